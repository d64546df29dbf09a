import pytest
from pyspark.sql import functions as F

WORDS = "the of and a in to is was for on that with as it by at from his an were are which this also be has had".split()
LONG = " ".join(f"{WORDS[i * 7 % 27]}{i % 1000}" for i in range(6_000))
#: Names that operators use inside; tables may have columns of these names.
CLASHING = ("key", "item", "bucket", "score", "votes", "ids", "word", "slot", "n", "kept", "hash", "row_id", "_text", "class_id", "rate")

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
ODD = [
    (None, "a document without an id that says something about the weather in the north", "en", "s1"),
    (1, None, "en", "s1"),
    (2, "", None, None),
    (3, " \t\n \r\n", "de", "s1"),
    (4, LONG, "en", "s2"),
    (5, LONG, "en", "s2"),
    (6, "word", "en", "s2"),
    (7, "two words", "en", None),
    (7, "two words", "en", None),
    (8, "Schöne Grüße aus dem Süden, wo die Sonne scheint und niemand friert 😀 größer", "de", "s1"),
    (9, "1234 5678 !!! ### $$$ \x0b\x0c   \xa0 x", None, "s3"),
    (10, "mail a.b@c.de or b@c.d.e_f@g.hi then 10.0.0.255 and 1.2.3.4.5.6.7.8 and 300.1.1.1 or 001.002.003.0255", "en", "s3"),
    (11, "card 4111 1111 1111 1111 and 4111-1111-1111-1112, call +1 (988) 555-2485 or +49 30 123 or +1-2", "en", "s3"),
    (12, "password=c1f6c02f845bf3028d token = \"0641917ea4e9feb9cda83477b57ac265\" page12345678", "en", "s3"),
    (13, "9" * 5000 + "." + "1." * 3000 + "@" + "a." * 3000 + " " + "-" * 3000 + "+1" + ".(" * 2000, "en", "s3"),
    (14, "l'été d'après, on s'en va\n\n\nl'été d'après, on s'en va\nà bientôt " * 3, "fr", "s1"),
]


def documents(spark, rows, extra=False):
    df = spark.createDataFrame([(i, t, lang, s, len(t or "")) for i, t, lang, s in rows], DOCS)
    return df.withColumns({c: F.lit(f"extra {c}") for c in CLASHING}) if extra else df


def pseudo(n, seed=0):
    """Different prose of several lines, the same on every run."""
    out = []
    for k in range(n):
        x, words = (k + 1) * 7919 + seed, []
        for i in range(60 + k % 40):
            x = (x * 1103515245 + 12345) % 2**31
            words.append(WORDS[x % 27] + WORDS[x // 27 % 27] + ("." if i % 12 == 11 else "") + ("\n" if i % 20 == 19 else ""))
        out.append(" ".join(words))
    return out


@pytest.fixture(scope="session")
def odd(spark):
    return documents(spark, ODD, extra=True).cache()


@pytest.fixture(scope="session")
def odd_dir(spark, odd, tmp_path_factory):
    """A folder of tables with odd rows and clashing columns."""
    return folder(spark, tmp_path_factory.mktemp("odd"), odd)


@pytest.fixture(scope="session")
def empty_dir(spark, tmp_path_factory):
    return folder(spark, tmp_path_factory.mktemp("empty"), documents(spark, []), [], [])


def folder(spark, path, docs, labels=((1, 1, 0), (4, 1, 0), (4, 0, None), (8, 0, None), (None, 1, 1), (10, 1, 1), (99, 0, 1)), vectors=None):
    if vectors is None:
        vectors = [(1, [1.0, 0.0]), (2, [1.0, 0.01]), (3, None), (4, [0.0, 0.0]), (5, [float("nan"), 1.0]), (6, [None, 1.0]), (7, [2.0, 0.0]),
                   (7, [2.0, 0.0]), (None, [1.0, 0.0]), (9, [1.0, 0.0, 0.0]), (10, []), (11, [-1.0, 0.0]), (12, [3e38, 0.0])]
    docs.write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(list(labels), "doc_id long, quality int, toxic int").withColumn("mark", F.lit("x")).write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame(list(vectors), "vec_id long, embedding array<float>").withColumns(
        {"label": F.lit(None).cast("int"), "item": F.lit(1), "bucket": F.lit(2)}
    ).write.parquet(f"{path}/embeddings.parquet")
    items = [(1, "the weather in the north, THE weather"), (2, None), (3, ""), (None, "two words Süden"), (4, "words words x9 1234"), (4, "nothing_that_is_there")]
    spark.createDataFrame(items if docs.take(1) else [], "item_id long, text string").withColumns({"rank": F.lit(1), "query": F.lit("x")}).write.parquet(f"{path}/benchmark.parquet")
    return str(path)
