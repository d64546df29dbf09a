"""The operators' own interfaces: rollups, hashing, groups, learned toxicity, and the pipeline's stages."""

import itertools

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from slotwise.llm import embedding_dup, lexicon, line_quality, lm_score, mixing, ngram_join, pairs, token_counts, toxicity
from slotwise.llm.pairs import components
from tests.llm.conftest import ODD, documents, pseudo


def change(op, n=None, old=None, source="s", lang="en", tokenizer="v1"):
    return op, source, lang, tokenizer, n, old


def batch(spark, *rows):
    return spark.createDataFrame(list(rows), token_counts.CHANGES)


def totals(rollup):
    return {(r.source, r.lang, r.tokenizer): (r.n_documents, int(r.n_tokens)) for r in rollup.totals().collect()}


def test_rollup_of_signed_batches(spark, tmp_path):
    rollup = token_counts.Rollup(spark, str(tmp_path / "a"))
    assert totals(rollup) == {}
    first = batch(spark, change("insert", 10), change("insert", 5), change("insert", 7, source=None), change("insert", None, lang="de"))
    second = batch(spark, change("delete", old=5), change("revise", 12, 10), change("delete", old=7, source=None))
    rollup.commit("a/1", first)
    rollup.commit("2", second)
    expected = {("s", "en", "v1"): (1, 12), ("s", "de", "v1"): (1, 0)}
    assert totals(rollup) == expected
    rollup.commit("a/1", first)  # sent again
    rollup.commit("2", second)
    rollup.commit("empty", batch(spark))
    assert totals(rollup) == expected
    folded = rollup.compacted(str(tmp_path / "b"), ["a/1", "2"])
    folded.commit("2", second)
    assert totals(folded) == expected
    folded.commit("3", batch(spark, change("insert", 2**62), change("insert", 2**62)))
    assert totals(folded)["s", "en", "v1"] == (3, 12 + 2**63)
    with pytest.raises(Exception, match="unknown kind"):
        folded.commit("4", batch(spark, change(None, 1)))
    assert totals(folded)["s", "en", "v1"] == (3, 12 + 2**63)


def test_a_failing_repeat_leaves_the_first_commit(spark, tmp_path):
    rollup = token_counts.Rollup(spark, str(tmp_path / "a"))
    rollup.commit("1", batch(spark, change("insert", 10)))
    with pytest.raises(Exception, match="unknown kind"):
        rollup.commit("2", batch(spark, change("insert", 5), change("unknown", 1)))
    broken = batch(spark, change("insert", 10)).filter(F.raise_error(F.lit("lost")).isNull())
    with pytest.raises(Exception, match="lost"):
        broken.count()
    rollup.commit("1", broken)  # sent again by a driver whose input is gone: the committed folder isn't touched
    assert totals(rollup) == {("s", "en", "v1"): (1, 10)}
    rollup.commit("2", batch(spark, change("insert", 5)))  # what the failed attempt left is replaced
    assert totals(rollup) == {("s", "en", "v1"): (2, 15)}


def test_components_of_chains_stars_and_rings(spark):
    name = lambda k: k.to_bytes(4, "big")
    edges = [(k, k + 1) for k in range(40)] + [(100, k) for k in range(101, 160)] + [(200, 201), (201, 202), (202, 200)] + [(300, 300)]
    df = spark.createDataFrame([(name(a), name(b)) for a, b in edges + edges[:5]], "item binary, root binary")
    found = {int.from_bytes(r.item, "big"): int.from_bytes(r.component, "big") for r in components(df).collect()}
    expected = {k: 0 for k in range(41)} | {k: 100 for k in range(100, 160)} | {k: 200 for k in range(200, 203)}
    assert found == expected


def test_near_copies_are_linked_and_counted(spark):
    """A group of many near copies larger than a block, against all pairs."""
    base = pseudo(1)[0].split()
    texts = pseudo(40, seed=5)
    for k in range(300):
        words = list(base)
        words[k % len(base)] = f"changed{k}"
        texts.append(" ".join(words))
    texts += texts[:3]
    docs = documents(spark, [(k, t, "en", "s") for k, t in enumerate(texts)])
    sets = [frozenset(zip(*[t.split()[k:] for k in range(5)], strict=False)) for t in texts]
    links = {k: set() for k in range(len(sets))}
    for a, b in itertools.combinations(range(len(sets)), 2):
        if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) - 1e-9:
            links[a].add(b)
            links[b].add(a)
    found = {r.doc_id: r for r in ngram_join.links(docs).collect()}
    for k, own in links.items():
        assert found[k].n_links == len(own)
    assert {found[k].class_id for k in range(40, 340)} == {40}
    assert [r.doc_id for r in ngram_join.deduplicated(docs).orderBy("doc_id").collect()] == list(range(41))


def test_hashing_finds_pairs_at_the_threshold():
    rng = np.random.default_rng(1)
    for width in (8, 64, 100):
        x = rng.normal(size=(1500, width))
        z = rng.normal(size=x.shape)
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        z -= (z * x).sum(axis=1, keepdims=True) * x
        y = 0.95 * x + np.sqrt(1 - 0.95**2) * z / np.linalg.norm(z, axis=1, keepdims=True)
        pairs = zip(embedding_dup.buckets(x), embedding_dup.buckets(y), strict=True)
        assert np.mean([len(np.intersect1d(a, b)) > 0 for a, b in pairs]) > 0.998


def vectors_of(spark, rows):
    return spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(rows)], "vec_id long, embedding array<double>")


def near(rng, center, n, by):
    x = center + by * rng.normal(size=(n, len(center)))
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def test_vectors_go_to_no_bucket(spark, monkeypatch):
    """Different vectors share many buckets; only those that their sketches link send their vectors, once."""
    rng = np.random.default_rng(4)
    rows = np.concatenate([rng.normal(size=(3000, 64)), near(rng, rng.normal(size=64) / 8, 20, 0.0125)])
    seen = []
    linked = pairs.linked
    monkeypatch.setattr(pairs, "linked", lambda members, *more: seen.append(members.count()) or linked(members, *more))
    found = embedding_dup.links(vectors_of(spark, rows))
    assert {r.n_links for r in found.filter("vec_id >= 3000").collect()} == {19} and found.filter("vec_id < 3000 AND n_links > 0").count() == 0
    assert seen == [20]


def test_links_of_vectors_against_all_pairs(spark):
    """A cluster, a chain that goes bucket by bucket, copies, strangers and another length; buckets and groups cut small."""
    rng = np.random.default_rng(5)
    chain = [rng.normal(size=64) / 8]
    for _ in range(199):  # steps of 10 degrees; two of them are 14 degrees or so
        step = rng.normal(size=64)
        step -= (step @ chain[-1]) * chain[-1] / (chain[-1] @ chain[-1])
        chain.append(chain[-1] / np.linalg.norm(chain[-1]) + np.tan(np.radians(10)) * step / np.linalg.norm(step))
    same = rng.normal(size=64)
    rows = [*near(rng, rng.normal(size=64) / 8, 150, 0.02), *chain, same, same, 2 * same, *rng.normal(size=(300, 64)), *near(rng, rng.normal(size=48) / 7, 5, 0.01)]
    unit = [v / np.linalg.norm(v) for v in rows]
    linked = np.array([[i != j and len(x) == len(y) and x @ y >= 0.95 for j, y in enumerate(unit)] for i, x in enumerate(unit)])
    group = np.arange(len(rows))
    while True:
        new = np.where(linked, group[None, :], group[:, None]).min(axis=1)
        if (new == group).all():
            break
        group = new
    for cut in ({}, {"large": 16, "whole": 4}):
        found = {r.vec_id: r for r in embedding_dup.links(vectors_of(spark, rows), **cut).collect()}
        assert [found[k].n_links for k in range(len(rows))] == linked.sum(axis=1).tolist()
        assert [found[k].component_id for k in range(len(rows))] == group.tolist()
        assert all(r.kept == (r.vec_id == r.component_id) for r in found.values())


def test_partners_are_found_in_runs_of_any_length():
    """Rows with a partner in their bucket and their groups, however rows come in batches, against all pairs."""
    rng = np.random.default_rng(6)
    sizes = [1, 2, 3, 32, 33, 50, 60, 61, 62, 200, 1, 1, 2, 40]
    bucket = np.repeat(np.arange(len(sizes)) - 5, sizes)
    seeds = rng.integers(-(2**63), 2**63, (len(bucket), 4))
    words = np.where(rng.random(len(bucket))[:, None] < 0.5, seeds[bucket * 7 % 5], seeds) ^ (1 << rng.integers(0, 63, (len(bucket), 4)))
    apart = np.array([[sum(bin((int(a) ^ int(b)) & (2**64 - 1)).count("1") for a, b in zip(x, y, strict=True)) for y in words] for x in words])
    close = (apart <= 20) & (bucket[:, None] == bucket) & ~np.eye(len(bucket), dtype=bool)
    columns = [pa.array(bucket), pa.array(np.arange(len(bucket))), *(pa.array(words[:, k]) for k in range(4))]
    batch = pa.RecordBatch.from_arrays(columns, names=["bucket", "n", *embedding_dup.WORDS])
    for step in (1, 7, 64, 1000):
        out = pa.Table.from_batches(embedding_dup.allowed(20, 60)(batch.slice(k, step) for k in range(0, batch.num_rows, step))).to_pylist()
        large = {r["n"]: [r[w] for w in embedding_dup.WORDS] for r in out if r["root"] is None}
        assert large == {k: words[k].tolist() for k in range(len(bucket)) if sizes[bucket[k] + 5] > 60}
        roots = {r["n"]: r["root"] for r in out if r["root"] is not None}
        assert len(out) == len(large) + len(roots) and set(roots) == set(np.flatnonzero(close.any(axis=1))) - set(large)
        assert all(roots[i] == roots[j] for i, j in np.argwhere(close).tolist() if i in roots)
        assert all(bucket[n] == bucket[root] and roots[root] == root for n, root in roots.items())


def test_sketches_tell_angles():
    """At the threshold sketches differ in as many bits as chance has it, and never in too many."""
    rng = np.random.default_rng(7)
    for width in (2, 3, 64, 300):
        x = rng.normal(size=(4000, width))
        z = rng.normal(size=x.shape)
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        z -= (z * x).sum(axis=1, keepdims=True) * x
        y = 0.95 * x + np.sqrt(1 - 0.95**2) * z / np.linalg.norm(z, axis=1, keepdims=True)
        apart = [bin((int(a) ^ int(b)) & (2**64 - 1)).count("1") for a, b in zip(embedding_dup.sketches(x).ravel(), embedding_dup.sketches(y).ravel(), strict=True)]
        apart = np.reshape(apart, (-1, 4)).sum(axis=1)
        assert abs(apart.mean() - 256 * np.arccos(0.95) / np.pi) < 1 and apart.max() <= embedding_dup.most_apart(0.95) < 70


def test_toxic_documents_are_learned(spark):
    """Insults that no fixed list knows, told from held-out labels."""
    rows, marks = [], []
    for k, text in enumerate(pseudo(600)):
        toxic = k % 6 == 0
        rows.append((k, text + (f" you grobbler{k % 9} and snarkwit" if toxic else ""), "en", "s"))
        marks.append((k, 1, int(toxic)))
    docs = documents(spark, rows).select("doc_id", (F.col("doc_id") % 5 != 0).alias("learn"), "text")
    labels = lexicon.marked_labels(spark.createDataFrame([m for m in marks if m[0] % 5], "doc_id long, quality int, toxic int"), F.col("toxic"))
    found = toxicity.scored(docs, labels).filter("doc_id % 5 = 0").collect()
    assert all((r.score >= 0.5) == (r.doc_id % 6 == 0) for r in found)


def test_class_model_is_a_distribution(spark):
    """Over all words and the unknown one, the chances of a next token add up to one."""
    docs = documents(spark, [(k, t, "en", "s") for k, t in enumerate(pseudo(30))])
    counts = lm_score.counted(docs).cache()
    model = lm_score.trained(docs, lm_score.started(counts))
    codes = np.array(sorted(r.code for r in counts.collect()))
    n = {r.code: r.n for r in counts.collect()}
    classes = model.classes(codes, model.places(codes))
    slots = model.slots(codes[:50], np.array([0]))
    p = model.chances(slots, model.weights)
    assert np.allclose(p.sum(axis=1), 1, atol=1e-5)
    within = np.array([n[c] + 1 for c in codes]) / model.totals[classes]
    sums = np.bincount(classes, within, lm_score.CLASSES) + 1 / model.totals
    assert np.allclose(sums, 1)


def test_stages_of_the_pipeline(spark, odd_dir):
    import corpus_pipeline

    prose = pseudo(30)
    near = prose[0].split()
    near[3] = "other"
    rows = [*ODD, *((100 + k, t, "en", "s9") for k, t in enumerate(prose)), (200, prose[0], "en", "s1"), (201, " ".join(near), "en", "s2"),
            (202, prose[1] + "\nwrite to anna.b@mail.example.com or 10.1.2.3 now", "en", "s9")]
    docs = documents(spark, rows)
    stages = dict(corpus_pipeline.STAGES)
    columns = docs.columns

    clean = stages["quality_rules"](spark, docs, odd_dir).cache()
    assert clean.columns == columns
    assert {100, 129, 200, 201, 202} <= {r.doc_id for r in clean.collect()} and 6 not in {r.doc_id for r in clean.collect()}
    single = stages["near_duplicates"](spark, docs, odd_dir).cache()
    kept = [r.doc_id for r in single.collect()]
    assert single.columns == columns and {100, 101, 4} <= set(kept) and not {200, 201, 5} & set(kept) and kept.count(7) == 1
    safe = {r.doc_id: r for r in stages["personal_data"](spark, docs, odd_dir).collect()}
    assert safe[202].text.endswith("write to <EMAIL> or <IP> now") and safe[202].n_chars == len(safe[202].text)
    assert safe[101].text == prose[1] and safe[1].text is None and len(safe) == len({r[0] for r in rows})
    mixed = stages["mixing"](spark, docs, odd_dir)
    assert mixed.columns == columns and {r.doc_id for r in mixed.collect()} <= {r[0] for r in rows}
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, documents(spark, []), odd_dir).count() == 0, name


def test_lines_of_a_hot_host_go_below_five_percent(spark):
    """A line in 2,050 of 42,000 documents of a host; 50 more documents are made of it."""
    hashed = F.concat_ws("", *(F.sha2(F.concat_ws("-", "id", F.lit(k)), 256) for k in range(4)))
    prose = F.regexp_replace(F.translate(hashed, "0123456789", "ghijklmnop"), "(.{4})", "$1 ")
    line = " ".join(f"all rights {w} reserved" for w in "of the and a in to is was for on that with as it by".split())
    start = F.substring(prose, 1, 300)  # 60 words
    text = F.when(F.col("id") < 2050, F.concat(start, F.lit(f"\n{line[:60]}"))).when(F.col("id") < 2100, F.concat(F.substring(prose, 1, 50), F.lit(f"\n{line}"))).otherwise(start)
    docs = spark.range(42_000).select(F.col("id").alias("doc_id"), text.alias("text"), F.lit("en").alias("lang"), F.lit("hot").alias("source"))
    judged = line_quality.judged(docs).filter("doc_id < 2100").agg(F.sum(F.col("kept").cast("int")).alias("kept"), F.min("removed_words").alias("removed")).first()
    assert judged["kept"] == 2050 and judged["removed"] > 0
    out = line_quality.cleaned(docs).agg(F.count("*").alias("n"), F.sum(F.col("text").contains("rights").cast("int")).alias("held")).first()
    assert (out["n"], out["held"]) == (42_000 - 50, 0)


def test_words_end_at_every_sign():
    """Elisions, hyphens, slashes, missing blanks, dashes, markup, underscores and quotes; the plain way is one pass over characters."""
    joined = ["l'ordure", "d’idiot", "you-idiot", "scum/trash", "idiot,moron", "so.stupid", "loser—clown", "<b>idiot</b>", "you_idiot", "'dumm'trottel", "¡estúpido!basura"]
    for text in [*joined, " ".join(joined), *(t for _, t, *_ in ODD if t), "", None]:
        plain = "".join(c if c.isalnum() else " " for c in (text or "").lower()).split()
        assert lexicon.words_of(text) == set(plain)
    match = lexicon.Matcher(list(toxicity.INSULTS))
    assert all(match(text) for text in joined)


def test_insults_in_joined_runs_are_votes(spark):
    docs = documents(spark, [(0, "prose (d'idiot) here", "fr", "s"), (1, "prose you-moron,here", "en", "s"), (2, "plain prose", "en", "s")]).select("doc_id", "text")
    votes = {r.doc_id: r.votes for r in toxicity.voted(docs, []).collect()}
    assert votes[0] and votes[1] and not votes[2]


def test_lexicons_come_from_all_labelled_documents(spark, monkeypatch):
    """A word in few toxic texts is a feature even if the classifier is fitted on a small share of the labels."""
    rows = [(k, f"{text} snarkwit" if k % 60 == 0 else text, "en", "s") for k, text in enumerate(pseudo(1200))]
    docs = documents(spark, rows).withColumn("learn", F.lit(True)).select("doc_id", "learn", "text")
    marks = spark.range(1200).select(F.col("id").alias("doc_id"), (F.col("id") % 10 == 0).cast("int").alias("mark"))
    given = []
    monkeypatch.setattr(toxicity, "voted", lambda docs, words, f=toxicity.voted: given.append(words) or f(docs, words))
    monkeypatch.setattr(mixing, "featured", lambda docs, words, f=mixing.featured: given.append(words) or f(docs, words))
    toxicity.scored(docs, marks, max_labelled=40)
    mixing.posteriors(docs.select("doc_id", "text"), marks.select("doc_id", (F.col("mark") * 2).alias("domain")), max_labelled=40)
    assert len(given) >= 2 and all("snarkwit" in words for words in given)


def test_rows_of_cut_buckets_grow_with_blocks(spark):
    """A bucket of many blocks has one row for each block and pair of blocks, and every pair of its items once."""
    members = spark.range(3000).selectExpr("id % 2 * 5 + 1 AS bucket", "cast(cast(id AS string) AS binary) AS item").union(
        spark.createDataFrame([(9, b"x"), (9, b"y"), (10, b"z")], "bucket long, item binary"))
    dealt = pairs.dealt(members, 100)
    assert dealt.count() == 3002
    rows = pairs.packed(dealt.filter("blocks > 1"))
    assert rows.count() == 2 * 15 * 15

    def count(batches):
        for batch in batches:
            assert len({*batch.column("left").to_pylist()}) == 1
            items, (first, second) = batch.column("item").to_pylist(), pairs.candidate_pairs(batch)
            for i, j in zip(first.tolist(), second.tolist(), strict=True):
                yield pa.RecordBatch.from_arrays([pa.array([b"-".join(sorted([items[i], items[j]]))])], names=["pair"])

    small = pairs.dealt(members.filter("bucket > 6 OR try_cast(cast(item AS string) AS int) < 100"), 10)
    found = pairs.compared(small, count, "pair binary")
    assert found.count() == found.distinct().count() == 2 * (50 * 49 // 2) + 1


def test_only_rows_with_wanted_keys_go_on(spark):
    """Binary keys, repeated ones too; of 5,000 other rows hardly any shares a bit with a wanted one."""
    rows = spark.range(5050).selectExpr("unhex(md5(cast(id % 5040 AS string))) AS text_key", "id")
    wanted = rows.filter("id < 40").select("text_key").distinct()
    found = {r.id for r in lexicon.likely(rows, wanted, "text_key").collect()}
    assert found >= {*range(40), *range(5040, 5050)} and len(found) < 100


def test_words_are_matched_among_the_distinct_runs_of_a_text():
    """What featured() reads of a text, its distinct runs in any order, gives the same features and counts as the text itself."""
    import re

    from slotwise.llm.line_quality import repeated_words

    texts = ["ὈΔΟΣ ΟΔΟΣ ΑΣ' ΑΣ-Β l'ordure\xa0d'idiot x_y İdiot", "²x ½ ٣٤ _a_ é\x85t z z ﬁ STRASSE", "a b c a b c d " * 3 + "e", "", "a b", "a b c d"]
    for text in texts:
        plain = set(re.findall(r"[^\W_]+", text.lower()))
        words = text.encode().split()
        runs = set(words)
        match = lexicon.Matcher([*plain, "ordu*", "stras*", "straß*"])
        expected = plain | {w for w in ("ordu*", "stras*") if any(len(x) > len(w) - 1 and x.startswith(w[:-1]) for x in plain)}
        assert match(text) == match(b" ".join(runs).decode()) == expected
        windows = [tuple(words[k : k + 3]) for k in range(len(words) - 2)]
        covered = {k + j for k, w in enumerate(windows) if windows.count(w) > 1 for j in range(3)}
        assert repeated_words(words, distinct=runs) == repeated_words(words) == len(covered)


def test_features_are_counted_once_a_text(monkeypatch):
    """Against sets of strings; texts come in several batches, and counts are sent several times."""
    from collections import Counter

    monkeypatch.setattr(lexicon, "_FLUSH", 300)
    monkeypatch.setattr(lexicon, "_COUNT_BYTES", 2000)
    texts = [*(t for _, t, *_ in ODD), "straßen strasse straß stra ééééé éééé idiot idiots IDIOTEN", *pseudo(60), "idiot"]
    kinds = [k % 3 for k in range(len(texts))]
    expected = Counter()
    for text, kind in zip(texts, kinds, strict=True):
        words = lexicon.words_of(text)
        expected.update((x, kind) for x in words | {w[:k] + "*" for w in words for k in lexicon.BEGINNINGS if len(w) > k})
    found, sent = Counter(), 0
    for rows in lexicon._counted(3)(iter(pa.table({"text": texts, "kind": kinds}).to_batches(max_chunksize=9))):
        sent += 1
        for r in rows.to_pylist():
            found.update({(r["feature"], k): r[f"n{k}"] for k in range(3) if r[f"n{k}"]})
    assert found == expected and sent > 2


def test_counting_features_costs_little_more_than_cutting_words():
    """Words that a task knows are not taken apart again: counting their features takes less than 2.5 times what cutting them takes."""
    import time

    words = ["".join(chr(97 + (k * 7919 >> 5 * j) % 26) for j in range(8)) for k in range(20_000)]
    texts = [" ".join(words[(k * 37 + i * 13) % len(words)] for i in range(300)) for k in range(2000)]
    rows = pa.table({"text": texts, "kind": [k % 3 for k in range(2000)]}).to_batches()

    def least(run) -> float:
        spent = []
        for _ in range(5):
            start = time.process_time()
            run()
            spent.append(time.process_time() - start)
        return min(spent)

    assert least(lambda: list(lexicon._counted(3)(iter(rows)))) < 2.5 * least(lambda: [lexicon._encoded_words(t) for t in texts])


def test_a_task_gives_its_memory_back(spark, monkeypatch):
    """Spark keeps Python processes for later tasks; one that has signed texts of many words must not hold them."""
    import gc
    import re
    from pathlib import Path

    def own() -> float:
        gc.collect()
        return int(re.search(r"RssAnon:\s+(\d+)", Path("/proc/self/status").read_text())[1]) / 1024

    docs = documents(spark, [])
    tasks = []
    monkeypatch.setattr(type(docs), "mapInArrow", lambda self, run, schema: tasks.append(run))
    ngram_join.signatures(docs)

    def batches():
        for k in range(40):
            texts = [" ".join(f"word{k}x{i}x{j}" for j in range(200)) for i in range(35)]
            yield pa.table({"doc_id": pa.array(range(35)), "text_key": pa.array([b""] * 35), "text": texts}).combine_chunks().to_batches()[0]

    assert sum(x.num_rows for x in tasks[0](iter(list(batches())[:1]))) == 35  # what is loaded once for good
    before = own()
    assert sum(x.num_rows for x in tasks[0](batches())) == 1400
    assert own() - before < 12
