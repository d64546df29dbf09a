"""Every query on odd and empty tables, against plain Python."""

import collections
import hashlib
import math
import re
import zlib

import duckdb
import numpy as np
import pandas as pd
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from slotwise.llm import language, mixing, oracle
from slotwise.llm.queries import queries, vocabulary
from tests.llm.conftest import ODD

QUERIES = {k: f for k, f in queries().items() if k != "pipeline"}


def crc(doc_id, divisor):
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % divisor


def rows(spark, name, path):
    return [r.asDict() for r in QUERIES[name](spark, path).collect()]


def by_id(found):
    """Results by id; repeated rows have equal results."""
    out = {}
    for r in found:
        assert out.setdefault(r["doc_id"], r) == r
    return out


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_empty_tables_give_no_rows(spark, empty_dir, name):
    assert rows(spark, name, empty_dir) == []


@pytest.mark.parametrize("name", sorted(oracle.oracle_sql()))
@pytest.mark.parametrize("where", ["odd", "small"])
def test_equals_sql(spark, odd_dir, name, where):
    path = odd_dir if where == "odd" else "/root/testdata/sf0.001"
    con = duckdb.connect()
    for table in ("documents", "labels", "embeddings", "benchmark"):
        part = "/*.parquet" if where == "odd" else ""
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{path}/{table}.parquet{part}')")
    mine = QUERIES[name](spark, path).toPandas()
    theirs = con.execute(oracle.oracle_sql()[name]).df()
    columns = sorted(mine.columns)
    assert columns == sorted(theirs.columns)

    def plain(df):
        cells = lambda r: tuple("null" if pd.isna(x) else x if isinstance(x, str) else float(x) for x in r)
        return sorted(str(cells(r)) for r in df[columns].astype(object).itertuples(index=False))

    assert plain(mine) == plain(theirs)


def test_language(spark, odd_dir):
    got = by_id(rows(spark, "op2_language", odd_dir))
    assert {i for i, *_ in ODD} == set(got)
    for i, text, *_ in ODD:
        assert got[i]["held_out"] == (crc(i, 4) == 2) and 0 <= got[i]["score"] <= 1
        if text is None or not any(map(str.isalpha, text)):
            assert got[i]["lang_pred"] == "und"

    # profiles and distances, the plain way
    def grams(text):
        letters = f" {re.sub(r'[\W\d_]+', ' ', text.lower())} "
        return collections.Counter(g for k in (1, 2, 3) for a in range(len(letters) - k + 1) if (g := letters[a : a + k]) != " ")

    def ranks(counts):
        code = lambda g: sum(ord(c) << 21 * (len(g) - 1 - k) for k, c in enumerate(g))
        return {g: k for k, g in enumerate(sorted(counts, key=lambda g: (-counts[g], code(g)))[: language.PROFILE_SIZE])}

    learned = collections.defaultdict(collections.Counter)
    for i, text, lang, _ in ODD:
        if crc(i, 4) != 2 and lang and text and any(map(str.isalpha, text)):
            learned[lang].update(grams(text))
    profiles = {lang: ranks(c) for lang, c in learned.items()}
    for i, text, *_ in ODD:
        if text and any(map(str.isalpha, text)):
            own = ranks(grams(text))
            far = {x: sum(abs(p[g] - k) if g in p else language.PROFILE_SIZE for g, k in own.items()) for x, p in profiles.items()}
            best = min(sorted(far), key=far.get)
            assert got[i]["lang_pred"] == best
            assert got[i]["score"] == pytest.approx(1 - far[best] / (language.PROFILE_SIZE * len(own)))


def test_language_on_held_out_documents(spark):
    path = "/root/testdata/sf0.001"
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{path}/documents.parquet").collect()}
    found = [r for r in rows(spark, "op2_language", path) if r["held_out"] and truth[r["doc_id"]]]
    assert np.mean([r["lang_pred"] == truth[r["doc_id"]] for r in found]) >= 0.95


BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def valid(kind, text):
    digits = [int(c) for c in text if c in "0123456789"]
    if kind == "ip":
        return all(len(p.lstrip("0")) < 4 and int(p.lstrip("0") or 0) <= 255 for p in text.split("."))
    if kind == "card":
        doubled = [d * 2 - 9 * (d > 4) if k % 2 else d for k, d in enumerate(reversed(digits))]
        return 12 <= len(digits) <= 19 and sum(doubled) % 10 == 0
    return kind == "email" or 9 <= len(digits) <= 15


@pytest.mark.parametrize("where", ["odd", "small"])
def test_personal_data(spark, odd_dir, where):
    path = odd_dir if where == "odd" else "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{path}/documents.parquet").collect()}
    got = by_id(rows(spark, "op6_pii", path))
    for i, text in texts.items():
        spans = sorted(
            (m.start(), rank, m.end(), kind)
            for rank, kind in enumerate(BASE) for m in re.finditer(BASE[kind], text or "") if valid(kind, m.group())
        )
        joined = ",".join(f"{k}:{a}:{b}" for a, _, b, k in spans)
        assert [got[i][f"n_{k}"] for k in BASE] == [sum(s[3] == k for s in spans) for k in BASE]
        assert got[i]["base_sha256"] == hashlib.sha256(joined.encode()).hexdigest()
        assert set(joined.split(",")) <= {*got[i]["spans"].split(","), ""}
    if where == "odd":
        assert sum(x.startswith("secret") for x in got[12]["spans"].split(",")) == 2


@pytest.mark.parametrize("where", ["odd", "small"])
def test_byte_bpe(spark, odd_dir, where):
    path = odd_dir if where == "odd" else "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{path}/documents.parquet").collect()}
    theirs = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=vocabulary().ranks, special_tokens={})
    for i, r in by_id(rows(spark, "op9_byte_bpe", path)).items():
        ids = theirs.encode_ordinary(texts[i])
        assert r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(texts[i].encode()).hexdigest()


@pytest.mark.parametrize("where", ["odd", "small"])
def test_language_model(spark, odd_dir, where):
    path = odd_dir if where == "odd" else "/root/testdata/sf0.001"
    texts = [(r.doc_id, r.text) for r in spark.read.parquet(f"{path}/documents.parquet").collect()]
    tokens = lambda t: [*(t or "").encode().lower().split(), b""]
    count = collections.Counter(x for i, t in texts if crc(i, 7) != 2 for x in tokens(t))
    n, v = sum(count.values()), len(count)
    got = by_id(rows(spark, "op10_lm_score", path))
    for i, t in texts:
        own, r = tokens(t), got[i]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (crc(i, 7) == 2, len(own), sum(x in count for x in own), n)
        assert r["base_score"] == pytest.approx(sum(math.log10((count[x] + 1) / (n + v + 1)) for x in own))
        assert math.isfinite(r["score"]) and r["score"] < 0


def test_mixing_meets_targets(spark):
    path = "/root/testdata/sf0.001"
    found = rows(spark, "op5_mixing", path)
    tokens = np.array([r["n_tokens"] for r in found])
    p = np.array([[r["p_good"], r["p_poor"], r["p_toxic"]] for r in found])
    rate = np.array([r["rate"] for r in found])
    assert (rate >= 0).all() and np.allclose(p.sum(axis=1), 1)

    aim = np.array([0.90, 0.08, 0.02])
    miss = lambda r: np.abs((tokens * r) @ p / tokens.sum() - aim).max()
    assert miss(rate) < miss(np.ones(len(rate)))
    copies = np.array([r["copies"] for r in found])
    assert (np.abs(copies - rate) < 1).all()


def members_of(spark, tokens, p):
    return spark.createDataFrame([(int(n), [float(x) for x in q]) for n, q in zip(tokens, p, strict=True)], "n_tokens long, p array<double>")


def plain_rates(tokens, p, aim, most, steps=20_000):
    """Many plain projected steps, for misses weighted by the inverse of the second moments."""
    weight = np.linalg.inv((tokens[:, None] * p).T @ p / tokens.sum() + mixing.RIDGE * np.eye(p.shape[1]))
    rate = np.ones(len(p))
    for _ in range(steps):
        rate = np.clip(rate - p @ (weight @ ((tokens * rate) @ p / tokens.sum() - aim)), 0, most)
    return rate


@pytest.mark.parametrize("most", [1.2, 50.0])
def test_steps_come_to_the_plain_solution(spark, monkeypatch, most):
    """Targets in reach of the rates, and targets out of their box; tables of rates are written on the way."""
    monkeypatch.setattr(mixing, "WRITE_EVERY", 5)
    rng = np.random.default_rng(3)
    p = rng.dirichlet([0.15, 0.15, 0.15], 400)
    tokens = rng.integers(0, 2000, 400)
    aim = np.array([0.7, 0.25, 0.05])
    found = mixing.fitted(members_of(spark, tokens, p).withColumn("key", F.monotonically_increasing_id()).repartition(7), list(aim), most).orderBy("key").toPandas()
    rate, plain = found["rate"].to_numpy(), plain_rates(tokens, p, aim, most)
    shares = lambda r: (tokens * r) @ p / tokens.sum()
    assert (rate >= 0).all() and (rate <= most).all() and (rate[tokens == 0] == 1).all()
    assert np.abs(shares(rate) - shares(plain)).max() < (1e-3 if most > 2 else 3e-3)
    assert (np.abs(shares(rate) - aim).max() < mixing.TOLERANCE) == (most > 2)


def test_mixing_and_toxicity_on_odd_rows(spark, odd_dir):
    mixed = by_id(rows(spark, "op5_mixing", odd_dir))
    scored = by_id(rows(spark, "op3_toxicity", odd_dir))
    assert set(mixed) == set(scored) == {i for i, *_ in ODD}
    assert mixed[1]["n_tokens"] == 0 and mixed[4]["n_tokens"] == 6_000
    for i, r in scored.items():
        assert r["held_out"] == (crc(i, 5) == 0) and 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5)
    assert scored[1]["score"] == scored[2]["score"] == scored[3]["score"]


def test_soft_members_are_bounded_and_survive(spark):
    """Soft posteriors that allow the targets with rates up to 3 or so, and softer ones that don't allow them at all: most documents stay,
    none is taken more than MAX_RATE times, and the miss is told."""
    rng = np.random.default_rng(5)
    logits = rng.normal(size=(2000, 3))
    logits[np.arange(2000), rng.choice(3, 2000, p=[0.76, 0.13, 0.11])] += 2
    p = np.exp(1.6 * logits)
    p /= p.sum(axis=1, keepdims=True)
    tokens = rng.integers(1, 2000, 2000)

    def solved(p, most):
        rated = mixing.fitted(members_of(spark, tokens, p).repartition(5), [0.90, 0.08, 0.02], most).cache()
        found = rated.toPandas()
        rate, n, q = found["rate"].to_numpy(), found["n_tokens"].to_numpy(), np.stack(found["p"])
        miss = (n * rate) @ q / n.sum() - [0.90, 0.08, 0.02]
        assert (rate >= 0).all() and (rate <= most).all() and list(mixing.missed(rated).values()) == pytest.approx(list(miss))
        return np.abs(miss).max(), (rate > 0).mean()

    assert solved(p, 4.0)[0] < mixing.TOLERANCE
    for own in (p, 0.7 * p + 0.1):
        miss, kept = solved(own, mixing.MAX_RATE)
        assert miss > mixing.TOLERANCE and kept > 0.5


@pytest.mark.parametrize("size", ["sf0.001", "sf0.01"])
def test_no_rates_in_the_box_come_nearer_to_the_targets(spark, size):
    """The optimum of weighted least squares, and most documents are still there."""
    found = rows(spark, "op5_mixing", f"/root/testdata/{size}")
    copies = np.array([r["copies"] for r in found])
    assert copies.max() <= mixing.MAX_RATE + 1 and (copies > 0).mean() > 0.4
    assert all(r["rate"] == 1 for r in found if not r["n_tokens"])
    found = [r for r in found if r["n_tokens"]]
    p = np.array([[r["p_good"], r["p_poor"], r["p_toxic"]] for r in found])
    tokens, rate = np.array([r["n_tokens"] for r in found]), np.array([r["rate"] for r in found])
    aim = np.array([0.90, 0.08, 0.02])
    weight = np.linalg.inv((tokens[:, None] * p).T @ p / tokens.sum() + mixing.RIDGE * np.eye(3))
    pull = p @ (weight @ ((tokens * rate) @ p / tokens.sum() - aim))
    still = rate - np.clip(rate - pull, 0, mixing.MAX_RATE)
    assert np.sqrt((tokens * still**2).sum() / tokens.sum()) < 0.02 or np.abs((tokens * rate) @ p / tokens.sum() - aim).max() < mixing.TOLERANCE
