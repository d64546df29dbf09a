"""Toxicity by weak supervision: lexicon and pattern voters, a generative label model, a linear classifier.

Lexicons are words and word beginnings that labelled toxic texts hold far more often than others, and a short fixed list. They
are dealt over several voters; further voters look for shouting, runs of exclamation marks and direct address. Each voter fires
on a text or not. The label model holds, for toxic and other texts, the rate at which each voter fires and how far voters fire
together beyond that; correlated voters share their say. It is fitted by expectation maximisation on the counts of vote
patterns over all learned documents, labelled or not (known labels stay fixed). A linear classifier on the single words,
beginnings and votes is then trained on the posteriors, and scores every text.

The classifier is trained on at most ``max_labelled`` of the learned documents, labelled or not, half of them with a lexicon word or
vote where there are such, drawn by hash. Everything else sees all documents: the lexicon comes from all labelled ones. Only the lexicon (at most
2000 words), the weights and at most 2 ** voters counts reach the driver.

Null and empty texts have no features and get the score of the constant alone. Without labels, or with labels of one kind only,
the score follows the fixed list and the prior. Null ids and null labels are not learned from. Repeated rows are scored each by
itself; repeated labels of an id count as their greatest.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slotwise.llm import lexicon, linear
from slotwise.llm.common import map_steps, written

MAX_LABELLED = 20_000
WORD_VOTERS, BEGINNING_VOTERS = 6, 4
EM_ROUNDS = 20

# A fixed value: common insults in the four languages.
INSULTS = frozenset("idiot moron stupid loser trash scum pathetic worthless disgusting clown dumm trottel abschaum widerlich stupide ordure minable idiota estúpido basura asqueroso".split())

_PATTERNS = (
    lambda t: sum(map(str.isupper, t)) * 2 > sum(map(str.isalpha, t)) > 20,
    lambda t: "!!" in t,
    lambda t: re.search(r"\b(you are|you're|du bist|tu es|eres)\b", t, re.I) is not None,
)
VOTERS = WORD_VOTERS + BEGINNING_VOTERS + 1 + len(_PATTERNS)


def voter_of(feature: str) -> int:
    code = zlib.crc32(feature.encode())
    return WORD_VOTERS + code % BEGINNING_VOTERS if feature.endswith("*") else code % WORD_VOTERS


def voted(docs: DataFrame, words: list[str]) -> DataFrame:
    """doc_id, the columns beside text, votes (a bit for each voter), active: numbers of the lexicon features and, after
    them, of the voters that fired."""
    at = {w: k for k, w in enumerate(words)}
    kept = [f for f in docs.schema if f.name != "text"]

    def vote(batch: pa.RecordBatch) -> dict[str, list]:
        votes, active = [], []
        match = lexicon.Matcher([*at, *INSULTS])
        for text in batch.column("text").to_pylist():
            own = match(text)
            hits = sorted(at[w] for w in own if w in at)
            bits = 0
            for k in hits:
                bits |= 1 << voter_of(words[k])
            if own & INSULTS:
                bits |= 1 << (WORD_VOTERS + BEGINNING_VOTERS)
            for k, test in enumerate(_PATTERNS):
                if text and test(text):
                    bits |= 1 << (WORD_VOTERS + BEGINNING_VOTERS + 1 + k)
            votes.append(bits)
            active.append(hits + [len(words) + k for k in range(VOTERS) if bits >> k & 1])
        return {"votes": votes, "active": active} | {f.name: batch.column(f.name) for f in kept}

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept), "votes int, active array<int>"])
    return map_steps(docs, vote, schema)


def posteriors(patterns: list[tuple[int, int | None, int]], rounds: int = EM_ROUNDS) -> dict[int, float]:
    """For each vote pattern P(toxic), from (votes, label or None, count)."""
    if not patterns:
        return {}
    votes = np.array([[v >> k & 1 for k in range(VOTERS)] for v, _, _ in patterns], float)
    n = np.array([c for _, _, c in patterns], float)
    fixed = np.array([np.nan if mark is None else 0.02 + 0.96 * mark for _, mark, _ in patterns])
    known = ~np.isnan(fixed)
    lexical = np.arange(VOTERS) <= WORD_VOTERS + BEGINNING_VOTERS
    rate = np.stack([np.where(lexical, 0.01, 0.1), np.where(lexical, 0.4, 0.1)])
    prior, share = 0.05, np.ones(VOTERS)

    def odds() -> np.ndarray:
        llr = np.where(votes > 0, np.log(rate[1] / rate[0]), np.log((1 - rate[1]) / (1 - rate[0])))
        return np.log(prior / (1 - prior)) + llr @ share

    for _ in range(rounds):
        q = np.where(known, fixed, 1 / (1 + np.exp(-odds())))
        together = np.zeros((VOTERS, VOTERS))
        for y, weight in ((0, n * (1 - q)), (1, n * q)):
            total = weight.sum()
            rate[y] = (weight @ votes + 0.5) / (total + 1)
            away = votes - rate[y]
            spread = np.sqrt(rate[y] * (1 - rate[y]))
            together += (away * weight[:, None]).T @ away / (total + 1) / np.outer(spread, spread) / 2
        np.fill_diagonal(together, 0)
        share = 1 / (1 + np.maximum(together, 0).sum(axis=1))
        prior = float(np.clip((n * q).sum() / n.sum(), 1e-4, 0.5))
    return {v: float(p) for (v, _, _), p in zip(patterns, 1 / (1 + np.exp(-odds())), strict=True)}


def scored(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED) -> DataFrame:
    """docs: doc_id, text, learn (may be learned from); labels: doc_id, mark. Returns the columns beside text, and score."""
    labelled = lexicon.labelled_texts(docs.filter("learn").select("doc_id", "text"), labels)
    words = lexicon.found(labelled)
    votes = written(voted(docs, words), "votes")

    learned = votes.filter("learn").join(labels.hint("merge"), "doc_id", "left")
    counts = learned.groupBy("votes", "mark").agg(F.count("*").alias("n")).orderBy("votes", "mark").collect()
    chance = posteriors([(r["votes"], r["mark"], r["n"]) for r in counts])

    hit = F.size("active") > 0
    train = written(
        lexicon.bounded(learned.filter(hit), max_labelled // 2, "doc_id")
        .union(lexicon.bounded(learned.filter(~hit), max_labelled // 2, "doc_id"))
        .select("votes", "active"),
        "toxicity-training",
    )

    def aims(batch: pa.RecordBatch) -> dict[str, list]:
        p = [chance[v] for v in batch.column("votes").to_pylist()]
        index = batch.column("active")
        return {"index": index, "value": [[1.0] * len(x) for x in index.to_pylist()], "aim": [[1 - x, x] for x in p]}

    weights = linear.fitted(map_steps(train, aims, "index array<int>, value array<double>, aim array<double>"), len(words) + VOTERS, 2)
    each = weights[:, 1] - weights[:, 0]
    if not chance:
        each[:] = 0
        each[len(words) + WORD_VOTERS + BEGINNING_VOTERS], each[-1] = 4.0, -3.0
    kept = [f for f in votes.schema if f.name not in ("votes", "active", "learn")]

    def score(batch: pa.RecordBatch) -> dict[str, list]:
        index = batch.column("active")
        of = np.repeat(np.arange(batch.num_rows), np.diff(np.asarray(index.offsets)))
        total = np.bincount(of, each[np.asarray(index.flatten())], batch.num_rows) + each[-1]
        return {"score": 1 / (1 + np.exp(-total))} | {f.name: batch.column(f.name) for f in kept}

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept), "score double"])
    return map_steps(votes, score, schema)
