"""Mixing to target weights with soft membership of domains.

Domains are classes of a labelled table, here made of its marks: good, poor (quality 0) and toxic (toxic 1). A softmax classifier on
measures of style and on words of the toxic and poor lexicons gives every document a posterior over the domains. Each document
then gets a rate from 0 to ``MAX_RATE``, the expected number of times it is taken, by least squares: rates for which the expected tokens of
each domain, the sum of rate * tokens * posterior, come nearest to the targets (share * all tokens), starting from taking everything once.

The rates are fitted by distributed projected gradient steps. Misses are weighted by the inverse of the domains' second moments, for which
a step of length 1 is safe; a step moves each rate against the weighted misses of its document's domains and projects it on the
box, and steps are accelerated by the last movement, which starts anew when it points uphill. Every step is one pass that adds up domain totals; rates follow from
the misses of the steps so far, and every ``WRITE_EVERY`` steps they are written as a table, so that a pass replays a few steps only. Steps end when the
targets hold, or when rates hardly move: targets that no rates in the box meet are missed, and ``missed`` gives what is left of each domain. It is logged.
``drawn`` takes a document floor(rate) times, and once more with the remaining probability, by a hash of its id and text.

The classifier is fitted on at most ``max_labelled`` labelled documents, drawn by hash; everything else sees all documents, the lexicon
all labelled ones. The driver gets the lexicon (at most 500 words), weights, and the sums of each step.

Null and empty texts have 0 tokens, a posterior like any text, and rate 1, as they cannot move any total. A null id is not matched to labels. Without labels, or with
one domain only, all posteriors are equal and every rate comes to about 1. Empty tables give an empty result. Targets must add up
to more than 0; domains without tokens cannot meet theirs and are left short. Repeated rows are rated each by itself; repeated labels of an id
count as the worst. Further columns pass through ``rated`` untouched.
"""

from __future__ import annotations

import logging
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slotwise.llm import lexicon, linear
from slotwise.llm.common import map_steps, text_key, written
from slotwise.llm.line_quality import repeated_words

DOMAINS = ("good", "poor", "toxic")
TARGETS = {"good": 0.90, "poor": 0.08, "toxic": 0.02}
MAX_LABELLED = 10_000
MAX_WORDS = 500
TOLERANCE = 1e-4
#: No document is taken more often than this, however far the targets are.
MAX_RATE = 2.0
#: Keeps the weights of misses finite where domains cannot be told apart.
RIDGE = 1e-6
#: Steps between two tables of rates; movement of rates (root mean square by tokens) that ends the steps.
WRITE_EVERY = 12
STILL = 1e-4

_LOG = logging.getLogger(__name__)

STYLE = ("size", "symbols", "digits", "upper", "marks", "word_size", "same_lines", "repeated", "distinct", "long_words")


def style(text: str, raw: bytes, words: list[bytes], distinct: set[bytes]) -> list[float]:
    """Measures between 0 and about 1. Digits, capitals and signs are those of ASCII."""
    n, chars = max(len(words), 1), max(len(text), 1)
    lines = [x for x in raw.split(b"\n") if x.strip()]
    count = lambda signs: len(raw) - len(raw.translate(None, signs))
    return [
        np.log1p(len(words)) / 10,
        min(1.0, 5 * count(b"#*$%&|<>{}[]") / chars),
        min(1.0, 5 * count(b"0123456789") / chars),
        count(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ") / chars,
        min(1.0, 10 * count(b"!?") / chars),
        min(1.0, chars / n / 20),
        1 - len(set(lines)) / max(len(lines), 1),
        repeated_words(words, distinct=distinct) / n,
        len(distinct) / n,
        sum(len(w) > 30 for w in words) / n if max(map(len, distinct), default=0) > 30 else 0.0,
    ]


def labelled_domains(labels: DataFrame) -> DataFrame:
    """doc_id, domain: 0 good, 1 poor, 2 toxic; labels without any mark are left out."""
    domain = F.when(F.col("toxic") == 1, 2).when(F.col("quality") == 0, 1).when(F.col("quality") == 1, 0)
    return labels.select("doc_id", domain.alias("domain")).filter("doc_id IS NOT NULL AND domain IS NOT NULL").groupBy("doc_id").agg(F.max("domain").alias("domain"))


def featured(docs: DataFrame, words: list[str]) -> DataFrame:
    """The columns beside text, n_tokens, and sparse features: index, value."""
    at = {w: k + len(STYLE) for k, w in enumerate(words)}
    kept = [f for f in docs.schema if f.name != "text"]

    def measure(batch: pa.RecordBatch) -> dict[str, list]:
        index, value, size = [], [], []
        match = lexicon.Matcher(words)
        for text in batch.column("text").to_pylist():
            text = text or ""
            raw = text.encode()
            tokens = raw.split()
            distinct = set(tokens)
            hits = sorted(at[w] for w in match(text))
            index.append([*range(len(STYLE)), *hits])
            value.append([*style(text, raw, tokens, distinct), *[1.0] * len(hits)])
            size.append(len(tokens))
        return {"index": index, "value": value, "n_tokens": size} | {f.name: batch.column(f.name) for f in kept}

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept), "n_tokens long, index array<int>, value array<double>"])
    return map_steps(docs, measure, schema)


def posteriors(docs: DataFrame, domains: DataFrame, max_labelled: int = MAX_LABELLED) -> DataFrame:
    """The columns of docs beside text, n_tokens, and the posterior p as array<double>; domains: doc_id, domain."""
    labelled = written(lexicon.labelled_texts(docs.select("doc_id", "text"), domains), "mixing-labelled")
    words: list[str] = []
    for found in lexicon.found_by_kind(labelled.select("text", F.col("domain").alias("kind")), len(DOMAINS), MAX_WORDS // 2)[1:]:
        words += [w for w in found if w not in words]
    sample = lexicon.bounded(labelled, max_labelled, "doc_id")
    aim = F.array(*((F.col("domain") == k).cast("double") for k in range(len(DOMAINS))))
    train = featured(sample, words).select("index", "value", aim.alias("aim"))
    train = written(train.repartition(linear.TASKS), "mixing-training")
    weights = linear.fitted(train, len(STYLE) + len(words), len(DOMAINS), rounds=60)
    rows = featured(docs, words)
    kept = [f for f in rows.schema if f.name not in ("index", "value")]

    def predict(batch: pa.RecordBatch) -> dict[str, list]:
        p = linear.probabilities(linear.logits(weights, batch.num_rows, *linear.unpacked(batch)))
        return {"p": list(p)} | {f.name: batch.column(f.name) for f in kept}

    return map_steps(rows, predict, ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept), "p array<double>"]))


def replayed(
    p: np.ndarray, rate: np.ndarray, ahead: np.ndarray, steps: list[tuple[np.ndarray, float]], most: float
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rates after some steps, those before the last one, and where the last one started.

    A step is the weighted miss and the part of the last movement that is added for the start of the next step; ahead is where the first starts.
    """
    before = start = rate
    for pull, momentum in steps:
        before, start = rate, ahead
        rate = np.clip(start - p @ pull, 0.0, most)
        ahead = rate + momentum * (rate - before)
    return rate, before, start


def _columns(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """tokens, p, rate, ahead."""
    p = np.asarray(batch.column("p").flatten()).reshape(batch.num_rows, -1)
    return np.asarray(batch.column("n_tokens"), float), p, np.asarray(batch.column("rate")), np.asarray(batch.column("ahead"))


def with_rates(rows: DataFrame, steps: list[tuple[np.ndarray, float]], most: float) -> DataFrame:
    """The rows, which have rate and ahead, after further steps. Rows without tokens keep their rate."""
    kept = [f for f in rows.schema if f.name not in ("rate", "ahead")]

    def apply(batch: pa.RecordBatch) -> dict[str, object]:
        tokens, p, rate, ahead = _columns(batch)
        new, before, _ = replayed(p, rate, ahead, steps, most)
        further = new + (steps[-1][1] if steps else 0.0) * (new - before)
        return {"rate": np.where(tokens > 0, new, rate), "ahead": np.where(tokens > 0, further, ahead)} | {f.name: batch.column(f.name) for f in kept}

    return map_steps(rows, apply, ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept), "rate double, ahead double"]))


def fitted(members: DataFrame, targets: list[float], max_rate: float = MAX_RATE, tolerance: float = TOLERANCE) -> DataFrame:
    """members (n_tokens, p and further columns) with the rates that bring expected domain totals to the targets, or as near as they come."""
    rows = written(members.withColumns({"rate": F.lit(1.0), "ahead": F.lit(1.0)}), "mixing-rates")
    aim = np.array(targets) / sum(targets)
    k = len(aim)
    total = rows.agg(F.coalesce(F.sum("n_tokens"), F.lit(0))).first()[0]
    if not total:
        return rows.drop("ahead")

    def summed(steps: list[tuple[np.ndarray, float]], add: Callable[..., np.ndarray], n: int) -> np.ndarray:
        """n sums over all documents, by tokens, of what add makes of them."""
        names = [f"s{x}" for x in range(n)]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums = np.zeros(n)
            for batch in batches:
                if batch.num_rows:
                    tokens, p, rate, ahead = _columns(batch)
                    sums += add(tokens, p, *replayed(p, rate, ahead, steps, max_rate))
            yield pa.RecordBatch.from_arrays([pa.array([x]) for x in sums], names=names)

        parts = rows.select("n_tokens", "p", "rate", "ahead").mapInArrow(run, ", ".join(f"{x} double" for x in names))
        return np.array(parts.agg(*(F.sum(x) for x in names)).first()) / total

    moments = summed([], lambda tokens, p, *_: ((tokens[:, None] * p).T @ p).ravel(), k * k).reshape(k, k)
    weight = np.linalg.inv(moments + RIDGE * np.eye(k))

    def measure(tokens: np.ndarray, p: np.ndarray, rate: np.ndarray, before: np.ndarray, start: np.ndarray) -> np.ndarray:
        return np.array([*(tokens * rate) @ p, tokens @ ((start - rate) * (rate - before)), tokens @ np.square(rate - start)])

    steps: list[tuple[np.ndarray, float]] = []
    shares = summed([], measure, k + 2)[:k]
    start, pace = shares, 1.0
    while np.abs(shares - aim).max() > tolerance:
        pull = weight @ (start - aim)
        found = summed([*steps, (pull, 0.0)], measure, k + 2)
        new, uphill, moved = found[:k], found[k] > 0, found[k + 1]
        faster = 1.0 if uphill else (1 + np.sqrt(1 + 4 * pace * pace)) / 2
        momentum = 0.0 if uphill else (pace - 1) / faster
        steps.append((pull, momentum))
        start, shares, pace = new + momentum * (new - shares), new, faster
        if moved < STILL * STILL:
            break
        if len(steps) == WRITE_EVERY:
            rows, steps = written(with_rates(rows, steps, max_rate), "mixing-rates"), []
    return with_rates(rows, steps, max_rate).drop("ahead")


def missed(rated: DataFrame, targets: dict[str, float] | None = None) -> dict[str, float]:
    """For each domain, by how much its expected share of all tokens is above (or, if negative, below) the target."""
    targets = targets or TARGETS
    sums = rated.agg(F.sum("n_tokens").alias("n"), *(F.sum(F.col("n_tokens") * F.col("rate") * F.get("p", F.lit(k))).alias(d) for k, d in enumerate(DOMAINS))).first()
    return {d: sums[d] / sums["n"] - targets[d] / sum(targets.values()) for d in DOMAINS} if sums["n"] else {}


def rated(docs: DataFrame, labels: DataFrame, targets: dict[str, float] | None = None, max_rate: float = MAX_RATE) -> DataFrame:
    """The columns of docs beside text, n_tokens, p, rate. Targets that are missed are logged, with the miss of each domain."""
    targets = targets or TARGETS
    out = written(fitted(posteriors(docs, labelled_domains(labels)), [targets[d] for d in DOMAINS], max_rate), "mixing-rated")
    miss = missed(out, targets)
    if any(abs(x) > TOLERANCE for x in miss.values()):
        _LOG.warning("domain shares miss their targets by %s", ", ".join(f"{d} {x:+.5f}" for d, x in miss.items()))
    return out


def copies() -> Column:
    """How often a row with rate, doc_id and key is taken."""
    uniform = F.pmod(F.xxhash64("doc_id", "key", F.lit("mixing")), F.lit(1 << 30)) / float(1 << 30)
    return F.floor(F.col("rate") + uniform).cast("int")


def drawn(docs: DataFrame, labels: DataFrame, targets: dict[str, float] | None = None) -> DataFrame:
    """The documents, each taken as often as its rate says."""
    named = docs.select("doc_id", text_key(F.col("text")).alias("key"), "text")
    taken = (
        rated(named, labels, targets)
        .select(F.col("doc_id").alias("of_id"), F.col("key").alias("of_key"), copies().alias("copies"))
        .filter("copies > 0")
        .groupBy("of_id", "of_key").agg(F.max("copies").alias("copies"))
    )
    rows = docs.join(taken, docs["doc_id"].eqNullSafe(F.col("of_id")) & (text_key(docs["text"]) == F.col("of_key")))
    return rows.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("doc_id", "text", "lang", "source", "n_chars")
