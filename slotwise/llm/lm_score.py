"""Language-model scores: a hashed maximum-entropy model with a class-factored softmax, and a unigram base score.

Tokens are words (ASCII letters lower-cased), then one end. P(token | before) = P(group | before) * P(class | group, before) *
P(token | class), with 16 groups of 16 classes. Both softmaxes are log-linear: weights for the word before, the two words before
and the word before that one (a skip), each hashed to a row of 16 weights, with the group for the second. The most frequent tokens,
``OWN_CLASSES`` of them, have classes of their own, so that their chances are log-linear as a whole; all others share one by their
last two bytes. Within a class, P = (c + 1) / (tokens + distinct tokens + 1 of the class), so unknown words have a share. This
last factor is a count: context reaches a word of a shared class through its group and class only. Each level has a row of weights
for every 64 distinct words, at most 65,536, which is what a task may hold and a broadcast may carry (4 MB a level).

Texts are coded once, as 64-bit codes of their tokens, in a table that counting, training and scoring read. Counts of all training
tokens are added up by Spark, one row for each word and task. Training is by distributed gradient updates: in a round each task
takes adaptive gradient steps over its own rows, from common weights, and sends the rows of weights it touched, which are averaged
by how often they were. Tasks are a fixed multiple of the cores, so that what they send does not grow with the input. Scoring works
on sparse numpy batches; the logarithms of the most frequent words' counts (65,536 at most, those above a threshold found from a
histogram) are broadcast, those of the rest are joined by word and added up by document.

Null texts count as empty: one token, the end. With nothing to learn from all counts are 0 and each base term is 0. Repeated rows
are scored each by itself; a null id counts as an empty one where rows are held out.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slotwise.llm.common import map_steps, mixed, steps, written

GROUPS = 16
CLASSES, OWN_CLASSES = GROUPS * GROUPS, 128
WORDS_A_SLOT = 64
SLOT_BITS = 8, 16
FREQUENT = 1 << 16
ROUNDS = 2
BATCH = 65_536
RATE = 0.2

END = b""
_FLUSH = 3_000_000
_SHARED = CLASSES - OWN_CLASSES
#: Bounds of a logit, within the range of single precision.
_LOGIT = np.float32(60)
_WEIGHTS = [f"w{k}" for k in range(GROUPS)]


class WordCodes(dict):
    """64-bit codes of words, remembered up to a bound; the last seven bits are the shared class."""

    def __init__(self, most: int = 500_000) -> None:
        super().__init__()
        self.most = most

    def __missing__(self, word: bytes) -> int:
        shared = xxhash.xxh64_intdigest(word[-2:], 7) % _SHARED
        code = self[word] = ((xxhash.xxh64_intdigest(word) & -_SHARED) | shared) - (1 << 63)
        return code

    def __call__(self, words: list[bytes]) -> np.ndarray:
        if len(self) > self.most:
            self.clear()
        return np.fromiter(map(self.__getitem__, words), np.int64, len(words))


def tokens(text: str | None) -> list[bytes]:
    """bytes.lower and bytes.split know ASCII only, which is what is wanted here."""
    words = (text or "").encode().lower().split()
    words.append(END)
    return words


def shared_class(codes: np.ndarray) -> np.ndarray:
    return codes & (_SHARED - 1)


def coded(docs: DataFrame) -> DataFrame:
    """The documents with the codes of all their tokens, 8 bytes each, in place of their text; as they are if they have them."""
    if "_codes" in docs.columns:
        return docs
    kept, codes = [f for f in docs.schema if f.name != "text"], WordCodes()

    def code(batch: pa.RecordBatch) -> dict[str, pa.Array]:
        found = [tokens(t) for t in batch.column("text").to_pylist()]
        ends = np.cumsum([0, *map(len, found)]) * 8
        held = [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(codes(list(chain.from_iterable(found))))]
        return {"_codes": pa.Array.from_buffers(pa.binary(), len(found), held)} | {f.name: batch.column(f.name) for f in kept}

    names = [*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept), "_codes binary"]
    return map_steps(docs, code, ", ".join(names))


def _codes(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """The codes of all tokens of a batch, and where each text starts."""
    column = batch.column("_codes")
    ends = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(column.buffers()[2], np.uint8)[ends[0] : ends[-1]].view(np.int64), (ends[:-1] - ends[0]) // 8


def counted(docs: DataFrame) -> DataFrame:
    """code, n: all tokens of the texts."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = []

        def added() -> tuple[np.ndarray, np.ndarray]:
            code, where = np.unique(np.concatenate([c for c, _ in held]), return_inverse=True)
            return code, np.bincount(where, np.concatenate([n for _, n in held])).astype(np.int64)

        for batch in steps(batches):
            held.append(np.unique(_codes(batch)[0], return_counts=True))
            if sum(len(c) for c, _ in held) > _FLUSH:
                held = [added()]
                if len(held[0][0]) > _FLUSH // 2:
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in held[0]], names=["code", "n"])
                    held = []
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in added()], names=["code", "n"])

    return coded(docs).select("_codes").mapInArrow(count, "code long, n long").groupBy("code").agg(F.sum("n").alias("n"))


def softmax(weights: np.ndarray, rows: list[np.ndarray], bias: np.ndarray) -> np.ndarray:
    """The chances at each token, from the rows of weights of its features."""
    logits = weights.take(rows[0], axis=0)
    for row in rows[1:]:
        logits += weights.take(row, axis=0)
    logits += bias
    np.clip(logits, -_LOGIT, _LOGIT, out=logits)
    np.exp(logits, out=logits)
    logits /= (logits @ np.ones(GROUPS, np.float32))[:, None]
    return logits


class Descent:
    """Adaptive gradient steps on one level's weights, and how often each row was touched."""

    def __init__(self, weights: np.ndarray) -> None:
        self.weights, self.seen = weights.copy(), np.full(weights.T.shape, 1e-2, np.float32)
        self.hits = np.zeros(len(weights), np.int64)

    def step(self, rows: list[np.ndarray], bias: np.ndarray, aims: np.ndarray) -> None:
        miss, size = softmax(self.weights, rows, bias), len(self.weights)
        miss[np.arange(len(aims)), aims] -= 1
        # one weight of all rows at a time: summing by row in columns is quicker than in cells
        g = np.empty(self.seen.shape, np.float32)
        for k, column in enumerate(np.ascontiguousarray(miss.T)):
            column = column.astype(float)
            g[k] = sum(np.bincount(row, column, size) for row in rows)
        self.seen += g * g
        g *= np.float32(RATE)
        g /= np.sqrt(self.seen)
        self.weights -= g.T
        for row in rows:
            self.hits += np.bincount(row, minlength=size)


class ClassModel:
    """What every task needs: the frequent words with counts and classes, class totals, and the weights of both levels."""

    def __init__(self, frequent: np.ndarray, counts: np.ndarray, own: np.ndarray, totals: np.ndarray, bits: int) -> None:
        self.frequent, self.counts, self.own, self.totals, self.bits = frequent, counts, own, totals, bits
        share = totals.reshape(GROUPS, GROUPS)
        groups = share.sum(axis=1)
        self.bias = np.log(groups / groups.sum()).astype(np.float32), np.log(share / groups[:, None]).astype(np.float32)
        self.weights = np.zeros((2, 1 << bits, GROUPS), np.float32)

    @classmethod
    def of(cls, state: dict) -> ClassModel:
        """From its attributes, which is how it is broadcast."""
        out = cls.__new__(cls)
        out.__dict__.update(state)
        return out

    def places(self, codes: np.ndarray) -> np.ndarray:
        """Place among the frequent words, or -1."""
        if not len(self.frequent):
            return np.full(len(codes), -1)
        at = np.minimum(np.searchsorted(self.frequent, codes), len(self.frequent) - 1)
        return np.where(self.frequent[at] == codes, at, -1)

    def classes(self, codes: np.ndarray, places: np.ndarray) -> np.ndarray:
        own = self.own[places] if len(self.own) else np.full(len(codes), -1)
        return np.where((places >= 0) & (own >= 0), own, shared_class(codes))

    def slots(self, codes: np.ndarray, starts: np.ndarray) -> list[np.ndarray]:
        """The three features of each token, from the two tokens before it in its text, as 64-bit hashes."""
        words = codes.view(np.uint64)
        before = np.concatenate([[0], words[:-1]]).astype(np.uint64)
        before[starts] = 1
        second = np.concatenate([[0, 0], words[:-2]])[: len(words)].astype(np.uint64)
        second[starts] = 2
        after = starts + 1
        second[after[after < len(words)]] = 2
        one = mixed(before)
        return [one, mixed(one + second), mixed(second + np.uint64(3))]

    def rows(self, hashes: list[np.ndarray], group: np.ndarray | None = None) -> list[np.ndarray]:
        """The rows of weights of the features, of the second level with the group."""
        shift = np.uint64(64 - self.bits)
        if group is not None:
            salt = (group.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
            hashes = [(h ^ salt) * np.uint64(0xD6E8FEB86659FD93) for h in hashes]
        return [(h >> shift).astype(np.int64) for h in hashes]

    def chances(self, hashes: list[np.ndarray], weights: np.ndarray) -> np.ndarray:
        """The chances of all classes at each token."""
        n, groups = len(hashes[0]), softmax(weights[0], self.rows(hashes), self.bias[0])
        within = [softmax(weights[1], self.rows(hashes, np.full(n, k)), self.bias[1][k]) for k in range(GROUPS)]
        return np.concatenate([groups[:, k : k + 1] * p for k, p in enumerate(within)], axis=1)

    def class_chances(self, hashes: list[np.ndarray], classes: np.ndarray) -> np.ndarray:
        """The chance of each token's own class."""
        group, place, at = classes // GROUPS, classes % GROUPS, np.arange(len(classes))
        p = softmax(self.weights[0], self.rows(hashes), self.bias[0])[at, group]
        return p.astype(float) * softmax(self.weights[1], self.rows(hashes, group), self.bias[1][group])[at, place]


def started(counts: DataFrame) -> ClassModel:
    """The model before training, from the counts of all training tokens."""
    # steps of an eighth of a doubling: few rows, whatever the counts
    level = F.floor(F.log2("n") * 8).cast("int")
    steps_down = counts.groupBy(level.alias("level")).agg(F.count("*").alias("words")).orderBy(F.desc("level")).collect()
    lowest, words = 1 << 30, 0
    for row in steps_down:
        words += row["words"]
        if words > FREQUENT:
            break
        lowest = row["level"]
    top = counts.filter(level >= lowest).toPandas().sort_values(["n", "code"], ascending=[False, True])
    order = np.argsort(top["code"].to_numpy(np.int64))
    frequent, n = top["code"].to_numpy(np.int64)[order], top["n"].to_numpy(np.int64)[order]
    own = np.full(len(frequent), -1)
    rank = np.empty(len(order), np.int64)
    rank[np.arange(len(order))] = order
    own[rank < OWN_CLASSES] = _SHARED + rank[rank < OWN_CLASSES]
    by_class = counts.groupBy(F.col("code").bitwiseAND(F.lit(_SHARED - 1)).alias("class")).agg(F.sum("n").alias("n"), F.count("*").alias("words")).collect()
    totals = np.zeros((2, CLASSES))
    for row in by_class:
        totals[:, row["class"]] = row["n"], row["words"]
    for k in np.flatnonzero(own >= 0):
        shared = shared_class(frequent[k : k + 1])[0]
        totals[:, shared] -= n[k], 1
        totals[:, own[k]] += n[k], 1
    distinct = int(totals[1].sum())
    bits = min(max((distinct // WORDS_A_SLOT).bit_length(), SLOT_BITS[0]), SLOT_BITS[1])
    return ClassModel(frequent, n, own, totals.sum(axis=0) + 1, bits)


def trained(docs: DataFrame, model: ClassModel, rounds: int = ROUNDS) -> ClassModel:
    spark = docs.sparkSession
    rows = coded(docs).select("_codes").coalesce(4 * spark.sparkContext.defaultParallelism)
    for _ in range(rounds):
        shared = spark.sparkContext.broadcast(vars(model))

        def descend(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            model = ClassModel.of(shared.value)
            levels = [Descent(weights) for weights in model.weights]
            for batch in steps(batches):
                code, starts = _codes(batch)
                aims = model.classes(code, model.places(code))
                hashes = model.slots(code, starts)
                for a in range(0, len(code), BATCH):
                    part, aim = [h[a : a + BATCH] for h in hashes], aims[a : a + BATCH]
                    group = aim // GROUPS
                    levels[0].step(model.rows(part), model.bias[0], group)
                    levels[1].step(model.rows(part, group), model.bias[1][group], aim % GROUPS)
            for k, level in enumerate(levels):
                touched = np.flatnonzero(level.hits)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(touched + (k << model.bits)), pa.array(level.hits[touched]), *(pa.array(level.weights[touched, w]) for w in range(GROUPS))],
                    names=["slot", "n", *_WEIGHTS],
                )

        parts = rows.mapInArrow(descend, "slot long, n long, " + ", ".join(f"{w} float" for w in _WEIGHTS))
        mean = [(F.sum(F.col(w).cast("double") * F.col("n")) / F.sum("n")).cast("float").alias(w) for w in _WEIGHTS]
        means = parts.groupBy("slot").agg(*mean).toArrow()
        flat = model.weights.reshape(-1, GROUPS)
        flat[means.column("slot").to_numpy()] = np.stack([means.column(w).to_numpy() for w in _WEIGHTS], axis=1)
    return model


def scored(docs: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """docs: text, learn and further columns. These, and n_tokens, n_known, train_tokens, base_score, score (both log10)."""
    docs = written(coded(docs.withColumn("row_id", F.monotonically_increasing_id())), "lm-codes", compression="zstd")
    learned = docs.filter("learn")
    counts = written(counted(learned), "token-counts")
    size = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    model = trained(learned, started(counts), rounds)
    shared = docs.sparkSession.sparkContext.broadcast(vars(model))
    kept = [f for f in docs.schema if f.name not in ("_codes", "learn")]

    def score(batch: pa.RecordBatch) -> dict[str, list]:
        model = ClassModel.of(shared.value)
        code, starts = _codes(batch)
        places = model.places(code)
        classes, hashes = model.classes(code, places), model.slots(code, starts)
        own = np.empty(len(code))
        for a in range(0, len(code), BATCH):
            own[a : a + BATCH] = model.class_chances([h[a : a + BATCH] for h in hashes], classes[a : a + BATCH])
        known = places >= 0
        logs = np.log10(model.counts + 1.0) if len(model.counts) else np.zeros(1)
        counted = np.where(known, logs[places], 0.0)
        add = lambda x: np.add.reduceat(x, starts)
        ends = [*starts[1:].tolist(), len(code)]
        return {
            "n_tokens": np.diff([*starts, len(code)]),
            "frequent_known": add(known.astype(np.int64)),
            "frequent_logs": add(counted),
            "class_logs": add(np.log10(own) - np.log10(model.totals[classes])),
            "rare": [code[a:b][~known[a:b]] for a, b in zip(starts, ends, strict=True)],
        } | {f.name: batch.column(f.name) for f in kept}

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept), "n_tokens long, frequent_known long, frequent_logs double, class_logs double, rare array<long>"])
    rows = written(map_steps(docs.drop("learn"), score, schema), "lm-rows")
    rare = (
        rows.select("row_id", F.explode("rare").alias("code"))
        .join(counts, "code")
        .groupBy("row_id")
        .agg(F.count("*").alias("rare_known"), F.sum(F.log10(F.col("n") + 1.0)).alias("rare_logs"))
    )
    logs = F.col("frequent_logs") + F.coalesce("rare_logs", F.lit(0.0))
    base = logs - F.col("n_tokens") * F.log10(F.lit(float(size["n"] + size["v"] + 1)))
    return rows.drop("rare").join(rare, "row_id", "left").select(
        *(f.name for f in kept if f.name != "row_id"),
        "n_tokens",
        (F.col("frequent_known") + F.coalesce("rare_known", F.lit(0))).alias("n_known"),
        F.lit(size["n"]).cast("long").alias("train_tokens"),
        base.alias("base_score"),
        (logs + F.col("class_logs")).alias("score"),
    )
