"""Near-duplicate vectors: cross-polytope hashing after fast Hadamard rotations, multiprobe buckets, verified pairs.

Vectors are linked if their cosine, in double precision, is 0.95 or more. A pseudo-random rotation is three rounds of random
signs and a fast Hadamard transform; the hash of a vector is the signed axis that is largest after rotation. A table joins three
such hashes, and puts each vector also into the neighbouring buckets that its next largest axes name. Every pair that shares a
bucket of any table is compared. With the given parameters a pair at the threshold shares a bucket in some table with a
probability above 0.999 (measured in the tests); pairs above it more surely.

Equal vectors are one class with a count. Buckets hold numbers of classes and sketches of 256 bits, never vectors: a bit is the
side of a random plane, so the bits in which two vectors differ tell their angle. In each bucket classes with a partner that
their sketches allow get an edge to one of their group; a pair at the threshold is not allowed once in 10 billion. Groups that
hang together by such edges in any bucket fetch their vectors, once for each class, and all pairs of a group are compared
exactly. A group that is long drawn out, so that sending its vectors to its buckets takes fewer rows, is compared bucket by
bucket instead, where pairs count in the first bucket that they share. No pair is written; see ``pairs``.

Vectors that are null, empty, zero, or hold null or non-finite components link with nothing; so do vectors of different
lengths. A component's id is its smallest vec_id. Repeated rows are copies of each other. Further columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slotwise.llm import pairs
from slotwise.llm.common import given_back, map_steps, mixed, written

THRESHOLD = 0.95
HASHES = 3
TABLES = 16
PROBES = 6
#: Bits of a sketch, and the 64-bit words that hold them.
BITS = 256
WORDS = [f"s{k}" for k in range(BITS // 64)]
#: How often the sketches of a pair at the threshold may differ in too many bits.
SKETCH_MISS = 1e-10
#: Members of a bucket that are compared where they lie; larger buckets are cut into blocks of so many.
LARGE = 8192
#: Members of a bucket from which on groups are followed one bucket at a time.
FEW = 32
#: Classes of a block of a group that is compared as a whole.
WHOLE = 1024


def hadamard(x: np.ndarray) -> np.ndarray:
    """Fast Hadamard transform of each row; the length is a power of two."""
    n, size, half = *x.shape, 1
    while half < size:
        x = x.reshape(n, size // (2 * half), 2, half)
        x = np.stack([x[:, :, 0] + x[:, :, 1], x[:, :, 0] - x[:, :, 1]], axis=2).reshape(n, size)
        half *= 2
    return x / np.sqrt(size)


def signs(size: int, seed: int) -> np.ndarray:
    return 1.0 - 2.0 * (mixed(np.arange(size, dtype=np.uint64) + np.uint64((seed + 1) << 32)) >> np.uint64(63)).astype(float)


def rotated(x: np.ndarray, seed: int) -> np.ndarray:
    for k in range(3):
        x = hadamard(x * signs(x.shape[1], 3 * seed + k))
    return x


def axes(x: np.ndarray, seed: int, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Codes of the largest signed axes of each row, best first, and how far each falls behind the best."""
    y = rotated(x, seed)
    order = np.argsort(-np.abs(y), axis=1, kind="stable")[:, :most]
    value = np.take_along_axis(y, order, axis=1)
    size = np.abs(value)
    return 2 * order + (value < 0), size[:, :1] - size


def buckets(x: np.ndarray, tables: int = TABLES, probes: int = PROBES, hashes: int = HASHES) -> np.ndarray:
    """For each unit row its bucket codes: tables x probes, those whose axes fall least behind."""
    width = 1 << max(1, (x.shape[1] - 1).bit_length())
    x = np.pad(x, ((0, 0), (0, width - x.shape[1])))
    each = min(probes, width)
    out = []
    for t in range(tables):
        code = np.full((len(x), 1), t + 1, np.uint64)
        lag = np.zeros((len(x), 1))
        for k in range(hashes):
            axis, behind = axes(x, hashes * t + k, each)
            lag = (lag[:, :, None] + behind[:, None, :]).reshape(len(x), -1)
            code = mixed(mixed(code)[:, :, None] ^ axis[:, None, :].astype(np.uint64)).reshape(len(x), -1)
            best = np.argsort(lag, axis=1, kind="stable")[:, :probes]
            lag, code = np.take_along_axis(lag, best, axis=1), np.take_along_axis(code, best, axis=1)
        out.append(code)
    return np.concatenate(out, axis=1).view(np.int64)


@lru_cache(maxsize=4)
def planes(width: int) -> np.ndarray:
    """Normals of the planes of a sketch, in all directions alike (normal deviates by the polar form)."""
    u = (mixed(np.arange(2 * width * BITS, dtype=np.uint64) + np.uint64(1 << 48)) >> np.uint64(11)).astype(float).reshape(2, width, BITS) / 2**53
    return np.sqrt(-2 * np.log1p(-u[0])) * np.cos(2 * np.pi * u[1])


def sketches(x: np.ndarray) -> np.ndarray:
    """For each row the sides of the planes it lies on: rows x words."""
    return np.packbits(x @ planes(x.shape[1]) >= 0, axis=1).view(np.int64)


def most_apart(threshold: float, bits: int = BITS, miss: float = SKETCH_MISS) -> int:
    """In how many bits sketches may differ: a pair at the threshold differs in more with a probability of at most miss."""
    p = math.acos(max(-1.0, min(1.0, threshold - 1e-6))) / math.pi
    left = 0.0
    for k in range(bits, 0, -1):
        left += math.comb(bits, k) * p**k * (1 - p) ** (bits - k)
        if left > miss:
            return k
    return 0


def units(vectors: DataFrame) -> DataFrame:
    """vec_id, item (stands for the exact vector; null if it cannot link), vector (unit, doubles)."""

    def run(batch: pa.RecordBatch) -> dict[str, list]:
        out: dict[str, list] = {"item": [None] * batch.num_rows, "vector": [None] * batch.num_rows}
        by_size: dict[int, list] = {}
        for k, row in enumerate(batch.column("embedding").to_pylist()):
            if row and None not in row:
                v = np.array(row, np.float64)
                top = np.abs(v).max()
                if np.isfinite(top) and top > 0:
                    by_size.setdefault(len(v), []).append((k, v))
        for found in by_size.values():
            x = np.stack([v for _, v in found])
            x = x / np.abs(x).max(axis=1, keepdims=True)
            x = x / np.sqrt((x * x).sum(axis=1, keepdims=True))
            for (k, v), unit in zip(found, x, strict=True):
                out["item"][k] = xxhash.xxh128_digest(v.tobytes())
                out["vector"][k] = unit.tobytes()
        return out | {"vec_id": batch.column("vec_id")}

    return map_steps(vectors.select("vec_id", "embedding"), run, "vec_id long, item binary, vector binary")


def hashed(classes: DataFrame, tables: int = TABLES, probes: int = PROBES) -> DataFrame:
    """bucket, n and the words of the sketch: a row for each bucket of each class."""

    def run(batch: pa.RecordBatch) -> dict[str, list]:
        out: dict[str, list] = {"buckets": [None] * batch.num_rows}
        words = np.zeros((batch.num_rows, len(WORDS)), np.int64)
        by_size: dict[int, list] = {}
        for k, v in enumerate(batch.column("vector").to_pylist()):
            by_size.setdefault(len(v) // 8, []).append((k, v))
        for size, found in by_size.items():
            x = np.frombuffer(b"".join(v for _, v in found)).reshape(-1, size)
            words[[k for k, _ in found]] = sketches(x)
            codes = np.sort(buckets(x, tables, probes) ^ np.int64(size), axis=1)
            for (k, _), code in zip(found, codes, strict=True):
                out["buckets"][k] = np.unique(code)
        return out | {"n": batch.column("n")} | {w: pa.array(words[:, k]) for k, w in enumerate(WORDS)}

    schema = f"n long, buckets array<long>, {', '.join(f'{w} long' for w in WORDS)}"
    return map_steps(classes.select("n", "vector"), run, schema).select(F.explode("buckets").alias("bucket"), "n", *WORDS)


def _apart(words: np.ndarray, rows: np.ndarray | slice, others: np.ndarray | int) -> np.ndarray:
    """In how many bits sketches differ (of a negative number numpy would count the bits of its absolute value)."""
    return np.bitwise_count((words[rows] ^ words[others]).view(np.uint64)).sum(axis=1, dtype=np.int64)


def followed(words: np.ndarray, most: int) -> np.ndarray:
    """For each sketch the first of its group, by following partners; each is held against those only that no group has yet."""
    root, left = np.arange(len(words)), np.arange(len(words))
    while len(left):
        first, left = left[0], left[1:]
        front = [first]
        while front and len(left):
            near = _apart(words, left, front.pop()) <= most
            root[left[near]] = first
            front.extend(left[near])
            left = left[~near]
    return root


def neighbours(words: np.ndarray, starts: np.ndarray, sizes: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows with a partner in their run and the first row of their group; runs by where they start and their sizes."""
    run = np.repeat(np.arange(len(sizes)), sizes)
    at = np.flatnonzero((sizes > 1)[run] & (sizes <= FEW)[run])
    rows, others = [], []
    for step in range(1, FEW):
        at = at[at + step < len(run)]
        at = at[run[at] == run[at + step]]
        if not len(at):
            break
        hit = at[_apart(words, at, at + step) <= most]
        rows.append(hit)
        others.append(hit + step)
    rows, others = (np.concatenate([*x, np.zeros(0, np.int64)]).astype(np.int64) for x in (rows, others))
    there = np.unique(np.concatenate([rows, others]))
    label = pairs.local_roots(len(there), np.searchsorted(there, rows), np.searchsorted(there, others), np.arange(len(there)))
    found, roots = [there], [there[label]]
    for k in np.flatnonzero(sizes > FEW):
        root = followed(words[starts[k] : starts[k] + sizes[k]], most)
        many = np.flatnonzero(np.bincount(root, minlength=len(root))[root] > 1)
        found.append(starts[k] + many)
        roots.append(starts[k] + root[many])
    return np.concatenate(found), np.concatenate(roots)


def allowed(most: int, large: int = LARGE) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Of rows in order of their buckets: bucket, n, root for those with a partner, in buckets of at most ``large`` members.

    The rows of larger buckets come back as they are, with root null.
    """

    def as_they_are(bucket: np.ndarray, n: np.ndarray, words: np.ndarray) -> pa.RecordBatch:
        return _flags(bucket, n, pa.nulls(len(n), pa.int64()), [pa.array(words[:, k]) for k in range(len(WORDS))])

    def judged(bucket: np.ndarray, n: np.ndarray, words: np.ndarray) -> Iterator[pa.RecordBatch]:
        starts = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
        sizes = np.diff(np.append(starts, len(bucket)))
        fits = sizes <= large
        for k in np.flatnonzero(~fits):
            own = slice(starts[k], starts[k] + sizes[k])
            yield as_they_are(bucket[own], n[own], words[own])
        found, roots = neighbours(words, starts[fits], sizes[fits], most) if fits.all() else _among(words, starts, sizes, fits, most)
        if len(found):
            yield _flags(bucket[found], n[found], pa.array(n[roots]), [pa.nulls(len(found), pa.int64())] * len(WORDS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = hot = None
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = (np.asarray(batch.column("bucket")), np.asarray(batch.column("n")), np.stack([np.asarray(batch.column(w)) for w in WORDS], axis=1))
            if hot is not None:
                end = np.searchsorted(rows[0], hot, "right")
                if end:
                    yield as_they_are(*(x[:end] for x in rows))
                rows = tuple(x[end:] for x in rows)
                if not len(rows[0]):
                    continue
                hot = None
            if held is not None:
                rows = tuple(np.concatenate(x) for x in zip(held, rows, strict=True))
            cut = np.searchsorted(rows[0], rows[0][-1])
            if cut:
                yield from judged(*(x[:cut] for x in rows))
            held = tuple(x[cut:] for x in rows)
            if len(held[0]) > large:
                hot = held[0][-1]
                yield as_they_are(*held)
                held = None
        if held is not None:
            yield from judged(*held)

    return run


def _among(words: np.ndarray, starts: np.ndarray, sizes: np.ndarray, fits: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """neighbours of those runs that fit."""
    there = np.flatnonzero(np.repeat(fits, sizes))
    found, roots = neighbours(words[there], np.cumsum(sizes[fits]) - sizes[fits], sizes[fits], most)
    return there[found], there[roots]


def _flags(bucket: np.ndarray, n: np.ndarray, root: pa.Array, words: list[pa.Array]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(bucket), pa.array(n), root, *words], names=["bucket", "n", "root", *WORDS])


def flagged(members: DataFrame, threshold: float, large: int = LARGE) -> DataFrame:
    """bucket, n, root: classes with a partner in a bucket that their sketches allow, and the one that stands for their group there."""
    most = most_apart(threshold)
    schema = f"bucket long, n long, root long, {', '.join(f'{w} long' for w in WORDS)}"
    rows = members.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(given_back(allowed(most, large)), schema)
    rows = written(rows, "vector-flagged")

    def between(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pairs.groups(batches):
            words = np.stack([np.asarray(batch.column(w)) for w in WORDS], axis=1)
            root = followed(words, most)
            many = np.flatnonzero(np.bincount(root, minlength=len(root))[root] > 1)
            n = np.asarray(batch.column("item"))
            yield pa.RecordBatch.from_arrays([batch.column("bucket").take(pa.array(many)), pa.array(n[many]), pa.array(n[root[many]])], names=["bucket", "n", "root"])

    # two blocks hold all pairs within either, too
    blocks = pairs.dealt(rows.filter("root IS NULL").withColumnRenamed("n", "item"), large)
    blocks = blocks.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).filter("other <> own")
    blocks = blocks.select("bucket", "item", *WORDS, F.least("own", "other").alias("left"), F.greatest("own", "other").alias("right"))
    found = written(pairs.by_group(blocks).mapInArrow(given_back(between), "bucket long, n long, root long"), "vector-flagged-large")
    return rows.filter("root IS NOT NULL").select("bucket", "n", "root").union(found)


def gathered(flags: DataFrame, whole: int = WHOLE) -> DataFrame:
    """bucket, n, blocks, own (as ``pairs.dealt``), buckets: classes that may be linked, by group, or by bucket where that takes fewer rows."""
    edges = flags.select(F.col("n").alias("item"), "root")
    groups = written(pairs.components(edges), "vector-groups").withColumnRenamed("item", "n")
    placed = flags.select("bucket", "n").distinct().join(groups, "n")
    sizes = placed.groupBy("component", "bucket").agg(F.count("*").alias("size"))
    spread = sizes.groupBy("component").agg(F.sum(F.col("size") * F.ceil(F.col("size") / pairs.BLOCK)).alias("apart"))
    sizes = groups.groupBy("component").agg(F.count("*").alias("size"))
    together = F.col("size") * F.ceil(F.col("size") / whole) <= F.col("apart")
    ways = written(sizes.join(spread, "component").select("component", together.alias("together")), "vector-ways")
    one = groups.join(ways.filter("together"), "component").select(F.xxhash64("component").alias("bucket"), F.col("n").alias("item"))
    many = written(placed.join(ways.filter("NOT together"), "component").select("bucket", F.col("n").alias("item")), "vector-spread")
    own = many.groupBy("item").agg(F.sort_array(F.collect_set("bucket")).alias("buckets"))
    rows = pairs.dealt(one, whole).withColumn("buckets", F.array("bucket"))
    return rows.unionByName(pairs.dealt(many).join(own, "item")).withColumnRenamed("item", "n")


def links(
    vectors: DataFrame, threshold: float = THRESHOLD, tables: int = TABLES, probes: int = PROBES, large: int = LARGE, whole: int = WHOLE
) -> DataFrame:
    """vec_id, n_links, component_id, kept."""
    rows = written(units(vectors), "vectors")
    classes = rows.filter(F.col("item").isNotNull()).groupBy("item").agg(F.min("vec_id").alias("low"), F.count("*").alias("copies"), F.first("vector").alias("vector"))
    classes = written(classes.withColumn("n", F.monotonically_increasing_id()), "vector-classes")
    members = gathered(flagged(hashed(classes, tables, probes), threshold, large), whole)

    def verdict(batch: pa.RecordBatch, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        raw = batch.column("vector").to_pylist()
        size = len(raw[0])
        if any(len(v) != size for v in raw):  # another length met by a clash of codes
            return np.array([len(raw[i]) == len(raw[j]) and bool(np.frombuffer(raw[i]) @ np.frombuffer(raw[j]) >= threshold) for i, j in zip(left, right, strict=True)])
        x = np.frombuffer(b"".join(raw)).reshape(batch.num_rows, -1)
        if len(left) <= 64:
            return (x[left] * x[right]).sum(axis=1) >= threshold
        return (x @ x.T)[left, right] >= threshold

    found = pairs.linked(members.join(classes.select("n", "item", "copies", "vector"), "n").drop("n"), verdict, "vector-links")
    weights = found.groupBy("item").agg(F.sum("weight").alias("others"))
    groups = written(pairs.components(found), "vector-components").join(classes.select("item", "low"), "item")
    lowest = groups.groupBy("component").agg(F.min("low").alias("group_low"))
    known = groups.join(lowest, "component").select("item", "group_low").join(weights, "item")
    verdicts = classes.select("item", "low", "copies").join(known, "item", "left").select(
        "item", F.coalesce("group_low", "low").alias("group_low"), (F.coalesce("others", F.lit(0)) + F.col("copies") - 1).alias("n_links")
    )
    return (
        rows.select("vec_id", "item")
        .join(verdicts, "item", "left")
        .select(
            "vec_id",
            F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
            F.when(F.col("item").isNull(), F.col("vec_id")).otherwise(F.col("group_low")).alias("component_id"),
        )
        .withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.col("component_id").isNull()))
    )
