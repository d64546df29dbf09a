"""Links between items that share buckets, found without writing the pairs.

Items are (item, payload); memberships are (bucket, item). All pairs inside a bucket are compared by numpy. A bucket of more
than ``block`` items is cut into blocks and each pair of blocks is a task row group of its own, so that no task holds a large
bucket. A pair that shares several buckets counts in the first of them (by bucket code) alone. From each bucket come, for
every item, the weight of its newly linked partners and a spanning edge to its group; never the pairs.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slotwise.llm.common import given_back, written

#: Items of a block. A group of rows holds two blocks at most.
BLOCK = 256


def dealt(members: DataFrame, block: int = BLOCK, most_load: int | None = None) -> DataFrame:
    """The members of buckets of two or more with blocks, how many blocks their bucket has, and own, the block they are in.

    An item's block is drawn from its hash; a bucket of n items has ceil(n / block) blocks, or as many more as it takes for
    a block to hold at most ``most_load`` of what column load adds up to.
    """
    load = F.sum("load") / most_load if most_load else F.lit(0.0)
    sizes = members.groupBy("bucket").agg(F.count("*").alias("size"), load.alias("loads")).filter("size > 1")
    blocks = F.ceil(F.greatest(F.col("size") / block, F.col("loads"))).cast("int")
    own = F.pmod(F.xxhash64("item", "bucket"), F.col("blocks")).cast("int")
    return members.join(sizes, "bucket").withColumn("blocks", blocks).withColumn("own", own).drop("size", "loads")


def packed(members: DataFrame) -> DataFrame:
    """bucket, left, right, packed: all members of a block (as dealt) as one row, for each pair of blocks that it takes part in."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in groups(batches, ("bucket", "own")):
            columns = [c for c in batch.schema.names if c != "blocks"]
            sink = pa.BufferOutputStream()
            # members of a large bucket have much in common
            with pa.ipc.new_stream(sink, batch.select(columns).schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
                out.write_batch(batch.select(columns))
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c).slice(0, 1) for c in ("bucket", "own", "blocks")), pa.array([sink.getvalue().to_pybytes()], pa.binary())],
                names=["bucket", "own", "blocks", "packed"],
            )

    rows = members.repartition("bucket", "own").sortWithinPartitions("bucket", "own").mapInArrow(given_back(pack), "bucket long, own int, blocks int, packed binary")
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return rows.select("bucket", F.least("own", "other").alias("left"), F.greatest("own", "other").alias("right"), "packed")


def unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each run of equal (bucket, left, right) the members of its one or two blocks, with left and right."""
    for batch in groups(batches):
        rows = _joined([pa.ipc.open_stream(x.as_buffer()).read_next_batch() for x in batch.column("packed")])
        for name in ("left", "right"):
            rows = rows.append_column(name, pa.array(np.full(rows.num_rows, batch.column(name)[0].as_py(), np.int32)))
        yield rows


def compared(members: DataFrame, compare: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """What compare makes of the groups of members (as dealt): buckets of one block as they are, pairs of blocks of all others."""
    whole = members.filter("blocks = 1").drop("blocks").withColumns({"left": F.lit(0), "right": F.lit(0)})
    blocks = packed(members.filter("blocks > 1"))
    found = by_group(whole).mapInArrow(given_back(lambda batches: compare(groups(batches))), schema)
    return found.union(by_group(blocks).mapInArrow(given_back(lambda batches: compare(unpacked(batches))), schema))


def by_group(df: DataFrame) -> DataFrame:
    """Rows of a group next to each other in one task."""
    return df.repartition("bucket", "left", "right").sortWithinPartitions("bucket", "left", "right")


def groups(batches: Iterator[pa.RecordBatch], by: tuple[str, ...] = ("bucket", "left", "right")) -> Iterator[pa.RecordBatch]:
    """One batch for each run of equal (bucket, left, right)."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = np.stack([np.asarray(batch.column(c)).astype(np.int64) for c in by], axis=1)
        cuts = (np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1).tolist()
        if held and tuple(keys[0]) != last:
            yield _joined(held)
            held = []
        start = 0
        for cut in cuts:
            held.append(batch.slice(start, cut - start))
            yield _joined(held)
            held, start = [], cut
        held.append(batch.slice(start))
        last = tuple(keys[-1])
    if held:
        yield _joined(held)


def _joined(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
    return parts[0] if len(parts) == 1 else pa.Table.from_batches(parts).combine_chunks().to_batches()[0]


def earlier(batch: pa.RecordBatch, rows: np.ndarray, others: np.ndarray) -> np.ndarray:
    """Whether the pairs rows[k], others[k] share a bucket before the one at hand. Column buckets: each item's own, sorted."""
    bucket = batch.column("bucket")[0].as_py()
    lists = batch.column("buckets")
    flat = np.asarray(lists.flatten())
    of = np.repeat(np.arange(batch.num_rows), np.diff(np.asarray(lists.offsets)))
    before = flat < bucket
    known, where = np.unique(flat[before], return_inverse=True)
    if not len(known):
        return np.zeros(len(rows), bool)
    held = np.zeros((batch.num_rows, len(known)), bool)
    held[of[before], where] = True
    common = held.sum(axis=0) > 1
    packed = np.packbits(held[:, common], axis=1)
    out = np.zeros(len(rows), bool)
    step = max(1, (8 << 20) // max(1, packed.shape[1]))
    for k in range(0, len(rows), step):
        out[k : k + step] = (packed[rows[k : k + step]] & packed[others[k : k + step]]).any(axis=1)
    return out


def candidate_pairs(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers of the pairs that this group has to compare: all within a block, or all between its two blocks."""
    own = np.asarray(batch.column("own"))
    if own.min() == own.max() == batch.column("right")[0].as_py() == batch.column("left")[0].as_py():
        return np.triu_indices(batch.num_rows, 1)
    first, second = np.flatnonzero(own == own.min()), np.flatnonzero(own != own.min())
    return np.repeat(first, len(second)), np.tile(second, len(first))


def local_roots(n: int, rows: np.ndarray, others: np.ndarray, order: np.ndarray) -> np.ndarray:
    """For each of n rows the row of the first item (by order) in its linked group."""
    label = order.copy()
    while True:
        low = np.minimum(label[rows], label[others])
        new = label.copy()
        np.minimum.at(new, rows, low)
        np.minimum.at(new, others, low)
        back = np.empty_like(order)
        back[order] = np.arange(n)
        new = np.minimum(new, new[back[new]])
        if (new == label).all():
            return back[label]
        label = new


def linked(
    members: DataFrame, verdict: Callable[[pa.RecordBatch, np.ndarray, np.ndarray], np.ndarray], name: str
) -> DataFrame:
    """item, root, weight: partial results of every group; sum the weights and join the roots for the whole.

    members: as dealt, bucket, blocks, own, item (binary), copies (long), buckets (array<long>) and what ``verdict`` needs; it
    says for pairs of rows whether they are linked.
    """

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, others = candidate_pairs(batch)
            if not len(rows):
                continue
            fits = verdict(batch, rows, others)
            rows, others = rows[fits], others[fits]
            if not len(rows):
                continue
            new = ~earlier(batch, rows, others)
            rows, others = rows[new], others[new]
            if not len(rows):
                continue
            n = batch.num_rows
            items = batch.column("item").to_pylist()
            copies = np.asarray(batch.column("copies"))
            weight = np.bincount(rows, copies[others], n) + np.bincount(others, copies[rows], n)
            order = np.empty(n, np.int64)
            order[np.array(sorted(range(n), key=items.__getitem__))] = np.arange(n)
            root = local_roots(n, rows, others, order)
            there = np.flatnonzero(weight)
            yield pa.RecordBatch.from_arrays(
                [pa.array([items[k] for k in there], pa.binary()), pa.array([items[root[k]] for k in there], pa.binary()), pa.array(weight[there].astype(np.int64))],
                names=["item", "root", "weight"],
            )

    return written(compared(members, compare, "item binary, root binary, weight long"), name)


def components(edges: DataFrame) -> DataFrame:
    """item, component: for each end of an edge (item, root) the least item that edges lead to.

    Alternates two steps: every larger neighbour of an item moves to its least neighbour, then every smaller one does, until
    nothing changes. Each step joins items with their least neighbour, which is found by partial minima; no list of
    neighbours is built, and rounds grow with the logarithm of a chain's length.
    """
    now = written(edges.filter(F.col("item") != F.col("root")).select("item", "root").distinct(), "edges")
    state = None
    while True:
        both = now.union(now.select(F.col("root"), F.col("item")))
        least = both.groupBy("item").agg(F.min("root").alias("low")).select("item", F.least("item", "low").alias("low"))
        # larger neighbours of each item move to its least neighbour
        large = both.join(least, "item").filter(F.col("root") > F.col("item")).select(F.col("root").alias("item"), F.col("low").alias("root"))
        large = large.filter(F.col("item") != F.col("root")).distinct()
        # smaller neighbours of each item, and the item itself, move to the least of them
        below = large.groupBy("item").agg(F.min("root").alias("low"))
        small = large.join(below, "item").select(F.explode(F.array(F.col("item"), F.col("root"))).alias("item"), F.col("low").alias("root"))
        now = written(small.filter(F.col("item") != F.col("root")).distinct(), "edges")
        new = now.agg(F.count("*"), F.sum(F.xxhash64("item", "root").cast("decimal(38,0)"))).first()
        if new == state:
            break
        state = new
    roots = now.select(F.col("root").alias("item"), F.col("root").alias("component")).distinct()
    return now.select("item", F.col("root").alias("component")).union(roots).distinct()
