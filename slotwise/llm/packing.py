"""Best-fit packing of token sequences, by hierarchical residual packing.

Documents become ids and one end id. What is longer than a sequence is cut into full pieces, the first piece taking the
remainder. Full pieces are sequences of their own; all others are dealt out evenly to tasks, which pack them
best-fit, longest first. A bin is then final if its gap is shorter than the shortest piece. The underfull bins become items of
further rounds: a round merges the bins of ``FAN`` tasks best-fit, until one task is left. No two bins of a task are half full or less
(they would be one bin), so a round has at most FAN items to place. Bins of more than half can only take such
items up, hence a task passes on at most FAN of them for each size of gap; the rest is final, as no later round could use
it. So a round reads a bounded number of bins a task whatever the input, and no bin that could be filled is lost.

A sequence's number is that of its first piece. Null and empty texts are one end id. Repeated rows are packed each by itself. Very
long texts become many pieces. Empty tables give no rows. The columns used are doc_id and text; others are left out.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slotwise.llm.common import map_steps, written
from slotwise.llm.encoders import ByteLevel

SIZE = 1024
END = 2
#: Pieces that a task packs, and tasks whose underfull bins meet in a round.
TASK_PIECES = 32_768
FAN = 8


def cut(n: int, size: int) -> list[tuple[int, int]]:
    """Start and length of the pieces of n ids."""
    first = (n - 1) % size + 1
    return [(0, first), *((start, size) for start in range(first, n, size))]


def pieces(docs: DataFrame, vocabulary: ByteLevel, size: int = SIZE, end: int = END, keep_ids: bool = False) -> DataFrame:
    """piece_id, doc_id, piece, start, length, ids_crc32 and, if wanted, ids: packed as little-endian unsigned 32-bit integers."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)
    held: list = []

    def encode(batch: pa.RecordBatch) -> dict[str, list]:
        if not held:
            held.append(shared.value.encoder())
        ids, counts = held[0](batch.column("text"))
        packed, ends = ids.astype("<u4").tobytes(), np.cumsum(counts)
        out: dict[str, list] = {k: [] for k in ("at", "piece", "start", "length", "ids_crc32", "ids")}
        for row, (a, b) in enumerate(zip((ends - counts).tolist(), ends.tolist(), strict=True)):
            text = packed[4 * a : 4 * b] + end.to_bytes(4, "little")
            for k, (start, length) in enumerate(cut(b - a + 1, size)):
                own = text[4 * start : 4 * (start + length)]
                for name, value in zip(out, (row, k, start, length, zlib.crc32(own), own if keep_ids else None), strict=True):
                    out[name].append(value)
        return out | {"doc_id": batch.column("doc_id").take(pa.array(out["at"], pa.int64()))}

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = map_steps(docs.select("doc_id", "text"), encode, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, ids binary")
    rows = rows if keep_ids else rows.drop("ids")
    return written(rows.select(F.monotonically_increasing_id().alias("piece_id"), "*"), "packing-pieces")


def best_fit(lengths: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Longest first (equal ones as given), each into the open bin with the least gap that holds it.

    Returns for each item the number of its bin and its offset there, and the fill of each bin.
    """
    bins, offsets = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    by_gap: list[list[int]] = [[] for _ in range(size + 1)]
    gaps = 0  # a bit for each gap that some bin has
    fills: list[int] = []
    order = np.argsort(-lengths, kind="stable")
    for item, length in zip(order.tolist(), lengths[order].tolist(), strict=True):
        fitting = gaps >> length
        if fitting:
            gap = length + (fitting & -fitting).bit_length() - 1
            bin_ = by_gap[gap].pop()
            if not by_gap[gap]:
                gaps &= ~(1 << gap)
        else:
            gap, bin_ = size, len(fills)
            fills.append(0)
        bins[item], offsets[item] = bin_, size - gap
        fills[bin_] = size - gap + length
        if gap > length:
            by_gap[gap - length].append(bin_)
            gaps |= 1 << (gap - length)
    return bins, offsets, np.array(fills, np.int64)


def passed_on(fills: np.ndarray, size: int, shortest: int, fan: int) -> np.ndarray:
    """The bins that a later round can use: those of at most half, and for each gap that can take a piece as many as fan others."""
    gaps = size - fills
    order = np.argsort(gaps, kind="stable")
    rank = np.arange(len(order)) - np.searchsorted(gaps[order], gaps[order])
    out = np.zeros(len(fills), bool)
    out[order] = rank < fan
    return (out | (2 * fills <= size)) & (gaps >= shortest)


def packed(rows: DataFrame, size: int = SIZE, task_pieces: int = TASK_PIECES, fan: int = FAN) -> DataFrame:
    """pieces with sequence_id and offset; rows as given by ``pieces``."""
    short = rows.filter(F.col("length") < size)
    found = short.agg(F.count("*").alias("n"), F.min("length").alias("shortest")).first()
    full = rows.filter(F.col("length") >= size).withColumns({"sequence_id": F.col("piece_id"), "offset": F.lit(0).cast("long")})
    if not found["n"]:
        return full
    shortest, tasks = found["shortest"], -(-found["n"] // task_pieces)
    kept = [f for f in rows.schema if f.name != "ids"]

    def first_round(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The pieces of a task; each bin's first piece tells its fill and whether it goes on."""
        table = pa.Table.from_batches(list(batches))
        if not table.num_rows:
            return
        table = table.sort_by([("length", "descending"), ("piece_id", "ascending")]).combine_chunks()
        bins, offsets, fills = best_fit(np.asarray(table["length"]), size)
        first = np.zeros(len(fills), np.int64)
        first[bins[offsets == 0]] = np.asarray(table["piece_id"])[offsets == 0]
        goes_on = passed_on(fills, size, shortest, fan)[bins] & (offsets == 0)
        task = np.full(len(bins), TaskContext.get().partitionId())
        for name, values in (("sequence_id", first[bins]), ("offset", offsets), ("fill", fills[bins]), ("task", task), ("goes_on", goes_on)):
            table = table.append_column(name, pa.array(values))
        yield from table.to_batches()

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept)
    dealt = short.select(*(f.name for f in kept)).repartition(tasks)
    out = written(dealt.mapInArrow(first_round, f"{schema}, sequence_id long, offset long, fill long, task long, goes_on boolean"), "packing-bins")

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches)).sort_by([("fill", "descending"), ("bin", "ascending")])
        names, sizes = np.asarray(table["bin"]), np.asarray(table["fill"])
        bins, offsets, fills = best_fit(sizes, size)
        into = np.zeros(len(fills), np.int64)
        into[bins[offsets == 0]] = names[offsets == 0]
        goes_on = passed_on(fills, size, shortest, fan)[bins] & (offsets == 0)
        columns = {"bin": names, "fill": fills[bins], "task": np.full(len(bins), table["task"][0].as_py()), "into": into[bins], "shift": offsets, "goes_on": goes_on}
        yield pa.RecordBatch.from_pydict({k: pa.array(v) for k, v in columns.items()})

    placed = out.drop("fill", "task", "goes_on")
    bins = out.filter("goes_on").select(F.col("sequence_id").alias("bin"), "fill", "task")
    while tasks > 1:
        tasks = -(-tasks // fan)
        merged = bins.select("bin", "fill", F.floor(F.col("task") / fan).alias("task")).groupBy("task").applyInArrow(merge, "bin long, fill long, task long, into long, shift long, goes_on boolean")
        merged = written(merged, "packing-round")
        moved = merged.filter("bin <> into").select("bin", "into", "shift")  # at most one for each task of the last round
        placed = placed.join(moved, placed["sequence_id"] == moved["bin"], "left").withColumns(
            {"sequence_id": F.coalesce("into", "sequence_id"), "offset": F.col("offset") + F.coalesce("shift", F.lit(0))}
        ).drop("bin", "into", "shift")
        bins = merged.filter("goes_on").select("bin", "fill", "task")
    if "ids" in rows.columns:
        placed = placed.join(rows.select("piece_id", "ids"), "piece_id")
    return placed.unionByName(full)


def sequences(rows: DataFrame) -> DataFrame:
    """sequence_id, ids (array<long>), from packed pieces that kept their ids; a sequence has a bounded number of them."""
    word = lambda x, k: F.conv(F.concat(*(F.hex(F.substring(x, k * 4 + b, 1)) for b in (4, 3, 2, 1))), 16, 10).cast("long")
    ids = F.transform(F.sequence(F.lit(0), F.col("length").cast("int") - 1), lambda k: word(F.col("ids"), k))
    parts = rows.select("sequence_id", F.struct("offset", ids.alias("ids")).alias("part")).groupBy("sequence_id").agg(F.sort_array(F.collect_list("part")).alias("parts"))
    return parts.select("sequence_id", F.flatten(F.transform("parts", lambda p: p["ids"])).alias("ids"))
