"""Alignment of two tokenizers' tokens on the same texts, by interval coalescing.

A byte-level vocabulary (A) encodes a space and the text, a vocabulary of pieces (B) the text, before which it puts a space itself. Tokens
of both are intervals of bytes. All of a batch are sorted by start (lexsort), the running maximum of their ends is accumulated, and a
group of tokens ends where a start reaches that maximum, which is where tokens of both end. Within a group each A token
is linked to each B token: runs of the two are expanded, and large groups by their distinct ids.

A first pass encodes each text once and keeps, for each document, its distinct linked pairs of ids with their number. Documents that
hold a pair are counted from these rows: summed in tasks, then by Spark. Pairs that many documents hold, above a threshold taken from
a histogram so that at most ``FREQUENT`` are left, are broadcast with their counts; the others are joined by pair and added up by document.

Texts that are null, empty, or whose tokens of A or B are other bytes than space and text have no tokens: zeros and an empty digest.
Strings of special tokens in a text are plain text. Repeated rows are documents of their own. Very long texts are encoded whole. Empty tables give no
rows. Further columns are left out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slotwise.llm.common import map_steps, written
from slotwise.llm.encoders import ByteLevel, ByteLevelEncoder, PieceEncoder, Pieces

#: Bytes of text aligned at a time.
STEP = 3 << 20
#: Pairs whose counts are broadcast, pairs of a group that are expanded token by token, distinct pairs that a task holds before it sends their counts.
FREQUENT = 1 << 17
LARGE_GROUP = 4096
_HELD = 2_000_000
#: A pair of ids is one number.
_SHIFT = 20


@dataclass(frozen=True)
class Groups:
    """Tokens of two tokenizations of the same bytes, group by group: A's before B's, each in order."""

    side: np.ndarray
    id: np.ndarray
    group: np.ndarray
    first: np.ndarray  # of its side in its group

    @classmethod
    def of(cls, a: np.ndarray, a_sizes: np.ndarray, b: np.ndarray, b_sizes: np.ndarray) -> Groups:
        side = np.repeat([0, 1], [len(a), len(b)])
        ends = np.concatenate([np.cumsum(a_sizes), np.cumsum(b_sizes)])
        starts = ends - np.concatenate([a_sizes, b_sizes])
        order = np.lexsort((side, starts))
        reached = np.maximum.accumulate(ends[order])
        opens = np.ones(len(order), bool)
        opens[1:] = starts[order][1:] >= reached[:-1]
        group = np.empty(len(order), np.int64)
        group[order] = np.cumsum(opens) - 1
        order = np.lexsort((starts, side, group))
        side, group = side[order], group[order]
        first = np.ones(len(order), bool)
        first[1:] = (group[1:] != group[:-1]) | (side[1:] != side[:-1])
        return cls(side, np.concatenate([a, b])[order], group, first)

    def links(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """group, pair, number: the linked pairs; a pair may have several rows in a group."""
        n_groups = int(self.group[-1]) + 1 if len(self.group) else 0
        n_a = np.bincount(self.group[self.side == 0], minlength=n_groups)
        n_b = np.bincount(self.group[self.side == 1], minlength=n_groups)
        start = np.cumsum(n_a + n_b) - n_a - n_b
        large = n_a * n_b > LARGE_GROUP
        plain = (self.side == 0) & ~large[self.group]
        of = self.group[plain]
        partners = n_b[of]
        begin = np.cumsum(partners) - partners
        partner = np.repeat(start[of] + n_a[of] - begin, partners) + np.arange(partners.sum())
        groups, pairs = [np.repeat(of, partners)], [np.repeat(self.id[plain], partners) << _SHIFT | self.id[partner]]
        numbers = [np.ones(len(partner), np.int64)]
        for g in np.flatnonzero(large):
            mine = self.id[start[g] : start[g] + n_a[g] + n_b[g]]
            (x, nx), (y, ny) = np.unique(mine[: n_a[g]], return_counts=True), np.unique(mine[n_a[g] :], return_counts=True)
            pairs.append((x[:, None] << _SHIFT | y).ravel())
            numbers.append((nx[:, None] * ny).ravel())
            groups.append(np.full(len(pairs[-1]), g))
        return np.concatenate(groups), np.concatenate(pairs), np.concatenate(numbers)


def _texts_of(names: int, mark: str) -> list[str]:
    return [f"{mark}{k}" for k in range(names)]


class Aligner:
    def __init__(self, a: ByteLevelEncoder, b: PieceEncoder) -> None:
        self.a, self.b = a, b
        # what a token adds to the digest's text: a sign by side and by whether it is the first of its side in its group
        self.n_a, n_b = len(a.pieces), len(b.pieces)
        self.words = [x for n, marks in ((self.n_a, ",;"), (n_b, ",|")) for mark in marks for x in _texts_of(n, mark)]
        self.base = np.array([[0, self.n_a], [2 * self.n_a, 2 * self.n_a + n_b]])

    def encoded(self, texts: pa.Array) -> tuple[np.ndarray, ...]:
        """Ids and counts of both, only of texts that both give back; and which these are."""
        a, n_a = self.a(texts)
        b, n_b = self.b(texts)
        given = b"".join(b" " + t.encode() for t in pc.fill_null(texts, "").to_pylist())
        size = np.asarray(pc.fill_null(pc.binary_length(texts), 0), np.int64) + 1
        fit = size > 1
        for ids, counts, pieces in ((a, n_a, self.a), (b, n_b, self.b)):
            own = [pieces.pieces[k] for k in ids.tolist()]
            if b"".join(own) != given:
                at = ends = 0
                for k, (n, bytes_) in enumerate(zip(counts.tolist(), size.tolist(), strict=True)):
                    fit[k] &= b"".join(own[at : at + n]) == given[ends : ends + bytes_]
                    at, ends = at + n, ends + bytes_
        a, b = a[np.repeat(fit, n_a)], b[np.repeat(fit, n_b)]
        return a, np.where(fit, n_a, 0), b, np.where(fit, n_b, 0), np.where(fit, size, 0)

    def __call__(self, texts: pa.Array) -> dict[str, object]:
        a, n_a, b, n_b, size = self.encoded(texts)
        rows = len(n_a)
        groups = Groups.of(a, self.a.sizes[a], b, self.b.sizes[b])
        n_tokens = n_a + n_b
        words = list(map(self.words.__getitem__, (self.base[groups.side, groups.first.astype(np.int64)] + groups.id).tolist()))
        ends = np.cumsum(n_tokens).tolist()
        digests = [hashlib.sha256("".join(words[e - n : e])[1:].encode()).hexdigest() if n else "" for e, n in zip(ends, n_tokens.tolist(), strict=True)]
        doc_of_group = np.repeat(np.arange(rows), n_tokens)[groups.first & (groups.side == 0)]
        group, pair, number = groups.links()
        doc = doc_of_group[group]
        order = np.lexsort((pair, doc))
        doc, pair, number = doc[order], pair[order], number[order]
        new = np.ones(len(doc), bool)
        new[1:] = (doc[1:] != doc[:-1]) | (pair[1:] != pair[:-1])
        start = np.flatnonzero(new)
        total = np.add.reduceat(number, start) if len(start) else number
        offsets = np.searchsorted(doc[start], np.arange(rows + 1))
        return {
            "n_a": n_a,
            "n_b": n_b,
            "n_groups": np.bincount(doc_of_group, minlength=rows),
            "n_links": np.bincount(doc, number, rows).astype(np.int64),
            "groups_sha256": digests,
            "pairs": pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(pair[start])),
            "numbers": pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(total)),
        }


def aligned(docs: DataFrame, a: ByteLevel, b: Pieces) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, groups_sha256, and the distinct linked pairs of ids: pairs (A id << 20 | B id) and
    numbers (of links)."""
    shared = docs.sparkSession.sparkContext.broadcast((a, b))
    held: list[Aligner] = []

    def align(batch: pa.RecordBatch) -> dict[str, object]:
        if not held:
            held.append(Aligner(shared.value[0].encoder(spaced=True), shared.value[1].encoder()))
        return held[0](batch.column("text")) | {"doc_id": batch.column("doc_id")}

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<long>, numbers array<long>"
    return map_steps(docs.select("doc_id", "text"), align, schema, STEP)


def pair_counts(rows: DataFrame) -> DataFrame:
    """pair, n: how many documents hold it; best: whether none of its A id has more."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs, numbers = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for batch in batches:
            own = np.asarray(batch.column("pairs").flatten(), np.int64)
            found, where = np.unique(np.concatenate([pairs, own]), return_inverse=True)
            pairs, numbers = found, np.bincount(where, np.concatenate([numbers, np.ones(len(own))]), len(found)).astype(np.int64)
            if len(pairs) > _HELD:
                yield pa.RecordBatch.from_arrays([pa.array(pairs), pa.array(numbers)], names=["pair", "n"])
                pairs, numbers = pairs[:0], numbers[:0]
        yield pa.RecordBatch.from_arrays([pa.array(pairs), pa.array(numbers)], names=["pair", "n"])

    counts = written(rows.select("pairs").mapInArrow(count, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")), "alignment-counts")
    a_id = F.shiftright("pair", _SHIFT)
    most = counts.groupBy(a_id.alias("a")).agg(F.max("n").alias("most"))  # at most one row for each id of the vocabulary
    return counts.join(most, a_id == F.col("a")).select("pair", "n", (F.col("n") == F.col("most")).alias("best"))


def frequent(counts: DataFrame, most: int = FREQUENT) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """pair (in order), n, best of the pairs above a number of documents that leaves at most so many."""
    level = F.floor(F.log2("n") * 8).cast("int")
    lowest, pairs = 1 << 30, 0
    for row in counts.groupBy(level.alias("level")).agg(F.count("*").alias("pairs")).orderBy(F.desc("level")).collect():
        pairs += row["pairs"]
        if pairs > most:
            break
        lowest = row["level"]
    top = counts.filter(level >= lowest).toPandas().sort_values("pair")
    return top["pair"].to_numpy(np.int64), top["n"].to_numpy(np.int64), top["best"].to_numpy(np.int64)


def measured(docs: DataFrame, a: ByteLevel, b: Pieces, most_frequent: int = FREQUENT) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256."""
    rows = aligned(docs, a, b).withColumn("_row", F.monotonically_increasing_id())
    rows = written(rows, "alignment-rows")
    counts = written(pair_counts(rows), "alignment-pairs")
    shared = docs.sparkSession.sparkContext.broadcast(frequent(counts, most_frequent))
    kept = [f for f in rows.schema if f.name not in ("pairs", "numbers")]

    def look_up(batch: pa.RecordBatch) -> dict[str, object]:
        known, n, best = shared.value
        offsets = np.asarray(batch.column("pairs").offsets)
        pair, number = np.asarray(batch.column("pairs").flatten(), np.int64), np.asarray(batch.column("numbers").flatten(), np.int64)
        doc = np.repeat(np.arange(batch.num_rows), np.diff(offsets))
        at = np.minimum(np.searchsorted(known, pair), max(len(known) - 1, 0))
        found = known[at] == pair if len(known) else np.zeros(len(pair), bool)
        sums = [np.zeros(batch.num_rows, np.int64) for _ in range(2)]
        for total, value in zip(sums, (n, best), strict=True):
            np.add.at(total, doc[found], number[found] * value[at[found]])
        ends = pa.array(np.searchsorted(doc[~found], np.arange(batch.num_rows + 1)), pa.int32())
        rare = {"rare": pa.ListArray.from_arrays(ends, pa.array(pair[~found])), "times": pa.ListArray.from_arrays(ends, pa.array(number[~found]))}
        return rare | {"known_sum": sums[0], "known_best": sums[1]} | {f.name: batch.column(f.name) for f in kept}

    schema = [*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept), "known_sum long, known_best long, rare array<long>, times array<long>"]
    looked_up = written(map_steps(rows, look_up, ", ".join(schema)), "alignment-known")
    others = (
        looked_up.select("_row", F.inline(F.arrays_zip(F.col("rare").alias("pair"), F.col("times").alias("times"))))
        .toDF("_of", "pair", "times")
        .join(counts, "pair")
        .groupBy("_of")
        .agg(F.sum(F.col("times") * F.col("n")).alias("rare_sum"), F.sum(F.when(F.col("best"), F.col("times"))).alias("rare_best"))
    )
    plus = lambda known, rare: F.col(known) + F.coalesce(rare, F.lit(0))
    return looked_up.join(others, F.col("_row") == F.col("_of"), "left").select(
        "doc_id",
        "n_a",
        "n_b",
        "n_groups",
        "n_links",
        plus("known_best", "rare_best").alias("n_best"),
        plus("known_sum", "rare_sum").alias("count_sum"),
        "groups_sha256",
    )
