"""Ranked lexical search, term at a time with limited accumulators.

The queries are a stated set, taken in blocks of a bounded number of terms; each block is searched against all documents. A first
pass keeps, for each document, the block's terms that it holds and how often (a forward index in the shared folder); document
counts, the corpus size and the greatest impact of each term are added up from it. A document belongs to one task, and so do
all its accumulators.

Terms of a query are taken rarest first. Rounds over a growing number of rare terms give partial scores; the k-th greatest of them is a
lower bound of the k-th final score. A query stops creating accumulators at the term from which the bounds of all
remaining terms together stay below it: no document without an accumulator can reach the first k then. The last pass creates accumulators
from the terms before that, drops those that the remaining bounds cannot lift to the k-th score, and continues the survivors
exactly with the remaining terms. Each task gives its k best for each query, and ranks of those give the result.

Scores are 64-bit integers. Terms are maximal runs of ASCII letters and digits and of all other characters beyond ASCII, with A-Z
lower-cased. Null and empty texts have no terms: they count nowhere and are not found, and as queries find nothing. Equal scores are ranked by
id, null ids last, then by row. Repeated rows are documents and queries of their own. Empty tables give no rows. Further
columns are left out.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from slotwise.llm.common import map_steps, written

#: Terms of the queries of a block at most (one query may have more), accumulators and scores held at a time, terms of the first round.
BLOCK_TERMS = 1 << 20
CELLS = 1 << 20
STEP = 1 << 20
FIRST_TERMS = 4

_SIGNS = bytes(c for c in range(128) if not chr(c).isalnum())
_FOLD = bytes.maketrans(_SIGNS + bytes(range(65, 91)), b" " * len(_SIGNS) + bytes(range(97, 123)))


def terms(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(_FOLD).split()


@dataclass(frozen=True)
class Entries:
    """Pairs of a key and a partner with the weight times its repeats; those of a key are starts[key] to starts[key + 1]."""

    starts: np.ndarray
    partner: np.ndarray
    weight: np.ndarray

    @classmethod
    def of(cls, key: np.ndarray, partner: np.ndarray, weight: np.ndarray, n_keys: int) -> Entries:
        order = np.argsort(key, kind="stable")
        return cls(np.searchsorted(key[order], np.arange(n_keys + 1)), partner[order], weight[order])

    def expanded(self, key: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Places of keys, repeated for each of the key's entries, and these entries; so many at a time that memory is bounded."""
        size = self.starts[key + 1] - self.starts[key]
        before = np.concatenate([[0], np.cumsum(size)])
        bounds = np.unique(np.append(np.searchsorted(before, np.arange(0, before[-1], STEP)), len(key)))
        for a, b in zip(bounds, bounds[1:], strict=False):
            own = size[a:b]
            yield np.repeat(np.arange(a, b), own), np.repeat(self.starts[key[a:b]] - before[a:b], own) + np.arange(before[a], before[b])


def _postings(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """doc (its place in the batch), term and tf of each posting, and n of each document."""
    sizes = np.diff(np.asarray(batch.column("terms").offsets))
    return (
        np.repeat(np.arange(batch.num_rows), sizes),
        np.asarray(batch.column("terms").flatten(), np.int64),
        np.asarray(batch.column("tfs").flatten(), np.int64),
        np.asarray(batch.column("n"), np.int64),
    )


def impacts(tf: np.ndarray, n: np.ndarray, documents: int, length: int) -> np.ndarray:
    m = 25 + 75 * n * documents // length
    return 1_000_000_000 * tf // (1000 * tf + 8 * m)


def forward_index(docs: DataFrame, vocabulary: list[bytes]) -> DataFrame:
    """row_id, doc_id, n (all terms of a document), terms (numbers in the vocabulary) and tfs, of documents with a term."""
    shared = docs.sparkSession.sparkContext.broadcast({t: k for k, t in enumerate(vocabulary)})

    def index(batch: pa.RecordBatch) -> dict[str, object]:
        number, at, rows, n = shared.value.get, [], [], []
        for k, text in enumerate(batch.column("text").to_pylist()):
            own = terms(text)
            if own:
                found = np.array([x for x in map(number, own) if x is not None], np.int64)
                at.append(k)
                n.append(len(own))
                rows.append(np.unique(found, return_counts=True))
        return {
            "doc_id": batch.column("doc_id").take(pa.array(at, pa.int64())), "n": n,
            "terms": [t for t, _ in rows], "tfs": [c for _, c in rows],
        }

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = map_steps(docs.select("doc_id", "text"), index, f"doc_id {kind}, n long, terms array<int>, tfs array<int>")
    return written(rows.select(F.monotonically_increasing_id().alias("row_id"), "*"), "lexical-index")


def _by_term(index: DataFrame, n_terms: int, add: Callable[..., np.ndarray]) -> DataFrame:
    """term, value: what add has made of each term in a task's documents; a task sends a row a term at most."""

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(n_terms, np.int64)
        for batch in batches:
            if batch.num_rows:
                total = add(total, *_postings(batch))
        held = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(total[held])], names=["term", "value"])

    return index.select("n", "terms", "tfs").mapInArrow(fold, "term long, value long")


def _collected(rows: DataFrame, aggregate: Column, n_terms: int) -> np.ndarray:
    found = rows.groupBy("term").agg(aggregate.alias("value")).toPandas()
    out = np.zeros(n_terms, np.int64)
    out[found["term"].to_numpy(np.int64)] = found["value"].to_numpy(np.int64)
    return out


def _best(rows: DataFrame, k: int, *order: Column) -> DataFrame:
    """The first k rows of each query, in two steps, so that no task gets what all tasks found for a query."""
    salted = Window.partitionBy("query", F.col("part") % 64).orderBy(*order)
    rows = rows.withColumn("_rank", F.row_number().over(salted)).filter(F.col("_rank") <= k)
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(*order))).filter(F.col("rank") <= k).drop("_rank", "part")


class Search:
    """One block of queries against an index: what tasks need of the queries, and the passes."""

    def __init__(self, index: DataFrame, queries: list[dict[int, int]], vocabulary_size: int, k: int) -> None:
        self.index, self.k, self.n_queries, self.n_terms = index, k, len(queries), vocabulary_size
        corpus = index.agg(F.count("*").alias("documents"), F.coalesce(F.sum("n"), F.lit(0)).alias("length")).first()
        self.documents, self.length = corpus["documents"], corpus["length"]
        held = _collected(_by_term(index, vocabulary_size, lambda total, doc, term, tf, n: total + np.bincount(term, minlength=len(total))), F.sum("value"), vocabulary_size)
        weight = np.array([math.floor(1000 * math.log((2 * self.documents + 2) / (2 * df + 1))) for df in held.tolist()], np.int64)
        documents, length = self.documents, self.length

        def greatest(total: np.ndarray, doc: np.ndarray, term: np.ndarray, tf: np.ndarray, n: np.ndarray) -> np.ndarray:
            np.maximum.at(total, term, impacts(tf, n[doc], documents, length))
            return total

        bound = weight * _collected(_by_term(index, vocabulary_size, greatest), F.max("value"), vocabulary_size)
        # (query, term) in the order of taking them: rarest first within a query
        rows = [(q, t, c) for q, own in enumerate(queries) for t, c in sorted(own.items(), key=lambda x: (held[x[0]], x[0])) if held[t]]
        self.query, self.term, repeats = np.array(rows, np.int64).reshape(-1, 3).T
        self.weight = weight[self.term] * repeats
        starts = np.searchsorted(self.query, np.arange(self.n_queries + 1))
        self.place = np.arange(len(self.query)) - starts[self.query]
        self.sizes = np.diff(starts)
        # what all terms from one on can add to a score
        reach = np.cumsum((bound[self.term] * repeats)[::-1])[::-1]
        after = np.append(reach, 0)[starts[1:]]
        self.remaining = np.append(reach, 0)
        self.starts, self.after = starts, after

    def bound_from(self, taken: np.ndarray) -> np.ndarray:
        """For each query the bound of all its terms behind the first so many."""
        return self.remaining[self.starts[:-1] + np.minimum(taken, self.sizes)] - self.after

    def creating(self, least: np.ndarray) -> np.ndarray:
        """For each query the number of terms that create accumulators, if the k-th score is at least so much."""
        reach = self.remaining[:-1] - self.after[self.query]
        return np.bincount(self.query, reach >= least[self.query], self.n_queries).astype(np.int64)

    def by_term(self, wanted: np.ndarray) -> Entries:
        return Entries.of(self.term[wanted], self.query[wanted], self.weight[wanted], self.n_terms)

    def partial(self, taken: np.ndarray) -> np.ndarray:
        """For each query the k-th greatest partial score of its first terms, 0 if there are fewer."""
        shared = self.index.sparkSession.sparkContext.broadcast(self.by_term(self.place < taken[self.query]))
        k, n_queries, documents, length = self.k, self.n_queries, self.documents, self.length

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            best = np.zeros((n_queries, k), np.int64)
            for doc, term, tf, n in _slices(batches, n_queries):
                cells = created(shared.value, doc, term, impacts(tf, n[doc], documents, length), n_queries, len(n))
                best = np.partition(np.concatenate([best, cells], axis=1), -k, axis=1)[:, -k:]
            query, at = np.nonzero(best)
            part = np.full(len(query), TaskContext.get().partitionId())
            yield pa.RecordBatch.from_arrays([pa.array(query), pa.array(best[query, at]), pa.array(part)], names=["query", "score", "part"])

        rows = self.index.select("n", "terms", "tfs").mapInArrow(run, "query long, score long, part long")
        found = _best(rows, k, F.desc("score")).filter(F.col("rank") == k).select("query", "score").toPandas()
        least = np.zeros(n_queries, np.int64)
        least[found["query"].to_numpy(np.int64)] = found["score"].to_numpy(np.int64)
        return least

    def thresholds(self) -> np.ndarray:
        """For each query a lower bound of its k-th score, from rounds over twice as many rare terms each, until none creates more."""
        taken, least = np.full(self.n_queries, FIRST_TERMS), np.zeros(self.n_queries, np.int64)
        while True:
            least = np.maximum(least, self.partial(np.where(self.bound_from(taken // 2) >= np.maximum(least, 1), taken, 0)))
            if not ((taken < self.sizes) & (self.bound_from(taken) >= least)).any():
                return least
            taken = 2 * taken

    def ranked(self) -> DataFrame:
        """query, rank, doc_id, score."""
        if not self.documents or not len(self.query):
            return self.index.sparkSession.createDataFrame([], f"query long, rank int, doc_id {self.index.schema['doc_id'].dataType.simpleString()}, score long")
        least = self.thresholds()
        creating = self.creating(least)
        first = self.place < creating[self.query]
        rest = Entries.of(self.query[~first], self.term[~first], self.weight[~first], self.n_queries)
        shared = self.index.sparkSession.sparkContext.broadcast((self.by_term(first), rest, least, self.bound_from(creating)))
        k, n_queries, n_terms, documents, length = self.k, self.n_queries, self.n_terms, self.documents, self.length

        def run(batch: pa.RecordBatch) -> dict[str, object]:
            first, rest, least, more = shared.value
            row, found = 0, []
            for doc, term, tf, n in _slices([batch], n_queries):
                impact = impacts(tf, n[doc], documents, length)
                cells = created(first, doc, term, impact, n_queries, len(n))
                query, at = np.nonzero((cells > 0) & (cells + more[:, None] >= least[:, None]))
                score = cells[query, at]
                postings = doc * n_terms + term  # in order, as the index is
                for pair, entry in rest.expanded(query):
                    wanted = at[pair] * n_terms + rest.partner[entry]
                    place = np.minimum(np.searchsorted(postings, wanted), len(postings) - 1)
                    np.add.at(score, pair, np.where(postings[place] == wanted, rest.weight[entry] * impact[place], 0))
                high = score >= least[query]
                found.append(pa.table({"query": query[high], "at": at[high] + row, "score": score[high]}))
                row += len(n)
            rows = pa.concat_tables(found)
            for name in ("doc_id", "row_id"):
                rows = rows.append_column(name, batch.column(name).take(rows["at"].combine_chunks()))
            keys = [("query", "ascending"), ("score", "descending"), ("doc_id", "ascending"), ("row_id", "ascending")]
            rows = rows.take(pc.sort_indices(rows, sort_keys=keys, null_placement="at_end"))
            query = np.asarray(rows["query"])
            rows = rows.filter(pa.array(np.arange(len(query)) - np.searchsorted(query, query) < k)).combine_chunks()
            return {x: rows[x].combine_chunks() for x in ("query", "score", "doc_id", "row_id")}

        kind = self.index.schema["doc_id"].dataType.simpleString()
        rows = map_steps(self.index, run, f"query long, score long, doc_id {kind}, row_id long").withColumn("part", F.col("row_id"))
        best = _best(rows, k, F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("row_id"))
        return best.select("query", F.col("rank").cast("int").alias("rank"), "doc_id", "score")


def created(entries: Entries, doc: np.ndarray, term: np.ndarray, impact: np.ndarray, n_queries: int, n_docs: int) -> np.ndarray:
    """The accumulators, queries x documents, of the postings whose terms have entries."""
    cells = np.zeros(n_queries * n_docs, np.int64)
    for posting, entry in entries.expanded(term):
        np.add.at(cells, entries.partner[entry] * n_docs + doc[posting], entries.weight[entry] * impact[posting])
    return cells.reshape(n_queries, n_docs)


def _slices(batches, n_queries: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """The postings of so many documents at a time that their accumulators have at most CELLS cells."""
    size = max(1, CELLS // max(n_queries, 1))
    for batch in batches:
        for a in range(0, batch.num_rows, size):
            yield _postings(batch.slice(a, size))


def ranked(docs: DataFrame, queries: DataFrame, k: int = 10, block_terms: int = BLOCK_TERMS) -> DataFrame:
    """queries: item_id, text. Returns item_id, rank, doc_id, score: the k best documents of each query."""
    spark = docs.sparkSession
    named = written(queries.select(F.monotonically_increasing_id().alias("row"), "item_id", "text"), "lexical-queries")
    lengths = named.agg(F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("n")).first()["n"]
    blocks = 1 + lengths // (2 * block_terms)  # a term has a character and a sign at least
    out = None
    for block in range(blocks):
        own = named.filter(F.pmod(F.xxhash64("row"), F.lit(blocks)) == block).orderBy("row").collect()
        counted: list[dict[bytes, int]] = []
        for row in own:
            counts: dict[bytes, int] = {}
            for term in terms(row["text"]):
                counts[term] = counts.get(term, 0) + 1
            counted.append(counts)
        vocabulary = sorted({t for c in counted for t in c})
        number = {t: x for x, t in enumerate(vocabulary)}
        search = Search(forward_index(docs, vocabulary), [{number[t]: n for t, n in c.items()} for c in counted], len(vocabulary), k)
        items = spark.createDataFrame(
            [(x, r["item_id"]) for x, r in enumerate(own)], f"of_query long, item_id {queries.schema['item_id'].dataType.simpleString()}"
        )
        found = search.ranked().join(items, F.col("query") == F.col("of_query")).select("item_id", "rank", "doc_id", "score")
        out = found if out is None else out.unionByName(found)
    return out
