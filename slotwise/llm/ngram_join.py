"""N-gram Jaccard join by chosen paths, and the groups of near-duplicate documents that it links.

A document is the set of its five-word shingles (words are runs without ASCII white space; a text of one to four words is one
shingle). Documents are linked if the Jaccard similarity of their sets is 0.8 or more, which is computed exactly.

Sets are split recursively. Every set has 64 min-hash coordinates, each the hash of one sampled token; two sets agree in a
coordinate with the probability of their similarity. A node of the recursion draws some coordinates (1 / threshold of them on
average, so that a pair at the threshold goes down one path of each node on average) and sends each set to the child named by
its token there. Children of one set end at once, children of at most ``small`` sets are compared by brute force, larger ones
are split again down to ``depth``, where what is left is compared in blocks. All of this is repeated in independent runs:
their number follows from the probability that a pair at the threshold stays together down to the last level, and from the
recall aimed at.

Equal sets are one class from the start, with a count, so a text that fills a third of the table costs no more than another.
In a bucket a first pass drops all sets whose sketches agree with no other's; only the rest fetch their shingles for the exact
comparison. No pair is written anywhere: each bucket gives, for each class, the number of links and one edge to its group.
Counting the links of n different texts that all resemble each other takes n * n / 2 comparisons, spread over blocks.

Null texts and texts without a word link with nothing and are groups of their own. Repeated rows are copies of each other. A
null doc_id counts in n_links of the others; class_id is null if no member has an id. Further columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slotwise.llm import pairs
from slotwise.llm.common import WordHashes, map_steps, mixed, text_key, written
from slotwise.llm.lexicon import likely

SHINGLE_WORDS = 5
THRESHOLD = 0.8
COORDINATES = 64
DEPTH = 3
SMALL = 64
TARGET_RECALL = 0.999
#: Sketches of a pair at the threshold agree in fewer of the 64 places than this about once in 10 billion pairs; such a link is lost.
SKETCH_SHARE = 0.45
#: Shingles that a block may hold.
BLOCK_SHINGLES = 2_000_000
#: Bytes of text that a Python step turns into shingles.
_STEP = 2 << 20

_ODD = mixed(np.arange(1, COORDINATES + 1, dtype=np.uint64)) | np.uint64(1)
_SHIFT = mixed(np.arange(1001, 1001 + COORDINATES, dtype=np.uint64))


def shingles(words: list[bytes], hashes: WordHashes) -> np.ndarray:
    """The set of shingles as sorted 64-bit hashes."""
    size = min(SHINGLE_WORDS, len(words))
    if not size:
        return np.zeros(0, np.uint64)
    codes = hashes(words)
    n = len(words) - size + 1
    out = codes[:n].copy()
    for k in range(1, size):
        out = out * np.uint64(0x9E3779B97F4A7C15) + codes[k : n + k]
    return np.unique(mixed(out))


def coordinates(tokens: np.ndarray) -> np.ndarray:
    """The least hash of the tokens under each of the 64 functions, mixed."""
    low = np.full(COORDINATES, np.iinfo(np.uint64).max, np.uint64)
    for k in range(0, len(tokens), 2048):
        np.minimum(low, (tokens[None, k : k + 2048] * _ODD[:, None] + _SHIFT[:, None]).min(axis=1), out=low)
    return mixed(low)


def signatures(docs: DataFrame) -> DataFrame:
    """doc_id, text_key, item (16 bytes that stand for the set; null without a word), n_tokens, chosen, sketch."""
    def sign(batch: pa.RecordBatch, hashes: WordHashes) -> dict[str, list]:
        out: dict[str, list] = {"item": [], "n_tokens": [], "chosen": [], "sketch": []}
        for text in batch.column("text").to_pylist():
            tokens = shingles((text or "").encode().split(), hashes)
            at = coordinates(tokens)
            out["item"].append(xxhash.xxh128_digest(tokens.tobytes()) if len(tokens) else None)
            out["n_tokens"].append(len(tokens))
            out["chosen"].append(at.astype(np.uint32).view(np.int32) if len(tokens) else None)
            out["sketch"].append(at.astype(np.uint16).tobytes() if len(tokens) else None)
        return out | {c: batch.column(c) for c in ("doc_id", "text_key")}

    return map_steps(
        docs.select("doc_id", text_key(F.col("text")).alias("text_key"), "text"), sign,
        "doc_id long, text_key binary, item binary, n_tokens int, chosen array<int>, sketch binary", _STEP, WordHashes,
    )


def together(depth: int) -> float:
    """The probability that a pair at the threshold shares a path of so many levels: one shared child a node on average."""
    survive = 1.0
    for _ in range(depth):
        survive = 1 - math.exp(-survive)
    return survive


def runs_needed(target_recall: float, depth: int) -> int:
    return math.ceil(math.log(1 - target_recall) / math.log(1 - together(depth)))


def leaves(classes: DataFrame, threshold: float, target_recall: float, depth: int, small: int) -> DataFrame:
    """bucket, item: the buckets of all runs that are to be compared."""
    odds = int((1 << 20) / (threshold * COORDINATES))
    drawn = F.pmod(F.xxhash64(F.col("bucket"), F.col("at")), F.lit(1 << 20)) < odds
    spark = classes.sparkSession
    roots = (
        spark.range(runs_needed(target_recall, depth))
        .select(F.xxhash64("id").alias("bucket"), F.explode(F.sequence(F.lit(0), F.lit(COORDINATES - 1))).alias("at"))
        .filter(drawn)
        .orderBy("bucket", "at")
        .collect()
    )  # some twenty rows, whatever the input
    children = F.array(*(F.xxhash64(F.lit(r["bucket"]), F.lit(r["at"]), F.col("chosen")[r["at"]]) for r in roots))
    members = classes.select("item", F.explode(children).alias("bucket"))
    found = []
    for level in range(1, depth + 1):
        shared = members.groupBy("bucket").agg(F.count("*").alias("size")).filter("size > 1")
        members = written(members.join(shared, "bucket"), "paths")
        last = level == depth
        found.append(members.filter(F.lit(last) | (F.col("size") <= small)).select("bucket", "item"))
        if not last:
            large = members.filter(F.col("size") > small).select("bucket", "item").join(classes.select("item", "chosen"), "item")
            below = F.filter(
                F.transform("chosen", lambda x, k: F.when(F.pmod(F.xxhash64("bucket", k), F.lit(1 << 20)) < odds, F.xxhash64("bucket", k, x))),
                lambda x: x.isNotNull(),
            )
            members = large.select("item", F.explode(below).alias("bucket"))
    out = found[0]
    for more in found[1:]:
        out = out.union(more)
    return out


def alike(batch: pa.RecordBatch, rows: np.ndarray, others: np.ndarray, share: float = SKETCH_SHARE) -> np.ndarray:
    """Whether sketches agree in enough coordinates."""
    sketch = np.frombuffer(b"".join(batch.column("sketch").to_pylist()), np.uint16).reshape(batch.num_rows, -1)
    out = np.empty(len(rows), bool)
    for k in range(0, len(rows), 32768):
        out[k : k + 32768] = (sketch[rows[k : k + 32768]] == sketch[others[k : k + 32768]]).mean(axis=1) >= share
    return out


def similar(batch: pa.RecordBatch, rows: np.ndarray, others: np.ndarray, threshold: float) -> np.ndarray:
    """Whether the Jaccard similarity of sets is at least the threshold. Column tokens: sorted 64-bit hashes."""
    sets = [np.frombuffer(x, np.uint64) for x in batch.column("tokens").to_pylist()]
    sizes = np.array([len(x) for x in sets])
    if len(rows) <= 256:
        both = np.array([np.intersect1d(sets[i], sets[j], assume_unique=True).size for i, j in zip(rows, others, strict=True)])
    else:
        used = np.unique(np.concatenate([rows, others]))
        tokens, where, held = np.unique(np.concatenate([sets[k] for k in used]), return_inverse=True, return_counts=True)
        of = np.repeat(np.arange(len(used)), sizes[used])
        column = np.cumsum(held > 1) - 1
        of, column = of[held[where] > 1], column[where[held[where] > 1]]
        shared = np.zeros((len(used), len(used)), np.float32)
        order = np.argsort(column, kind="stable")
        of, column = of[order], column[order]
        step = 4096
        for start in range(0, int(column[-1]) + 1 if len(column) else 0, step):
            a, b = np.searchsorted(column, [start, start + step])
            part = np.zeros((len(used), step), np.float32)
            part[of[a:b], column[a:b] - start] = 1
            shared += part @ part.T
        both = shared[np.searchsorted(used, rows), np.searchsorted(used, others)].astype(np.int64)
    return both >= threshold * (sizes[rows] + sizes[others] - both) - 1e-9


def _flagged(members: DataFrame) -> DataFrame:
    """Of a bucket's items those with a partner that their sketches allow and that no earlier bucket has."""

    def flag(batches):
        for batch in batches:
            rows, others = pairs.candidate_pairs(batch)
            if not len(rows):
                continue
            fits = alike(batch, rows, others)
            rows, others = rows[fits], others[fits]
            new = ~pairs.earlier(batch, rows, others) if len(rows) else np.zeros(0, bool)
            there = np.unique(np.concatenate([rows[new], others[new]]))
            if len(there):
                yield batch.select(["bucket", "item", "copies", "n_tokens", "sketch", "buckets"]).take(pa.array(there))

    return pairs.compared(members, flag, "bucket long, item binary, copies long, n_tokens int, sketch binary, buckets array<long>")


def links(docs: DataFrame, threshold: float = THRESHOLD, target_recall: float = TARGET_RECALL, depth: int = DEPTH, small: int = SMALL) -> DataFrame:
    """doc_id, text_key, class_id (the least doc_id of the group), n_links (other documents linked directly), kept."""
    signed = written(signatures(docs), "signatures")
    classes = written(
        signed.filter(F.col("item").isNotNull())
        .groupBy("item")
        .agg(
            F.min("doc_id").alias("low"), F.count("*").alias("copies"), F.min("text_key").alias("text_key"),
            F.first("n_tokens").alias("n_tokens"), F.first("chosen").alias("chosen"), F.first("sketch").alias("sketch"),
        ),
        "classes",
    )
    members = written(leaves(classes, threshold, target_recall, depth, small), "leaves")
    own = members.groupBy("item").agg(F.sort_array(F.collect_list("bucket")).alias("buckets"))
    payload = classes.select("item", "copies", "n_tokens", "sketch").join(own, "item")
    flagged = written(_flagged(pairs.dealt(members).join(payload, "item")), "flagged").dropDuplicates(["bucket", "item"])

    # only the classes that are left fetch their shingles, from one text each
    wanted = written(flagged.select("item").distinct().join(classes.select("item", "text_key"), "item"), "wanted")
    texts = likely(docs.select(text_key(F.col("text")).alias("text_key"), "text"), wanted, "text_key")
    texts = texts.dropDuplicates(["text_key"]).join(wanted, "text_key").select("item", "text")

    def tokens_of(batch: pa.RecordBatch, hashes: WordHashes) -> dict[str, list]:
        return {"item": batch.column("item"), "tokens": [shingles(t.encode().split(), hashes).tobytes() for t in batch.column("text").to_pylist()]}

    tokens = written(map_steps(texts, tokens_of, "item binary, tokens binary", _STEP, WordHashes), "tokens")
    rows = pairs.dealt(flagged.withColumnRenamed("n_tokens", "load"), most_load=BLOCK_SHINGLES).drop("load").join(tokens, "item")

    def verdict(batch: pa.RecordBatch, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        fits = alike(batch, left, right)
        fits[fits] = ~pairs.earlier(batch, left[fits], right[fits])
        if fits.any():
            fits[fits] = similar(batch, left[fits], right[fits], threshold)
        return fits

    found = pairs.linked(rows, verdict, "links")
    weights = found.groupBy("item").agg(F.sum("weight").alias("others"))
    groups = written(pairs.components(found), "components").join(classes.select("item", "low"), "item")
    lowest = groups.groupBy("component").agg(F.min("low").alias("group_low"))
    known_groups = groups.join(lowest, "component").select("item", "group_low").join(weights, "item")
    verdicts = classes.select("item", "low", "copies").join(known_groups, "item", "left").select(
        "item",
        F.coalesce("group_low", "low").alias("group_low"),
        (F.coalesce("others", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
    )
    return (
        signed.select("doc_id", "text_key", "item")
        .join(verdicts, "item", "left")
        .select(
            "doc_id",
            F.when(F.col("item").isNull(), F.col("doc_id")).otherwise(F.col("group_low")).alias("class_id"),
            F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
            "text_key",
        )
        .withColumn("kept", F.coalesce(F.col("doc_id") == F.col("class_id"), F.col("class_id").isNull()))
    )


def deduplicated(docs: DataFrame) -> DataFrame:
    """One document of each group: the one with the least id. Documents of groups without any id stay, copies apart."""
    keep = links(docs).filter("kept").select(F.col("doc_id").alias("of_id"), F.col("text_key").alias("of_key")).distinct()
    rows = docs.join(keep, docs["doc_id"].eqNullSafe(F.col("of_id")) & (text_key(docs["text"]) == F.col("of_key")), "left_semi")
    return rows.withColumn("own_key", text_key(F.col("text"))).dropDuplicates(["doc_id", "own_key"]).drop("own_key")
