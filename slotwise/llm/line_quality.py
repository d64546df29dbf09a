"""Quality rules: lines that many documents of a host share, and documents depleted of them.

A document is judged by rules on its own words, and by its lines. A line is normalised (lower case, digits as 0, white
space as one blank) and hashed; for each host and line the distinct documents that hold it are counted. Lines held by more
than ``max_documents`` documents are removed, however many documents the host has. A document that loses more
than ``max_removed`` of its words is depleted and rejected. With a share of 0 the limit is ``min_documents`` alone, at every size
of the host: so ``cleaned``, where boilerplate of a large host is to go. ``judged`` keeps both limits by default, as its SQL does.

Copies of a text in a host are one document for these counts, so that copies alone make no line frequent. The counts are
made of partial sums, one row for each line and task; hosts and lines may be as hot as they like.

Null and empty texts have no words: all counts are 0, ``base_failed`` is true. A null host is a host of its own. Rows that
repeat an id or a whole row are judged each by itself. Columns other than those named pass through untouched.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slotwise.llm.common import map_steps, text_key, written

MIN_WORDS = 50
MAX_DOCUMENTS = 10
MAX_REMOVED = 0.5

SYMBOLS = b"#*$%&|<>"
_CONTINUED = bytes(range(0x80, 0xC0))
_NOT_SYMBOLS = bytes(x for x in range(256) if x not in SYMBOLS)
_DIGITS = re.compile(r"[0-9]")


def repeated_words(words: list[bytes], size: int = 3, distinct: set[bytes] | None = None) -> int:
    """Words that lie in a window of so many words found twice or more, the first included. distinct: the set of the words, if it is there."""
    if len(words) <= size:
        return 0
    numbers = {w: k for k, w in enumerate(distinct or set(words))}
    ids = np.fromiter(map(numbers.__getitem__, words), np.int64, len(words))
    window, most = ids[: len(ids) - size + 1], len(numbers)
    for k in range(1, size):
        if most * len(numbers) >= 1 << 62:  # keep the codes within 64 bits
            _, window = np.unique(window, return_inverse=True)
            most = len(window)
        window, most = window * len(numbers) + ids[k : len(ids) - size + 1 + k], most * len(numbers)
    found = np.sort(window)
    same = found[1:] == found[:-1]
    if not same.any():
        return 0
    order = np.argsort(window)
    again = np.zeros(len(window), bool)
    again[order[1:][same]] = again[order[:-1][same]] = True
    covered = np.zeros(len(words), bool)
    for k in range(size):
        covered[k : len(words) - size + 1 + k] |= again
    return int(covered.sum())


def normalised(line: str) -> str:
    return _DIGITS.sub("0", b" ".join(line.encode().split()).decode().lower())


def _profile(batch: pa.RecordBatch) -> dict[str, list]:
    out: dict[str, list] = {k: [] for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "line_hashes", "line_words")}
    for text in batch.column("text").to_pylist():
        raw = (text or "").encode()
        words = raw.split()
        joined = b"".join(words)
        lines = [(line, n) for line in raw.split(b"\n") if (n := len(line.split()))]
        out["n_words"].append(len(words))
        out["word_chars"].append(len(joined.translate(None, _CONTINUED)))
        out["n_symbols"].append(len(raw.translate(None, _NOT_SYMBOLS)))
        out["n_dup_lines"].append(len(lines) - len({line for line, _ in lines}))
        out["n_repeat_words"].append(repeated_words(words))
        out["line_hashes"].append([xxhash.xxh64_intdigest(normalised(line.decode())) - (1 << 63) for line, _ in lines])
        out["line_words"].append([n for _, n in lines])
    for name in ("doc_id", "source", "key"):
        out[name] = batch.column(name)
    return out


def profile(docs: DataFrame) -> DataFrame:
    """doc_id, source, key of the text, the five counts, and for each line with a word its hash and number of words."""
    return map_steps(
        docs.select("doc_id", "source", text_key(F.col("text")).alias("key"), "text"),
        _profile,
        "doc_id long, source string, key binary, n_words long, word_chars long, n_symbols long, n_dup_lines long, "
        "n_repeat_words long, line_hashes array<long>, line_words array<int>",
    )


def frequent_lines(profiles: DataFrame, max_documents: int = MAX_DOCUMENTS) -> DataFrame:
    """source, line: lines that more of the host's distinct documents hold than the limit allows, however large the host is."""
    documents = profiles.groupBy("source", "key").agg(F.first("line_hashes").alias("line_hashes"))
    return (
        documents.select("source", F.explode(F.array_distinct("line_hashes")).alias("line"))
        .groupBy("source", "line")
        .agg(F.count("*").alias("n_holding"))
        .filter(F.col("n_holding") > max_documents)
        .select("source", "line")
    )


def removed_lines(profiles: DataFrame, max_documents: int = MAX_DOCUMENTS) -> DataFrame:
    """host, text, removed_words, removed_hashes: for each distinct text of a host what it loses, if anything."""
    frequent = frequent_lines(profiles, max_documents).select(F.col("source").alias("of_host"), "line")
    lines = profiles.groupBy("source", "key").agg(
        F.first("line_hashes").alias("line_hashes"), F.first("line_words").alias("line_words")
    ).select("source", "key", F.inline(F.arrays_zip("line_hashes", "line_words")).alias("hash", "words"))
    held = lines.groupBy("source", "key", "hash").agg(F.sum("words").alias("words"))
    return (
        held.join(frequent, held["source"].eqNullSafe(frequent["of_host"]) & (held["hash"] == frequent["line"]))
        .groupBy(F.col("source").alias("lost_host"), F.col("key").alias("lost_key"))
        .agg(F.sum("words").alias("removed_words"), F.collect_list("hash").alias("removed_hashes"))
    )


def judged(docs: DataFrame, max_documents: int = MAX_DOCUMENTS, max_removed: float = MAX_REMOVED) -> DataFrame:
    """One row for each document: its counts, the words and lines it loses, base_failed and kept."""
    profiles = written(profile(docs), "line-profiles")
    lost = removed_lines(profiles, max_documents)
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    rows = profiles.drop("line_hashes", "line_words").join(
        lost, F.col("source").eqNullSafe(F.col("lost_host")) & (F.col("key") == F.col("lost_key")), "left"
    )
    return (
        rows.withColumn("removed_words", F.coalesce("removed_words", F.lit(0)))
        .withColumn("base_failed", failed)
        .withColumn("kept", ~failed & (F.col("removed_words") <= max_removed * F.col("n_words")))
        .drop("lost_host", "lost_key")
    )


def _without_lines(batch: pa.RecordBatch) -> dict[str, list]:
    texts = []
    for text, gone in zip(batch.column("text").to_pylist(), batch.column("removed_hashes").to_pylist(), strict=True):
        if gone:
            drop = set(gone)
            lines = text.split("\n")
            text = "\n".join(x for x in lines if not x.encode().split() or xxhash.xxh64_intdigest(normalised(x)) - (1 << 63) not in drop)
        texts.append(text)
    return {"text": texts} | {c: batch.column(c) for c in ("doc_id", "lang", "source")}


def cleaned(docs: DataFrame) -> DataFrame:
    """The documents that are kept, without the lines of more than MAX_DOCUMENTS of their host's; n_chars follows the text."""
    verdicts = judged(docs).select(
        F.col("source").alias("of_host"), F.col("key").alias("of_key"), "kept", "removed_hashes"
    ).filter("kept").dropDuplicates(["of_host", "of_key"]).drop("kept")
    rows = docs.select("doc_id", "text", "lang", "source").join(
        verdicts, F.col("source").eqNullSafe(F.col("of_host")) & (text_key(F.col("text")) == F.col("of_key"))
    )
    out = map_steps(
        rows.select("doc_id", "text", "lang", "source", "removed_hashes"), _without_lines,
        "doc_id long, text string, lang string, source string",
    )
    return out.withColumn("n_chars", F.length("text").cast("long"))
