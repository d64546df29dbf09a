"""Words and word beginnings that set marked documents apart, found from labelled texts."""

from __future__ import annotations

import itertools
import re
from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slotwise.llm.common import given_back, steps, written

#: Lengths of the word beginnings that count beside whole words.
BEGINNINGS = (4, 5, 6)
MAX_FEATURES = 2000
#: Log-likelihood ratio from which a feature is no chance find, and how many times likelier it must be in marked texts.
MIN_RATIO = 30.0
MIN_LIFT = 5.0

#: What separates words: beyond ASCII signs of any script, which are rare; within ASCII all but letters and digits, as bytes.
_OTHER_SIGNS = re.compile(r"[^\x00-\x7F\w]")
_BLANKS = bytes(x if x >= 0x80 or chr(x).isalnum() else 0x20 for x in range(256))
#: Features that a task counts before it sends their counts, and bytes of text between two looks at them.
_FLUSH = 400_000
_COUNT_BYTES = 1 << 20
#: What is kept of four bytes, by the length of the word that they begin.
_FIRST = np.array([0, 0xFF, 0xFFFF, 0xFFFFFF, 0xFFFFFFFF], np.uint32)
#: No word begins like this, in UTF-8.
_NO_WORD = 0xFFFFFFFF


def _spaced(text: str | None) -> bytes:
    """The lower-case text in UTF-8, with a space for all that separates words."""
    return _OTHER_SIGNS.sub(" ", (text or "").lower()).encode().translate(_BLANKS)


def _encoded_words(text: str | None) -> set[bytes]:
    """Lower-case words in UTF-8: runs of letters and digits of any script."""
    return set(_spaced(text).split())


def words_of(text: str | None) -> set[str]:
    """Lower-case words: runs of letters and digits of any script."""
    return {w.decode() for w in _encoded_words(text)}


class Features:
    """In how many texts of each kind words and, with a star, word beginnings are found.

    Words and beginnings have numbers. The beginnings of new words are cut off for many texts at once.
    """

    def __init__(self, kinds: int) -> None:
        self.words: defaultdict[bytes, int] = defaultdict(itertools.count().__next__)
        self.heads: defaultdict[str, int] = defaultdict(itertools.count(1).__next__)  # 0 stands for none
        self.of = np.zeros((0, len(BEGINNINGS)), np.int32)
        self.by_word, self.by_head = np.zeros((kinds, 0), np.int64), np.zeros((kinds, 1), np.int64)

    def __len__(self) -> int:
        return len(self.words) + len(self.heads)

    def add(self, texts: list[str | None], kinds: list[int]) -> None:
        held = [np.fromiter(map(self.words.__getitem__, own), np.int64, len(own)) for own in map(_encoded_words, texts)]
        self._cut()
        for own, kind in zip(held, kinds, strict=True):
            self.by_word[kind, own] += 1
            self.by_head[kind, self.of[own]] += 1  # once, however many of the words begin like this

    def _cut(self) -> None:
        new = pa.array(list(itertools.islice(self.words, len(self.of), None)), pa.binary()).cast(pa.string())
        length, columns = pc.utf8_length(new), []
        for size in BEGINNINGS:
            heads = pc.if_else(pc.greater(length, size), pc.utf8_slice_codeunits(new, 0, size), pa.scalar(None, pa.string())).dictionary_encode()
            numbers = [*map(self.heads.__getitem__, heads.dictionary.to_numpy(zero_copy_only=False)), 0]
            columns.append(np.array(numbers, np.int32)[np.asarray(heads.indices.fill_null(-1))])
        self.of = np.concatenate([self.of, np.stack(columns, axis=1)])
        self.by_word = np.pad(self.by_word, ((0, 0), (0, len(new))))
        self.by_head = np.pad(self.by_head, ((0, 0), (0, len(self.heads) + 1 - self.by_head.shape[1])))

    def counted(self) -> pa.RecordBatch:
        """feature, n0, n1 and so on for the kinds."""
        names = pa.concat_arrays([pa.array(list(self.words), pa.binary()).cast(pa.string()), pa.array([head + "*" for head in self.heads], pa.string())])
        columns = [pa.array(np.concatenate([x, y[1:]])) for x, y in zip(self.by_word, self.by_head, strict=True)]
        return pa.RecordBatch.from_arrays([names, *columns], names=["feature", *(f"n{k}" for k in range(len(columns)))])


class Matcher:
    """Finds which of some features texts have, without building all the others."""

    def __init__(self, wanted: list[str]) -> None:
        self.words = frozenset(w for w in wanted if not w.endswith("*"))
        self.beginnings = {k: frozenset(w[:-1] for w in wanted if w.endswith("*") and len(w) == k + 1) for k in BEGINNINGS}
        # first four bytes, so that only words that may have a feature are cut out
        heads = {int.from_bytes(w.encode()[:4], "little") for w in self.words.union(*self.beginnings.values())}
        self.heads = np.array(sorted(heads | {_NO_WORD}), np.uint32)

    def __call__(self, text: str | None) -> set[str]:
        raw = b" %b    " % _spaced(text)
        blank = np.frombuffer(raw, np.uint8) == 0x20
        edges = np.flatnonzero(blank[1:] != blank[:-1]) + 1
        starts, ends = edges[::2], edges[1::2]
        first = np.ndarray(len(raw) - 3, "<u4", raw, strides=(1,))[starts] & _FIRST[np.minimum(ends - starts, 4)]
        hit = np.flatnonzero(self.heads[np.searchsorted(self.heads, first)] == first)
        words = {raw[start:end].decode() for start, end in zip(starts[hit].tolist(), ends[hit].tolist(), strict=True)}
        out = set(self.words.intersection(words))
        for word in words:
            out.update([word[:k] + "*" for k, wanted in self.beginnings.items() if len(word) > k and word[:k] in wanted])
        return out


def bounded(labelled: DataFrame, most: int, *keys: str) -> DataFrame:
    """About so many rows at most, drawn by the hash of their keys."""
    n = labelled.count()
    if n <= most:
        return labelled
    return labelled.filter(F.pmod(F.xxhash64(*keys), F.lit(1 << 30)) < int((1 << 30) * most / n))


#: Bits by which rows without a wanted key are told; 2 MB for any number of keys.
_BITS = 1 << 24
_PART_BITS = 1 << 15


def _bit(key: Column) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(_BITS))


def likely(rows: DataFrame, wanted: DataFrame, key: str) -> DataFrame:
    """The rows whose key is among the wanted ones, and a few others that share a bit with one.

    The wanted keys' hashes set bits of a map of fixed size, which is broadcast, so that no other row enters a later shuffle.
    """
    part = F.call_function("div", F.col("_bit"), F.lit(_PART_BITS))
    bits = wanted.select(_bit(F.col(key)).alias("_bit")).groupBy(part.alias("_part")).agg(F.bitmap_construct_agg(F.col("_bit") % _PART_BITS).alias("_bits"))
    at = F.col("_bit") % _PART_BITS
    byte = F.conv(F.hex(F.substring(F.col("_bits"), (F.call_function("div", at, F.lit(8)) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    is_set = F.call_function("shiftright", byte, (at % 8).cast("int")).bitwiseAND(F.lit(1)) == 1
    found = rows.withColumn("_bit", _bit(F.col(key))).withColumn("_part", part)
    return found.join(F.broadcast(bits), "_part").filter(is_set).select(*rows.columns)


def labelled_texts(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs (doc_id, text) joined with labels on doc_id, as shuffled rows at every size. Texts without a label do not enter the shuffle."""
    return likely(docs.filter("doc_id IS NOT NULL"), labels, "doc_id").join(labels.hint("merge"), "doc_id")


def marked_labels(labels: DataFrame, mark: Column) -> DataFrame:
    """doc_id, mark (0 or 1): one row for each id that has a label; of repeated labels the greatest counts."""
    return labels.select("doc_id", mark.cast("int").alias("mark")).filter("doc_id IS NOT NULL AND mark IS NOT NULL").groupBy("doc_id").agg(F.max("mark").alias("mark"))


def _counted(kinds: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = Features(kinds)
        for batch in steps(batches, _COUNT_BYTES):
            features.add(batch.column("text").to_pylist(), batch.column("kind").to_pylist())
            if len(features) > _FLUSH:
                yield features.counted()
                features = Features(kinds)
        yield features.counted()

    return count


def found_by_kind(labelled: DataFrame, kinds: int, most: int = MAX_FEATURES) -> list[list[str]]:
    """For each kind of labelled texts (text, kind from 0 on) the features that speak for it, the surest first; one pass over the texts."""
    sizes = {r["kind"]: r["count"] for r in labelled.groupBy("kind").count().collect()}
    n = sum(sizes.values())
    names = [f"n{k}" for k in range(kinds)]
    counts = labelled.select("text", "kind").mapInArrow(given_back(_counted(kinds)), "feature string, " + ", ".join(f"{x} long" for x in names))
    counts = counts.groupBy("feature").agg(*(F.sum(x).alias(x) for x in names))
    held = sum((F.col(x) for x in names[1:]), F.col(names[0]))
    part = lambda k, expected: F.when(k > 0, k * F.log(k / expected)).otherwise(0.0)
    sure = {}
    for k, name in enumerate(names):
        marked, others = sizes.get(k, 0), n - sizes.get(k, 0)
        if marked and others:
            a, b = F.col(name), held - F.col(name)
            ratio = 2 * (part(a, held * (marked / n)) + part(b, held * (others / n)))
            lift = (a / marked) / ((b + 0.5) / others)
            sure[k] = F.when((lift >= MIN_LIFT) & (ratio >= MIN_RATIO), ratio)
    out: list[list[str]] = [[] for _ in names]
    if sure:
        ratios = counts.select("feature", *(r.alias(f"r{k}") for k, r in sure.items()))
        ratios = written(ratios.filter(F.coalesce(*(f"r{k}" for k in sure)).isNotNull()), "lexicon")
        for k in sure:
            best = ratios.filter(f"r{k} IS NOT NULL").orderBy(F.desc(f"r{k}"), "feature").limit(most)
            out[k] = [r["feature"] for r in best.select("feature").collect()]
    return out


def found(labelled: DataFrame, most: int = MAX_FEATURES) -> list[str]:
    """The features of labelled texts (text, mark) that speak for the mark, the surest first."""
    return found_by_kind(labelled.select("text", F.col("mark").alias("kind")), 2, most)[1]
