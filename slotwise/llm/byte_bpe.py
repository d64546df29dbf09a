"""Byte-level BPE: encoding and decoding with the ranks of a given vocabulary; Spark's higher-order functions fold the merges.

A text is cut by the vocabulary's pattern. A word is an array of the ids of its bytes, folded by ranked merges: a step merges the
leftmost adjacent pair of the lowest rank; the ranks of adjacent pairs are kept beside the ids, so that a merge looks up two pairs
only. The rank map, from pairs of ids to the id of the piece they make, is one constant value of the expression: an array of small
maps by a hash of the pair, since a map in an expression is searched from end to end. It comes from a one-row table by a scalar
subquery, as a literal of that size would be printed in every description of the plan. Decoding puts the binary pieces of the ids
together.

Words are counted over all texts. Those of the highest counts (about ``FREQUENT_WORDS`` at most, of ``CACHED_BYTES`` at most, and never
words that occur once) are folded once and broadcast, as a table by hash; results don't depend on which they are. All other words are folded where
they stand, once for each text that holds them: no text, word or id is shuffled for it, only counts are, and a word or text that
fills a third of the table costs no more than any other. Texts go through tasks in Arrow batches that cut them into words and put
the ids in place. Words of more than ``FOLDED_BYTES`` bytes, for which a fold over arrays is quadratic, are merged in the task by a heap.

Null texts count as empty: no ids. Repeated rows are encoded alike. Special tokens are ordinary text. Vocabularies whose ranks
lack a single byte, or go beyond 28 bits, are refused.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from slotwise.llm.common import map_steps, mixed, steps, written
from slotwise.llm.encoders import UNCUT, TextEncoder, gathered

FREQUENT_WORDS = 1 << 20
CACHED_BYTES = 64
FOLDED_BYTES = 128
_SLOTS = 1 << 17
#: Words that the driver puts in order at a time.
_MERGED = 1 << 16
#: Letters in every version of Unicode: such a part, with its space, is one word of a pattern that has letters as an alternative.
_LETTERS = "^[A-Za-zÀ-ÖØ-öø-ʯ]+$"
#: A mark's bits: 28 of a rank, 7 of a place, 28 of an id. No pair has the rank _NONE.
_RANK, _PLACE = 35, 28
_NONE = (1 << 28) - 1
#: Of the places in a word, for its hash.
_FACTORS = mixed(np.arange(1, CACHED_BYTES + 1, dtype=np.uint64)) | np.uint64(1)
#: Bytes of text that a task cuts into words or puts in place at a time.
_STEP = 1 << 20


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with the value computed once: the end of a fold over nothing, for which Spark works out no type again for each row."""
    return F.aggregate(F.array().cast("array<int>"), value, lambda state, _: state, use)


def _using(df: DataFrame, name: str, constant: Column, use: Callable[[Column], Column]) -> DataFrame:
    """The rows with use(constant) as a column. The optimiser puts the subquery in place of its one mention."""
    return df.withColumn("_constant", constant).withColumn(name, _let(F.col("_constant"), use)).drop("_constant")


def _lists(values: np.ndarray | pa.Array, sizes: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), values)


def _sizes(lists: pa.ListArray) -> np.ndarray:
    return np.asarray(pc.fill_null(pc.list_value_length(lists), 0), np.int64)


def merged(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The ids of a word: the adjacent pair of the lowest rank, leftmost first, taken from a heap until none has a rank."""
    n = len(word)
    ends, before, heap = list(range(1, n + 1)), list(range(-1, n - 1)), []

    def offer(start: int) -> None:
        middle = ends[start]
        if middle < n and (rank := ranks.get(word[start : ends[middle]])) is not None:
            heapq.heappush(heap, (rank, start, ends[middle]))

    for start in range(n):
        offer(start)
    while heap:
        _, start, end = heapq.heappop(heap)
        middle = ends[start]
        if not middle or middle >= n or ends[middle] != end:
            continue  # one of the two is no longer there as it was
        ends[start], ends[middle] = end, 0
        if end < n:
            before[end] = start
        offer(start)
        if before[start] >= 0:
            offer(before[start])
    return [ranks[word[k:end]] for k, end in enumerate(ends) if end]


def _signs(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of some words, and where each word starts and the last one ends."""
    if not len(words):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = words.buffers()
    starts = np.frombuffer(offsets, np.int32)[words.offset : words.offset + len(words) + 1].astype(np.int64)
    return np.frombuffer(data or b"", np.uint8)[starts[0] : starts[-1]], starts - starts[0]


def _hashed(signs: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """64-bit hashes of words: sums of their bytes by factors of the places."""
    place = np.arange(len(signs)) - np.repeat(starts[:-1], np.diff(starts))
    sums = np.cumsum((signs + np.uint64(1)) * _FACTORS[place % len(_FACTORS)])
    return np.diff(np.concatenate([np.zeros(1, np.uint64), sums])[starts])


class WordCodes(TextEncoder):
    """Texts to the codes of their words: code gives all codes of some words, and how many each word has."""

    spaced = False

    def __init__(self, pattern: str, code: Callable[[pa.Array], tuple[np.ndarray, np.ndarray]]) -> None:
        self.find, self.code = regex.compile(pattern).findall, code
        self.alone = _LETTERS if r"| ?\p{L}+|" in pattern else "^$"

    def words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        alone = pc.match_substring_regex(words, self.alone)
        is_alone = np.asarray(alone)
        others = [self.find(" " + w) for w in words.filter(pc.invert(alone)).to_pylist()]
        n_words = np.ones(len(words), np.int64)
        n_words[~is_alone] = [len(x) for x in others]
        single = pc.binary_join_element_wise("", words.filter(alone), " ").cast(pa.string())
        codes, sizes = self.code(pa.concat_arrays([single, pa.array(list(chain.from_iterable(others)), pa.string())]))
        # the words of each part in order: those that stand alone first, then all others
        of_alone = np.repeat(is_alone, n_words)
        wanted = np.where(of_alone, np.cumsum(of_alone) - 1, len(single) + np.cumsum(~of_alone) - 1)
        before, ends = np.concatenate([[0], np.cumsum(sizes[wanted])]), np.cumsum(n_words)
        return gathered(codes, np.cumsum(sizes) - sizes, sizes, wanted), before[ends] - before[ends - n_words]

    def parts(self, texts: pa.Array) -> tuple[pa.Array, list[str]]:
        """What stands behind the single spaces that texts are cut at, and the words of all the rest."""
        texts = pc.fill_null(texts, "")
        odd = pc.match_substring_regex(texts, UNCUT)
        lists = pc.split_pattern(texts.filter(pc.invert(odd)), " ")
        parts, first = lists.flatten(), np.zeros(len(lists.flatten()), bool)
        first[np.asarray(lists.offsets)[:-1] - lists.offsets[0].as_py()] = True
        apart = texts.filter(odd).to_pylist() + parts.filter(pa.array(first)).to_pylist()
        return parts.filter(pa.array(~first)), [w for text in apart for w in self.find(text)]

    def whole(self, texts: list[str]) -> list[list[int]]:
        words = [self.find(text) for text in texts]
        codes, sizes = self.code(pa.array(list(chain.from_iterable(words)), pa.string()))
        ends = np.concatenate([[0], np.cumsum(sizes)])[np.cumsum([0, *map(len, words)])]
        return [codes[start:end].tolist() for start, end in zip(ends, ends[1:], strict=False)]


@dataclass(frozen=True)
class WordTable:
    """The ids of words by the words' hashes, in order; where the ids of each start; the bytes of all pieces by id.

    Ids that are found count only if they decode to the word itself, so words with the same hash are not mixed up.
    """

    hashes: np.ndarray
    ids: np.ndarray
    starts: np.ndarray
    pieces: Pieces

    @classmethod
    def of(cls, hashes: np.ndarray, sizes: np.ndarray, ids: np.ndarray, pieces: Pieces) -> WordTable:
        """The words in any order: their hashes, how many ids each has, all ids. Put in order by a few words at a time, as temporary arrays are larger."""
        order, sizes, kind = np.argsort(hashes, kind="stable"), sizes.astype(np.int64), np.min_scalar_type(len(pieces.starts))
        before = np.cumsum(sizes) - sizes
        parts = [gathered(ids, before, sizes, order[k : k + _MERGED]).astype(kind) for k in range(0, len(order), _MERGED)]
        starts = np.concatenate([[0], np.cumsum(sizes[order])]).astype(np.uint32)
        return cls(hashes[order], np.concatenate([np.zeros(0, kind), *parts]), starts, pieces)

    def find(self, signs: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The numbers of the words that are there, all their ids, how many each has, and the numbers of those whose hash is another word's."""
        hashes, none = _hashed(signs, starts), np.zeros(0, np.int64)
        if not len(self.hashes):
            return none, none, none, none
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        found = np.flatnonzero(self.hashes[at] == hashes)
        first, lengths = self.starts[at[found]].astype(np.int64), np.diff(starts)[found]
        sizes = self.starts[at[found] + 1] - first
        ids = gathered(self.ids, first, sizes, np.arange(len(found))).astype(np.int64)
        decoded, ends = self.pieces.decoded(ids, sizes)
        if np.array_equal(np.diff(ends, prepend=0), lengths) and np.array_equal(decoded, gathered(signs, starts[found], lengths, np.arange(len(found)))):
            return found, ids, sizes, none
        same = np.array([
            decoded[a:b].tobytes() == signs[starts[k] : starts[k + 1]].tobytes()
            for k, a, b in zip(found, np.concatenate([[0], ends]), ends, strict=False)
        ])
        return found[same], ids[np.repeat(same, sizes)], sizes[same], found[~same]


@dataclass(frozen=True)
class Pieces:
    """The bytes of all pieces, and where those of each id start."""

    signs: np.ndarray
    starts: np.ndarray

    @classmethod
    def of(cls, ranks: dict[bytes, int]) -> Pieces:
        every = [b""] * (max(ranks.values()) + 1)
        for piece, rank in ranks.items():
            every[rank] = piece
        return cls(np.frombuffer(b"".join(every), np.uint8), np.cumsum([0, *map(len, every)]))

    def decoded(self, ids: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All bytes that ids decode to, and where those of each text end; sizes: how many ids each text has."""
        lengths = self.starts[ids + 1] - self.starts[ids]
        ends = np.concatenate([[0], np.cumsum(lengths)])[np.cumsum(sizes)]
        return gathered(self.signs, self.starts[ids], lengths, np.arange(len(ids))), ends


@dataclass(frozen=True)
class Marks:
    """Words of bytes, as the fold takes them. ids: of each byte; ranks: of each pair of bytes."""

    ids: np.ndarray
    ranks: np.ndarray

    @classmethod
    def of(cls, ranks: dict[bytes, int]) -> Marks:
        pairs = np.full((256, 256), _NONE, np.int32)
        for piece, rank in ranks.items():
            if len(piece) == 2:
                pairs[piece[0], piece[1]] = rank
        return cls(np.array([ranks[bytes([b])] for b in range(256)], np.int32), pairs)

    def __call__(self, signs: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """A mark for each byte of some words, of FOLDED_BYTES at most, that stand one behind the other."""
        ends = np.cumsum(lengths)
        ranks = self.ranks[signs, np.append(signs[1:], signs[:1])].astype(np.int64)
        ranks[ends[lengths > 0] - 1] = _NONE
        return ranks << _RANK | np.arange(len(signs)) - np.repeat(ends - lengths, lengths) << _PLACE | self.ids[signs]


class _Known:
    """Ids of words where they are known in the task; -1, -2, ... stand for the words in ``rare``, which are not."""

    def __init__(self, ranks: Broadcast, table: WordTable) -> None:
        self.ranks, self.table, self.rare = ranks, table, {}

    def __call__(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        signs, starts = _signs(words)
        found, ids, n_ids, mistaken = self.table.find(signs, starts)
        missing = np.ones(len(words), bool)
        missing[found] = False
        missing, mistaken = np.flatnonzero(missing), set(mistaken.tolist())
        others = [self.code(signs[starts[k] : starts[k + 1]].tobytes(), k in mistaken) for k in missing.tolist()]
        sizes = np.concatenate([n_ids, np.fromiter(map(len, others), np.int64, len(others))])
        codes = np.concatenate([ids, np.array([k for x in others for k in x], np.int64)])
        order = np.empty(len(words), np.int64)
        order[np.concatenate([found, missing])] = np.arange(len(words))
        return gathered(codes, np.cumsum(sizes) - sizes, sizes, order), sizes[order]

    def code(self, word: bytes, mistaken: bool) -> tuple[int, ...]:
        if mistaken and word in self.ranks.value:
            return (self.ranks.value[word],)
        if len(word) > FOLDED_BYTES:
            return tuple(merged(word, self.ranks.value))
        return (-1 - self.rare.setdefault(word, len(self.rare)),)


@dataclass(frozen=True)
class Vocabulary:
    """Ranks by piece, and the pattern that cuts texts into words."""

    ranks: dict[bytes, int]
    pattern: str

    def __post_init__(self) -> None:
        if not all(bytes([b]) in self.ranks for b in range(256)):
            raise ValueError("a rank for every single byte is needed")
        if max(self.ranks.values()) >= _NONE:
            raise ValueError(f"ranks below {_NONE} are needed")

    @classmethod
    def read(cls, path: str, pattern: str) -> Vocabulary:
        """A file of lines: piece in base 64, rank."""
        with open(path, "rb") as lines:
            return cls({base64.b64decode(piece): int(rank) for piece, rank in map(bytes.split, lines)}, pattern)

    def merges(self, spark: SparkSession) -> Column:
        """The id of what each pair of ids makes: small maps by a hash of the pair, in one constant value."""
        ranks = self.ranks
        made = [
            (ranks[piece[:k]], ranks[piece[k:]], rank)
            for piece, rank in ranks.items()
            for k in range(1, len(piece))
            if piece[:k] in ranks and piece[k:] in ranks
        ]
        left, right, rank = np.array(made, np.int64).reshape(-1, 3).T
        slot = (left * 7919 + right) & (_SLOTS - 1)
        order = np.argsort(slot, kind="stable")
        offsets = np.searchsorted(slot[order], np.arange(_SLOTS + 1)).astype(np.int32)
        maps = pa.MapArray.from_arrays(pa.array(offsets), pa.array(((left << 32) | right)[order]), pa.array(rank[order]))
        one_row = pa.table({"slots": pa.ListArray.from_arrays(pa.array([0, _SLOTS], pa.int32()), maps)})
        return written(spark.createDataFrame(one_row), "bpe-merges").scalar()

    def folded(self, word: Column, table: Column) -> Column:
        """The ids that a word, an array of marks, is merged to; table: as merges() gives it.

        A mark is one number for each part of the word: from the top the rank of the pair that it makes with the next part, where it
        starts, and its id. So the lowest mark is the leftmost pair of the lowest rank, and one array holds all that a step needs.
        """
        of = lambda mark: mark.bitwiseAND(F.lit((1 << _PLACE) - 1))
        rest = lambda mark: mark.bitwiseAND(F.lit((1 << _RANK) - 1))

        def pair(a: Column, b: Column) -> Column:
            """The rank of a pair of ids, at its place in a mark."""
            small = F.get(table, (a * 7919 + b).bitwiseAND(F.lit(_SLOTS - 1)).cast("int"))
            return F.shiftleft(F.coalesce(F.element_at(small, F.shiftleft(a, 32).bitwiseOR(b)), F.lit(_NONE)), _RANK)

        def merge(marks: Column, low: Column, at: Column) -> Column:
            """at: the number of the pair from 0; what it makes has its rank as id."""
            made = F.shiftright(low, _RANK)
            new = pair(made, of(F.get(marks, at + 2))).bitwiseOR(rest(low) - of(low)).bitwiseOR(made)
            before = lambda mark: pair(of(mark), made).bitwiseOR(rest(mark))
            changed = F.transform(marks, lambda mark, k: F.when(k == at, new).when(k == at - 1, before(mark)).otherwise(mark))
            return F.filter(changed, lambda _, k: k != at + 1)

        def step(marks: Column, _: Column) -> Column:
            # array_position ends by an exception in Spark, which takes longer than counting the parts before
            at = lambda low: F.size(F.filter(marks, lambda mark: rest(mark) < rest(low)))
            place = lambda low: _let(at(low), lambda k: merge(marks, low, k))
            return _let(F.array_min(marks), lambda low: F.when(low < F.lit(_NONE << _RANK), place(low)).otherwise(marks))

        return F.aggregate(F.sequence(F.lit(1), F.size(word) - 1), word, step, lambda end: F.transform(end, of))

    def encoded_words(self, words: DataFrame) -> DataFrame:
        """The words of a table (word) with their ids: array<bigint>. They are not cut by the pattern."""
        ranks, marks = words.sparkSession.sparkContext.broadcast(self.ranks), Marks.of(self.ranks)

        def prepare(batch: pa.RecordBatch) -> dict[str, object]:
            codes = [w.encode() for w in batch.column("word").to_pylist()]
            known = [
                [ranks.value[c]] if c in ranks.value else merged(c, ranks.value) if len(c) > FOLDED_BYTES else None for c in codes
            ]
            parts = [None if k is not None else marks(np.frombuffer(c, np.uint8), np.array([len(c)])) for c, k in zip(codes, known, strict=True)]
            return {"word": batch.column("word"), "_known": known, "_marks": parts}

        rows = map_steps(words.select("word"), prepare, "word string, _known array<bigint>, _marks array<bigint>")
        rows = _using(rows, "_folded", self.merges(words.sparkSession), lambda table: F.when(F.col("_marks").isNotNull(), self.folded(F.col("_marks"), table)))
        return rows.select("word", F.coalesce("_known", "_folded").alias("ids"))

    def counted(self, docs: DataFrame) -> DataFrame:
        """word, n: the words of all texts that are no pieces themselves and have CACHED_BYTES at most."""
        pattern, spark = self.pattern, docs.sparkSession
        parts = counted_parts(docs.select("text"), pattern)
        words = F.explode(F.regexp_extract_all("part", F.lit("(?U)" + pattern), F.lit(0))).alias("word")
        counts = parts.select(words, "n").filter(F.octet_length("word") <= CACHED_BYTES).groupBy("word").agg(F.sum("n").alias("n"))
        whole = [piece.decode() for piece in self.ranks if piece.decode(errors="ignore").encode() == piece]
        pieces = spark.createDataFrame(pa.table({"word": pa.array(whole, pa.string())}))
        return counts.join(F.broadcast(pieces), "word", "left_anti")


def counted_parts(docs: DataFrame, pattern: str) -> DataFrame:
    """part, n: what texts are cut into at single spaces, each with its space, and how often it occurs."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches, _STEP):
            parts, others = WordCodes(pattern, _signs).parts(batch.column("text"))
            found = parts.value_counts()
            spaced = pc.binary_join_element_wise("", found.field("values"), " ")
            words = pa.concat_arrays([spaced.cast(pa.string()), pa.array(others, pa.string())])
            n = pa.concat_arrays([found.field("counts"), pa.array(np.ones(len(others), np.int64))])
            yield pa.RecordBatch.from_arrays([words, n], names=["part", "n"])

    return docs.mapInArrow(count, "part string, n long").groupBy("part").agg(F.sum("n").alias("n"))


def frequent_words(docs: DataFrame, vocabulary: Vocabulary, most: int = FREQUENT_WORDS) -> WordTable:
    """All pieces that are words and the words with the highest counts, about so many at most, with their ids."""
    # steps of an eighth of a doubling: few rows, whatever the counts
    level = F.floor(F.log2("n") * 8).cast("int")
    counts = written(vocabulary.counted(docs).filter("n > 1"), "bpe-words")
    lowest, share, words = 0, 1.0, 0
    for row in counts.groupBy(level.alias("level")).agg(F.count("*").alias("words")).orderBy(F.desc("level")).collect():
        lowest, share = row["level"], min(1.0, (most - words) / row["words"])
        words += row["words"]
        if words >= most:
            break
    spark = docs.sparkSession
    # of the lowest level as many, drawn by hash, as there is room for
    best = counts.filter((level > lowest) | ((level == lowest) & (F.pmod(F.xxhash64("word"), F.lit(1 << 30)) < int(share * (1 << 30)))))
    best = best.select("word").repartition(4 * spark.sparkContext.defaultParallelism, "word")
    hashed, kind = _hashed, np.min_scalar_type(max(vocabulary.ranks.values()))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = _sizes(batch.column("ids"))
            columns = hashed(*_signs(batch.column("word"))), sizes.astype(np.uint8), np.asarray(batch.column("ids").flatten()).astype(kind)
            yield pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()) for x in columns], names=["hashes", "sizes", "ids"])

    parts = vocabulary.encoded_words(best).mapInArrow(pack, "hashes binary, sizes binary, ids binary").toArrow()
    whole = {piece: rank for piece, rank in vocabulary.ranks.items() if piece.decode(errors="ignore").encode() == piece}

    def column(name: str, own: np.ndarray) -> np.ndarray:
        return np.concatenate([own, *(np.frombuffer(x.as_buffer(), own.dtype) for x in parts.column(name))])

    hashes = column("hashes", _hashed(*_signs(pa.array([piece.decode() for piece in whole], pa.string()))))
    sizes, ids = column("sizes", np.ones(len(whole), np.uint8)), column("ids", np.array(list(whole.values()), kind))
    return WordTable.of(hashes, sizes, ids, Pieces.of(vocabulary.ranks))


def _encoded(docs: DataFrame, vocabulary: Vocabulary, most_frequent: int, finish: Callable[[np.ndarray, np.ndarray], dict], schema: str) -> DataFrame:
    """The documents without their text, with what finish makes of all ids of some texts and how many each text has."""
    context = docs.sparkSession.sparkContext
    frequent, ranks = context.broadcast(frequent_words(docs, vocabulary, most_frequent)), context.broadcast(vocabulary.ranks)
    pattern, marks = vocabulary.pattern, Marks.of(vocabulary.ranks)
    kept = [f for f in docs.schema if f.name != "text"]
    names = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept)

    def cut(batch: pa.RecordBatch) -> dict[str, object]:
        known = _Known(ranks, frequent.value)
        codes, sizes = WordCodes(pattern, known)(batch.column("text"))
        # words that are to be folded: each once for a text, numbered within it
        is_rare = codes < 0
        text = np.repeat(np.arange(len(sizes)), sizes)[is_rare]
        n = max(1, len(known.rare))
        pairs, of = np.unique(text * n + (-1 - codes[is_rare]), return_inverse=True)
        first = np.searchsorted(pairs, np.arange(len(sizes) + 1) * n)
        codes[is_rare] = first[text] - of - 1
        lengths = np.fromiter(map(len, known.rare), np.int64, len(known.rare))
        signs = gathered(np.frombuffer(b"".join(known.rare), np.uint8), np.cumsum(lengths) - lengths, lengths, pairs % n)
        words = _lists(marks(signs, lengths[pairs % n]), lengths[pairs % n])
        return {"_bpe_ids": _lists(codes.astype(np.int32), sizes), "_bpe_rare": _lists(words, np.diff(first))} | {f.name: batch.column(f.name) for f in kept}

    def place(batch: pa.RecordBatch) -> dict[str, object]:
        texts, rare = batch.column("_bpe_ids"), batch.column("_bpe_rare")
        codes, sizes, words, n_rare = np.asarray(texts.flatten(), np.int64), _sizes(texts), rare.flatten(), _sizes(rare)
        lengths = _sizes(words)
        is_rare = codes < 0
        before = np.repeat(np.cumsum(n_rare) - n_rare, sizes)
        word = before[is_rare] - 1 - codes[is_rare]
        starts, counts = np.arange(len(codes)), np.ones(len(codes), np.int64)
        starts[is_rare], counts[is_rare] = len(codes) + (np.cumsum(lengths) - lengths)[word], lengths[word]
        ids = gathered(np.concatenate([codes, np.asarray(words.flatten())]), starts, counts, np.arange(len(codes)))
        ends = np.concatenate([[0], np.cumsum(counts)])[np.cumsum(sizes)]
        return finish(ids, np.diff(ends, prepend=0)) | {f.name: batch.column(f.name) for f in kept}

    comma = ", " if kept else ""
    rows = map_steps(docs, cut, f"{names}{comma}_bpe_ids array<int>, _bpe_rare array<array<bigint>>", _STEP)
    fold = lambda table: F.transform("_bpe_rare", lambda word: vocabulary.folded(word, table))
    rows = _using(rows, "_bpe_rare", vocabulary.merges(docs.sparkSession), fold)
    return map_steps(rows, place, f"{names}{comma}{schema}", _STEP)


def encoded(docs: DataFrame, vocabulary: Vocabulary, most_frequent: int = FREQUENT_WORDS) -> DataFrame:
    """The documents with ``ids``, array<int>, in place of their text."""
    return _encoded(docs.drop("ids"), vocabulary, most_frequent, lambda ids, sizes: {"ids": _lists(ids.astype(np.int32), sizes)}, "ids array<int>")


def digests(docs: DataFrame, vocabulary: Vocabulary, most_frequent: int = FREQUENT_WORDS) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: of the ids as packed, and of the bytes they decode to."""
    pieces = docs.sparkSession.sparkContext.broadcast(Pieces.of(vocabulary.ranks))

    def digest(ids: np.ndarray, sizes: np.ndarray) -> dict[str, object]:
        ends = np.cumsum(sizes)
        parts = [ids[end - size : end] for end, size in zip(ends, sizes, strict=True)]
        return {
            "n_tokens": sizes,
            "ids_sha256": [hashlib.sha256(x.astype("<u4").data).hexdigest() for x in parts],
            "decoded_sha256": [hashlib.sha256(pieces.value.decoded(x, np.array([len(x)]))[0].data).hexdigest() for x in parts],
        }

    schema = "n_tokens long, ids_sha256 string, decoded_sha256 string"
    return _encoded(docs.select("doc_id", "text"), vocabulary, most_frequent, digest, schema)
