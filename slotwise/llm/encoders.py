"""Texts to ids of given vocabularies, for use inside tasks: each distinct word of a batch is encoded once.

A text is cut at single spaces behind other signs; no piece of either vocabulary reaches over such a place, so the ids of
the parts, put together, are those of the whole text. Texts with white space before a space or at their end are encoded whole. Tests
hold all of this against the libraries on whole texts. Strings of special tokens inside texts are plain text.
"""

from __future__ import annotations

import base64
import itertools
import os
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Characters that are white space to the byte-level vocabularies (Unicode's White_Space).
_WHITE = "\t-\r \x85\xa0  -     　"
#: Texts that are not cut at their spaces.
UNCUT = f"[{_WHITE}] |[{_WHITE}]$|^$"
#: Below U+0530 every version of Unicode has the same letters. Longer runs than 256 go to the encoder that is not quadratic.
_NEW_LETTERS = "[^\x00-ԯ]"
_LONG = r"\s{257}|\S{257}"


def read_bytes(path: str) -> bytes:
    with open(path, "rb") as file:
        return file.read()


def gathered(ids: np.ndarray, starts: np.ndarray, sizes: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """The wanted ranges of ids, one behind the other."""
    size = sizes[wanted]
    begin = np.cumsum(size) - size
    return ids[np.repeat(starts[wanted] - begin, size) + np.arange(size.sum())]


class TextEncoder:
    """spaced: a space is put before each text."""

    pieces: list[bytes]
    spaced: bool

    def words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Words with a space before each: all ids, and how many each word has."""
        raise NotImplementedError

    def whole(self, texts: list[str]) -> list[list[int]]:
        """The ids of texts as they are; with ``spaced`` the space is there already."""
        raise NotImplementedError

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts, and how many each text has. Null texts count as empty."""
        texts = pc.fill_null(texts, "")
        odd = np.asarray(pc.match_substring_regex(texts, UNCUT + "|^ " * self.spaced))
        simple = pc.split_pattern(texts.filter(pa.array(~odd)), " ")
        parts, n_parts = simple.flatten(), np.diff(np.asarray(simple.offsets))
        apart = texts.filter(pa.array(odd)).to_pylist()
        apart = [" " * self.spaced + t for t in apart]
        first = np.zeros(len(parts), bool)
        if not self.spaced and len(parts):
            first[np.cumsum(n_parts) - n_parts] = True
        coded = parts.filter(pa.array(~first)).dictionary_encode()
        apart += parts.filter(pa.array(first)).to_pylist()
        ids, sizes = self.words(coded.dictionary)
        n_words = len(sizes)
        others = self.whole(apart)
        sizes = np.concatenate([sizes, np.fromiter(map(len, others), np.int64, len(others))])
        ids = np.concatenate([ids, np.fromiter(itertools.chain.from_iterable(others), np.int64)])
        # the parts of each text in order: words by number, what was encoded apart behind them
        of_part = np.empty(len(parts), np.int64)
        of_part[~first] = np.asarray(coded.indices)
        of_part[first] = n_words + int(odd.sum()) + np.arange(int(first.sum()))
        n_units = np.ones(len(odd), np.int64)
        n_units[~odd] = n_parts
        units = np.empty(int(n_units.sum()), np.int64)
        is_odd = np.repeat(odd, n_units)
        units[~is_odd] = of_part
        units[is_odd] = n_words + np.arange(int(odd.sum()))
        before = np.concatenate([[0], np.cumsum(sizes[units])])
        ends = np.cumsum(n_units)
        return gathered(ids, np.cumsum(sizes) - sizes, sizes, units), before[ends] - before[ends - n_units]


@dataclass(frozen=True)
class ByteLevel:
    """A byte-level BPE vocabulary: the tokenizer's file, and the same vocabulary as ranks with its pattern.

    Ranks serve short runs of old alphabets, which are nearly all; the tokenizer itself encodes the rest.
    """

    tokenizer: bytes
    ranks: bytes
    pattern: str

    @classmethod
    def read(cls, tokenizer: str, ranks: str, pattern: str) -> ByteLevel:
        return cls(read_bytes(tokenizer), read_bytes(ranks), pattern)

    def encoder(self, spaced: bool = False) -> ByteLevelEncoder:
        return ByteLevelEncoder(self, spaced)


class ByteLevelEncoder(TextEncoder):
    def __init__(self, vocabulary: ByteLevel, spaced: bool) -> None:
        import tiktoken

        self.vocabulary, self.spaced = vocabulary, spaced
        ranks = {base64.b64decode(piece): int(rank) for piece, rank in map(bytes.split, vocabulary.ranks.splitlines())}
        self.pieces = [b""] * (max(ranks.values()) + 1)
        for piece, rank in ranks.items():
            self.pieces[rank] = piece
        self.sizes = np.fromiter(map(len, self.pieces), np.int64, len(self.pieces))
        self.short = tiktoken.Encoding("own", pat_str=vocabulary.pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.long = re.compile(f"{_LONG}|{_NEW_LETTERS}").search
        self.tokenizer = None

    def words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        sizes = np.zeros(len(words), np.int64)
        hard = np.asarray(pc.or_(pc.match_substring_regex(words, _NEW_LETTERS), pc.greater(pc.utf8_length(words), 256)))
        easy = words.filter(pa.array(~hard))
        ids = np.array(self.short(" " + " ".join(easy.to_pylist())) if len(easy) else [], np.int64)
        ends = np.cumsum(np.asarray(pc.binary_length(easy), np.int64) + 1)
        reached = np.cumsum(self.sizes[ids])
        stops = np.searchsorted(reached, ends) + 1
        if not np.array_equal(reached[stops - 1], ends):
            raise ValueError("a token reaches over a cut")
        sizes[~hard] = np.diff(stops, prepend=0)
        if not hard.any():
            return ids, sizes
        others = self.whole([" " + w for w in words.filter(pa.array(hard)).to_pylist()])
        sizes[hard] = [len(x) for x in others]
        out = np.empty(int(sizes.sum()), np.int64)
        of_hard = np.repeat(hard, sizes)
        out[~of_hard] = ids
        out[of_hard] = [k for x in others for k in x]
        return out, sizes

    def whole(self, texts: list[str]) -> list[list[int]]:
        hard = [t for t in texts if self.long(t)]
        if hard and self.tokenizer is None:
            from tokenizers import Tokenizer

            os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
            self.tokenizer = Tokenizer.from_buffer(self.vocabulary.tokenizer)
            self.tokenizer.encode_special_tokens = True
        found = iter(self.tokenizer.encode_batch(hard, add_special_tokens=False) if hard else [])
        return [next(found).ids if self.long(t) else self.short(t) for t in texts]


@dataclass(frozen=True)
class Pieces:
    """A vocabulary of pieces with byte fallback, whose encoder puts one space before a text."""

    model: bytes

    @classmethod
    def read(cls, path: str) -> Pieces:
        return cls(read_bytes(path))

    def encoder(self) -> PieceEncoder:
        return PieceEncoder(self)


class PieceEncoder(TextEncoder):
    spaced = True

    def __init__(self, vocabulary: Pieces) -> None:
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_proto=vocabulary.model)
        n = self.model.get_piece_size()
        names = [self.model.id_to_piece(k) for k in range(n)]
        self.pieces = [bytes([int(x[3:5], 16)]) if self.model.is_byte(k) else x.replace("▁", " ").encode() for k, x in enumerate(names)]
        self.sizes = np.fromiter(map(len, self.pieces), np.int64, n)

    def words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        found = self.model.encode(words.to_pylist(), num_threads=1)
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        return np.fromiter(itertools.chain.from_iterable(found), np.int64, int(sizes.sum())), sizes

    def whole(self, texts: list[str]) -> list[list[int]]:
        return self.model.encode([t[1:] for t in texts], num_threads=1)
