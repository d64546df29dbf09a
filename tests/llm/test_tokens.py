"""Packing, lexical search and alignment against plain Python, and the encoders against the libraries on whole texts."""

import collections
import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from slotwise.llm import alignment, lexical, packing
from slotwise.llm.encoders import Pieces
from slotwise.llm.queries import byte_level, queries
from tests.llm.conftest import documents, pseudo

SIGNS = ["a", "b ", " A", "1", "'s", ".", "\t", "\n", "\r", " ", "\xa0", "\x85", " ", "　", "\x1c", "\x00", "é", "漢", "ß", "\U0001f600", "▁",
         "<|endoftext|>", "</s>", "<0x41>", "́", "٣", "ﬁ", "über ", " schön", "мир "]
LONG_RUNS = ["9" * 3000, "x" * 3000, " " * 300, "a " * 500 + " ", "x" * 3000 + " " + "y" * 300 + " z", ("été " * 400).strip(), "don't 's  's", " \n x"]


def a_model():
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    tokenizer.encode_special_tokens = True
    return tokenizer


def b_model():
    return sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))


def odd_texts():
    draw = random.Random(7)
    return ["", " ", "  ", "\n", *LONG_RUNS, *("".join(draw.choice(SIGNS) for _ in range(draw.randint(1, 50))) for _ in range(1500))]


def test_encoders_give_what_the_libraries_give():
    texts = odd_texts()
    split = lambda found: [x.tolist() for x in np.split(found[0], np.cumsum(found[1])[:-1])]
    arrow = pa.array(texts)
    for spaced in (False, True):
        whole = a_model().encode_batch([" " * spaced + t for t in texts], add_special_tokens=False)
        assert split(byte_level().encoder(spaced)(arrow)) == [e.ids for e in whole]
    pieces = Pieces.read(public_tokenizers.path("piece_bpe_32k.model")).encoder()
    for text, mine, theirs in zip(texts, split(pieces(arrow)), b_model().encode(texts), strict=True):
        assert mine == theirs or "▁" in text  # which counts as a space, so that pieces are other bytes anyway
    for encoder in (byte_level().encoder(), pieces):
        ids, counts = encoder(pa.array([None, "", None], pa.string()))
        assert not len(ids) and counts.tolist() == [0, 0, 0]


def rows_of(spark, name, path):
    return [r.asDict() for r in queries()[name](spark, path).collect()]


@pytest.mark.parametrize("where", ["odd", "small"])
def test_pieces_are_packed_whole(spark, odd_dir, where):
    path = odd_dir if where == "odd" else "/root/testdata/sf0.001"
    texts = [(r.doc_id, r.text or "") for r in spark.read.parquet(f"{path}/documents.parquet").collect()]
    found = rows_of(spark, "op11_packing", path)
    expected = collections.Counter()
    for doc_id, text in texts:
        ids = [*a_model().encode(text, add_special_tokens=False).ids, 2]
        first = len(ids) % 1024 or 1024
        starts = [0, *range(first, len(ids), 1024)]
        for k, start in enumerate(starts):
            own = ids[start : starts[k + 1] if k + 1 < len(starts) else None]
            expected[doc_id, k, start, len(own), zlib.crc32(np.array(own, "<u4").tobytes())] += 1
    assert collections.Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in found) == expected
    gapless(found)
    assert len({r["sequence_id"] for r in found}) <= 1.02 * sum(r["length"] for r in found) / 1024 + 1


def gapless(found, size=1024):
    sequences = collections.defaultdict(list)
    for r in found:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for own in sequences.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= size
    return sequences


@pytest.mark.parametrize("kind", ["even", "large", "small", "equal"])
def test_rounds_lose_no_room(spark, kind):
    """Tasks of few pieces and several rounds: hardly more bins than one plain best-fit over everything, whatever the lengths."""
    draw = random.Random(3)
    sizes = {"even": lambda: draw.randint(1, 63), "large": lambda: draw.choice([40, 41, 23, 24]), "small": lambda: draw.randint(1, 9), "equal": lambda: 36}[kind]
    lengths = [sizes() for _ in range(4000)] + [64] * 5
    rows = spark.createDataFrame([(k, k, 0, n) for k, n in enumerate(lengths)], "piece_id long, doc_id long, piece int, length long")
    found = [r.asDict() for r in packing.packed(rows, size=64, task_pieces=500, fan=3).collect()]
    assert sorted(r["doc_id"] for r in found) == list(range(len(lengths)))
    bins = gapless(found, 64)
    fills = packing.best_fit(np.array([n for n in lengths if n < 64]), 64)[2]
    assert len(bins) - 5 <= len(fills) * 1.03 + 1
    half = [own for own in bins.values() if 2 * sum(n for _, n in own) <= 64]
    assert len(half) <= 1  # two of them would have met in some round


def test_sequences_hold_the_ids(spark):
    docs = documents(spark, [(k, t, "en", "s") for k, t in enumerate([*pseudo(12), LONG_RUNS[3] * 3, "", None])]).select("doc_id", "text")
    rows = packing.packed(packing.pieces(docs, byte_level(), size=128, keep_ids=True), size=128).cache()
    sequences = {r.sequence_id: r.ids for r in packing.sequences(rows).collect()}
    texts = collections.defaultdict(list)
    for r in rows.orderBy("doc_id", "piece").collect():
        texts[r.doc_id] += sequences[r.sequence_id][r.offset : r.offset + r.length]
    for r in docs.collect():
        assert texts[r.doc_id] == [*a_model().encode(r.text or "", add_special_tokens=False).ids, 2]


def searched(docs, queries, k):
    """All scores, the plain way."""
    import math

    fold = lambda t: "".join(c.lower() if c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ" else c if ord(c) > 127 or c.isalnum() else " " for c in t or "").split(" ")
    counts = [(i, collections.Counter(filter(None, fold(t)))) for i, t in docs]
    n_docs, total = sum(bool(c) for _, c in counts), sum(sum(c.values()) for _, c in counts)
    df = collections.Counter(t for _, c in counts for t in c)
    out = collections.Counter()
    for item, text in queries:
        scores = []
        for i, own in counts:
            m = 25 + 75 * sum(own.values()) * n_docs // total
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (1_000_000_000 * own[t] // (1000 * own[t] + 8 * m)) for t in filter(None, fold(text)) if own[t])
            if score:
                scores.append((-score, i is None, i or 0))
        out.update((item, rank, None if null else i, -score) for rank, (score, null, i) in enumerate(sorted(scores)[:k], 1))
    return out


@pytest.mark.parametrize("blocks", [1, 3])
def test_search_equals_all_scores(spark, monkeypatch, blocks):
    """Small steps and slices, ties, copies, null ids, repeated query terms, queries of common words only; one block of queries and several."""
    monkeypatch.setattr(lexical, "CELLS", 100)
    monkeypatch.setattr(lexical, "STEP", 50)
    monkeypatch.setattr(lexical, "FIRST_TERMS", 1)
    texts = pseudo(300)
    docs = [(k, t) for k, t in enumerate(texts)] + [(900 + k, texts[3]) for k in range(30)] + [(None, texts[3]), (7, texts[7]), (950, ""), (951, None), (952, "... !")]
    wanted = [(k, " ".join(texts[k * 11].split()[: 3 + 4 * k])) for k in range(12)] + [(20, "the the OF of and"), (21, ""), (None, texts[3]), (22, "Été unknown")]
    frame = spark.createDataFrame(docs, "doc_id long, text string").withColumn("score", F.lit("x"))
    items = spark.createDataFrame(wanted, "item_id long, text string")
    block_terms = lexical.BLOCK_TERMS if blocks == 1 else sum(len(t) for _, t in wanted) // 5
    found = lexical.ranked(frame, items, k=10, block_terms=block_terms).collect()
    assert collections.Counter((r.item_id, r["rank"], r.doc_id, r.score) for r in found) == searched(docs, wanted, 10)


def test_searches_stop_creating_accumulators(spark):
    """A query whose rare words ten documents hold: its common words create none."""
    docs = spark.createDataFrame([(k, t + (" zyzzyva quokka" if k % 20 == 0 else "")) for k, t in enumerate(pseudo(400))], "doc_id long, text string")
    words = [b"quokka", b"zyzzyva", *sorted({w for t in pseudo(5) for w in lexical.terms(t)})[:30]]
    number = {w: k for k, w in enumerate(sorted(words))}
    search = lexical.Search(lexical.forward_index(docs, sorted(words)), [{number[w]: 1 for w in [b"quokka", b"zyzzyva", b"thethe"] if w in number}], len(words), 10)
    creating = search.creating(search.thresholds())
    assert 1 <= creating[0] <= 2


def cut_groups(a, b):
    """Groups from the offsets where tokens of both end."""
    ends = lambda sizes: np.cumsum(sizes).tolist()
    common = sorted(set(ends(a)) & set(ends(b)))
    group = lambda sizes: [sum(c < e for c in common) for e in ends(sizes)]
    return group(a), group(b)


@pytest.mark.parametrize("where", ["odd", "small", "signs"])
def test_alignment(spark, odd_dir, tmp_path, where):
    path = odd_dir if where == "odd" else "/root/testdata/sf0.001"
    if where == "signs":
        path = str(tmp_path)
        documents(spark, [(k, t, "en", "s") for k, t in enumerate(odd_texts()[:400])]).write.parquet(f"{path}/documents.parquet")
    docs = [(r.doc_id, r.text or "") for r in spark.read.parquet(f"{path}/documents.parquet").collect()]
    a_words, b_words = byte_level().encoder().pieces, Pieces.read(public_tokenizers.path("piece_bpe_32k.model")).encoder().pieces
    a_tokens, b_tokens, expected, counts = a_model(), b_model(), [], collections.Counter()
    for doc_id, text in docs:
        a, b = a_tokens.encode(f" {text}", add_special_tokens=False).ids, b_tokens.encode(text)
        same = text and all(b"".join(words[k] for k in ids) == f" {text}".encode() for ids, words in ((a, a_words), (b, b_words)))
        a, b = (a, b) if same else ([], [])
        groups = collections.defaultdict(lambda: ([], []))
        for side, (ids, of) in enumerate(zip((a, b), cut_groups([len(a_words[k]) for k in a], [len(b_words[k]) for k in b]), strict=True)):
            for k, g in zip(ids, of, strict=True):
                groups[g][side].append(k)
        links = [(x, y) for own in groups.values() for x in own[0] for y in own[1]]
        counts.update(set(links))
        digest = ";".join("|".join(",".join(map(str, x)) for x in groups[g]) for g in sorted(groups))
        expected.append((doc_id, len(a), len(b), len(groups), links, hashlib.sha256(digest.encode()).hexdigest() if a else ""))
    most = collections.defaultdict(int)
    for (x, _), n in counts.items():
        most[x] = max(most[x], n)
    plain = collections.Counter(
        (i, n_a, n_b, n, len(links), sum(counts[p] == most[p[0]] for p in links), sum(counts[p] for p in links), digest) for i, n_a, n_b, n, links, digest in expected
    )
    columns = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
    got = collections.Counter(tuple(r[c] for c in columns) for r in rows_of(spark, "op13_alignment", path))
    assert got == plain
    few = alignment.measured(spark.read.parquet(f"{path}/documents.parquet"), byte_level(), Pieces.read(public_tokenizers.path("piece_bpe_32k.model")), most_frequent=20)
    assert collections.Counter(tuple(r[c] for c in columns) for r in few.collect()) == plain


def test_large_groups_are_expanded_by_distinct_ids(monkeypatch):
    draw = np.random.default_rng(2)
    a, b = draw.integers(0, 5, 60), draw.integers(0, 4, 60)
    a_sizes, b_sizes = draw.integers(1, 4, 60), draw.integers(1, 4, 60)
    b_sizes[-1] += max(0, a_sizes.sum() - b_sizes.sum())
    a_sizes[-1] += max(0, b_sizes.sum() - a_sizes.sum())

    def counted():
        group, pair, number = alignment.Groups.of(a, a_sizes, b, b_sizes).links()
        out = collections.Counter()
        for x in zip(group.tolist(), pair.tolist(), number.tolist(), strict=True):
            out[x[:2]] += x[2]
        return out

    plain = counted()
    monkeypatch.setattr(alignment, "LARGE_GROUP", 2)
    assert counted() == plain


@pytest.mark.parametrize("letters", ["abcdefghijklmnopqrstuvwxyz", "a", "ab", "éèê漢"])
def test_long_words_equal_the_library(spark, letters):
    """Words far beyond what is merged pair by pair: random letters, one letter, and letters of several bytes."""
    import tiktoken

    from slotwise.llm.queries import vocabulary

    draw = random.Random(4)
    words = ["".join(draw.choice(letters) for _ in range(n)) for n in (120, 129, 1000, 3000)]
    theirs = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=vocabulary().ranks, special_tokens={})
    found = {r.word: r.ids for r in vocabulary().encoded_words(spark.createDataFrame([(w,) for w in words], "word string").repartition(4)).collect()}
    assert all(found[w] == theirs.encode_ordinary(w) for w in words)


def test_a_very_long_word_ends_soon_and_equals_the_library():
    import tiktoken

    from slotwise.llm.byte_bpe import merged
    from slotwise.llm.queries import vocabulary

    draw, ranks = random.Random(5), vocabulary().ranks
    theirs = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    for letters in ("abcdefghijklmnopqrstuvwxyz", "ab", "éèê漢"):
        word = "".join(draw.choice(letters) for _ in range(100_000))
        assert merged(word.encode(), ranks) == theirs.encode_ordinary(word)


@pytest.mark.parametrize("hashes", ["own", "all the same"])
def test_frequent_words_fill_the_table_and_are_told_apart(spark, monkeypatch, hashes):
    """Words with equal counts are taken as far as there is room, and words whose hashes are the same get their own ids."""
    from slotwise.llm import byte_bpe
    from slotwise.llm.queries import vocabulary

    if hashes != "own":
        monkeypatch.setattr(byte_bpe, "_hashed", lambda signs, starts: np.zeros(len(starts) - 1, np.uint64))
    words = [f"{a}{b}{c}zq" for a in ("schau", "qué", "wer") for b in ("ton", "lé", "xkv") for c in ("bei", "ñor", "wz")]
    docs = documents(spark, [(k, " ".join(words), "en", "s") for k in range(2)])
    table = byte_bpe.frequent_words(docs, vocabulary(), most=len(words) // 2)
    whole = sum(piece.decode(errors="ignore").encode() == piece for piece in vocabulary().ranks)
    assert 0 < len(table.hashes) - whole < len(words)
    known = byte_bpe._Known(spark.sparkContext.broadcast(vocabulary().ranks), byte_bpe.frequent_words(docs, vocabulary()))
    texts = pa.array([" " + w for w in [*words[1:], "the", "nowhere-seen"]])
    codes, sizes = known(texts)
    ends = np.cumsum(sizes)
    ranks = vocabulary().ranks
    for word, end, size in zip(texts.to_pylist(), ends, sizes, strict=True):
        if codes[end - size] >= 0:
            assert codes[end - size : end].tolist() == byte_bpe.merged(word.encode(), ranks)
    assert len(known.rare) == 1 if hashes == "own" else len(known.rare) >= 1


def test_the_driver_holds_little_beside_the_table_of_words(spark):
    """Words are hashed and packed in tasks; the driver's arrays stay near the size of the table, whatever the words' lengths."""
    import tracemalloc

    from slotwise.llm.byte_bpe import frequent_words
    from slotwise.llm.queries import vocabulary

    parts = "national government information international development university department association community president".split()
    words = [" ".join(f"{a}{b}{c}{d}" for d in parts for c in parts) for a in parts for b in parts]
    docs = documents(spark, [(k, text, "en", "s") for k, text in enumerate(words * 2)])
    own = vocabulary()
    tracemalloc.start()
    table = frequent_words(docs, own)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(table.hashes) > 58_000 and peak < 20e6


def test_a_step_of_the_fold_searches_no_position_and_works_out_no_type(spark):
    """array_position ends by an exception for each merge, and an element of an array asks for its type in each row: most of the fold's time."""
    from slotwise.llm.queries import vocabulary

    words = ["unbelievableness", "a", "ab", "zq" * 64, "漢字かな", "xschautonbei", "é"]
    rows = vocabulary().encoded_words(spark.createDataFrame([(w,) for w in words], "word string"))
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert "aggregate(" in plan and "array_position" not in plan
    from slotwise.llm.byte_bpe import merged

    ranks = vocabulary().ranks
    assert {r.word: r.ids for r in rows.collect()} == {w: [ranks[w.encode()]] if w.encode() in ranks else merged(w.encode(), ranks) for w in words}
