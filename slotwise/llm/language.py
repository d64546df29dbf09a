"""Language identification by rank order of frequent n-grams.

For each language the most frequent n-grams of one to three characters, over all learned texts, form a ranked profile. A
document's own most frequent n-grams are ranked alike, and the language whose ranks are least out of place wins. Letters are
lower-cased; runs of anything else count as one blank.

A document's n-grams are counted inside its row. For the profiles each task adds up its rows and sends one row for each
language and n-gram, so that nothing grows with a language's share of the rows. Only the profiles, ``profile_size`` n-grams
for each of at most ``max_languages`` languages, are broadcast.

Null texts and texts without a letter are ``und`` with score 0, as is every text if nothing could be learned. Equal
distances go to the language first in alphabetical order; equal counts rank by the n-gram's code. Repeated rows are
predicted each by itself. Rows with a null language are not learned from.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slotwise.llm.common import map_steps, steps

PROFILE_SIZE = 400
MAX_LANGUAGES = 1000
UNKNOWN = "und"

_BETWEEN = re.compile(r"[\W\d_]+")
_FLUSH = 1_000_000


def has_letter(text: str | None) -> bool:
    return text is not None and any(map(str.isalpha, text))


def gram_counts(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Codes of the n-grams of a text in rising order, and their counts. A code holds up to three characters of 21 bits."""
    letters = np.frombuffer(f" {_BETWEEN.sub(' ', text.lower())} ".encode("utf-32-le"), np.uint32).astype(np.int64)
    pairs = (letters[:-1] << 21) | letters[1:]
    triples = (pairs[:-1] << 21) | letters[2:]
    return np.unique(np.concatenate([letters[letters != 32], pairs, triples]), return_counts=True)


def ranked(codes: np.ndarray, counts: np.ndarray, size: int) -> np.ndarray:
    """The most frequent codes, first rank first."""
    return codes[np.lexsort((codes, -counts))[:size]]


def _added(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    codes, where = np.unique(np.concatenate([c for c, _ in parts]), return_inverse=True)
    return codes, np.bincount(where, np.concatenate([n for _, n in parts])).astype(np.int64)


def _count_by_language(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict[str, tuple[np.ndarray, np.ndarray]] = {}

    def flushed() -> Iterator[pa.RecordBatch]:
        for lang, (codes, counts) in sums.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(codes), pa.string()), pa.array(codes), pa.array(counts)], names=["lang", "gram", "n"]
            )
        sums.clear()

    for batch in steps(batches):
        waiting: dict[str, list] = {lang: [x] for lang, x in sums.items()}
        for text, lang in zip(batch.column("text").to_pylist(), batch.column("lang").to_pylist(), strict=True):
            if has_letter(text):
                waiting.setdefault(lang, []).append(gram_counts(text))
        sums = {lang: _added(parts) for lang, parts in waiting.items()}
        if sum(len(c) for c, _ in sums.values()) > _FLUSH:
            yield from flushed()
    yield from flushed()


def learned_profiles(labelled: DataFrame, profile_size: int = PROFILE_SIZE, max_languages: int = MAX_LANGUAGES) -> dict[str, np.ndarray]:
    """The ranked n-grams of each language of labelled texts (text, lang)."""
    counts = (
        labelled.filter(F.col("lang").isNotNull())
        .select("text", "lang")
        .mapInArrow(_count_by_language, "lang string, gram long, n long")
        .groupBy("lang", "gram")
        .agg(F.sum("n").alias("n"))
    )
    best = _best(counts, profile_size)
    rows = best.limit(max_languages * profile_size + 1).collect()
    if len(rows) > max_languages * profile_size:
        raise ValueError(f"more than {max_languages} languages")
    out: dict[str, list] = {}
    for row in sorted(rows, key=lambda r: (r["lang"], -r["n"], r["gram"])):
        out.setdefault(row["lang"], []).append(row["gram"])
    return {lang: np.array(grams, np.int64) for lang, grams in out.items()}


def _best(counts: DataFrame, size: int) -> DataFrame:
    from pyspark.sql import Window

    order = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    return counts.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= size).select("lang", "gram", "n")


def predicted(docs: DataFrame, profiles: dict[str, np.ndarray], profile_size: int = PROFILE_SIZE) -> DataFrame:
    """doc_id, lang_pred, score (1 at no distance, 0 at the greatest), and the columns of ``docs`` beside text."""
    languages = sorted(profiles)
    known = np.unique(np.concatenate([profiles[x] for x in languages])) if languages else np.zeros(0, np.int64)
    ranks = np.full((len(languages), len(known) + 1), -1, np.int64)
    for k, lang in enumerate(languages):
        ranks[k, np.searchsorted(known, profiles[lang])] = np.arange(len(profiles[lang]))
    bound = docs.sparkSession.sparkContext.broadcast((languages, known, ranks))
    kept = [f for f in docs.schema if f.name != "text"]

    def predict(batch: pa.RecordBatch) -> dict[str, list]:
        languages, known, ranks = bound.value
        names, scores = [], []
        for text in batch.column("text").to_pylist():
            if not languages or not has_letter(text):
                names.append(UNKNOWN)
                scores.append(0.0)
                continue
            own = ranked(*gram_counts(text), profile_size)
            at = np.minimum(np.searchsorted(known, own), len(known) - 1)
            there = np.where(known[at] == own, ranks[:, at], -1)
            distance = np.where(there < 0, profile_size, np.abs(there - np.arange(len(own)))).sum(axis=1)
            best = int(distance.argmin())
            names.append(languages[best])
            scores.append(1.0 - float(distance[best]) / (profile_size * len(own)))
        return {"lang_pred": names, "score": scores} | {f.name: batch.column(f.name) for f in kept}

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept), "lang_pred string", "score double"])
    return map_steps(docs, predict, schema)
