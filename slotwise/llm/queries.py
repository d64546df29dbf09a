"""Each operator applied to its whole table, as a registered query."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from slotwise.llm import (
    alignment,
    byte_bpe,
    embedding_dup,
    language,
    lexical,
    lexicon,
    line_quality,
    lm_score,
    mixing,
    ngram_join,
    packing,
    pii,
    token_counts,
    toxicity,
)
from slotwise.llm.common import crc_mod, new_folder, text_key, written
from slotwise.llm.encoders import ByteLevel, Pieces


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.links(documents(spark, sf_dir)).select("doc_id", "class_id", "n_links", "kept")


def op2_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    held_out = crc_mod(F.col("doc_id"), 4) == 2
    profiles = language.learned_profiles(docs.filter(~held_out).select("text", "lang"))
    return language.predicted(docs.select("doc_id", held_out.alias("held_out"), "text"), profiles)


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = crc_mod(F.col("doc_id"), 5) == 0
    docs = documents(spark, sf_dir).select("doc_id", held_out.alias("held_out"), (~held_out).alias("learn"), "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").filter(crc_mod(F.col("doc_id"), 5) != 0)
    scores = toxicity.scored(docs, lexicon.marked_labels(labels, F.col("toxic")))
    return scores.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A rollup after loading all documents, taking down those of low quality, recounting toxic ones without their first
    line, and a second tokenizer version; the middle batches are committed twice, as after a lost answer."""
    docs = documents(spark, sf_dir)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").filter("doc_id IS NOT NULL")
    marks = labels.groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("toxic").alias("toxic"))
    words, pieces = token_counts.TOKENIZERS
    shorter = F.regexp_replace("text", r"^[^\n]*\n", "")
    counted = written(
        docs.select(
            "doc_id", "source", "lang", token_counts.count_tokens(F.col("text"), words).alias("n_words"),
            token_counts.count_tokens(shorter, words).alias("n_shorter"), token_counts.count_tokens(F.col("text"), pieces).alias("n_pieces"),
        ),
        "token-counts",
    )
    known = counted.join(marks, "doc_id")
    none = F.lit(None).cast("long")
    takedown = token_counts.changes(known.filter("quality = 0"), "delete", words, none, F.col("n_words"))
    recount = token_counts.changes(known.filter("toxic = 1 AND NOT quality <=> 0"), "revise", words, F.col("n_shorter"), F.col("n_words"))

    rollup = token_counts.Rollup(spark, new_folder(spark, "rollup"))
    rollup.commit("load", token_counts.changes(counted, "insert", words, F.col("n_words"), none))
    for _ in range(2):
        rollup.commit("takedown", takedown)
        rollup.commit("recount", recount)
    rollup.commit("upgrade", token_counts.changes(counted, "insert", pieces, F.col("n_pieces"), none))
    return rollup.totals().withColumn("n_tokens", F.col("n_tokens").cast("long"))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", text_key(F.col("text")).alias("key"), "text")
    rated = mixing.rated(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    shares = (F.get("p", F.lit(k)).alias(f"p_{name}") for k, name in enumerate(mixing.DOMAINS))
    return rated.select("doc_id", "n_tokens", *shares, "rate", mixing.copies().alias("copies"))


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.spans(documents(spark, sf_dir).select("doc_id", "text")).select(
        "doc_id",
        *(pii.count_of(kind).alias(f"n_{kind}") for kind in ("email", "ip", "card", "phone")),
        F.sha2(pii.joined(F.col("base")).cast("binary"), 256).alias("base_sha256"),
        pii.joined(F.col("spans")).alias("spans"),
    )


def op7_line_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_quality.judged(documents(spark, sf_dir)).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "removed_words"
    )


def op8_embedding_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dup.links(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def vocabulary() -> byte_bpe.Vocabulary:
    return byte_bpe.Vocabulary.read(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.digests(documents(spark, sf_dir), vocabulary())


def op10_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = crc_mod(F.col("doc_id"), 7) == 2
    return lm_score.scored(documents(spark, sf_dir).select("doc_id", held_out.alias("held_out"), (~held_out).alias("learn"), "text"))


def byte_level() -> ByteLevel:
    return ByteLevel.read(public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op11_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = packing.packed(packing.pieces(documents(spark, sf_dir), byte_level()))
    return rows.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op12_lexical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.ranked(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.measured(documents(spark, sf_dir), byte_level(), Pieces.read(public_tokenizers.path("piece_bpe_32k.model")))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline  # which uses this module

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_ngram_join": op1_ngram_join,
        "op2_language": op2_language,
        "op3_toxicity": op3_toxicity,
        "op4_token_counts": op4_token_counts,
        "op5_mixing": op5_mixing,
        "op6_pii": op6_pii,
        "op7_line_quality": op7_line_quality,
        "op8_embedding_dup": op8_embedding_dup,
        "op9_byte_bpe": op9_byte_bpe,
        "op10_lm_score": op10_lm_score,
        "op11_packing": op11_packing,
        "op12_lexical": op12_lexical,
        "op13_alignment": op13_alignment,
        "pipeline": pipeline,
    }
