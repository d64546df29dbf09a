"""Token counts kept by source, language and tokenizer version, from signed changes.

A rollup is a folder of batches. A batch of changes holds inserts (a document with its tokens), deletes (with the tokens it had)
and revisions (with the tokens it had and has, as after a fix or a new tokenizer version); each change names its key. Changes become
signed sums for each key, and a batch is committed by writing its few sums as one folder named by the batch id. A repeated
commit of a batch replaces the folder by the same sums, so it changes nothing, and a commit that fails leaves no sums behind.
Totals add up all batches; nothing is ever read again from documents. ``compacted`` folds batches into one, with their ids, and
later commits of these ids are ignored.

Sums are made of partial sums, so a hot source costs nothing more. Keys may be null and are groups of their own. A null count
adds 0 tokens; a null text has 0. An unknown or null kind of change is refused, since it could not be undone. Keys whose documents and
tokens are back to 0 are left out of the totals. No changes: an empty batch. Repeated rows of a batch are changes each; a feed
that repeats itself does so as the same batch.
"""

from __future__ import annotations

from urllib.parse import quote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

KEYS = ("source", "lang", "tokenizer")
CHANGES = "op string, source string, lang string, tokenizer string, n_tokens long, old_tokens long"
DELTAS = "source string, lang string, tokenizer string, n_documents long, n_tokens decimal(38,0), covers array<string>"

#: Tokenizers by version: runs of anything but ASCII white space; runs of letters, of digits, or of other signs.
TOKENIZERS: dict[str, str] = {
    "words-1": r"[^\x20\x09-\x0D]+",
    "pieces-1": r"\p{L}+|\p{N}+|[^\p{L}\p{N}\x20\x09-\x0D]+",
}


def count_tokens(text: Column, tokenizer: str) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(TOKENIZERS[tokenizer])), F.lit(0)).cast("long")


def deltas(changes: DataFrame) -> DataFrame:
    """Signed sums for each key. Columns of the changes: op ('insert', 'delete' or 'revise'), the keys, n_tokens, old_tokens."""
    refused = F.raise_error(F.concat(F.lit("unknown kind of change: "), F.coalesce("op", F.lit("null"))))
    sign = F.when(F.col("op") == "insert", 1).when(F.col("op") == "delete", -1).when(F.col("op") == "revise", 0).otherwise(refused.cast("int"))
    new, old = F.coalesce("n_tokens", F.lit(0)), F.coalesce("old_tokens", F.lit(0))
    tokens = F.when(F.col("op") == "insert", new).when(F.col("op") == "delete", -old).otherwise(new - old)
    return changes.groupBy(*KEYS).agg(
        F.sum(sign).cast("long").alias("n_documents"), F.sum(tokens.cast("decimal(38,0)")).cast("decimal(38,0)").alias("n_tokens")
    )


class Rollup:
    """Totals in a folder that all executors share."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder.rstrip("/")

    def _batches(self) -> DataFrame:
        try:
            return self.spark.read.schema(DELTAS).option("recursiveFileLookup", "true").parquet(f"{self.folder}/batches")
        except Exception as error:
            if getattr(error, "getCondition", lambda: "")() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], DELTAS)

    def covered(self) -> DataFrame:
        """batch_id: the batches that are folded into another."""
        return self._batches().select(F.explode("covers").alias("batch_id")).distinct()

    def commit(self, batch_id: str, changes: DataFrame) -> None:
        """Add a batch. Committing it again changes nothing.

        A batch is one file, which appears by the rename that ends its write. A folder that holds it is never written again,
        so a later attempt that fails cannot harm it; what an earlier attempt left without that file is replaced.
        """
        folder = f"{self.folder}/batches/{quote(batch_id, safe='')}"
        if self._written(folder) or self.covered().filter(F.col("batch_id") == batch_id).head(1):
            return
        sums = deltas(changes).withColumn("covers", F.lit(None).cast("array<string>"))
        sums.coalesce(1).write.mode("overwrite").parquet(folder)

    def _written(self, folder: str) -> bool:
        try:
            return bool(self.spark.read.schema(DELTAS).parquet(folder).inputFiles())
        except Exception as error:
            if getattr(error, "getCondition", lambda: "")() != "PATH_NOT_FOUND":
                raise
            return False

    def totals(self) -> DataFrame:
        """source, lang, tokenizer, n_documents, n_tokens."""
        return (
            self._batches()
            .filter("n_tokens IS NOT NULL")
            .groupBy(*KEYS)
            .agg(F.sum("n_documents").cast("long").alias("n_documents"), F.sum("n_tokens").cast("decimal(38,0)").alias("n_tokens"))
            .filter("n_documents <> 0 OR n_tokens <> 0")
        )

    def compacted(self, folder: str, batch_ids: list[str]) -> Rollup:
        """A rollup in a new folder with all sums of this one in a single batch that stands for the named batches."""
        marks = [r["batch_id"] for r in self.covered().collect()] + list(batch_ids)
        sums = self.totals().withColumn("covers", F.lit(None).cast("array<string>"))
        named = self.spark.createDataFrame([(sorted(set(marks)),)], "covers array<string>").select(
            *(F.lit(None).cast("string").alias(k) for k in KEYS),
            F.lit(None).cast("long").alias("n_documents"), F.lit(None).cast("decimal(38,0)").alias("n_tokens"), "covers",
        )
        sums.union(named).coalesce(1).write.mode("overwrite").parquet(f"{folder.rstrip('/')}/batches/compacted")
        return Rollup(self.spark, folder)


def changes(counted: DataFrame, op: str, tokenizer: str, new: Column, old: Column) -> DataFrame:
    """Changes of one kind for documents with their counts."""
    return counted.select(F.lit(op).alias("op"), "source", "lang", F.lit(tokenizer).alias("tokenizer"), new.alias("n_tokens"), old.alias("old_tokens"))
