"""What several operators share: tables in the shared folder, Arrow batches, stable hashes."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that one Python step holds at a time.
STEP_BYTES = 8 << 20


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share, from spark.checkpoint.dir.

    A temporary folder is used only by a local session that names none, as in tests.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return f"{tempfile.gettempdir()}/slotwise-shared"


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/llm/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, compression: str | None = None) -> DataFrame:
    """The rows as a table in the shared folder: computed once, and safe from lost executors."""
    folder = new_folder(df.sparkSession, name)
    df.write.parquet(folder, compression=compression)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def crc_mod(doc_id: Column, divisor: int) -> Column:
    """crc32 of the id as text, modulo the divisor; a null id counts as an empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % divisor


def text_key(text: Column) -> Column:
    """16 bytes that stand for a text; a null text counts as an empty one."""
    return F.unhex(F.md5(F.coalesce(text, F.lit("")).cast("binary")))


def steps(batches: Iterator[pa.RecordBatch], most: int = STEP_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches cut so that each has about so many bytes at most, or one row."""
    for batch in batches:
        rows = batch.num_rows
        if not rows:
            continue
        size = max(1, int(rows * most / max(batch.nbytes, 1)))
        if size >= rows:
            yield batch
            continue
        sizes = np.zeros(rows, np.int64)
        for column in batch.columns:
            if pa.types.is_string(column.type) or pa.types.is_binary(column.type):
                sizes += np.asarray(pc.fill_null(pc.binary_length(column), 0), np.int64)
            elif pa.types.is_list(column.type):
                sizes += 8 * np.asarray(pc.fill_null(pc.list_value_length(column), 0), np.int64)
        part = np.cumsum(sizes) // most
        bounds = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), rows]
        for start, end in zip(bounds, bounds[1:], strict=False):
            yield batch.slice(start, end - start)


def given_back(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run, after which the memory that it freed goes back to the system: Spark keeps a task's Python process for later tasks."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # not every C library has it
            if trim:
                trim(0)

    return task


def map_steps(
    df: DataFrame, step: Callable[..., dict[str, Any]], schema: str, most: int = STEP_BYTES, held: Callable[[], Any] | None = None
) -> DataFrame:
    """step gives the columns of the result for some rows; it runs in Arrow batches of bounded size.

    What ``held`` makes is step's second argument; it is made once a task and dropped at the task's end.
    """
    kinds = None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = () if held is None else (held(),)
        for batch in steps(batches, most):
            columns = step(batch, *own)
            yield pa.RecordBatch.from_arrays(
                [columns[f.name] if isinstance(columns[f.name], pa.Array) else pa.array(columns[f.name], f.type) for f in kinds],
                schema=kinds,
            )

    kinds = arrow_schema(df.sparkSession, schema)
    return df.mapInArrow(given_back(run), schema)


def arrow_schema(spark: SparkSession, schema: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(schema))


class WordHashes(dict):
    """64-bit hashes of words, remembered up to a bound."""

    def __init__(self, most: int = 65_536) -> None:
        super().__init__()
        self.most = most

    def __missing__(self, word: bytes) -> int:
        code = self[word] = xxhash.xxh64_intdigest(word)
        return code

    def __call__(self, words: list[bytes]) -> np.ndarray:
        if len(self) > self.most:
            self.clear()
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def mixed(x: np.ndarray) -> np.ndarray:
    """Well spread 64-bit values (the finaliser of a splitting generator)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))
