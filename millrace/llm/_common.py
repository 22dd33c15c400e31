"""What the operators of this subpackage share: scratch tables, batches, row packing."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..scratch import Scratch, shared_dir  # noqa: F401  the operators take them from here

#: Runs of these bytes separate words; the complement makes words.
SPACE_BYTES = b"\x20\x09\x0a\x0b\x0c\x0d"
SPANS = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))
WORDS = r"[^\x20\x09-\x0D]+"


#: Bytes of rows that cross to Python together, about: one long text may be more.
BATCH_BYTES = 8 << 20


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Whole texts cross to Python in batches of so many rows and about BATCH_BYTES: a bound on a worker's memory."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def release() -> None:
    """Hands a worker's freed memory back: workers outlive their tasks and share the executor's limit."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        pass


def _tidied(f: Callable) -> Callable:
    def run(batches: Iterator) -> Iterator:
        try:
            yield from f(batches)
        finally:
            release()

    return run


def map_pandas(df: DataFrame, f: Callable, schema) -> DataFrame:
    return df.mapInPandas(_tidied(f), schema)


def map_arrow(df: DataFrame, f: Callable, schema) -> DataFrame:
    return df.mapInArrow(_tidied(f), schema)


def tasks(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def pack_row(df: DataFrame, **new: Column) -> DataFrame:
    """All input columns as one struct `_in`, beside new working columns: no name can clash."""
    return df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("_in"), *[c.alias(k) for k, c in new.items()])


def unpack_row(df: DataFrame, names: list[str], *out: str) -> DataFrame:
    """Input columns again, then the operator's own; of two with one name the operator's stays."""
    return df.select(*[F.col("_in")[c].alias(c) for c in names if c not in out], *out)


def crc_of(col: str) -> Column:
    """CRC-32 of a column's decimal text; null counts as the empty text."""
    return F.crc32(F.coalesce(F.col(col).cast("string"), F.lit("")))


#: A key with more than one in so many rows is hot; there are at most so many hot keys, whatever the table.
HOT_SHARE, HOT_LEAST = 10_000, 1000


def hot_bound(rows: int) -> int:
    """Rows of a key from which it is hot."""
    return max(HOT_LEAST, rows // HOT_SHARE)


def join_by_key(many: DataFrame, one: DataFrame, hot: DataFrame, keys: list[str]) -> DataFrame:
    """Inner join of `many` with `one`, which has a row a key. Keys in `hot`, rows of `one` of which there
    are at most HOT_SHARE by `hot_bound`, are broadcast, so that no task gathers a hot key's rows."""
    rest = many.join(F.broadcast(hot.select(*keys)), keys, "left_anti").join(one, keys)
    return rest.unionByName(many.join(F.broadcast(hot), keys))
