"""Exact dedup by content sort.

Texts are normalised (each run of white space becomes one space), range-partitioned by sampled
splitters, sorted within their partition by external sort, and compared with their neighbours in
full; the smallest identifier of equal texts stays.

The range key is (first 24 characters, 64-bit hash, whole text): it begins with the content, its
splitters have a bounded size whatever the texts, and texts that share a long opening are still
spread by the hash. Grouping is by the whole normalised text.

Skew: copies of every text are counted first, by a 64-bit hash with partial aggregation. A text with
more than one in HEAVY_SHARE of all rows (HEAVY_LEAST rows at least) never enters the sort: its copies
are grouped by SHA-256 where they are read, a row per task and text, and get the result from the list
of such texts, which has at most HEAVY_SHARE entries of bounded size, whatever the texts.

Defined results: null text counts as empty; a null id never wins over another id; of rows that
repeat id and text one is kept; a group of null ids alone has keep_id null and keeps one row; an
empty table gives an empty result; texts are compared whole, however long; input columns pass through, and where one has the name of an
output column the operator's own replaces it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._common import pack_row, tasks, unpack_row

OUT = ("keep_id", "group_size", "kept", "text_sha256")
#: Texts with more copies than one in so many rows, and so many at least, stay out of the sort.
HEAVY_SHARE, HEAVY_LEAST = 100_000, 1000
PREFIX = 24


def normalised(col: Column) -> Column:
    """One space for each run of white space. A lone space needs no replacing, so the pattern skips it."""
    return F.regexp_replace(F.coalesce(col, F.lit("")), r"[\x09-\x0D][\x20\x09-\x0D]*|\x20[\x20\x09-\x0D]+", " ")


def heavy_hashes(rows: DataFrame) -> list[int]:
    """Hashes of the texts with very many copies: at most HEAVY_SHARE."""
    counts = rows.groupBy(F.xxhash64("_norm").alias("h")).agg(F.count(F.lit(1)).alias("n"))
    return [r["h"] for r in counts.where(F.col("n") >= max(HEAVY_LEAST, rows.count() // HEAVY_SHARE)).select("h").collect()]


def one_of(rows: DataFrame) -> DataFrame:
    """Adds kept: true for one row of each text_sha256. First one of each task's rows, then one of these,
    so that no task ranks all rows that repeat an id and a text."""
    rows = rows.withColumn("_task", F.spark_partition_id())
    rows = rows.withColumn("_rank", F.row_number().over(Window.partitionBy("text_sha256", "_task").orderBy(F.lit(1))))
    among = Window.partitionBy("text_sha256", F.when(F.col("_rank") == 1, -1).otherwise(F.col("_task")))
    return rows.withColumn("kept", (F.row_number().over(among.orderBy("_task", "_rank")) == 1) & (F.col("_rank") == 1)).drop("_task", "_rank")


def exact_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Input columns plus keep_id, group_size, kept, text_sha256; one row per input row."""
    spark, names = df.sparkSession, df.columns
    heavy = heavy_hashes(df.select(normalised(F.col(text_col)).alias("_norm")))
    rows = pack_row(df, _id=F.col(id_col), _norm=normalised(F.col(text_col)))
    own = F.xxhash64("_norm").isin(heavy) if heavy else F.lit(False)

    keyed = rows.where(~own).withColumn("text_sha256", F.sha2(F.col("_norm").cast("binary"), 256)).withColumn("_head", F.substring("_norm", 1, PREFIX)).withColumn("_hash", F.xxhash64("_norm"))
    sorted_rows = keyed.repartitionByRange(max(tasks(spark), 1), "_head", "_hash")
    equal = Window.partitionBy("_head", "_hash", "_norm")
    ranked = sorted_rows.withColumn("_rank", F.row_number().over(equal.orderBy(F.col("_id").asc_nulls_last())))
    light = (
        ranked.withColumn("keep_id", F.min("_id").over(equal))
        .withColumn("group_size", F.count(F.lit(1)).over(equal))
        .withColumn("kept", F.col("_rank") == 1)
    )
    out = unpack_row(light, names, *OUT)
    if not heavy:
        return out

    mine = rows.where(own).withColumn("text_sha256", F.sha2(F.col("_norm").cast("binary"), 256)).drop("_norm")
    groups = mine.groupBy("text_sha256").agg(F.min("_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    hit = mine.join(F.broadcast(groups), "text_sha256")
    wins = F.col("_id").eqNullSafe(F.col("keep_id"))
    return out.unionByName(unpack_row(one_of(hit.where(wins)).unionByName(hit.where(~wins).withColumn("kept", F.lit(False))), names, *OUT))
