"""Model anatomy tables: parameter groups, tied tensors, adapters, peaks, norms, benchmarks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def tied(df: DataFrame, pointer: str = "ptr", order: str = "pos") -> DataFrame:
    """A tensor whose storage stood earlier in order is tied."""
    return df.withColumn("tied", F.row_number().over(Window.partitionBy(pointer).orderBy(order)) > 1)


def group_table(df: DataFrame, kind: Column) -> DataFrame:
    """name, shape, numel, tied, pos -> per group: tensors, shapes, own and tied parameters, share of all own."""
    shapes = F.transform(F.sort_array(F.collect_set(F.struct("first", "shape"))), lambda x: x["shape"])
    d = df.withColumn("group", kind).withColumn("shape", F.array_join(F.col("shape").cast("array<string>"), "x"))
    d = d.withColumn("first", F.min("pos").over(Window.partitionBy("group", "shape")))
    own = F.sum(F.when(~F.col("tied"), F.col("numel")).otherwise(0))
    g = d.groupBy("group").agg(F.count(F.lit(1)).alias("tensors"), shapes.alias("shapes"), own.alias("own"), F.sum(F.when(F.col("tied"), F.col("numel")).otherwise(0)).alias("tied"))
    return g.withColumn("share", F.col("own") / F.sum("own").over(Window.partitionBy()))  # one row per group


def adapter_parameters(layers: DataFrame, targets: list[str], rank: int) -> DataFrame:
    """name, n_in, n_out -> parameters of low-rank adapters on the targeted leaf modules."""
    return layers.where(F.substring_index("name", ".", -1).isin(targets)).agg(F.coalesce(F.sum(rank * (F.col("n_in") + F.col("n_out"))), F.lit(0)).alias("parameters"))


def worst_peaks(runs: DataFrame) -> DataFrame:
    """mode, peak -> the greatest peak of each mode and all of them."""
    return runs.groupBy("mode").agg(F.max("peak").alias("peak"), F.sort_array(F.collect_list("peak")).alias("peaks"))


def benchmark(df: DataFrame) -> DataFrame:
    """concurrency, ok, seconds, tokens, t0, t1 -> counts, throughput, latency (null if none succeeded), tokens."""
    ok = F.when(F.col("ok"), F.col("seconds"))
    span = F.max("t1") - F.min("t0")
    return df.groupBy("concurrency").agg(
        F.count(F.lit(1)).alias("n"), F.count_if("ok").alias("succeeded"), F.count_if(~F.col("ok")).alias("failed"), (F.count_if("ok") / span).alias("per_second"),
        F.avg(ok).alias("mean_seconds"), F.max(ok).alias("max_seconds"), F.sum(F.when(F.col("ok"), F.col("tokens")).otherwise(0)).alias("tokens"),
    )
