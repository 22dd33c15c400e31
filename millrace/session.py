"""Session defaults and the table loader."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession


def build(app: str = "millrace", cpus: int | None = None, **conf: str) -> SparkSession:
    """A local session for tests and benches; on a cluster the caller brings its own."""
    cores = cpus or min(8, os.cpu_count() or 1)
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(cores))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", os.environ.get("MILLRACE_DRIVER_MEMORY", "8g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the Parquet tables, by Spark's reader alone (any Hadoop path works)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """Rows of a table that has fewer splits than there are cores, dealt over the cores: work on text
    is worth more than one pass of a small file's rows. Any larger table is left as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)
