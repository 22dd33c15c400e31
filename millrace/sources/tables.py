"""Tables: positions, heads, required columns, versions, shards, logs, snapshots, series."""

from __future__ import annotations

import json
from html import escape
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.hashing import nul_joined, sha1_mod
from ..functions.text import is_json_object


def with_position(spark: SparkSession, paths: list[str] | str, columns: list[str]) -> DataFrame:
    """The columns, with (file, row) that order rows as the files do."""
    df = spark.read.parquet(*([paths] if isinstance(paths, str) else paths))
    return df.select(*columns, F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"))


def head(df: DataFrame, n: int) -> DataFrame:
    return df.orderBy("file", "row").limit(n)


def require(df: DataFrame, columns: list[str]) -> DataFrame:
    missing = sorted(set(columns) - set(df.columns))
    if missing:
        raise ValueError(f"columns are missing: {missing}")
    return df


def present(df: DataFrame, columns: list[str]) -> DataFrame:
    """(wanted, present): whether a column is declared and every row, as it is read, has it, null or not."""
    has = lambda c: F.count(c) + F.count_if(c.isNull()) == F.count(F.lit(1))
    cells = [F.struct(F.lit(w).alias("wanted"), (has(F.col(f"`{w}`")) if w in df.columns else F.lit(False)).alias("present")) for w in columns]
    return df.agg(F.array(*cells).alias("c")).select(F.inline("c"))


def rows_of(df: DataFrame, by: str, col: str) -> DataFrame:
    """(by, n): rows by origin; the column is read, which a bare count would not do."""
    return df.groupBy(by).agg((F.count(col) + F.count_if(F.col(col).isNull())).alias("n"))


def concat(*dfs: DataFrame) -> DataFrame:
    out = dfs[0]
    for d in dfs[1:]:
        out = out.unionByName(d)
    return out


def with_shard(df: DataFrame, columns: list[str], n: int) -> DataFrame:
    return df.withColumn("shard", sha1_mod(nul_joined(*[F.col(c) for c in columns]), n))


def write_shards(df: DataFrame, columns: list[str], n: int, path: str) -> None:
    with_shard(df, columns, n).repartition("shard").write.mode("overwrite").partitionBy("shard").parquet(path)


def version_files(versions: dict[str, list[str]], version: str, exists=lambda p: Path(p).exists()) -> list[str]:
    """The files of a named version; an unknown version or a missing file is an error."""
    if version not in versions:
        raise ValueError(f"unknown version {version}; there are {sorted(versions)}")
    gone = [p for p in versions[version] if not exists(p)]
    if gone:
        raise ValueError(f"files of {version} are missing: {gone}")
    return list(versions[version])


def load_config(path: str) -> dict:
    """JSON, or YAML where a YAML library is installed."""
    text = Path(path).read_text(encoding="utf-8")
    try:
        return json.loads(text)
    except ValueError:
        import yaml

        return yaml.safe_load(text)


def log_events(spark: SparkSession, path: str, fields: str) -> DataFrame:
    """Lines that are JSON objects, with their file and the fields; other lines are passed over."""
    lines = spark.read.text(path).select("value", F.col("_metadata.file_name").alias("file"))
    parsed = lines.where(F.col("value").contains("{") & is_json_object(F.col("value")))
    return parsed.select("file", F.from_json("value", fields).alias("x")).select("file", "x.*")


def runs_union(spark: SparkSession, glob: str, schema: str, suffix: str = "-requests.jsonl") -> DataFrame:
    """Rows of many runs, each with the name of its run."""
    df = spark.read.schema(schema).json(glob)
    return df.select("*", F.regexp_replace(F.col("_metadata.file_name"), F.lit(suffix.replace(".", r"\.") + "$"), F.lit("")).alias("run"))


SNAPSHOT = "wall_time double, pods struct<items:array<struct<name:string,uid:string,ready:boolean,restarts:int>>>, endpoints struct<items:array<struct<service:string,addresses:array<struct<pod:string,ready:boolean>>>>>, hpa struct<items:array<struct<name:string,current:int,desired:int>>>"


def snapshots(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SNAPSHOT).json(path)


def pods_of(snaps: DataFrame) -> DataFrame:
    return snaps.select("wall_time", F.explode("pods.items").alias("p")).select("wall_time", "p.*")


def endpoint_ready(snaps: DataFrame, service: str) -> DataFrame:
    """Whether any ready address stands behind the service, by time."""
    some = F.exists("endpoints.items", lambda e: (e["service"] == service) & F.exists(e["addresses"], lambda a: a["ready"]))
    return snaps.select("wall_time", F.coalesce(some, F.lit(False)).alias("ready"))


MATRIX = "metric map<string,string>, `values` array<array<string>>"


def series(spark: SparkSession, path: str, label: str = "pod") -> DataFrame:
    """A matrix of samples -> (label, ts, value)."""
    m = spark.read.schema(MATRIX).json(path)
    return m.select(F.col("metric")[label].alias(label), F.explode("values").alias("v")).select(label, F.col("v")[0].cast("double").alias("ts"), F.col("v")[1].cast("double").alias("value"))


def instant(spark: SparkSession, path: str, name: str) -> DataFrame:
    """An instant vector's samples of one metric -> (labels, value); `le` as a number."""
    m = spark.read.schema("metric map<string,string>, value array<string>").json(path)
    return m.where(F.col("metric")["__name__"] == name).select("metric", F.col("metric")["le"].cast("double").alias("le"), F.col("value")[1].cast("double").alias("value"))


def runs_of(runs: DataFrame, parent: str, kind: str = "candidate") -> DataFrame:
    """All runs of a parent and kind."""
    tags = F.col("tags")
    return runs.where((tags["parent"] == parent) & (tags["kind"] == kind))


def log_metrics(df: DataFrame, run: str, step: int, path: str) -> None:
    """A callback's values, a row each, appended to the table of metrics."""
    values = F.create_map(*[x for c in df.columns for x in (F.lit(c), F.col(c).cast("double"))])
    df.select(F.lit(run).alias("run"), F.lit(step).alias("step"), F.explode(values).alias("name", "value")).write.mode("append").parquet(path)


def html(df: DataFrame, most: int = 1000) -> str:
    """A small result as an HTML table, its texts escaped; a larger one is an error."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} rows")
    line = lambda cells, tag: "<tr>" + "".join(f"<{tag}>{'' if c is None else escape(str(c))}</{tag}>" for c in cells) + "</tr>"
    return "\n".join(["<table>", line(df.columns, "th"), *[line(r, "td") for r in rows], "</table>"])


def markdown(df: DataFrame, most: int = 1000) -> str:
    """A small result as a Markdown table; a larger one is an error."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} rows")
    line = lambda cells: "| " + " | ".join("" if c is None else str(c).replace("|", "\\|") for c in cells) + " |"
    return "\n".join([line(df.columns), line(["---"] * len(df.columns)), *[line(r) for r in rows]])


def last_rows(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Of each key the last row in order: what is read later replaces what was read before."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*[F.desc(c) for c in order]))
    return df.withColumn("_r", rank).where("_r = 1").drop("_r")


def first_rows(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Of each key the first row in order."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_r", rank).where("_r = 1").drop("_r")
