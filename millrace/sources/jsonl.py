"""JSON lines: strict with line numbers, lenient, with unique ids; the sinks."""

from __future__ import annotations

import json
import os
import tempfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

CHAT = T.StructType([
    T.StructField("id", T.StringType()), T.StructField("topic", T.StringType()),
    T.StructField("messages", T.ArrayType(T.StructType([T.StructField("role", T.StringType()), T.StructField("content", T.StringType())]))),
])
ROLES = ("system", "user", "assistant")


class BadLine(ValueError):
    """A line that breaks its contract; names file and line."""


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(path, line, value), lines from 1 in each file. Files are read in splits; a line's number is
    the lines in earlier splits of its file plus its place in its own, so no split is read by one
    task with others only to count."""
    meta = F.col("_metadata")
    rows = spark.read.text(path).select(meta["file_path"].alias("path"), meta["file_block_start"].alias("_at"), "value", F.monotonically_increasing_id().alias("_id"))
    blocks = rows.groupBy("path", "_at").agg(F.count(F.lit(1)).alias("_n"), F.min("_id").alias("_first"))
    before = Window.partitionBy("path").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    starts = blocks.withColumn("_start", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    joined = rows.join(starts, ["path", "_at"])
    return joined.select("path", (F.col("_start") + F.col("_id") - F.col("_first") + 1).cast("int").alias("line"), "value")


def chat_fault(line: str) -> str | None:
    """What is wrong with one strict chat line, or None."""
    if not line.strip():
        return "blank line"
    try:
        x = json.loads(line)
    except ValueError as e:
        return f"bad JSON: {e}"
    if not isinstance(x, dict):
        return "not an object"
    if set(x) != {"id", "topic", "messages"}:
        return "fields are not id, topic, messages"
    if not isinstance(x["id"], str) or not x["id"].strip() or not isinstance(x["topic"], str):
        return "id or topic"
    m = x["messages"]
    if not isinstance(m, list) or any(not isinstance(y, dict) or set(y) != {"role", "content"} for y in m):
        return "messages"
    if tuple(y["role"] for y in m) != ROLES:
        return "roles are not system, user, assistant"
    if any(not isinstance(y["content"], str) or not y["content"].strip() for y in m):
        return "blank content"
    return None


def _faults(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        pdf["fault"] = [chat_fault(v) for v in pdf["value"]]
        yield pdf


def strict_chat(spark: SparkSession, path: str) -> DataFrame:
    """Chat examples; the first bad line of the first bad file raises BadLine('path:line: why')."""
    lines = numbered_lines(spark, path)
    told = lines.mapInPandas(_faults, "path string, line int, value string, fault string")
    bad = told.where(F.col("fault").isNotNull()).orderBy("path", "line").first()
    if bad:
        raise BadLine(f"{bad['path']}:{bad['line']}: {bad['fault']}")
    return lines.select(F.from_json("value", CHAT).alias("x"), "line").select("x.*", "line")


def lenient(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """Blank lines are skipped, bad ones make nulls."""
    return spark.read.schema(schema).json(path)


def unique_ids(df: DataFrame, id_col: str = "id") -> DataFrame:
    """The rows, if there are any and every id is a non-empty string that occurs once."""
    ids = df.select(F.col(id_col).alias("i"))
    n, blank = ids.agg(F.count(F.lit(1)), F.count_if(F.coalesce(F.col("i"), F.lit("")) == "")).first()
    if not n or blank or ids.groupBy("i").count().where("count > 1").head(1):
        raise ValueError("rows with unique, non-empty string ids are needed")
    return df


def write_jsonl(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).json(path)


def append_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def write_splits(df: DataFrame, path: str, split_col: str = "split") -> None:
    df.write.mode("overwrite").partitionBy(split_col).json(path)


def read_document(path: str) -> dict:
    def no(x):
        raise ValueError(f"{x} is not allowed")

    with open(path, encoding="utf-8") as f:
        return json.load(f, parse_constant=no)


def write_document(path: str, value: dict) -> None:
    """One JSON document, without NaN, put in place atomically: temporary file, sync, rename, sync."""
    data = json.dumps(value, ensure_ascii=False, indent=2, allow_nan=False).encode() + b"\n"
    write_atomic(path, data)


def write_atomic(path: str, data: bytes) -> None:
    folder = os.path.dirname(os.path.abspath(path))
    fd, tmp = tempfile.mkstemp(dir=folder)
    try:
        with os.fdopen(fd, "wb") as f:
            f.write(data)
            f.flush()
            os.fsync(f.fileno())
        os.replace(tmp, path)
    except BaseException:
        if os.path.exists(tmp):
            os.unlink(tmp)
        raise
    handle = os.open(folder, os.O_RDONLY)
    try:
        os.fsync(handle)
    finally:
        os.close(handle)
