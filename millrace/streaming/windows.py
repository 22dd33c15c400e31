"""Structured Streaming: windowed counts, rates, histogram quantiles, gauges, alerts, exactly-once sink."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def event_stream(spark: SparkSession, path: str, schema, ts: str = "ts", late: str = "1 minute", per_trigger: int = 1) -> DataFrame:
    """A file source with event time as TIMESTAMP (NTZ has no watermark) and the lateness allowed."""
    raw = spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).parquet(path)
    return raw.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late)


def window_counts(df: DataFrame, ts: str, width: str, by: list[str], step: str | None = None) -> DataFrame:
    w = F.window(ts, width, step) if step else F.window(ts, width)
    return df.groupBy(w.alias("w"), *by).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *by, "n")


def rates(df: DataFrame, ts: str, width_s: int, step_s: int, by: list[str]) -> DataFrame:
    out = window_counts(df, ts, f"{width_s} seconds", by, f"{step_s} seconds")
    return out.withColumn("rate", F.col("n") / width_s)


def rejected_share(df: DataFrame, ts: str, width: str, step: str, outcome: str = "outcome") -> DataFrame:
    g = df.groupBy(F.window(ts, width, step).alias("w")).agg(F.avg((F.col(outcome) == "rejected").cast("int")).alias("share"), F.count(F.lit(1)).alias("n"))
    return g.select(F.col("w.end").alias("tick"), "share", "n")


def bucket_counts(df: DataFrame, ts: str, value: str, width: str, step: str, bounds: list[float]) -> DataFrame:
    """Per window and bound the values at or below it, for a histogram quantile."""
    les = [*bounds, float("inf")]
    g = df.groupBy(F.window(ts, width, step).alias("w")).agg(*[F.count_if(F.col(value) <= b).alias(f"_{i}") for i, b in enumerate(les)])
    pairs = F.array(*[F.struct(F.lit(float(b)).alias("le"), F.col(f"_{i}").alias("cum")) for i, b in enumerate(les)])
    return g.select(F.col("w.end").alias("tick"), F.explode(pairs).alias("p")).select("tick", "p.le", "p.cum")


def gauges(df: DataFrame, ts: str, width: str, by: list[str], value: str) -> DataFrame:
    """The last value of each window; of values at one time the greatest."""
    return df.groupBy(F.window(ts, width).alias("w"), *by).agg(F.max_by(value, F.struct(ts, value)).alias("value")).select(F.col("w.end").alias("tick"), *by, "value")


def alert_states(ticks: DataFrame, hold: float) -> DataFrame:
    """(name, tick seconds, active) -> state of each tick, kept over batches: pending since when."""

    def step(key: tuple, pdfs: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        since = state.get[0] if state.exists else None
        rows = []
        for pdf in pdfs:
            rows += list(pdf[["tick", "active"]].itertuples(index=False, name=None))
        out = []
        for tick, active in sorted(rows):
            since = (tick if since is None or since < 0 else since) if active else None
            out.append((key[0], tick, "inactive" if since is None else "firing" if tick - since >= hold else "pending"))
        state.update((since if since is not None else -1.0,))
        yield pd.DataFrame(out, columns=["name", "tick", "state"])

    return ticks.groupBy("name").applyInPandasWithState(step, "name string, tick double, state string", "since double", "append", "NoTimeout")


def once_per_batch(target: str) -> Callable[[DataFrame, int], None]:
    """foreachBatch: a batch is a folder of its own, named by its number, so that writing it again replaces
    it and nothing already written is read."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{target}/batch_id={batch_id}")

    return write


def finish(df: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append") -> None:
    """Runs a stream over what is there now."""
    df.writeStream.foreachBatch(write).outputMode(mode).trigger(availableNow=True).option("checkpointLocation", checkpoint).start().awaitTermination()


def settle(df: DataFrame, folder: str, keys: list[str], mode: str = "update") -> DataFrame:
    """Runs a stream over what is there now into a shared folder; of each key the row of its last batch."""
    spark, columns = df.sparkSession, df.columns
    empty = spark.createDataFrame([], df.schema)
    empty.write.mode("overwrite").parquet(f"{folder}/out/batch_id=-1")
    finish(df, once_per_batch(f"{folder}/out"), f"{folder}/state", mode)
    rows = spark.read.schema(df.schema).option("basePath", f"{folder}/out").parquet(f"{folder}/out/*")
    batch = F.regexp_extract(F.col("_metadata.file_path"), r"batch_id=(-?\d+)", 1).cast("long")
    last = rows.select(F.struct(*columns).alias("row"), batch.alias("batch")).groupBy(*[F.col(f"row.{k}").alias(k) for k in keys])
    return last.agg(F.max_by("row", "batch").alias("row")).select("row.*")


def request_sessions(events: DataFrame, deadline: float, ts: str = "ts") -> DataFrame:
    """(request_id, t seconds, kind, event time) -> one row a request: its chunks and its outcome. A request
    is completed by its end mark and expired by a timer `deadline` seconds after its first event; what
    arrives later than that counts no more. Keeps one small state a request until the timer."""

    def step(key: tuple, pdfs: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            _, chunks, done = state.get
            state.remove()
            yield pd.DataFrame({"request_id": [key[0]], "chunks": [chunks], "outcome": ["completed" if done else "expired"]})
            return
        sent, chunks, done = state.get if state.exists else (float("inf"), 0, False)
        whole = pd.concat(list(pdfs), ignore_index=True)
        sent = min(sent, float(whole["t"].min()))
        inside = whole["t"] < sent + deadline
        chunks += int((inside & (whole["kind"] == "chunk")).sum())
        done = bool(done or (inside & (whole["kind"] == "done")).any())
        state.update((sent, chunks, done))
        state.setTimeoutTimestamp(max(int((sent + deadline) * 1000), state.getCurrentWatermarkMs() + 1))

    return events.groupBy("request_id").applyInPandasWithState(step, "request_id string, chunks long, outcome string", "sent double, chunks long, done boolean", "append", "EventTimeTimeout")


def drain(df: DataFrame, name: str, mode: str = "update", checkpoint: str | None = None) -> DataFrame:
    """Runs a stream over what is there now and returns the memory sink; for tests and small results."""
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True)
    q = q.option("checkpointLocation", checkpoint) if checkpoint else q
    run = q.start()
    run.awaitTermination()
    return df.sparkSession.table(name)
