"""Streams with state beyond windows of fixed width: sessions, interval joins, late rows, alerts with timers."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Groups over which rows are dealt where an operator wants a key and the rows have none.
SPREAD = 256


def session_counts(df: DataFrame, ts: str, gap: str, by: list[str], **more: Column) -> DataFrame:
    """A row a session of each key: rows that follow one another within the gap. A row that comes late, but
    not behind the watermark, may join two open sessions; a session is given out once the watermark passes
    its end. State: one row an open session."""
    g = df.groupBy(F.session_window(ts, gap).alias("w"), *by).agg(F.count(F.lit(1)).alias("n"), *[c.alias(k) for k, c in more.items()])
    return g.select(*by, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n", *more)


def joined_within(left: DataFrame, right: DataFrame, key: str, left_ts: str, right_ts: str, within: str, how: str = "left_outer") -> DataFrame:
    """Rows of two streams with one key, the right one from the left one's time to `within` after it. Both
    need a watermark: from them and the interval Spark knows when a left row can meet no more, gives it out
    with nulls and forgets it. The right key is named `_key`."""
    r = right.withColumnRenamed(key, "_key")
    on = (F.col(key) == F.col("_key")) & (F.col(right_ts) >= F.col(left_ts)) & (F.col(right_ts) <= F.col(left_ts) + F.expr(f"INTERVAL {within}"))
    return left.join(r, on, how)


def late_marked(df: DataFrame, ts: str) -> DataFrame:
    """All rows with late: whether the row's time lies behind the watermark that its batch began with, so
    that rows which windows would drop in silence can be counted and kept aside. Holds no state."""
    names = df.columns
    schema = T.StructType([*df.schema.fields, T.StructField("late", T.BooleanType())])

    def mark(key: tuple, pdfs: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        behind = state.getCurrentWatermarkMs()
        for pdf in pdfs:
            yield pdf[names].assign(late=pdf["_ms"] < behind)

    rows = df.withColumn("_ms", F.unix_millis(ts)).withColumn("_part", F.pmod(F.xxhash64(*names), F.lit(SPREAD)))
    return rows.groupBy("_part").applyInPandasWithState(mark, schema, "none int", "append", "NoTimeout")


def condition(n: Column, value: Column, limit: float, least: int = 20) -> Column:
    """Whether an alert's condition holds: a value above the limit, over enough samples."""
    return F.coalesce((n >= least) & (value > limit), F.lit(False))


class AlertTimers(StatefulProcessor):
    """The states of one alert: since when its condition holds, its last tick, and a timer for the next."""

    def __init__(self, step: float, hold: float):
        self.step, self.hold = step, hold

    def init(self, handle) -> None:
        self.handle = handle
        self.seen = handle.getValueState("seen", "since double, last double")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        since, last = self.seen.get() if self.seen.exists() else (None, None)
        ticks, out = [], []
        for pdf in rows:
            ticks += list(zip(pdf["tick"].tolist(), pdf["active"].tolist()))
        for tick, active in sorted(ticks):
            if since is not None and tick - last > self.step:
                out.append((key[0], last + self.step, "resolved"))
                since = None
            since = (tick if since is None else since) if active else None
            out.append((key[0], tick, "inactive" if since is None else "firing" if tick - since >= self.hold else "pending"))
            last = tick
        for at in list(self.handle.listTimers()):
            self.handle.deleteTimer(at)
        if since is not None:
            self.handle.registerTimer(int((last + self.step) * 1000))
        self.seen.update((since, last))
        yield pd.DataFrame(out, columns=["name", "tick", "state"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        since, last = self.seen.get()
        if since is not None:
            self.seen.update((None, last))
            yield pd.DataFrame([(key[0], last + self.step, "resolved")], columns=["name", "tick", "state"])

    def close(self) -> None:
        pass


def alerts(ticks: DataFrame, step: float, hold: float) -> DataFrame:
    """(name, tick seconds, active, and a time column with a watermark) -> (name, tick, state). As the batch
    `alert_islands`, and a row `resolved` a step after the last tick of an alert whose ticks stop: a timer in
    event time tells that none came. Needs the RocksDB state store (`ROCKS`) and ticks in order but for the
    watermark's delay."""
    return ticks.groupBy("name").transformWithStateInPandas(AlertTimers(step, hold), "name string, tick double, state string", "append", "eventTime")
