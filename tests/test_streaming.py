"""Streams over small files equal the batch; alerts keep state; the sink writes each key once."""

import pytest
from pyspark.sql import functions as F

from millrace.operators import telemetry
from millrace.streaming import flows, snapshots, windows


def test_window_counts_equal_batch(spark, sf, tmp_path):
    events = spark.read.parquet(f"{sf}/events.parquet")
    events.repartition(3).write.parquet(str(tmp_path / "in"))
    s = windows.event_stream(spark, str(tmp_path / "in"), events.schema, late="40 days")
    out = windows.drain(windows.window_counts(s, "ts", "1 day", ["event_type"]), "t_counts", "update", str(tmp_path / "cp"))
    got = {(r[0], r[1]): r[2] for r in out.groupBy("start", "event_type").agg(F.max("n")).collect()}
    want = {(r[0], r[1]): r[2] for r in windows.window_counts(events.withColumn("ts", F.col("ts").cast("timestamp")), "ts", "1 day", ["event_type"]).select("start", "event_type", "n").collect()}
    assert got == want


def test_alerts_keep_state_between_batches(spark, tmp_path):
    schema = "name string, tick double, active boolean"
    ticks = [(0, True), (10, True), (20, True), (30, False), (40, True)]
    for i, part in enumerate((ticks[:2], ticks[2:])):
        spark.createDataFrame([("a", float(t), x) for t, x in part], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    got = {r["tick"]: r["state"] for r in windows.drain(windows.alert_states(stream, 20), "t_alerts", "append", str(tmp_path / "cp")).collect()}
    batch = spark.createDataFrame(ticks, "tick long, active boolean")
    assert got == {float(r[0]): r[1] for r in telemetry.alert_islands(batch, 10, 20).collect()}


def test_once_per_batch(spark, tmp_path):
    df = spark.createDataFrame([("a", 1), ("b", 2), ("a", 3)], "k string, v int")
    once = windows.once_per_batch(str(tmp_path / "by"))
    for batch in (0, 0, 1, 1, 0):
        once(df.where(F.col("v") % 2 == batch), batch)
    assert sorted(r["v"] for r in spark.read.parquet(str(tmp_path / "by")).collect()) == [1, 2, 3]


def test_polled_answers_outlive_a_stop(spark, tmp_path):
    """An answer that was journaled before a stop and not yet processed comes with the next run."""
    (tmp_path / "answers").mkdir()
    (tmp_path / "answers" / "a.txt").write_text("\n".join(f"line {i}" for i in range(5)))
    options = {"file": f"file://{tmp_path}/answers", "lines": "2"}
    journal = snapshots.Journal(f"file://{tmp_path}/journal")
    assert snapshots.next_lines(options, 2) == ["line 4"] and snapshots.next_lines(options, 3) == []
    stream = snapshots.polled(spark, journal=f"file://{tmp_path}/journal", poll="millrace.streaming.snapshots:next_lines", **options)
    run = lambda: windows.finish(stream, windows.once_per_batch(str(tmp_path / "out")), str(tmp_path / "state"))
    run()
    journal.append(1, snapshots.next_lines(options, 1))  # polled, then stopped
    run()
    run()
    got = spark.read.parquet(str(tmp_path / "out")).collect()
    assert sorted(r["body"] for r in got) == [f"line {i}" for i in range(5)]
    assert snapshots.run_command({"command": '["echo", "hello"]'}, 0) == ["hello\n"]


def test_alert_condition(spark):
    df = spark.createDataFrame([(19, 9.0), (20, 9.0), (20, 0.5), (None, 9.0)], "n int, v double")
    assert [r[0] for r in df.select(flows.condition(F.col("n"), F.col("v"), 0.5)).collect()] == [False, True, False, False]


@pytest.mark.parametrize("by", [[], ["event_type"]])
def test_rates(spark, sf, by):
    e = spark.read.parquet(f"{sf}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    r = windows.rates(e, "ts", 3600, 1800, by)
    assert r.agg(F.sum("n")).first()[0] == 2 * e.count()
