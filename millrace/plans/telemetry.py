"""Queries of serving telemetry over the events table: outcomes, latency, windows, alerts, replays, streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import stats
from ..operators import anatomy, telemetry
from ..scratch import Scratch
from ..streaming import flows, snapshots, windows
from . import relational  # noqa: F401  its SQL is used here
from .registry import SQL, Tables, query

BOUNDS = [1.0, 5.0, 10.0, 20.0, 50.0, 100.0, 200.0]
#: How an event's fields stand for a request: status by type, done by its value.
STATUS_SQL = "CASE event_type WHEN 'error' THEN 0 WHEN 'signup' THEN 429 ELSE 200 END"
OUT_SQL = f"CASE WHEN value > 150 THEN 'expired' WHEN {STATUS_SQL} IN (429, 503) THEN 'rejected' WHEN {STATUS_SQL} = 200 AND event_id % 7 <> 0 THEN 'completed' WHEN {STATUS_SQL} = 200 THEN 'aborted' ELSE 'error' END"


def requests(t: Tables) -> DataFrame:
    status = F.when(F.col("event_type") == "error", 0).when(F.col("event_type") == "signup", 429).otherwise(200)
    e = t.events
    d = e.select("event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), "user_id", "event_type", "value", status.alias("status"))
    d = d.withColumn("t", F.col("us") / 1e6).withColumn("phase", F.concat(F.lit("p"), F.col("user_id") % 5))
    return d.withColumn("outcome", telemetry.outcome(F.col("status"), F.col("event_id") % 7 != 0, F.col("value") > 150))


REQ = f"SELECT event_id, epoch_us(ts) AS us, epoch_us(ts) / 1e6 AS t, user_id, event_type, value, 'p' || (user_id % 5) AS phase, {OUT_SQL} AS outcome FROM events"
FIVE = ", ".join(f"count(*) FILTER (WHERE outcome = '{o}') AS {o}" for o in telemetry.OUTCOMES)


@query(f"WITH r AS ({REQ}) SELECT phase, {FIVE}, count(*) AS total, round(avg((outcome <> 'completed')::INT), 6) AS error_fraction FROM r GROUP BY phase")
def outcome_accounting(t: Tables) -> DataFrame:
    return telemetry.outcome_counts(requests(t), ["phase"]).withColumn("error_fraction", F.round("error_fraction", 6))


@query(f"WITH r AS ({REQ}) SELECT phase, round(quantile_cont(value, 0.5) FILTER (WHERE outcome = 'completed'), 6) AS p50, round(quantile_cont(value, 0.95) FILTER (WHERE outcome = 'completed'), 6) AS p95 FROM r GROUP BY phase")
def latency_p50_p95(t: Tables) -> DataFrame:
    d = telemetry.latency(requests(t), ["phase"], "value")
    return d.select("phase", F.round("p50", 6).alias("p50"), F.round("p95", 6).alias("p95"))


LES = f"[{', '.join(map(str, BOUNDS))}]::DOUBLE[]"
CUM = f"SELECT phase, le, count(*) FILTER (WHERE value <= le) AS cum FROM r, (SELECT unnest(list_append({LES}, 'inf'::DOUBLE)) AS le) GROUP BY ALL"


@query(f"WITH r AS ({REQ}) {CUM}")
def histogram_buckets(t: Tables) -> DataFrame:
    return stats.cumulative(requests(t), "value", BOUNDS, ["phase"])


@query(f"""
WITH r AS ({REQ}), c AS ({CUM}), w AS (SELECT *, lag(cum, 1, 0) OVER p AS before, lag(le, 1, 0) OVER p AS lower, max(cum) OVER (PARTITION BY phase) AS total FROM c WINDOW p AS (PARTITION BY phase ORDER BY le))
SELECT phase, round(CASE WHEN isinf(le) THEN lower ELSE lower + (le - lower) * (0.95 * total - before) / (cum - before) END, 6) AS quantile FROM w WHERE cum >= 0.95 * total QUALIFY row_number() OVER (PARTITION BY phase ORDER BY le) = 1""")
def histogram_quantile(t: Tables) -> DataFrame:
    q = stats.histogram_quantile(stats.cumulative(requests(t), "value", BOUNDS, ["phase"]), 0.95, ["phase"])
    return q.select("phase", F.round("quantile", 6).alias("quantile"))


@query(f"WITH r AS ({REQ}), g AS (SELECT phase, us - lag(us) OVER (PARTITION BY user_id ORDER BY us, event_id) AS gap FROM r) SELECT phase, count(gap) AS gaps, max(gap)::BIGINT AS longest, min(gap)::BIGINT AS shortest FROM g GROUP BY phase")
def inter_event_gap(t: Tables) -> DataFrame:
    g = telemetry.gaps_of(requests(t).select(F.col("user_id").alias("request_id"), F.col("us").alias("t"), "phase"))
    return g.groupBy("phase").agg(F.count("gap").alias("gaps"), F.max("gap").alias("longest"), F.min("gap").alias("shortest"))


@query(f"WITH r AS ({REQ}), c AS (SELECT phase, outcome, value FROM r WHERE outcome = 'completed') SELECT phase, round(quantile_cont(value, 0.95), 6) AS gap FROM c GROUP BY phase")
def flattened_gap_percentile(t: Tables) -> DataFrame:
    r = requests(t).groupBy("phase", "outcome", "user_id").agg(F.collect_list("value").alias("gaps"))
    return telemetry.gap_percentile(r, ["phase"], "gaps").select("phase", F.round("gap", 6).alias("gap"))


@query(f"WITH r AS ({REQ}) SELECT user_id, min(us) AS first FROM r WHERE value > 100 GROUP BY user_id UNION ALL SELECT user_id, NULL FROM (SELECT user_id FROM r GROUP BY user_id HAVING max(value) <= 100)")
def first_crossing(t: Tables) -> DataFrame:
    return telemetry.first_time(requests(t), ["user_id"], F.col("value") > 100, "us")


@query(f"""
WITH r AS ({REQ}), d AS (SELECT event_type AS k, us // 86400000000 AS day FROM r WHERE value > 60), s AS (SELECT k, min(day) AS a, max(day) AS b FROM d GROUP BY k),
g AS (SELECT k, a, unnest(range(0, b - a + 1)) AS second FROM s), n AS (SELECT k, day, count(*) AS n FROM d GROUP BY ALL)
SELECT g.k AS event_type, g.second, coalesce(n.n, 0) AS n FROM g LEFT JOIN n ON n.k = g.k AND n.day = g.a + g.second""")
def bins_zero_filled(t: Tables) -> DataFrame:
    """Days stand for seconds here: the events span a month."""
    d = requests(t).where("value > 60").withColumn("day", F.floor(F.col("us") / 86_400_000_000))
    return telemetry.per_second(d, "day", ["event_type"])


@query(f"""
WITH r AS ({REQ}), q AS (SELECT event_id, user_id, CASE WHEN event_id % 3 > 0 THEN 'pod' || event_id % 4 END AS pod FROM r),
l AS (SELECT user_id, 'pod' || arg_max(event_id, event_id) % 4 AS lp FROM r WHERE event_type = 'view' GROUP BY user_id)
SELECT coalesce(pod, lp) AS pod, CASE WHEN pod IS NOT NULL THEN 'client' WHEN lp IS NOT NULL THEN 'backend_log' ELSE 'unknown' END AS pod_source, count(*) AS n FROM q LEFT JOIN l USING (user_id) GROUP BY ALL""")
def attribution_left_join(t: Tables) -> DataFrame:
    r = requests(t)
    q = r.select("event_id", F.col("user_id").alias("request_id"), F.when(F.col("event_id") % 3 > 0, F.concat(F.lit("pod"), F.col("event_id") % 4)).alias("pod"))
    log = r.where("event_type = 'view'").select(F.col("user_id").alias("request_id"), F.col("event_id").alias("wall_time"), F.concat(F.lit("pod"), F.col("event_id") % 4).alias("pod"))
    return telemetry.attribute(q, log).groupBy("pod", "pod_source").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH r AS ({REQ}), n AS (SELECT phase, event_type, count(*) AS n FROM r GROUP BY ALL) SELECT phase, round(max(n) / sum(n), 6) AS max_share, list_sum(list(n))::BIGINT AS total FROM n GROUP BY phase")
def max_share(t: Tables) -> DataFrame:
    d = telemetry.pod_shares(requests(t), "phase", "event_type")
    total = F.aggregate(F.map_values("pods"), F.lit(0).cast("bigint"), lambda a, x: a + x)
    return d.select("phase", F.round("max_share", 6).alias("max_share"), total.alias("total"))


@query(f"WITH r AS ({REQ}), b AS (SELECT us // 3600000000 AS ts, 'pod' || user_id % 3 AS pod, sum(value > 20)::BIGINT AS value FROM r GROUP BY ALL) SELECT a.ts, a.pod AS hot, b.pod AS idle FROM b a JOIN b ON a.ts = b.ts AND a.pod <> b.pod WHERE a.value > 2 AND b.value = 0")
def time_equi_join(t: Tables) -> DataFrame:
    b = requests(t).groupBy(F.floor(F.col("us") / 3_600_000_000).alias("ts"), F.concat(F.lit("pod"), F.col("user_id") % 3).alias("pod")).agg(F.count_if(F.col("value") > 20).alias("value"))
    return telemetry.idle_neighbours(b, 2).select("ts", "hot", "idle")


@query(f"WITH r AS ({REQ}), s AS (SELECT user_id, event_id AS sid, us AS start FROM r WHERE event_type = 'signup') SELECT s.sid, count(*) AS n FROM s JOIN r ON r.user_id = s.user_id AND r.us >= s.start AND r.us < s.start + 7200000000 GROUP BY s.sid")
def range_join_after_signup(t: Tables) -> DataFrame:
    r = requests(t)
    s = r.where("event_type = 'signup'").select("user_id", F.col("event_id").alias("sid"), F.col("us").alias("start"))
    return telemetry.within(r, s, "user_id", 7_200_000_000, "us").groupBy("sid").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH r AS ({REQ}), p AS (SELECT phase, count(*) AS planned FROM r GROUP BY phase), s AS (SELECT phase, count(*) AS sent FROM r WHERE outcome <> 'rejected' GROUP BY phase) SELECT phase, planned, coalesce(sent, 0) AS sent, planned - coalesce(sent, 0) AS unsent FROM p LEFT JOIN s USING (phase)")
def plan_reconciliation(t: Tables) -> DataFrame:
    r = requests(t)
    return telemetry.unsent(r, r.where("outcome <> 'rejected'"), "phase")


WIDTH, STEP, HOLD = 3600, 600, 1800
TICKS = f"""
WITH r AS ({REQ}), c AS (SELECT event_type, us // {STEP}000000 AS c, count(*) AS n FROM r GROUP BY ALL), x AS (SELECT event_type, n, unnest(range(c + 1, c + {WIDTH // STEP} + 1)) AS tick FROM c)
SELECT event_type, tick * {STEP} AS tick, sum(n)::BIGINT AS n, round(sum(n) / {WIDTH}, 9) AS rate FROM x GROUP BY event_type, tick"""


@query(TICKS)
def sliding_rate(t: Tables) -> DataFrame:
    d = requests(t).withColumn("s", F.floor(F.col("us") / 1_000_000))
    return telemetry.sliding_counts(d, "s", WIDTH, STEP, ["event_type"]).withColumn("rate", F.round("rate", 9))


@query(f"""
WITH k AS ({TICKS}), a AS (SELECT event_type, tick, tick - row_number() OVER (PARTITION BY event_type ORDER BY tick) * {STEP} AS i FROM k WHERE n >= 6),
s AS (SELECT event_type, tick, min(tick) OVER (PARTITION BY event_type, i) AS since FROM a)
SELECT event_type, CASE WHEN since IS NULL THEN 'inactive' WHEN tick - since >= {HOLD} THEN 'firing' ELSE 'pending' END AS state, count(*) AS ticks FROM k LEFT JOIN s USING (event_type, tick) GROUP BY ALL""")
def alert_islands(t: Tables) -> DataFrame:
    d = requests(t).withColumn("s", F.floor(F.col("us") / 1_000_000))
    k = telemetry.sliding_counts(d, "s", WIDTH, STEP, ["event_type"]).withColumn("active", F.col("n") >= 6)
    return telemetry.alert_islands(k, STEP, HOLD, ["event_type"]).groupBy("event_type", "state").agg(F.count(F.lit(1)).alias("ticks"))


#: What the batch queries of sessions and of planned requests say too.
SESSIONS, PLANNED = SQL["sessions"], SQL["plan_reconciliation"]
#: Replays as recursions over a pod's rows in order of time, the queue or the cache as the state.
NUMBERED = f"WITH RECURSIVE r AS ({REQ}), o AS (SELECT phase AS pod, event_id AS id, t, value * 20 AS service, user_id::VARCHAR AS key, row_number() OVER (PARTITION BY phase ORDER BY t, event_id) AS rn FROM r), p AS (SELECT DISTINCT pod FROM o)"


@query(f"""{NUMBERED},
f AS (SELECT pod, 0::BIGINT AS rn, NULL::BIGINT AS id, NULL::BOOLEAN AS admitted, NULL::DOUBLE AS start, NULL::DOUBLE AS finish, []::DOUBLE[] AS busy, []::DOUBLE[] AS queue FROM p
  UNION ALL SELECT o.pod, o.rn, o.id, y.admitted, y.start, y.start + o.service, CASE WHEN y.admitted THEN list_append(x.busy, y.start + o.service) ELSE x.busy END, CASE WHEN y.start > o.t THEN list_append(x.queue, y.start) ELSE x.queue END
  FROM f JOIN o ON o.pod = f.pod AND o.rn = f.rn + 1, LATERAL (SELECT list_filter(f.busy, lambda v: v > o.t) AS busy, list_filter(f.queue, lambda v: v > o.t) AS queue) x,
  LATERAL (SELECT len(x.busy) < 2 OR len(x.queue) < 2 AS admitted, CASE WHEN len(x.busy) < 2 THEN o.t WHEN len(x.queue) < 2 THEN list_sort(x.busy)[len(x.busy) - 1] END AS start) y)
SELECT pod, id, admitted, round(start, 3) AS start, round(finish, 3) AS finish FROM f WHERE rn > 0""")
def admission_replay(t: Tables) -> DataFrame:
    r = requests(t).select(F.col("phase").alias("pod"), F.col("event_id").alias("id"), "t", (F.col("value") * 20).alias("service"))
    return telemetry.replay_admission(r, 2, 2).withColumns({c: F.round(c, 3) for c in ("start", "finish")})


@query(f"""{NUMBERED},
f AS (SELECT pod, 0::BIGINT AS rn, NULL::BIGINT AS id, NULL::BOOLEAN AS hit, []::VARCHAR[] AS held FROM p
  UNION ALL SELECT o.pod, o.rn, o.id, list_contains(f.held, o.key), list_append(list_filter(f.held, lambda v: v <> o.key), o.key)[-8:] FROM f JOIN o ON o.pod = f.pod AND o.rn = f.rn + 1)
SELECT pod, id, hit FROM f WHERE rn > 0""")
def lru_replay(t: Tables) -> DataFrame:
    r = requests(t).select(F.col("phase").alias("pod"), F.col("event_id").alias("id"), "t", F.col("user_id").alias("key"))
    return telemetry.replay_lru(r, 8)


@query('SELECT event_id AS id, CASE WHEN event_id % 5 < 4 THEN 0 ELSE 1 + (event_id // 5) % 3 END::INT AS client, event_id / 6.0 AS "offset" FROM events')
def open_loop_schedule(t: Tables) -> DataFrame:
    return telemetry.schedule(t.events.select(F.col("event_id").alias("id")), 6.0, skew=True)


@query(f"""
WITH r AS ({REQ}), c AS (SELECT *, outcome = 'completed' AS ok, event_id % 50 AS tokens FROM r)
SELECT user_id % 4 AS concurrency, count(*) AS n, count(*) FILTER (WHERE ok) AS succeeded, count(*) FILTER (WHERE NOT ok) AS failed, round(count(*) FILTER (WHERE ok) / (max(t + value) - min(t)), 9) AS per_second,
  round(avg(value) FILTER (WHERE ok), 6) AS mean_seconds, max(value) FILTER (WHERE ok) AS max_seconds, coalesce(sum(tokens) FILTER (WHERE ok), 0)::BIGINT AS tokens FROM c GROUP BY 1""")
def benchmark_summary(t: Tables) -> DataFrame:
    r = requests(t).select((F.col("user_id") % 4).alias("concurrency"), (F.col("outcome") == "completed").alias("ok"), F.col("value").alias("seconds"), (F.col("event_id") % 50).alias("tokens"), F.col("t").alias("t0"), (F.col("t") + F.col("value")).alias("t1"))
    return anatomy.benchmark(r).withColumn("mean_seconds", F.round("mean_seconds", 6)).withColumn("per_second", F.round("per_second", 9))


def _stream(t: Tables) -> DataFrame:
    path = f"{t.sf_dir}/events.parquet"
    schema = t.events.schema
    if not path.endswith(".parquet") or t.spark.read.parquet(path).inputFiles()[0].split("/")[-1] != "events.parquet":
        return windows.event_stream(t.spark, path, schema)
    # A single file is watched through its folder, by name.
    raw = t.spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(t.sf_dir)
    return raw.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", "40 days")


@query("SELECT epoch_us(time_bucket(INTERVAL '1 day', ts)) // 1000000 AS start, event_type, count(*) AS n FROM events GROUP BY ALL")
def stream_window_counts(t: Tables) -> DataFrame:
    """The streaming count run over what is there (availableNow), each window's last update."""
    out = _settled(t, windows.window_counts(_stream(t), "ts", "1 day", ["event_type"]), ["start", "event_type"])
    return out.select(F.unix_seconds("start").alias("start"), "event_type", "n")


@query("SELECT count(*) FILTER (WHERE fault IS NULL) AS accepted, count(*) FILTER (WHERE fault = 'invalid chunks') AS bad_chunks FROM (SELECT CASE WHEN event_id % 70 BETWEEN 1 AND 64 THEN NULL ELSE 'invalid chunks' END AS fault FROM events)")
def request_validation(t: Tables) -> DataFrame:
    body = F.concat(F.lit('{"prompt":"hello","chunks":'), F.col("event_id") % 70, F.lit("}"))
    d = t.events.select(body.alias("body")).withColumn("fault", telemetry.payload_fault("body"))
    return d.agg(F.count_if(F.col("fault").isNull()).alias("accepted"), F.count_if(F.col("fault") == "invalid chunks").alias("bad_chunks"))


# Time to first chunk, cohorts, schedules, scaling, sessions and streams.


@query(f"WITH r AS ({REQ}), c AS (SELECT user_id, min(us) / 1e6 AS first FROM r WHERE event_type = 'view' GROUP BY user_id), s AS (SELECT user_id, min(us) / 1e6 AS sent FROM r GROUP BY user_id) SELECT user_id, round(first - sent, 6) AS ttfc FROM s LEFT JOIN c USING (user_id)")
def first_chunk_times(t: Tables) -> DataFrame:
    r = requests(t).withColumnRenamed("user_id", "request_id")
    sent = r.groupBy("request_id").agg(F.min("t").alias("sent"))
    d = telemetry.first_chunk(sent, r.where("event_type = 'view'").select("request_id", "t"))
    return d.select(F.col("request_id").alias("user_id"), F.round("ttfc", 6).alias("ttfc"))


@query(f"""
WITH r AS ({REQ}), c AS (SELECT phase, count(*) AS client_n, round(quantile_cont(value, 0.95), 6) AS client_p FROM r WHERE outcome = 'completed' GROUP BY phase),
b AS (SELECT phase, le, count(*) FILTER (WHERE value <= le) AS cum FROM r, (SELECT unnest(list_append({LES}, 'inf'::DOUBLE)) AS le) WHERE outcome = 'completed' GROUP BY ALL),
w AS (SELECT *, lag(cum, 1, 0) OVER p AS before, lag(le, 1, 0) OVER p AS lower, max(cum) OVER (PARTITION BY phase) AS total FROM b WINDOW p AS (PARTITION BY phase ORDER BY le)),
q AS (SELECT phase, total AS server_n, round(CASE WHEN isinf(le) THEN lower ELSE lower + (le - lower) * (0.95 * total - before) / (cum - before) END, 6) AS server_p FROM w WHERE cum >= 0.95 * total QUALIFY row_number() OVER (PARTITION BY phase ORDER BY le) = 1)
SELECT * FROM c JOIN q USING (phase)""")
def cohort_comparison(t: Tables) -> DataFrame:
    """Client percentiles beside those of buckets that three instances keep."""
    r = requests(t).withColumn("ttfc", F.col("value"))
    buckets = stats.cumulative(r.where("outcome = 'completed'").withColumn("instance", F.col("user_id") % 3), "value", BOUNDS, ["phase", "instance"])
    d = telemetry.cohorts(r, buckets)
    return d.select("phase", "client_n", F.round("client_p", 6).alias("client_p"), "server_n", F.round("server_p", 6).alias("server_p"))


@query("""
WITH i AS (SELECT user_id, event_id, '{"client": ' || event_id % 4 || ', "id": ' || event_id || '}' AS item FROM events)
SELECT user_id, 3::BIGINT AS runs, CASE WHEN user_id % 2 = 1 THEN 2 ELSE 1 END::BIGINT AS schedules, sha256('[' || string_agg(item, ',' ORDER BY event_id) || ']') AS first FROM i GROUP BY user_id""")
def schedule_identity(t: Tables) -> DataFrame:
    """Each user's requests as a plan that three runs share; the third run of every other one leaves it."""
    d = t.events.select("user_id", F.col("event_id").alias("id")).withColumn("run", F.explode(F.sequence(F.lit(0), F.lit(2))))
    left = (F.col("user_id") % 2 == 1) & (F.col("run") == 2)
    client = F.when(left, F.col("id") % 4 + 1).otherwise(F.col("id") % 4)
    items = d.select("user_id", "run", "id", F.concat(F.lit('{"client": '), client.cast("string"), F.lit(', "id": '), F.col("id").cast("string"), F.lit("}")).alias("item"))
    whole = telemetry.same_plan(items, "user_id", "run", "id").select("user_id", "runs", "schedules")
    first = telemetry.same_plan(items.where("run = 0"), "user_id", "run", "id").select("user_id", F.col("digest").alias("first"))
    return whole.join(first, "user_id")


@query("SELECT event_id, event_type FROM events ORDER BY ts DESC LIMIT 5")
def last_snapshots(t: Tables) -> DataFrame:
    return telemetry.last_snapshots(t.events, 5, "ts").select("event_id", "event_type")


@query(f"WITH s AS (SELECT us // 86400000000 AS d, count(DISTINCT user_id) AS current, count(*) // 20 AS desired, count(DISTINCT CASE WHEN value > 20 THEN user_id END) AS ready FROM ({REQ}) GROUP BY 1), b AS (SELECT arg_min(current, d) AS base FROM s) SELECT min(d) FILTER (WHERE desired > base) AS wanted, min(d) FILTER (WHERE ready > base) AS ready, min(d) FILTER (WHERE ready > base) - min(d) FILTER (WHERE desired > base) AS lag FROM s, b")
def scaling_trace(t: Tables) -> DataFrame:
    d = requests(t).groupBy(F.floor(F.col("us") / 86_400_000_000).alias("wall_time")).agg(F.count_distinct("user_id").alias("current"), F.floor(F.count(F.lit(1)) / 20).alias("desired"), F.count_distinct(F.when(F.col("value") > 20, F.col("user_id"))).alias("ready"))
    return telemetry.scaling(d).select("wanted", "ready", "lag")


@query(f"WITH r AS ({REQ}) SELECT a.event_id FROM r a WHERE a.event_type = 'click' AND EXISTS (SELECT 1 FROM r b WHERE b.event_type = 'signup' AND b.user_id = a.user_id)")
def sent_events(t: Tables) -> DataFrame:
    """Log events whose request a run has sent."""
    r = requests(t)
    return telemetry.sent_only(r.where("event_type = 'click'"), r.where("event_type = 'signup'"), "user_id").select("event_id")


TUMBLE = "time_bucket(INTERVAL '1 hour', ts)"


def _settled(t: Tables, df: DataFrame, keys: list[str]) -> DataFrame:
    return windows.settle(df, Scratch(t.spark).root, keys)


@query(f"SELECT epoch_us(b) // 1000000 AS end, event_type, count(*) AS n, round(count(*) / 7200.0, 9) AS rate FROM (SELECT event_type, unnest([{TUMBLE} + INTERVAL '1 hour', {TUMBLE} + INTERVAL '2 hour']) AS b FROM events) GROUP BY ALL")
def stream_rates(t: Tables) -> DataFrame:
    """A rate over two hours, every hour."""
    out = _settled(t, windows.rates(_stream(t), "ts", 7200, 3600, ["event_type"]), ["start", "event_type"])
    return out.select(F.unix_seconds("end").alias("end"), "event_type", "n", F.round("rate", 9).alias("rate"))


@query(f"SELECT epoch_us({TUMBLE} + INTERVAL '1 hour') // 1000000 AS tick, round(avg((event_type = 'signup')::INT), 6) AS share, count(*) AS n FROM events GROUP BY 1")
def stream_rejected_share(t: Tables) -> DataFrame:
    s = _stream(t).withColumn("outcome", F.when(F.col("event_type") == "signup", "rejected").otherwise("completed"))
    out = _settled(t, windows.rejected_share(s, "ts", "1 hour", "1 hour"), ["tick"])
    return out.select(F.unix_seconds("tick").alias("tick"), F.round("share", 6).alias("share"), "n")


@query(f"SELECT epoch_us({TUMBLE} + INTERVAL '1 hour') // 1000000 AS tick, le, count(*) FILTER (WHERE value <= le) AS cum FROM events, (SELECT unnest(list_append({LES}, 'inf'::DOUBLE)) AS le) GROUP BY ALL")
def stream_buckets(t: Tables) -> DataFrame:
    out = _settled(t, windows.bucket_counts(_stream(t), "ts", "value", "1 hour", "1 hour", BOUNDS), ["tick", "le"])
    return out.select(F.unix_seconds("tick").alias("tick"), "le", "cum")


@query(f"""
WITH d AS (SELECT epoch_us(time_bucket(INTERVAL '1 day', ts) + INTERVAL '1 day') // 1000000 AS tick, value FROM events),
b AS (SELECT tick, le, count(*) FILTER (WHERE value <= le) AS cum FROM d, (SELECT unnest(list_append({LES}, 'inf'::DOUBLE)) AS le) GROUP BY ALL),
w AS (SELECT *, lag(cum, 1, 0) OVER p AS before, lag(le, 1, 0) OVER p AS lower, max(cum) OVER (PARTITION BY tick) AS total FROM b WINDOW p AS (PARTITION BY tick ORDER BY le))
SELECT tick, round(CASE WHEN isinf(le) THEN lower ELSE lower + (le - lower) * (0.9 * total - before) / (cum - before) END, 6) AS quantile FROM w WHERE cum >= 0.9 * total QUALIFY row_number() OVER (PARTITION BY tick ORDER BY le) = 1""")
def stream_quantiles(t: Tables) -> DataFrame:
    """The daily 90 % quantile of a stream's histogram."""
    out = _settled(t, windows.bucket_counts(_stream(t), "ts", "value", "1 day", "1 day", BOUNDS), ["tick", "le"])
    q = stats.histogram_quantile(out, 0.9, ["tick"])
    return q.select(F.unix_seconds("tick").alias("tick"), F.round("quantile", 6).alias("quantile"))


@query(f"SELECT epoch_us({TUMBLE} + INTERVAL '1 hour') // 1000000 AS tick, event_type, arg_max(value, ts) AS value FROM events GROUP BY ALL")
def stream_gauges(t: Tables) -> DataFrame:
    out = _settled(t, windows.gauges(_stream(t), "ts", "1 hour", ["event_type"], "value"), ["tick", "event_type"])
    return out.select(F.unix_seconds("tick").alias("tick"), "event_type", "value")


@query("SELECT user_id, count(*) AS n, sum(event_id)::BIGINT AS ids FROM events GROUP BY user_id")
def stream_exactly_once(t: Tables) -> DataFrame:
    """A sink that gets every batch twice holds each row once."""
    folder = Scratch(t.spark).root
    once = windows.once_per_batch(f"{folder}/out")

    def twice(batch: DataFrame, i: int) -> None:
        once(batch, i)
        once(batch, i)

    windows.finish(_stream(t).select("user_id", "event_id"), twice, f"{folder}/state")
    return t.spark.read.parquet(f"{folder}/out").groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.sum("event_id").alias("ids"))


@query("""
WITH e AS (SELECT user_id, event_id, event_type, epoch_us(ts) / 1e6 AS t FROM events), s AS (SELECT user_id, min(t) AS sent FROM e GROUP BY 1),
x AS (SELECT user_id, sent, count(*) FILTER (WHERE event_type = 'view' AND t < sent + 86400) AS chunks, bool_or(event_type = 'purchase' AND t < sent + 86400) AS done FROM e JOIN s USING (user_id) GROUP BY ALL)
SELECT user_id, chunks, CASE WHEN done THEN 'completed' ELSE 'expired' END AS outcome FROM x""")
def stream_sessions(t: Tables) -> DataFrame:
    """A user's first day as a request: views are chunks, a purchase ends it, the deadline is a day later.
    A mark long after the last event moves the watermark past every deadline."""
    folder = Scratch(t.spark).root
    e = t.events.select(F.col("user_id").cast("string").alias("request_id"), "event_type", F.col("ts").cast("timestamp").alias("ts"))
    e.write.parquet(f"{folder}/in")
    e.agg((F.max("ts") + F.expr("INTERVAL '200 days'")).alias("ts")).select(F.lit("end").alias("request_id"), F.lit("end").alias("event_type"), "ts").write.mode("append").parquet(f"{folder}/in")
    kind = F.when(F.col("event_type") == "purchase", "done").when(F.col("event_type") == "view", "chunk").otherwise("other")
    s = windows.event_stream(t.spark, f"{folder}/in", e.schema, late="40 days", per_trigger=100_000).withColumn("us", F.unix_micros("ts"))
    out = windows.settle(windows.request_sessions(s.select("request_id", (F.col("us") / 1e6).alias("t"), kind.alias("kind"), "ts"), 86_400.0), folder, ["request_id"], "append")
    return out.select(F.col("request_id").cast("bigint").alias("user_id"), "chunks", "outcome")


# Streams with state: each equals a query over the same rows at rest.


def _played(t: Tables, rows: DataFrame, folder: str, parts: list, late: str, per_trigger: int = 1, ts: str = "ts") -> DataFrame:
    """A stream over rows that are written part by part (conditions), then a mark 400 days after the last, with
    -1 for numbers and `end` for texts: it moves the watermark past all that is open. (Of nulls, a filter that
    the optimizer puts below the watermark would lose it.)"""
    for part in parts:
        rows.where(part).coalesce(1).write.mode("append").parquet(folder)
    mark = rows.agg((F.max(ts) + F.expr("INTERVAL '400 days'")).alias(ts))
    mark.select(*[F.col(ts) if c == ts else F.lit("end" if kind == "string" else -1).cast(kind).alias(c) for c, kind in rows.dtypes]).coalesce(1).write.mode("append").parquet(folder)
    return windows.event_stream(t.spark, folder, rows.schema, ts, late, per_trigger)


def _events(t: Tables) -> DataFrame:
    return requests(t).select("event_id", "user_id", "event_type", "phase", "outcome", F.timestamp_micros("us").alias("ts"))


@query(SESSIONS)
def stream_session_windows(t: Tables) -> DataFrame:
    """The rows come in three batches that all span the month, so later ones join sessions that are open."""
    root = Scratch(t.spark).root
    s = _played(t, _events(t), f"{root}/in", [F.col("event_id") % 3 == i for i in (2, 0, 1)], "60 days")
    out = windows.settle(flows.session_counts(s, "ts", "2 hours", ["user_id"]), root, ["user_id", "start"], "append")
    return out.where("user_id >= 0").groupBy("user_id").agg(F.count(F.lit(1)).alias("sessions"), F.max("n").alias("longest"))


@query(PLANNED)
def stream_unsent(t: Tables) -> DataFrame:
    """Planned requests against those sent within the hour, as two streams: unsent ones are given out when
    nothing can meet them any more."""
    root, e = Scratch(t.spark).root, _events(t)
    halves = [F.col("event_id") % 2 == i for i in (1, 0)]
    plan = _played(t, e.select("event_id", "phase", F.col("ts").alias("planned")), f"{root}/plan", halves, "60 days", ts="planned")
    sent = e.where("outcome <> 'rejected'").select("event_id", (F.col("ts") + F.expr("INTERVAL '30 seconds'")).alias("sent"))
    sent = _played(t, sent, f"{root}/sent", halves, "60 days", ts="sent")
    both = flows.joined_within(plan, sent, "event_id", "planned", "sent", "1 hour")
    out = windows.settle(both.select("event_id", "phase", "sent"), root, ["event_id"], "append")
    return out.where("event_id >= 0").groupBy("phase").agg(F.count(F.lit(1)).alias("planned"), F.count("sent").alias("sent"), F.count_if(F.col("sent").isNull()).alias("unsent"))


@query("""
WITH e AS (SELECT event_type, event_id % 3 AS b, epoch_us(ts) // 1000 AS ms FROM events), m AS (SELECT b, max(ms) AS top FROM e GROUP BY b),
x AS (SELECT e.*, coalesce(ms < (SELECT max(top) FROM m WHERE m.b < e.b) - 432000000, false) AS late FROM e)
SELECT event_type, count(*) AS read, count(*) FILTER (WHERE NOT late) AS kept, count(*) FILTER (WHERE late) AS dropped FROM x GROUP BY event_type""")
def stream_late_rows(t: Tables) -> DataFrame:
    """Rows in three batches, five days of lateness allowed: what is behind the watermark is told, not lost."""
    root = Scratch(t.spark).root
    s = _played(t, _events(t).select("event_id", "event_type", "ts"), f"{root}/in", [F.col("event_id") % 3 == i for i in (0, 1, 2)], "5 days")
    windows.finish(flows.late_marked(s, "ts"), windows.once_per_batch(f"{root}/out"), f"{root}/state")
    out = t.spark.read.parquet(f"{root}/out").where("event_id >= 0")
    return out.groupBy("event_type").agg(F.count(F.lit(1)).alias("read"), F.count_if(~F.col("late")).alias("kept"), F.count_if("late").alias("dropped"))


DAY, QUARTER, STAY, LIMIT = 86_400, 21_600, 64_800, 60 / 86_400
#: Ticks of a daily rate, every sixth hour, with every ninth missing.
DAYS = f"""
WITH c AS (SELECT event_type, epoch_us(ts) // {QUARTER}000000 AS c, count(*) AS n FROM events GROUP BY ALL),
x AS (SELECT event_type, n, unnest(range(c + 1, c + {DAY // QUARTER} + 1)) AS tick FROM c),
k AS (SELECT event_type, tick * {QUARTER} AS tick, sum(n) >= 20 AND sum(n) / {DAY} > {LIMIT} AS active FROM x GROUP BY event_type, tick HAVING tick % 9 > 0),
a AS (SELECT event_type, tick, tick - row_number() OVER (PARTITION BY event_type ORDER BY tick) * {QUARTER} AS i FROM k WHERE active),
s AS (SELECT event_type, tick, min(tick) OVER (PARTITION BY event_type, i) AS since FROM a),
z AS (SELECT event_type, tick::DOUBLE AS tick, CASE WHEN since IS NULL THEN 'inactive' WHEN tick - since >= {STAY} THEN 'firing' ELSE 'pending' END AS state FROM k LEFT JOIN s USING (event_type, tick)
  UNION ALL SELECT a.event_type, (a.tick + {QUARTER})::DOUBLE, 'resolved' FROM a WHERE NOT EXISTS (SELECT 1 FROM k WHERE k.event_type = a.event_type AND k.tick = a.tick + {QUARTER}))"""


@query(f"{DAYS} SELECT event_type AS name, tick, state FROM z")
def stream_alerts(t: Tables) -> DataFrame:
    """Alerts over at least 20 samples, their timers in event time: where ticks stop, an alert resolves."""
    d = requests(t).withColumn("s", F.floor(F.col("us") / 1_000_000))
    k = telemetry.sliding_counts(d, "s", DAY, QUARTER, ["event_type"]).where(F.col("tick") / QUARTER % 9 > 0)
    k = k.select(F.col("event_type").alias("name"), F.col("tick").cast("double").alias("tick"), flows.condition(F.col("n"), F.col("rate"), LIMIT).alias("active"), F.timestamp_seconds("tick").alias("ts"))
    root = Scratch(t.spark).root
    k = Scratch(t.spark).table(k, "ticks")
    low, high = k.agg(F.min("tick"), F.max("tick")).first()
    share = F.floor((F.col("tick") - low) / ((high - low) / 4 + 1))
    stream = _played(t, k, f"{root}/in", [share == i for i in range(5)], f"{QUARTER} seconds")
    t.spark.conf.set("spark.sql.streaming.stateStore.providerClass", flows.ROCKS)
    try:
        windows.finish(flows.alerts(stream, QUARTER, STAY), windows.once_per_batch(f"{root}/out"), f"{root}/state")
    finally:
        t.spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    return t.spark.read.parquet(f"{root}/out").where("name <> 'end'").select("name", "tick", "state")
