"""Serving telemetry: outcomes, latency, attribution, correlations, accounting, alerts, replays."""

from __future__ import annotations

from collections import OrderedDict, deque

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import stats
from ..functions.text import is_json_object, strip

OUTCOMES = ("completed", "rejected", "aborted", "expired", "error")


def outcome(status: Column, done: Column, deadline: Column) -> Column:
    return (
        F.when(F.coalesce(deadline, F.lit(False)), "expired").when(status.isin(429, 503), "rejected")
        .when((status == 200) & F.coalesce(done, F.lit(False)), "completed").when(status == 200, "aborted").otherwise("error")
    )


def outcome_counts(df: DataFrame, by: list[str], col: str = "outcome") -> DataFrame:
    """All five outcomes, zeros included, the total, and the share that did not complete (0 for none)."""
    failed = F.coalesce(F.avg((F.col(col) != "completed").cast("int")), F.lit(0.0))
    return df.groupBy(*by).agg(*[F.count_if(F.col(col) == o).alias(o) for o in OUTCOMES], F.count(F.lit(1)).alias("total"), failed.alias("error_fraction"))


def latency(df: DataFrame, by: list[str], value: str, outcome_col: str = "outcome") -> DataFrame:
    """Median and p95 of completed requests, interpolated."""
    found = stats.percentiles(df.where(F.col(outcome_col) == "completed"), value, {"p50": 0.5, "p95": 0.95}, by)
    return stats.beside(df.select(*by).distinct(), found, by, "left")


def gap_percentile(df: DataFrame, by: list[str], gaps: str, q: float = 0.95) -> DataFrame:
    """Over all gaps between chunks of completed requests."""
    return stats.percentiles(df.where("outcome = 'completed'").select(*by, F.explode(gaps).alias("g")), "g", {"gap": q}, by)


def gaps_of(chunks: DataFrame) -> DataFrame:
    """(request_id, t) -> with gap: the time since the request's chunk before, null for its first one."""
    return chunks.withColumn("gap", F.col("t") - F.lag("t").over(Window.partitionBy("request_id").orderBy("t")))


def first_chunk(requests: DataFrame, chunks: DataFrame) -> DataFrame:
    """(request_id, sent) and (request_id, t) -> with ttfc: from sending to the first chunk, null without one."""
    first = chunks.groupBy("request_id").agg(F.min("t").alias("_t"))
    return requests.join(first, "request_id", "left").withColumn("ttfc", F.col("_t") - F.col("sent")).drop("_t")


def cohorts(client: DataFrame, server: DataFrame, q: float = 0.95) -> DataFrame:
    """Client requests (phase, outcome, ttfc) beside server buckets (phase, instance, le, cum): counts of
    both, the client's exact percentile and that of the buckets summed over instances."""
    done = client.where("outcome = 'completed'")
    exact = done.groupBy("phase").agg(F.count(F.lit(1)).alias("client_n")).join(stats.percentiles(done, "ttfc", {"client_p": q}, ["phase"]), "phase")
    summed = server.groupBy("phase", "le").agg(F.sum("cum").alias("cum"))
    total = summed.groupBy("phase").agg(F.max("cum").alias("server_n"))
    return exact.join(total, "phase").join(stats.histogram_quantile(summed, q, ["phase"]).withColumnRenamed("quantile", "server_p"), "phase")


def same_plan(items: DataFrame, group: str, run: str, order: str) -> DataFrame:
    """Per group whether all its runs had the same schedule: one digest of the items in order. A schedule
    is what one load generator holds."""
    whole = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(order, "item"))), lambda x: x["item"]), ",")
    digests = items.groupBy(group, run).agg(F.sha2(F.concat(F.lit("["), whole, F.lit("]")).cast("binary"), 256).alias("digest"))
    return digests.groupBy(group).agg(F.count(F.lit(1)).alias("runs"), F.count_distinct("digest").alias("schedules"), F.min("digest").alias("digest"))


def last_snapshots(snaps: DataFrame, n: int, t: str = "wall_time", then: list[str] | None = None) -> DataFrame:
    """The n latest; of equal times those that come last by `then`, all other columns if not told."""
    rest = then or [c for c in snaps.columns if c != t]
    return snaps.orderBy(F.desc(t), *[F.desc(c) for c in rest]).limit(n)


def attribute(requests: DataFrame, log: DataFrame) -> DataFrame:
    """Requests without a pod get that of the last log event with their id; `pod_source` says whence."""
    last = log.groupBy("request_id").agg(F.max_by("pod", "wall_time").alias("_pod"))
    both = requests.join(last, "request_id", "left")
    source = F.when(F.col("pod").isNotNull(), "client").when(F.col("_pod").isNotNull(), "backend_log").otherwise("unknown")
    return both.withColumn("pod_source", source).withColumn("pod", F.coalesce("pod", "_pod")).drop("_pod")


def unsent(plan: DataFrame, sent: DataFrame, by: str) -> DataFrame:
    p, s = plan.groupBy(by).agg(F.count(F.lit(1)).alias("planned")), sent.groupBy(by).agg(F.count(F.lit(1)).alias("sent"))
    return p.join(s, by, "left").select(by, "planned", F.coalesce("sent", F.lit(0)).alias("sent"), (F.col("planned") - F.coalesce("sent", F.lit(0))).alias("unsent"))


def pod_shares(df: DataFrame, client: str = "client_ip", pod: str = "pod") -> DataFrame:
    """client -> {pod: n} and the greatest pod's share."""
    n = df.where(F.col(pod).isNotNull()).groupBy(client, pod).agg(F.count(F.lit(1)).alias("n"))
    return n.groupBy(client).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct(pod, "n")))).alias("pods"), (F.max("n") / F.sum("n")).alias("max_share"))


def idle_neighbours(busy: DataFrame, limit: float) -> DataFrame:
    """(ts, pod, value) -> times when one pod is above the limit while another is at zero."""
    hot = busy.where(F.col("value") > limit).select("ts", F.col("pod").alias("hot"), F.col("value").alias("hot_value"))
    idle = busy.where(F.col("value") == 0).select("ts", F.col("pod").alias("idle"))
    return hot.join(idle, "ts").where("hot <> idle")


def within(events: DataFrame, starts: DataFrame, key: str, seconds: float, t: str = "t", start: str = "start", cell: float | None = None) -> DataFrame:
    """Events of a key in [start, start + seconds): an equi join on key and time cell, so that a key
    with many rows is spread; each start is in the two cells that its range can touch."""
    width = cell or seconds
    e = events.withColumn("_cell", F.floor(F.col(t) / width))
    reach = F.sequence(F.floor(F.col(start) / width), F.floor((F.col(start) + seconds) / width))
    s = starts.withColumn("_cell", F.explode(reach))
    return e.join(s, [key, "_cell"]).where((F.col(t) >= F.col(start)) & (F.col(t) < F.col(start) + seconds)).drop("_cell")


def first_time(df: DataFrame, by: list[str], condition: Column, t: str) -> DataFrame:
    return df.groupBy(*by).agg(F.min(F.when(condition, F.col(t))).alias("first"))


def scaling(snaps: DataFrame) -> DataFrame:
    """wall_time, current, desired, ready -> when more was first wanted, when first got, and the lag to ready."""
    base = snaps.agg(F.min_by("current", "wall_time").alias("base"))
    d = snaps.join(F.broadcast(base))  # one row
    return d.agg(F.min(F.when(F.col("desired") > F.col("base"), F.col("wall_time"))).alias("wanted"), F.min(F.when(F.col("ready") > F.col("base"), F.col("wall_time"))).alias("ready")).withColumn("lag", F.col("ready") - F.col("wanted"))


def per_second(df: DataFrame, t: str, by: list[str] | None = None) -> DataFrame:
    """Rows per whole second from the group's first, zeros included."""
    keys = by or []
    start = df.groupBy(*keys).agg(F.floor(F.min(t)).alias("_t0"), F.floor(F.max(t)).alias("_t1"))
    all_s = start.select(*keys, "_t0", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_t1") - F.col("_t0"))).alias("second"))
    n = df.groupBy(*keys, F.floor(t).alias("_s")).agg(F.count(F.lit(1)).alias("n"))
    j = all_s.withColumn("_s", F.col("_t0") + F.col("second")).join(n, [*keys, "_s"], "left")
    return j.select(*keys, "second", F.coalesce("n", F.lit(0)).alias("n"))


def sliding_counts(df: DataFrame, t: str, width: int, step: int, by: list[str] | None = None) -> DataFrame:
    """Rows in the `width` seconds before each tick of `step` seconds (half open), per group."""
    keys = by or []
    cells = df.groupBy(*keys, F.floor(F.col(t) / step).alias("_c")).agg(F.count(F.lit(1)).alias("n"))
    k = width // step
    ticks = cells.withColumn("tick", F.explode(F.sequence(F.col("_c") + 1, F.col("_c") + k)))
    return ticks.groupBy(*keys, (F.col("tick") * step).alias("tick")).agg(F.sum("n").alias("n")).withColumn("rate", F.col("n") / width)


def alert_islands(ticks: DataFrame, step: int, hold: int, by: list[str] | None = None) -> DataFrame:
    """tick, active -> tick, state. A condition must have held at every tick for `hold` seconds to fire;
    a missing tick ends it. Pending before, inactive else."""
    keys = by or []
    on = ticks.where("active")
    w = Window.partitionBy(*keys).orderBy("tick")
    island = F.col("tick") - F.row_number().over(w) * step
    since = on.withColumn("_i", island).withColumn("since", F.min("tick").over(Window.partitionBy(*keys, "_i"))).select(*keys, "tick", "since")
    out = ticks.join(since, [*keys, "tick"], "left")
    state = F.when(F.col("since").isNull(), "inactive").when(F.col("tick") - F.col("since") >= hold, "firing").otherwise("pending")
    return out.select(*keys, "tick", state.alias("state"))


def replay_admission(df: DataFrame, capacity: int, queue_limit: int) -> DataFrame:
    """pod, id, t, service -> admitted, start, finish: a bounded queue per pod, in order of arrival.
    State passes from batch to batch of a pod, so a pod's rows need not fit in memory."""
    import heapq

    def run(batches):
        now, busy, queue = None, [], deque()
        for pdf in batches:
            out = []
            for pod, rid, t, service in pdf[["pod", "id", "t", "service"]].itertuples(index=False):
                if pod != now:
                    now, busy, queue = pod, [], deque()
                while queue and queue[0] <= t:
                    queue.popleft()
                while busy and busy[0] <= t:
                    heapq.heappop(busy)
                if len(busy) >= capacity and len(queue) >= queue_limit:
                    out.append((pod, rid, False, None, None))
                    continue
                start = t if len(busy) < capacity else heapq.nsmallest(len(busy) - capacity + 1, busy)[-1]
                if start > t:
                    queue.append(start)
                heapq.heappush(busy, start + service)
                out.append((pod, rid, True, start, start + service))
            yield pd.DataFrame(out, columns=["pod", "id", "admitted", "start", "finish"])

    rows = df.select("pod", F.col("id").cast("long").alias("id"), F.col("t").cast("double").alias("t"), F.col("service").cast("double").alias("service"))
    return rows.repartition("pod").sortWithinPartitions("pod", "t", "id").mapInPandas(run, "pod string, id long, admitted boolean, start double, finish double")


def replay_lru(df: DataFrame, capacity: int) -> DataFrame:
    """pod, id, t, key -> hit: a least-recently-used cache per pod."""

    def run(batches):
        now, cache = None, OrderedDict()
        for pdf in batches:
            out = []
            for pod, rid, key in pdf[["pod", "id", "key"]].itertuples(index=False):
                if pod != now:
                    now, cache = pod, OrderedDict()
                out.append((pod, rid, key in cache))
                cache[key] = None
                cache.move_to_end(key)
                if len(cache) > capacity:
                    cache.popitem(last=False)
            yield pd.DataFrame(out, columns=["pod", "id", "hit"])

    rows = df.select("pod", F.col("id").cast("long").alias("id"), "t", F.col("key").cast("string").alias("key"))
    return rows.repartition("pod").sortWithinPartitions("pod", "t", "id").mapInPandas(run, "pod string, id long, hit boolean")


def schedule(plan: DataFrame, rate: float, skew: bool = False, order: str = "id") -> DataFrame:
    """Open-loop plan of numbered requests: request k at k / rate; clients in turn, or four of five to client 0."""
    k = F.col(order)
    client = F.when(k % 5 < 4, 0).otherwise(1 + (F.floor(k / 5) % 3)) if skew else k % 4
    return plan.select("*", client.cast("int").alias("client"), (k / rate).alias("offset"))


def sent_only(log: DataFrame, sent: DataFrame, key: str) -> DataFrame:
    """Log events whose request a run has sent; others belong to other runs."""
    return log.join(sent.select(key).distinct(), key, "left_semi")


def _kind(parsed: Column, path: str) -> Column:
    """The JSON type at a path as Spark names it, VOID for a JSON null; null if nothing is there."""
    return F.schema_of_variant(F.try_variant_get(parsed, path, "variant"))


def _number(kind: Column) -> Column:
    return F.coalesce(kind.startswith("BIGINT") | kind.startswith("DECIMAL") | kind.startswith("DOUBLE"), F.lit(False))


def payload_fault(payload: str) -> Column:
    """Why a JSON request is refused, or null: object, messages of allowed roles with content, at most
    8192 characters together, numbers in range and numbers indeed. A null where a number may stand is
    none; a prompt stands for messages where these are missing or null."""
    v = F.col(payload)
    parsed = F.try_parse_json(v)
    told, prompt = _kind(parsed, "$.messages"), _kind(parsed, "$.prompt")
    absent = F.coalesce(told == "VOID", F.lit(True))
    alone = absent & F.coalesce(prompt == "STRING", F.lit(False))
    text = F.get_json_object(v, "$.prompt")
    listed = F.when(F.coalesce(told.startswith("ARRAY"), F.lit(False)), F.try_variant_get(parsed, "$.messages", "array<variant>"))

    def bad(m: Column) -> Column:
        role, content = F.try_variant_get(m, "$.role", "string"), F.try_variant_get(m, "$.content", "string")
        sound = (_kind(m, "$.role") == "STRING") & role.isin("user", "assistant", "system") & (_kind(m, "$.content") == "STRING") & (F.length(strip(content)) > 0)
        return ~F.coalesce(sound, F.lit(False))

    size = F.when(alone, F.length(text)).otherwise(F.aggregate(listed, F.lit(0), lambda a, m: a + F.coalesce(F.length(F.try_variant_get(m, "$.content", "string")), F.lit(0))))
    invalid = F.when(alone, F.length(strip(text)) == 0).otherwise(F.exists(listed, bad))

    def number(name: str, low: float, high: float) -> Column:
        kind = _kind(parsed, f"$.{name}")
        within_ = F.coalesce(F.get_json_object(v, f"$.{name}").try_cast("double").between(low, high), F.lit(False))
        return kind.isNotNull() & ~(_number(kind) & within_)

    return (
        F.when(~is_json_object(v), "JSON object required")
        .when(~alone & (listed.isNull() | (F.size(listed) == 0)), "nonempty messages required").when(invalid, "invalid message").when(size > 8192, "input exceeds 8192 characters")
        .when(number("chunks", 1, 64), "invalid chunks").when(~_kind(parsed, "$.chunks").startswith("BIGINT"), "chunks must be integer")
        .when(number("chunk_delay", 0, 0.6), "invalid chunk_delay").when(number("work_multiplier", 0, 8), "invalid work_multiplier")
        .when(F.length(F.get_json_object(v, "$.request_id")) > 128, "request_id too long")
    )


def generate_fault(payload: str, limit: int) -> Column:
    """Why a generation request is refused, or null: a prompt that is text, not blank, of at most 8192
    characters, the agreed whole token limit or none, no other fields."""
    v = F.col(payload)
    parsed = F.try_parse_json(v)
    prompt, told = F.get_json_object(v, "$.prompt"), _kind(parsed, "$.max_new_tokens")
    right = (_kind(parsed, "$.prompt") == "STRING") & (F.length(strip(prompt)) > 0) & (F.length(prompt) <= 8192)
    agreed = told.isNull() | (told.startswith("BIGINT") & (F.try_variant_get(parsed, "$.max_new_tokens", "bigint") == limit))
    extra = F.size(F.array_except(F.json_object_keys(v), F.array(F.lit("prompt"), F.lit("max_new_tokens")))) > 0
    return (
        F.when(~is_json_object(v), "JSON object required").when(~F.coalesce(right, F.lit(False)), "invalid prompt")
        .when(~F.coalesce(agreed, F.lit(False)), "invalid max_new_tokens").when(F.coalesce(extra, F.lit(False)), "unknown fields")
    )


def versions_seen(snaps: DataFrame, col: str, known: list[str]) -> DataFrame:
    """The states or versions that occur, and those that should not."""
    seen = F.sort_array(F.collect_set(col))
    return snaps.agg(seen.alias("seen"), F.array_except(seen, F.array(*[F.lit(k) for k in known])).alias("unknown"))


def baseline_kept(pods: DataFrame, expected: list[str]) -> DataFrame:
    """(wall_time, name, restarts) -> by time: exactly the expected pods, and none restarted."""
    want = F.array(*[F.lit(p) for p in sorted(expected)])
    return pods.groupBy("wall_time").agg((F.sort_array(F.collect_set("name")) == want).alias("same_pods"), F.bool_and(F.col("restarts") == 0).alias("no_restarts"))
