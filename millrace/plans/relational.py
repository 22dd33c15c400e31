"""Relational queries over the star tables: joins of every kind, sets, groupings, windows, top-k."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.gates import frame, same_rows, subset
from .registry import Tables, query


@query("""
SELECT n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey
JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE o_orderdate >= TIMESTAMP '1995-01-01' GROUP BY n_name""")
def revenue_by_nation(t: Tables) -> DataFrame:
    j = t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey")).join(t.customer, F.col("o_custkey") == F.col("c_custkey")).join(t.nation, F.col("c_nationkey") == F.col("n_nationkey"))
    j = j.where(F.col("o_orderdate") >= F.lit("1995-01-01").cast("timestamp_ntz"))
    return j.groupBy("n_name").agg(F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"), F.count(F.lit(1)).alias("n"))


@query("""
SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS qty, round(avg(l_extendedprice), 4) AS price, count(*) AS n FROM lineitem GROUP BY ALL""")
def pricing_summary(t: Tables) -> DataFrame:
    return t.lineitem.groupBy("l_returnflag", "l_linestatus").agg(F.round(F.sum("l_quantity"), 2).alias("qty"), F.round(F.avg("l_extendedprice"), 4).alias("price"), F.count(F.lit(1)).alias("n"))


@query("""
SELECT 'with_orders' AS side, count(*) AS n FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders)
UNION ALL SELECT 'without_orders', count(*) FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)""")
def semi_anti_sets(t: Tables) -> DataFrame:
    o = t.orders.select(F.col("o_custkey").alias("c_custkey"))
    count = lambda how, name: t.customer.join(o, "c_custkey", how).agg(F.lit(name).alias("side"), F.count(F.lit(1)).alias("n"))
    return count("left_semi", "with_orders").unionByName(count("left_anti", "without_orders"))


@query("""
SELECT 'both' AS part, count(*) AS n FROM (SELECT c_nationkey FROM customer INTERSECT SELECT s_nationkey FROM supplier)
UNION ALL SELECT 'customers_only', count(*) FROM (SELECT c_nationkey FROM customer EXCEPT SELECT s_nationkey FROM supplier)
UNION ALL SELECT 'all_rows', count(*) FROM (SELECT c_nationkey FROM customer UNION ALL SELECT s_nationkey FROM supplier)""")
def set_operations(t: Tables) -> DataFrame:
    a, b = t.customer.select(F.col("c_nationkey").alias("k")), t.supplier.select(F.col("s_nationkey").alias("k"))
    parts = {"both": a.intersect(b), "customers_only": a.subtract(b), "all_rows": a.unionByName(b)}
    out = None
    for name, d in parts.items():
        row = d.agg(F.lit(name).alias("part"), F.count(F.lit(1)).alias("n"))
        out = row if out is None else out.unionByName(row)
    return out


@query("SELECT coalesce(o_custkey, c_custkey) AS k, (o_custkey IS NOT NULL)::INT AS has_order, (c_custkey IS NOT NULL)::INT AS has_customer FROM (SELECT DISTINCT o_custkey FROM orders) FULL OUTER JOIN customer ON o_custkey = c_custkey")
def full_coverage(t: Tables) -> DataFrame:
    o, c = t.orders.select("o_custkey").distinct(), t.customer.select("c_custkey")
    j = o.join(c, F.col("o_custkey") == F.col("c_custkey"), "full_outer")
    return j.select(F.coalesce("o_custkey", "c_custkey").alias("k"), F.col("o_custkey").isNotNull().cast("int").alias("has_order"), F.col("c_custkey").isNotNull().cast("int").alias("has_customer"))


@query("SELECT l_partkey, round(sum(l_quantity), 2) AS qty FROM lineitem GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 15")
def topk(t: Tables) -> DataFrame:
    return t.lineitem.groupBy("l_partkey").agg(F.round(F.sum("l_quantity"), 2).alias("qty")).orderBy(F.desc("qty"), "l_partkey").limit(15)


@query("SELECT c_mktsegment, o_orderpriority, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ROLLUP (c_mktsegment, o_orderpriority)")
def rollup_counts(t: Tables) -> DataFrame:
    j = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey"))
    return j.rollup("c_mktsegment", "o_orderpriority").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT o_orderkey, o_custkey, r::INT AS r FROM (SELECT o_orderkey, o_custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS r FROM orders) WHERE r <= 2")
def top_orders_per_customer(t: Tables) -> DataFrame:
    w = Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey")
    return t.orders.withColumn("r", F.row_number().over(w)).where("r <= 2").select("o_orderkey", "o_custkey", "r")


@query("SELECT e.event_id, arg_max(s.event_id, s.ts) AS signup FROM events e JOIN events s ON s.user_id = e.user_id AND s.event_type = 'signup' AND s.ts <= e.ts WHERE e.event_type = 'purchase' GROUP BY e.event_id")
def asof_signup(t: Tables) -> DataFrame:
    """The last signup at or before each purchase: one window over both kinds, no range join."""
    both = t.events.where("event_type in ('purchase', 'signup')")
    last = F.last(F.when(F.col("event_type") == "signup", F.col("event_id")), True).over(Window.partitionBy("user_id").orderBy("ts", F.col("event_type") != "signup").rowsBetween(Window.unboundedPreceding, 0))
    return both.withColumn("signup", last).where("event_type = 'purchase' and signup is not null").select("event_id", "signup")


@query("SELECT user_id, count(*) AS sessions, max(n) AS longest FROM (SELECT user_id, s, count(*) AS n FROM (SELECT user_id, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM (SELECT user_id, ts, event_id, (coalesce(epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)), 1e15) > 7200000000)::INT AS new FROM events)) GROUP BY ALL) GROUP BY user_id")
def sessions(t: Tables) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = t.events.select("user_id", "ts", "event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"))
    new = (F.coalesce(F.col("us") - F.lag("us").over(w), F.lit(10**15)) > 7_200_000_000).cast("int")
    s = e.withColumn("new", new).withColumn("s", F.sum("new").over(w)).groupBy("user_id", "s").agg(F.count(F.lit(1)).alias("n"))
    return s.groupBy("user_id").agg(F.count(F.lit(1)).alias("sessions"), F.max("n").alias("longest"))


@query("SELECT 'nations_in_regions' AS name, count(*) = 0 AS passed FROM nation WHERE n_regionkey NOT IN (SELECT r_regionkey FROM region) UNION ALL SELECT 'customers_in_nations', count(*) = 0 FROM customer WHERE c_nationkey NOT IN (SELECT n_nationkey FROM nation) UNION ALL SELECT 'parts_in_suppliers', count(*) = 0 FROM part WHERE p_partkey NOT IN (SELECT s_suppkey FROM supplier) UNION ALL SELECT 'same_rows', (SELECT count(*) FROM (SELECT * FROM region EXCEPT ALL SELECT * FROM region ORDER BY 1 DESC)) = 0")
def referential_checks(t: Tables) -> DataFrame:
    from ..operators.gates import Check

    n, r, c = t.nation, t.region, t.customer
    checks = [
        Check("nations_in_regions", subset(n.select(F.col("n_regionkey").alias("k")), r.select(F.col("r_regionkey").alias("k")), "k")),
        Check("customers_in_nations", subset(c.select(F.col("c_nationkey").alias("k")), n.select(F.col("n_nationkey").alias("k")), "k")),
        Check("parts_in_suppliers", subset(t.part.select(F.col("p_partkey").alias("k")), t.supplier.select(F.col("s_suppkey").alias("k")), "k")),
        Check("same_rows", same_rows(r, r.orderBy(F.desc("r_regionkey")))),
    ]
    return frame(t.spark, checks).select("name", "passed")


@query(r"SELECT page_id, length(html) AS size, len(regexp_extract_all(html, '<[a-zA-Z]')) AS tags FROM pages")
def page_scan(t: Tables) -> DataFrame:
    return t.pages.select("page_id", F.char_length("html").cast("bigint").alias("size"), F.regexp_count("html", F.lit("<[a-zA-Z]")).cast("bigint").alias("tags"))
