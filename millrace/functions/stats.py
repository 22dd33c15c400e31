"""Percentiles in the five definitions that reports use, spreads, shares, histogram quantiles.

Order statistics are exact. Of few rows they are taken with a window over the values' counts; of many by
selection, which narrows value ranges down by counting, so that no task ranks a group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..scratch import Scratch


#: Rows up to which one window over the different values of a group is fit for a task.
FEW = 1_000_000
#: Cells that a value range is cut into in a pass.
CELLS = 4096


def at_positions(df: DataFrame, value: str, positions: dict[str, Column], by: list[str] | None = None) -> DataFrame:
    """Per group the values at 0-based positions (columns over `_n`) of the sorted rows; nulls are no rows,
    NaN is above all. Up to FEW rows are ranked in a window; more are narrowed down by `refined`."""
    keys = by or []
    rows = df.where(F.col(value).isNotNull())
    if df.count() > FEW:
        return refined(rows, value, positions, keys)
    counts = rows.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_c"))
    upto = Window.partitionBy(*keys).orderBy(value)
    whole = Window.partitionBy(*keys)
    ranked = counts.withColumn("_hi", F.sum("_c").over(upto)).withColumn("_n", F.sum("_c").over(whole)).withColumn("_lo", F.col("_hi") - F.col("_c"))
    hit = [F.max(F.when((p >= F.col("_lo")) & (p < F.col("_hi")), F.col(value))).alias(name) for name, p in positions.items()]
    return ranked.groupBy(*keys).agg(*hit)


def refined(rows: DataFrame, value: str, positions: dict[str, Column], keys: list[str], cells: int = CELLS) -> DataFrame:
    """The same by selection: the range that holds a position is cut into equal cells, rows are counted by
    cell, and the cell with the position is the next range, until its ends are equal. A pass is one grouping
    with partial aggregation; what it holds is bounded by cells times ranges, whatever the rows, and a pass
    narrows a range by that factor, so few passes settle any spread of values. Cells keep the order of
    values, so rounding cannot misplace a row."""
    scratch = Scratch(rows.sparkSession)
    names = [f"_k{i}" for i in range(len(keys))]
    v = scratch.table(rows.select(*[F.col(k).alias(n) for k, n in zip(keys, names)], F.col(value).alias("_v")), "values")
    whole = v.groupBy(*names).agg(F.count(F.lit(1)).alias("_n"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
    wanted = F.array(*[F.struct(F.lit(name).alias("what"), p.cast("bigint").alias("at")) for name, p in positions.items()])
    now = whole.select(*names, "_lo", "_hi", F.lit(0).cast("bigint").alias("_below"), F.inline(wanted))
    now = scratch.table(now.where(F.col("at").isNotNull() & F.col("at").between(0, F.col("_n") - 1)), "ranges")
    rng = [*names, "_lo", "_hi"]
    while (n := now.where(~F.col("_lo").eqNullSafe(F.col("_hi"))).select(*rng).distinct().count()) > 0:
        open_ = now.where(~F.col("_lo").eqNullSafe(F.col("_hi")))
        ranges = open_.select(*[F.col(c).alias(f"r{c}") for c in rng]).distinct()
        same = (F.col("_v") >= F.col("r_lo")) & (F.col("_v") <= F.col("r_hi"))
        for k in names:
            same = F.col(k).eqNullSafe(F.col(f"r{k}")) & same
        inside = v.join(F.broadcast(ranges) if n <= 10_000 else ranges, same).select(*[F.col(f"r{c}").alias(c) for c in rng], "_v", _cell(F.col("_v"), F.col("r_lo"), F.col("r_hi"), cells).alias("_cell"))
        counts = inside.groupBy(*rng, "_cell").agg(F.count(F.lit(1)).alias("_c"), F.min("_v").alias("_least"), F.max("_v").alias("_most"))
        upto = F.sum("_c").over(Window.partitionBy(*rng).orderBy("_cell").rowsBetween(Window.unboundedPreceding, 0))
        counts = counts.withColumn("_upto", upto)
        on = (F.col("at") - F.col("_below") < F.col("_upto")) & (F.col("at") - F.col("_below") >= F.col("_upto") - F.col("_c"))
        for c in rng:
            on = F.col(c).eqNullSafe(F.col(f"c{c}")) & on
        hit = open_.join(counts.withColumnsRenamed({c: f"c{c}" for c in rng}), on)
        hit = hit.select(*names, F.col("_least").alias("_lo"), F.col("_most").alias("_hi"), (F.col("_below") + F.col("_upto") - F.col("_c")).alias("_below"), "what", "at")
        now = scratch.table(now.where(F.col("_lo").eqNullSafe(F.col("_hi"))).unionByName(hit), "ranges")
    found = now.groupBy(*names).agg(*[F.max(F.when(F.col("what") == name, F.col("_lo"))).alias(name) for name in positions])
    return found.withColumnsRenamed(dict(zip(names, keys))) if keys else found


def _cell(v: Column, low: Column, high: Column, cells: int) -> Column:
    """A cell number that never falls as v rises: 0 for the low end, cells - 1 for the high one, so the two
    differ. Infinite ends and NaN are cells of their own."""
    half = lambda c: c.cast("double") * 0.5  # noqa: E731  the difference of two doubles may not be one
    share = (half(v) - half(low)) / F.nullif(half(high) - half(low), F.lit(0.0))
    plain = F.least(F.greatest(F.floor(share * cells), F.lit(0)), F.lit(cells - 1))
    x, endless = v.cast("double"), F.lit(float("inf"))
    odd = F.when(F.isnan(x), cells + 1).when(x == endless, cells).when(x == -endless, -2).when(low.cast("double") == -endless, F.when(x < 0, -1).otherwise(0))
    steep = F.when(F.isnan(high.cast("double")) | (high.cast("double") == endless), F.when(v == low, -1).when(x < 0, 0).otherwise(1))
    return F.coalesce(odd, steep, F.when(v == low, -1).when(v == high, cells), plain)


def percentiles(df: DataFrame, value: str, shares: dict[str, float], by: list[str] | None = None) -> DataFrame:
    """Per group of rows with a value the percentiles interpolated at (n - 1) q, as doubles."""
    at = {name: F.lit(q) * (F.col("_n") - 1) for name, q in shares.items()}
    ends = {f"{name}_{side}": f(p).cast("bigint") for name, p in at.items() for side, f in (("lo", F.floor), ("hi", F.ceil))}
    both = at_positions(df, value, ends | {"_last": F.col("_n") - 1}, by)
    n = df.where(F.col(value).isNotNull()).groupBy(*(by or [])).agg(F.count(F.lit(1)).alias("_n"))
    joined = beside(both, n, by or [])

    def between(name: str) -> Column:
        lo, hi, p = F.col(f"{name}_lo").cast("double"), F.col(f"{name}_hi").cast("double"), at[name]
        return F.when(lo == hi, lo).otherwise(lo + (hi - lo) * (p - F.floor(p)))

    return joined.select(*(by or []), *[between(name).alias(name) for name in shares])


def beside(a: DataFrame, b: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Rows of two tables of one row a group, side by side; null keys meet."""
    if not keys:
        return a.withColumn("_one", F.lit(1)).join(b.withColumn("_one", F.lit(1)), "_one", how).drop("_one")
    other = b.withColumnsRenamed({k: f"_b_{k}" for k in keys})
    on = [F.col(k).eqNullSafe(F.col(f"_b_{k}")) for k in keys]
    return a.join(other, on, how).drop(*[f"_b_{k}" for k in keys])


def nearest_rank(q: float) -> Column:
    """sorted[min(n - 1, int(q n))]"""
    return F.least(F.col("_n") - 1, F.floor(F.lit(q) * F.col("_n")))


def floor_index(q: float) -> Column:
    """sorted[int(q (n - 1))]"""
    return F.floor(F.lit(q) * (F.col("_n") - 1))


def upper_median() -> Column:
    """sorted[n // 2]"""
    return F.floor(F.col("_n") / 2)


def spread(df: DataFrame, value: str, by: list[str] | None = None) -> DataFrame:
    """p10, p50, p90, their ratio, coefficient of variation, least and greatest. Unrounded."""
    keys = by or []
    order = at_positions(df, value, {"p10": nearest_rank(0.1), "p50": nearest_rank(0.5), "p90": nearest_rank(0.9)}, keys)
    rest = df.groupBy(*keys).agg(F.stddev_pop(value).alias("_sd"), F.avg(value).alias("_mean"), F.min(value).alias("min"), F.max(value).alias("max"))
    joined = beside(order, rest, keys)
    cv = F.when(F.col("_mean") != 0, F.col("_sd") / F.col("_mean")).otherwise(0.0)
    return joined.select(*keys, "p10", "p50", "p90", (F.col("p90") / F.greatest("p10", F.lit(1))).alias("ratio_p90_p10"), cv.alias("cv"), "min", "max")


def mode_share(df: DataFrame, value: str, order: str) -> DataFrame:
    """The commonest value (of equals the one seen first) and its share."""
    counts = df.groupBy(value).agg(F.count(F.lit(1)).alias("n"), F.min(order).alias("_first"))
    return counts.agg(F.max_by(value, F.struct("n", -F.col("_first"))).alias("mode"), (F.max("n") / F.sum("n")).alias("share"))


def duplicate_share(col: Column) -> Column:
    """Share of rows beyond the first of each value."""
    return (F.count(col) - F.count_distinct(col)) / F.count(col)


def ceil_div(a: Column, b) -> Column:
    return F.ceil(a / b).cast("bigint")


def half_even(value: Column, digits: int) -> Column:
    """Rounded as Python rounds: the exact double, ties to even."""
    return F.bround(value, digits)


def close(a: Column, b: Column, relative: float = 1e-9) -> Column:
    """Equal up to a relative difference; what is not finite is close to its like only."""
    return F.coalesce((a == b) | (F.abs(a - b) <= F.greatest(F.abs(a), F.abs(b)) * relative), F.lit(False))


def iso(seconds: Column) -> Column:
    """Epoch seconds as ISO 8601 in UTC, to the microsecond."""
    return F.date_format(F.convert_timezone(F.current_timezone(), F.lit("UTC"), F.timestamp_seconds(seconds).cast("timestamp_ntz")), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")


def epoch(text: Column) -> Column:
    """ISO 8601 as epoch seconds."""
    return F.unix_micros(F.to_timestamp(text)) / 1e6


def weighted_mean(value: Column, weight: Column) -> Column:
    return F.sum(value * weight) / F.sum(F.when(value.isNotNull(), weight))


def l2_norm(vector: Column) -> Column:
    return F.sqrt(F.aggregate(vector, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))


def cumulative(df: DataFrame, value: str, bounds: list[float], by: list[str] | None = None) -> DataFrame:
    """Histogram: per group and upper bound `le` (infinity last) the rows at or below it."""
    keys, les = by or [], [*bounds, float("inf")]
    one = df.groupBy(*keys).agg(*[F.count_if(F.col(value) <= b).alias(f"_{i}") for i, b in enumerate(les)])
    pairs = F.array(*[F.struct(F.lit(float(b)).alias("le"), F.col(f"_{i}").alias("cum")) for i, b in enumerate(les)])
    return one.select(*keys, F.explode(pairs).alias("_p")).select(*keys, "_p.le", "_p.cum")


def histogram_quantile(buckets: DataFrame, q: float, by: list[str] | None = None, le: str = "le", cum: str = "cum") -> DataFrame:
    """Interpolated in the first bucket that reaches q of the total; in the infinite bucket its lower
    bound; null for an empty histogram."""
    keys = by or []
    w = Window.partitionBy(*keys).orderBy(le)
    b = buckets.withColumn("_before", F.lag(cum, 1, 0).over(w)).withColumn("_lower", F.lag(le, 1, 0.0).over(w))
    b = b.withColumn("_total", F.max(cum).over(Window.partitionBy(*keys)))
    at = b.where(F.col(cum) >= F.col("_total") * q)
    x = F.struct(le, cum, "_before", "_lower", "_total")
    first = at.groupBy(*keys).agg(F.min_by(x, le).alias("x"))
    inside = F.col(f"x.{cum}") > F.col("x._before")
    val = F.col("x._lower") + (F.col(f"x.{le}") - F.col("x._lower")) * (q * F.col("x._total") - F.col("x._before")) / (F.col(f"x.{cum}") - F.col("x._before"))
    out = F.when(F.col("x._total") == 0, None).when(F.col(f"x.{le}") == float("inf"), F.col("x._lower")).when(inside, val).otherwise(F.col(f"x.{le}"))
    return first.select(*keys, out.alias("quantile"))
