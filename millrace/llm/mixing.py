"""Mixing sources to target weights by entropy balancing.

Among all document rates r with 0 <= r <= 3 that give each source its target number of words, the
mix takes the one of least relative entropy to "every document once". Its dual is convex and has
one multiplier per source; a document of size x then has the rate min(3, exp(multiplier * x)).
Distributed Newton iterations find the multipliers: each is one aggregation over the counts of
(source, size), guarded by bisection. Rates are rounded into whole copies: first by cumulative
rounding in order of size, then the words a source still lacks (or has too many) are made up by
whole copies of ever smaller documents, at most one size per power of two.

The table of (source, size) has at most sqrt(2 x words) sizes per source, since k different sizes
need k^2 / 2 words; windows over it are bounded by that. Documents meet it in one join on both
columns; a hot pair is numbered by two-level ranks, salted by a hash of id and text, so that only rows
that repeat both share a group. Ranks go by id, then by that hash, then by a hash of what is carried.
Sources are ranked by one task: their table has a row a source.

Defined results: null text has size 0; null source is a source of its own, last; size 0 is never
taken; a very long text counts whole; rows that repeat an id count as separate documents; an empty
table gives an empty result; input columns travel as one struct, so no name clashes.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._common import WORDS, Scratch

MOST = 3  # copies of a document
#: Rows of one (source, size) that are ranked in one group, about.
RANK_ROWS = 20_000


def words_in(col: Column) -> Column:
    """How many words the text has: the white-space-separated runs, counted by where they begin."""
    return F.coalesce(F.regexp_count(col, F.lit(WORDS)), F.lit(0)).cast("bigint")


def targets_of(sizes: DataFrame, cycle: int = 3) -> DataFrame:
    """(source, source_size) -> with weight, target; one row per source.

    Sources in code-point order, null last, weigh 1..cycle, repeating. Targets share all words by
    weight and stop at MOST times the source; what is above goes to the others by weight. The
    stopping level is found in one pass over sources by rising cap per weight."""
    order = Window.orderBy(F.col("source").isNull(), "source")
    ranked = sizes.withColumn("weight", (F.pmod(F.row_number().over(order) - 1, F.lit(cycle)) + 1).cast("double"))
    cap = (F.col("source_size") * MOST).cast("double")
    ranked = ranked.withColumn("_cap", cap).withColumn("_ratio", F.col("_cap") / F.col("weight"))
    everything = Window.partitionBy()
    rising = Window.orderBy("_ratio", F.col("source").isNull(), "source")
    before = rising.rowsBetween(Window.unboundedPreceding, -1)
    onward = rising.rowsBetween(0, Window.unboundedFollowing)
    level = (F.sum("source_size").over(everything) - F.coalesce(F.sum("_cap").over(before), F.lit(0.0))) / F.sum("weight").over(onward)
    found = ranked.withColumn("_level", level)
    first = F.min(F.when(F.col("_ratio") >= F.col("_level"), F.struct("_ratio", "_level"))).over(everything)
    found = found.withColumn("_at", first["_level"])
    return found.select("source", "source_size", "weight", F.least("_cap", F.col("_at") * F.col("weight")).alias("target"))


def _rate(x: Column, lam: Column) -> Column:
    return F.exp(F.least(F.lit(math.log(MOST)), lam * x))


def multipliers(cells: DataFrame, targets: DataFrame, scratch: Scratch, rounds: int = 200, close: float = 1e-6) -> DataFrame:
    """Newton on the dual, all sources at once: (source, unit, lam). Sizes are measured in `unit`,
    the source's word-weighted mean size, so that the first guess ln(ratio) is near."""
    # Sums are exact decimals: doubles would depend on the order of rows, and reruns must agree.
    whole = (F.col("n") * F.col("size")).cast("decimal(25,0)")
    total = cells.groupBy("source").agg((F.sum(whole * F.col("size").cast("decimal(12,0)")).cast("double") / F.sum(whole).cast("double")).alias("unit"))
    state = targets.join(total, targets["source"].eqNullSafe(total["source"])).select(
        targets["source"], "source_size", "target", "unit",
        F.ln(F.col("target") / F.col("source_size")).alias("lam"), F.lit(-1e4).alias("lo"), F.lit(1e4).alias("hi"), F.lit(False).alias("done"),
    ).where("source_size > 0")
    state = scratch.table(state, "dual")
    for _ in range(rounds):
        at = cells.join(state, cells["source"].eqNullSafe(state["source"])).select(
            state["source"], "target", "unit", "lam", "lo", "hi", "source_size",
            (F.col("n") * F.col("size")).cast("double").alias("w"), (F.col("size") / F.col("unit")).alias("x"),
        )
        r = _rate(F.col("x"), F.col("lam"))
        sums = at.groupBy("source", "source_size", "target", "unit", "lam", "lo", "hi").agg(
            F.sum((F.col("w") * r).cast("decimal(28,6)")).cast("double").alias("got"),
            F.sum(F.when(F.col("lam") * F.col("x") < math.log(MOST), F.col("w") * F.col("x") * r).otherwise(0.0).cast("decimal(28,6)")).cast("double").alias("slope"),
        )
        gap = F.col("got") - F.col("target")
        done = (F.abs(gap) <= close * F.col("target")) | (F.col("target") >= MOST * F.col("source_size") * (1 - 1e-12))
        lo = F.when(gap < 0, F.col("lam")).otherwise(F.col("lo"))
        hi = F.when(gap > 0, F.col("lam")).otherwise(F.col("hi"))
        newton = F.col("lam") - gap / F.col("slope")
        middle = F.when(hi >= 1e4, F.greatest(lo * 2, lo + 1)).when(lo <= -1e4, F.least(hi * 2, hi - 1)).otherwise((lo + hi) / 2)
        step = F.when((F.col("slope") > 0) & (newton > lo) & (newton < hi), newton).otherwise(middle)
        after = sums.select("source", "source_size", "target", "unit", F.when(done, F.col("lam")).otherwise(step).alias("lam"), lo.alias("lo"), hi.alias("hi"), done.alias("done"))
        new = scratch.table(after, "dual")
        scratch.drop(state)
        state = new
        if not state.where(~F.col("done")).head(1):
            return state
    raise ArithmeticError(f"a source's multiplier is not found after {rounds} rounds")


def copies_of(cells: DataFrame, state: DataFrame) -> DataFrame:
    """(source, size, n) -> with copies: whole copies that all n documents of the cell make together."""
    joined = cells.join(state, cells["source"].eqNullSafe(state["source"])).select(
        cells["source"], "size", "n", "target",
        F.when(F.col("target") >= MOST * F.col("source_size") * (1 - 1e-12), F.lit(float(MOST))).otherwise(_rate(F.col("size") / F.col("unit"), F.col("lam"))).alias("rate"),
    )
    by_size = Window.partitionBy("source").orderBy(F.col("size").desc())
    upto = F.floor(F.sum(F.col("n") * F.col("rate")).over(by_size) + 0.5)
    rounded = joined.withColumn("_upto", upto).withColumn("copies", F.col("_upto") - F.coalesce(F.lag("_upto").over(by_size), F.lit(0)))
    rounded = rounded.withColumn("copies", F.least(F.greatest(F.col("copies"), F.lit(0)), F.col("n") * MOST).cast("bigint"))
    rounded = rounded.withColumn("_power", F.floor(F.log2(F.col("size").cast("double"))).cast("int"))
    # The cell of each power of two that can move most copies either way; at most 63 per source.
    room = F.least(F.col("copies"), F.col("n") * MOST - F.col("copies"))
    pick = Window.partitionBy("source", "_power").orderBy(room.desc(), "size")
    rounded = rounded.withColumn("_pick", F.row_number().over(pick) == 1)
    steps = rounded.groupBy("source").agg(
        (F.max("target") - F.sum(F.col("copies") * F.col("size"))).alias("lack"),
        F.sort_array(F.collect_list(F.when(F.col("_pick"), F.struct("size", "n", "copies"))), asc=False).alias("ladder"),
    )

    def step(acc: Column, c: Column) -> Column:
        moved = F.least(F.greatest(F.round(acc["lack"] / c["size"]).cast("bigint"), -c["copies"]), c["n"] * MOST - c["copies"])
        return F.struct((acc["lack"] - moved * c["size"]).alias("lack"), F.concat(acc["moves"], F.array(F.struct(c["size"].alias("size"), moved.alias("moved")))).alias("moves"))

    start = F.struct(F.col("lack").cast("double").alias("lack"), F.array().cast("array<struct<size:bigint,moved:bigint>>").alias("moves"))
    moves = steps.select("source", F.explode(F.aggregate("ladder", start, step)["moves"]).alias("m")).select(F.col("source").alias("_s"), F.col("m.size").alias("_size"), "m.moved")
    fixed = rounded.join(moves, rounded["source"].eqNullSafe(moves["_s"]) & (rounded["size"] == moves["_size"]), "left")
    return fixed.select("source", "size", "n", (F.col("copies") + F.coalesce("moved", F.lit(0))).alias("copies"))


def mix(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", carry: list[str] | None = None) -> DataFrame:
    """One row per input row: id, size, source_size, target, copies, taken (and the carried columns)."""
    spark = df.sparkSession
    scratch = Scratch(spark)
    kept = list(dict.fromkeys(carry or []))
    salt = F.xxhash64(F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.coalesce(F.col(text_col).cast("string"), F.lit("")))
    docs = df.select(F.struct(*[F.col(f"`{c}`") for c in kept] or [F.lit(1)]).alias("_in"), salt.alias("_hash"), F.col(id_col).alias("_id"), F.col(source_col).cast("string").alias("source"), words_in(F.col(text_col)).alias("size"))
    sizes = scratch.table(docs.drop("_in"), "sizes")  # words are counted once, not in every pass
    cells = scratch.table(sizes.groupBy("source", "size").agg(F.count(F.lit(1)).alias("n")), "cells")
    targets = scratch.table(targets_of(cells.groupBy("source").agg(F.sum(F.col("n") * F.col("size")).alias("source_size"))), "targets")
    live = cells.where("size > 0")
    state = multipliers(live, targets, scratch)
    copies = scratch.table(copies_of(live, state), "copies")

    base = docs if kept else sizes.withColumn("_in", F.lit(None))
    salts = F.ceil(F.coalesce(F.col("n"), F.lit(1)) / RANK_ROWS)
    plan = copies.select(F.col("source").alias("_s"), F.col("size").alias("_size"), "n", "copies")
    joined = base.join(plan, base["source"].eqNullSafe(plan["_s"]) & (base["size"] == plan["_size"]), "left")
    joined = joined.withColumn("_salt", F.when(salts > 1, F.pmod("_hash", salts)).otherwise(F.lit(0)).cast("bigint"))
    rank = F.row_number().over(Window.partitionBy("source", "size", "_salt").orderBy("_id", "_hash", *([F.xxhash64("_in")] if kept else [])))
    # Only cells with more than one salt need the offsets of their salts.
    large = plan.where(F.col("n") > RANK_ROWS)
    spread = sizes.join(large, sizes["source"].eqNullSafe(large["_s"]) & (sizes["size"] == large["_size"])).select("source", "size", F.pmod("_hash", F.ceil(F.col("n") / RANK_ROWS)).cast("bigint").alias("_salt"))
    spread = spread.groupBy("source", "size", "_salt").agg(F.count(F.lit(1)).alias("_c"))
    before = Window.partitionBy("source", "size").orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    offsets = spread.select(F.col("source").alias("_os"), F.col("size").alias("_osize"), F.col("_salt").alias("_osalt"), F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_start"))
    ranked = joined.withColumn("_rank", rank)
    ranked = ranked.join(offsets, ranked["source"].eqNullSafe(offsets["_os"]) & (ranked["size"] == offsets["_osize"]) & (ranked["_salt"] == offsets["_osalt"]), "left")
    place = F.coalesce(F.col("_start"), F.lit(0)) + F.col("_rank")
    each = F.floor(F.col("copies") / F.col("n")) + F.when(place <= F.pmod(F.col("copies"), F.col("n")), 1).otherwise(0)
    ranked = ranked.withColumn("copies", F.coalesce(each, F.lit(0)).cast("bigint"))
    goal = targets.select(F.col("source").alias("_gs"), "source_size", "target")
    out = ranked.join(goal, ranked["source"].eqNullSafe(goal["_gs"]))
    return out.select(F.col("_id").alias(id_col), "size", F.col("source_size").cast("bigint").alias("source_size"), F.col("target").cast("double").alias("target"), "copies", (F.col("copies") * F.col("size")).cast("bigint").alias("taken"), *([F.col("_in")] if kept else []))
