"""Connected components of a link table, and keeping decided component by component.

Links are contracted where they lie first: each task joins the ends of its links and hands on one link a
node to the least node that it reaches there. What is left after that is small for most tables, and a
counted number of links up to ONE_TASK is settled by one task in the same way. Larger tables go through
alternating large-star and small-star steps: groupings with partial aggregation, and joins whose hot keys
adaptive execution splits. Every round is a written table, so plans stay short and a lost executor costs its
own tasks. The driver gets counts and a checksum."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..scratch import Scratch

#: Links that one task settles: 16 bytes each, and about 100 more while they are joined.
ONE_TASK = 500_000
#: Links of a component that one task decides on; larger components are decided in rounds.
DECIDED = 500_000


def _contract(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(u, v) -> one row for each node and the least node that it reaches, but for these."""
    root: dict[int, int] = {}

    def find(x: int) -> int:
        top = x
        while (up := root.get(top, top)) != top:
            top = up
        while (up := root.get(x, x)) != top:
            root[x], x = top, up
        return top

    for pdf in batches:
        for u, v in zip(pdf["u"].tolist(), pdf["v"].tolist()):
            a, b = find(u), find(v)
            if a != b:
                root[max(a, b)] = min(a, b)
    nodes = [x for x in root if find(x) != x]
    for at in range(0, len(nodes), 100_000):
        part = nodes[at : at + 100_000]
        yield pd.DataFrame({"u": np.array(part, dtype=np.int64), "v": np.array([find(x) for x in part], dtype=np.int64)})


def contract(links: DataFrame) -> DataFrame:
    return links.select("u", "v").mapInPandas(_contract, "u long, v long")


def _least(links: DataFrame) -> DataFrame:
    return links.groupBy("u").agg(F.min("v").alias("m"))


def large_star(links: DataFrame) -> DataFrame:
    both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = _least(both).select("u", F.least("u", "m").alias("m"))
    return both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")


def small_star(links: DataFrame) -> DataFrame:
    down = links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = _least(down)
    moved = down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()


def components(links: DataFrame, scratch: Scratch, rounds: int = 1000) -> DataFrame:
    """(u, v) longs -> (node, root): each linked node with the least node that it reaches."""
    now = scratch.table(contract(links.where("u <> v")).distinct(), "links")
    mark = None
    for _ in range(rounds):
        n = now.count()
        if n <= ONE_TASK:
            settled = contract(now.coalesce(1)) if n else now
            now = scratch.table(settled, "links")
            break
        new = scratch.table(small_star(large_star(now)), "links")
        scratch.drop(now)
        now = new
        seen = tuple(now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if seen == mark:
            break
        mark = seen
    else:
        raise ArithmeticError(f"components still change after {rounds} rounds")
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)


def _decide(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Links sorted by component and later end: a node goes if an earlier node that stays is linked to it."""
    now, gone = None, set()
    for pdf in batches:
        out = []
        for root, b, a in zip(pdf["root"].tolist(), pdf["b"].tolist(), pdf["a"].tolist()):
            if root != now:
                now, gone = root, set()
            if b not in gone and a not in gone:
                gone.add(b)
                out.append(b)
        yield pd.DataFrame({"k": np.array(out, dtype=np.int64)})


def dropped_in_order(links: DataFrame, scratch: Scratch) -> DataFrame:
    """(a, b) longs, a < b -> (k): what a scan in rising order would drop, if a node goes as soon as an
    earlier kept one is linked to it. A component is decided in one pass by the task that holds its links;
    components of more than DECIDED links are decided in rounds, all of them together."""
    links = scratch.table(links.select("a", "b"), "pairs")
    roots = components(links.select(F.col("b").alias("u"), F.col("a").alias("v")), scratch)
    rooted = scratch.table(links.join(roots.select(F.col("node").alias("b"), "root"), "b"), "rooted")
    large = rooted.groupBy("root").count().where(F.col("count") > DECIDED).select("root")  # at most all links / DECIDED
    large = scratch.table(large, "large")
    hot = large.count()
    small = rooted.join(F.broadcast(large), "root", "left_anti") if hot else rooted
    gone = small.repartition("root").sortWithinPartitions("root", "b", "a").select("root", "b", "a").mapInPandas(_decide, "k long")
    if not hot:
        return gone
    return gone.unionByName(in_rounds(rooted.join(F.broadcast(large), "root", "left_semi").select("a", "b"), scratch))


def in_rounds(links: DataFrame, scratch: Scratch, rounds: int = 100_000) -> DataFrame:
    """The same for components of any size: undecided nodes without undecided earlier neighbours stay, their
    later neighbours go; a round decides the head of every chain."""
    links, dropped = scratch.table(links.select("a", "b"), "links"), None
    for _ in range(rounds):
        if not links.head(1):
            break
        heads = links.select("a").distinct().join(links.select(F.col("b").alias("a")).distinct(), "a", "left_anti")
        gone = scratch.table(links.join(heads, "a").select(F.col("b").alias("k")).distinct(), "gone")
        dropped = gone if dropped is None else dropped.unionByName(gone)
        left = links.join(gone.select(F.col("k").alias("a")), "a", "left_anti").join(gone.select(F.col("k").alias("b")), "b", "left_anti")
        left = scratch.table(left.join(heads, "a", "left_anti"), "links")
        scratch.drop(links)
        links = left
    if links.head(1):
        raise ArithmeticError(f"rows are still undecided after {rounds} rounds")
    return dropped if dropped is not None else links.select(F.col("a").alias("k"))
