"""Sharding by a hierarchical weighted hash tree.

A tree has regions, regions have racks, racks have shards with weights. For a key, every shard
makes a weighted hash draw: -ln(u) / weight, u from a digest of key and shard name. A rack draws
the least of its shards' draws and a region the least of its racks'. By the rule for the least of
exponential draws, an inner node's draw is distributed as a draw with the node's total weight, so
a descent that takes the least draw at region, rack and shard level honours the weights at each
level. A node's draw depends on what is below it alone: when weights change, a key moves only out
of a subtree that got lighter or into one that got heavier, and a new shard takes keys only into
itself. (Draws that were made afresh for each node's total weight would honour the weights as well,
but a key that a grown subtree attracts could then end at any of its shards, old ones too.)

Defined results: a null key is a key of its own; null text counts as empty; a very long text is read
for its size and checksum only; rows that repeat a key go to one shard and get different slots; an
empty table gives an empty result; other columns, of whatever name, are not read.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows that share a slot-numbering group, about; more rows make more groups, not larger ones.
RANK_ROWS = 100_000


@dataclass(frozen=True)
class Shard:
    number: int
    region: int
    rack: int
    weight: float = 1.0

    @property
    def name(self) -> str:
        return f"{self.region}/{self.rack}/{self.number}"


def tree(n: int, per_rack: int = 2, racks_per_region: int = 2, weights: dict[int, float] | None = None) -> list[Shard]:
    """n shards in order, filling racks and regions; a further shard changes no other one's place."""
    return [Shard(i, i // (per_rack * racks_per_region), i // per_rack, (weights or {}).get(i, 1.0)) for i in range(n)]


def draw(key: Column, shard: Shard) -> Column:
    digest = F.md5(F.concat(F.coalesce(key.cast("string"), F.lit("null")), F.lit("|" + shard.name)).cast("binary"))
    u = (F.conv(F.substring(digest, 1, 12), 16, 10).cast("double") + F.lit(0.5)) / F.lit(float(1 << 48))
    return -F.ln(u) / F.lit(shard.weight)


def name_of(shard: Shard) -> str:
    return f"_draw{shard.number}"


def drawn(df: DataFrame, key: str, shards: list[Shard]) -> DataFrame:
    """Adds each shard's draw as a column, which trees that share the shard share."""
    return df.select("*", *[draw(F.col(key), s).alias(name_of(s)) for s in shards])


def descend(shards: list[Shard]) -> Column:
    """The number of the shard that a descent by least draws ends at."""

    def least(cols: list[Column]) -> Column:
        return cols[0] if len(cols) == 1 else F.least(*cols)

    def first_equal(draws: list[tuple[Column, Column]], best: Column) -> Column:
        """The value that goes with the first draw equal to best."""
        return reduce(lambda rest, x: F.when(x[0] == best, x[1]).otherwise(rest), reversed(draws[:-1]), draws[-1][1])

    regions: dict[int, dict[int, list[Shard]]] = {}
    for s in shards:
        regions.setdefault(s.region, {}).setdefault(s.rack, []).append(s)
    region_draws, inner = [], []
    for racks in regions.values():
        rack_draws = []
        for members in racks.values():
            leaf = [(F.col(name_of(s)), F.lit(s.number)) for s in members]
            best = least([c for c, _ in leaf])
            rack_draws.append((best, first_equal(leaf, best)))
        best = least([c for c, _ in rack_draws])
        region_draws.append(best)
        inner.append(first_equal(rack_draws, best))
    return first_equal(list(zip(region_draws, inner)), least(region_draws)).cast("int")


def place(df: DataFrame, key: str, shards: list[Shard], out: str) -> DataFrame:
    """Adds column out: the shard number that the descent ends at."""
    return drawn(df, key, shards).withColumn(out, descend(shards)).drop(*map(name_of, shards))


def shard_documents(df: DataFrame, n_shards: int = 8, id_col: str = "doc_id", text_col: str = "text", weights: dict[int, float] | None = None) -> DataFrame:
    """One row per input row: id, size, text_crc32, law, shard, slot, grown_shard.

    Slots are gapless in each shard. They are numbered in two levels, so that no task sorts a whole
    shard: rows of a shard fall into groups by a digest of the key, groups are counted, and a row's
    slot is the rows in earlier groups plus its rank in its own.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    parts = max(1, -(-df.count() // (n_shards * RANK_ROWS)))
    key = F.coalesce(F.col(id_col).cast("string"), F.lit("null"))
    part = F.pmod(F.conv(F.substring(F.md5(key.cast("binary")), 1, 8), 16, 10).cast("bigint"), F.lit(parts)).cast("int")
    rows = df.select(
        F.col(id_col),
        (F.octet_length(text) + 1).cast("bigint").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        part.alias("_part"),
    )
    # The grown tree has the shards of the other one and one more: their draws are made once.
    grown = tree(n_shards + 1, weights=weights)
    rows = drawn(rows, id_col, grown).withColumn("shard", descend(grown[:-1])).withColumn("grown_shard", descend(grown)).drop(*map(name_of, grown))
    ranked = rows.withColumn("_rank", F.row_number().over(Window.partitionBy("shard", "_part").orderBy(id_col, "text_crc32", "size")))
    if parts > 1:
        keys = place(df.select(F.col(id_col), part.alias("_part")), id_col, tree(n_shards, weights=weights), "shard")
        counts = keys.groupBy("shard", "_part").agg(F.count(F.lit(1)).alias("_n"))  # n_shards x parts rows
        before = Window.partitionBy("shard").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
        starts = counts.select("shard", "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
        ranked = ranked.join(starts, ["shard", "_part"])
    else:
        ranked = ranked.withColumn("_start", F.lit(0))
    return ranked.select(
        id_col, "size", "text_crc32", F.lit("key").alias("law"), "shard",
        (F.col("_start") + F.col("_rank") - 1).cast("bigint").alias("slot"), "grown_shard",
    )


def write_shards(df: DataFrame, path: str, n_shards: int = 8, id_col: str = "doc_id") -> None:
    """The documents themselves, in one folder per shard."""
    placed = place(df, id_col, tree(n_shards), "shard")
    placed.write.partitionBy("shard").parquet(path)
