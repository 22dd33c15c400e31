"""Merkle manifest of a dataset: every row a leaf, every group a subtree, one root over the groups.

A leaf is the SHA-256 of the row's fields. The leaves of a group, ordered by id, are joined two by two
(a lone last node by itself) until one is left; the groups' subroots, ordered by group, likewise. Each row
gets its authentication path: the siblings on the way to the root, which with the row alone prove it.

How it is spread: leaves are range-sorted and numbered, and cut into aligned blocks of 2^BLOCK of them, so
that every block but a group's last is a whole subtree. A task walks its blocks leaf by leaf: one treehash
stack per level computes the sibling that this level needs next, and 2H - 1 steps a leaf go to the stack
whose lowest node is lowest, so that the stacks together hold a number of nodes that grows with the
logarithm of the block. The blocks' tops are leaves of the next walk, until a group has one node; then the
subroots are walked in the same way. Paths above a block are the same for all its rows: they are made once
a block and appended. No task sees more than a block at once, whatever a group's share of the rows.

Defined results: a null field counts as `-`; a null id comes first in its group, a null group first among
groups; rows that repeat an id are ordered by their leaf, and repeated rows are a leaf each; a very long
text is hashed whole where it is read; an empty table gives an empty result; columns that are neither
fields nor carried are not read, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._common import Scratch, map_arrow, small_batches, tasks

#: Levels of a block: 2^BLOCK leaves are walked by one task at a time.
BLOCK = 10
#: Rows of shared paths that are broadcast at most (about 2 kB each); more are joined by a shuffle.
BROADCAST_ROWS = 10_000
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def field(value: Column) -> Column:
    """Byte count, colon and value, or a dash for null: no two rows give one input of the hash."""
    text = value.cast("string")
    return F.when(value.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf_of(*values: Column) -> Column:
    return F.sha2(F.concat(*map(field, values)).cast("binary"), 256)


def join(left: bytes | None, right: bytes | None) -> bytes | None:
    """The node over two; beyond the last leaf there is nothing."""
    if left is None:
        return None
    return hashlib.sha256(left if right is None else left + right).hexdigest().encode()


class Treehash:
    """Computes the node of one level whose leaves begin at `start`, a step at a time."""

    __slots__ = ("level", "stack", "next", "node", "done")

    def __init__(self, level: int):
        self.level, self.stack, self.next, self.node, self.done = level, [], 0, None, True

    def begin(self, start: int) -> None:
        self.stack, self.next, self.done = [], start, False

    def low(self) -> int:
        """The level of its lowest node; an empty stack counts as its own level."""
        return self.stack[-1][0] if self.stack else self.level

    def step(self, leaves: list[bytes]) -> None:
        """One leaf pushed, or two nodes of one level joined."""
        stack = self.stack
        if len(stack) > 1 and stack[-1][0] == stack[-2][0]:
            level, right = stack.pop()
            stack[-1] = (level + 1, join(stack[-1][1], right))
        else:
            stack.append((0, leaves[self.next] if self.next < len(leaves) else None))
            self.next += 1
        if len(stack) == 1 and stack[0][0] == self.level:
            self.node, self.done = stack.pop()[1], True


def top_of(leaves: list[bytes], height: int, seen: Callable[[int, int, bytes | None], None] | None = None) -> bytes:
    """The top node by one treehash over all leaves; `seen` gets (level, index, node) of the first two nodes of a level."""
    stack: list[tuple[int, bytes | None]] = []
    for i in range(1 << height):
        level, node = 0, leaves[i] if i < len(leaves) else None
        if seen and i < 2:
            seen(0, i, node)
        while stack and stack[-1][0] == level:
            node = join(stack.pop()[1], node)
            level += 1
            if seen and i >> level < 2:
                seen(level, i >> level, node)
        stack.append((level, node))
        if i >= len(leaves) and len(stack) == 1 and level == height:
            break
    return stack[0][1]


def traverse(leaves: list[bytes], height: int) -> Iterator[list[bytes | None]]:
    """The siblings of each leaf, level by level, in the order of the leaves; None where there is none."""
    auth: list[bytes | None] = [None] * height
    hashes = [Treehash(h) for h in range(height)]

    def seen(level: int, index: int, node: bytes | None) -> None:
        if level < height:
            if index:
                auth[level] = node
            else:
                hashes[level].node = node

    top_of(leaves, height, seen)
    for leaf in range(len(leaves)):
        yield auth
        after = leaf + 1
        for h in range(height):
            if after & ((1 << h) - 1):
                break
            auth[h] = hashes[h].node
            hashes[h].begin((after + (1 << h)) ^ (1 << h))
        at_work = [x for x in hashes if not x.done and x.next < len(leaves) or x.stack]
        for x in hashes:
            if not x.done and x not in at_work:  # it lies beyond the last leaf
                x.node, x.done = None, True
        for _ in range(2 * height - 1):
            if not at_work:
                break
            x = min(at_work, key=Treehash.low)
            x.step(leaves)
            if x.done:
                at_work.remove(x)


def height_of(n: int) -> int:
    """Levels of a whole group of n nodes above them."""
    return (n - 1).bit_length()


def ranked(rows: DataFrame, scratch: Scratch, group: str, order: list[str], parts: int) -> DataFrame:
    """Adds pos, the row's place in its group from 0, and n, the group's rows. Rows are range-sorted over
    all groups together, so a group of any size is spread; counts by task and group give each its start."""
    keys = [group, *order]
    placed = rows.repartitionByRange(parts, *keys).sortWithinPartitions(*keys).withColumn("_at", F.monotonically_increasing_id())
    placed = scratch.table(placed, "sorted").withColumn("_part", F.shiftright("_at", 33))
    counts = placed.groupBy(group, "_part").agg(F.count(F.lit(1)).alias("_count"), F.min("_at").alias("_first"))
    whole = Window.partitionBy(group)
    before = F.coalesce(F.sum("_count").over(whole.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = scratch.table(counts.select(F.col(group).alias("_g"), F.col("_part").alias("_p"), "_first", before.alias("_start"), F.sum("_count").over(whole).alias("n")), "starts")
    if starts.count() <= BROADCAST_ROWS:
        starts = F.broadcast(starts)
    found = placed.join(starts, placed[group].eqNullSafe(starts["_g"]) & (placed["_part"] == starts["_p"]))
    return found.select(*rows.columns, (F.col("_start") + F.col("_at") - F.col("_first")).alias("pos"), "n")


def blocks_of(nodes: DataFrame) -> DataFrame:
    """A row per aligned block of (g, pos, n, digest, carry): its nodes in order, at most 2^BLOCK."""
    each = F.struct("pos", "digest", "carry")
    return nodes.groupBy("g", F.shiftright("pos", BLOCK).alias("block")).agg(F.max("n").alias("n"), F.sort_array(F.collect_list(each)).alias("nodes"))


def _leaves(nodes: pa.Scalar) -> list[bytes]:
    return nodes.values.field("digest").cast(pa.binary()).to_pylist()


def tops_of(blocks: DataFrame) -> DataFrame:
    """(g, pos, n, digest): the top of each block is a node of the next walk."""
    group = blocks.schema["g"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.column("n").to_pylist()
            tops = [top_of(_leaves(x), min(BLOCK, height_of(k))).decode() for x, k in zip(batch.column("nodes"), n)]
            more = [-(-k // (1 << BLOCK)) for k in n]
            yield pa.RecordBatch.from_arrays([batch.column("g"), batch.column("block"), pa.array(more, pa.int64()), pa.array(tops, pa.string())], ["g", "pos", "n", "digest"])

    schema = T.StructType([T.StructField("g", group), T.StructField("pos", T.LongType()), T.StructField("n", T.LongType()), T.StructField("digest", T.StringType())])
    return map_arrow(blocks, run, schema)


def paths_of(blocks: DataFrame, shared: DataFrame) -> DataFrame:
    """(g, pos, carry, digest, path, and what `shared` has more) per node: its own block's siblings, then the
    path that `shared` has for the block. A step of a path is L or R (the sibling's side) and its digest, or
    an empty text where a node has no sibling."""
    more = [c for c in shared.columns if c not in ("g", "pos", "path")]
    with_shared = blocks.join(shared.withColumnsRenamed({"g": "_g", "pos": "_pos"}), F.col("g").eqNullSafe(F.col("_g")) & (F.col("block") == F.col("_pos")))
    rows = with_shared.select("g", "block", "n", "nodes", "path", *more)
    each = blocks.schema["nodes"].dataType.elementType
    schema = T.StructType([T.StructField("g", blocks.schema["g"].dataType), each["pos"], each["carry"], each["digest"], T.StructField("path", T.ArrayType(T.StringType())), *[shared.schema[c] for c in more]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                values = batch.column("nodes")[i].values
                above = batch.column("path")[i].as_py()
                height = min(BLOCK, height_of(batch.column("n")[i].as_py()))
                flat, ends = [], [0]
                for at, auth in enumerate(traverse(_leaves(batch.column("nodes")[i]), height)):
                    flat += ["" if x is None else ("L" if at >> h & 1 else "R") + x.decode() for h, x in enumerate(auth)]
                    flat += above
                    ends.append(len(flat))
                path = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, pa.string()))
                same = lambda c: pa.repeat(batch.column(c)[i], len(values))  # noqa: B023, E731
                yield pa.RecordBatch.from_arrays([same("g"), values.field("pos"), values.field("carry"), values.field("digest"), path, *map(same, more)], schema.names)

    return map_arrow(rows, run, schema)


def climb(nodes: DataFrame, scratch: Scratch) -> DataFrame:
    """(g, pos, n, digest, carry) -> (g, pos, carry, digest, path, top): each node's path to its group's top."""
    blocks = scratch.table(blocks_of(nodes), "blocks")
    return paths_of(blocks, _few(shared_of(blocks, scratch)))


def shared_of(blocks: DataFrame, scratch: Scratch) -> DataFrame:
    """(g, pos, path, top) of each block."""
    tops = scratch.table(tops_of(blocks), "tops")
    if (tops.agg(F.max("n")).first()[0] or 0) <= 1:
        return tops.select("g", "pos", F.array().cast("array<string>").alias("path"), F.col("digest").alias("top"))
    upper = climb(tops.withColumn("carry", F.struct(F.lit(0).alias("none"))), scratch)
    return scratch.table(upper.select("g", "pos", "path", "top"), "upper")


def _few(shared: DataFrame) -> DataFrame:
    return F.broadcast(shared) if shared.count() <= BROADCAST_ROWS else shared


def manifest(df: DataFrame, id_col: str = "doc_id", group_col: str = "lang", fields: tuple[str, ...] = FIELDS, carry: dict[str, Column] | None = None) -> DataFrame:
    """One row per input row: the id, carried expressions, leaf, path, subroot, root."""
    spark = df.sparkSession
    small_batches(spark, 16)
    scratch, n_parts = Scratch(spark), max(tasks(spark), 1)
    kept = {"id": F.col(id_col)} | (carry or {})
    rows = df.select(F.col(group_col).alias("g"), F.col(id_col).alias("_id"), leaf_of(*map(F.col, fields)).alias("digest"), F.struct(*[c.alias(k) for k, c in kept.items()]).alias("carry"))
    rows = scratch.table(rows, "leaves")  # texts are read once; the sort samples its rows first
    placed = ranked(rows, scratch, "g", ["_id", "digest"], n_parts)
    blocks = scratch.table(blocks_of(placed.drop("_id")), "blocks")
    shared = shared_of(blocks, scratch)

    subroots = shared.where("pos = 0").select(F.lit(0).alias("all"), F.col("g").alias("_group"), F.col("top").alias("digest"), F.struct("g").alias("carry"))
    groups = climb(ranked(subroots, scratch, "all", ["_group"], min(n_parts, 8)).withColumnRenamed("all", "g"), scratch)
    groups = scratch.table(groups.select(F.col("carry.g").alias("_group"), F.col("path").alias("_above"), F.col("top").alias("root")), "groups")
    whole = shared.join(_few(groups), F.col("g").eqNullSafe(F.col("_group")))
    whole = scratch.table(whole.select("g", "pos", F.concat("path", "_above").alias("path"), F.col("top").alias("subroot"), "root"), "shared")

    out = paths_of(blocks, _few(whole))
    return out.select(F.col("carry.id").alias(id_col), *[F.col("carry")[k].alias(k) for k in (carry or {})], F.col("digest").alias("leaf"), "path", "subroot", "root")


def fold(leaf: Column, path: Column) -> Column:
    """The root that a leaf and its path give."""

    def up(node: Column, step: Column) -> Column:
        sibling = F.substring(step, 2, 64)
        pair = F.when(F.substring(step, 1, 1) == "L", F.concat(sibling, node)).otherwise(F.concat(node, sibling))
        return F.sha2(pair.cast("binary"), 256)

    return F.aggregate(path, leaf, up)


def proof(path: Column) -> Column:
    """One digest of all siblings of a path."""
    return F.sha2(F.array_join(F.transform(path, lambda s: F.substring(s, 2, 64)), "").cast("binary"), 256)
