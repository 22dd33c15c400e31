"""Prefix trie of conversations: a node per distinct sequence of first turns, with what sharing it saves.

Turns become digests of 16 bytes where they are read; a conversation is its turns' digests end to end, so
that equal beginnings are equal prefixes of one binary key. Keys are range-sorted globally (the id breaks
ties, so copies of one conversation are spread too). Each task sweeps its sorted conversations with one
stack: the LCP of neighbours tells which nodes end, and a node that ends is finished, with the sums of its
subtree. Only nodes on the paths to a task's first and last conversation may go on in another task. Of
these a task hands over its stacks: partial counts along both paths, one row a task. One sweep over these
rows, in the order of tasks, stitches the stacks and finishes the nodes that were open.

The ids that end at a node are hashed in order while it is swept; where its run crosses tasks, their id
lists are written in pieces of PIECE bytes, which one task per node streams through the hash in order.

Bounds: a task holds one path and, for each node on it, its finished children until the node's smallest
member is known; the stitch reads two paths a task and holds one. A conversation is one row of 20 bytes a
turn. Texts do not leave the task that reads them.

Defined results: turns order by number (null first), then by role and by the digest of role and text, so
ties have a fixed order and repeated rows are turns of their own; null role or text counts as empty; a row
without a conversation id belongs to no conversation and is left out; an empty table has no conversation
and so no node; other columns, of whatever name, are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ._common import Scratch, crc_of, map_arrow, small_batches, tasks

#: Bytes of a turn's digest.
WIDE = 16
#: Turns that one task sweeps, about.
TURNS = 500_000
#: Bytes of an id list that is handed over at once.
PIECE = 1 << 20
#: Open nodes that are broadcast at most; more meet their children by a shuffle.
BROADCAST_ROWS = 200_000
EMPTY = hashlib.sha256(b"").hexdigest()
COUNTS = ("n_convs", "n_children", "n_leaves", "saved_tokens")
NODE = ("node", "parent", "depth", "conv_id", "parent_conv_id", *COUNTS, "ends_sha256")
#: What a task writes: finished nodes, one row of its open ones, pieces of id lists.
OPEN = "node binary, depth long, words long, conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long"
STITCHED = OPEN.replace("words long", "parent binary")
KINDS = "kind string, part int, piece long, node binary, parent binary, depth long, conv_id long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string, ids binary, open array<struct<" + OPEN.replace(" ", ": ").replace(",:", ",") + ", spine: boolean, last: boolean>>"


def words_in(text: Column) -> Column:
    return F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+"))


def turns_of(df: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    """conv_id -> turns in order, each (digest, words)."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role_col, text_col))
    digest = F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256)
    rows = df.where(F.col(conv_col).isNotNull()).select(
        F.col(conv_col).cast("long").alias("conv_id"),
        F.struct(F.col(turn_col).cast("long").alias("turn"), role.alias("role"), F.unhex(F.substring(digest, 1, 2 * WIDE)).alias("digest"), words_in(text).cast("int").alias("words")).alias("t"),
    )
    ordered = F.sort_array(F.collect_list("t"))
    return rows.groupBy("conv_id").agg(F.transform(ordered, lambda t: F.struct(t["digest"].alias("digest"), t["words"].alias("words"))).alias("turns"))


def rebuilt(turns: DataFrame) -> DataFrame:
    """The first h turns of the conversation that opens its twenty, then what each has after its own first h."""
    h = F.pmod(crc_of("conv_id"), F.lit(4)).cast("int")
    heads = turns.where("conv_id % 20 = 0").select(F.col("conv_id").alias("_base"), F.slice("turns", 1, 3).alias("_head"))
    own = turns.withColumn("_base", F.col("conv_id") - F.col("conv_id") % 20).withColumn("_h", h)
    joined = own.join(heads, "_base", "left")
    none = F.slice("turns", 1, 0)
    rest = F.when(F.size("turns") > F.col("_h"), F.slice("turns", F.col("_h") + 1, F.size("turns"))).otherwise(none)
    return joined.select("conv_id", F.concat(F.coalesce(F.slice("_head", F.lit(1), F.col("_h")), none), rest).alias("turns"))


def keyed(conversations: DataFrame) -> DataFrame:
    """(conv_id, turns) -> (conv_id, key, words): the digests end to end."""
    key = F.unhex(F.array_join(F.transform("turns", lambda t: F.hex(t["digest"])), ""))
    return conversations.select("conv_id", key.alias("key"), F.transform("turns", lambda t: t["words"]).alias("words"))


class Node:
    """A node on the path that is being swept, with what is known of its subtree."""

    __slots__ = ("id", "state", "words", "spine", "conv_id", "n_convs", "children", "leaves", "saved", "ends", "ended", "held")

    def __init__(self, state, words: int, spine: bool):
        self.state, self.words, self.spine = state, words, spine
        self.id = state.digest()[:WIDE] if state else None
        self.conv_id, self.n_convs, self.children, self.leaves, self.saved = None, 0, 0, 0, 0
        self.ends, self.ended = None, 0  # pieces of the ids that end here
        self.held: list = []  # finished children, until the smallest member is known

    def meet(self, conv_id: int, n: int) -> None:
        self.n_convs += n
        self.conv_id = conv_id if self.conv_id is None else min(self.conv_id, conv_id)

    def count(self, leaves: int, saved: int) -> None:
        """A finished child."""
        self.children += 1
        self.leaves += leaves
        self.saved += saved

    def totals(self) -> tuple[int, int]:
        """Leaves and saved tokens of the whole subtree, this node included."""
        return (self.leaves if self.children else 1), self.saved + (self.n_convs - 1) * self.words


class Sweep:
    """One task's sweep over sorted conversations. `rows` gathers what is to be written."""

    def __init__(self, part: int):
        self.part, self.rows, self.path, self.key, self.open, self.pieces = part, [], [], None, [], 0

    def add(self, conv_id: int, key: bytes, words: list[int]) -> None:
        if self.key is None:
            shared = -1
        elif self.key == key:
            shared = len(words)
        else:
            shared, most = 0, min(len(key), len(self.key)) // WIDE
            while shared < most and key[shared * WIDE : (shared + 1) * WIDE] == self.key[shared * WIDE : (shared + 1) * WIDE]:
                shared += 1
        while len(self.path) > shared + 1:
            self.close()
        first = self.key is None
        if not self.path:
            self.path.append(Node(hashlib.sha256(), 0, True))
        for d in range(len(self.path) - 1, len(words)):
            state = self.path[-1].state.copy()
            state.update(key[d * WIDE : (d + 1) * WIDE])
            self.path.append(Node(state, words[d], first))
        node = self.path[-1]
        node.meet(conv_id, 1)
        if node.ends is None:
            node.ends = bytearray()
        node.ends += (b"," if node.ended else b"") + str(conv_id).encode()
        node.ended += 1
        if node.spine and len(node.ends) > PIECE:
            self.hand_over(node)
        self.key = key

    def hand_over(self, node: Node) -> None:
        """A piece of the ids that end at a node that may end ids in other tasks too."""
        self.rows.append({"kind": "ids", "part": self.part, "piece": self.pieces, "node": node.id, "ids": bytes(node.ends)})
        self.pieces += 1
        node.ends, node.ended = bytearray(), 0

    def close(self, last: bool = False) -> None:
        """The deepest node ends here, unless it lies on the path to the task's first or last conversation."""
        node, depth = self.path.pop(), len(self.path)
        above = self.path[-1] if self.path else None
        if node.spine or last:
            if node.ended:
                self.hand_over(node)
            self.open.append({"node": node.id, "depth": depth, "words": node.words, "conv_id": node.conv_id, "n_convs": node.n_convs, "n_children": node.children, "n_leaves": node.leaves, "saved_tokens": node.saved, "spine": node.spine, "last": last})
            self.rows += node.held  # their parent's smallest member may be elsewhere
        else:
            leaves, saved = node.totals()
            for row in node.held:
                row["parent_conv_id"] = node.conv_id
            self.rows += node.held
            ends = hashlib.sha256(node.ends).hexdigest() if node.ended else EMPTY
            above.held.append({"kind": "node", "node": node.id, "parent": above.id, "depth": depth, "conv_id": node.conv_id, "n_convs": node.n_convs, "n_children": node.children, "n_leaves": leaves, "saved_tokens": saved, "ends_sha256": ends})
            above.count(leaves, saved)
            if above.spine and len(above.held) > 1000:
                self.rows += above.held
                above.held = []
        if above:
            above.meet(node.conv_id, node.n_convs)

    def finish(self) -> None:
        while self.path:
            self.close(last=True)
        if self.open:
            self.rows.append({"kind": "open", "part": self.part, "open": self.open})


def _arrow(ddl: str) -> pa.Schema:
    return to_arrow_schema(T.StructType.fromDDL(ddl))


def sweep(sorted_rows: DataFrame) -> DataFrame:
    """Finished nodes, the task's open paths and pieces of id lists, told apart by kind."""
    schema = _arrow(KINDS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        own = Sweep(TaskContext.get().partitionId())
        for batch in batches:
            for conv_id, key, words in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "key", "words"))):
                own.add(conv_id, key, words)
                if len(own.rows) > 2000:
                    yield pa.RecordBatch.from_pylist(own.rows, schema)
                    own.rows = []
        own.finish()
        for at in range(0, len(own.rows), 2000):
            yield pa.RecordBatch.from_pylist(own.rows[at : at + 2000], schema)

    return map_arrow(sorted_rows.select("conv_id", "key", "words"), run, KINDS)


class Stitch:
    """Aligns the tasks' open paths, in their order, and finishes nodes as they leave the path."""

    def __init__(self):
        self.path: list[tuple[dict, Node]] = []
        self.rows: list[dict] = []

    def task(self, nodes: list[dict]) -> None:
        """The open nodes of one task: the paths to its first and its last conversation."""
        by_depth = sorted(nodes, key=lambda x: x["depth"])
        self.follow([x for x in by_depth if x["spine"]], by_depth)
        self.follow([x for x in by_depth if x["last"]], [])
        for x in by_depth:
            if x["last"] and not x["spine"]:
                self.add(x)

    def follow(self, path: list[dict], counted: list[dict]) -> None:
        shared = 0
        while shared < min(len(path), len(self.path)) and path[shared]["node"] == self.path[shared][0]["node"]:
            shared += 1
        while len(self.path) > shared:
            self.close()
        for x in path[shared:]:
            self.path.append((x, Node(None, x["words"], True)))
        for x in counted:
            if x["spine"]:
                self.add(x)

    def add(self, x: dict) -> None:
        node = self.path[x["depth"]][1]
        node.meet(x["conv_id"], x["n_convs"])
        node.children += x["n_children"]
        node.leaves += x["n_leaves"]
        node.saved += x["saved_tokens"]

    def close(self) -> None:
        x, node = self.path.pop()
        leaves, saved = node.totals()
        parent = None
        if self.path:
            self.path[-1][1].count(leaves, saved)
            parent = self.path[-1][0]["node"]
        self.rows.append({"node": x["node"], "parent": parent, "depth": x["depth"], "conv_id": node.conv_id, "n_convs": node.n_convs, "n_children": node.children, "n_leaves": leaves, "saved_tokens": saved})


def _stitched(opened: DataFrame) -> DataFrame:
    """The nodes that were open in some task, finished: a sweep over one row a task."""
    schema = _arrow(STITCHED)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole = Stitch()
        for batch in batches:
            for nodes in batch.column("open"):
                whole.task(nodes.as_py())
                yield pa.RecordBatch.from_pylist(whole.rows, schema)
                whole.rows = []
        while whole.path:
            whole.close()
        yield pa.RecordBatch.from_pylist(whole.rows, schema)

    return map_arrow(opened.select("part", "open").repartition(1).sortWithinPartitions("part"), run, STITCHED)


def _hashed(pieces: DataFrame, n: int) -> DataFrame:
    """(node, ends_sha256): each node's id pieces through one hash, in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["node", "ends_sha256"]
        now, state = None, None
        for batch in batches:
            out = []
            for node, ids in zip(batch.column("node"), batch.column("ids")):
                if node.as_py() == now:
                    state.update(b",")
                else:
                    if now is not None:
                        out.append((now, state.hexdigest()))
                    now, state = node.as_py(), hashlib.sha256()
                state.update(ids.as_py())
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], t) for i, t in ((0, pa.binary()), (1, pa.string()))], names)
        if now is not None:
            yield pa.RecordBatch.from_arrays([pa.array([now], pa.binary()), pa.array([state.hexdigest()], pa.string())], names)

    ordered = pieces.select("node", "part", "piece", "ids").repartition(n, "node").sortWithinPartitions("node", "part", "piece")
    return map_arrow(ordered, run, "node binary, ends_sha256 string")


def prefix_trie(conversations: DataFrame, n_parts: int | None = None) -> DataFrame:
    """(conv_id, turns) -> one row per node: NODE."""
    spark = conversations.sparkSession
    small_batches(spark, 2000)
    scratch, n = Scratch(spark), n_parts or max(tasks(spark), 1)
    rows = keyed(conversations).repartitionByRange(n, "key", "conv_id").sortWithinPartitions("key", "conv_id")
    swept = scratch.table(sweep(rows), "swept")

    ended = _hashed(swept.where("kind = 'ids'"), n)
    stitched = scratch.table(_stitched(swept.where("kind = 'open'")), "stitched")
    few = stitched.count() <= BROADCAST_ROWS
    opened = stitched.join(ended, "node", "left").withColumn("parent_conv_id", F.lit(None).cast("long"))
    opened = opened.withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(EMPTY))).select(*NODE)
    above = stitched.select(F.col("node").alias("parent"), F.col("conv_id").alias("_above"))
    closed = swept.where("kind = 'node'").select(*NODE)
    below = closed.where("parent_conv_id is null").unionByName(opened).join(F.broadcast(above) if few else above, "parent", "left")
    return closed.where("parent_conv_id is not null").unionByName(below.withColumn("parent_conv_id", F.col("_above")).select(*NODE))


def conversation_trie(df: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """The trie of rebuilt conversations."""
    n = max(tasks(df.sparkSession), -(-df.count() // TURNS))
    return prefix_trie(rebuilt(turns_of(df, conv_col, turn_col, role_col, text_col)), n)
