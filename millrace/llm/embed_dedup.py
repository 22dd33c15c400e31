"""Embedding near-dedup by NN-descent, within labels, at a cosine of 0.98.

Equal vectors are one node with a count. A neighbour graph starts from several random-hyperplane
orders (neighbours in an order, within buckets of bounded size) and is refined by rounds of
neighbours-of-neighbours joins: every node brings together its nearest and those that have it as
nearest, whose similarities improve each other's lists. A list that is full of links is saturated
and doubles, up to LONGEST. Beyond that lists say too little: all nodes of a component of more than
LARGE nodes are compared with all nodes of their label in blocks, which gives their link counts
exactly and without a row per link; so are nodes that this joins to such a component, until none joins.

The graph is audited: every row whose id is divisible by AUDIT is compared with all of its label in
blocks. Recall is the mean share of a row's links that were found, over all such rows and over those
outside the components compared in blocks; the lesser of the two counts. Below the recall wanted, lists
and rounds are doubled, and where LONGEST does not do, all nodes are compared in blocks. Links are the graph's pairs with
the cosine, computed in double precision.

Defined results: vectors that are null, empty, zero, or hold null or non-finite components, and those
without a label, link with nothing; vectors of different length never link; rows that repeat an id
count as separate vectors, whether their vectors are equal or not, and give a row each; a null id is
not linked; an empty table gives an empty result; other columns, of whatever name, are not read. Nodes
are numbered as they are written, so their names are theirs alone; ids appear in the result only.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._common import Scratch, map_pandas, tasks
from .components import components

COSINE = 0.98
LIST, LONGEST, LARGE = 8, 128, 64
REVERSE = 4
ORDERS, ORDER_BITS, NEXT = 8, 24, 2
BUCKET = 5000
BLOCK = 2000
AUDIT = 50


def nodes_of(df: DataFrame, id_col: str, vec_col: str, label_col: str) -> DataFrame:
    """(label, v, node, low, mult, ask): distinct valid vectors, numbered, with their least id; whether the
    audit asks for one of its rows. To be written before it is read twice."""
    v = F.col("v")
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("v"), F.col(label_col).cast("string").alias("label"))
    sound = F.col("id").isNotNull() & F.col("label").isNotNull() & v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    return rows.where(sound).groupBy("label", "v").agg(F.min("id").alias("low"), F.count(F.lit(1)).alias("mult"), F.bool_or(F.pmod("id", F.lit(AUDIT)) == 0).alias("ask")).withColumn("node", F.monotonically_increasing_id())


def _prepare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    planes: dict[int, np.ndarray] = {}
    for pdf in batches:
        if not len(pdf):
            continue
        vecs, codes = [], []
        for v in pdf["v"]:
            a = np.asarray(v, dtype=np.float64)
            a = a / np.abs(a).max()  # no overflow in the norm
            a = a / np.sqrt(a @ a)
            d = len(a)
            if d not in planes:
                planes[d] = np.random.default_rng(d).standard_normal((d, ORDERS * ORDER_BITS))
            bits = (a @ planes[d] > 0).reshape(ORDERS, ORDER_BITS)
            codes.append((bits @ (1 << np.arange(ORDER_BITS - 1, -1, -1))).tolist())
            vecs.append(a.tobytes())
        kind = pdf["label"] + "/" + pdf["v"].str.len().astype(str)
        yield pd.DataFrame({"node": pdf["node"], "kind": kind, "mult": pdf["mult"], "ask": pdf["ask"], "vec": vecs, "codes": codes})


def _adjacent(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Similarities of rows that follow one another in an order, within a bucket."""
    tail = None
    for pdf in batches:
        block = pdf if tail is None else pd.concat([tail, pdf], ignore_index=True)
        fresh = 0 if tail is None else len(tail)
        keys = list(zip(block["order"], block["kind"], block["bucket"], block["salt"]))
        vecs = [np.frombuffer(x) for x in block["vec"]]
        ids = block["node"].to_numpy()
        out = []
        for j in range(1, len(keys)):
            for i in range(max(0, j - NEXT), j):
                if j >= fresh and keys[i] == keys[j]:
                    out.append((ids[i], ids[j], float(vecs[i] @ vecs[j])))
        tail = block[-NEXT:]
        if out:
            yield pd.DataFrame(out, columns=["a", "b", "sim"])


def _local_join(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """All pairs of a node's neighbourhood of which one is new, where they improve a list. Rows come sorted by hub."""
    held: list = []
    hub = None

    def join() -> list:
        _, at = np.unique([r[0] for r in held], return_index=True)  # a neighbour of both kinds comes twice
        if len(at) < 2:
            return []
        ids = np.array([held[i][0] for i in at])
        kth = np.array([held[i][1] for i in at])
        fresh = {r[0] for r in held if r[2]}
        new = np.array([i in fresh for i in ids.tolist()], dtype=bool)
        v = np.array([np.frombuffer(held[i][3]) for i in at])
        s = v @ v.T
        good = (s > np.minimum.outer(kth, kth)) & (new[:, None] | new[None, :]) & (ids[:, None] < ids[None, :])
        i, j = np.nonzero(good)
        return list(zip(ids[i].tolist(), ids[j].tolist(), s[i, j].tolist()))

    out: list = []
    for pdf in batches:
        for h, *row in pdf[["hub", "node", "kth", "new", "vec"]].itertuples(index=False):
            if h != hub:
                if len(held) > 1:
                    out += join()
                held, hub = [], h
            held.append(row)
        if len(out) > 50_000:
            yield pd.DataFrame(out, columns=["a", "b", "sim"])
            out = []
    if len(held) > 1:
        out += join()
    if out:
        yield pd.DataFrame(out, columns=["a", "b", "sim"])


def _both(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("a").alias("node"), F.col("b").alias("nbr"), "sim").unionByName(pairs.select(F.col("b").alias("node"), F.col("a").alias("nbr"), "sim"))


def _lists(found: DataFrame, state: DataFrame | None, base: int) -> DataFrame:
    """The best of each node. found: node, nbr, sim, old; one exchange serves all three steps."""
    here = found.repartition(tasks(found.sparkSession), "node")
    one = here.groupBy("node", "nbr").agg(F.max("sim").alias("sim"), F.max("old").alias("old"))
    rank = F.row_number().over(Window.partitionBy("node").orderBy(F.desc("sim"), "nbr"))
    ranked = one.withColumn("r", rank)
    if state is None:
        return ranked.where(F.col("r") <= base).select("node", "nbr", "sim", "old")
    ranked = ranked.join(state.select("node", "width"), "node", "left")
    return ranked.where(F.col("r") <= F.coalesce("width", F.lit(base))).select("node", "nbr", "sim", "old")


def _state(graph: DataFrame, base: int) -> DataFrame:
    """(node, width, kth): how long a node's list may be, twice as long once it is full of links, and the
    similarity that a new neighbour must exceed."""
    seen = graph.groupBy("node").agg(F.min("sim").alias("low"), F.count(F.lit(1)).alias("c"), F.count_if(F.col("sim") >= COSINE).alias("links"))
    wide = F.least(F.pow(F.lit(2.0), F.floor(F.log2(F.col("links").cast("double"))) + 1), F.lit(float(LONGEST))).cast("int")
    sized = seen.withColumn("width", F.when(F.col("links") >= base, wide).otherwise(base))
    return sized.select("node", "width", F.when(F.col("c") >= F.col("width"), F.col("low")).otherwise(-2.0).alias("kth"))


def _blocks(df: DataFrame) -> DataFrame:
    return df.groupBy("kind").agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("blocks"))


def _grouped_blocks(df: DataFrame, *cols: str) -> DataFrame:
    """Rows of a kind dealt into blocks of about BLOCK, each block one row."""
    n = _blocks(df)
    dealt = df.join(n, "kind").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks"))).drop("blocks")
    return dealt.repartition(tasks(df.sparkSession), "kind", "block").groupBy("kind", "block").agg(*[F.collect_list(c).alias(c) for c in cols])


def _scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Query block against data block: links of each query, and the components they are in."""
    for pdf in batches:
        for q, qv, d, dv, mult, root in pdf[["q", "qvec", "node", "vec", "mult", "root"]].itertuples(index=False):
            q, d, mult, root = (np.asarray(x, dtype=np.int64) for x in (q, d, mult, root))
            a = np.frombuffer(b"".join(qv)).reshape(len(q), -1)
            b = np.frombuffer(b"".join(dv)).reshape(len(d), -1)
            hit = (a @ b.T >= COSINE) & (q[:, None] != d[None, :])
            n = (hit * mult).sum(axis=1)
            rows = np.flatnonzero(n)
            roots = [np.unique(root[hit[i]]).tolist() for i in rows]
            if len(rows):
                yield pd.DataFrame({"q": q[rows], "n": n[rows], "roots": roots})


def scan(queries: DataFrame, nodes: DataFrame, roots: DataFrame) -> DataFrame:
    """Exact: (q, n, roots) of the query nodes against all nodes of their kind, in blocks."""
    rooted = nodes.join(roots, "node", "left").select("node", "kind", "mult", "vec", F.coalesce("root", "node").alias("root"))
    data = _grouped_blocks(rooted, "node", "vec", "mult", "root")
    ask = _grouped_blocks(queries.select("node", "kind", "vec"), "node", "vec").select("kind", F.col("node").alias("q"), F.col("vec").alias("qvec"))
    # Each block of queries goes to each block of its kind, which stays where it is.
    aimed = ask.join(_blocks(nodes), "kind").select("kind", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1)).alias("block"), "q", "qvec")
    pairs = data.join(aimed, ["kind", "block"])
    hits = map_pandas(pairs, _scan, "q long, n long, roots array<long>")
    return hits.groupBy("q").agg(F.sum("n").alias("n"), F.array_distinct(F.flatten(F.collect_list("roots"))).alias("roots"))


def _round(nodes: DataFrame, graph: DataFrame, scratch: Scratch, base: int) -> DataFrame:
    """One round of the local join: better lists. graph: node, nbr, sim, old. A hub brings together its
    `base` nearest and REVERSE of those that have it as nearest, new ones first, if any is new."""
    spark = nodes.sparkSession
    state = scratch.table(_state(graph, base), "state")
    new = F.col("old") == 0
    forward = graph.select(F.col("node").alias("hub"), F.col("nbr").alias("node"), new.alias("new"), "sim", F.lit(False).alias("back"))
    back = graph.select(F.col("nbr").alias("hub"), "node", new.alias("new"), "sim", F.lit(True).alias("back"))
    near = forward.unionByName(back).repartition(tasks(spark), "hub")
    near = near.withColumn("live", F.max("new").over(Window.partitionBy("hub"))).where("live")
    near = near.withColumn("r", F.row_number().over(Window.partitionBy("hub", "back").orderBy(F.desc("new"), F.desc("sim"), "node")))
    near = near.where(F.col("r") <= F.when(F.col("back"), REVERSE).otherwise(base)).select("hub", "node", "new")
    near = near.join(nodes.select("node", "vec"), "node").join(state.select("node", "kth"), "node", "left")
    near = near.select("hub", "node", F.coalesce("kth", F.lit(-2.0)).alias("kth"), "new", "vec").repartition(tasks(spark), "hub").sortWithinPartitions("hub")
    better = _both(map_pandas(near, _local_join, "a long, b long, sim double"))
    found = graph.select("node", "nbr", "sim", F.lit(1).alias("old")).unionByName(better.withColumn("old", F.lit(0)))
    out = scratch.table(_lists(found, state, base), "graph")
    scratch.drop(state)
    return out


def _joining(edges: DataFrame, exact: DataFrame) -> DataFrame:
    """The graph's links, and from each compared node to the components it has links into."""
    return edges.unionByName(exact.select(F.col("q").alias("u"), F.explode("roots").alias("v")))


def _large(nodes: DataFrame, edges: DataFrame, roots: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame, DataFrame]:
    """What blocks say of all nodes of large components, which nodes these are, and the components then."""
    spark, joined = nodes.sparkSession, roots
    exact, seen = spark.createDataFrame([], "q long, n long, roots array<long>"), spark.createDataFrame([], "node long")
    while True:
        large = joined.groupBy("root").agg(F.count(F.lit(1)).alias("c")).where(F.col("c") > LARGE).select("root")
        fresh = scratch.table(joined.join(large, "root").select("node").join(seen, "node", "left_anti"), "fresh")
        if not fresh.head(1):
            return exact, seen, joined
        exact = scratch.table(exact.unionByName(scan(nodes.join(fresh, "node"), nodes, roots)), "exact")
        seen = seen.unionByName(fresh)
        joined = components(_joining(edges, exact), scratch)


def _counts(counts: DataFrame, exact: DataFrame) -> DataFrame:
    """(node, n): links by the graph, or by the comparison in blocks where there was one."""
    both = counts.select(F.col("u").alias("node"), "n").join(exact.select(F.col("q").alias("node"), F.col("n").alias("m")), "node", "full_outer")
    return both.select("node", F.coalesce("m", "n").alias("n"))


def _recall(truth: DataFrame, by_node: DataFrame, exact: DataFrame) -> float:
    """Mean share of links found: of all asked rows or of those not compared in blocks, the lesser."""
    share = F.least(F.lit(1.0), F.coalesce("n", F.lit(0)) / F.col("t"))
    asked = truth.join(by_node, "node", "left").join(exact.select(F.col("q").alias("node"), F.lit(True).alias("sure")), "node", "left")
    return min((x for x in asked.agg(F.avg(share), F.avg(F.when(F.col("sure").isNull(), share))).first() if x is not None), default=1.0)


def near_dedup(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", recall: float = 0.97, with_audit: bool = False):
    """One row per input row: id, n_links, component_id, kept. with_audit: also the measured recall."""
    spark = df.sparkSession
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")
    scratch = Scratch(spark)
    raw = scratch.table(nodes_of(df, id_col, vec_col, label_col), "raw")
    nodes = scratch.table(map_pandas(raw, _prepare, "node long, kind string, mult long, ask boolean, vec binary, codes array<long>"), "nodes")
    total = nodes.count()
    bits = min(ORDER_BITS, max(0, round(math.log2(max(1, total / (4 * BUCKET))))))
    placed = nodes.select("node", "kind", "vec", F.posexplode("codes").alias("order", "code")).withColumn("bucket", F.shiftright("code", ORDER_BITS - bits))
    sizes = placed.groupBy("order", "kind", "bucket").agg(F.ceil(F.count(F.lit(1)) / BUCKET).alias("salts"))
    placed = placed.join(sizes, ["order", "kind", "bucket"]).withColumn("salt", F.pmod(F.xxhash64("node"), F.col("salts")))
    placed = placed.repartition(tasks(spark), "order", "kind", "bucket", "salt").sortWithinPartitions("order", "kind", "bucket", "salt", "code", "node")
    first = _both(map_pandas(placed.select("order", "kind", "bucket", "salt", "node", "vec"), _adjacent, "a long, b long, sim double")).withColumn("old", F.lit(0))

    base, rounds, measured = LIST, 4, None
    graph = scratch.table(_lists(first, None, base), "graph")
    none = spark.createDataFrame([], "node long, root long")
    truth = scratch.table(scan(nodes.where("ask"), nodes, none).select(F.col("q").alias("node"), F.col("n").alias("t")), "truth")
    while True:
        links = -1
        for _ in range(rounds):
            new = _round(nodes, graph, scratch, base)
            scratch.drop(graph)
            graph = new
            now = graph.where(F.col("sim") >= COSINE).count()
            if now == links:
                break
            links = now
        edges = scratch.table(graph.where(F.col("sim") >= COSINE).select(F.least("node", "nbr").alias("u"), F.greatest("node", "nbr").alias("v")).distinct(), "edges")
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        counts = both.join(nodes.select(F.col("node").alias("v"), "mult"), "v").groupBy("u").agg(F.sum("mult").alias("n"))
        roots = components(edges, scratch)
        exact, seen, joined = _large(nodes, edges, roots, scratch)
        by_node = scratch.table(_counts(counts, exact), "counts")
        measured = _recall(truth, by_node, exact)
        if measured >= recall:
            break
        if base >= LONGEST:
            rest = scan(nodes.join(seen, "node", "left_anti"), nodes, roots)
            exact = scratch.table(exact.unionByName(rest), "exact")
            joined = components(_joining(edges, exact), scratch)
            by_node = scratch.table(_counts(counts, exact), "counts")
            measured = _recall(truth, by_node, exact)
            break
        base, rounds = base * 2, rounds * 2
        graph = scratch.table(graph.withColumn("old", F.lit(0)), "graph")

    whole = raw.select("node", "low", "mult").join(by_node, "node", "left").join(joined, "node", "left")
    whole = whole.select("node", "low", (F.coalesce("n", F.lit(0)) + F.col("mult") - 1).alias("n_links"), F.coalesce("root", "node").alias("root"))
    tops = whole.groupBy("root").agg(F.min("low").alias("component_id"))
    members = members_of(df, raw, id_col, vec_col, label_col).join(whole.join(tops, "root"), "node", "left")
    out = members.select(
        F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"), F.coalesce("component_id", F.col("id").cast("long")).alias("component_id"),
    ).withColumn("kept", F.col(id_col).eqNullSafe(F.col("component_id")))
    return (out, measured) if with_audit else out


def members_of(df: DataFrame, nodes: DataFrame, id_col: str, vec_col: str, label_col: str) -> DataFrame:
    """(id, node): each row's node, null for those that link with nothing."""
    rows = df.select(F.col(id_col).alias("id"), F.col(vec_col).cast("array<double>").alias("v"), F.col(label_col).cast("string").alias("label"))
    linkable = F.col("id").isNotNull() & F.col("label").isNotNull()
    named = rows.where(linkable).join(nodes.select("label", "v", "node"), ["label", "v"], "left").select("id", "node")
    return named.unionByName(rows.where(~linkable).select("id", F.lit(None).cast("long").alias("node")))
