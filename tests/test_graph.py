"""Components, keeping decided by component, and bands of sketches, against brute force."""

import random

import pytest
from pyspark.sql import functions as F

from millrace.operators import graph, near
from millrace.scratch import Scratch


def reached(links):
    root = {}
    for u, v in links:
        root.setdefault(u, u), root.setdefault(v, v)
    changed = True
    while changed:
        changed = False
        for u, v in links:
            low = min(root[u], root[v])
            if root[u] != low or root[v] != low:
                root[u] = root[v] = low
                changed = True
    return root


def scanned(links):
    earlier = {}
    for a, b in links:
        earlier.setdefault(b, []).append(a)
    gone = set()
    for b in sorted(earlier):
        if any(a not in gone for a in earlier[b]):
            gone.add(b)
    return gone


def links_of(rng, n, m):
    pairs = {tuple(sorted(rng.sample(range(n), 2))) for _ in range(m)}
    return sorted(pairs) + [(1000 + i, 1001 + i) for i in range(60)] + [(2000, 2001 + i) for i in range(60)]


@pytest.mark.parametrize("one_task", [500_000, 0])
def test_components(spark, monkeypatch, one_task):
    monkeypatch.setattr(graph, "ONE_TASK", one_task)
    rng = random.Random(3)
    links = [(a, b) if rng.random() < 0.5 else (b, a) for a, b in links_of(rng, 80, 50)] + [(5, 5)]
    df = spark.createDataFrame(links, "u long, v long").repartition(5)
    got = {r["node"]: r["root"] for r in graph.components(df, Scratch(spark)).collect()}
    assert got == reached([x for x in links if x[0] != x[1]])
    assert graph.components(df.limit(0), Scratch(spark)).count() == 0


@pytest.mark.parametrize("decided", [500_000, 5])
def test_what_a_scan_would_drop(spark, monkeypatch, decided):
    monkeypatch.setattr(graph, "DECIDED", decided)
    for seed in range(2):
        links = links_of(random.Random(seed), 60, 80)
        df = spark.createDataFrame(links, "a long, b long").repartition(5)
        assert {r[0] for r in graph.dropped_in_order(df, Scratch(spark)).collect()} == scanned(links)


def test_a_long_chain_needs_few_tables(spark):
    n = 20_000
    chain = spark.range(n - 1, numPartitions=8).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    scratch = Scratch(spark)
    gone = graph.dropped_in_order(chain, scratch)
    assert gone.count() == n // 2 and gone.where("k % 2 = 0").count() == 0
    assert scratch.n < 10


def test_bands_find_pairs_and_crowds(spark, monkeypatch):
    rng = random.Random(6)
    words = lambda n: [f"w{rng.randrange(900)}" for _ in range(n)]
    base, texts = words(120), []
    for _ in range(25):  # a crowd of near copies
        w = list(base)
        w[rng.randrange(120)] = "x"
        texts.append(" ".join(w))
    for _ in range(40):
        w = words(60)
        texts += [" ".join(w), " ".join([*w, "more"])]
    texts += [None, "", "one two"]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, t string")
    exact = {(r["a"], r["b"]) for r in near.pairs_within(df, "id", "t").collect()}
    assert len(exact) > 200
    for bucket in (200, 4):
        monkeypatch.setattr(near, "BUCKET", bucket)
        found = {(r["a"], r["b"]) for r in near.pairs_by_bands(df, "id", "t").collect()}
        assert found <= exact and len(found) >= 0.97 * len(exact)
    sets = near.sets(df, "id", "t", 4)
    one = {r["k"]: r["sig"] for r in near.sketches(sets, 8).collect()}
    assert one == {r["k"]: r["m"] for r in sets.where(F.size("s") > 0).select("k", near.minhash(F.col("s"), 8).alias("m")).collect()}
