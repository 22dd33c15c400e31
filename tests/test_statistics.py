"""Order statistics by selection, and the keyword automaton, against brute force."""

import math
import os
import random
import subprocess
import sys

import pytest
from pyspark.sql import functions as F

from millrace.functions import stats
from millrace.operators import curate



def at():
    return {"first": F.lit(0), "low": F.floor(F.lit(0.1) * F.col("_n")), "middle": F.floor(F.col("_n") / 2), "last": F.col("_n") - 1}


def order(v):
    return (math.isnan(v), 0 if math.isnan(v) else v)


@pytest.mark.parametrize("cells", [4096, 3])
def test_selection(spark, cells):
    rng = random.Random(1)
    odd = [float("inf"), float("-inf"), float("nan"), 0.0, 1.7e308, -1.7e308, 5e-324, 1e-310]
    rows = [(g, rng.choice([rng.gauss(0, 1), rng.gauss(0, 1) * 10.0 ** rng.randrange(-300, 300), float(rng.randrange(4)), rng.choice(odd)])) for g in ("a", "b", None) for _ in range(200)]
    rows += [("one", 5.0), ("same", 2.0), ("same", 2.0), ("odd", float("nan")), ("ends", float("inf")), ("ends", float("-inf")), ("none", None)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(4)
    got = {r["g"]: r for r in stats.refined(df.where("v is not null"), "v", at(), ["g"], cells).collect()}
    for g in {r[0] for r in rows} - {"none"}:
        vs = sorted((v for h, v in rows if h == g and v is not None), key=order)
        n = len(vs)
        want = [vs[0], vs[int(0.1 * n)], vs[n // 2], vs[-1]]
        assert all(a == b or (math.isnan(a) and math.isnan(b)) for a, b in zip([got[g][k] for k in at()], want)), g
    assert "none" not in got


def test_selection_of_whole_numbers_beyond_doubles(spark):
    values = [2**62 + i for i in range(50)] + [-(2**62) - i for i in range(50)]
    df = spark.createDataFrame([(v,) for v in values], "v long").repartition(3)
    got = stats.refined(df, "v", at(), []).first()
    assert [got[k] for k in at()] == [sorted(values)[i] for i in (0, 10, 50, 99)]
    assert stats.refined(df.limit(0), "v", at(), []).count() in (0, 1)


def test_both_ways_agree(spark, sf, monkeypatch):
    df = spark.read.parquet(f"{sf}/orders.parquet")
    shares = {"p0": 0.0, "p31": 0.31, "p99": 0.99, "p100": 1.0}
    few = stats.percentiles(df, "o_totalprice", shares, ["o_orderpriority"]).collect()
    monkeypatch.setattr(stats, "FEW", 10)
    many = stats.percentiles(df, "o_totalprice", shares, ["o_orderpriority"]).collect()
    assert sorted(few) == sorted(many) and len(few) == 5


SMALL_HEAP = """
import sys, tempfile
from millrace.session import build
from millrace.functions import stats
from pyspark.sql import functions as F
spark = build("heap", 4)
spark.sparkContext.setCheckpointDir("file://" + tempfile.mkdtemp(dir=sys.argv[1]))
n = 10_000_000
df = spark.range(n, numPartitions=16).select((F.pmod(F.col("id") * 7_368_787, F.lit(n)) * 1.5).alias("v"))
got = stats.percentiles(df, "v", {"q": 0.25, "m": 0.5}).first()
assert (got["q"], got["m"]) == ((n - 1) * 0.25 * 1.5, (n - 1) * 0.5 * 1.5), got
print("held")
"""


def test_ten_million_values_of_one_group_under_a_small_heap(tmp_path):
    out = subprocess.run([sys.executable, "-c", SMALL_HEAP, str(tmp_path)], env=os.environ | {"MILLRACE_DRIVER_MEMORY": "512m"}, capture_output=True, text=True, timeout=600)
    assert "held" in out.stdout, out.stderr[-2000:]


RULES = [(3, "c", "cc"), (1, "a", "abc"), (2, "b", "bc"), (1, "a", "zzz"), (9, "z", "é"), (4, "n", None)]


@pytest.mark.parametrize("most", [16 << 20, 3])
def test_first_rule_of_a_table(spark, monkeypatch, most):
    monkeypatch.setattr(curate, "AUTOMATON_BYTES", most)
    texts = ["xABCx", "bc cc", "cc", "nothing", "", None, "É", "ccbcZZZ"]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, t string").repartition(3)
    rules = spark.createDataFrame(RULES, "rule long, label string, keyword string")
    got = {r["id"]: r["topic"] for r in curate.classify_by_table(df, [F.col("t")], rules).collect()}
    assert [got[i] for i in range(len(texts))] == ["a", "b", "c", None, None, None, "z", "a"]
    none = curate.classify_by_table(df, [F.col("t")], rules.limit(0)).collect()
    assert {r["topic"] for r in none} == {None} and len(none) == len(texts)
    last = rules.unionByName(spark.createDataFrame([(7, "any", "")], rules.schema))
    assert {r["id"]: r["topic"] for r in curate.classify_by_table(df, [F.col("t")], last).collect()}[3] == "any"


def test_rules_as_the_expression(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    rows = [(i, label, w) for i, (label, words) in enumerate(curate.EXAMPLE_RULES) for w in words]
    rules = spark.createDataFrame(rows, "rule long, label string, keyword string")
    got = curate.classify_by_table(docs, [F.col("text")], rules).select("doc_id", "topic")
    assert got.exceptAll(docs.select("doc_id", curate.classify([F.col("text")], curate.EXAMPLE_RULES).alias("topic"))).count() == 0
