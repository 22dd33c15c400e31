"""Traps of text, hashing and percentile semantics, against plain Python."""

import hashlib
import json
import random
import unicodedata

import pytest
from pyspark.sql import functions as F

from millrace.functions import hashing, stats, text


def column(spark, values, expr, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[0] for r in df.select("i", expr(F.col("v")).alias("x")).orderBy("i").select("x").collect()]


def test_normalize_text(spark):
    samples = ["  Ａ—B–c  d\t\n", "x‑y", "a\x1cb", "ﬁ Straße", "", None]

    def plain(t):
        if t is None:
            return None
        t = unicodedata.normalize("NFKC", t).translate({0x2014: "-", 0x2013: "-", 0x2011: "-", 0xA0: " "})
        return " ".join(t.split()).lower()

    assert column(spark, samples, text.normalize_text) == [plain(t) for t in samples]


def test_unsafe_covers_what_nfkc_changes():
    import re

    safe = [chr(c) for c in range(0x500) if not re.match(text.UNSAFE, chr(c))]
    assert len(safe) > 300 and all(unicodedata.normalize("NFKC", c) == c for c in safe)
    assert not any(unicodedata.combining(c) for c in safe)


def test_casefold_differs_from_lower(spark):
    assert column(spark, ["Straße  X"], text.casefold_key) == ["strasse x"]


def test_shingles(spark):
    got = column(spark, ["a b c d e", "a b", "", "é ä ß w é ä ß w"], lambda c: text.shingles(text.words(c), 4))
    assert [sorted(x) for x in got] == [["a b c d", "b c d e"], ["a b"], [], ["w é ä ß", "ß w é ä", "ä ß w é", "é ä ß w"]]


def test_pii(spark):
    t = "tel +7 (912) 345-67-89, a.b@x.org; Дата рождения: 01.02.1990; приказ от 23.11.2021"
    assert column(spark, [t], text.scrub) == ["tel [PHONE], [EMAIL]; Дата рождения: [DATE]; приказ от 23.11.2021"]
    df = spark.createDataFrame([(t,)], "v string").select(*[c.alias(n) for n, c in text.pii_hits(F.col("v")).items()])
    assert tuple(df.first()) == (1, 1, 1)


def test_fences_and_syntax(spark):
    got = column(spark, ["```python\nx = 1\n```\n```", "x = 1"], text.strip_fence)
    assert [tuple(r) for r in got] == [("x = 1", True), ("x = 1", False)]

    def by_hand(t):
        t = t.strip()
        if not t.startswith("```"):
            return t, False
        lines = t.splitlines()[1:]
        while lines and lines[-1].strip().startswith("```"):
            del lines[-1]
        return "\n".join(lines).strip(), True

    rng = random.Random(4)
    cases = ["  x = 1\n", "```", "```\n```", "```py\r\na\r\n\r\n```\x85 ```\n", "", "\x1c\u2003a\u00a0", "```a\n b\n```x\ny\n```"] + ["".join(rng.choice(["```", "\n", " ", "a", "\r\n", "\t", "\u2028", "\x1d", "`"]) for _ in range(12)) for _ in range(300)]
    assert [tuple(r) for r in column(spark, cases, text.strip_fence)] == [by_hand(t) for t in cases]
    assert column(spark, cases, text.line_count) == [len(t.splitlines()) for t in cases]
    assert column(spark, cases, text.strip) == [t.strip() for t in cases]
    joined = column(spark, [None, " \n", " 1 2 "], lambda c: text.join_input(F.lit("do"), c))
    assert joined == ["do", "do", f"do\n\n{text.INPUT_HEADING}\n1 2"]
    assert column(spark, ["x = 1", "x = = 1", "", None], text.parses) == [True, False, True, True]


def test_sha1_mod(spark):
    values = [f"text {i}" for i in range(50)]
    for n in (2, 5, 7):
        assert column(spark, values, lambda c, n=n: hashing.sha1_mod(c, n)) == [int(hashlib.sha1(v.encode()).hexdigest(), 16) % n for v in values]


def test_canonical_forms(spark):
    v = '{"b": 1, "a": [1, {"z": "é", "y": null}]}'
    a, b = column(spark, [v, "no"], hashing.canonical_json)[0], column(spark, [v], hashing.fingerprint_json)[0]
    assert a == json.dumps(json.loads(v), sort_keys=True, separators=(",", ":"), ensure_ascii=False)
    assert a != b and json.loads(a) == json.loads(b)
    assert column(spark, ["no", "NaN"], hashing.canonical_json) == [None, None]


@pytest.mark.parametrize("n", [1, 2, 10, 101])
def test_percentiles(spark, n):
    rng = random.Random(n)
    v = [rng.randrange(30) for _ in range(n)]
    s = sorted(v)
    df = spark.createDataFrame([(x,) for x in v], "x int")
    got = stats.at_positions(df, "x", {"a": stats.nearest_rank(0.9), "b": stats.floor_index(0.95), "c": stats.upper_median()}).first()
    assert tuple(got) == (s[min(n - 1, int(0.9 * n))], s[int(0.95 * (n - 1))], s[n // 2])


def test_histogram_quantile(spark):
    df = spark.createDataFrame([("a", 0.1, 5), ("a", 0.2, 10), ("a", float("inf"), 10), ("b", 0.1, 0), ("b", float("inf"), 0), ("c", 1.0, 1), ("c", float("inf"), 9)], "k string, le double, cum long")
    got = {r[0]: r[1] for r in stats.histogram_quantile(df, 0.95, ["k"]).collect()}
    assert got["a"] == pytest.approx(0.19) and got["b"] is None and got["c"] == 1.0


def test_cache_key_ignores_path(tmp_path):
    a, b = tmp_path / "a", tmp_path / "b"
    a.write_bytes(b"x"), b.write_bytes(b"x")
    assert hashing.cache_key(a, {"k": 1}) == hashing.cache_key(b, {"k": 1}) != hashing.cache_key(a, {"k": 2})
