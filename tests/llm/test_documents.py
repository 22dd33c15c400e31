"""Operators over documents: awkward rows (nulls, empty, long, repeated, clashing names), brute force, recovery of results."""

import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept boolean, size string, score int, _id int, shard string, copies int"


def words(rng, n, k=400):
    return " ".join(f"{'aeiou'[rng.randrange(5)]}w{rng.randrange(k)}" for _ in range(n))


def rows():
    rng = random.Random(11)
    base = words(rng, 160)
    out = []
    for i in range(60):
        w = base.split()
        for _ in range(rng.randrange(12)):
            w[rng.randrange(len(w))] = f"n{rng.randrange(9999)}"
        out.append(" ".join(w))
    out += [words(rng, rng.randrange(1, 300)) for _ in range(50)]
    out += [None, "", "  \t ", "a", "a  b", "A B", "a\nb", "one two three four five", "ONE two  three four five", "!!!", "漢字 かな", "x" * 3000, "ab" * 40_000, out[3], out[3], "é" * 900, base + " " + words(rng, 30)]
    data = [(i, t, [None, "en", "fr"][i % 3], [None, "b", "a", "é"][i % 4], None, True, "s", 1, 2, "q", 3) for i, t in enumerate(out)]
    return data + [data[3], (None, "a", None, None, None, None, None, None, None, None, None), (None, None, "en", "a", 1, None, None, None, None, None, None)]


ROWS = rows()
KEYED = [(r[0], r[1] or "") for r in ROWS]


@pytest.fixture(scope="module")
def docs(spark):
    df = spark.createDataFrame(ROWS, SCHEMA)
    path = spark.sparkContext._jsc.sc().getCheckpointDir().get() + "/docs"
    df.repartition(3, "n_chars", "doc_id").write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def table(df):
    return df.toPandas().replace({np.nan: None}).to_dict("records")


def by_id(df):
    return {r["doc_id"]: r for r in table(df) if r["doc_id"] is not None}


def norm(t):
    import re

    return re.sub(r"[\x20\x09-\x0D]+", " ", t)


@pytest.mark.parametrize("hits", [40, 2])
def test_exact_dedup(spark, docs, empty, monkeypatch, hits):
    from millrace.llm import exact_dedup as m

    if hits == 2:  # the path for texts with very many copies
        monkeypatch.setattr(m, "HEAVY_LEAST", 2)
    groups = defaultdict(list)
    for i, t in KEYED:
        groups[norm(t)].append(i)
    got = m.exact_dedup(docs)
    assert got.columns == [c for c in docs.columns if c != "kept"] + list(m.OUT)
    out = table(got)
    assert len(out) == len(ROWS)
    for r in out:
        g = groups[norm(r["text"] or "")]
        assert r["group_size"] == len(g) and r["text_sha256"] == hashlib.sha256(norm(r["text"] or "").encode()).hexdigest()
        assert r["keep_id"] == min((x for x in g if x is not None), default=None)
        if r["kept"]:
            assert r["doc_id"] == r["keep_id"]
    assert sum(r["kept"] for r in out) == len(groups)
    assert m.exact_dedup(empty).count() == 0


def test_sharding(spark, docs, empty, tmp_path):
    from millrace.llm import sharding as m

    out = table(m.shard_documents(docs, 8))
    assert len(out) == len(ROWS)
    for r in out:
        assert r["law"] == "key" and r["grown_shard"] in (r["shard"], 8)
    slots = defaultdict(list)
    for r in out:
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in out) == Counter((i, len(t.encode()) + 1, zlib.crc32(t.encode())) for i, t in KEYED)
    assert m.shard_documents(empty).count() == 0
    m.write_shards(docs, str(tmp_path / "s"))
    assert spark.read.parquet(str(tmp_path / "s")).count() == len(ROWS)


def test_tree_moves_only_into_grown_subtrees(spark):
    from millrace.llm import sharding as m

    keys = spark.range(4000).withColumnRenamed("id", "k")
    for n in (1, 5, 8, 9):
        both = m.place(m.place(keys, "k", m.tree(n), "a"), "k", m.tree(n + 1), "b").collect()
        assert all(r["b"] in (r["a"], n) for r in both)
        assert abs(sum(r["b"] == n for r in both) / 4000 - 1 / (n + 1)) < 0.04
    heavier = m.place(m.place(keys, "k", m.tree(8), "a"), "k", m.tree(8, weights={3: 3.0}), "b").collect()
    assert all(r["b"] in (r["a"], 3) for r in heavier) and abs(sum(r["b"] == 3 for r in heavier) / 4000 - 0.3) < 0.04


def test_slots_over_many_groups(spark, monkeypatch):
    from millrace.llm import sharding as m

    monkeypatch.setattr(m, "RANK_ROWS", 10)
    out = table(m.shard_documents(spark.range(900).select(F.col("id").alias("doc_id"), F.lit("x").alias("text"))))
    slots = defaultdict(list)
    for r in out:
        slots[r["shard"]].append(r["slot"])
    assert len(out) == 900 and all(sorted(s) == list(range(len(s))) for s in slots.values())


@pytest.mark.parametrize("salted", [False, True])
def test_mixing(spark, docs, empty, monkeypatch, salted):
    from millrace.llm import mixing as m

    if salted:
        monkeypatch.setattr(m, "RANK_ROWS", 4)
    df = docs.where("doc_id is not null").dropDuplicates(["doc_id"])
    out = table(m.mix(df))
    src = {r[0]: r[3] for r in ROWS}
    assert len(out) == df.count() and all(r["taken"] == r["copies"] * r["size"] and 0 <= r["copies"] <= 3 for r in out)
    sizes, taken, target = Counter(), Counter(), {}
    for r in out:
        s = src[r["doc_id"]]
        assert r["size"] == len((dict(KEYED)[r["doc_id"]]).encode().split())
        sizes[s] += r["size"]
        taken[s] += r["taken"]
        target[s] = r["target"]
    order = sorted((s for s in sizes if s is not None)) + [None]
    weight, caps = {s: 1 + i % 3 for i, s in enumerate(order)}, {}
    while True:
        rest, w = sum(sizes.values()) - sum(caps.values()), sum(weight[s] for s in order if s not in caps)
        new = {s: 3 * sizes[s] for s in order if s not in caps and rest * weight[s] / w > 3 * sizes[s]}
        if not new:
            break
        caps.update(new)
    for s in order:
        assert target[s] == pytest.approx(caps.get(s, rest * weight[s] / w))
        assert abs(taken[s] - target[s]) <= max(3, 0.01 * target[s])
    assert table(m.mix(df).orderBy("doc_id")) == table(m.mix(df).orderBy("doc_id"))
    assert m.mix(docs).count() == len(ROWS) and m.mix(empty).count() == 0
    carried = m.mix(df, carry=df.columns).select("_in.*")
    assert carried.columns == df.columns


def test_language_id(spark, docs, empty):
    from millrace.llm import langid as m

    out = table(m.identify(docs, with_spans=True))
    assert len(out) == len(ROWS) and all(0 <= r["score"] <= 1 for r in out)
    letters = {i: any(c.isalpha() for c in t) for i, t in KEYED}
    for r in out:
        assert (r["lang_pred"] == "und") == (not letters.get(r["doc_id"], False)) or r["doc_id"] is None
        assert r["held_out"] == (zlib.crc32(("" if r["doc_id"] is None else str(int(r["doc_id"]))).encode()) % 4 == 2)
    assert m.identify(empty).count() == 0
    carried = m.identify(docs, carry=docs.columns)
    assert carried.columns == [c for c in docs.columns if c not in ("score",)] + ["lang_pred", "score", "held_out"]
    assert carried.select("doc_id", "text").exceptAll(docs.select("doc_id", "text")).count() == 0


def test_language_draw_is_never_empty_in_silence(spark):
    from millrace.llm import langid as m

    share = (m.highest(5000, 10**11) + 2**63) / 2**64
    assert abs(share * 10**11 - 5000) < 1 and m.highest(5000, 3) == 2**63 - 1
    df = spark.createDataFrame([(1, "a text", "en")], "doc_id long, text string, lang string")
    assert m.fit(df).langs == ["en"]
    with pytest.raises(ValueError):
        m.fit(df, per_lang=0)


def test_language_draw_with_many_null_and_repeated_ids(spark):
    from millrace.llm import langid as m

    one = spark.range(60_000, numPartitions=4).selectExpr("cast(null as long) as doc_id", "'the same text, again and again' as text", "'en' as lang")
    two = spark.range(60_000, numPartitions=4).selectExpr("4L as doc_id", "concat('der Text Nummer ', id) as text", "'de' as lang")
    both = one.unionByName(two).unionByName(spark.createDataFrame([(1, "123", "none"), (2, None, "fr")], "doc_id long, text string, lang string"))
    model = m.fit(both, per_lang=300)
    assert model.langs == ["de", "en"]
    mark = F.xxhash64(F.lit(""), F.lit("the same text, again and again"), F.monotonically_increasing_id())
    assert 200 < one.where(mark <= m.highest(300, 60_000)).count() < 400
    out = m.identify(both.where("doc_id is null or doc_id = 1 or text like '%77'"), labelled=both, carry=["doc_id", "lang"]).groupBy("lang", "lang_pred").count().collect()
    assert {(r[0], r[1]) for r in out} == {("en", "en"), ("de", "de"), ("none", "und")}
    assert max(r[2] for r in out) == 60_000


def test_language_spans_and_scripts(spark):
    from millrace.llm import langid as m

    en, fr, ru = "the cat was on that other thing with this", "le chat était sur une autre chose avec des", "этот кот был на другой вещи и там"
    train = spark.createDataFrame([(i, t, l) for i, (t, l) in enumerate([(en, "en"), (fr, "fr"), (ru, "ru")] * 5)], "doc_id long, text string, lang string")
    model = m.fit(train)
    mixed = " ".join([en] * 6) + " " + " ".join([fr] * 9) + " кот там"
    got = table(m.predict(spark.createDataFrame([(1, mixed)], "doc_id long, text string"), model, with_spans=True))[0]
    assert got["lang_pred"] == "fr" and 0.4 < got["score"] < 0.8
    assert [s["lang"] for s in got["spans"]] == ["en", "fr", "ru"] and got["spans"][0]["end"] <= got["spans"][1]["start"]


def test_viterbi_is_optimal():
    from millrace.llm.langid import viterbi

    rng = np.random.default_rng(4)
    scores, doc = rng.normal(size=(400, 3)) * 4, np.sort(rng.integers(0, 25, 400))
    labels = viterbi(scores, doc, 25, 5.0)

    def value(path, s):
        return s[np.arange(len(path)), path].sum() - 5.0 * (np.diff(path) != 0).sum()

    for d in np.unique(doc):
        s = scores[doc == d]
        best = s[0].copy()
        for row in s[1:]:
            best = np.maximum(best, best.max() - 5.0) + row
        assert value(labels[doc == d], s) == pytest.approx(best.max())


def test_language_held_out_accuracy(spark, sf):
    from millrace.llm.queries import op3_language_id

    truth = {r[0]: r[1] for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang").collect()}
    out = [r for r in table(op3_language_id(spark, sf)) if r["held_out"]]
    assert sum(truth[r["doc_id"]] == r["lang_pred"] for r in out) >= 0.97 * len(out)


def components(sets, same=lambda a, b: 100 * len(a & b) >= 80 * len(a | b)):
    ids = list(sets)
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for n, i in enumerate(ids):
        for j in ids[:n]:
            if sets[i] and sets[j] and same(sets[i], sets[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def grams(t):
    w = t.encode().lower().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def test_ngram_join(spark, docs, empty):
    from millrace.llm.ngram_join import ngram_join

    sets = {i: grams(t) for i, t in KEYED if i is not None}
    want = components(sets)
    out = table(ngram_join(docs))
    assert len(out) == len(ROWS)
    for r in out:
        if r["doc_id"] is not None:
            assert (r["n_shingles"], r["component_id"]) == (len(sets[r["doc_id"]]), want[r["doc_id"]])
    assert {r["component_id"] for r in out if r["doc_id"] is None} == {None, want[next(i for i, t in KEYED if t == "a")]}
    assert ngram_join(empty).count() == 0


def test_frequent_grams_pass_through_a_fragment(monkeypatch):
    from millrace.llm import ngram_join as m

    rng = random.Random(12)
    monkeypatch.setattr(m, "HOT", 6)
    monkeypatch.setattr(m, "HELD", 20)
    sets = [sorted({rng.choice([1, 2, 3, rng.randrange(4, 60)]) for _ in range(8)}) for _ in range(40)]
    count = Counter(g for s in sets for g in s)
    lots = [pd.DataFrame([(0, u, np.array([g << 16 for g in sets[u]], dtype=np.uint64).tobytes(), None, None) for u in range(a, a + 4)], columns=["frag", "uid", "data", "dfs", "meta"]) for a in range(0, 40, 4)]
    got = defaultdict(dict)
    for pdf in m._count_fragment(iter(lots)):
        for u, data, dfs in pdf[["uid", "data", "dfs"]].itertuples(index=False):
            got[u].update(zip((np.frombuffer(data, np.uint64) >> np.uint64(16)).tolist(), np.frombuffer(dfs, np.uint32).tolist()))
    assert any(n >= 6 for n in count.values())
    assert {u: x for u, x in got.items()} == {u: w for u, s in enumerate(sets) if (w := {g: count[g] if count[g] < 6 else m.MANY for g in s if count[g] > 1})}


def test_long_texts_have_whole_sets(monkeypatch):
    from millrace.llm import ngram_join as m

    rng = random.Random(9)
    texts = [words(rng, n, 50).encode() for n in (3, 900, 5, 2000, 4)] + [b"", b" \n", b"z" * 400, b"q " * 300, b" a\tb  " * 70]
    whole = m.gram_entries(texts)
    for lot in (30, 64, 500):
        monkeypatch.setattr(m, "LOT", lot)
        assert (m.gram_entries(texts) == whole).all()


def test_ngram_join_reads_a_plain_scan(spark, sf, monkeypatch):
    from millrace.llm import ngram_join, queries

    monkeypatch.setattr(ngram_join, "ngram_join", lambda df: df)
    assert "Repartition" not in queries.op5_ngram_join(spark, sf)._jdf.queryExecution().logical().toString()


def test_components(spark):
    from millrace.llm._common import Scratch
    from millrace.llm.components import components as cc

    rng = random.Random(6)
    links = [(i, i + 1) for i in range(100, 160)] + [(rng.randrange(90), rng.randrange(90)) for _ in range(60)] + [(500, x) for x in range(501, 560)]
    sets = {x: {x} for e in links for x in e}
    root = {x: x for x in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in links:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    got = {r["node"]: r["root"] for r in cc(spark.createDataFrame(links, "u long, v long"), Scratch(spark)).collect()}
    assert all(got.get(x, x) == find(x) for x in sets)
    assert cc(spark.createDataFrame([], "u long, v long"), Scratch(spark)).count() == 0


def windows(texts, w):
    count = Counter(t[i : i + w] for t in texts for i in range(len(t) - w + 1))
    out = []
    for t in texts:
        gone = bytearray(len(t))
        for i in range(len(t) - w + 1):
            if count[t[i : i + w]] > 1:
                gone[i : i + w] = b"\1" * w
        out.append(gone)
    return out


@pytest.mark.parametrize("runs", [4000, 1])
def test_suffix_dedup(spark, docs, empty, monkeypatch, runs):
    from millrace.llm import suffix_dedup as m

    rows_ = KEYED
    df = spark.createDataFrame(rows_, "doc_id long, text string").withColumn("digest", F.lit("clash"))
    texts = [t.encode() for _, t in rows_]
    want = Counter()
    for (i, _), t, gone in zip(rows_, texts, windows(texts, 400)):
        spans = sum(g and (k == 0 or not gone[k - 1]) for k, g in enumerate(gone))
        want[(i, len(t), sum(gone), spans, hashlib.sha256(bytes(b for b, g in zip(t, gone) if not g)).hexdigest())] += 1
    if runs == 1:  # every group is salted and meets again in the second level
        monkeypatch.setattr(m, "GROUP_BYTES", 1)
    got = Counter((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in table(m.suffix_dedup(df)))
    assert got == want
    if runs == 4000:
        assert m.suffix_dedup(empty).count() == 0
        longest = by_id(m.suffix_dedup(docs.where("length(text) > 50000")))
        assert all(r["n_removed"] == r["n_bytes"] for r in longest.values())
        one = table(m.suffix_dedup(df, with_bytes=True))
        assert all(hashlib.sha256(bytes(r["kept"])).hexdigest() == r["kept_sha256"] and len(r["spans"]) == r["n_spans"] for r in one)


def test_suffix_dedup_of_long_runs_and_many_copies(spark):
    from millrace.llm import suffix_dedup as m

    ones = [(i, "a" * (1_000_000 + i)) for i in range(12)]  # one digit throughout, no two alike
    got = table(m.suffix_dedup(spark.createDataFrame(ones, "doc_id long, text string").repartition(4)))
    assert len(got) == 12 and all(r["n_removed"] == r["n_bytes"] == 1_000_000 + r["doc_id"] and r["n_spans"] == 1 for r in got)
    # Copies just below the bound of the join-free way, and one text that shares a window with them.
    rng = random.Random(8)
    shared = words(rng, 200, 4000)
    many = [(i, shared) for i in range(900)] + [(1000, words(rng, 90, 4000) + shared[:450]), (1001, words(rng, 300, 4000))]
    out = by_id(m.suffix_dedup(spark.createDataFrame(many, "doc_id long, text string").repartition(5)))
    assert all(out[i]["n_removed"] == len(shared) for i in range(900)) and out[1000]["n_removed"] == 450 and out[1001]["n_removed"] == 0


def test_batches_are_bounded_by_bytes(spark):
    from millrace.llm import _common as m

    m.small_batches(spark, 500)
    df = spark.createDataFrame([("x" * 1_000_000,)] * 60, "t string").repartition(1)
    sizes = table(m.map_pandas(df, lambda it: (pd.DataFrame({"n": [int(p["t"].str.len().sum())]}) for p in it), "n long"))
    assert max(r["n"] for r in sizes) <= m.BATCH_BYTES + 1_000_000


def test_chunk_dedup(spark, docs, empty):
    from millrace.llm import chunk_dedup as m

    first = {}
    ordered = sorted(KEYED, key=lambda x: (x[0] is not None, x[0] or 0))
    for i, t in ordered:
        for a, n in m.chunks_of(t.encode()):
            first.setdefault(t.encode()[a : a + n], (i, a, t))
    want = Counter()
    for i, t in KEYED:
        data = t.encode()
        parts = m.chunks_of(data)
        assert b"".join(data[a : a + n] for a, n in parts) == data and all(n <= m.MOST for _, n in parts)
        later = [a << 9 | n for a, n in parts if first[data[a : a + n]][:2] != (i, a)]
        if i is None:
            continue
        kept, cut = data, m.stretches(np.array(later, dtype=np.int64))
        for s, e in reversed(cut):
            kept = kept[:s] + kept[e:]
        want[(i, len(data), len(data) - len(kept), len(cut), hashlib.sha256(kept).hexdigest())] += 1
    got = Counter((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in table(m.chunk_dedup(docs)) if r["doc_id"] is not None)
    assert got == want
    assert m.chunk_dedup(empty).count() == 0


def test_chunks_resist_insertion(spark):
    from millrace.llm import chunk_dedup as m

    rng = random.Random(8)
    passage = words(rng, 60, 5000)
    t = [words(rng, 100, 5000) + " " + passage + " " + words(rng, 90, 5000), words(rng, 37, 5000) + " inserted " + passage + words(rng, 20, 5000), words(rng, 200, 5000)]
    out = by_id(m.chunk_dedup(spark.createDataFrame(list(enumerate(t)), "doc_id long, text string")))
    assert out[0]["n_removed"] == 0 and out[0]["n_shared"] >= 64 and out[1]["n_removed"] >= 64 and out[2]["n_shared"] == 0


def test_packing(spark, docs, empty):
    import public_tokenizers
    from tokenizers import Tokenizer

    from millrace.llm import packing as m

    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    df = docs.where("doc_id is not null").dropDuplicates(["doc_id"])
    ids = {i: np.array(tok.encode(t, add_special_tokens=False).ids + [0], dtype="<u4") for i, t in KEYED if i is not None}
    pieces = table(m.pack(df, with_ids=True))
    at = defaultdict(list)
    seqs = defaultdict(list)
    for p in pieces:
        part = ids[p["doc_id"]][p["start"] : p["start"] + p["length"]]
        assert p["ids_crc32"] == zlib.crc32(part.tobytes()) and list(part) == list(p["ids"]) and p["doc_tokens"] == len(ids[p["doc_id"]])
        at[p["doc_id"]].append((p["start"], p["length"]))
        seqs[p["sequence_id"]].append((p["offset"], p["length"]))
    for i, x in ids.items():
        assert sum(n for _, n in at[i]) == len(x) and all(a + n == b for (a, n), (b, _) in zip(sorted(at[i]), sorted(at[i])[1:]))
    pad = 0
    for s in seqs.values():
        s.sort()
        n = sum(x for _, x in s)
        assert s[0][0] == 0 and all(a + k == b for (a, k), (b, _) in zip(s, s[1:])) and n <= 1024
        pad += 0 if n & (n - 1) == 0 else 1024 - n
    assert pad < 0.02 * sum(map(len, ids.values()))
    assert m.pack(empty).count() == 0 and m.pack(docs).where("doc_id is null").count() >= 2


def test_packing_reads_the_end_mark_as_one_id():
    import public_tokenizers
    from tokenizers import Tokenizer

    from millrace.llm.packing import default_tokenizer, encoder

    path = public_tokenizers.path("byte_bpe_50k.json")
    tok = Tokenizer.from_file(path)
    for text in ("a <|endoftext|> b", "<|endoftext|>", "<|endoftext|><|endoftext|>\n x", "<|endoftext |> <|endoftext"):
        want = tok.encode(text, add_special_tokens=False).ids
        assert list(encoder(default_tokenizer())(text)) == want == list(encoder(path)(text))
    assert encoder(path)("a <|endoftext|> b") == [64, 220, 50256, 275]


def test_bins_cut_little_and_pad_little():
    from millrace.llm.packing import SLACK, Bins, reciprocal

    assert [reciprocal(n) for n in (1023, 513, 512, 342, 341, 32, 31, 16, 1)] == [1, 1, 2, 2, 3, 32, 32, 64, 1024]
    rng = random.Random(3)
    for lengths in ([rng.randrange(1, 900) for _ in range(3000)], [1], [1024], [5] * 2500, [700] * 50, [int(rng.paretovariate(1) * 40) for _ in range(3000)], []):
        got = []
        bins = Bins(lambda *x: got.append(x))
        for d, n in enumerate(lengths):
            bins.add(d, np.arange(n, dtype="<u4"))
            assert len(bins.waiting) <= 2
        bins.finish()
        whole, sizes = defaultdict(list), Counter()
        for doc, start, ids, total, seq, offset in got:
            assert total == lengths[doc] and len(ids) and offset == sizes[seq]
            whole[doc] += list(ids) if start == len(whole[doc]) else [None]
            sizes[seq] += len(ids)
        assert all(whole[d] == list(range(n)) for d, n in enumerate(lengths))
        assert all(n <= 1024 and (n & (n - 1) == 0 or 1024 - n <= SLACK) for n in sizes.values())
        assert len(got) <= 2 * len(lengths) + sum(n // 1024 for n in lengths) + 40


@pytest.mark.parametrize("end", ["", "b", "\n<|endoftext|>", "<|endoftext|>  x"])
def test_packing_reads_long_blanks(end):
    import public_tokenizers
    from tokenizers import Tokenizer

    from millrace.llm.packing import BLANKS, default_tokenizer, encoder

    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for run in (" " * BLANKS, "\n" * 3 * BLANKS, " \u2003\t" * BLANKS, "x" + " " * (BLANKS - 1), "y\x1c" + "\n " * BLANKS + "\x1c"):
        for text in (run + end, "a b" + run + end, "a " + run + "c" + run + end):
            assert list(encoder(default_tokenizer())(text)) == tok.encode(text, add_special_tokens=False).ids
    assert len(encoder(default_tokenizer())(" " * 10_000_000 + "b")) > 1000


@pytest.mark.parametrize("frequent", [65_536, 40])
def test_lm_scores(spark, docs, empty, monkeypatch, frequent):
    from millrace.llm import lm_scoring as m
    from millrace.llm.gru import Shape

    monkeypatch.setattr(m, "FREQUENT", frequent)
    out = table(m.lm_scores(docs, shape=Shape(4, 5, 8), epochs=1))
    count, tokens = Counter(), {}
    for i, t in KEYED:
        tokens[i, t] = t.encode().lower().split() + [None]
        if zlib.crc32(("" if i is None else str(i)).encode()) % 7 != 2:
            count.update(tokens[i, t])
    n, v = count.total(), len(count)
    text = dict(KEYED)
    for r in out:
        if r["doc_id"] is None:
            continue
        w = tokens[r["doc_id"], text[r["doc_id"]]]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(w), sum(count[x] > 0 for x in w), n)
        assert r["base_score"] == pytest.approx(sum(math.log10((count[x] + 1) / (n + v + 1)) for x in w))
        assert r["score"] < 0 and math.isfinite(r["score"])
    assert len(out) == len(ROWS) and m.lm_scores(empty).count() == 0


def test_lm_beats_its_base_on_held_out(spark, sf):
    from millrace.llm.queries import op1_lm_scoring

    out = [r for r in table(op1_lm_scoring(spark, sf)) if r["held_out"]]
    assert sum(r["score"] for r in out) > 0.985 * sum(r["base_score"] for r in out)


def test_lm_learns_from_all_training_documents(spark):
    from millrace.llm import lm_scoring as m
    from millrace.llm.gru import Shape

    cycle = [f"w{(5 * i) % 16}" for i in range(16)]
    data = [(i, " ".join(cycle[(i + j) % 16] for j in range(120))) for i in range(1200)]
    df = spark.createDataFrame(data, "doc_id long, text string").repartition(3)
    out = [r for r in table(m.lm_scores(df, fit_docs=1, epochs=1, shape=Shape(5, 5, 16))) if r["held_out"]]
    assert sum(r["score"] for r in out) > 0.7 * sum(r["base_score"] for r in out)
    assert m.shape_for(10**5).vocabulary == 1024 < m.shape_for(10**8).vocabulary < m.shape_for(10**9).vocabulary <= m.FREQUENT


def test_gru_gradients_and_carried_state():
    from millrace.llm import gru

    m = gru.Model.start(gru.Shape(3, 4, 5), np.arange(1, 13))
    rng = np.random.default_rng(1)
    docs = [rng.integers(0, 12, n) for n in (1, 30, 75, 4)]
    whole = m.score(docs, lanes=2, steps=1000)
    assert np.allclose(whole, m.score(docs, lanes=3, steps=7), rtol=1e-4)
    for d, s in zip(docs, whole):
        h, total = np.zeros((1, 5), np.float32), 0.0
        for x in d:
            total += m.output(h, np.array([x]))[0][0]
            h = m.cell((m.p["E"] @ m.p["W"] + m.p["b"])[[x]], h)[0]
        assert total == pytest.approx(s, rel=1e-4)
    x, fresh, h0 = rng.integers(0, 12, (6, 3)), rng.random((6, 3)) < 0.2, np.zeros((3, 5), np.float32)
    _, grads, _ = m.window(x, fresh, h0)
    for k in m.p:
        i = np.unravel_index(np.abs(grads[k]).argmax(), grads[k].shape)
        old, e = m.p[k][i], 1e-2
        m.p[k][i] = old + e
        up = m.window(x, fresh, h0)[2]
        m.p[k][i] = old - e
        down = m.window(x, fresh, h0)[2]
        m.p[k][i] = old
        assert grads[k][i] == pytest.approx((up - down) / (2 * e), rel=0.05, abs=0.01)
    curve = m.train([np.append(rng.integers(1, 4, 50), 0) for _ in range(40)], 4)
    assert curve[-1] > curve[0]


def test_gru_gates_row_sums_and_wide_logits():
    from millrace.llm import gru

    rng = np.random.default_rng(3)
    sizes = np.array([1, 1, 700, 2, 3, 1, 64, 5])
    rows, first = rng.standard_normal((sizes.sum(), 6)).astype(np.float32), np.cumsum(sizes) - sizes
    assert np.allclose(gru.summed(rows, first), np.add.reduceat(rows, first), atol=1e-3)
    assert np.array_equal(gru.summed(rows[:4], np.arange(4)), rows[:4])

    m = gru.Model.start(gru.Shape(3, 4, 5), np.arange(1, 13))
    gx, h = rng.standard_normal((3, 7, 5)).astype(np.float32) * 60, rng.random((7, 5)).astype(np.float32)
    gh, n = np.empty((3, 7, 5), np.float32), np.empty((7, 5), np.float32)
    with np.errstate(over="ignore"):
        new = m.step(gx, h, m.gates("U"), gh, n)
    z, r, c = (h.astype(float) @ m.p["U"][:, 5 * g : 5 * g + 5] for g in range(3))
    z, r = (np.tanh(x + g) / 2 + 0.5 for x, g in ((z, gx[0]), (r, gx[1])))
    c = np.tanh(gx[2] + r * c)
    assert all(x.flags.c_contiguous for x in gh) and np.allclose(new, c + z * (h - c), atol=1e-5)

    # Sums of exps that leave the range of float32, with and without gradients.
    m.p["C"] *= 3000
    m.p["M"] *= 3000
    t = rng.integers(0, 12, 7)
    got, grads = m.output(h, t)[0], {}
    assert np.array_equal(got, m.output(h, t, grads)[0]) and all(np.isfinite(g).all() for g in grads.values())
    for s, x, lp in zip(h.astype(float), t, got):
        a, k = s @ m.p["C"] + m.p["c"], m.cls[x]
        b = m.p["M"][m.bounds[k] : m.bounds[k + 1]] @ s + m.p["m"][m.bounds[k] : m.bounds[k + 1]]
        i = x - m.bounds[k]
        want = a[k] - np.logaddexp.reduce(a) + b[i] - np.logaddexp.reduce(b)
        assert lp == pytest.approx(want, rel=1e-3, abs=1e-2)
