"""NN-descent against brute force; the pipeline's stages against their meaning; the registry."""

import re
from collections import Counter

import numpy as np
import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer


def vectors():
    rng = np.random.default_rng(3)
    out = []
    centre = {}
    for i in range(260):
        label = [None, 1, 2][0 if i % 20 == 0 else 1 + i % 2]
        if i % 4 == 0 and label in centre:
            v = centre[label] + rng.normal(size=16) * 0.03
        else:
            v = rng.normal(size=16)
            centre.setdefault(label, v)
        out.append((i, v.tolist(), label))
    for k in range(60):  # a group that lists grow to hold, and one larger than any list
        out.append((300 + k, (np.ones(16) + rng.normal(size=16) * 0.02).tolist(), 1))
    for k in range(160):
        out.append((1000 + k, (np.arange(16) - 8 + rng.normal(size=16) * 0.02).tolist(), 2))
    out += [(400, None, 1), (401, [], 1), (402, [0.0] * 16, 1), (403, [float("nan")] + [1.0] * 15, 1), (404, [float("inf")] * 16, 1), (405, [None] + [1.0] * 15, 1), (406, [1.0] * 8, 1), (407, out[5][1], out[5][2]), (408, out[5][1], out[5][2]), (409, [1e200] * 16, 1)]
    return out


def test_nn_descent(spark):
    from millrace.llm.embed_dedup import near_dedup

    rows = vectors()
    df = spark.createDataFrame([(*r, "x", True) for r in rows], "vec_id long, embedding array<double>, label int, n_links string, kept boolean")
    out, recall = near_dedup(df, with_audit=True)
    got = {r["vec_id"]: r for r in out.collect()}
    sound = {i: np.array(v) / np.abs(v).max() for i, v, lab in rows if lab is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)}
    lab = {i: x for i, _, x in rows}
    unit = {i: v / np.linalg.norm(v) for i, v in sound.items()}
    links = {i: {j for j in unit if j != i and lab[i] == lab[j] and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= 0.98} for i in unit}
    root = {i: i for i in got}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, js in links.items():
        for j in js:
            a, b = sorted((find(i), find(j)))
            root[b] = a
    assert len(got) == len(rows) and recall >= 0.9
    assert sum(got[i]["n_links"] for i in got) >= 0.95 * sum(map(len, links.values()))
    for i, r in got.items():
        assert r["n_links"] <= len(links.get(i, ())) and r["kept"] == (r["vec_id"] == r["component_id"])
    assert sum(got[i]["component_id"] != find(i) for i in got) <= 0.02 * len(got)
    assert near_dedup(df.limit(0)).count() == 0


def test_a_row_for_each_vector_where_ids_repeat(spark):
    from millrace.llm.embed_dedup import near_dedup

    a, b, c = [1.0, 0.0, 0.0, 0.0], [0.0, 1.0, 0.0, 0.0], [0.0, 0.999, 0.01, 0.0]
    data = [(1, a, 1), (1, b, 1), (1, a, 1), (2, a, 1), (3, c, 1), (4, b, 2), (None, a, 1), (5, [0.0, 0.0, 1.0, 1.0], 1), (1, a, None)]
    out = near_dedup(spark.createDataFrame(data, "vec_id long, embedding array<double>, label int")).collect()
    assert sorted((r["vec_id"] or 0, r["n_links"], r["component_id"] or 0) for r in out) == [(0, 0, 0), (1, 0, 1), (1, 1, 1), (1, 2, 1), (1, 2, 1), (2, 2, 1), (3, 1, 1), (4, 0, 4), (5, 0, 5)]


def near_with_losses(spark, monkeypatch, lost):
    """A group of 60 (ids 0 to 59) and 40 pairs (1000 to 1079), where the graph never sees pairs of a lost id."""
    from millrace.llm import embed_dedup as m

    def without(f):
        def run(batches):
            for pdf in f(batches):
                yield pdf[[not (lost(a) or lost(b)) for a, b in zip(pdf["a"], pdf["b"])]]

        return run

    monkeypatch.setattr(m, "LARGE", 16)
    monkeypatch.setattr(m, "LONGEST", 32)
    monkeypatch.setattr(m, "nodes_of", lambda *x, f=m.nodes_of: f(*x).withColumn("node", F.col("low")))  # ids are unique here
    for name in ("_adjacent", "_local_join"):
        monkeypatch.setattr(m, name, without(getattr(m, name)))
    rng = np.random.default_rng(5)
    data = [(k, (np.ones(32) + rng.normal(size=32) * 0.02).tolist(), 1) for k in range(60)]
    for k in range(40):
        v = rng.normal(size=32)
        data += [(1000 + 2 * k + j, (v + rng.normal(size=32) * 0.01).tolist(), 1) for j in range(2)]
    out, recall = m.near_dedup(spark.createDataFrame(data, "vec_id long, embedding array<double>, label int"), with_audit=True)
    return {r["vec_id"]: r for r in out.collect()}, recall


def test_audit_sees_small_groups_beside_a_large_one(spark, monkeypatch):
    got, recall = near_with_losses(spark, monkeypatch, lambda i: i >= 1000)
    assert recall == 1.0
    assert all(got[i]["n_links"] == (59 if i < 60 else 1) and got[i]["component_id"] == (0 if i < 60 else i // 2 * 2) for i in got)


def test_links_into_a_large_component_count_at_both_ends(spark, monkeypatch):
    got, _ = near_with_losses(spark, monkeypatch, lambda i: i == 59)
    assert all(got[i]["n_links"] == 59 and got[i]["component_id"] == 0 for i in range(60))


def in_one_language(docs, least):
    """Ids that the language stage keeps, by a recursion over one document's words at a time."""
    from millrace.llm import langid as m

    model = m.fit(docs.where(~m.held_out()))
    kept = set()
    for i, text in docs.select("doc_id", "text").collect():
        w = m.words_of([text or ""])
        if not w.letters[0]:
            continue
        scores = model.word_scores(w)
        best, back = scores[0].copy(), []
        for row in scores[1:]:
            move = best[None, :] - m.SWITCH * (1 - np.eye(len(best)))
            back.append(move.argmax(axis=1))
            best = move.max(axis=1) + row
        path = [int(best.argmax())]
        for step in reversed(back):
            path.append(int(step[path[-1]]))
        mass = Counter()
        for label, a, b in zip(reversed(path), w.begin, w.end):
            mass[label] += int(b - a)
        if max(mass.values()) >= least * sum(mass.values()):
            kept.add(i)
    return kept


def mix_by_hand(sizes, copies):
    """source -> (target, words taken)."""
    held, taken = Counter(), Counter()
    for i, (source, n) in sizes.items():
        held[source] += n
        taken[source] += n * copies.get(i, 0)
    order = sorted(held, key=lambda x: (x is None, x))
    weight = {x: k % 3 + 1 for k, x in enumerate(order)}
    target, free, left = {}, set(order), sum(held.values())
    while free:
        share = left / sum(weight[x] for x in free)
        full = {x for x in free if share * weight[x] > 3 * held[x]}
        for x in full or free:
            target[x] = 3 * held[x] if full else share * weight[x]
        left -= sum(target[x] for x in full)
        free = free - full if full else set()
    return {x: (target[x], taken[x]) for x in order if target[x]}


def test_pipeline(spark, sf):
    import corpus_pipeline as pipeline

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    names = [n for n, _ in pipeline.STAGES]
    assert names == ["language", "exact", "near", "mixed", "packed"]
    from millrace.llm._common import Scratch

    scratch, now, seen = Scratch(spark), docs, []
    for name, stage in pipeline.STAGES:
        new = scratch.table(stage(spark, now, sf), name)
        if name != "packed":
            assert new.columns == docs.columns
        seen.append((now, new))
        now = new
    texts = lambda d: {r[0]: r[1] for r in d.select("doc_id", "text").collect()}
    lang_in, lang_out = map(texts, seen[0])
    assert set(lang_out) == in_one_language(seen[0][0], pipeline.LEAST_SHARE)
    assert len(lang_out) >= 0.95 * len(lang_in)
    exact_in, exact_out = map(texts, seen[1])
    best = {}
    for i, t in exact_in.items():
        k = re.sub(r"[\x20\x09-\x0D]+", " ", t)
        best[k] = min(best.get(k, i), i)
    assert set(exact_out) == set(best.values())
    near_in, near_out = map(texts, seen[2])
    from tests.llm.test_documents import components, grams

    want = components({i: grams(t) for i, t in near_in.items()})
    assert set(near_out) == {i for i, r in want.items() if i == r}
    mixed_in, mixed_out = seen[3]
    copies = [r[0] for r in mixed_out.groupBy("doc_id").count().select("count").collect()]
    assert max(copies) <= 3 and mixed_out.join(mixed_in, "doc_id", "left_anti").count() == 0
    sizes = {r[0]: (r[1], len(re.findall(r"[^\x20\x09-\x0D]+", r[2]))) for r in mixed_in.select("doc_id", "source", "text").collect()}
    for source, (want, got) in mix_by_hand(sizes, {r[0]: r[1] for r in mixed_out.groupBy("doc_id").count().collect()}).items():
        least = min(n for x, n in sizes.values() if x == source and n)
        assert abs(got - want) <= max(0.01 * want, least), source
    packed = seen[4][1]
    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    left = sorted((i, len(tok.encode(t, add_special_tokens=False).ids) + 1) for i, t in mixed_out.select("doc_id", "text").collect())
    by_doc = {}
    for r in packed.collect():
        by_doc.setdefault(r["doc_id"], []).append((r["start"], r["length"], r["doc_tokens"]))
    for i, n in dict(left).items():
        copies = sum(d == i for d, _ in left)
        at = Counter(k for a, m, total in by_doc.pop(i) for k in range(a, a + m) if total == n)
        assert at == Counter({k: copies for k in range(n)})
    assert not by_doc
    assert packed.groupBy("sequence_id").agg(F.sum("length").alias("n")).where("n > 1024").count() == 0
    assert pipeline.ORACLE_SQL is None and pipeline.run(spark, sf).count() == packed.count()


def test_sql_of_this_subpackage(spark, sf):
    import duckdb

    from millrace.llm import queries as q
    from tests.test_oracles import rows

    con = duckdb.connect()
    for t in ("documents", "conversations"):
        con.sql(f"create view {t} as select * from '{sf}/{t}.parquet'")
    for name, sql in q.oracle_sql().items():
        df = q.queries()[name](spark, sf)
        rel = con.sql(sql)
        assert sorted(df.columns) == sorted(rel.columns)
        assert rows(df.columns, df.collect()) == rows(rel.columns, rel.fetchall())


def test_one_query_per_operator():
    from millrace.llm import queries as q

    assert [int(n[2:].split("_")[0]) for n in q.queries()] == list(range(1, 14))


def test_pipeline_stages_on_awkward_rows(spark):
    import corpus_pipeline as pipeline

    from millrace.llm._common import Scratch
    from tests.llm.test_documents import ROWS, SCHEMA

    scratch = Scratch(spark)
    whole = spark.createDataFrame(ROWS, SCHEMA)
    for docs in (scratch.table(whole), scratch.table(whole.limit(0)), scratch.table(whole.where("text is null"))):
        columns = docs.columns
        for name, stage in pipeline.STAGES:
            docs = scratch.table(stage(spark, docs, "unused"), name)
            if name != "packed":
                assert docs.columns == columns
                assert docs.where("kept is not null and kept <> true or size is not null and size <> 's' or score is not null and score <> 1").count() == 0


def test_clear(spark):
    from millrace.llm._common import Scratch

    df = Scratch(spark).table(spark.range(3))
    assert df.count() == 3
    Scratch.clear(spark)
    assert not Scratch.roots
