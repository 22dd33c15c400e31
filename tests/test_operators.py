"""Curation, chat, evaluation, release and telemetry operators against small brute-force versions."""

import json
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from millrace.operators import curate, evaluation, near, release, telemetry, tokens
from millrace.operators.gates import Check, GateError, convergence, enforce
from millrace.sources import jsonl, tables


def test_cap_and_duplicates(spark):
    rng = random.Random(3)
    rows = [(i, rng.choice(["a", "b", None]), f"k{rng.randrange(12)}") for i in range(120)]
    rows = [(i, None if t is None else "ab"[int(k[1:]) % 2], k) for i, t, k in rows]
    seen, n, want = set(), {}, {}
    for i, t, k in rows:
        if t is None:
            want[i] = "untagged"
        elif n.get(t, 0) >= 4:
            want[i] = "over_cap"
        elif k in seen:
            want[i] = "duplicate"
        else:
            want[i] = "kept"
            n[t] = n.get(t, 0) + 1
        if t is not None:
            seen.add(k)
    df = spark.createDataFrame(rows, "i long, t string, k string")
    assert {r["i"]: r["fate"] for r in curate.capped(df, "k", "t", "i", 4).collect()} == want


def test_classify_first_rule(spark):
    rules = [("x", ["foo"]), ("y", ["bar", "foo"])]
    df = spark.createDataFrame([("Foo bar",), ("BAR",), ("z",), (None,)], "v string")
    assert [r[0] for r in df.select(curate.classify([F.col("v")], rules)).collect()] == ["x", "y", None, None]
    with pytest.raises(ValueError, match="q"):
        curate.check_labels(["x", "q"], rules)


def test_group_split():
    sizes = {f"g{i}": (i * 7) % 13 + 1 for i in range(40)}
    out = curate.group_split(sizes, {"train": 0.8, "val": 0.1, "test": 0.1}, 42)
    assert set(out) == set(sizes) and set(out.values()) == {"train", "val", "test"}
    assert out == curate.group_split(dict(reversed(sizes.items())), {"train": 0.8, "val": 0.1, "test": 0.1}, 42)
    with pytest.raises(ValueError):
        curate.group_split({"a": 1}, {"train": 0.5, "test": 0.5}, 1)


def test_greedy_is_not_components(spark):
    df = spark.range(5).withColumnRenamed("id", "k")
    pairs = spark.createDataFrame([(0, 1, 1.0), (1, 2, 1.0), (2, 3, 1.0), (3, 4, 1.0)], "a long, b long, jaccard double")
    assert sorted(r[0] for r in near.greedy(df, pairs, "k").collect()) == [0, 2, 4]


def test_near_pairs_brute_force(spark):
    rng = random.Random(5)
    base = [f"w{rng.randrange(60)}" for _ in range(40)]
    texts = []
    for _ in range(25):
        t = list(base)
        for _ in range(rng.randrange(4)):
            t[rng.randrange(len(t))] = f"w{rng.randrange(900)}"
        texts.append(" ".join(t))
    texts += ["", "one two", "one two"]
    sets = [{" ".join(w[i : i + 4]) for i in range(len(w) - 3)} if len(w := t.split()) >= 4 else ({t} if w else set()) for t in texts]
    want = {(i, j) for i in range(len(sets)) for j in range(i) if sets[i] and len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= 0.85}
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    assert {(r["b"], r["a"]) for r in near.pairs_within(df, "id", "text").collect()} == want


def test_strict_jsonl(spark, tmp_path):
    good = json.dumps({"id": "1", "topic": "t", "messages": [{"role": r, "content": "c"} for r in jsonl.ROLES]})
    bad = good.replace('"assistant"', '"user"')
    p = tmp_path / "x.jsonl"
    p.write_text("\n".join([good, good, bad, good, bad]) + "\n")
    with pytest.raises(jsonl.BadLine, match=r"x\.jsonl:3: roles"):
        jsonl.strict_chat(spark, str(p))
    p.write_text("\n".join([good, good]) + "\n")
    assert jsonl.strict_chat(spark, str(p)).count() == 2
    p.write_text(good + "\n\n" + good + "\n")
    with pytest.raises(jsonl.BadLine, match=":2: blank"):
        jsonl.strict_chat(spark, str(p))


def test_line_numbers_over_splits(spark, tmp_path):
    p = tmp_path / "many.jsonl"
    p.write_text("".join(f"line {i}\n" for i in range(1, 3001)))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4k")
    try:
        rows = jsonl.numbered_lines(spark, str(p)).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert len(rows) == 3000 and all(r["value"] == f"line {r['line']}" for r in rows)


def test_atomic_document(tmp_path, monkeypatch):
    p = tmp_path / "d.json"
    jsonl.write_document(str(p), {"a": 1})
    with pytest.raises(ValueError):
        jsonl.write_document(str(p), {"a": float("nan")})
    monkeypatch.setattr("os.replace", lambda *a: (_ for _ in ()).throw(OSError("no")))
    with pytest.raises(OSError):
        jsonl.write_document(str(p), {"a": 2})
    assert json.loads(p.read_text()) == {"a": 1} and [x.name for x in tmp_path.iterdir()] == ["d.json"]


def test_mixed_log(spark, tmp_path):
    (tmp_path / "a.log").write_text('plain\n{"event": "x", "pod": "p"}\n[1]\n{"event": "y"} tail\n')
    assert [(r["event"], r["pod"]) for r in tables.log_events(spark, str(tmp_path / "a.log"), "event string, pod string").collect()] == [("x", "p")]


def test_versions(tmp_path):
    f = tmp_path / "a"
    f.write_text("")
    assert tables.version_files({"v1": [str(f)]}, "v1") == [str(f)]
    for versions, v in (({}, "v1"), ({"v1": [str(tmp_path / "no")]}, "v1")):
        with pytest.raises(ValueError):
            tables.version_files(versions, v)


def test_boundary_inside_a_token():
    class Pairs:
        def encode(self, text):
            spans = [(i, min(i + 2, len(text))) for i in range(0, len(text), 2)]
            return [hash(text[a:b]) for a, b in spans], spans

    t = Pairs()
    ids, spans = t.encode("Привет, мир")
    n, fallback = tokens.boundary(t.encode("Приве")[0], ids, spans, 5)
    assert fallback and spans[n][0] >= 5


def test_padding(spark):
    df = spark.createDataFrame([(0, [1, 2], [-100, 2]), (1, [3], [3])], "o long, input_ids array<int>, labels array<int>")
    a = tokens.pad_batches(df, "o", 2, 9, "left").orderBy("o").collect()[1]
    assert (a["input_ids"], a["attention_mask"], a["labels"]) == ([9, 3], [0, 1], [-100, 3])


def first_fit(lengths, capacity):
    """(key, bin, slot) by a scan over all bins."""
    room, rows, out = [], [], []
    for key, n in sorted(enumerate(lengths), key=lambda x: (-x[1], x[0])):
        at = next((i for i, r in enumerate(room) if r >= n), len(room))
        if at == len(room):
            room.append(capacity)
            rows.append(0)
        out.append((key, at, rows[at]))
        room[at] -= n
        rows[at] += 1
    return sorted(out)


def test_first_fit_by_counts():
    rng = random.Random(1)
    for _ in range(300):
        capacity = rng.choice([1, 7, 50])
        lengths = [rng.randrange(rng.choice([0, 1]), rng.choice([capacity, capacity // 2 + 1]) + 1) for _ in range(rng.randrange(1, 120))]
        counts = Counter(lengths)
        ranks, at = {}, Counter()
        for key, n in enumerate(lengths):
            ranks[n, at[n]] = key
            at[n] += 1
        got = []
        for n, first, bin_, bins, each, slot in tokens.placements(counts, capacity):
            got += [(ranks[n, first + i], bin_ + i // each, slot + i % each) for i in range(bins * each)]
        assert sorted(got) == first_fit(lengths, capacity)


def test_first_fit_of_rows(spark):
    rng = random.Random(2)
    lengths = [rng.choice([64, rng.randrange(0, 65)]) for _ in range(700)]  # half have one length
    df = spark.createDataFrame(list(enumerate(lengths)), "id long, len int").repartition(5)
    got = sorted((r["id"], r["bin"], r["slot"]) for r in tokens.first_fit_decreasing(df, 64).collect())
    assert got == first_fit(lengths, 64)
    assert tokens.first_fit_decreasing(df.limit(0), 64).count() == 0
    with pytest.raises(ValueError):
        tokens.first_fit_decreasing(df, 63)


GOLD = [(f"q{i}", "B", ["A", "B", "REFUSE"], [f"s{i % 3}"]) for i in range(50)]
OUT = [(f"q{i}", '{"answer":"B"}', None) for i in range(50)]


def golden(spark, out=OUT):
    g = spark.createDataFrame(GOLD, "id string, expected string, choices array<string>, slices array<string>")
    return g, spark.createDataFrame(out, "id string, raw string, error string")


def test_strict_answers(spark):
    bad = ['{"answer":"B"}.', '{"answer":"B","x":1}', '{"answer":1}', '{"answer":"Z"}', '```{"answer":"B"}```', "", "null", "['B']", '{"answer":"B",}', None]
    df = spark.createDataFrame([(b, ["A", "B"]) for b in bad + ['{"answer":"B"}', '{"answer":"A","answer":"B"}']], "r string, c array<string>")
    assert [r[0] for r in df.select(evaluation.strict_answer("r", "c")).collect()] == [None] * len(bad) + ["B", "B"]


ABOUT = {"model": "m", "protocol_sha256": "p", "golden_sha256": "g", "baseline_spec_sha256": "s", "behavioral": {"overall": {"n": 3, "correct": 3, "valid": 3, "errors": 0, "accuracy": 1.0, "format_rate": 1.0}}}


def test_score_and_gate(spark):
    good = evaluation.report_of(evaluation.score_items(*golden(spark)), **ABOUT)
    assert {s: m["n"] for s, m in good["slices"].items()} == {"s0": 17, "s1": 17, "s2": 16}
    assert all(c.passed for c in evaluation.quality_gate(good, good, ["s0"]))
    assert evaluation.gate_rejects_corruption(good, good, ["s0"]).passed
    worse = evaluation.report_of(evaluation.score_items(*golden(spark, [("q0", "B", None), *OUT[1:]])), **ABOUT)
    assert not all(c.passed for c in evaluation.quality_gate(good, worse, ["s0"]))
    for change in (lambda r: r.update(status="x"), lambda r: r["overall"].update(accuracy=float("nan")), lambda r: r["overall"].update(n=49), lambda r: r.pop("slices"), lambda r: r.update(golden_sha256="h"), lambda r: r["per_item"].pop(), lambda r: r["behavioral"]["overall"].update(errors=1), lambda r: r["slices"].pop("s0"), lambda r: r["overall"].update(correct=True)):
        copy = json.loads(json.dumps(good))
        change(copy)
        assert not all(c.passed for c in evaluation.quality_gate(good, copy, ["s0"]))
    assert not all(c.passed for c in evaluation.quality_gate(good, good, []))
    for out in (OUT[:-1], [*OUT, OUT[0]], [*OUT[:-1], ("zz", "", None)]):
        with pytest.raises(ValueError):
            evaluation.score_items(*golden(spark, out))


def test_errored_output_is_invalid(spark):
    items = evaluation.score_items(*golden(spark, [("q0", '{"answer":"B"}', "timeout"), *OUT[1:]]))
    assert tuple(evaluation.overall(items).first())[:4] == (50, 49, 49, 1)


def test_leakage(spark):
    cols = "id string, group_id string, input string, expected string, choices array<string>, slices array<string>, source string, type string"
    rows = [(f"q{i}", f"g{i}", f"Question {i}", "A", ["A"], [f"s{i % 3}"], "src", None) for i in range(50)]
    beh = [(f"b{i}", "h", f"x{i}", "A", ["A"], ["s"], "src", t) for i, t in enumerate(("format", "paraphrase", "refusal"))]
    g, b = spark.createDataFrame(rows, cols), spark.createDataFrame(beh, cols)
    train = lambda *x: spark.createDataFrame([("t", *x)], "id string, group_id string, input string")
    ok = lambda *a: all(c.passed for c in evaluation.leakage_gate(*a))
    assert ok(g, train("other", "other"), b)
    assert not ok(g, train("other", "  QUESTION   7 "), b) and not ok(g, train("g7", "other"), b)
    assert not ok(g.limit(49), train("o", "o"), b) and not ok(g, train("o", "o"), b.limit(2))


def release_pair():
    from millrace.functions.hashing import canonical, digest

    runtime = {"a": 1}
    m = {"schema_version": 1, "model_id": "m", "artifact_uri": "u", "model_sha256": "a" * 64, "protocol_sha256": "b" * 64, "golden_sha256": "c" * 64, "runtime_sha256": digest(canonical(runtime)), "runtime": runtime}
    r = {"status": "complete", "passed": True, "evaluation_run_id": "e", "metrics": {"accuracy": 0.5, "format_rate": 1}, **{k: m[k] for k in ("model_id", *release.HASHES)}}
    return m, r


def test_release_matrix(spark):
    import json

    cases = [("", release_pair())]
    for i, keys in enumerate(release_pair()):
        for k in keys:
            pair = release_pair()
            pair[i].pop(k)
            cases.append((f"without {k}", pair))
    for value in (float("nan"), float("inf"), -0.1, 1.1, True, "1", None, 10**400, 1e300, [0.5]):
        m, r = release_pair()
        r["metrics"]["accuracy"] = value
        cases.append((f"accuracy {str(value)[:9]}", (m, r)))
    changes = [(0, "schema_version", x) for x in (True, 2, 1.0, "1")] + [(0, "model_sha256", "A" * 64), (0, "golden_sha256", "c" * 64 + "\n"), (0, "runtime", {"a": 2}), (0, "runtime", {}), (0, "runtime", [1]), (0, "model_id", " "), (0, "model_id", 5), (1, "passed", "true"), (1, "passed", 1), (1, "status", "failed"), (1, "golden_sha256", "d" * 64), (1, "evaluation_run_id", "\t")]
    for i, k, v in changes:
        pair = release_pair()
        pair[i][k] = v
        cases.append((f"{k} {v!r}", pair))
    df = spark.createDataFrame([(name, json.dumps(m), json.dumps(r)) for name, (m, r) in cases], "name string, m string, r string")
    refused = {x[0] for x in release.broken_rules(df, "m", "r", ["name"]).select("name").distinct().collect()}
    assert {name for name, _ in cases} - refused == {""}
    odd = spark.createDataFrame([("null", None, None), ("text", "x", "y"), ("list", "[]", "[]")], df.schema)
    assert release.broken_rules(odd, "m", "r", ["name"]).select("name").distinct().count() == 3
    assert release.validate(spark, *release_pair()) == []


@pytest.mark.parametrize("crash", ["intent", "pointer", "journal", "end"])
def test_publication_recovers(spark, tmp_path, crash):
    from millrace.functions.hashing import canonical, digest

    files = tmp_path / "files"
    files.mkdir()
    (files / "w").write_text("weights")
    m, r = release_pair()
    m["file_hashes"] = {"w": digest("weights")}
    m["model_sha256"] = r["model_sha256"] = digest(canonical(m["file_hashes"]))
    publisher = lambda: release.Publisher(f"file://{tmp_path}/out", spark, str(files))
    first = publisher()
    with pytest.raises(RuntimeError):
        first.publish(m, r, crash)
    for _ in range(2):
        p = publisher()
        rid = p.publish(m, r)
    assert p.published() == [rid] and p.files.read("pending.json") is None
    before = p.files.read("current.json")
    with pytest.raises(GateError):  # the folder has another publisher by now
        first.publish({**m, "artifact_uri": "elsewhere"}, r)
    for bad in ({**m, "schema_version": 2}, {**m, "file_hashes": {"w": digest("other")}}, {**m, "file_hashes": {}}, {**m, "file_hashes": {"w": digest("weights"), "x": digest("x")}}):
        with pytest.raises(GateError):
            p.publish(bad, r)
    again = p.publish({**m, "artifact_uri": "elsewhere"}, r)
    assert p.published() == [rid, again] and p.current()["release_id"] == again
    (files / "w").write_text("changed")
    with pytest.raises(GateError):
        p.publish(m, r)
    assert p.files.read("current.json") != before and p.published() == [rid, again]


def test_integrity(spark, tmp_path):
    from millrace.functions.hashing import digest

    (tmp_path / "a").write_text("x")
    (tmp_path / "b").write_text("y")
    assert release.integrity(spark, {"a": digest("x"), "b": digest("y")}, str(tmp_path)).count() == 0
    told = {r[0]: r[1] for r in release.integrity(spark, {"a": digest("z"), "c": digest("y"), "../q": "0"}, str(tmp_path)).collect()}
    assert told == {"a": "changed", "b": "not in the inventory", "c": "missing", "../q": "unsafe path"}


def test_outcomes(spark):
    rows = [(200, False, False, "aborted"), (200, True, False, "completed"), (429, False, False, "rejected"), (503, True, False, "rejected"), (200, True, True, "expired"), (0, False, False, "error"), (None, None, None, "error")]
    df = spark.createDataFrame(rows, "s int, d boolean, x boolean, want string")
    assert all(r["got"] == r["want"] for r in df.select("want", telemetry.outcome(F.col("s"), F.col("d"), F.col("x")).alias("got")).collect())


def test_lru_and_admission(spark):
    keys = "aabacb"
    df = spark.createDataFrame([("p", i, float(i), k) for i, k in enumerate(keys)], "pod string, id long, t double, key string")
    assert [r["hit"] for r in telemetry.replay_lru(df, 2).orderBy("id").collect()] == [False, True, False, True, False, False]
    df = spark.createDataFrame([("p", 0, 0.0, 10.0), ("p", 1, 1.0, 5.0), ("p", 2, 2.0, 5.0), ("p", 3, 11.0, 1.0)], "pod string, id long, t double, service double")
    got = telemetry.replay_admission(df, 1, 1).orderBy("id").collect()
    assert [(r["admitted"], r["start"]) for r in got] == [(True, 0.0), (True, 10.0), (False, None), (True, 15.0)]


def test_alert_needs_every_tick(spark):
    active = {0: True, 10: True, 20: True, 30: False, 40: True, 60: True, 70: True, 80: True}
    df = spark.createDataFrame(list(active.items()), "tick long, active boolean")
    got = {r[0]: r[1] for r in telemetry.alert_islands(df, 10, 20).collect()}
    assert got == {0: "pending", 10: "pending", 20: "firing", 30: "inactive", 40: "pending", 60: "pending", 70: "pending", 80: "firing"}


def test_range_join(spark):
    rng = random.Random(2)
    ev = [(rng.choice("ab"), rng.uniform(0, 100)) for _ in range(200)]
    st = [(rng.choice("ab"), rng.uniform(0, 100)) for _ in range(20)]
    want = sum(k == q and s <= t < s + 19 for k, t in ev for q, s in st)
    e, s = spark.createDataFrame(ev, "k string, t double"), spark.createDataFrame(st, "k string, start double")
    assert telemetry.within(e, s, "k", 19).count() == want


def test_payload(spark):
    cases = {'{"prompt":5}': "nonempty messages required", '{"messages":"x","prompt":"y"}': "nonempty messages required", '{"prompt":"x","chunks":null}': "invalid chunks", '{"messages":[{"role":"user","content":5}]}': "invalid message",
             '{"messages":["{\\"role\\":\\"user\\",\\"content\\":\\"x\\"}"]}': "invalid message", '{"messages":null,"prompt":" "}': "invalid message", '{"messages":[{"role":"user","content":"é"},{"role":"system","content":"s"}],"chunk_delay":0.5,"work_multiplier":8}': None,
             '{"prompt":"x","work_multiplier":"1"}': "invalid work_multiplier", '{"prompt":"x","request_id":"' + "r" * 129 + '"}': "request_id too long", '{"prompt":"x"}': None, "[]": "JSON object required", '{"messages":[]}': "nonempty messages required", '{"messages":[{"role":"root","content":"x"}]}': "invalid message", '{"prompt":"x","chunks":true}': "invalid chunks", '{"prompt":"x","chunks":1.5}': "chunks must be integer", '{"prompt":"x","chunk_delay":0.7}': "invalid chunk_delay", '{"prompt":"' + "y" * 8193 + '"}': "input exceeds 8192 characters"}
    df = spark.createDataFrame([(k,) for k in cases], "b string")
    assert [r[0] for r in df.select(telemetry.payload_fault("b")).collect()] == list(cases.values())


def test_gates(spark):
    done = []
    with pytest.raises(GateError, match="a: .*c: "):
        enforce([Check("a", False, "x"), Check("b", True), Check("c", False, "y")], done.extend)
    assert len(done) == 3
    curve = spark.createDataFrame([(i, 1.0 - i / 20) for i in range(10)], "step int, value double")
    assert all(c.passed for c in convergence(curve, 0.9))
    assert not all(c.passed for c in convergence(curve.withColumn("value", -F.col("value")), 0.9))


def test_run_selection(spark):
    runs = spark.createDataFrame([("r2", "a", "FINISHED", 0.5, {"k": "v", "base_revision": "1"}), ("r1", "b", "FINISHED", 0.5, {"k": "v", "base_revision": "1"}), ("r0", "c", "FAILED", 0.1, {"k": "v", "base_revision": "1"})], "run_id string, candidate string, status string, final_val_loss double, tags map<string,string>")
    assert evaluation.best_run(runs).first()["run_id"] == "r1"
    checks = {c.name: c.passed for c in evaluation.selection_gate("FINISHED", runs, {"a", "b", "c"}, {"k": "v"})}
    assert checks == {"parent": True, "candidates": True, "provenance": True, "finished": False, "one_base": True}
    assert evaluation.loss_gate("FINISHED", 0.5, 1.0, 0.6).passed and not evaluation.loss_gate("FINISHED", float("nan"), 1.0, 0.6).passed


def test_questions_epochs_templates(spark):
    df = spark.createDataFrame([(i, "Q", ["x", "y"]) for i in range(100)], "id long, stem string, o array<string>")
    assert df.select(tokens.render_question(F.col("stem"), F.col("o"))).first()[0] == "Q\nA) x\nB) y"
    a, b = (tokens.epoch_batches(df, "id", 1, e, 8, 4) for e in (0, 1))
    assert a.count() == 100 and a.groupBy("part", "batch").count().agg(F.max("count")).first()[0] <= 8
    assert a.select("id", "part").exceptAll(b.select("id", "part")).count() > 0
    chat = spark.createDataFrame([("1", [("user", "u"), ("assistant", "a")]), ("2", [("user", "u"), ("tool", "a")])], "id string, messages array<struct<role:string,content:string>>")
    assert [r[0] for r in tokens.template_faults(chat).collect()] == ["2"]


def test_generate_requests(spark):
    cases = {'{"prompt":"x"}': None, '{"prompt":"x","max_new_tokens":"32"}': "invalid max_new_tokens", '{"prompt":"x","max_new_tokens":32.0}': "invalid max_new_tokens", '{"prompt":5}': "invalid prompt", '{"prompt":" \\n "}': "invalid prompt", '{"prompt":"x","max_new_tokens":32}': None, '{"prompt":"","max_new_tokens":32}': "invalid prompt", '{"prompt":"x","max_new_tokens":33}': "invalid max_new_tokens", '{"prompt":"x","max_new_tokens":32,"t":1}': "unknown fields", "x": "JSON object required"}
    df = spark.createDataFrame([(k,) for k in cases], "b string")
    assert [r[0] for r in df.select(telemetry.generate_fault("b", 32)).collect()] == list(cases.values())


def test_snapshots(spark, tmp_path):
    (tmp_path / "s.jsonl").write_text("\n".join(json.dumps({"wall_time": t, "pods": {"items": [{"name": p, "restarts": 0, "ready": True} for p in pods]}, "endpoints": {"items": [{"service": "api", "addresses": [{"pod": "a", "ready": t > 1}]}]}}) for t, pods in ((1, "ab"), (2, "a"))))
    s = tables.snapshots(spark, str(tmp_path / "s.jsonl"))
    assert [r["ready"] for r in tables.endpoint_ready(s, "api").orderBy("wall_time").collect()] == [False, True]
    kept = telemetry.baseline_kept(tables.pods_of(s), ["a", "b"]).orderBy("wall_time").collect()
    assert [(r["same_pods"], r["no_restarts"]) for r in kept] == [(True, True), (False, True)]


def test_series(spark, tmp_path):
    (tmp_path / "m.jsonl").write_text(json.dumps({"metric": {"pod": "a", "le": "0.5", "__name__": "x"}, "values": [["1", "2"], ["3", "4"]], "value": ["9", "7"]}))
    assert [tuple(r) for r in tables.series(spark, str(tmp_path / "m.jsonl")).collect()] == [("a", 1.0, 2.0), ("a", 3.0, 4.0)]
    r = tables.instant(spark, str(tmp_path / "m.jsonl"), "x").first()
    assert (r["le"], r["value"]) == (0.5, 7.0)


def test_collect_stage(spark):
    rows = [("f", 0, "Write  license", "", "x = 1"), ("f", 1, "Write license", None, "x = 1"), ("f", 2, "copyright", "in", "```python\ny = 2\n```"), ("f", 3, "copyright", "", "y = = 2"), ("g", 0, "", "", "z"), ("g", 1, "plain", "", "z = 1"), ("g", 2, "copyright", "", "q = 1")]
    df = spark.createDataFrame(rows, "file string, row long, instruction string, input string, output string")
    got = {(r["file"], r["row"]): r["fate"] for r in curate.collect(df, curate.EXAMPLE_RULES, 2).collect()}
    assert got == {("f", 0): "kept", ("f", 1): "duplicate", ("f", 2): "kept", ("f", 3): "syntax", ("g", 0): "short", ("g", 1): "untagged", ("g", 2): "over_cap"}


def test_exact_sample(spark):
    df = spark.range(50).withColumnRenamed("id", "k")
    assert [r["k"] for r in curate.sample_exact(df, 7, 3, ["k"]).collect()] == sorted(random.Random(3).sample(range(50), 7))


def test_documents_configs_and_keys(tmp_path):
    from millrace.functions import hashing
    from millrace.sources import jsonl

    path = str(tmp_path / "m.json")
    jsonl.write_document(path, {"é": [1, 2.5, None]})
    assert jsonl.read_document(path) == {"é": [1, 2.5, None]} == tables.load_config(path)
    with pytest.raises(ValueError):
        jsonl.write_document(path, {"x": float("nan")})
    (tmp_path / "n.json").write_text('{"x": NaN}')
    with pytest.raises(ValueError):
        jsonl.read_document(str(tmp_path / "n.json"))
    (tmp_path / "copy").write_bytes((tmp_path / "m.json").read_bytes())
    assert hashing.cache_key(path, {"a": 1, "b": 2}) == hashing.cache_key(tmp_path / "copy", {"b": 2, "a": 1}) != hashing.cache_key(path, {"a": 2, "b": 2})
    assert hashing.training_fingerprint(b"code", {"a": 1}) != hashing.training_fingerprint(b"code", {"a": 2})
    with pytest.raises(ValueError, match="unknown version"):
        tables.version_files({"v1": [path]}, "v2")
    with pytest.raises(ValueError, match="missing"):
        tables.version_files({"v1": [path + "x"]}, "v1")
    assert tables.version_files({"v1": [path]}, "v1") == [path]


def test_markdown_is_for_small_tables(spark):
    df = spark.createDataFrame([(1, "a|b"), (2, None)], "n int, s string")
    assert tables.markdown(df.orderBy("n")) == "| n | s |\n| --- | --- |\n| 1 | a\\|b |\n| 2 |  |"
    with pytest.raises(ValueError):
        tables.markdown(df, most=1)
