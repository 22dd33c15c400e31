"""Queries of gates: each rule is a row (name, passed), over data that keeps it and data that breaks it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import hashing
from ..sources.files import Files
from ..operators import evaluation, gates, release, telemetry, tokens
from ..operators.gates import Check
from .chat import TURNS, _golden
from .registry import Tables, query
from .store import registry


def told(t: Tables, checks: list[Check]) -> DataFrame:
    return gates.frame(t.spark, checks).select("name", "passed")


GOLD = """
WITH g AS (SELECT doc_id, CASE WHEN doc_id % 11 = 0 THEN '  ' ELSE text END AS input, source AS group_id, CASE WHEN doc_id % 13 = 0 THEN 'Q' ELSE 'A' END AS expected, doc_id % 17 = 0 AS no_slices, doc_id % 19 = 0 AS bad_choice FROM documents)"""


def golden_rows(t: Tables) -> DataFrame:
    """Golden rows with planted faults."""
    i, strings = F.col("doc_id"), "array<string>"
    return t.documents.select(
        i.cast("string").alias("id"), F.when(i % 11 == 0, "  ").otherwise(F.col("text")).alias("input"), F.col("source").alias("group_id"), F.when(i % 13 == 0, "Q").otherwise("A").alias("expected"),
        F.when(i % 17 == 0, F.array().cast(strings)).otherwise(F.array("lang", "source")).alias("slices"), F.when(i % 19 == 0, F.array(F.lit("A"), F.lit(None))).otherwise(F.array(F.lit("A"), F.lit("B"))).alias("choices"),
        F.lit("corpus").alias("source"),
    )


@query(rf"{GOLD} SELECT rule, count(*) AS n FROM (SELECT unnest(list_filter([CASE WHEN coalesce(trim(input), '') = '' THEN 'input' END, CASE WHEN coalesce(trim(group_id), '') = '' THEN 'group_id' END, CASE WHEN no_slices THEN 'slices' END, CASE WHEN bad_choice THEN 'choices' END, CASE WHEN expected = 'Q' THEN 'expected' END], lambda x: x IS NOT NULL)) AS rule FROM g) GROUP BY rule")
def golden_row_faults(t: Tables) -> DataFrame:
    return evaluation.row_faults(golden_rows(t)).groupBy("rule").agg(F.count(F.lit(1)).alias("n"))


def _sound(t: Tables, rest: int) -> DataFrame:
    i = F.col("doc_id")
    return t.documents.where(i % 10 == rest).select(
        i.cast("string").alias("id"), F.concat(F.lit("question "), i).alias("input"), F.concat(F.lit("g"), i).alias("group_id"), F.lit("A").alias("expected"), F.array(F.lit("A"), F.lit("B")).alias("choices"),
        F.array(F.concat(F.lit("s"), F.floor(i / 10) % 5)).alias("slices"), F.lit("corpus").alias("source"), F.array(*[F.lit(k) for k in ("format", "paraphrase", "refusal")])[(F.floor(i / 10) % 3).cast("int")].alias("type"),
    )


@query("""
WITH d AS (SELECT doc_id, doc_id % 10 = 0 AS gold, doc_id % 10 = 1 AS beh FROM documents), n AS (SELECT count(*) FILTER (WHERE gold) AS g, count(*) FILTER (WHERE beh) AS b, count(DISTINCT (doc_id // 10) % 5) FILTER (WHERE gold) AS s, count(DISTINCT (doc_id // 10) % 3) FILTER (WHERE beh) AS k FROM d)
SELECT unnest(['size', 'rows', 'unique_inputs', 'no_overlap', 'slices', 'behavioral', 'separate_ids']) AS name, unnest([g >= 15, true, true, (SELECT count(*) FROM d WHERE gold AND doc_id % 20 = 0) = 0, s >= 3, b >= 3 AND k = 3, true]) AS passed FROM n""")
def leakage_gate(t: Tables) -> DataFrame:
    """Training repeats the inputs of every other golden row, in other case and spacing."""
    train = t.documents.where("doc_id % 20 = 0").select(F.lit("other").alias("group_id"), F.concat(F.lit("  QUESTION \t"), "doc_id").alias("input"))
    return told(t, evaluation.leakage_gate(_sound(t, 0), train, _sound(t, 1), 15))


@query("""
WITH r AS (SELECT o_orderpriority AS c, o_orderstatus = 'F' AS done FROM orders WHERE o_custkey % 5 = 3 AND o_orderkey % 4 > 0)
SELECT unnest(['parent', 'candidates', 'provenance', 'finished', 'one_base']) AS name, unnest([true, (SELECT count(*) = 5 AND count(DISTINCT c) = 5 FROM r), true, (SELECT bool_and(done) FROM r), true]) AS passed""")
def selection_gate(t: Tables) -> DataFrame:
    runs = registry(t).where((F.col("tags")["parent"] == "3") & (F.col("tags")["kind"] == "candidate"))
    names = {r[0] for r in t.orders.select("o_orderpriority").distinct().collect()}  # five priorities
    return told(t, evaluation.selection_gate("FINISHED", runs, names, {"base_revision": "r1"}))


@query("SELECT o_orderpriority AS name, coalesce(min(o_totalprice) / max(o_totalprice) <= 0.0025, false) AS passed FROM orders WHERE o_totalprice > 0 GROUP BY 1")
def loss_ratio_gate(t: Tables) -> DataFrame:
    r = t.orders.where("o_totalprice > 0").groupBy("o_orderpriority").agg(F.min("o_totalprice").alias("a"), F.max("o_totalprice").alias("b")).collect()  # five priorities
    return t.spark.createDataFrame([(x["o_orderpriority"], evaluation.loss_gate("FINISHED", x["a"], x["b"], 0.0025).passed) for x in r], "name string, passed boolean")


def _curve(t: Tables) -> DataFrame:
    return t.orders.groupBy(F.floor(F.col("o_orderkey") / 100).cast("int").alias("step")).agg(F.avg("o_totalprice").alias("value"))


CURVE = "WITH c AS (SELECT o_orderkey // 100 AS step, avg(o_totalprice) AS value FROM orders GROUP BY 1), k AS (SELECT greatest(1, count(*) // 5) AS k, count(*) AS n FROM c), r AS (SELECT *, row_number() OVER (ORDER BY step) AS i FROM c)"


@query(f"""{CURVE}, m AS (SELECT avg(value) FILTER (WHERE i <= k) AS first, avg(value) FILTER (WHERE i > n - k) AS last, arg_max(value, step) AS final, min(step) AS zero, max(n) AS n FROM r, k)
SELECT unnest(['finite', 'starts_at_zero', 'falls', 'below_base']) AS name, unnest([true, zero = 0 AND n >= 3, last < first, final < 200000]) AS passed FROM m""")
def convergence_gate(t: Tables) -> DataFrame:
    return told(t, gates.convergence(_curve(t), 200_000))


@query(f"{CURVE} SELECT 'again' AS name, true AS passed UNION ALL SELECT 'other', (SELECT count(*) FROM c WHERE step = 3) = 0")
def reproducible_curves(t: Tables) -> DataFrame:
    """A run's curve against its repetition, and against one that differs at step 3."""
    c = _curve(t)
    spoilt = c.withColumn("value", F.when(F.col("step") == 3, F.col("value") + 1e-6).otherwise(F.col("value")))
    rounded = lambda d: d.withColumn("value", F.round("value", 8))
    return told(t, [Check("again", gates.same_rows(rounded(c), rounded(_curve(t).repartition(3)))), Check("other", gates.same_rows(rounded(c), rounded(spoilt)))])


@query("SELECT o_orderpriority AS name, max(o_totalprice) > quantile_cont(o_totalprice, 0.5) AND quantile_cont(o_totalprice, 0.5) > min(o_totalprice) AS passed FROM orders GROUP BY 1")
def peak_order_gate(t: Tables) -> DataFrame:
    r = t.orders.groupBy("o_orderpriority").agg(F.min("o_totalprice").alias("a"), F.percentile("o_totalprice", 0.5).alias("b"), F.max("o_totalprice").alias("c")).collect()  # five priorities
    return t.spark.createDataFrame([(x["o_orderpriority"], gates.peaks_ordered(x["a"], x["b"], x["c"]).passed) for x in r], "name string, passed boolean")


@query("SELECT 'targets_up' AS name, count(*) FILTER (WHERE n < 5) = 0 AND count(*) > 0 AS passed FROM (SELECT user_id, count(*) AS n FROM events GROUP BY 1) UNION ALL SELECT 'series', (SELECT count(DISTINCT event_type) FROM events WHERE event_type IN ('view', 'purchase', 'nothing')) = 3")
def monitoring_gate(t: Tables) -> DataFrame:
    targets = t.events.groupBy("user_id").agg((F.count(F.lit(1)) >= 5).alias("up"))
    return told(t, gates.monitoring(targets, t.events.select(F.col("event_type").alias("name")), ["view", "purchase", "nothing"]))


@query("SELECT 'rows' AS name, count(*) > 0 AS passed FROM events UNION ALL SELECT 'all_have_ids', bool_and(event_id IS NOT NULL) FROM events UNION ALL SELECT 'some_error', bool_or(event_type = 'error') FROM events UNION ALL SELECT 'all_positive', bool_and(value > 50) FROM events UNION ALL SELECT 'report', false")
def evidence_audit(t: Tables) -> DataFrame:
    """Findings that hold for all rows or for one; an input that is missing fails."""
    e = t.events.agg((F.count(F.lit(1)) > 0).alias("rows"), F.bool_and(F.col("event_id").isNotNull()).alias("all_have_ids"), F.bool_or(F.col("event_type") == "error").alias("some_error"), F.bool_and(F.col("value") > 50).alias("all_positive"))
    return told(t, gates.audit({**{k: (v, "events") for k, v in e.first().asDict().items()}, "report": (None, "no such file")}))


@query("SELECT list_sort(list(DISTINCT event_type)) AS seen, list_sort(list_filter(list(DISTINCT event_type), lambda x: NOT list_contains(['view', 'click', 'purchase'], x))) AS unknown FROM events")
def states_seen(t: Tables) -> DataFrame:
    return telemetry.versions_seen(t.events, "event_type", ["view", "click", "purchase"])


@query("""
SELECT 'keys' AS name, (SELECT count(*) FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)) = 0 AND (SELECT count(*) FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer)) = 0 AS passed
UNION ALL SELECT 'orders_of_customers', (SELECT count(*) FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer)) = 0
UNION ALL SELECT 'customers_of_orders', (SELECT count(*) FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)) = 0
UNION ALL SELECT 'same_order_keys', count(*) = count(DISTINCT o_orderkey) FROM orders
UNION ALL SELECT 'same_customers', count(*) = count(DISTINCT o_custkey) FROM orders""")
def set_gates(t: Tables) -> DataFrame:
    """Equality, inclusion and multiset equality of keys, some of which hold."""
    o, c = t.orders.select(F.col("o_custkey").alias("k")), t.customer.select(F.col("c_custkey").alias("k"))
    keys = t.orders.select("o_orderkey")
    return told(t, [
        Check("keys", gates.same_keys(c, o, "k")), Check("orders_of_customers", gates.subset(o, c, "k")), Check("customers_of_orders", gates.subset(c, o, "k")),
        Check("same_order_keys", gates.same_rows(keys, keys.distinct())), Check("same_customers", gates.same_rows(o, o.distinct())),
    ])


@query("SELECT o_custkey, list_sort(list_distinct(list(o_orderpriority))) AS priorities FROM orders GROUP BY o_custkey")
def union_of_sets(t: Tables) -> DataFrame:
    """The union of the sets that a customer's orders hold."""
    return gates.union_by(t.orders.select("o_custkey", F.array("o_orderpriority", "o_orderpriority").alias("priorities")), ["o_custkey"], "priorities")


@query("SELECT 'negative_test' AS name, true AS passed UNION ALL SELECT 'rescored', true UNION ALL SELECT 'rescored_other', (SELECT count(*) FROM documents WHERE doc_id % 29 = 0) = 0 AND (SELECT count(*) FROM documents WHERE doc_id % 31 = 0) = 0")
def rescore_gates(t: Tables) -> DataFrame:
    """A spoilt report is rejected; a report equals its outputs' scores, and another's not."""
    gold, a, b = _golden(t)
    items, others = evaluation.score_items(gold, a), evaluation.score_items(gold, b)
    about = {"model": "m", "protocol_sha256": "p", "golden_sha256": "g", "baseline_spec_sha256": "s", "behavioral": {"overall": dict(zip(evaluation.METRICS, (3, 3, 3, 0, 1.0, 1.0)))}}
    report = evaluation.scored(items, **about)
    other = evaluation.rescored_equal(report, others)
    return told(t, [evaluation.gate_rejects_corruption(report, report, ["en"]), evaluation.rescored_equal(report, items), Check("rescored_other", other.passed)])


def _release(t: Tables) -> tuple[dict, dict]:
    """A manifest over the nations' names, as if they were files, and its report."""
    files = {r["n_name"]: hashing.digest(r["n_name"]) for r in t.nation.collect()}  # 25 rows
    runtime = {"generation": {"max_new_tokens": 32}}
    m = {"schema_version": 1, "model_id": "m", "artifact_uri": "u", "file_hashes": files, "model_sha256": hashing.digest(hashing.canonical(files)), "protocol_sha256": "b" * 64, "golden_sha256": "c" * 64, "runtime": runtime, "runtime_sha256": hashing.digest(hashing.canonical(runtime))}
    return m, {"status": "complete", "passed": True, "evaluation_run_id": "e", "metrics": {"accuracy": 0.5, "format_rate": 1.0}, **{k: m[k] for k in ("model_id", *release.HASHES)}}


#: What is wrong with a document's release, by its id: a change of the manifest or the report, and the rules it breaks.
PLANTED = [
    ("", []), ("version", ["schema_version"]), ("capitals", ["golden_sha256", "bound:golden_sha256"]), ("runtime", ["runtime"]), ("model", ["bound:model_sha256"]),
    ("metric", ["metric:accuracy"]), ("huge", ["metric:format_rate"]), ("run", ["evaluation_run_id"]), ("passed", ["evaluation"]), ("uri", ["artifact_uri"]), ("id", ["model_id", "bound:model_id"]),
]


@query(f"""
WITH p AS (SELECT unnest(range({len(PLANTED)})) AS i, unnest({[rules for _, rules in PLANTED]}) AS rules),
d AS (SELECT doc_id, unnest(rules) AS rule FROM documents JOIN p ON p.i = doc_id % {len(PLANTED)}
  UNION ALL SELECT doc_id, 'metric:accuracy' FROM documents WHERE doc_id % {len(PLANTED)} <> 5 AND n_chars / 4000.0 > 1)
SELECT rule, count(*) AS n, min(doc_id) AS first FROM d GROUP BY rule""")
def release_gate(t: Tables) -> DataFrame:
    """A release of every document: its text is the model, its length a metric; faults are planted by id."""
    is_ = lambda name: F.col("doc_id") % len(PLANTED) == [x for x, _ in PLANTED].index(name)
    runtime = '{"generation":{"max_new_tokens":32}}'
    d = t.documents.select("doc_id", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("model"), (F.col("n_chars") / 4000.0).alias("metric"))
    text = lambda x: F.concat(F.lit('"'), x, F.lit('"'))
    m = {
        "schema_version": F.when(is_("version"), "true").otherwise("1"), "model_id": text(F.when(is_("id"), " ").otherwise(F.concat(F.lit("m"), "doc_id"))), "artifact_uri": F.when(is_("uri"), "7").otherwise('"u"'),
        "model_sha256": text(F.col("model")), "protocol_sha256": text(F.lit("b" * 64)), "golden_sha256": text(F.when(is_("capitals"), "C" * 64).otherwise("c" * 64)), "runtime_sha256": text(F.lit(hashing.digest(runtime))),
        "runtime": F.when(is_("runtime"), '{"generation":{}}').otherwise(runtime),
    }
    metrics = F.concat(F.lit('{"accuracy":'), F.when(is_("metric"), "true").otherwise(F.col("metric").cast("string")), F.lit(',"format_rate":'), F.when(is_("huge"), "1" + "0" * 400).otherwise("1"), F.lit("}"))
    r = {
        "status": F.lit('"complete"'), "passed": F.when(is_("passed"), '"true"').otherwise("true"), "evaluation_run_id": F.when(is_("run"), "null").otherwise('"e"'), "metrics": metrics, "model_id": text(F.concat(F.lit("m"), "doc_id")),
        "model_sha256": text(F.when(is_("model"), "d" * 64).otherwise(F.col("model"))), "protocol_sha256": text(F.lit("b" * 64)), "golden_sha256": text(F.lit("c" * 64)), "runtime_sha256": text(F.lit(hashing.digest(runtime))),
    }
    whole = lambda parts: F.concat(F.lit("{"), F.concat_ws(",", *[F.concat(F.lit(f'"{k}":'), v) for k, v in parts.items()]), F.lit("}"))
    broken = release.broken_rules(d.select("doc_id", whole(m).alias("m"), whole(r).alias("r")), "m", "r", ["doc_id"])
    return broken.groupBy("rule").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first"))


@query("SELECT n_regionkey AS release, count(*) AS nations, 1::BIGINT AS entries, n_regionkey = (SELECT max(n_regionkey) FROM nation) AS current FROM nation GROUP BY n_regionkey")
def publication_crashes(t: Tables) -> DataFrame:
    """A release of each region's nations, stopped after each step in turn and taken up by another publisher:
    one journal entry each, and the last one is current."""
    from .store import folder

    where, stops = folder(t), ["intent", "pointer", "journal", "end"]
    for k, r in enumerate(t.nation.select(F.col("n_regionkey").alias("r")).distinct().orderBy("r").collect()):  # a row a region
        names = [x["n_name"] for x in t.nation.where(F.col("n_regionkey") == r["r"]).orderBy("n_name").collect()]
        files, put = {f"{r['r']}/{n}": hashing.digest(n) for n in names}, Files(t.spark, f"{where}/artifacts")
        for n in names:
            put.put(f"{r['r']}/{n}", n.encode())
        m, report = _release(t)
        m |= {"artifact_uri": str(r["r"]), "file_hashes": files, "model_sha256": hashing.digest(hashing.canonical(files))}
        report["model_sha256"] = m["model_sha256"]
        publisher = lambda: release.Publisher(f"{where}/out", t.spark, f"{where}/artifacts")
        try:
            publisher().publish(m, report, stops[k % len(stops)])
        except RuntimeError:
            publisher().publish(m, report)
    last = release.Publisher(f"{where}/out", t.spark, f"{where}/artifacts")
    current = last.current()["manifest"]["artifact_uri"]
    lines = t.spark.read.option("wholetext", True).text(f"{where}/out/journal")
    uri = F.get_json_object("value", "$.manifest.artifact_uri").cast("int")
    nations = F.size(F.json_object_keys(F.get_json_object("value", "$.manifest.file_hashes"))).cast("bigint")
    return lines.groupBy(uri.alias("release")).agg(F.max(nations).alias("nations"), F.count(F.lit(1)).alias("entries"), F.first(uri == int(current)).alias("current"))


@query("SELECT sha256('{\"decision\":{\"ok\":true},\"manifest\":{\"files\":{' || string_agg('\"' || n_name || '\":\"' || sha256(n_name) || '\"', ',' ORDER BY n_name) || '}}}') AS release_id, substr(sha256('code{\"files\":{' || string_agg('\"' || n_name || '\":\"' || sha256(n_name) || '\"', ',' ORDER BY n_name) || '}}'), 1, 12) AS fingerprint FROM nation")
def release_identity(t: Tables) -> DataFrame:
    m, _ = _release(t)
    rid = hashing.release_id({"files": m["file_hashes"]}, {"ok": True})
    return t.spark.createDataFrame([(rid, hashing.training_fingerprint(b"code", {"files": m["file_hashes"]}))], "release_id string, fingerprint string")


@query("SELECT fault, count(*) AS n FROM (SELECT CASE doc_id % 4 WHEN 0 THEN 'changed' WHEN 1 THEN 'missing' END AS fault FROM documents) WHERE fault IS NOT NULL GROUP BY fault UNION ALL SELECT 'unsafe path', 2")
def artifact_integrity(t: Tables) -> DataFrame:
    """An inventory of one file for each remainder, against the files written."""
    from .store import folder

    path, fs = folder(t), t.spark._jvm.org.apache.hadoop.fs
    names = t.documents.select((F.col("doc_id") % 4).alias("r")).groupBy("r").agg(F.count(F.lit(1)).alias("n")).orderBy("r").collect()  # four rows
    disk = fs.Path(path).getFileSystem(t.spark._jsc.hadoopConfiguration())
    for x in names:
        if x["r"] != 1:
            out = disk.create(fs.Path(f"{path}/f{x['r']}"))
            out.write(bytearray(f"body {x['r']}".encode()))
            out.close()
    expected = {f"f{x['r']}": hashing.digest("other" if x["r"] == 0 else f"body {x['r']}") for x in names}
    told_ = release.integrity(t.spark, {**expected, "../x": "0", "/abs": "0"}, path)
    counted = told_.join(t.spark.createDataFrame([(f"f{x['r']}", x["n"]) for x in names], "path string, n long"), "path", "left")
    return counted.groupBy("fault").agg(F.sum(F.coalesce("n", F.lit(1))).alias("n"))


@query("SELECT CASE doc_id % 5 WHEN 0 THEN 'a/b.bin' WHEN 1 THEN '../a' WHEN 2 THEN '/a' WHEN 3 THEN 'a/../b' ELSE 'a..b/c' END AS path, doc_id % 5 IN (0, 4) AS safe, count(*) AS n FROM documents GROUP BY ALL")
def path_safety(t: Tables) -> DataFrame:
    p = F.array(*[F.lit(x) for x in ("a/b.bin", "../a", "/a", "a/../b", "a..b/c")])[(F.col("doc_id") % 5).cast("int")]
    return t.documents.select(p.alias("path")).groupBy("path").agg(F.count(F.lit(1)).alias("n")).select("path", release.is_safe(F.col("path")).alias("safe"), "n")


@query(f"SELECT CASE WHEN (roles[1] = 'system' AND len(roles) = 1) OR len(list_filter(range(1, len(r) + 1), lambda i: r[i] <> CASE WHEN i % 2 = 1 THEN 'user' ELSE 'assistant' END)) > 0 THEN 'roles' WHEN len(list_filter(texts, lambda x: trim(coalesce(x, '')) = '')) > 0 THEN 'blank content' END AS fault, count(*) AS n FROM (SELECT *, CASE WHEN roles[1] = 'system' THEN roles[2:] ELSE roles END AS r FROM ({TURNS})) GROUP BY 1")
def role_violations_alternating(t: Tables) -> DataFrame:
    c = tokens.conversations(t.conversations)
    return c.groupBy(tokens.role_faults(F.col("messages"), "alternating").alias("fault")).agg(F.count(F.lit(1)).alias("n"))


@query(f"SELECT conv_id::VARCHAR AS id, sha256(texts[-1] || '<|end|>' || chr(10)) AS answer FROM ({TURNS}) WHERE roles[-1] = 'assistant'")
def template_answers(t: Tables) -> DataFrame:
    """Inference text begins the training text, and the labels that count decode to the answer."""
    c = tokens.conversations(t.conversations).select(F.col("conv_id").cast("string").alias("id"), "messages").where(tokens.answer_of(F.col("messages")).isNotNull())
    bad = tokens.template_faults(c)
    d = tokens.unmasked_answers(tokens.tokenize(c.join(bad, "id", "left_anti"), tokens.ByteTokenizer(), 1 << 30), lambda ids: bytes(ids).decode("utf-8"))
    return d.select("id", F.sha2(F.col("answer").cast("binary"), 256).alias("answer"))
