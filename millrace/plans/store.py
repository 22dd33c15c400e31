"""Queries of sources and sinks: what is written to the shared folder is read again and measured."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import hashing
from ..operators import tokens
from ..scratch import Scratch
from ..sources import jsonl
from ..sources import tables as src
from ..sources.files import Files
from ..streaming import snapshots, windows
from .registry import Tables, query


def folder(t: Tables) -> str:
    """A new name in the shared folder."""
    return f"{Scratch(t.spark).root}/{uuid.uuid4().hex}"


@query("SELECT count(*) AS n, 0::BIGINT AS first, count(*) - 1 AS last, (sum(o_orderkey) / count(*))::DOUBLE AS mean FROM orders")
def parquet_positions(t: Tables) -> DataFrame:
    d = src.with_position(t.spark, f"{t.sf_dir}/orders.parquet", ["o_orderkey"])
    by_file = d.groupBy("file").agg(F.count(F.lit(1)).alias("n"), F.min("row").alias("first"), F.max("row").alias("last"), F.sum("o_orderkey").alias("s"))
    return by_file.agg(F.sum("n").alias("n"), F.max("first").alias("first"), F.max("last").alias("last"), (F.sum("s") / F.sum("n")).alias("mean"))


@query("SELECT n_nationkey, n_name FROM nation ORDER BY n_nationkey LIMIT 7")
def parquet_head(t: Tables) -> DataFrame:
    return src.head(src.with_position(t.spark, f"{t.sf_dir}/nation.parquet", ["n_nationkey", "n_name"]), 7).select("n_nationkey", "n_name")


@query("SELECT origin, count(*) AS n FROM (SELECT 'nation' AS origin, n_name FROM nation UNION ALL SELECT 'region', r_name FROM region UNION ALL SELECT 'supplier', s_name FROM supplier) GROUP BY origin")
def table_concat(t: Tables) -> DataFrame:
    named = lambda df, origin, col: df.select(F.lit(origin).alias("origin"), F.col(col).alias("name"))
    return src.rows_of(src.concat(named(t.nation, "nation", "n_name"), named(t.region, "region", "r_name"), named(t.supplier, "supplier", "s_name")), "origin", "name")


@query("SELECT w AS wanted, w IN (SELECT column_name FROM (DESCRIBE orders)) AS present FROM (SELECT unnest(['o_orderkey', 'o_comment', 'o_custkey', 'O_CUSTKEY', 'doc_id']) AS w)")
def required_columns(t: Tables) -> DataFrame:
    """Declared columns are read; that a missing one is an error is `require`'s part."""
    wanted = ["o_orderkey", "o_comment", "o_custkey", "O_CUSTKEY", "doc_id"]
    return src.present(src.require(t.orders, ["o_orderkey", "o_custkey"]), wanted)


def _chats(t: Tables) -> DataFrame:
    turn = lambda role, content: F.struct(F.lit(role).alias("role"), content.alias("content"))
    d = t.documents.where("trim(text) <> '' and lang is not null")
    return d.select(F.col("doc_id").cast("string").alias("id"), F.col("lang").alias("topic"), F.array(turn("system", F.lit("s")), turn("user", F.col("source")), turn("assistant", F.col("text"))).alias("messages"))


@query(r"SELECT lang AS topic, count(*) AS n, sum(length(text))::BIGINT AS chars FROM documents WHERE trim(text) <> '' AND lang IS NOT NULL AND trim(source) <> '' AND regexp_matches(text, '[^\s]') GROUP BY lang")
def jsonl_strict_roundtrip(t: Tables) -> DataFrame:
    """Chats written as JSON lines and read under the strict contract."""
    path = folder(t)
    jsonl.write_jsonl(_chats(t).where(F.length(F.regexp_replace(F.col("messages")[2]["content"], r"(?U)[\s\x1c-\x1f]", "")) > 0), path)
    back = jsonl.strict_chat(t.spark, path)
    return back.groupBy("topic").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length(F.col("messages")[2]["content"])).alias("chars"))


LINES = ['{"id":"1","topic":"t","messages":[{"role":"system","content":"s"},{"role":"user","content":"u"},{"role":"assistant","content":"a"}]}', " ", "[1]", '{"id":"1","topic":"t"}', '{"id":"1","topic":"t","messages":[{"role":"user","content":"u"}]}', '{"id":" ","topic":"t","messages":[]}', '{"id":"1","topic":"t","messages":[{"role":"system","content":"s"},{"role":"user","content":" "},{"role":"assistant","content":"a"}]}']
FAULTS = [None, "blank line", "not an object", "fields are not id, topic, messages", "roles are not system, user, assistant", "id or topic", "blank content"]


@query("SELECT CASE doc_id % 7 " + " ".join(f"WHEN {i} THEN '{f}'" for i, f in enumerate(FAULTS) if f) + " END AS fault, count(*) AS n FROM documents GROUP BY 1")
def jsonl_line_faults(t: Tables) -> DataFrame:
    d = t.documents.select(F.lit("f").alias("path"), F.col("doc_id").cast("int").alias("line"), F.array(*[F.lit(x) for x in LINES])[(F.col("doc_id") % 7).cast("int")].alias("value"))
    told = d.mapInPandas(jsonl._faults, "path string, line int, value string, fault string")
    return told.groupBy("fault").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT count(*) AS lines, min(doc_id) + 1 AS first, max(doc_id) + 1 AS last FROM documents")
def numbered_text_lines(t: Tables) -> DataFrame:
    """Lines of one file, numbered from 1 whatever splits it is read in."""
    path = folder(t)
    t.documents.select("doc_id").orderBy("doc_id").coalesce(1).write.csv(path)
    lines = jsonl.numbered_lines(t.spark, path).where(F.col("line") == F.col("value").cast("int") + 1)
    return lines.agg(F.count(F.lit(1)).alias("lines"), F.min("line").cast("bigint").alias("first"), F.max("line").cast("bigint").alias("last"))


@query("SELECT count(*) AS n, sum(event_id)::BIGINT AS ids FROM events")
def jsonl_lenient_scan(t: Tables) -> DataFrame:
    """Blank lines between the rows are passed over."""
    path = folder(t)
    t.events.select(F.explode(F.array(F.to_json(F.struct("event_id")), F.lit(""), F.lit("  "))).alias("value")).write.text(path)
    return jsonl.lenient(t.spark, path, "event_id long").where("event_id is not null").agg(F.count(F.lit(1)).alias("n"), F.sum("event_id").alias("ids"))


@query("SELECT 'documents' AS name, count(*) = count(DISTINCT doc_id) AND count(*) = count(doc_id) AS sound FROM documents UNION ALL SELECT 'sources', count(*) = count(DISTINCT source) AND count(*) = count(source) FROM documents UNION ALL SELECT 'nothing', false")
def unique_id_contract(t: Tables) -> DataFrame:
    def sound(ids: DataFrame) -> bool:
        try:
            jsonl.unique_ids(ids)
        except ValueError:
            return False
        return True

    ids = t.documents.select(F.col("doc_id").cast("string").alias("id"))
    cases = {"documents": ids, "sources": t.documents.select(F.col("source").alias("id")), "nothing": ids.limit(0)}
    return t.spark.createDataFrame([(k, sound(v)) for k, v in cases.items()], "name string, sound boolean")


@query("SELECT CASE WHEN doc_id % 10 < 8 THEN 'train' WHEN doc_id % 10 = 8 THEN 'val' ELSE 'test' END AS split, count(*) AS n, sum(length(text))::BIGINT AS chars FROM documents GROUP BY 1")
def split_sink(t: Tables) -> DataFrame:
    path, m = folder(t), F.col("doc_id") % 10
    jsonl.write_splits(t.documents.select("text", F.when(m < 8, "train").when(m == 8, "val").otherwise("test").alias("split")), path)
    back = t.spark.read.schema("text string, split string").json(path)
    return back.groupBy("split").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("text")).alias("chars"))


@query("SELECT p_brand, count(*) AS n, round(sum(p_retailprice), 2) AS price FROM part GROUP BY p_brand")
def csv_sink(t: Tables) -> DataFrame:
    path = folder(t)
    jsonl.write_csv(t.part.select("p_brand", "p_name", "p_retailprice"), path)
    back = t.spark.read.option("header", True).schema("p_brand string, p_name string, p_retailprice double").csv(path)
    return back.groupBy("p_brand").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("p_retailprice"), 2).alias("price"))


@query("SELECT s_nationkey, 2 * count(*) AS attempts, count(*) AS suppliers FROM supplier GROUP BY s_nationkey")
def append_sink(t: Tables) -> DataFrame:
    """A journal of two attempts."""
    path = folder(t)
    for attempt in (1, 2):
        jsonl.append_jsonl(t.supplier.select("s_suppkey", "s_nationkey", F.lit(attempt).alias("attempt")), path)
    back = t.spark.read.schema("s_suppkey long, s_nationkey int, attempt int").json(path)
    return back.groupBy("s_nationkey").agg(F.count(F.lit(1)).alias("attempts"), F.count_distinct("s_suppkey").alias("suppliers"))


@query("""
SELECT list_reduce(list_transform(range(1, 41), lambda i: (instr('0123456789abcdef', sha1(concat(p_brand, chr(0), p_name))[i]) - 1)::BIGINT), lambda a, d: (a * 16 + d) % 2, 0::BIGINT) AS shard, count(*) AS n, sum(p_size)::BIGINT AS size FROM part GROUP BY 1""")
def shard_files(t: Tables) -> DataFrame:
    path = folder(t)
    src.write_shards(t.part.select("p_brand", "p_name", "p_size"), ["p_brand", "p_name"], 2, path)
    return t.spark.read.parquet(path).groupBy(F.col("shard").cast("bigint").alias("shard")).agg(F.count(F.lit(1)).alias("n"), F.sum("p_size").alias("size"))


@query("SELECT event_type, count(*) AS n, sum(event_id)::BIGINT AS ids FROM events WHERE event_id % 3 < 2 GROUP BY event_type")
def mixed_log_scan(t: Tables) -> DataFrame:
    """Lines of a server: two of three are JSON objects, the others start alike and are none."""
    path, whole = folder(t), F.to_json(F.struct("event_id", "event_type"))
    t.events.select(F.when(F.col("event_id") % 3 < 2, whole).otherwise(F.concat(whole, F.lit(" trailing {"))).alias("value")).write.text(path)
    return src.log_events(t.spark, path, "event_id long, event_type string").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("event_id").alias("ids"))


HOURS = "SELECT epoch_us(ts) // 3600000000 AS h, user_id % 6 AS pod, max(event_id % 4 > 0) AS ready, (sum(event_id) % 2)::INT AS restarts FROM events GROUP BY ALL"


def _snapshots(t: Tables) -> DataFrame:
    """A snapshot an hour: the pods that had an event, one endpoint of those with an even number."""
    h = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 3_600_000_000)
    pods = t.events.groupBy(h.alias("h"), (F.col("user_id") % 6).alias("pod")).agg(F.max(F.col("event_id") % 4 > 0).alias("ready"), F.pmod(F.sum("event_id"), F.lit(2)).cast("int").alias("restarts"))
    name = F.concat(F.lit("pod"), "pod")
    item = F.struct(name.alias("name"), name.alias("uid"), "ready", "restarts")
    address = F.struct(name.alias("pod"), "ready")
    s = pods.groupBy(F.col("h").cast("double").alias("wall_time")).agg(F.collect_list(item).alias("p"), F.collect_list(F.when(F.col("pod") % 2 == 0, address)).alias("a"))
    path = folder(t)
    services = F.array(F.struct(F.lit("other").alias("service"), F.array(F.struct(F.lit("x").alias("pod"), F.lit(True).alias("ready"))).alias("addresses")), F.struct(F.lit("api").alias("service"), F.col("a").alias("addresses")))
    jsonl.write_jsonl(s.select("wall_time", F.struct(F.col("p").alias("items")).alias("pods"), F.struct(services.alias("items")).alias("endpoints")), path)
    return src.snapshots(t.spark, path)


@query(f"SELECT 'pod' || pod AS name, count(*) AS seen, count(*) FILTER (WHERE ready) AS ready, sum(restarts)::BIGINT AS restarts FROM ({HOURS}) GROUP BY pod")
def snapshot_pods(t: Tables) -> DataFrame:
    return src.pods_of(_snapshots(t)).groupBy("name").agg(F.count(F.lit(1)).alias("seen"), F.count_if("ready").alias("ready"), F.sum("restarts").alias("restarts"))


@query(f"SELECT 'pod' || pod AS name, count(*) AS seen, count(*) FILTER (WHERE ready) AS ready, sum(restarts)::BIGINT AS restarts FROM ({HOURS}) GROUP BY pod")
def polled_pods(t: Tables) -> DataFrame:
    """The snapshots as answers to polls, 200 a poll. Every poll is another run of the stream, which goes on
    from its checkpoint."""
    root = Scratch(t.spark).root
    _snapshots(t).write.json(f"{root}/answers")
    stream = snapshots.polled(t.spark, journal=f"{root}/journal", poll="millrace.streaming.snapshots:next_lines", file=f"{root}/answers", lines="200")
    seen, journal = -1, snapshots.Journal(f"{root}/journal")
    while journal.size() > seen:
        seen = journal.size()
        windows.finish(stream, windows.once_per_batch(f"{root}/out"), f"{root}/state")
    body = F.from_json("body", src.SNAPSHOT)
    read = t.spark.read.parquet(f"{root}/out").select(body.alias("x")).select("x.*")
    return src.pods_of(read).groupBy("name").agg(F.count(F.lit(1)).alias("seen"), F.count_if("ready").alias("ready"), F.sum("restarts").alias("restarts"))


@query(f"SELECT ready, count(*) AS snapshots FROM (SELECT h, coalesce(bool_or(ready AND pod % 2 = 0), false) AS ready FROM ({HOURS}) GROUP BY h) GROUP BY ready")
def snapshot_endpoint_ready(t: Tables) -> DataFrame:
    return src.endpoint_ready(_snapshots(t), "api").groupBy("ready").agg(F.count(F.lit(1)).alias("snapshots"))


@query(f"SELECT same_pods, no_restarts, count(*) AS snapshots FROM (SELECT h, list_sort(list(pod)) = [0, 1, 2, 3, 4, 5] AS same_pods, bool_and(restarts = 0) AS no_restarts FROM ({HOURS}) GROUP BY h) GROUP BY ALL")
def snapshot_baseline(t: Tables) -> DataFrame:
    from ..operators import telemetry

    kept = telemetry.baseline_kept(src.pods_of(_snapshots(t)), [f"pod{i}" for i in range(6)])
    return kept.groupBy("same_pods", "no_restarts").agg(F.count(F.lit(1)).alias("snapshots"))


@query("SELECT 'pod' || user_id % 4 AS pod, count(*) AS samples, round(sum(value), 2) AS total, max(epoch_us(ts) / 1e6)::DOUBLE AS last FROM events GROUP BY 1")
def series_scan(t: Tables) -> DataFrame:
    """A matrix of samples, numbers as text."""
    ts = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    m = t.events.groupBy(F.concat(F.lit("pod"), F.col("user_id") % 4).alias("pod"), (F.col("event_id") % 50).alias("part")).agg(F.collect_list(F.array(ts.cast("decimal(20,6)").cast("string"), F.col("value").cast("string"))).alias("values"))
    path = folder(t)
    jsonl.write_jsonl(m.select(F.create_map(F.lit("pod"), "pod", F.lit("__name__"), F.lit("cpu")).alias("metric"), "values"), path)
    return src.series(t.spark, path).groupBy("pod").agg(F.count(F.lit(1)).alias("samples"), F.round(F.sum("value"), 2).alias("total"), F.max("ts").alias("last"))


@query("SELECT le, sum(n)::DOUBLE AS cum FROM (SELECT le, user_id % 3 AS pod, count(*) FILTER (WHERE value <= le) AS n FROM events, (SELECT unnest([10::DOUBLE, 100::DOUBLE, 'inf'::DOUBLE]) AS le) GROUP BY ALL) GROUP BY le")
def instant_buckets(t: Tables) -> DataFrame:
    """Buckets of three instances, summed by bound."""
    from ..functions import stats

    c = stats.cumulative(t.events.withColumn("pod", F.col("user_id") % 3), "value", [10.0, 100.0], ["pod"])
    le = F.when(F.col("le") == float("inf"), "Infinity").otherwise(F.col("le").cast("string"))
    labels = F.create_map(F.lit("__name__"), F.lit("seconds_bucket"), F.lit("le"), le, F.lit("pod"), F.col("pod").cast("string"))
    path = folder(t)
    jsonl.write_jsonl(c.select(labels.alias("metric"), F.array(F.lit("0"), F.col("cum").cast("string")).alias("value")), path)
    return src.instant(t.spark, path, "seconds_bucket").groupBy("le").agg(F.sum("value").alias("cum"))


@query("SELECT 'run' || user_id % 3 AS run, count(*) AS n, sum(event_id)::BIGINT AS ids FROM events GROUP BY 1")
def runs_union(t: Tables) -> DataFrame:
    """Files of several runs, each named after its run."""
    path, fs = folder(t), t.spark._jvm.org.apache.hadoop.fs
    for k in range(3):
        at = f"{path}/{k}"
        t.events.where(F.col("user_id") % 3 == k).select("event_id").coalesce(1).write.json(at)
        root = fs.Path(at)
        disk = root.getFileSystem(t.spark._jsc.hadoopConfiguration())
        part = next(f.getPath() for f in disk.listStatus(root) if f.getPath().getName().startswith("part-"))
        disk.mkdirs(fs.Path(f"{path}/all"))
        disk.rename(part, fs.Path(f"{path}/all/run{k}-requests.jsonl"))
    return src.runs_union(t.spark, f"{path}/all/*-requests.jsonl", "event_id long").groupBy("run").agg(F.count(F.lit(1)).alias("n"), F.sum("event_id").alias("ids"))


@query("SELECT o_custkey, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS last, arg_min(o_orderkey, (o_orderdate, o_orderkey)) AS first FROM orders GROUP BY o_custkey")
def first_and_last_rows(t: Tables) -> DataFrame:
    o = t.orders.select("o_custkey", "o_orderkey", "o_orderdate")
    last = src.last_rows(o, ["o_custkey"], ["o_orderdate", "o_orderkey"]).select("o_custkey", F.col("o_orderkey").alias("last"))
    first = src.first_rows(o, ["o_custkey"], ["o_orderdate", "o_orderkey"]).select("o_custkey", F.col("o_orderkey").alias("first"))
    return last.join(first, "o_custkey")


def registry(t: Tables) -> DataFrame:
    """Orders as runs of a sweep: the priority is the candidate, the customer's number the parent."""
    tags = F.create_map(F.lit("parent"), (F.col("o_custkey") % 5).cast("string"), F.lit("kind"), F.when(F.col("o_orderkey") % 4 > 0, "candidate").otherwise("probe"), F.lit("base_revision"), F.lit("r1"))
    return t.orders.select(F.col("o_orderkey").cast("string").alias("run_id"), F.col("o_orderpriority").alias("candidate"), F.when(F.col("o_orderstatus") == "F", "FINISHED").otherwise("RUNNING").alias("status"), (F.col("o_totalprice") / 1000).alias("final_val_loss"), tags.alias("tags"))


@query("SELECT o_orderkey::VARCHAR AS run_id, o_orderpriority AS candidate FROM orders WHERE o_custkey % 5 = 3 AND o_orderkey % 4 > 0")
def registry_filter(t: Tables) -> DataFrame:
    return src.runs_of(registry(t), "3").select("run_id", "candidate")


@query("SELECT name, count(*) AS steps, round(sum(v), 4) AS total FROM (SELECT 'loss' AS name, round(o_totalprice / 1000, 4) AS v FROM orders UNION ALL SELECT 'key', o_orderkey::DOUBLE FROM orders) GROUP BY name")
def metric_log(t: Tables) -> DataFrame:
    """The values of two callbacks, appended."""
    path = folder(t)
    d = t.orders.select(F.round(F.col("o_totalprice") / 1000, 4).alias("loss"), F.col("o_orderkey").alias("key"))
    for step in (0, 1):
        src.log_metrics(d.where(F.col("key") % 2 == step), "r", step, path)
    return t.spark.read.parquet(path).groupBy("name").agg(F.count(F.lit(1)).alias("steps"), F.round(F.sum("value"), 4).alias("total"))


@query("SELECT r_regionkey, count(*) AS chars FROM (SELECT r_regionkey, unnest(range(length('| ' || r_regionkey || ' | ' || r_name || ' |'))) FROM region) GROUP BY r_regionkey")
def markdown_rows(t: Tables) -> DataFrame:
    """A report table as Markdown; its lines are rows again."""
    text = src.markdown(t.region.select("r_regionkey", "r_name").orderBy("r_regionkey"))
    lines = text.split("\n")[2:]
    return t.spark.createDataFrame([(int(x.split("|")[1]), len(x)) for x in lines], "r_regionkey int, chars long")


@query("SELECT n_nationkey, length('<tr><td>' || n_nationkey || '</td><td>' || replace(n_name, '_', '&amp;') || '</td></tr>') AS chars FROM nation")
def html_rows(t: Tables) -> DataFrame:
    """A report table as HTML, its texts escaped; its lines are rows again."""
    named = t.nation.select("n_nationkey", F.translate("n_name", "_", "&").alias("n_name"))
    lines = src.html(named).split("\n")[2:-1]
    return t.spark.createDataFrame([(int(x.split("<td>")[1].split("<")[0]), len(x)) for x in lines], "n_nationkey int, chars long")


@query("SELECT lang, sha256('{\"chars\":' || sum(length(text)) || ',\"n\":' || count(*) || '}') AS digest FROM documents GROUP BY lang")
def metric_documents(t: Tables) -> DataFrame:
    """A metrics document for each language, put in place in the canonical form, and read again."""
    d = t.documents.groupBy("lang").agg(F.to_json(F.struct(F.count(F.lit(1)).alias("n"), F.sum(F.length("text")).alias("chars"))).alias("doc"))
    path = folder(t)
    files = Files(t.spark, path)
    for r in d.select("lang", hashing.canonical_json(F.col("doc")).alias("doc")).collect():  # a row a language
        files.put(f"lang-{r['lang']}.json", b"{}")
        files.put(f"lang-{r['lang']}.json", r["doc"].encode())
    read = t.spark.read.format("binaryFile").load(path)
    name = F.regexp_extract(F.col("_metadata.file_name"), r"lang-(.*)\.json", 1)
    return read.select(F.when(name != "None", name).alias("lang"), F.sha2("content", 256).alias("digest"))


@query("SELECT v AS version, count(*) AS parts, sum(p_size)::BIGINT AS size FROM part, (SELECT unnest(['first', 'whole']) AS v) WHERE v = 'whole' OR p_partkey % 2 = 0 GROUP BY v")
def version_rows(t: Tables) -> DataFrame:
    """Two versions of a table as lists of files; a version with a missing file and an unknown one are errors."""
    root = folder(t)
    for i, name in enumerate(("even", "odd")):
        t.part.where(F.col("p_partkey") % 2 == i).write.parquet(f"{root}/{name}")
    versions = {"first": [f"{root}/even"], "whole": [f"{root}/even", f"{root}/odd"], "broken": [f"{root}/even", f"{root}/gone"]}
    there = lambda path: Files(t.spark, path).exists("")
    for bad in ("broken", "unknown"):
        try:
            src.version_files(versions, bad, there)
            raise AssertionError(bad)
        except ValueError:
            pass
    rows = [t.spark.read.parquet(*src.version_files(versions, v, there)).agg(F.lit(v).alias("version"), F.count(F.lit(1)).alias("parts"), F.sum("p_size").alias("size")) for v in ("first", "whole")]
    return rows[0].unionByName(rows[1])


@query("""
SELECT p_brand, sha256('{"config":{"seed":42},"data_sha256":"' || sha256(string_agg(p_name, chr(10) ORDER BY p_partkey) || chr(10)) || '"}') AS cache_key FROM part GROUP BY p_brand""")
def cache_keys(t: Tables) -> DataFrame:
    """The key of a file's derived data, from its content and the configuration: one file a brand."""
    path = folder(t)
    named = t.part.select("p_brand", "p_partkey", F.col("p_name").alias("value")).repartition("p_brand").sortWithinPartitions("p_brand", "p_partkey")
    named.select("p_brand", "value").write.partitionBy("p_brand").text(path)
    files = t.spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    brand = F.url_decode(F.url_decode(F.regexp_extract(F.col("_metadata.file_path"), "p_brand=([^/]*)/", 1)))  # a folder's escapes, and the path's
    return files.select(brand.alias("p_brand"), hashing.cache_keys(F.sha2("content", 256), {"seed": 42}).alias("cache_key"))


@query("SELECT chat.rows AS rows, chat.tokens AS tokens, 2048 AS max_len, 'right' AS pad_side FROM (SELECT count(*) AS rows, sum(least(n, 2048))::BIGINT AS tokens FROM (SELECT sum(octet_length(encode('<|' || role || '|>' || chr(10) || text || '<|end|>' || chr(10)))) AS n, arg_max(role, turn) AS r FROM conversations GROUP BY conv_id) WHERE r = 'assistant') chat")
def token_table(t: Tables) -> DataFrame:
    """Token sequences written beside what a trainer must know of them."""
    from .chat import MOST, _tokenized

    path = folder(t)
    tokens.write_tokens(_tokenized(t), path, "bytes", MOST, 0)
    d, about = tokens.read_tokens(t.spark, path)
    n = d.agg(F.count(F.lit(1)).alias("rows"), F.sum(F.size("input_ids")).alias("tokens"))
    return n.select("rows", "tokens", F.lit(about["max_len"]).alias("max_len"), F.lit(about["pad_side"]).alias("pad_side"))
