"""Queries of the functions that records are made with: inputs, fences, syntax, arrays, times, identities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import hashing, stats, text
from ..operators import anatomy, curate, near, telemetry, tokens
from .chat import LENS, TURNS, _tokenized
from .registry import Tables, query


def pick(values: list[str | None], by: Column) -> Column:
    return F.array(*[F.lit(v) for v in values])[F.pmod(by, F.lit(len(values))).cast("int")]


def sql_pick(values: list[str | None], by: str) -> str:
    quoted = ", ".join("NULL" if v is None else "'" + v.replace("'", "''").replace("\n", "' || chr(10) || '").replace("\t", "' || chr(9) || '") + "'" for v in values)
    return f"([{quoted}])[{by} % {len(values)} + 1]"


GIVEN = [None, "", " \n ", " x = 1 ", "a\nb"]


@query(f"WITH d AS (SELECT doc_id, source, {sql_pick(GIVEN, 'doc_id')} AS g FROM documents) SELECT doc_id, CASE WHEN doc_id % 5 < 3 THEN source ELSE source || chr(10) || chr(10) || '{text.INPUT_HEADING}' || chr(10) || trim(g) END AS user_text FROM d")
def user_texts(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", text.join_input(F.col("source"), pick(GIVEN, F.col("doc_id"))).alias("user_text"))


FENCED = ["```python\nx = 1\n```", "  x = 1\n", "```\na\n\nb\n```\n ```\n", "plain", "```", "\n\n```py\n y\n```text\nz"]
CODE = ["x = 1", "x = 1", "a\n\nb", "plain", "", "y\n```text\nz"]


@query(f"SELECT doc_id, {sql_pick(CODE, 'doc_id')} AS code, doc_id % 6 IN (0, 2, 4, 5) AS fenced FROM documents")
def fenced_answers(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", text.strip_fence(pick(FENCED, F.col("doc_id"))).alias("c")).select("doc_id", "c.*")


@query("SELECT lang, sum(CASE WHEN coalesce(text, '') = '' THEN 0 ELSE len(regexp_extract_all(text, '\\r\\n|[\\n\\r\\x0b\\x0c\\x1c-\\x1e\\x{85}\\x{2028}\\x{2029}]')) + (NOT regexp_matches(text, '(\\r\\n|[\\n\\r\\x0b\\x0c\\x1c-\\x1e\\x{85}\\x{2028}\\x{2029}])\\z'))::INT END)::BIGINT AS lines FROM documents GROUP BY lang")
def line_totals(t: Tables) -> DataFrame:
    return t.documents.groupBy("lang").agg(F.sum(text.line_count(F.col("text"))).cast("bigint").alias("lines"))


SNIPPETS = ["x = 1", "x = = 1", "def f():\n    return 1", "print 'a'", "", "if x:\npass"]


@query(f"SELECT {sql_pick(SNIPPETS, 'doc_id')} AS code, doc_id % 6 IN (0, 2, 4) AS parses, count(*) AS n FROM documents GROUP BY ALL")
def syntax_by_snippet(t: Tables) -> DataFrame:
    d = t.documents.select(pick(SNIPPETS, F.col("doc_id")).alias("code"))
    return d.groupBy("code", text.parses(F.col("code")).alias("parses")).agg(F.count(F.lit(1)).alias("n"))


@query(r"SELECT doc_id, length(regexp_replace(regexp_replace(text, '\s+', ' ', 'g'), '^ | $', '', 'g')) AS chars FROM documents")
def clean_instructions(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", F.length(text.clean_instruction(F.col("text"))).cast("bigint").alias("chars"))


@query("SELECT lower(lang) || ' ' || lower(o) AS group_key, count(*) AS n FROM (SELECT lang, unnest(['A', 'b']) AS o FROM documents) GROUP BY 1")
def group_keys(t: Tables) -> DataFrame:
    """Topics as 'lang  A | detail' in mixed spacing; what stands before the bar is the group."""
    raw = t.documents.select("doc_id", "lang", F.explode(F.array(F.lit("A"), F.lit("b"))).alias("o")).select(F.concat(F.upper("lang"), F.lit(" \t "), "o", F.lit("  | detail "), "doc_id").alias("topic"))
    return raw.groupBy(text.normalize_group(F.col("topic")).alias("group_key")).agg(F.count(F.lit(1)).alias("n"))


PROMPTS = ["Be brief.", "Answer in code.", "Explain."]
COLLECT = f"""
WITH r AS (SELECT doc_id, 'tag' || doc_id % 3 || ' ' || source AS instruction, CASE WHEN doc_id % 5 < 3 THEN '' ELSE trim({sql_pick(GIVEN, 'doc_id')}) END AS input, {sql_pick(CODE, 'doc_id')} AS code, 'k' || doc_id % 3 AS topic FROM documents),
k AS (SELECT *, sha1(concat(instruction, chr(0), input, chr(0), code)) AS key FROM r WHERE code <> '' AND doc_id % 3 < 2),
f AS (SELECT *, (row_number() OVER (PARTITION BY key ORDER BY doc_id) = 1)::INT AS first FROM k),
b AS (SELECT *, coalesce(sum(first) OVER (PARTITION BY topic ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM f),
kept AS (SELECT *, 'doc-' || key[1:16] AS id FROM b WHERE first = 1 AND before < 30)
"""


def _collected(t: Tables) -> DataFrame:
    """Rows for the collecting scan: the label's keyword is in the instruction."""
    i = F.col("doc_id")
    rules = [("k0", ["tag0"]), ("k1", ["tag1"])]
    d = t.documents.select(F.lit("f").alias("file"), i.alias("row"), F.concat(F.lit(" tag"), (i % 3).cast("string"), F.lit(" \n"), "source").alias("instruction"), pick(GIVEN, i).alias("input"), pick(FENCED, i).alias("output"))
    return curate.collect(d, rules, 30, check_syntax=False)


@query(f"{COLLECT} SELECT id, topic, sha256(([{', '.join(repr(p) for p in PROMPTS)}])[list_reduce(list_transform(range(1, 41), lambda i: (instr('0123456789abcdef', sha1(id)[i]) - 1)::BIGINT), lambda a, d: (a * 16 + d) % 3, 0::BIGINT) + 1] || '|' || instruction || CASE WHEN input = '' THEN '' ELSE chr(10) || chr(10) || '{text.INPUT_HEADING}' || chr(10) || input END || '|' || code) AS turns FROM kept")
def chat_records(t: Tables) -> DataFrame:
    """Scan, cap, ids and messages of the collecting stage."""
    records = curate.chat_records(_collected(t).where("fate = 'kept'"), PROMPTS)
    return records.select("id", "topic", F.sha2(F.array_join(F.transform("messages", lambda m: m["content"]), "|").cast("binary"), 256).alias("turns"))


@query(f"SELECT conv_id, len(roles) AS turns, sha256(array_to_string(list_transform(range(1, len(roles) + 1), lambda i: roles[i] || ':' || texts[i]), '|')) AS digest FROM ({TURNS})")
def messages_projected(t: Tables) -> DataFrame:
    """Role and content alone of messages that carry more."""
    more = F.sort_array(F.collect_list(F.struct("turn", "role", F.col("text").alias("content"), F.lit("x").alias("extra"))))
    c = t.conversations.groupBy("conv_id").agg(more.alias("m")).select("conv_id", tokens.only_role_content(F.col("m")).alias("m"))
    return c.select("conv_id", F.size("m").cast("bigint").alias("turns"), F.sha2(F.array_join(F.transform("m", lambda x: F.concat(x["role"], F.lit(":"), x["content"])), "|").cast("binary"), 256).alias("digest"))


@query(f"SELECT conv_id, 'Q' || conv_id || chr(10) || array_to_string(list_transform(range(1, least(len(roles), 26) + 1), lambda i: chr((64 + i)::INT) || ') ' || roles[i]), chr(10)) AS question FROM ({TURNS})")
def rendered_questions(t: Tables) -> DataFrame:
    c = tokens.conversations(t.conversations)
    return c.select("conv_id", tokens.render_question(F.concat(F.lit("Q"), "conv_id"), F.slice(F.transform("messages", lambda m: m["role"]), 1, 26)).alias("question"))


@query(f"SELECT conv_id, 8 * len(texts) AS width, sum_tokens, kept FROM (SELECT conv_id, texts, list_sum(list_transform(texts, lambda x: least(length(x), 5)))::BIGINT AS sum_tokens, greatest(least(list_sum(list_transform(texts, lambda x: length(x))), 12) - 4, 0)::BIGINT AS kept FROM ({TURNS}))")
def array_operations(t: Tables) -> DataFrame:
    """Cut, concatenated, masked and padded arrays."""
    c = tokens.conversations(t.conversations).select("conv_id", F.transform("messages", lambda m: F.sequence(F.lit(1), F.length(m["content"]))).alias("ids"))
    whole = tokens.truncated(F.flatten("ids"), 12)
    d = c.select("conv_id", F.flatten(F.transform("ids", lambda x: tokens.truncated(x, 5))).alias("cut"), tokens.masked(whole, F.lit(4)).alias("labels"), (F.size("ids") * 8).alias("w"), "ids")
    padded = tokens.padded(tokens.truncated(F.flatten("ids"), 8), F.col("w"), 0)
    return d.select("conv_id", F.size(padded).cast("bigint").alias("width"), F.size("cut").cast("bigint").alias("sum_tokens"), F.size(F.filter("labels", lambda x: x != tokens.IGNORED)).cast("bigint").alias("kept"))


@query("SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S.%fZ') AS iso, epoch_us(ts) / 1e6 AS seconds FROM events")
def iso_times(t: Tables) -> DataFrame:
    s = t.events.select("event_id", (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("s"))
    d = s.select("event_id", stats.iso(F.col("s")).alias("iso"))
    return d.select("event_id", "iso", stats.epoch(F.col("iso")).alias("seconds"))


@query("SELECT l_orderkey, l_linenumber, ceil(l_quantity / 8)::BIGINT AS steps, round_even(l_extendedprice, 0) AS even, abs(l_discount - round(l_discount, 2)) <= 1e-9 * greatest(l_discount, round(l_discount, 2)) AS same FROM lineitem")
def rounding_rules(t: Tables) -> DataFrame:
    return t.lineitem.select("l_orderkey", "l_linenumber", stats.ceil_div(F.col("l_quantity"), 8).alias("steps"), stats.half_even(F.col("l_extendedprice"), 0).alias("even"), stats.close(F.col("l_discount"), F.round("l_discount", 2)).alias("same"))


@query("SELECT event_type, count(*) FILTER (WHERE k % 3 = 0) AS digests FROM (SELECT event_type, event_id AS k FROM events) GROUP BY event_type")
def digest_forms(t: Tables) -> DataFrame:
    """Only a lower-case SHA-256 as a whole is one."""
    i, h = F.col("event_id"), F.sha2(F.col("props").cast("binary"), 256)
    v = F.when(i % 3 == 0, h).when(i % 3 == 1, F.concat(F.lit("x"), h)).otherwise(F.concat(h, F.lit("\n")))
    return t.events.select("event_type", hashing.is_digest(v).alias("d")).groupBy("event_type").agg(F.count_if("d").alias("digests"))


@query("SELECT CAST(props::JSON ->> '$.k' AS BIGINT) % 5 AS k, count(*) AS n FROM events GROUP BY 1")
def json_fields(t: Tables) -> DataFrame:
    return t.events.groupBy((F.get_json_object("props", "$.k").cast("bigint") % 5).alias("k")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT p_brand AS mode, max(p_size) AS peak, list_sort(list(p_size)) AS peaks FROM part GROUP BY p_brand")
def worst_peaks(t: Tables) -> DataFrame:
    return anatomy.worst_peaks(t.part.select(F.col("p_brand").alias("mode"), F.col("p_size").alias("peak")))


@query(f"{LENS} SELECT sum(CASE WHEN supervised > 0 THEN least(full_len, 2048) ELSE 0 END) * 3 / 52.0 AS seconds FROM m")
def train_time(t: Tables) -> DataFrame:
    total = tokens.token_stats(_tokenized(t)).first()["total_tokens"]
    return t.spark.createDataFrame([(tokens.train_seconds(total, 3, 52),)], "seconds double")


@query("SELECT source, doc_id FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS r, count(*) OVER (PARTITION BY source) AS n FROM documents) WHERE r = 1 AND n > 1 ORDER BY doc_id LIMIT 3")
def first_examples(t: Tables) -> DataFrame:
    """The first three sources that several documents have, as evidence."""
    shared = t.documents.where("source is not null").groupBy("source").agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("n")).where("n > 1").select("source", "doc_id")
    return curate.evidence(shared, ["doc_id"])


BODIES = ['{"prompt":"hello"}', '{"prompt":5}', '{"messages":"x","prompt":"y"}', '{"prompt":"x","chunks":null}', '{"messages":[{"role":"user","content":5}]}', '{"messages":[{"role":"root","content":"x"}]}', '{"messages":[{"role":"user","content":"a"},{"role":"assistant","content":"b"}],"chunk_delay":0.6}', "[1]", '{"prompt":"x","chunks":true}', '{"prompt":"x","work_multiplier":8.5}', '{"prompt":" "}', '{"prompt":"x"}}', '{"messages":[]}', '{"messages":[{"role":"user"}]}', '{"prompt":"x","chunks":2.0}']
REFUSED = [None, "nonempty messages required", "nonempty messages required", "invalid chunks", "invalid message", "invalid message", None, "JSON object required", "invalid chunks", "invalid work_multiplier", "invalid message", "JSON object required", "nonempty messages required", "invalid message", "chunks must be integer"]


@query(f"SELECT {sql_pick(REFUSED, 'event_id')} AS fault, count(*) AS n FROM events GROUP BY 1")
def request_faults(t: Tables) -> DataFrame:
    d = t.events.select(pick(BODIES, F.col("event_id")).alias("body"))
    return d.groupBy(telemetry.payload_fault("body").alias("fault")).agg(F.count(F.lit(1)).alias("n"))


CALLS = ['{"prompt":"x","max_new_tokens":32}', '{"prompt":"x"}', '{"prompt":"x","max_new_tokens":"32"}', '{"prompt":7}', '{"prompt":"\\n"}', '{"prompt":"x","max_new_tokens":33}', '{"prompt":"x","max_new_tokens":32.0}', '{"prompt":"x","top_k":1}', "nothing", '{"prompt":"x","max_new_tokens":null}']
ANSWERS = [None, None, "invalid max_new_tokens", "invalid prompt", "invalid prompt", "invalid max_new_tokens", "invalid max_new_tokens", "unknown fields", "JSON object required", "invalid max_new_tokens"]


@query(f"SELECT {sql_pick(ANSWERS, 'event_id')} AS fault, count(*) AS n FROM events GROUP BY 1")
def generation_faults(t: Tables) -> DataFrame:
    d = t.events.select(pick(CALLS, F.col("event_id")).alias("body"))
    return d.groupBy(telemetry.generate_fault("body", 32).alias("fault")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT doc_id, length('<|system|>' || chr(10) || 'Be brief.<|end|>' || chr(10) || '<|user|>' || chr(10) || source || '<|end|>' || chr(10) || '<|assistant|>' || chr(10)) AS chars FROM documents")
def batch_predictions(t: Tables) -> DataFrame:
    """A stand-in for a model: it answers with the length of its rendered prompt."""
    d = tokens.predict(t.documents.select("doc_id", "source"), lambda prompts: [str(len(p)) for p in prompts], "Be brief.", "source")
    return d.select("doc_id", F.col("output").cast("bigint").alias("chars"))


@query("SELECT doc_id, least(coalesce(len(list_distinct(regexp_extract_all(lower(source), '[\\p{L}\\p{N}_]+'))), 0), 1) > 0 AS sketched, 64 AS size FROM documents")
def minhash_shape(t: Tables) -> DataFrame:
    """A sketch has 64 values, the same for the same text, and none for no words."""
    s = near.sets(t.documents, "doc_id", "source", 4).select(F.col("k").alias("doc_id"), near.minhash(F.col("s")).alias("m"))
    return s.select("doc_id", F.exists("m", lambda x: x.isNotNull()).alias("sketched"), F.size("m").alias("size"))
