"""Queries of chat assembly, tokens, packing, evaluation and sweeps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import hashing, stats
from ..operators import anatomy, evaluation, tokens
from .registry import Tables, query

TURNS = "SELECT conv_id, list(role ORDER BY turn) AS roles, list(text ORDER BY turn) AS texts FROM conversations GROUP BY conv_id"
MOST = 2048


@query(f"SELECT conv_id, sha256(array_to_string(list_transform(range(1, len(roles) + 1), lambda i: '<|' || roles[i] || '|>' || chr(10) || texts[i] || '<|end|>' || chr(10)), '')) AS rendered FROM ({TURNS})")
def chat_assemble(t: Tables) -> DataFrame:
    c = tokens.conversations(t.conversations)
    return c.select("conv_id", F.sha2(tokens.render(F.col("messages")).cast("binary"), 256).alias("rendered"))


@query(f"""
SELECT CASE WHEN roles <> ['system', 'user', 'assistant'] THEN 'roles' WHEN len(list_filter(texts, lambda x: trim(coalesce(x, '')) = '')) > 0 THEN 'blank content' END AS fault, count(*) AS n FROM ({TURNS}) GROUP BY 1""")
def role_violations(t: Tables) -> DataFrame:
    c = tokens.conversations(t.conversations)
    return c.groupBy(tokens.role_faults(F.col("messages")).alias("fault")).agg(F.count(F.lit(1)).alias("n"))


@query(f"SELECT conv_id, len(roles) - 1 AS prompt_turns, CASE WHEN roles[-1] = 'assistant' THEN length(texts[-1]) END AS answer_chars, length(texts[list_position(roles, 'user')]) AS first_user_chars FROM ({TURNS})")
def prompt_answer_split(t: Tables) -> DataFrame:
    c = tokens.conversations(t.conversations)
    m = F.col("messages")
    return c.select("conv_id", F.size(tokens.prompt_of(m)).cast("bigint").alias("prompt_turns"), F.length(tokens.answer_of(m)).cast("bigint").alias("answer_chars"), F.length(tokens.first_of_role(m, "user")).cast("bigint").alias("first_user_chars"))


def _tokenized(t: Tables) -> DataFrame:
    c = tokens.conversations(t.conversations).select(F.col("conv_id").cast("string").alias("id"), "messages").where(tokens.answer_of(F.col("messages")).isNotNull())
    return tokens.tokenize(c, tokens.ByteTokenizer(), MOST)


LENS = f"""
WITH c AS ({TURNS}), r AS (SELECT *, list_transform(range(1, len(roles) + 1), lambda i: octet_length(encode('<|' || roles[i] || '|>' || chr(10) || texts[i] || '<|end|>' || chr(10)))) AS sizes FROM c WHERE roles[-1] = 'assistant'),
l AS (SELECT conv_id, list_sum(sizes) AS full_len, coalesce(list_sum(sizes[1:len(sizes) - 1]), 0) + octet_length(encode('<|assistant|>' || chr(10))) AS prompt_len FROM r),
m AS (SELECT *, greatest(least(full_len, {MOST}) - prompt_len, 0) AS supervised, full_len > {MOST} AS truncated FROM l)
"""


@query(f"{LENS} SELECT count(*) AS n_in, count(*) FILTER (WHERE supervised > 0) AS n_kept, sum(CASE WHEN supervised > 0 THEN least(full_len, {MOST}) ELSE 0 END)::BIGINT AS total_tokens, sum(supervised)::BIGINT AS supervised_tokens, trunc(quantile_cont(full_len, 0.5))::INT AS full_len_p50, trunc(quantile_cont(full_len, 0.95))::INT AS full_len_p95 FROM m")
def token_stats(t: Tables) -> DataFrame:
    s = tokens.token_stats(_tokenized(t))
    return s.select("n_in", "n_kept", "total_tokens", "supervised_tokens", "full_len_p50", "full_len_p95")


@query(f"{LENS} SELECT round(avg(truncated::INT), 6) AS ratio, avg(truncated::INT) > 0.05 AS warn FROM m")
def truncation_ratio(t: Tables) -> DataFrame:
    s = tokens.token_stats(_tokenized(t)).select(F.col("truncation_ratio").alias("r"))
    return s.select(F.round("r", 6).alias("ratio"), (F.col("r") > 0.05).alias("warn"))


@query(f"{LENS} SELECT conv_id::VARCHAR AS id, least(prompt_len, {MOST})::BIGINT AS masked, supervised::BIGINT AS supervised FROM m")
def label_mask_counts(t: Tables) -> DataFrame:
    d = _tokenized(t)
    ignored = F.size(F.filter("labels", lambda x: x == tokens.IGNORED))
    return d.select("id", ignored.cast("bigint").alias("masked"), F.col("meta.supervised").cast("bigint").alias("supervised"))


@query(f"{LENS}, o AS (SELECT conv_id, least(full_len, {MOST}) AS n FROM m) SELECT conv_id // 8 AS batch, max(n)::BIGINT AS width, count(*) AS rows, sum(n)::BIGINT AS tokens FROM o GROUP BY 1")
def pad_widths(t: Tables) -> DataFrame:
    d = tokens.pad_batches(_tokenized(t).withColumn("o", F.col("id").cast("bigint")), "o", 8)
    return d.groupBy("batch").agg(F.max(F.size("input_ids")).cast("bigint").alias("width"), F.count(F.lit(1)).alias("rows"), F.sum(F.aggregate("attention_mask", F.lit(0), lambda a, x: a + x)).alias("tokens"))


@query(f"SELECT conv_id::VARCHAR AS id, conv_id % 3 = 0 AS fallback, length(texts[-1]) + CASE WHEN conv_id % 3 = 0 THEN 2 ELSE 0 END AS answer_chars FROM ({TURNS}) WHERE roles[-1] = 'assistant'")
def subword_boundaries(t: Tables) -> DataFrame:
    """Subword tokens; every third answer begins with two blank lines, which one token joins to the line's end
    before them: there the prompt's own tokens are no beginning of the whole text's."""
    c = tokens.conversations(t.conversations).where(tokens.answer_of(F.col("messages")).isNotNull())
    last = F.element_at("messages", -1)
    content = F.when(F.col("conv_id") % 3 == 0, F.concat(F.lit("\n\n"), last["content"])).otherwise(last["content"])
    c = c.select(F.col("conv_id").cast("string").alias("id"), F.concat(tokens.prompt_of(F.col("messages")), F.array(F.struct(last["role"].alias("role"), content.alias("content")))).alias("messages"))
    found = tokens.tokenize(c, tokens.SubwordTokenizer(), 1 << 30).select("id", F.col("meta.fallback").alias("fallback"))
    return found.join(c.select("id", F.length(F.element_at("messages", -1)["content"]).cast("bigint").alias("answer_chars")), "id")


def _placed(t: Tables) -> DataFrame:
    d = _tokenized(t).where("meta.supervised > 0").select(F.col("id").cast("long").alias("id"), F.size("input_ids").alias("len"))
    return tokens.first_fit_decreasing(d, MOST)


#: First fit as a recursion over rows by falling length, with the room of each bin as its state.
FFD = f"""{LENS.replace('WITH c', 'WITH RECURSIVE c', 1)}, o AS (SELECT conv_id AS id, least(full_len, {MOST})::INT AS len, row_number() OVER (ORDER BY least(full_len, {MOST}) DESC, conv_id) AS rn FROM m WHERE supervised > 0),
f AS (SELECT 0::BIGINT AS rn, NULL::BIGINT AS id, NULL::INT AS len, 0::BIGINT AS bin, []::INT[] AS rooms
  UNION ALL SELECT o.rn, o.id, o.len, p.p, CASE WHEN p.p > len(f.rooms) THEN list_append(f.rooms, {MOST} - o.len) ELSE list_transform(f.rooms, lambda x, i: CASE WHEN i = p.p THEN x - o.len ELSE x END) END
  FROM f JOIN o ON o.rn = f.rn + 1, LATERAL (SELECT coalesce(nullif(list_position(list_transform(f.rooms, lambda x: x >= o.len), true), 0), len(f.rooms) + 1)::BIGINT AS p) p),
placed AS (SELECT id, len, 0 AS shard, (bin - 1)::INT AS bin, (row_number() OVER (PARTITION BY bin ORDER BY rn) - 1)::INT AS slot FROM f WHERE rn > 0)"""


@query(f"{FFD} SELECT * FROM placed")
def ffd_packing(t: Tables) -> DataFrame:
    return _placed(t)


@query(f"{FFD}, b AS (SELECT bin, sum(len) AS used, count(*) AS c FROM placed GROUP BY bin) SELECT sum(c)::BIGINT AS examples, count(*) AS bins, ceil(sum(c) / 8)::BIGINT AS steps_before, ceil(count(*) / 8)::BIGINT AS steps_after, sum(used) / (count(*) * {MOST}) AS fill, max(c) AS most_in_bin FROM b")
def packing_report(t: Tables) -> DataFrame:
    return tokens.packing_report(_placed(t), MOST, 8)


VARIANTS = ['{"answer":"A"}', '{"answer":"B"}', '{"answer":"B"}.', '{"answer":"Z"}', '["A"]', '{"answer":1}', '{"answer":"A","x":1}', "A"]


def _golden(t: Tables) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Items from documents: expected A; two models that answer by the id."""
    d = t.documents.select(F.col("doc_id").cast("string").alias("id"), "doc_id", "lang", "source")
    gold = d.select("id", F.lit("A").alias("expected"), F.array(F.lit("A"), F.lit("B"), F.lit("REFUSE")).alias("choices"), F.array("lang", "source", "lang").alias("slices"))
    pick = F.array(*[F.lit(v) for v in VARIANTS])
    out = lambda mul, err: d.select("id", pick[(F.col("doc_id") * mul % len(VARIANTS)).cast("int")].alias("raw"), F.when(F.col("doc_id") % err == 0, "timeout").alias("error"))
    return gold, out(3, 29), out(5, 31)


def _sql_items(mul: int, err: int) -> str:
    values = ", ".join("'" + v.replace("'", "''") + "'" for v in VARIANTS)
    raw = f"[{values}][(doc_id * {mul}) % {len(VARIANTS)} + 1]"
    ok = f"(doc_id % {err} <> 0 AND json_valid({raw}) AND json_type({raw}::JSON) = 'OBJECT' AND json_keys({raw}::JSON) = ['answer'] AND json_type({raw}::JSON, '$.answer') = 'VARCHAR' AND list_contains(['A', 'B', 'REFUSE'], {raw}::JSON ->> '$.answer'))"
    case = f"CASE WHEN json_valid({raw}) THEN {ok} ELSE false END"
    return f"SELECT doc_id, doc_id::VARCHAR AS id, lang, source, doc_id % {err} = 0 AS error, {case} AS valid, CASE WHEN {case} THEN {raw}::JSON ->> '$.answer' = 'A' ELSE false END AS correct FROM documents"


SCORES = "count(*) AS n, count(*) FILTER (WHERE correct) AS correct, count(*) FILTER (WHERE valid) AS valid, count(*) FILTER (WHERE error) AS errors, round(count(*) FILTER (WHERE correct) / count(*), 6) AS accuracy, round(count(*) FILTER (WHERE valid) / count(*), 6) AS format_rate"


def _rounded(df: DataFrame) -> DataFrame:
    return df.withColumn("accuracy", F.round("accuracy", 6)).withColumn("format_rate", F.round("format_rate", 6))


@query(f"WITH i AS ({_sql_items(3, 29)}) SELECT id, valid, correct FROM i")
def strict_answer_parse(t: Tables) -> DataFrame:
    gold, a, _ = _golden(t)
    return evaluation.score_items(gold, a).select("id", "valid", "correct")


@query(f"WITH i AS ({_sql_items(3, 29)}) SELECT {SCORES} FROM i")
def score_overall(t: Tables) -> DataFrame:
    gold, a, _ = _golden(t)
    return _rounded(evaluation.overall(evaluation.score_items(gold, a)))


@query(f"WITH i AS ({_sql_items(3, 29)}), s AS (SELECT *, unnest(list_distinct([lang, source])) AS slice FROM i) SELECT slice, {SCORES} FROM s GROUP BY slice")
def score_by_slice(t: Tables) -> DataFrame:
    gold, a, _ = _golden(t)
    return _rounded(evaluation.by_slice(evaluation.score_items(gold, a)))


@query(f"WITH a AS ({_sql_items(3, 29)}), b AS ({_sql_items(5, 31)}) SELECT a.id, CASE WHEN b.correct THEN 'improved' ELSE 'regressed' END AS change FROM a JOIN b USING (id) WHERE a.correct <> b.correct")
def baseline_candidate_diff(t: Tables) -> DataFrame:
    gold, a, b = _golden(t)
    return evaluation.changes(evaluation.score_items(gold, a), evaluation.score_items(gold, b))


@query(f"""
WITH a AS ({_sql_items(3, 29)}), b AS ({_sql_items(5, 31)}), x AS (SELECT {SCORES} FROM a), y AS (SELECT {SCORES} FROM b),
p AS (SELECT count(*) FILTER (WHERE correct) / count(*) AS acc FROM a WHERE lang = 'en'), q AS (SELECT count(*) FILTER (WHERE correct) / count(*) AS acc FROM b WHERE lang = 'en'),
s AS (SELECT count(*) AS n FROM (SELECT lang FROM documents UNION SELECT source FROM documents))
SELECT unnest(['protocol_sha256', 'golden_sha256', 'baseline_spec_sha256', 'reports', 'size', 'ids', 'slices', 'errors', 'accuracy', 'format_rate', 'critical', 'slice:en', 'behavioral']) AS name,
       unnest([true, true, true, true, x.n >= 50, true, s.n >= 3, y.errors = 0, y.accuracy >= x.accuracy, y.format_rate >= x.format_rate, true, q.acc >= p.acc, true]) AS passed FROM x, y, p, q, s""")
def quality_gate(t: Tables) -> DataFrame:
    from ..operators.gates import frame

    gold, a, b = _golden(t)
    about = {"model": "m", "protocol_sha256": "p", "golden_sha256": "g", "baseline_spec_sha256": "s", "behavioral": {"overall": {"n": 3, "correct": 3, "valid": 3, "errors": 0, "accuracy": 1.0, "format_rate": 1.0}}}
    reports = [evaluation.scored(evaluation.score_items(gold, x), **about) for x in (a, b)]
    return frame(t.spark, evaluation.quality_gate(*reports, ["en"])).select("name", "passed")


@query("""
WITH d AS (SELECT doc_id::VARCHAR AS id, source || '/' || n_chars AS group_id, lower(trim(regexp_replace(text, '\\s+', ' ', 'g'))) AS k, doc_id % 10 = 0 AS gold FROM documents)
SELECT id FROM d WHERE gold AND (k IN (SELECT k FROM d WHERE NOT gold) OR group_id IN (SELECT group_id FROM d WHERE NOT gold))""")
def leakage_items(t: Tables) -> DataFrame:
    d = t.documents.select(F.col("doc_id").cast("string").alias("id"), F.concat("source", F.lit("/"), "n_chars").alias("group_id"), F.col("text").alias("input"), "doc_id")
    return evaluation.leaks(d.where("doc_id % 10 = 0"), d.where("doc_id % 10 <> 0"))


RUN = "o_orderkey::VARCHAR AS run_id, o_orderpriority AS name, 'FINISHED' AS status, round(o_totalprice / 1000, 6) AS final_val_loss"


def _runs(t: Tables) -> DataFrame:
    return t.orders.select(F.col("o_orderkey").cast("string").alias("run_id"), F.col("o_orderpriority").alias("name"), F.lit("FINISHED").alias("status"), F.round(F.col("o_totalprice") / 1000, 6).alias("final_val_loss"))


@query(f"SELECT {RUN} FROM orders ORDER BY final_val_loss, run_id LIMIT 1")
def best_run(t: Tables) -> DataFrame:
    return evaluation.best_run(_runs(t))


@query(f"SELECT *, row_number() OVER (ORDER BY final_val_loss, run_id)::INT AS rank FROM (SELECT {RUN} FROM orders QUALIFY row_number() OVER (PARTITION BY o_orderpriority ORDER BY round(o_totalprice / 1000, 6), o_orderkey::VARCHAR) = 1)")
def run_comparison(t: Tables) -> DataFrame:
    """The best run of each configuration, ranked."""
    r = _runs(t)
    best = r.groupBy("name").agg(F.min_by(F.struct(*r.columns), F.struct("final_val_loss", "run_id")).alias("r")).select("r.*")
    return evaluation.compare_runs(best)


@query("SELECT l_returnflag, round(sum(l_discount * l_quantity) / sum(l_quantity), 6) AS weighted FROM lineitem GROUP BY 1")
def weighted_mean(t: Tables) -> DataFrame:
    return t.lineitem.groupBy("l_returnflag").agg(F.round(stats.weighted_mean(F.col("l_discount"), F.col("l_quantity")), 6).alias("weighted"))


@query("""
WITH p AS (SELECT p_brand AS g, p_size, row_number() OVER (PARTITION BY p_name ORDER BY p_partkey) > 1 AS tied FROM part)
SELECT g AS "group", count(*) AS tensors, sum(CASE WHEN tied THEN 0 ELSE p_size END)::BIGINT AS own, sum(CASE WHEN tied THEN p_size ELSE 0 END)::BIGINT AS tied,
       round(sum(CASE WHEN tied THEN 0 ELSE p_size END) / sum(sum(CASE WHEN tied THEN 0 ELSE p_size END)) OVER (), 6) AS share FROM p GROUP BY g""")
def group_table_shares(t: Tables) -> DataFrame:
    p = t.part.select("p_brand", F.col("p_name").alias("ptr"), F.col("p_partkey").alias("pos"), F.array("p_size").alias("shape"), F.col("p_size").cast("long").alias("numel"))
    g = anatomy.group_table(anatomy.tied(p), F.col("p_brand"))
    return g.select("group", "tensors", "own", "tied", F.round("share", 6).alias("share"))


@query("SELECT sum(16 * (p_size + 2 * p_size))::BIGINT AS parameters FROM part WHERE p_type IN ('ECONOMY', 'SMALL')")
def adapter_parameters(t: Tables) -> DataFrame:
    layers = t.part.select(F.concat(F.lit("model.layers."), "p_type").alias("name"), F.col("p_size").cast("long").alias("n_in"), (F.col("p_size").cast("long") * 2).alias("n_out"))
    return anatomy.adapter_parameters(layers, ["ECONOMY", "SMALL"], 16)


@query("SELECT event_id, sha256('{\"k\":' || (props::JSON ->> '$.k') || '}') AS compact, sha256('{\"k\": ' || (props::JSON ->> '$.k') || '}') AS spaced FROM events")
def canonical_hashes(t: Tables) -> DataFrame:
    p = F.col("props")
    return t.events.select("event_id", F.sha2(hashing.canonical_json(p).cast("binary"), 256).alias("compact"), F.sha2(hashing.fingerprint_json(p).cast("binary"), 256).alias("spaced"))
