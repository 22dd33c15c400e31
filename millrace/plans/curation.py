"""Queries of curation: normalising, masking, dedup, taxonomy, percentiles, splits, contamination."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import hashing, stats, text
from ..operators import curate, near
from ..scratch import Scratch
from ..sources import tables as src
from .registry import Tables, query

NORM = r"trim(lower(regexp_replace(text, '\s+', ' ', 'g')))"
PHONE, EMAIL = text.PII["phone"][0], text.PII["email"][0]
BAND = (30, 20_000)
FIXED = "".join  # SQL parts


def _sql_words(col: str = NORM) -> str:
    return rf"regexp_extract_all({col}, '[\p{{L}}\p{{N}}_]+')"


def _sql_sets(table: str, key: str, size: int = 4) -> str:
    w = _sql_words()
    grams = f"list_distinct(list_transform(range(1, len(w) - {size} + 2), lambda i: array_to_string(w[i:i + {size - 1}], ' ')))"
    return f"SELECT {key} AS k, CASE WHEN len(w) >= {size} THEN {grams} WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS s FROM (SELECT {key}, {w} AS w FROM {table})"


@query(rf"""
WITH n AS (SELECT doc_id, lang, regexp_replace(regexp_replace(text, '{PHONE}', '[PHONE]', 'g'), '{EMAIL}', '[EMAIL]', 'g') AS text, length(text) AS size FROM documents),
k AS (SELECT *, row_number() OVER (PARTITION BY {NORM} ORDER BY doc_id) AS r FROM n WHERE size BETWEEN {BAND[0]} AND {BAND[1]})
SELECT d.lang, count(*) AS scanned, count(k.doc_id) AS in_band, count(k.doc_id) FILTER (WHERE k.r = 1) AS kept
FROM documents d LEFT JOIN k USING (doc_id) GROUP BY d.lang""")
def curation_funnel_by_lang(t: Tables) -> DataFrame:
    """One pass over the texts: a row's key is null outside the band, equal keys meet once."""
    inside = F.coalesce(F.char_length("text").between(*BAND), F.lit(False))
    masked = t.documents.select("doc_id", "lang", F.when(inside, text.scrub(F.col("text"))).alias("masked"))
    keyed = masked.select("doc_id", "lang", F.sha2(text.normalize_text(F.col("masked")).cast("binary"), 256).alias("k"))
    cells = keyed.groupBy("k", "lang").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first"))
    first = F.row_number().over(Window.partitionBy("k").orderBy("first"))
    ranked = cells.withColumn("r", first)
    banded = F.col("k").isNotNull()
    return ranked.groupBy("lang").agg(F.sum("n").alias("scanned"), F.coalesce(F.sum(F.when(banded, F.col("n"))), F.lit(0)).alias("in_band"), F.count_if(banded & (F.col("r") == 1)).alias("kept"))


@query(f"SELECT min(doc_id) AS doc_id FROM documents GROUP BY {NORM}")
def exact_dedup_kept(t: Tables) -> DataFrame:
    return curate.exact_first(t.documents.select("doc_id", "text"), text.normalize_text(F.col("text")), ["doc_id"], ["doc_id"])


@query(f"SELECT lang, round((count(*) - count(DISTINCT {NORM})) / count(*), 6) AS duplicate_share FROM documents GROUP BY lang")
def duplicate_share(t: Tables) -> DataFrame:
    d = t.documents.select("lang", F.sha2(text.normalize_text(F.col("text")).cast("binary"), 256).alias("k"))
    return d.groupBy("lang").agg(F.round(stats.duplicate_share(F.col("k")), 6).alias("duplicate_share"))


@query(rf"""
WITH h AS (SELECT len(regexp_extract_all(text, '{PHONE}')) AS p, len(regexp_extract_all(regexp_replace(text, '{PHONE}', '[PHONE]', 'g'), '{EMAIL}')) AS e, CASE WHEN doc_id % 9 = 0 AND text IS NOT NULL THEN 2 ELSE 0 END AS b FROM documents)
SELECT sum(p)::BIGINT AS phone, sum(e)::BIGINT AS email, sum(b)::BIGINT AS birth_date, count(*) FILTER (WHERE p + e + b > 0) AS masked_rows FROM h""")
def pii_hit_totals(t: Tables) -> DataFrame:
    """Every ninth text gets a birth date at its end, with and without a year of its own century."""
    told = F.when(F.col("doc_id") % 9 == 0, F.concat("text", F.lit("; Дата рождения: 12.03.1990, ГОД РОЖДЕНИЯ 1/2/2001, приказ от 12.03.1990"))).otherwise(F.col("text"))
    h = t.documents.select(told.alias("text")).select(*[c.alias(n) for n, c in text.pii_hits(F.col("text")).items()])
    return h.agg(*[F.sum(n).alias(n) for n in text.PII], F.count_if(F.col("phone") + F.col("email") + F.col("birth_date") > 0).alias("masked_rows"))


@query(rf"SELECT doc_id, sha256(regexp_replace(regexp_replace(text, '{PHONE}', '[PHONE]', 'g'), '{EMAIL}', '[EMAIL]', 'g')) AS masked_sha256 FROM documents")
def pii_scrubbed_text(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", F.sha2(text.scrub(F.col("text")).cast("binary"), 256).alias("masked_sha256"))


def _sql_topic() -> str:
    tests = " ".join("WHEN " + " OR ".join(f"contains(lower(text), '{w}')" for w in words) + f" THEN '{label}'" for label, words in curate.EXAMPLE_RULES)
    return f"CASE {tests} END"


@query(f"SELECT topic, count(*) AS n FROM (SELECT {_sql_topic()} AS topic FROM documents) GROUP BY topic")
def topic_classify(t: Tables) -> DataFrame:
    return t.documents.select(curate.classify([F.col("text")], curate.EXAMPLE_RULES).alias("topic")).groupBy("topic").agg(F.count(F.lit(1)).alias("n"))


@query(r"""
WITH r AS (SELECT item_id AS rule, 'topic-' || item_id AS label, unnest(list_distinct(regexp_extract_all(lower(text), '[\p{L}]{6,}'))) AS keyword FROM benchmark),
d AS (SELECT doc_id, (SELECT min(rule) FROM r WHERE contains(lower(text), keyword)) AS rule FROM documents)
SELECT 'topic-' || rule AS topic, count(*) AS n FROM d GROUP BY 1""")
def topics_by_table(t: Tables) -> DataFrame:
    """A topic for each benchmark item, its long words as keywords: a rule table of any size in one pass."""
    words = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(r"[\p{L}]{6,}"), 0))
    rules = t.benchmark.select(F.col("item_id").alias("rule"), F.concat(F.lit("topic-"), "item_id").alias("label"), F.explode(words).alias("keyword"))
    d = curate.classify_by_table(t.documents.select("text"), [F.col("text")], rules)
    return d.groupBy("topic").agg(F.count(F.lit(1)).alias("n"))


CAP = 20


@query(f"""
WITH a AS (SELECT doc_id, {_sql_topic()} AS topic, sha1(text) AS k FROM documents),
f AS (SELECT *, (topic IS NOT NULL AND row_number() OVER (PARTITION BY topic IS NULL, k ORDER BY doc_id) = 1)::INT AS first FROM a),
b AS (SELECT *, coalesce(sum(first) OVER (PARTITION BY topic ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM f)
SELECT topic, CASE WHEN topic IS NULL THEN 'untagged' WHEN before >= {CAP} THEN 'over_cap' WHEN first = 1 THEN 'kept' ELSE 'duplicate' END AS fate, count(*) AS n
FROM b GROUP BY ALL""")
def collect_accounting(t: Tables) -> DataFrame:
    d = t.documents.select("doc_id", curate.classify([F.col("text")], curate.EXAMPLE_RULES).alias("topic"), F.sha1(F.col("text").cast("binary")).alias("k"))
    return curate.capped(d, "k", "topic", "doc_id", CAP).groupBy("topic", "fate").agg(F.count(F.lit(1)).alias("n"))


@query(f"""
SELECT doc_id FROM (SELECT doc_id, topic, row_number() OVER (PARTITION BY topic ORDER BY doc_id) AS r FROM (SELECT doc_id, {_sql_topic()} AS topic FROM documents)) WHERE topic IS NOT NULL AND r <= {CAP}""")
def topic_cap(t: Tables) -> DataFrame:
    d = t.documents.select("doc_id", curate.classify([F.col("text")], curate.EXAMPLE_RULES).alias("topic")).where("topic is not null")
    return d.withColumn("r", F.row_number().over(Window.partitionBy("topic").orderBy("doc_id"))).where(F.col("r") <= CAP).select("doc_id")


@query("SELECT doc_id, 'doc-' || substr(sha1(concat(lang, chr(0), source, chr(0), text)), 1, 16) AS content_id FROM documents")
def content_id(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", hashing.content_id(F.col("lang"), F.col("source"), F.col("text")).alias("content_id"))


@query("""
SELECT shard, count(*) AS n FROM (
  SELECT list_reduce(list_transform(range(1, 41), lambda i: (instr('0123456789abcdef', sha1(text)[i]) - 1)::BIGINT), lambda a, d: (a * 16 + d) % 7, 0::BIGINT) AS shard FROM documents) GROUP BY shard""")
def hash_shard(t: Tables) -> DataFrame:
    return src.with_shard(t.documents.select("text"), ["text"], 7).groupBy("shard").agg(F.count(F.lit(1)).alias("n"))


NEAR = 0.85


PAIRS = f"""
WITH reps AS (SELECT min(doc_id) AS doc_id, {NORM} AS text FROM documents GROUP BY ALL), s AS ({_sql_sets('reps', 'doc_id')}),
e AS (SELECT k, len(s) AS n, unnest(s) AS x FROM s),
p AS (SELECT a.k AS a, b.k AS b, a.n AS na, b.n AS nb, count(*) AS o FROM e a JOIN e b ON a.x = b.x AND a.k < b.k AND least(a.n, b.n) >= {NEAR} * greatest(a.n, b.n) GROUP BY ALL)
SELECT a, b, round(o / (na + nb - o), 6) AS jaccard FROM p WHERE o / (na + nb - o) >= {NEAR}"""


@query(PAIRS)
def near_dup_pairs_lsh(t: Tables) -> DataFrame:
    """Candidates by bands of the sketches, each verified: 16 bands of 4 rows miss a pair of the threshold's
    similarity once in 100,000."""
    return near.pairs_by_bands(_reps(t.documents), "doc_id", "t", threshold=NEAR, normal=True).select("a", "b", F.round("jaccard", 6).alias("jaccard"))


@query(f"WITH p AS ({PAIRS}) SELECT count(*) AS pairs, count(*) AS found, 0::BIGINT AS wrong FROM p")
def lsh_recall(t: Tables) -> DataFrame:
    """Pairs of the exact join, how many of them the bands find, and what the bands find beside them. The
    exact join's pairs are written first, so that its sets are gone when the bands' are shuffled."""
    reps, scratch, beside = _reps(t.documents), Scratch(t.spark), Scratch(t.spark)
    found = scratch.table(near.pairs_within(reps, "doc_id", "t", threshold=NEAR, normal=True, scratch=beside).select("a", "b"), "exact", large=True)
    beside.drop_all()
    exact = found.select("a", "b", F.lit(1).alias("exact"))
    bands = near.pairs_by_bands(reps, "doc_id", "t", threshold=NEAR, normal=True).select("a", "b", F.lit(1).alias("banded"))
    both = exact.join(bands, ["a", "b"], "full_outer")
    return both.agg(F.count("exact").alias("pairs"), F.count_if(F.col("exact").isNotNull() & F.col("banded").isNotNull()).alias("found"), F.count_if(F.col("exact").isNull()).alias("wrong"))


@query(PAIRS)
def near_dup_pairs_jaccard(t: Tables) -> DataFrame:
    """Between texts that are different after normalisation; copies are told by exact_dedup_kept."""
    return near.pairs_within(_reps(t.documents), "doc_id", "t", threshold=NEAR, normal=True).select("a", "b", F.round("jaccard", 6).alias("jaccard"))


def _reps(docs: DataFrame) -> DataFrame:
    """(doc_id, t): one row of each normalised text, which is made once. Rows are ranked by digest alone;
    texts are read where they were written."""
    scratch = Scratch(docs.sparkSession)
    d = scratch.table(docs.select("doc_id", text.normalize_text(F.col("text")).alias("t"), F.monotonically_increasing_id().alias("_i")), "normal", texts=True)
    digest = F.sha2(F.coalesce("t", F.lit("")).cast("binary"), 256)
    rank = F.row_number().over(Window.partitionBy("_k").orderBy("doc_id", "_i"))
    copies = scratch.table(d.select(digest.alias("_k"), "doc_id", "_i").withColumn("_r", rank).where("_r > 1").select("_i"), "copies")
    return near.chosen(d, copies, "_i", "left_anti").select("doc_id", "t")


#: The kept rows as a recursion over rows in order that have an earlier near copy, with the dropped ones as state.
GREEDY = f"""
WITH RECURSIVE reps AS (SELECT min(doc_id) AS doc_id, {NORM} AS text FROM documents GROUP BY ALL), s AS ({_sql_sets('reps', 'doc_id')}),
e AS (SELECT k, len(s) AS n, unnest(s) AS x FROM s),
j AS (SELECT a.k AS a, b.k AS b, a.n AS na, b.n AS nb, count(*) AS o FROM e a JOIN e b ON a.x = b.x AND a.k < b.k AND least(a.n, b.n) >= {NEAR} * greatest(a.n, b.n) GROUP BY ALL),
l AS (SELECT b, list(a) AS before, row_number() OVER (ORDER BY b) AS rn FROM j WHERE o / (na + nb - o) >= {NEAR} GROUP BY b),
f AS (SELECT 0::BIGINT AS rn, []::BIGINT[] AS dropped UNION ALL SELECT l.rn, CASE WHEN len(list_filter(l.before, lambda x: NOT list_contains(f.dropped, x))) > 0 THEN list_append(f.dropped, l.b) ELSE f.dropped END FROM f JOIN l ON l.rn = f.rn + 1)
SELECT doc_id FROM reps WHERE NOT list_contains((SELECT arg_max(dropped, rn) FROM f), doc_id)"""


@query(GREEDY)
def near_dup_greedy_kept(t: Tables) -> DataFrame:
    reps = _reps(t.documents)
    return near.greedy(reps.select("doc_id"), near.pairs_within(reps, "doc_id", "t", threshold=NEAR, normal=True), "doc_id").select("doc_id")


@query(f"""
WITH d AS ({_sql_sets('documents', 'doc_id')}), b AS ({_sql_sets('benchmark', 'item_id')}),
x AS (SELECT k, unnest(s) AS x FROM d), y AS (SELECT k, len(s) AS n, unnest(s) AS x FROM b)
SELECT x.k AS a, y.k AS b, round(count(*) / y.n, 6) AS share FROM x JOIN y USING (x) GROUP BY x.k, y.k, y.n HAVING count(*) / y.n >= 0.5""")
def benchmark_containment(t: Tables) -> DataFrame:
    return near.containment(t.documents, t.benchmark, "doc_id", "item_id", "text", "text").select("a", "b", F.round("share", 6).alias("share"))


def _two(t: Tables) -> tuple[DataFrame, DataFrame]:
    d = t.documents.select("doc_id", "text", "source")
    return d.where("doc_id % 10 < 8"), d.where("doc_id % 10 >= 8")


@query(f"""
WITH d AS (SELECT doc_id, {NORM} AS k, source, doc_id % 10 < 8 AS train FROM documents)
SELECT 'id' AS rule, 0::BIGINT AS hits
UNION ALL SELECT 'text', count(*) FROM (SELECT k FROM d WHERE train INTERSECT SELECT k FROM d WHERE NOT train)
UNION ALL SELECT 'group', count(*) FROM (SELECT source FROM d WHERE train INTERSECT SELECT source FROM d WHERE NOT train)""")
def contamination_report(t: Tables) -> DataFrame:
    return curate.contamination(*_two(t), "doc_id", "text", "source")


@query(f"""
WITH l AS (SELECT min(doc_id) AS doc_id, {NORM} AS text FROM documents WHERE doc_id % 10 < 8 GROUP BY ALL), r AS (SELECT min(doc_id) AS doc_id, {NORM} AS text FROM documents WHERE doc_id % 10 >= 8 GROUP BY ALL),
ls AS ({_sql_sets('l', 'doc_id')}), rs AS ({_sql_sets('r', 'doc_id')}), le AS (SELECT k, len(s) AS n, unnest(s) AS x FROM ls), re AS (SELECT k, len(s) AS n, unnest(s) AS x FROM rs),
p AS (SELECT le.k AS a, re.k AS b, le.n AS na, re.n AS nb, count(*) AS o FROM le JOIN re ON le.x = re.x AND least(le.n, re.n) >= {NEAR} * greatest(le.n, re.n) GROUP BY ALL)
SELECT a, b, round(o / (na + nb - o), 6) AS jaccard FROM p WHERE o / (na + nb - o) >= {NEAR}""")
def contamination_near_pairs(t: Tables) -> DataFrame:
    train, test = (_reps(x) for x in _two(t))
    return near.pairs_across(train, test, "doc_id", "doc_id", "t", "t", threshold=NEAR, normal=True).select("a", "b", F.round("jaccard", 6).alias("jaccard"))


@query()
def group_split_sizes(t: Tables) -> DataFrame:
    d = t.documents.select("doc_id", text.normalize_group(F.concat_ws("-", "source", "lang"), compose=False).alias("g"))
    rows = curate.split_rows(d, "g", {"train": 0.8, "val": 0.1, "test": 0.1}, 42)
    return rows.groupBy("split").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("g").alias("groups"))


SPREAD_SQL = """
WITH v AS (SELECT {by} AS g, {x} AS x FROM {t}), o AS (SELECT g, list_sort(list(x)) AS s, stddev_pop(x) / avg(x) AS cv, min(x) AS mn, max(x) AS mx FROM v GROUP BY g)
"""
POS = "s[(least(len(s) - 1, floor({q} * len(s))) + 1)::INT]"


@query(f"""{SPREAD_SQL.format(by='lang', x='length(text)', t='documents')}
SELECT g AS lang, {POS.format(q=.1)} AS p10, {POS.format(q=.5)} AS p50, {POS.format(q=.9)} AS p90, round({POS.format(q=.9)} / greatest({POS.format(q=.1)}, 1), 6) AS ratio_p90_p10, round(cv, 6) AS cv, mn AS min, mx AS max FROM o""")
def length_spread(t: Tables) -> DataFrame:
    d = t.documents.select("lang", F.char_length("text").cast("bigint").alias("x"))
    s = stats.spread(d, "x", ["lang"])
    return s.select("lang", "p10", "p50", "p90", F.round("ratio_p90_p10", 6).alias("ratio_p90_p10"), F.round("cv", 6).alias("cv"), "min", "max")


@query(f"""{SPREAD_SQL.format(by='lang', x='length(text)', t='documents')}
SELECT g AS lang, {POS.format(q=.5)} AS nearest, s[(floor(0.95 * (len(s) - 1)) + 1)::INT] AS floor_index, s[len(s) // 2 + 1] AS upper_median FROM o""")
def len_percentiles_by_position(t: Tables) -> DataFrame:
    d = t.documents.select("lang", F.char_length("text").cast("bigint").alias("x"))
    return stats.at_positions(d, "x", {"nearest": stats.nearest_rank(0.5), "floor_index": stats.floor_index(0.95), "upper_median": stats.upper_median()}, ["lang"])


@query("SELECT o_orderpriority, round(quantile_cont(o_totalprice, 0.5), 4) AS p50, round(quantile_cont(o_totalprice, 0.95), 4) AS p95, trunc(quantile_cont(o_totalprice, 0.9))::INT AS p90_int FROM orders GROUP BY 1")
def percentiles_linear(t: Tables) -> DataFrame:
    p = stats.percentiles(t.orders, "o_totalprice", {"p50": 0.5, "p95": 0.95, "p90": 0.9}, ["o_orderpriority"])
    return p.select("o_orderpriority", F.round("p50", 4).alias("p50"), F.round("p95", 4).alias("p95"), F.col("p90").cast("int").alias("p90_int"))


@query("SELECT l_linestatus, l_returnflag, round(quantile_cont(l_extendedprice, 0.25), 4) AS q1, round(quantile_cont(l_extendedprice, 0.75), 4) AS q3, round(quantile_cont(l_extendedprice, 0.999), 4) AS top FROM lineitem GROUP BY ALL")
def percentiles_by_selection(t: Tables) -> DataFrame:
    """Exact percentiles of continuous values without ranking a group anywhere."""
    n, at = F.col("_n") - 1, {"q1": 0.25, "q3": 0.75, "top": 0.999}
    ends = {f"{k}_{side}": f(F.lit(q) * n) for k, q in at.items() for side, f in (("lo", F.floor), ("hi", F.ceil))}
    by = ["l_linestatus", "l_returnflag"]
    found = stats.refined(t.lineitem, "l_extendedprice", ends, by)
    both = stats.beside(found, t.lineitem.groupBy(*by).agg(F.count(F.lit(1)).alias("_n")), by)
    value = lambda k, q: F.col(f"{k}_lo") + (F.col(f"{k}_hi") - F.col(f"{k}_lo")) * (F.lit(q) * n - F.floor(F.lit(q) * n))
    return both.select(*by, *[F.round(value(k, q), 4).alias(k) for k, q in at.items()])


@query("""
WITH c AS (SELECT lang, source, count(*) AS n, min(doc_id) AS f FROM documents GROUP BY ALL)
SELECT (SELECT source FROM (SELECT source, count(*) AS n, min(doc_id) AS f FROM documents GROUP BY 1) ORDER BY n DESC, f LIMIT 1) AS mode,
       (SELECT max(n) / sum(n) FROM (SELECT count(*) AS n FROM documents GROUP BY source)) AS share""")
def mode_and_share(t: Tables) -> DataFrame:
    return stats.mode_share(t.documents, "source", "doc_id")


DIVERSITY = f"""
WITH b AS (SELECT count(*) AS examples, count(DISTINCT lang) AS prompts, count(DISTINCT source) AS groups, round((count(text) - count(DISTINCT text)) / count(text), 6) AS duplicate_answer_share FROM documents),
g AS (SELECT round(max(n) / sum(n), 6) AS largest_group_share FROM (SELECT count(*) AS n FROM documents GROUP BY source)),
l AS (SELECT round(max(n) / sum(n), 6) AS same_length_share FROM (SELECT count(*) AS n FROM documents GROUP BY length(text))),
o AS (SELECT list_sort(list(length(text))) AS s FROM documents), r AS (SELECT round({POS.format(q=.9)} / greatest({POS.format(q=.1)}, 1), 6) AS answer_len_ratio FROM o)
SELECT * FROM b, g, l, r"""


@query(DIVERSITY)
def diversity_stats(t: Tables) -> DataFrame:
    d = curate.diversity(t.documents, "lang", "source", "text")
    return d.select(*[F.round(c, 6).alias(c) if "share" in c or "ratio" in c else F.col(c) for c in d.columns])


LIMITS = {"min_examples": 500, "min_prompts": 5, "min_groups": 10, "max_largest_group_share": 0.2, "min_answer_len_ratio": 2.0, "max_same_length_share": 0.05, "max_duplicate_answer_share": 0.02}


@query(f"WITH m AS ({DIVERSITY}), v AS (UNPIVOT (SELECT COLUMNS(*)::DOUBLE FROM m) ON COLUMNS(*) INTO NAME name VALUE value), l AS (SELECT unnest({[k.split('_', 1)[1] for k in LIMITS]}) AS name, unnest({[k.split('_', 1)[0] for k in LIMITS]}) AS kind, unnest({[float(v) for v in LIMITS.values()]}) AS lim) SELECT name FROM l JOIN v USING (name) WHERE CASE WHEN kind = 'min' THEN value < lim ELSE value > lim END")
def diversity_violations(t: Tables) -> DataFrame:
    from ..operators.gates import frame

    measures = curate.diversity(t.documents, "lang", "source", "text").first().asDict()
    return frame(t.spark, [c for c in curate.diversity_checks(measures, LIMITS) if not c.passed]).select("name")


@query("SELECT label, round(avg(sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE)))), 5) AS mean_norm, round(max(sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE)))), 5) AS max_norm FROM embeddings GROUP BY label")
def embedding_norms(t: Tables) -> DataFrame:
    d = t.embeddings.select("label", stats.l2_norm(F.col("embedding")).alias("n"))
    return d.groupBy("label").agg(F.round(F.avg("n"), 5).alias("mean_norm"), F.round(F.max("n"), 5).alias("max_norm"))


@query(f"SELECT lang, count(*) AS n, sum(len({_sql_words()}))::BIGINT AS words FROM documents GROUP BY lang")
def word_totals(t: Tables) -> DataFrame:
    return t.documents.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.sum(F.size(text.words(F.col("text")))).alias("words"))


@query("SELECT source, lang, count(*) AS n FROM documents WHERE text IS NOT NULL AND length(text) BETWEEN 100 AND 4000 GROUP BY ALL")
def length_band_counts(t: Tables) -> DataFrame:
    return curate.length_band(t.documents, "text", 100, 4000).groupBy("source", "lang").agg(F.count(F.lit(1)).alias("n"))


@query()
def minhash_signatures(t: Tables) -> DataFrame:
    s = near.sets(t.documents, "doc_id", "text", 4)
    return s.select(F.col("k").alias("doc_id"), near.minhash(F.col("s")).alias("signature"))


@query()
def code_syntax_report(t: Tables) -> DataFrame:
    d = t.documents.select("lang", text.strip_fence(F.col("text")).alias("c"))
    return d.groupBy("lang").agg(F.count_if(text.parses(F.col("c.code"))).alias("parses"), F.count_if("c.fenced").alias("fenced"), F.sum(text.line_count(F.col("c.code"))).alias("lines"))
