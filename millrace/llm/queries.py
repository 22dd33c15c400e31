"""Queries of this subpackage: one per operator, over whole tables, with their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import load, spread

def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(load(spark, sf_dir, "documents"))


def op1_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .lm_scoring import lm_scores

    return lm_scores(_docs(spark, sf_dir))


def op2_entropy_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import mix

    return mix(_docs(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken")


def op4_hash_tree_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sharding import shard_documents

    return shard_documents(_docs(spark, sf_dir), 8)


def op5_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .ngram_join import ngram_join

    # Batches are named by task and position: the plain scan, which reads the same way twice.
    return ngram_join(load(spark, sf_dir, "documents"))


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .exact_dedup import exact_dedup

    docs = _docs(spark, sf_dir).select("doc_id", "text")
    return exact_dedup(docs).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .langid import identify

    return identify(_docs(spark, sf_dir), labelled=load(spark, sf_dir, "documents")).select("doc_id", "held_out", "lang_pred", "score")


def op7_chunk_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .chunk_dedup import chunk_dedup

    return chunk_dedup(_docs(spark, sf_dir))


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .suffix_dedup import suffix_dedup

    return suffix_dedup(_docs(spark, sf_dir))


def op9_nn_descent(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .embed_dedup import near_dedup

    return near_dedup(load(spark, sf_dir, "embeddings"))


def op10_harmonic_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack

    # A task that runs again must find its rows in the same order: the plain scan.
    return pack(load(spark, sf_dir, "documents"))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .merkle import FIELDS, fold, leaf_of, manifest, proof

    docs = _docs(spark, sf_dir)
    raised = F.when(F.col("n_chars").isNotNull(), F.col("n_chars").cast("decimal(20,0)") + 1)
    changed = leaf_of(*[raised if c == "n_chars" else F.col(c) for c in FIELDS])
    hit = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 7 == 0, F.lit(False))
    out = manifest(docs, carry={"_seen": F.when(hit, changed)})
    out = out.withColumn("folded_root", fold(F.coalesce("_seen", "leaf"), F.col("path")))
    return out.select("doc_id", "leaf", "subroot", "root", proof(F.col("path")).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def op12_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .trie import COUNTS, conversation_trie

    return conversation_trie(load(spark, sf_dir, "conversations")).select("conv_id", "depth", "parent_conv_id", *COUNTS, "ends_sha256")


def op13_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .bpe import decode, encode

    out = decode(encode(_docs(spark, sf_dir), carry=["doc_id"]))
    joined = F.array_join(F.col("ids").cast("array<string>"), " ")
    return out.select("doc_id", F.size("ids").cast("bigint").alias("n_tokens"), F.sha2(joined.cast("binary"), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


OP6_SQL = r"""
WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = min(doc_id) OVER w AS kept, sha256(t) AS text_sha256
FROM n WINDOW w AS (PARTITION BY t)
"""


#: CRC-32 in SQL: what a byte adds, and the fold over the bytes of an upper-case hex text.
BYTE_TABLE = """byte_table AS (
  SELECT list_transform(range(256), lambda n: list_reduce(range(8), lambda a, i: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END, n::BIGINT)) AS crc)"""


def _crc(h: str) -> str:
    return f"""xor(list_reduce(list_transform(range(length({h}) // 2), lambda i: (16 * (instr('0123456789ABCDEF', {h}[2 * i + 1]) - 1) + instr('0123456789ABCDEF', {h}[2 * i + 2]) - 1)::BIGINT),
                         lambda a, c: xor(crc[(xor(a, c) & 255) + 1], a >> 8), 4294967295::BIGINT), 4294967295)::BIGINT"""


def _op11_sql() -> str:
    part = lambda c: f"CASE WHEN {c} IS NULL THEN '-' ELSE octet_length(encode(({c})::VARCHAR)) || ':' || ({c})::VARCHAR END"
    leaf = lambda n: "sha256(" + " || ".join(map(part, ("doc_id", "source", "lang", n, "text"))) + ")"
    climb = """
  SELECT lvl + 1, g, p // 2, CASE WHEN b IS NULL THEN sha256(a) ELSE sha256(a || b) END, (n + 1) // 2
  FROM (SELECT lvl, g, pos AS p, digest AS a, n, lead(digest) OVER (PARTITION BY g ORDER BY pos) AS b FROM {t} WHERE n > 1) x WHERE p % 2 = 0"""
    return f"""
WITH RECURSIVE {BYTE_TABLE},
c AS (SELECT *, upper(hex(encode(doc_id::VARCHAR))) AS h FROM documents),
d AS (SELECT doc_id, lang, {leaf("n_chars")} AS leaf,
             CASE WHEN coalesce({_crc("h")} % 7 = 0, false) THEN {leaf("n_chars::HUGEINT + 1")} ELSE {leaf("n_chars")} END AS seen FROM c, byte_table),
r AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY lang) AS n,
             dense_rank() OVER (ORDER BY lang NULLS FIRST) - 1 AS g FROM d),
low AS (SELECT 0 AS lvl, g, pos, leaf AS digest, n FROM r UNION ALL {climb.format(t="low")}),
tops AS (SELECT g, digest AS subroot, count(*) OVER () AS n FROM low WHERE n = 1),
high AS (SELECT 0 AS lvl, 0 AS g, g AS pos, subroot AS digest, n FROM tops UNION ALL {climb.format(t="high")}),
up AS (
  SELECT 0 AS lvl, r.doc_id, r.leaf, r.seen AS acc, r.g, r.pos, r.n, 0 AS tier, '' AS proof, r.g AS g0 FROM r
  UNION ALL
  SELECT CASE WHEN u.n = 1 THEN 0 ELSE u.lvl + 1 END, u.doc_id, u.leaf,
         CASE WHEN u.n = 1 THEN u.acc WHEN s.digest IS NULL THEN sha256(u.acc) WHEN u.pos % 2 = 1 THEN sha256(s.digest || u.acc) ELSE sha256(u.acc || s.digest) END,
         CASE WHEN u.n = 1 THEN 0 ELSE u.g END, CASE WHEN u.n = 1 THEN u.g ELSE u.pos // 2 END, CASE WHEN u.n = 1 THEN (SELECT count(*) FROM tops) ELSE (u.n + 1) // 2 END,
         CASE WHEN u.n = 1 THEN 1 ELSE u.tier END, u.proof || coalesce(s.digest, ''), u.g0
  FROM up u LEFT JOIN (SELECT 0 AS tier, * FROM low UNION ALL SELECT 1, * FROM high) s
    ON s.tier = u.tier AND s.lvl = u.lvl AND s.g = u.g AND s.pos = xor(u.pos, 1) AND u.n > 1
  WHERE u.n > 1 OR u.tier = 0)
SELECT doc_id, leaf, subroot, (SELECT digest FROM high WHERE n = 1) AS root, sha256(proof) AS proof_sha256, acc AS folded_root,
       acc = (SELECT digest FROM high WHERE n = 1) AS verified
FROM up JOIN tops ON tops.g = up.g0 WHERE up.n = 1 AND tier = 1
"""


def _op12_sql() -> str:
    return f"""
WITH {BYTE_TABLE},
t AS (SELECT conv_id, list({{'role': coalesce(role, ''), 'text': coalesce(text, '')}} ORDER BY turn NULLS FIRST, coalesce(role, ''), sha256(octet_length(encode(coalesce(role, ''))) || ':' || coalesce(role, '') || coalesce(text, ''))) AS turns
      FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
h AS (SELECT t.*, ({_crc("upper(hex(encode(conv_id::VARCHAR)))")} % 4)::BIGINT AS h FROM t, byte_table),
b AS (SELECT h.conv_id AS c, list_concat(coalesce(heads.turns[1:h.h], []), h.turns[h.h + 1:]) AS turns
      FROM h LEFT JOIN t AS heads ON heads.conv_id = h.conv_id - h.conv_id % 20),
p AS (SELECT c, d, sha256(turns[1:d]::VARCHAR || d) AS node, len(turns) AS size, CASE WHEN d = 0 THEN NULL ELSE sha256(turns[1:d - 1]::VARCHAR || (d - 1)) END AS parent,
             CASE WHEN d = 0 THEN 0 ELSE len(regexp_extract_all(turns[d].text, '[^\x20\x09-\x0D]+')) END AS words
      FROM b, unnest(range(len(turns) + 1)) AS x(d)),
n AS (SELECT node, any_value(parent) AS parent, any_value(d) AS depth, min(c) AS conv_id, count(*) AS n_convs, any_value(words) AS words,
             sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (size = d), '')) AS ends_sha256 FROM p GROUP BY node),
k AS (SELECT parent, count(*) AS kids FROM n GROUP BY parent),
f AS (SELECT n.*, coalesce(kids, 0) AS kids FROM n LEFT JOIN k ON k.parent = n.node),
a AS (SELECT p.node AS above, sum((f.kids = 0)::INT) AS leaves, sum((f.n_convs - 1) * f.words) AS saved
      FROM f JOIN p ON p.c = f.conv_id AND p.d <= f.depth GROUP BY p.node)
SELECT f.conv_id, f.depth::BIGINT AS depth, up.conv_id AS parent_conv_id, f.n_convs::BIGINT AS n_convs, f.kids::BIGINT AS n_children, a.leaves::BIGINT AS n_leaves, a.saved::BIGINT AS saved_tokens, f.ends_sha256
FROM f JOIN a ON a.above = f.node LEFT JOIN n AS up ON up.node = f.parent
"""


def _op4_sql() -> str:
    from .sharding import tree

    draws = [f"-ln(((('0x' || substr(md5(doc_id || '|{x.name}'), 1, 12))::BIGINT) + 0.5) / 281474976710656.0)" for x in tree(9)]
    return f"""
WITH {BYTE_TABLE},
d AS (
  SELECT doc_id, coalesce(text, '') AS t, upper(hex(encode(coalesce(text, '')))) AS h, [{', '.join(draws)}] AS x FROM documents),
p AS (
  SELECT doc_id, (length(h) // 2 + 1)::BIGINT AS size,
         {_crc('h')} AS text_crc32,
         (list_position(x[1:8], list_min(x[1:8])) - 1)::INTEGER AS shard,
         (list_position(x, list_min(x)) - 1)::INTEGER AS grown_shard
  FROM d, byte_table)
SELECT doc_id, size, text_crc32, 'key' AS law, shard,
       (row_number() OVER (PARTITION BY shard ORDER BY doc_id) - 1)::BIGINT AS slot, grown_shard FROM p
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_lm_scoring, op2_entropy_mixing, op3_language_id, op4_hash_tree_sharding, op5_ngram_join, op6_exact_dedup, op7_chunk_dedup, op8_suffix_dedup, op9_nn_descent, op10_harmonic_packing, op11_merkle_manifest, op12_conversation_trie, op13_byte_bpe)}


def oracle_sql() -> dict[str, str]:
    return {"op4_hash_tree_sharding": _op4_sql(), "op6_exact_dedup": OP6_SQL, "op11_merkle_manifest": _op11_sql(), "op12_conversation_trie": _op12_sql()}
