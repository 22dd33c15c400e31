"""Curation: taxonomy, length band, caps with accounting, diversity, contamination, group split."""

from __future__ import annotations

import json
import random
import uuid
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import hashing, stats, text
from ..scratch import Scratch
from .gates import Check

#: A taxonomy is an ordered list of (label, keywords): an argument, or a JSON file of such pairs.
EXAMPLE_RULES = [("secret", ["token =", "password", "api_key"]), ("license", ["copyright", "license"]), ("table", [" | "]), ("symbols", ["***", "$$$"])]


def load_rules(path: str) -> list[tuple[str, list[str]]]:
    with open(path, encoding="utf-8") as f:
        return [(label, list(words)) for label, words in json.load(f)]


def classify(parts: list[Column], rules: list) -> Column:
    """The label of the first rule of which a keyword is in the lower-cased parts; null if none is."""
    hay = F.lower(F.concat_ws("\n", *[F.when(F.length(p) > 0, p) for p in parts]))
    tests = [(reduce(lambda a, b: a | b, [F.contains(hay, F.lit(w)) for w in words]), label) for label, words in rules]
    out = F.when(*[tests[0][0], F.lit(tests[0][1])])
    for test, label in tests[1:]:
        out = out.when(test, F.lit(label))
    return out


#: Bytes of keywords that one automaton holds; a larger rule table makes several, and as many passes.
AUTOMATON_BYTES = 16 << 20
_automata: dict[str, object] = {}


def _automaton(name: str, shared):
    """A broadcast list of (keyword, number) as an automaton, made once a worker."""
    import ahocorasick

    if name not in _automata:
        made = ahocorasick.Automaton()
        for word, number in shared.value:
            made.add_word(word, number)
        made.make_automaton()
        if len(_automata) > 3:
            _automata.clear()
        _automata[name] = made
    return _automata[name]


def classify_by_table(df: DataFrame, parts: list[Column], rules: DataFrame, out: str = "topic") -> DataFrame:
    """Adds the label of the first rule of which a keyword is in the lower-cased parts; null if none is.
    rules: (rule, label, keyword), a row a keyword, rules in order of their number; any number of them. All
    keywords are looked for at once, in one pass over a text. The automaton goes to every worker; if the
    table is larger than AUTOMATON_BYTES, it is cut by rule numbers and texts are passed over once a cut."""
    spark = df.sparkSession
    words = rules.where("keyword is not null").groupBy("keyword").agg(F.min("rule").alias("rule"))
    words = Scratch(spark).table(words.select("rule", "keyword", F.octet_length("keyword").cast("long").alias("size")), "keywords")
    total = words.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    cuts = [(None, None)]
    if total > AUTOMATON_BYTES:
        at = [i / (total // AUTOMATON_BYTES + 1) for i in range(1, total // AUTOMATON_BYTES + 1)]
        ends = sorted({int(x) for x in words.approxQuantile("rule", at, 0.001)})
        cuts = list(zip([None, *ends], [*ends, None]))
    hay = F.lower(F.concat_ws("\n", *[F.when(F.length(p) > 0, p) for p in parts]))
    found = df.withColumn("_hay", hay)
    numbers = []
    for k, (low, high) in enumerate(cuts):
        mine = words.where((F.lit(True) if low is None else F.col("rule") > low) & (F.lit(True) if high is None else F.col("rule") <= high))
        shared = spark.sparkContext.broadcast([(r["keyword"], r["rule"]) for r in mine.where("size > 0").collect()])
        always = mine.where("size = 0").agg(F.min("rule")).first()[0]  # the empty keyword is in every text
        found = found.withColumn(f"_rule{k}", _first_rule(shared, always)(F.col("_hay")))
        numbers.append(F.col(f"_rule{k}"))
    labels = rules.groupBy(F.col("rule").alias("_rule")).agg(F.min("label").alias("_label"))
    least = F.coalesce(*numbers)  # cuts are in the order of rules
    return found.withColumn("_rule", least).join(labels, "_rule", "left").withColumn(out, F.col("_label")).drop("_hay", "_rule", "_label", *[f"_rule{k}" for k in range(len(cuts))])


def _first_rule(shared, always: int | None):
    name = uuid.uuid4().hex

    @F.pandas_udf("long")
    def of(texts: pd.Series) -> pd.Series:
        found, out = _automaton(name, shared), []
        for text in texts:
            best = always
            if len(found):
                for _, number in found.iter(text):
                    if best is None or number < best:
                        best = number
            out.append(best)
        return pd.Series(out, dtype="Int64")

    return of


def check_labels(wanted: list[str], rules: list) -> list[str]:
    unknown = sorted(set(wanted) - {label for label, _ in rules})
    if unknown:
        raise ValueError(f"unknown labels: {unknown}")
    return wanted


def length_band(df: DataFrame, col: str, low: int, high: int) -> DataFrame:
    """Characters between the bounds, both included."""
    return df.where(F.char_length(F.coalesce(F.col(col), F.lit(""))).between(low, high))


def exact_first(df: DataFrame, key: Column, order: list[str], columns: list[str] | None = None) -> DataFrame:
    """Of equal keys, compared by digest, the first row in order, one where rows tie. Whole rows are
    pruned by rank before they are shuffled; if a few small columns are enough they travel with the
    order in one aggregation."""
    digest = F.sha2(F.coalesce(key, F.lit("")).cast("binary"), 256)
    if columns is not None:
        named = list(dict.fromkeys([*order, *columns]))
        return df.groupBy(digest.alias("_k")).agg(F.min(F.struct(*named)).alias("_m")).select(*[F.col(f"_m.{c}").alias(c) for c in columns])
    rank = F.row_number().over(Window.partitionBy("_k").orderBy(*order))
    return df.withColumn("_k", digest).withColumn("_r", rank).where("_r = 1").drop("_k", "_r")


def capped(df: DataFrame, key: str, topic: str, order: str, cap: int) -> DataFrame:
    """Each row's fate: kept, duplicate, over_cap, or untagged. The cap is tested before the
    duplicate: a row that repeats a key after its topic is full counts as over_cap. Rows that tie in
    order follow one another as they were written: the rows are written once and read again."""
    rows = Scratch(df.sparkSession).table(df.withColumn("_at", F.struct(order, F.monotonically_increasing_id().alias("_i"))), "rows")
    tagged = rows.where(F.col(topic).isNotNull())
    first = tagged.groupBy(key).agg(F.min("_at").alias("_o")).select(F.col("_o._i").alias("_i"))
    marked = tagged.join(first.withColumn("_first", F.lit(1)), tagged["_at._i"] == first["_i"], "left").drop("_i")
    # A topic is full after its cap-th first row: ranks up to the cap are limited before the shuffle.
    top = marked.where("_first = 1").select(topic, F.col("_at").alias("_o")).withColumn("_r", F.row_number().over(Window.partitionBy(topic).orderBy("_o"))).where(F.col("_r") <= cap)
    full = top.groupBy(F.col(topic).alias("_t")).agg(F.count(F.lit(1)).alias("_n"), F.max("_o").alias("_last")).where(F.col("_n") == cap).select("_t", "_last")
    counted = marked.join(full, marked[topic] == full["_t"], "left")
    over = F.col("_last").isNotNull() & (F.col("_at") > F.col("_last"))
    fate = F.when(over, "over_cap").when(F.col("_first") == 1, "kept").otherwise("duplicate")
    done = counted.withColumn("fate", fate).drop("_first", "_t", "_last")
    return done.unionByName(rows.where(F.col(topic).isNull()).withColumn("fate", F.lit("untagged"))).drop("_at")


def collect(df: DataFrame, rules: list, cap: int, min_lines: int = 1, topics: list[str] | None = None, check_syntax: bool = True, rows: int | None = None) -> DataFrame:
    """instruction, input, output, file, row -> with code, topic, key, fate for every row scanned.
    With `rows`, at most so many are kept of each file and later rows are not counted."""
    if topics:
        check_labels(topics, rules)
    d = df.select("file", "row", text.clean_instruction(F.col("instruction")).alias("instruction"), text.strip(F.coalesce("input", F.lit(""))).alias("input"), text.strip_fence(F.col("output"))["code"].alias("code"))
    d = d.withColumn("pos", F.struct("file", "row"))
    short = (F.length("instruction") == 0) | (text.line_count(F.col("code")) < min_lines)
    bad = ~text.parses(F.col("code")) if check_syntax else F.lit(False)
    d = d.withColumn("_gone", F.when(short, "short").when(bad, "syntax"))
    d = d.withColumn("topic", F.when(F.col("_gone").isNull(), classify([F.col("instruction"), F.col("input"), F.col("code")], rules)))
    if topics:
        d = d.withColumn("topic", F.when(F.col("topic").isin(topics), F.col("topic")))
    d = d.withColumn("key", F.sha1(hashing.nul_joined(F.col("instruction"), F.col("input"), F.col("code")).cast("binary")))
    out = capped(d.where("_gone is null"), "key", "topic", "pos", cap).drop("_gone")
    out = out.unionByName(d.where("_gone is not null").withColumn("fate", F.col("_gone")).drop("_gone"))
    if rows is None:
        return out
    kept = F.sum((F.col("fate") == "kept").cast("int")).over(Window.partitionBy("file").orderBy("row").rowsBetween(Window.unboundedPreceding, -1))
    return out.withColumn("_t", F.coalesce(kept, F.lit(0))).where(F.col("_t") < rows).drop("_t")


def chat_records(kept: DataFrame, prompts: list[str], prefix: str = "doc-") -> DataFrame:
    """The kept rows of `collect` as chat examples: id from the content, a system prompt drawn by the
    id's digest, the instruction with its input, the code."""
    named = kept.select(hashing.content_id(F.col("instruction"), F.col("input"), F.col("code"), prefix=prefix).alias("id"), "topic", "instruction", "input", "code")
    prompt = F.array(*[F.lit(p) for p in prompts])[hashing.sha1_mod(F.col("id"), len(prompts)).cast("int")]
    turn = lambda role, content: F.struct(F.lit(role).alias("role"), content.alias("content"))
    messages = F.array(turn("system", prompt), turn("user", text.join_input(F.col("instruction"), F.col("input"))), turn("assistant", F.col("code")))
    return named.select("id", "topic", messages.alias("messages"))


def diversity(df: DataFrame, prompt: str, group: str, answer: str) -> DataFrame:
    """One row of measures over a chat table."""
    size = F.char_length(answer)
    base = df.agg(
        F.count(F.lit(1)).alias("examples"), F.count_distinct(prompt).alias("prompts"), F.count_distinct(group).alias("groups"),
        stats.duplicate_share(F.col(answer)).alias("duplicate_answer_share"),
    )
    top = lambda c, name: df.groupBy(c.alias("_v")).count().agg((F.max("count") / F.sum("count")).alias(name))
    ratio = stats.spread(df.select(size.alias("len")), "len").select(F.col("ratio_p90_p10").alias("answer_len_ratio"))
    out = base
    for part in (top(F.col(group), "largest_group_share"), top(size, "same_length_share"), ratio):
        out = out.withColumn("_j", F.lit(1)).join(part.withColumn("_j", F.lit(1)), "_j").drop("_j")
    return out


def diversity_checks(measures: dict, limits: dict) -> list[Check]:
    """All thresholds: names with min_ bound from below, with max_ from above."""
    out = []
    for name, limit in limits.items():
        kind, what = name.split("_", 1)
        value = measures[what]
        out.append(Check(what, value >= limit if kind == "min" else value <= limit, f"{value} against {name} {limit}"))
    return out


def contamination(train: DataFrame, test: DataFrame, key: str, body: str, group: str, near: DataFrame | None = None) -> DataFrame:
    """Rows (rule, hits): ids, normalised texts, groups and near copies shared by the two. Each table is
    read once: a row gives one key a rule, and a rule's key is shared if both sides have it."""

    def keys(df: DataFrame, side: str) -> DataFrame:
        d = df.select(F.col(key).cast("string").alias("id"), F.sha2(text.normalize_text(F.col(body)).cast("binary"), 256).alias("text"), F.col(group).cast("string").alias("group"))
        pairs = F.array(*[F.struct(F.lit(r).alias("rule"), F.col(r).alias("k")) for r in ("id", "text", "group")])
        return d.select(F.inline(pairs)).where("k is not null").withColumn("side", F.lit(side))

    both = keys(train, "train").unionByName(keys(test, "test")).groupBy("rule", "k").agg(F.count_if(F.col("side") == "train").alias("a"), F.count_if(F.col("side") == "test").alias("b"))
    hits = both.groupBy("rule").agg(F.count_if((F.col("a") > 0) & (F.col("b") > 0)).alias("hits"))
    rules = train.sparkSession.createDataFrame([("id",), ("text",), ("group",)], "rule string")
    out = rules.join(hits, "rule", "left").select("rule", F.coalesce("hits", F.lit(0)).alias("hits"))
    return out if near is None else out.unionByName(near.agg(F.lit("near").alias("rule"), F.count(F.lit(1)).alias("hits")))


def evidence(shared: DataFrame, order: list[str], k: int = 3) -> DataFrame:
    """The first k rows of a finding, as examples."""
    return shared.orderBy(*order).limit(k)


def group_split(sizes: dict[str, int], ratios: dict[str, float], seed: int) -> dict[str, str]:
    """Whole groups to splits: shuffled by seed, larger first, each to the split that lacks most.
    Sizes are one number per group; rows stay where they are and meet the split in a join."""
    keys = sorted(sizes)
    random.Random(seed).shuffle(keys)
    lack = {name: sum(sizes.values()) * share for name, share in ratios.items()}
    out = {}
    for key in sorted(keys, key=sizes.get, reverse=True):
        out[key] = max(ratios, key=lack.get)
        lack[out[key]] -= sizes[key]
    empty = sorted(set(ratios) - set(out.values()))
    if empty:
        raise ValueError(f"{len(sizes)} groups leave {empty} empty")
    return out


def split_rows(df: DataFrame, group: str, ratios: dict[str, float], seed: int, most_groups: int = 1_000_000) -> DataFrame:
    """Rows with their split. The group table is bounded by most_groups; beyond it is an error."""
    rows = df.groupBy(group).count().limit(most_groups + 1).collect()
    if len(rows) > most_groups:
        raise ValueError(f"more than {most_groups} groups")
    placed = group_split({r[0]: r[1] for r in rows}, ratios, seed)
    table = df.sparkSession.createDataFrame(list(placed.items()), f"`{group}` string, split string")
    return df.join(table, group)


def sample_exact(df: DataFrame, n: int, seed: int, order: list[str]) -> DataFrame:
    """The rows at Python's random.sample(range(count), n), in order: the same sample as there."""
    spark, named = df.sparkSession, [F.col(f"`{c}`") for c in df.columns]
    sorted_rows = df.repartitionByRange(*order).sortWithinPartitions(*order) if order else df
    packed = sorted_rows.select(F.struct(*named).alias("row"), F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("i"))
    rows = Scratch(spark).table(packed, "numbered")
    parts = rows.groupBy("part").agg(F.count(F.lit(1)).alias("c"), F.min("i").alias("first"))  # a row a task
    before = F.sum("c").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    starts = parts.select("part", "first", F.coalesce(before, F.lit(0)).alias("start"))
    total = rows.count()
    at = sorted(random.Random(seed).sample(range(total), min(n, total)))
    wanted = spark.createDataFrame([(i,) for i in at], "pos long")
    flat = rows.join(starts, "part").select((F.col("start") + F.col("i") - F.col("first")).alias("pos"), "row")
    return flat.join(wanted, "pos").orderBy("pos").select("row.*")


def sample_hash(df: DataFrame, share: float, key: str, seed: int) -> DataFrame:
    """A share of rows by a hash of key and seed: distributed and repeatable, another sample than above."""
    return df.where(F.pmod(F.xxhash64(F.lit(seed), F.col(key)), F.lit(1_000_000)) < int(share * 1_000_000))
