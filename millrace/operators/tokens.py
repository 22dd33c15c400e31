"""Tokenised chat: template, prompt boundary, masking, truncation, padding, statistics, packing."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import stats
from ..scratch import Scratch

IGNORED = -100


class Tokenizer(Protocol):
    def encode(self, text: str) -> tuple[list[int], list[tuple[int, int]]]: ...


class ByteTokenizer:
    """One id per UTF-8 byte, with the character range that each belongs to."""

    def encode(self, text: str) -> tuple[list[int], list[tuple[int, int]]]:
        ids, spans = [], []
        for i, ch in enumerate(text):
            for b in ch.encode("utf-8"):
                ids.append(b)
                spans.append((i, i + 1))
        return ids, spans


class RegexTokenizer:
    """Words with the blank before them, and single other characters, hashed into a vocabulary."""

    def __init__(self, vocabulary: int = 32_768):
        self.vocabulary = vocabulary

    def encode(self, text: str) -> tuple[list[int], list[tuple[int, int]]]:
        import zlib

        found = list(re.finditer(r" ?\w+|\s|[^\w\s]", text))
        return [zlib.crc32(m[0].encode()) % self.vocabulary for m in found], [m.span() for m in found]


class SubwordTokenizer:
    """Byte-level BPE by a tokenizer file, with the character range of each token; a worker loads it once."""

    def __init__(self, path: str | None = None):
        if path is None:
            import public_tokenizers

            path = public_tokenizers.path("byte_bpe_50k.json")
        self.path = path

    def encode(self, text: str) -> tuple[list[int], list[tuple[int, int]]]:
        found = _loaded(self.path).encode(text, add_special_tokens=False)
        return found.ids, found.offsets


@lru_cache(maxsize=4)
def _loaded(path: str):
    from tokenizers import Tokenizer

    made = Tokenizer.from_file(path)
    made.encode_special_tokens = True  # their strings in a text are ordinary text
    return made


def render(messages: Column, generation: bool = False) -> Column:
    """The template: role and content of each message between marks; with `generation` the answer's
    opening at the end, so that the text for inference is a prefix of the text for training."""
    body = F.array_join(F.transform(messages, lambda m: F.concat(F.lit("<|"), m["role"], F.lit("|>\n"), m["content"], F.lit("<|end|>\n"))), "")
    return F.concat(body, F.lit("<|assistant|>\n")) if generation else body


def conversations(df: DataFrame) -> DataFrame:
    """(conv_id, messages) of turns in order."""
    turns = F.sort_array(F.collect_list(F.struct("turn", "role", F.col("text").alias("content"))))
    return df.groupBy("conv_id").agg(F.transform(turns, lambda t: F.struct(t["role"].alias("role"), t["content"].alias("content"))).alias("messages"))


def only_role_content(messages: Column) -> Column:
    return F.transform(messages, lambda m: F.struct(m["role"].alias("role"), m["content"].alias("content")))


def first_of_role(messages: Column, role: str) -> Column:
    return F.try_element_at(F.filter(messages, lambda m: m["role"] == role), F.lit(1))["content"]


def prompt_of(messages: Column) -> Column:
    return F.slice(messages, F.lit(1), F.size(messages) - 1)


def answer_of(messages: Column) -> Column:
    """The last message if it is the assistant's, else null."""
    last = F.try_element_at(messages, F.lit(-1))
    return F.when(last["role"] == "assistant", last["content"])


def role_faults(messages: Column, policy: str = "strict") -> Column:
    """Null if the roles keep the policy: strict is system, user, assistant; alternating is an optional
    system and then user and assistant in turn."""
    roles = F.transform(messages, lambda m: m["role"])
    if policy == "strict":
        ok = roles == F.array(*[F.lit(r) for r in ("system", "user", "assistant")])
    else:
        rest = F.when(F.try_element_at(roles, F.lit(1)) == "system", F.slice(roles, F.lit(2), F.size(roles))).otherwise(roles)
        ok = (F.size(rest) > 0) & F.forall(F.transform(rest, lambda r, i: r == F.when(i % 2 == 0, "user").otherwise("assistant")), lambda x: x)
    blank = F.exists(messages, lambda m: F.trim(F.coalesce(m["content"], F.lit(""))) == "")
    return F.when(~ok, "roles").when(blank, "blank content")


def boundary(prompt_ids: list[int], full_ids: list[int], spans: list[tuple[int, int]], prompt_chars: int) -> tuple[int, bool]:
    """Tokens of the prompt in the full text; whether the prompt's own ids are not a prefix of it (then
    the first token that starts at or after the prompt's end begins the answer; there must be one)."""
    if full_ids[: len(prompt_ids)] == prompt_ids:
        return len(prompt_ids), False
    answer = next((i for i, (a, _) in enumerate(spans) if a >= prompt_chars), None)
    if answer is None:
        raise ValueError("no token of the answer: the text is cut off, or one token holds prompt and answer")
    return answer, True


def tokenize(df: DataFrame, tokenizer: Tokenizer, most: int, id_col: str = "id", messages: str = "messages") -> DataFrame:
    """(id, input_ids, labels, meta): whole and prompt rendered, encoded, masked, cut at `most`."""
    schema = f"{id_col} string, input_ids array<int>, labels array<int>, meta struct<full_len:int,prompt_len:int,answer_len:int,truncated:boolean,fallback:boolean,supervised:int>"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for key, full, prompt in zip(pdf["id"], pdf["full"], pdf["prompt"]):
                ids, spans = tokenizer.encode(full)
                n, fallback = boundary(tokenizer.encode(prompt)[0], ids, spans, len(prompt))
                labels = [IGNORED] * n + ids[n:]
                meta = {"full_len": len(ids), "prompt_len": n, "answer_len": len(ids) - n, "truncated": len(ids) > most, "fallback": fallback, "supervised": sum(x != IGNORED for x in labels[:most])}
                rows.append((key, ids[:most], labels[:most], meta))
            yield pd.DataFrame(rows, columns=[id_col, "input_ids", "labels", "meta"])

    texts = df.select(F.col(id_col).cast("string").alias("id"), render(F.col(messages)).alias("full"), render(prompt_of(F.col(messages)), True).alias("prompt"))
    return texts.mapInPandas(run, schema)


def write_tokens(df: DataFrame, path: str, model: str, most: int, pad_id: int, pad_side: str = "right") -> None:
    """A token table, and beside it the one row that says how it was made."""
    df.write.parquet(f"{path}/rows")
    about = [(model, most, pad_id, pad_side)]
    df.sparkSession.createDataFrame(about, "model string, max_len int, pad_id int, pad_side string").coalesce(1).write.json(f"{path}/about")


def read_tokens(spark: SparkSession, path: str) -> tuple[DataFrame, dict]:
    about = spark.read.schema("model string, max_len int, pad_id int, pad_side string").json(f"{path}/about").collect()
    if len(about) != 1:
        raise ValueError("a token table says once how it was made")
    return spark.read.parquet(f"{path}/rows"), about[0].asDict()


def masked(ids: Column, n: Column) -> Column:
    """Labels: the first n positions ignored."""
    return F.concat(F.array_repeat(F.lit(IGNORED), n), F.slice(ids, n + 1, F.greatest(F.size(ids) - n, F.lit(0))))


def truncated(ids: Column, most: int) -> Column:
    return F.slice(ids, 1, most)


def padded(ids: Column, width: Column, pad, side: str = "right") -> Column:
    fill = F.array_repeat(F.lit(pad), F.greatest(width - F.size(ids), F.lit(0)).cast("int"))
    return F.concat(fill, ids) if side == "left" else F.concat(ids, fill)


def pad_batches(df: DataFrame, order: str, size: int, pad: int = 0, side: str = "right") -> DataFrame:
    """Rows in batches of `size` in order (ids from 0), each padded to its batch's width."""
    d = df.withColumn("batch", F.floor(F.col(order) / size))
    width = F.max(F.size("input_ids")).over(Window.partitionBy("batch"))
    d = d.withColumn("width", width)
    mask = padded(F.transform("input_ids", lambda _: F.lit(1)), F.col("width"), 0, side)
    return d.withColumn("attention_mask", mask).withColumn("input_ids", padded(F.col("input_ids"), F.col("width"), pad, side)).withColumn("labels", padded(F.col("labels"), F.col("width"), IGNORED, side))


def token_stats(df: DataFrame) -> DataFrame:
    """Distributions are over all examples, totals over those that teach anything."""
    kept = F.col("meta.supervised") > 0
    out = df.agg(
        F.count(F.lit(1)).alias("n_in"), F.count_if(kept).alias("n_kept"), F.count_if(~kept).alias("n_dropped"),
        F.sum(F.when(kept, F.size("input_ids")).otherwise(0)).alias("total_tokens"), F.sum("meta.supervised").alias("supervised_tokens"),
        F.avg(F.col("meta.truncated").cast("int")).alias("truncation_ratio"),
    )
    lengths = Scratch(df.sparkSession).table(df.select("meta.full_len", "meta.prompt_len", "meta.answer_len"), "lengths")
    for c in ("full_len", "prompt_len", "answer_len"):
        found = stats.percentiles(lengths, c, {f"{c}_p{int(q * 100)}": q for q in (0.5, 0.9, 0.95, 0.99)})
        out = stats.beside(out, found.select(*[F.col(x).cast("int").alias(x) for x in found.columns]), [], "left")
    return out


def train_seconds(tokens: float, epochs: float, per_second: float) -> float:
    return tokens * epochs / per_second


def placements(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """First fit of lengths in falling order, for counts of equal lengths: (length, first rank, first bin,
    bins, rows a bin, slot of a bin's first row). Bins are kept as runs of neighbours with equal room, so the
    work depends on how many lengths there are, not on how many rows."""
    runs: list[list[int]] = []  # bins, room, rows in each
    out = []
    for length in sorted(counts, reverse=True):
        left, rank, at, now = counts[length], 0, 0, []
        for bins, room, slot in runs:
            each = min(left, room // length) if length else left
            if not left or not each:
                now.append([bins, room, slot])
                at += bins
                continue
            full = min(bins, left // each) if length else 1
            out.append((length, rank, at, full, each, slot))
            now.append([full, room - each * length, slot + each])
            rank, left, at = rank + full * each, left - full * each, at + full
            if full < bins and 0 < left < each:  # the last bin gets what is left
                out.append((length, rank, at, 1, left, slot))
                now.append([1, room - left * length, slot + left])
                rank, left, at, full = rank + left, 0, at + 1, full + 1
            if full < bins:
                now.append([bins - full, room, slot])
                at += bins - full
        each = capacity // length if length else left
        if left and each:
            for bins, rows in ((left // each, each), (1, left % each)):
                if bins and rows:
                    out.append((length, rank, at, bins, rows, 0))
                    now.append([bins, capacity - rows * length, rows])
                    rank, at = rank + bins * rows, at + bins
        runs = now
    return out


def first_fit_decreasing(df: DataFrame, capacity: int, key: str = "id", length: str = "len") -> DataFrame:
    """(key, len, shard, bin, slot): rows by falling length, then by key, each in the first bin with room.
    Where a row goes depends on how many rows have each length and on its rank among those of its own, so
    counts are placed (one for each length up to the capacity) and rows meet their bin by rank. Ranks come
    from a range sort over all rows and counts by task: no task holds a length's rows."""
    spark = df.sparkSession
    scratch = Scratch(spark)
    rows = df.select(F.col(key).cast("long").alias("key"), F.col(length).cast("int").alias("len"))
    over = rows.where(F.col("len") > capacity).head(1)
    if over:
        raise ValueError(f"{over[0]['key']} is longer than {capacity}")
    ordered = rows.repartitionByRange("len", "key").sortWithinPartitions("len", "key")
    ordered = scratch.table(ordered.withColumn("_i", F.monotonically_increasing_id()), "ordered").withColumn("_p", F.shiftright("_i", 33))
    parts = scratch.table(ordered.groupBy("len", "_p").agg(F.count(F.lit(1)).alias("c"), F.min("_i").alias("_first")), "parts")
    counts = {r["len"]: r["c"] for r in parts.groupBy("len").agg(F.sum("c").alias("c")).collect()}  # a row a length
    before = F.coalesce(F.sum("c").over(Window.partitionBy("len").orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranked = ordered.join(parts.select("len", "_p", "_first", before.alias("_start")), ["len", "_p"]).select("key", "len", (F.col("_start") + F.col("_i") - F.col("_first")).alias("rank"))
    found = placements(counts, capacity)
    table = spark.createDataFrame(found, "len int, first long, at long, bins long, each long, slot long")
    here = (F.col("rank") >= F.col("first")) & (F.col("rank") < F.col("first") + F.col("bins") * F.col("each"))
    held = table.withColumnRenamed("len", "_len")
    placed = ranked.join(F.broadcast(held) if len(found) <= 100_000 else held, (F.col("len") == F.col("_len")) & here)
    by = F.col("rank") - F.col("first")
    return placed.select(F.col("key").alias(key), "len", F.lit(0).alias("shard"), (F.col("at") + F.floor(by / F.col("each"))).cast("int").alias("bin"), (F.col("slot") + by % F.col("each")).cast("int").alias("slot"))


def packed_bins(placed: DataFrame, examples: DataFrame, key: str = "id") -> DataFrame:
    """Bins with their concatenated ids and labels and the lengths inside."""
    both = placed.join(examples, key)
    items = F.sort_array(F.collect_list(F.struct("slot", "input_ids", "labels")))
    bins = both.groupBy("shard", "bin").agg(items.alias("x"))
    return bins.select("shard", "bin", F.flatten(F.transform("x", lambda e: e["input_ids"])).alias("input_ids"), F.flatten(F.transform("x", lambda e: e["labels"])).alias("labels"), F.transform("x", lambda e: F.size(e["input_ids"])).alias("seq_lens"))


def packing_report(placed: DataFrame, capacity: int, batch: int) -> DataFrame:
    bins = placed.groupBy("shard", "bin").agg(F.sum("len").alias("used"), F.count(F.lit(1)).alias("c"))
    return bins.agg(
        F.sum("c").alias("examples"), F.count(F.lit(1)).alias("bins"), F.ceil(F.sum("c") / batch).alias("steps_before"), F.ceil(F.count(F.lit(1)) / batch).alias("steps_after"),
        (F.sum("used") / (F.count(F.lit(1)) * capacity)).alias("fill"), F.max("c").alias("most_in_bin"),
    )


def render_question(stem: Column, options: Column) -> Column:
    """The stem and its options, each on a line behind its letter."""
    letters = F.array(*[F.lit(chr(65 + i)) for i in range(26)])
    lines = F.zip_with(F.slice(letters, F.lit(1), F.size(options)), options, lambda k, o: F.concat(k, F.lit(") "), o))
    return F.concat_ws("\n", stem, F.array_join(lines, "\n"))


def epoch_batches(df: DataFrame, key: str, seed: int, epoch: int, size: int, parts: int = 64) -> DataFrame:
    """Rows with (part, batch): an order drawn by hash of seed, epoch and key. Parts are drawn first, so
    that no task orders all rows; another order than a generator's shuffle on one machine."""
    drawn = F.xxhash64(F.lit(seed), F.lit(epoch), F.col(key))
    d = df.withColumn("part", F.pmod(drawn, F.lit(parts)))
    rank = F.row_number().over(Window.partitionBy("part").orderBy(drawn, key)) - 1
    return d.withColumn("batch", F.floor(rank / size))


def predict(df: DataFrame, generate, system: str, prompt_col: str = "prompt", out: str = "output") -> DataFrame:
    """Adds the model's answers: `generate` takes a list of rendered prompts and returns as many texts, in
    Arrow batches, so that a model is loaded once a worker."""
    messages = F.array(F.struct(F.lit("system").alias("role"), F.lit(system).alias("content")), F.struct(F.lit("user").alias("role"), F.col(prompt_col).cast("string").alias("content")))

    @F.pandas_udf("string")
    def of(prompts: pd.Series) -> pd.Series:
        return pd.Series(list(generate(prompts.tolist())), dtype=object)

    return df.withColumn(out, of(render(messages, True)))


def unmasked_answers(df: DataFrame, decode) -> DataFrame:
    """(id, answer): what the labels that count decode to."""

    @F.pandas_udf("string")
    def of(labels: pd.Series) -> pd.Series:
        return pd.Series([decode([int(x) for x in row if x != IGNORED]) for row in labels], dtype=object)

    return df.select("id", of("labels").alias("answer"))


def template_faults(df: DataFrame, id_col: str = "id", messages: str = "messages") -> DataFrame:
    """Examples whose text for inference is not the beginning of their text for training."""
    m = F.col(messages)
    return df.where(~F.startswith(render(m), render(prompt_of(m), True))).select(id_col)
