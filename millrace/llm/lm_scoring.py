"""Language-model scoring of whole documents.

Counts of every word over all training documents are gathered by a distributed count (a row per
task and word). The most frequent words and two marks (end of text, other word) are the vocabulary
of a gated recurrent model (`gru`), whose output biases start from those counts and whose vocabulary
grows with the square root of the words read, up to FREQUENT. Its weights are fitted on all training
documents: the driver's few epochs over about `fit_docs` of them give all tasks the same start, then
in ROUNDS rounds every task trains on its own rows of the round, each training document falls into
one round, and the tasks' parameters are averaged by their tokens, slice by slice. Scoring carries
the state through each whole document. A word outside the vocabulary has the probability of the mark
"other" times its smoothed share of all other words' counts, so the counts of the whole corpus decide
every rare word.

Texts are read twice, to count and to encode: the encoded table holds two bytes a word, and the words
beyond a broadcast list of FREQUENT words as text. Those meet their counts in a join on the word; by
the list's making no such word is frequent, so the join has no hot key. Every row of the encoded table
has a number of its own, by which sums come back to it, so copies of a text are no hot key either.
Texts that a task reads again are scored once. Nothing is proportional to the corpus on the driver.

Defined results: null text is empty, which is the end mark alone; a null id hashes as empty text;
repeated rows are scored alike; a very long text is scored whole, in windows; an empty table gives an
empty result; other columns, of whatever name, are not read.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._common import Scratch, crc_of, map_arrow, map_pandas, small_batches
from .gru import END, OTHER, Model, Shape

FREQUENT = 65_536
#: Tokens that go through the lanes together, about.
TOGETHER = 1_500_000
#: Tokens that a task trains on together, about, and lanes at most.
TRAINED, LANES = 600_000, 512
#: Passes over shares of the training documents that make up the whole, and the rate of the first.
ROUNDS, RATE = 4, 8e-3
#: Parameters that travel as one row, and how many partial sums of a slice there are.
SLICE, PARTS = 65_536, 64
#: Words that a task counts together before it passes on its counts.
HELD = 4_000_000


def held_out(id_col: str) -> Column:
    return F.pmod(crc_of(id_col), F.lit(7)) == 2


def words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The words of texts, A-Z lowered and split at ASCII white space, end to end; of each its text."""
    split = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    sizes = pc.list_value_length(split).to_numpy(zero_copy_only=False)
    flat, owner = split.flatten(), np.repeat(np.arange(len(texts)), sizes)
    full = pc.binary_length(flat).to_numpy(zero_copy_only=False) > 0
    return (flat, owner) if full.all() else (flat.filter(pa.array(full)), owner[full])


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held, size = [], 0

    def rows() -> pa.RecordBatch:
        found = pa.concat_arrays(held).value_counts()
        held.clear()
        return pa.RecordBatch.from_arrays([found.field("values"), found.field("counts")], names=["word", "n"])

    for batch in batches:
        held.append(words(batch.column(0))[0])
        size += len(held[-1])
        if size > HELD:
            yield rows()
            size = 0
    if size:
        yield rows()


def shape_for(tokens: int) -> Shape:
    """A vocabulary of the square root of the words read, from the least shape to what the list holds."""
    size = max(Shape().vocabulary, min(FREQUENT, math.isqrt(tokens)))
    classes = max(Shape().classes, math.isqrt(size) // 2)
    return Shape(classes, size // classes)


def encoder(shared, inside: int, schema: T.StructType):
    """(id, held_out, round, text) -> a numbered row with model ids, counts and sums of frequent words, rare words."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        frequent, logs = shared.value
        number = TaskContext.get().partitionId() << 33
        for batch in batches:
            n = batch.num_rows
            flat, owner = words(batch.column(3))
            found = pc.index_in(flat, value_set=frequent)
            rank = pc.fill_null(found, -1).to_numpy(zero_copy_only=False).astype(np.int64)
            known = rank >= 0
            ids = np.where(known & (rank < inside), rank + 2, OTHER)
            sizes = np.bincount(owner, minlength=n)
            ends = np.cumsum(sizes)
            at = np.insert(ids, ends, END).astype("<u2").tobytes()
            edges = 2 * (np.concatenate([[0], ends]) + np.arange(n + 1))
            value = np.where(known, logs[rank] if len(logs) else 0.0, 0.0)
            rare = flat.filter(pa.array(~known))
            rare_at = np.concatenate([[0], np.cumsum(np.bincount(owner[~known], minlength=n))]).astype(np.int32)
            by_text = lambda x: pa.array(np.bincount(owner, weights=x, minlength=n))
            yield pa.RecordBatch.from_arrays(
                [
                    *batch.columns[:3], pa.array(number + np.arange(n)), pa.array([at[a:b] for a, b in zip(edges, edges[1:])], pa.binary()),
                    pa.array(np.bincount(owner[known], minlength=n).astype(np.int64)), pa.array(np.bincount(owner[ids == OTHER], minlength=n).astype(np.int64)),
                    by_text(value), by_text(np.where(rank >= inside, value, 0.0)), pa.ListArray.from_arrays(pa.array(rare_at), rare),
                ],
                names=schema.names,
            )
            number += n

    return encode


def lm_scores(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", fit_docs: int = 1500, epochs: int = 3, shape: Shape | None = None) -> DataFrame:
    """One row per input row: id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    spark = df.sparkSession
    small_batches(spark, 500)
    scratch = Scratch(spark)
    key = F.coalesce(F.col(id_col).cast("string"), F.lit(""))
    docs = df.select(F.col(id_col).alias("id"), held_out(id_col).alias("held_out"), F.xxhash64(key).alias("drawn"), F.col(text_col).cast("string").alias("text"))
    train = docs.where(~F.col("held_out"))

    counts = scratch.table(map_arrow(train.select("text"), _count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")), "counts")
    n_docs = train.count()
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count(F.lit(1)).alias("v")).first()
    n_all, v_all = total["n"] + n_docs, total["v"] + (n_docs > 0)
    shape = shape or shape_for(n_all)
    # Words of at least `least` occurrences are the frequent ones: as many as fit the list, ties all in or
    # all out. Counts of counts are few (their sum bounds them), so no task sorts or sends a share of the words.
    falling = Window.orderBy(F.desc("n"))
    upto = counts.groupBy("n").agg(F.count(F.lit(1)).alias("c")).select("n", F.sum("c").over(falling).alias("upto"))
    least = upto.where(F.col("upto") <= FREQUENT).agg(F.min("n")).first()[0]
    top = [] if least is None else sorted(counts.where(F.col("n") >= least).collect(), key=lambda r: (-r["n"], r["word"]))
    top_counts = np.array([r["n"] for r in top], dtype=np.float64)
    inside = shape.vocabulary - 2
    n_other = total["n"] - int(top_counts[:inside].sum())
    v_other = total["v"] - min(inside, len(top))

    model = Model.start(shape, np.concatenate([[n_docs, n_other + 1], top_counts[:inside]]))
    shared = spark.sparkContext.broadcast((pa.array([r["word"] for r in top], pa.string()), np.log10(top_counts + 1)))
    fields = [T.StructField(c, t) for c, t in (("id", df.schema[id_col].dataType), ("held_out", T.BooleanType()), ("drawn", T.LongType()), ("row", T.LongType()), ("ids", T.BinaryType()))]
    fields += [T.StructField(c, t) for c, t in (("n_frequent", T.LongType()), ("n_other", T.LongType()), ("s_all", T.DoubleType()), ("s_other", T.DoubleType()), ("rare", T.ArrayType(T.StringType())))]
    schema = T.StructType(fields)
    coded = scratch.table(map_arrow(docs, encoder(shared, inside, schema), schema), "coded")

    fitted = coded.where(~F.col("held_out"))
    share = min(2**63 - 1, -(2**63) + 2**64 * fit_docs // max(1, n_docs))
    # Texts that are drawn start once, however often they occur: rows without ids, or with one, are no lump.
    drawn = sorted(bytes(r[0]) for r in fitted.where(F.xxhash64("drawn", "ids") <= F.lit(share)).select("ids").distinct().collect())
    model.train([np.frombuffer(x, "<u2").astype(np.int64) for x in drawn], epochs)
    for r in range(ROUNDS if n_docs else 0):
        mine = fitted.where(F.pmod(F.xxhash64(F.lit("round"), "drawn", "ids"), F.lit(ROUNDS)) == r).select("ids")
        model = averaged(mine, model, RATE * (1 - r / ROUNDS))
    weights = spark.sparkContext.broadcast(model)

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        lm = weights.value
        done: dict[bytes, float] = {}
        rows, fresh, keys, size = [], [], [], 0

        def flush() -> pd.DataFrame:
            done.update(zip(keys, lm.score(fresh).tolist()))
            out = pd.DataFrame({"row": [a for a, _ in rows], "logp": [done[k] for _, k in rows]})
            rows.clear(), fresh.clear(), keys.clear()
            return out

        for pdf in batches:
            for row, ids in zip(pdf["row"], pdf["ids"]):
                key = hashlib.blake2b(ids, digest_size=16).digest()
                rows.append((row, key))
                if key not in done:
                    done[key] = 0.0
                    fresh.append(np.frombuffer(ids, "<u2"))
                    keys.append(key)
                    size += len(fresh[-1])
            if size > TOGETHER:
                yield flush()
                size = 0
        if rows:
            yield flush()

    scored = map_pandas(coded.select("row", "ids"), score, "row long, logp double")
    if len(top) < total["v"]:
        tail = counts if least is None else counts.where(F.col("n") < least)
        meets = coded.where(F.size("rare") > 0).select("row", F.explode("rare").alias("word")).join(tail.select("word", "n"), "word")
        scored = scored.join(meets.groupBy("row").agg(F.sum(F.log10(F.col("n") + 1.0)).alias("s_rare"), F.count(F.lit(1)).alias("n_rare")), "row", "left")
    else:
        scored = scored.withColumn("s_rare", F.lit(0.0)).withColumn("n_rare", F.lit(0))
    both = coded.drop("rare", "drawn").withColumn("n_tokens", (F.octet_length("ids") / 2).cast("bigint")).drop("ids").join(scored, "row")
    s_rare, n_rare = F.coalesce("s_rare", F.lit(0.0)), F.coalesce("n_rare", F.lit(0))
    log_end = math.log10(n_docs + 1)
    return both.select(
        F.col("id").alias(id_col), "held_out", "n_tokens",
        (F.col("n_frequent") + n_rare + F.lit(int(n_docs > 0))).cast("bigint").alias("n_known"),
        F.lit(n_all).cast("bigint").alias("train_tokens"),
        (F.col("s_all") + F.lit(log_end) + s_rare - F.col("n_tokens") * F.lit(math.log10(n_all + v_all + 1))).alias("base_score"),
        (F.col("logp") / F.lit(math.log(10)) + F.col("s_other") + s_rare - F.col("n_other") * F.lit(math.log10(n_other + v_other + 1))).alias("score"),
    )


def averaged(texts: DataFrame, model: Model, rate: float) -> Model:
    """The model after each task's training on all its texts, averaged by the tasks' tokens."""
    spark = texts.sparkSession
    start = spark.sparkContext.broadcast(model)

    def fit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        lm, part = start.value, TaskContext.get().partitionId() % PARTS
        lm = Model(lm.shape, {k: v.copy() for k, v in lm.p.items()}, lm.bounds)
        held, size, n, kept = [], 0, 0, {}
        for pdf in batches:
            for ids in pdf["ids"]:
                held.append(np.frombuffer(ids, "<u2").astype(np.int64))
                size += len(held[-1])
                if size > TRAINED:
                    lm.train(held, 1, lanes=LANES, rate=rate, kept=kept)
                    n += size
                    held, size = [], 0
        lm.train(held, 1, lanes=max(4, min(LANES, size // 2048)), rate=rate, kept=kept)
        n += size
        if n:
            flat = np.concatenate([v.ravel() for v in lm.p.values()])
            cut = [flat[i : i + SLICE].tobytes() for i in range(0, len(flat), SLICE)]
            yield pd.DataFrame({"slice": range(len(cut)), "part": part, "n": n, "data": cut})

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """The weighted mean of each slice's rows here, with the sum of their weights."""
        sums: dict[int, list] = {}
        for pdf in batches:
            for i, n, data in pdf[["slice", "n", "data"]].itertuples(index=False):
                s = sums.setdefault(i, [0, 0.0])
                s[0] += n
                s[1] = s[1] + n * np.frombuffer(data, np.float32).astype(np.float64)
        if sums:
            yield pd.DataFrame({"slice": list(sums), "n": [n for n, _ in sums.values()], "data": [(x / n).astype(np.float32).tobytes() for n, x in sums.values()]})

    # Summed in two steps: no task gathers a slice of all tasks' parameters.
    trained = map_pandas(texts, fit, "slice int, part int, n long, data binary").repartition("slice", "part")
    partial = map_pandas(trained, add, "slice int, n long, data binary").repartition("slice")
    slices = sorted(map_pandas(partial, add, "slice int, n long, data binary").collect())
    flat = np.frombuffer(b"".join(bytes(r["data"]) for r in slices), np.float32)
    start.unpersist()
    if not len(flat):
        return model
    ends = np.cumsum([v.size for v in model.p.values()])
    return Model(model.shape, {k: x.reshape(v.shape).copy() for (k, v), x in zip(model.p.items(), np.split(flat, ends[:-1]))}, model.bounds)

