"""Substring dedup by content-defined chunks.

A gear rolling hash over the last 32 bytes cuts every text where its top bits are zero, so cuts
follow content and fall in step again soon after an insertion. Chunks have 32 to 256 bytes, 64 on
average. Equal chunks are found by a 128-bit digest; the occurrence with the smallest (id, offset)
stays and the others go, if they lie in a stretch of at least 64 bytes of such chunks: a lone short
chunk is chance, not copying.

Each chunk travels as 48 bytes. Digests are counted with partial aggregation, so a digest that
every document has costs a row per task; the occurrences then meet the repeated digests in a join on
the digest. Digests with more than one in HOT_SHARE of all occurrences are few by that bound and are
broadcast for it, so no task gathers a frequent digest's occurrences.

Defined results: null text is empty; a null id is an id of its own and comes before all others;
rows that repeat id and text share their fate, as do the places they keep; texts are never cut,
however long; an empty table gives an empty result; other columns, of whatever name, are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._common import SPANS, Scratch, hot_bound, join_by_key, map_pandas, small_batches

LEAST, MOST = 32, 256
#: A cut where so many top bits of the gear hash are zero: every 2^5 bytes.
BITS = 5
STRETCH = 64
REACH = 32  # bytes that the 32-bit gear hash sees
NO_ID = -(1 << 63)


@lru_cache(maxsize=1)
def gear() -> np.ndarray:
    return np.random.default_rng(32).integers(0, 1 << 32, 256, dtype=np.uint32)


def rolling(data: np.ndarray) -> np.ndarray:
    """At each byte the sum of gear[b] << age over the last 32 bytes, by doubling the reach."""
    h = gear()[data]
    reach = 1
    while reach < REACH:
        more = h.copy()
        more[reach:] += h[:-reach] << np.uint32(reach)
        h, reach = more, reach * 2
    return h


def cut_points(h: np.ndarray) -> list[int]:
    """Ends of the chunks of one text."""
    n, last, out = len(h), 0, []
    for c in (np.flatnonzero(h >> np.uint32(32 - BITS) == 0) + 1).tolist():
        while c - last > MOST:
            last += MOST
            out.append(last)
        if c - last >= LEAST:
            out.append(c)
            last = c
    while n - last > MOST:
        last += MOST
        out.append(last)
    if last < n:
        out.append(n)
    return out


def chunks_of(data: bytes) -> list[tuple[int, int]]:
    """(offset, length) of each chunk."""
    ends = cut_points(rolling(np.frombuffer(data, dtype=np.uint8)))
    return [(a, b - a) for a, b in zip([0, *ends], ends)]


def _chunks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        digests, counts, places = [], [], []
        for text in pdf["text"]:
            data = text.encode("utf-8")
            ends = cut_points(rolling(np.frombuffer(data, dtype=np.uint8)))
            at = 0
            for end in ends:
                digests.append(hashlib.blake2b(data[at:end], digest_size=16).digest())
                places.append(at << 9 | (end - at))
                at = end
            counts.append(len(ends))
        both = np.frombuffer(b"".join(digests), dtype=np.int64).reshape(-1, 2)
        yield pd.DataFrame({"d1": both[:, 0], "d2": both[:, 1], "id": np.repeat(pdf["id"].to_numpy(), counts), "th": np.repeat(pdf["th"].to_numpy(), counts), "place": np.array(places, dtype=np.int64)})


def stretches(places: np.ndarray) -> list[tuple[int, int]]:
    """Chunks end to end make a stretch; those of STRETCH bytes or more count."""
    out: list[list[int]] = []
    for p in np.sort(places).tolist():
        s, e = p >> 9, (p >> 9) + (p & 511)
        if out and s == out[-1][1]:
            out[-1][1] = e
        else:
            out.append([s, e])
    return [(s, e) for s, e in out if e - s >= STRETCH]


def chunk_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_bytes: bool = False) -> DataFrame:
    """One row per input row: id, n_bytes, n_chunks, n_shared (bytes that occur elsewhere), n_removed
    (those not kept here), n_spans, kept_sha256 (and spans, kept)."""
    spark = df.sparkSession
    small_batches(spark, 500)
    scratch = Scratch(spark)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    docs = df.select(F.col(id_col), text.alias("text"), F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("id"), F.xxhash64(text).alias("th"))
    found = scratch.table(map_pandas(docs.select("text", "id", "th"), _chunks, "d1 long, d2 long, id long, th long, place long"), "chunks")
    # The first occurrence by id and place; texts that share an id and a chunk's place both keep it.
    firsts = found.groupBy("d1", "d2").agg(F.min(F.struct("id", "place")).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    firsts = scratch.table(firsts.select("d1", "d2", F.col("first.id").alias("id1"), F.col("first.place").alias("place1"), "n"), "firsts", large=True)
    again = join_by_key(found, firsts, firsts.where(F.col("n") >= hot_bound(found.count())), ["d1", "d2"])
    stays = (F.col("id") == F.col("id1")) & (F.col("place") == F.col("place1"))
    by_doc = again.groupBy("id", "th").agg(F.collect_set("place").alias("shared"), F.collect_set(F.when(~stays, F.col("place"))).alias("later"))

    longs = ("n_bytes", "n_chunks", "n_shared", "n_removed", "n_spans")
    schema = T.StructType([T.StructField(id_col, df.schema[id_col].dataType), *[T.StructField(c, T.LongType()) for c in longs], T.StructField("kept_sha256", T.StringType())])
    if with_bytes:
        schema = schema.add("spans", SPANS).add("kept", T.BinaryType())

    def remove(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for body, shared, later in zip(pdf["text"], pdf["shared"], pdf["later"]):
                data = body.encode("utf-8")
                common = stretches(shared) if shared is not None else []
                cut = stretches(later) if later is not None else []
                at, left = 0, []
                for s, e in cut:
                    left.append(data[at:s])
                    at = e
                kept = b"".join([*left, data[at:]])
                n_chunks = len(cut_points(rolling(np.frombuffer(data, dtype=np.uint8)))) if data else 0
                row = (len(data), n_chunks, sum(e - s for s, e in common), len(data) - len(kept), len(cut), hashlib.sha256(kept).hexdigest())
                rows.append((*row, [{"start": s, "end": e} for s, e in cut], kept) if with_bytes else row)
            out = pd.DataFrame(rows, columns=schema.names[1:])
            out.insert(0, id_col, pdf[id_col])
            yield out

    joined = docs.join(by_doc, ["id", "th"], "left").select(F.col(id_col), "text", "shared", "later")
    return map_pandas(joined, remove, schema)
