"""Suffix-array dedup: every byte covered by a 400-byte string that starts anywhere else is removed.

Only equality of suffixes to a depth of 400 bytes matters, so suffixes are ordered by a radix sort,
most significant digit first, that stops at that depth and drops a suffix as soon as it is alone.

First digit, distributed. A start's digit is the least hash among the 128-byte grams inside its
400-byte window: a function of the window, so equal windows have equal digits. Along a text the
digit changes only every hundred bytes or so; a *run* of starts with one digit travels as one row.
Digits that occur at a single place in the whole corpus are dropped by a count over all texts
(hashes and text digests only), and only the runs that remain ship their bytes.

Further digits, in tasks. Rows with one first digit meet; their starts are refined by four digits
of 100 bytes each, 64-bit hashes read from running sums, and whatever is alone after a digit is
dropped. The groups left after the last digit are the repeated windows. Digits are hashes, so the
sort brings equal suffixes together and says nothing of the order of different ones.

Skew and memory: texts are known by digest, and one body of each digest is sorted, however many
copies it has; a run is cut at RUN starts; a first digit whose runs have more than GROUP_BYTES is
split by salt, and its windows meet again in a second level by buckets of their hash, where each
task tells each window once, packed. A worker sorts BLOCK bytes at once, a group at most beyond that. Texts with
very many copies go whole without a join.

Defined results: null text is empty; a text under 400 bytes loses nothing; a very long text is
hashed in chunks, by starts, without losing any; ids may be null or repeated (a repeated row is a
copy, so its whole text goes when it has 400 bytes); an empty table gives an empty result; other
columns, of whatever name, are not read. 64-bit hashes of 128 and 4 x 100 bytes stand for the bytes
themselves.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._common import SPANS, Scratch, hot_bound, join_by_key, map_pandas, small_batches, tasks

WINDOW, GRAM, DIGIT = 400, 128, 100
#: Bytes that are hashed at once; longer texts are cut with an overlap, by starts.
CHUNK = 1 << 20
#: Starts in one row, bytes of one first digit that meet in one group (more are split by salt), bytes
#: sorted at once. A worker holds about 80 bytes for each byte that it sorts.
RUN, GROUP_BYTES, BLOCK = 1 << 15, 1 << 20, 1 << 19
#: A window that another task may have too: its hash, its text, its start.
OPEN = np.dtype([("wh", "<u8"), ("digest", "S16"), ("s", "<i8")])
#: Texts with more copies than one in so many rows go whole without a join: at most so many texts.
HEAVY_SHARE = 400


@lru_cache(maxsize=1)
def _constants() -> tuple[np.ndarray, np.uint64, np.uint64]:
    base = 0x9E3779B97F4A7C15 | 1
    return np.random.default_rng(20).integers(1, 1 << 63, 256, dtype=np.uint64), np.uint64(base), np.uint64(pow(base, -1, 1 << 64))


_powers: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Of the base and its inverse; what is kept follows the longest stretch hashed at once, a few chunks."""
    if len(_powers.get("up", ())) < n:
        _, base, inverse = _constants()
        for name, b in (("up", base), ("down", inverse)):
            a = np.full(n, b, dtype=np.uint64)
            a[0] = 1
            _powers[name] = np.cumprod(a)
    return _powers["up"][:n], _powers["down"][:n]


def running(data: np.ndarray) -> np.ndarray:
    """Sums from which the hash of any stretch can be read."""
    up, _ = powers(len(data) + 1)
    out = np.zeros(len(data) + 1, dtype=np.uint64)
    terms = _constants()[0][data]
    terms *= up[: len(data)]
    np.cumsum(terms, out=out[1:])
    return out


def mixed(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(32))
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(29)
    return h


def sliding(v: np.ndarray, w: int, f: np.ufunc) -> np.ndarray:
    """f over each w consecutive values."""
    fill = np.iinfo(np.uint64).max if f is np.minimum else 0
    m = len(v)
    a = np.full(-(-m // w) * w, fill, dtype=np.uint64)
    a[:m] = v
    blocks = a.reshape(-1, w)
    left = f.accumulate(blocks, axis=1).ravel()
    right = f.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return f(right[: m - w + 1], left[w - 1 : m])


def segments(texts: list[bytes]) -> Iterator[tuple[bytes, np.ndarray]]:
    """Chunks of texts of at least WINDOW bytes; with each (text number, offset in it, place in the chunk, length)."""
    parts, rows, size = [], [], 0
    for i, t in enumerate(texts):
        for at in range(0, max(0, len(t) - WINDOW + 1), CHUNK):
            part = t[at : at + CHUNK + WINDOW - 1]
            parts.append(part)
            rows.append((i, at, size, len(part)))
            size += len(part)
            if size >= CHUNK:
                yield b"".join(parts), np.array(rows, dtype=np.int64)
                parts, rows, size = [], [], 0
    if parts:
        yield b"".join(parts), np.array(rows, dtype=np.int64)


def first_digits(chunk: bytes, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each place: its gram's hash; the first digit of the start there, 0 where no window starts."""
    data = np.frombuffer(chunk, dtype=np.uint8)
    sums = running(data)
    _, down = powers(len(data) + 1)
    grams = mixed((sums[GRAM:] - sums[:-GRAM]) * down[: len(data) - GRAM + 1]) | np.uint64(1)
    least = sliding(grams, WINDOW - GRAM + 1, np.minimum)
    edge = np.zeros(len(least) + 1, dtype=np.int8)
    edge[rows[:, 2]] += 1
    edge[rows[:, 2] + rows[:, 3] - WINDOW + 1] -= 1
    return grams, np.where(np.cumsum(edge[:-1]) > 0, least, np.uint64(0))


def digest_of(text: bytes) -> bytes:
    return hashlib.sha256(text).digest()[:16]


def digest_col(text: Column) -> Column:
    return F.unhex(F.substring(F.sha2(text.cast("binary"), 256), 1, 32))


def runs_of(own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begin and end of each run of starts with one digit, none longer than RUN."""
    first = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
    size = np.diff(np.append(first, len(own)))
    if (size > RUN).any():
        pieces = -(-size // RUN)
        first = np.repeat(first, pieces) + RUN * (np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces))
    return first, np.append(first[1:], len(own))


def _anchors(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(digit, text digest, place of the chunk, grams with it, bytes of its runs): each text of the task once."""
    seen: set[bytes] = set()
    for pdf in batches:
        texts, keys = [], []
        for t in pdf["text"]:
            data = t.encode("utf-8") if t else b""
            if len(data) >= WINDOW and (key := digest_of(data)) not in seen:
                seen.add(key)
                texts.append(data)
                keys.append(key)
        for chunk, rows in segments(texts):
            grams, digits = first_digits(chunk, rows)
            w = WINDOW - GRAM + 1
            padded = np.zeros(len(grams) + w - 1, dtype=np.uint64)
            padded[w - 1 : w - 1 + len(digits)] = digits
            at = np.flatnonzero(grams == sliding(padded, w, np.maximum))
            first, last = runs_of(digits)
            live = digits[first] > 0
            first, last = first[live], last[live]
            # One row for each chunk's text and digit: its places, and the bytes of its runs.
            place = np.concatenate([at, first])
            h = np.concatenate([grams[at], digits[first]])
            n = np.repeat([1, 0], [len(at), len(first)])
            size = np.concatenate([np.zeros(len(at), np.int64), last - first + WINDOW - 1])
            seg = np.searchsorted(rows[:, 2], place, side="right") - 1
            order = np.lexsort((h, seg))
            h, seg = h[order], seg[order]
            edge = np.flatnonzero(np.append(True, (seg[1:] != seg[:-1]) | (h[1:] != h[:-1])))
            part = rows[seg[edge]]
            yield pd.DataFrame(
                {"h": h[edge].view(np.int64), "digest": [keys[i] for i in part[:, 0]], "at": part[:, 1], "n": np.add.reduceat(n[order], edge).astype(np.int64), "size": np.add.reduceat(size[order], edge)}
            )


def _runs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The runs of each text whose digits occur elsewhere: (digit, its salts, digest, first start, bytes)."""
    for pdf in batches:
        texts = [t.encode("utf-8") for t in pdf["text"]]
        wanted = [dict(zip(h.tolist(), n.tolist())) for h, n in zip(pdf["hs"], pdf["salts"])]
        keys = list(pdf["digest"])
        for chunk, rows in segments(texts):
            _, digits = first_digits(chunk, rows)
            out = []
            for i, at, place, length in rows:
                own = digits[place : place + length - WINDOW + 1]
                first, last = runs_of(own)
                for a, b, h in zip(first.tolist(), last.tolist(), own[first].view(np.int64).tolist()):
                    if salts := wanted[i].get(h):
                        out.append((h, salts, keys[i], int(at) + a, chunk[place + a : place + b + WINDOW - 1]))
            if out:
                yield pd.DataFrame(out, columns=["h", "salts", "digest", "start", "data"])


def repeated(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Radix passes: whether each start's window occurs again among the starts; its hash."""
    sums = running(data)
    _, down = powers(len(data) + 1)
    alive = np.arange(len(starts), dtype=np.int32)
    final = np.zeros(len(starts), dtype=np.uint64)
    for d in range(0, WINDOW, DIGIT):
        at = starts + d
        digit = sums[at + DIGIT]
        digit -= sums[at]
        digit *= down[at]
        del at
        final *= np.uint64(0x2545F4914F6CDD1D)
        final += mixed(digit)
        del digit
        final = mixed(final)
        keys = final[alive]
        order = np.argsort(keys)
        keys = keys[order]
        same = keys[1:] == keys[:-1]
        del keys
        again = np.zeros(len(alive), dtype=bool)
        again[1:] |= same
        again[:-1] |= same
        alive = np.sort(alive[order[again]])
    flag = np.zeros(len(starts), dtype=bool)
    flag[alive] = True
    return flag, final


def _sorted_blocks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Blocks of whole groups (rows come sorted by digit and salt)."""
    held: list[pd.DataFrame] = []
    size = 0
    for pdf in batches:
        if not len(pdf):
            continue
        held.append(pdf)
        size += int(pdf["data"].str.len().sum())
        if size >= BLOCK:
            block = pd.concat(held, ignore_index=True)
            h, salt = block["h"].to_numpy(), block["salt"].to_numpy()
            cut = int(np.flatnonzero((h != h[-1]) | (salt != salt[-1])).max(initial=-1)) + 1
            if cut:
                yield block[:cut]
            held = [block[cut:]]
            size = int(held[0]["data"].str.len().sum())
    if held and len(last := pd.concat(held, ignore_index=True)):
        yield last


def _stretches(digests: np.ndarray, s: np.ndarray, e: np.ndarray) -> pd.DataFrame:
    n = len(s)
    return pd.DataFrame({"h": np.zeros(n, np.int64), "bucket": np.zeros(n, np.int64), "open": [None] * n, "digest": digests, "s": s, "e": e})


def _windows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Stretches of starts whose window is repeated (open null), and of salted groups what the others must
    know: each window that is alone here, and one of each that is not, packed by buckets of their hash."""
    for block in _sorted_blocks(batches):
        lens = block["data"].str.len().to_numpy().astype(np.int64)
        data = np.frombuffer(b"".join(block["data"]), dtype=np.uint8)
        counts = lens - WINDOW + 1
        row = np.repeat(np.arange(len(block), dtype=np.int32), counts)
        # A row's starts are its bytes but for the last WINDOW - 1.
        places = np.arange(len(row), dtype=np.int32)
        places += row * np.int32(WINDOW - 1)
        flag, hashes = repeated(data, places)
        # From a place in the block to the start in its document.
        shift = block["start"].to_numpy() - (np.cumsum(lens) - lens)
        doc_start = lambda i: places[i] + shift[row[i]]
        on = np.flatnonzero(flag)
        digests = block["digest"].to_numpy()
        if len(on):
            first = np.flatnonzero(np.append(True, (np.diff(on) != 1) | (np.diff(row[on]) != 0)))
            last = np.append(first[1:], len(on)) - 1
            yield _stretches(digests[row[on[first]]], doc_start(on[first]), doc_start(on[last]) + WINDOW)
        salts, group = block["salts"].to_numpy(), block["h"].to_numpy()
        for h in np.unique(group[salts > 1]):
            n = int(salts[group == h][0])
            here = np.flatnonzero((group == h)[row])
            _, one = np.unique(hashes[here], return_index=True)
            here = here[np.union1d(one, np.flatnonzero(~flag[here]))]
            told = np.empty(len(here), dtype=OPEN)
            told["wh"], told["digest"], told["s"] = hashes[here], digests[row[here]].astype("S16"), doc_start(here)
            bucket = (told["wh"] >> np.uint64(7)) % np.uint64(n)
            order = np.argsort(bucket, kind="stable")
            edge = np.searchsorted(bucket[order], np.arange(n + 1, dtype=np.uint64))
            parts = [(int(h), k, told[order[a:b]].tobytes(), None, None, None) for k, (a, b) in enumerate(zip(edge, edge[1:])) if b > a]
            out = pd.DataFrame(parts, columns=["h", "bucket", "open", "digest", "s", "e"])
            yield out.astype({"s": "Int64", "e": "Int64"})


def _meet(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Windows of a bucket that several salts have. Rows come sorted by digit and bucket."""

    def made(parts: list[bytes]) -> pd.DataFrame:
        x = np.frombuffer(b"".join(parts), dtype=OPEN)
        x = x[np.argsort(x["wh"], kind="stable")]
        same = x["wh"][1:] == x["wh"][:-1]
        x = x[np.append(same, False) | np.append(False, same)]
        digests = np.array([d.ljust(16, b"\0") for d in x["digest"].tolist()], dtype=object)
        return pd.DataFrame({"digest": digests, "s": x["s"], "e": x["s"] + WINDOW})

    now, held = None, []
    for pdf in batches:
        for h, bucket, part in pdf[["h", "bucket", "open"]].itertuples(index=False):
            if (h, bucket) != now and held:
                yield made(held)
                held = []
            now = (h, bucket)
            held.append(part)
    if held:
        yield made(held)


def merged(starts, ends) -> list[tuple[int, int]]:
    """Maximal stretches; those that touch are one."""
    out: list[list[int]] = []
    for s, e in sorted(zip(starts, ends)):
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return [(s, e) for s, e in out]


def removal(df: DataFrame, intervals: DataFrame, id_col: str, with_bytes: bool) -> DataFrame:
    """Joins (digest, starts, ends) to the documents and takes the bytes out. df: id, text, digest."""
    schema = T.StructType([T.StructField(id_col, df.schema[id_col].dataType), *[T.StructField(c, T.LongType()) for c in ("n_bytes", "n_removed", "n_spans")], T.StructField("kept_sha256", T.StringType())])
    if with_bytes:
        schema = schema.add("spans", SPANS).add("kept", T.BinaryType())

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for text, starts, ends in zip(pdf["text"], pdf["starts"], pdf["ends"]):
                data = text.encode("utf-8") if text else b""
                cut = merged(starts, ends) if starts is not None else []
                at, left = 0, []
                for s, e in cut:
                    left.append(data[at:s])
                    at = e
                kept = b"".join([*left, data[at:]])
                row = (len(data), len(data) - len(kept), len(cut), hashlib.sha256(kept).hexdigest())
                rows.append((*row, [{"start": s, "end": e} for s, e in cut], kept) if with_bytes else row)
            out = pd.DataFrame(rows, columns=schema.names[1:])
            out.insert(0, id_col, pdf[id_col])
            yield out

    joined = df.join(intervals, "digest", "left").select(id_col, "text", "starts", "ends")
    return map_pandas(joined, run, schema)


def gather(stretches: DataFrame) -> DataFrame:
    """(digest, s, e) -> (digest, starts, ends)."""
    return stretches.groupBy("digest").agg(F.collect_list(F.struct("s", "e")).alias("x")).select("digest", F.col("x.s").alias("starts"), F.col("x.e").alias("ends"))


def suffix_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_bytes: bool = False) -> DataFrame:
    """One row per input row: id, n_bytes, n_removed, n_spans, kept_sha256 (and spans, kept)."""
    spark = df.sparkSession
    small_batches(spark, 500)
    scratch = Scratch(spark)
    docs = df.select(F.col(id_col), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    docs = docs.withColumn("digest", digest_col(F.col("text")))
    long_enough = F.octet_length("text") >= WINDOW

    copies = scratch.table(
        docs.groupBy("digest", F.octet_length("text").alias("len")).agg(F.count(F.lit(1)).alias("copies")).where((F.col("copies") > 1) & (F.col("len") >= WINDOW)), "copies"
    )
    heavy_rows = copies.where(F.col("copies") >= max(1000, df.count() // HEAVY_SHARE)).select("digest").collect()  # at most HEAVY_SHARE texts
    heavy = F.col("digest").isin([bytes(r[0]) for r in heavy_rows]) if heavy_rows else F.lit(False)

    anchors = scratch.table(map_pandas(docs.select("text"), _anchors, "h long, digest binary, at long, n long, size long"), "digits")
    # A digit counts if it stands at two places of one text or in two texts: copies alone make none.
    place = F.xxhash64("digest", "at")
    counts = anchors.groupBy("h").agg(F.min(place).alias("a"), F.max(place).alias("b"), F.max("n").alias("n"), F.sum("size").alias("size"), F.count(F.lit(1)).alias("rows")).where("a <> b or n > 1")
    counts = scratch.table(counts.select("h", F.ceil(F.col("size") / GROUP_BYTES).cast("int").alias("salts"), "rows"), "counts")
    met = join_by_key(anchors.select("h", "digest"), counts.drop("rows"), counts.where(F.col("rows") >= hot_bound(anchors.count())).drop("rows"), ["h"])
    wanted = met.groupBy("digest").agg(F.collect_set(F.struct("h", "salts")).alias("x")).select("digest", F.col("x.h").alias("hs"), F.col("x.salts").alias("salts"))
    bodies = docs.where(long_enough).groupBy("digest").agg(F.first("text").alias("text"))
    runs = map_pandas(bodies.join(wanted, "digest"), _runs, "h long, salts int, digest binary, start long, data binary")
    runs = runs.withColumn("salt", F.pmod(F.xxhash64("digest", "start"), F.col("salts")))
    runs = runs.repartition(tasks(spark), "h", "salt").sortWithinPartitions("h", "salt", "digest", "start")
    found = scratch.table(map_pandas(runs, _windows, "h long, bucket long, open binary, digest binary, s long, e long"), "windows")
    open_ = found.where(F.col("open").isNotNull()).select("h", "bucket", "open")
    across = map_pandas(open_.repartition(tasks(spark), "h", "bucket").sortWithinPartitions("h", "bucket"), _meet, "digest binary, s long, e long")
    whole = copies.select("digest", F.lit(0).cast("long").alias("s"), F.col("len").cast("long").alias("e"))
    stretches = found.where(F.col("open").isNull()).select("digest", "s", "e").unionByName(across).join(copies.select("digest"), "digest", "left_anti").unionByName(whole)
    intervals = gather(stretches)
    if not heavy_rows:
        return removal(docs, intervals, id_col, with_bytes)
    # Texts with very many copies go whole; they need no join.
    light = removal(docs.where(~heavy), intervals, id_col, with_bytes)
    gone = docs.where(heavy).select(
        id_col, F.octet_length("text").cast("long").alias("n_bytes"), F.octet_length("text").cast("long").alias("n_removed"), F.lit(1).cast("long").alias("n_spans"), F.sha2(F.lit("").cast("binary"), 256).alias("kept_sha256"),
        *([F.array(F.struct(F.lit(0).alias("start"), F.octet_length("text").alias("end"))).alias("spans"), F.lit("").cast("binary").alias("kept")] if with_bytes else []),
    )
    return light.unionByName(gone)
