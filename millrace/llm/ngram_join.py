"""N-gram Jaccard join by vertical partitioning, exact, at a similarity of 0.8.

A text's set is its distinct word 5-grams, as 48-bit hashes. The global order of grams is cut into
fragments; every text sends each fragment its own stretch of its sorted set, packed by batch, and a
fragment counts the texts of each of its grams. Summed over fragments, a text's repeated grams
decide whether it can have a partner at all: fewer than 0.8 of its set, and it has none. Grams of HOT and
more texts stand last in the order, alike, and pass through a fragment without being held. Almost all
texts end here. The rest go round once more among themselves, which gives exact frequencies.

Candidates come from prefixes: in the order (frequency, gram), two sets with the similarity share
one of the first n - ceil(0.8 n) + 1 grams, and grams of frequency 1, which lead the order, need no
look-up. Pairs are verified by vertical fragments again: overlaps are counted for each fragment of
a pair separately and summed per pair.

Large groups cost no square. Copies are one text (by digest). Each text is first compared with a
few leaders of its fullest buckets; what is linked makes components, and then only pairs of texts
in different components are compared: in a bucket, the texts outside its commonest component with
all others. A pair inside one component needs no link of its own, so nothing is lost.

Defined results: null, empty and wordless texts have no set, link with nothing and are their own
component; texts of under five words have one gram, the whole sequence; rows that repeat an id are
one document if their texts agree and linked through the id otherwise; a null id gets the component
of its text's other ids, if any; a very long text has its whole set, hashed in lots; an empty table
gives an empty result; other columns, of whatever name, are not read.
A batch is named by its task and position, so the input must be a table scan or another input whose
partitions come out alike when they are read again (a written table, in the pipeline).
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import SPACE_BYTES, Scratch, hot_bound, join_by_key, map_pandas, small_batches, tasks
from .components import components
from .suffix_dedup import mixed, powers, running

NO_ID = -(1 << 63)
#: Similarity as a fraction: 100 * overlap >= 80 * union.
NUM, DEN = 80, 100
#: Fragments in which the overlaps of a pair are counted.
PAIR_FRAGMENTS = 4
#: Grams in a fragment, about.
FRAGMENT = 4_000_000
#: Entries after which a task looks for hot grams, what makes one, and the count that stands for all of them.
HELD, HOT, MANY = 8_000_000, 1 << 16, (1 << 32) - 1
#: Leaders that a text is compared with before all else.
LEADERS = 3
ENTRY = "frag int, uid long, data binary, dfs binary, meta binary"

#: Bytes of text that are hashed at once.
LOT = 2 << 20

_cut = re.compile(rb"[\x20\x09-\x0d]")
_space = np.zeros(256, dtype=bool)
_space[list(SPACE_BYTES)] = True


def needed(n):
    """The least overlap with any partner: ceil(0.8 n)."""
    return -(-n * NUM // DEN)


def pieces(texts: list[bytes], k: int) -> Iterator[tuple[list[bytes], list[int]]]:
    """Texts in lots of about LOT bytes, each with its number; a longer text is cut after a space, and a
    further piece begins k - 1 words early, so that every gram is whole in one piece."""
    lot, numbers, size = [], [], 0
    for i, t in enumerate(texts):
        while True:
            cut = _cut.search(t, LOT) if len(t) > LOT else None
            part, rest = (t, b"") if cut is None else (t[: cut.end()], t[cut.end() :])
            lot.append(part)
            numbers.append(i)
            size += len(part)
            if size > LOT:
                yield lot, numbers
                lot, numbers, size = [], [], 0
            early = part.rsplit(None, k - 1)[1:] if rest.strip(SPACE_BYTES) else []
            if not rest.strip(SPACE_BYTES):
                break
            t = b" ".join([*early, rest])
    if lot:
        yield lot, numbers


def gram_entries(texts: list[bytes], k: int = 5) -> np.ndarray:
    """gram << 16 | text number, sorted, each once."""
    lots = []
    for lot, numbers in pieces(texts, k):
        entries = _lot_entries(lot, k)
        own = np.array(numbers, dtype=np.uint64)[(entries & np.uint64(0xFFFF)).astype(np.int64)]
        lots.append((entries & np.uint64(0xFFFFFFFFFFFF0000)) | own)
    if len(lots) < 2:
        return lots[0] if lots else np.zeros(0, dtype=np.uint64)
    entries = np.sort(np.concatenate(lots))
    return entries[np.append(True, entries[1:] != entries[:-1])] if len(entries) else entries


def _lot_entries(texts: list[bytes], k: int) -> np.ndarray:
    """The same of texts that are hashed together."""
    data = np.frombuffer(b"\n".join([b"", *texts, b""]).lower(), dtype=np.uint8)
    inside = ~_space[data]
    step = np.diff(inside.astype(np.int8))
    begin, end = np.flatnonzero(step == 1) + 1, np.flatnonzero(step == -1) + 1
    sums = running(data)
    _, down = powers(len(data) + 1)
    word = mixed((sums[end] - sums[begin]) * down[begin] + (end - begin).astype(np.uint64))
    offsets = np.cumsum([1, *[len(t) + 1 for t in texts]])
    doc = np.searchsorted(offsets, begin, side="right") - 1
    factors = np.random.default_rng(5).integers(1, 1 << 63, k + 1, dtype=np.uint64) | np.uint64(1)
    parts, owners = [], []
    if len(word) >= k:
        full = sum((word[j : len(word) - k + 1 + j] * factors[j] for j in range(1, k)), word[: len(word) - k + 1] * factors[0])
        same = doc[: len(word) - k + 1] == doc[k - 1 :]
        parts.append(full[same])
        owners.append(doc[: len(word) - k + 1][same])
    counts = np.bincount(doc, minlength=len(texts))
    short = np.flatnonzero((counts > 0) & (counts < k))
    first = np.cumsum(counts) - counts
    for d in short:
        w = word[first[d] : first[d] + counts[d]]
        parts.append(np.sum(w * factors[: len(w)], keepdims=True) + factors[k : k + 1] * np.uint64(len(w)))
        owners.append(np.array([d]))
    if not parts:
        return np.zeros(0, dtype=np.uint64)
    h = mixed(np.concatenate(parts))
    entries = np.sort((h & np.uint64(0xFFFFFFFFFFFF0000)) | np.concatenate(owners).astype(np.uint64))
    return entries[np.append(True, entries[1:] != entries[:-1])] if len(entries) else entries


def _emit(uid: int, entries: np.ndarray, fragments: int, meta: bytes) -> pd.DataFrame:
    """A batch's stretches by fragment, and the row that says what its texts are."""
    edges = np.array([(i << 48) // fragments << 16 for i in range(1, fragments)], dtype=np.uint64)
    cut = np.concatenate([[0], np.searchsorted(entries, edges), [len(entries)]])
    full = np.flatnonzero(np.diff(cut))
    rows = [(int(f), uid, entries[cut[f] : cut[f + 1]].tobytes(), None, None) for f in full]
    rows.append((uid % fragments, uid, None, None, meta))
    return pd.DataFrame(rows, columns=["frag", "uid", "data", "dfs", "meta"])


def _uid(n: int) -> int:
    from pyspark import TaskContext

    return TaskContext.get().partitionId() << 32 | n


def _among(h: np.ndarray, few: np.ndarray) -> np.ndarray:
    """Which of h are in the sorted array."""
    if not len(few):
        return np.zeros(len(h), dtype=bool)
    return few[np.minimum(np.searchsorted(few, h), len(few) - 1)] == h


def _count_fragment(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """One fragment: how many texts have each gram. Entries of lone grams go, the others get the count; from
    HOT on all get MANY instead, and once a gram is known to be so frequent its entries pass straight
    through, so a task holds no more than HOT entries of a gram."""
    hot = np.zeros(0, dtype=np.uint64)
    rows: list[tuple[int, int]] = []  # fragment and batch of each part
    parts: list[np.ndarray] = []
    held, limit = 0, HELD

    def frame(out: list) -> pd.DataFrame:
        return pd.DataFrame(out, columns=["frag", "uid", "data", "dfs", "meta"])

    def counted(entries: np.ndarray) -> np.ndarray:
        h = entries >> np.uint64(16)
        order = np.argsort(h, kind="stable")
        h = h[order]
        first = np.flatnonzero(np.append(True, h[1:] != h[:-1]))
        n = np.diff(np.append(first, len(h))).astype(np.uint32)
        df = np.empty(len(entries), dtype=np.uint32)
        df[order] = np.repeat(np.where(n >= HOT, np.uint32(MANY), n), n)
        return df

    def told(least: int) -> Iterator[pd.DataFrame]:
        """Passes on entries of counts from `least` on and keeps the others."""
        nonlocal hot, held
        entries = np.concatenate(parts) if parts else np.zeros(0, dtype=np.uint64)
        df = counted(entries)
        go = df >= least
        hot = np.union1d(hot, np.unique(entries[df == MANY] >> np.uint64(16)))
        at, out = np.cumsum([0, *map(len, parts)]), []
        for i, (f, u) in enumerate(rows):
            here = slice(at[i], at[i + 1])
            e, d, g = entries[here], df[here], go[here]
            if g.any():
                out.append((f, u, e[g].tobytes(), d[g].tobytes(), None))
            parts[i] = e[~g].copy()
            if len(out) >= 200:
                yield frame(out)
                out = []
        if out:
            yield frame(out)
        held = sum(map(len, parts))

    for pdf in batches:
        meta = pdf["meta"].notna()
        if meta.any():
            yield pdf[meta]
        through = []
        for f, u, data in pdf.loc[~meta, ["frag", "uid", "data"]].itertuples(index=False):
            e = np.frombuffer(data, dtype=np.uint64)
            often = _among(e >> np.uint64(16), hot)
            if often.any():
                through.append((f, u, e[often].tobytes(), np.full(int(often.sum()), MANY, dtype=np.uint32).tobytes(), None))
                e = e[~often]
            if len(e):
                rows.append((f, u))
                parts.append(e)
                held += len(e)
        if through:
            yield frame(through)
        if held > limit:
            yield from told(MANY)
            limit = max(HELD, 2 * held)
    yield from told(2)


def _batches_of(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[bytes, np.ndarray, np.ndarray]]:
    """Per batch of texts: meta, entries, counts, sorted by (text, gram). Rows come sorted by uid."""

    def made(rows: list) -> tuple[bytes, np.ndarray, np.ndarray]:
        meta = next(r[2] for r in rows if r[2] is not None)
        e = np.frombuffer(b"".join(r[0] for r in rows if r[0] is not None), dtype=np.uint64)
        d = np.frombuffer(b"".join(r[1] for r in rows if r[1] is not None), dtype=np.uint32)
        order = np.lexsort((e, e & np.uint64(0xFFFF)))
        return meta, e[order], d[order]

    now, rows = None, []
    for pdf in batches:
        for uid, *row in pdf[["uid", "data", "dfs", "meta"]].itertuples(index=False):
            if uid != now and rows:
                yield made(rows)
                rows = []
            now = uid
            rows.append(row)
    if rows:
        yield made(rows)


def _counted(packed: DataFrame, fragments: int, finish: Callable, schema: str) -> DataFrame:
    """Two shuffles: to fragments for counting, back to batches for what the counts mean."""
    counted = map_pandas(packed.repartitionById(fragments, F.col("frag")), _count_fragment, ENTRY)
    back = counted.repartition(tasks(packed.sparkSession), "uid").sortWithinPartitions("uid", "frag")
    return map_pandas(back, finish, schema)


def _texts(fragments: int) -> Callable:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: set[bytes] = set()
        for number, pdf in enumerate(batches):
            texts = [t.encode("utf-8") if t else b"" for t in pdf["text"]]
            keys = [hashlib.blake2b(b" ".join(t.lower().split()), digest_size=16).digest() for t in texts]
            new = []
            for key in keys:
                new.append(key not in seen)
                seen.add(key)
            entries = gram_entries(texts)
            owner = (entries & np.uint64(0xFFFF)).astype(np.int64)
            n = np.bincount(owner, minlength=len(texts)).astype(np.int64)
            meta = np.column_stack([pdf["id"].to_numpy(dtype=np.int64), np.frombuffer(b"".join(keys), dtype=np.int64).reshape(-1, 2), n, np.array(new, dtype=np.int64)])
            yield _emit(_uid(number), entries[np.array(new, dtype=bool)[owner]], fragments, meta.tobytes())

    return run


def _possible(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """One row per document; with its repeated grams if they may be enough for a partner."""
    for meta, entries, _ in _batches_of(batches):
        m = np.frombuffer(meta, dtype=np.int64).reshape(-1, 5)
        owner = (entries & np.uint64(0xFFFF)).astype(np.int64)
        got = np.bincount(owner, minlength=len(m))
        at = np.concatenate([[0], np.cumsum(got)])
        enough = (m[:, 3] > 0) & (got >= needed(m[:, 3]))
        grams = [entries[at[i] : at[i + 1]].tobytes() if enough[i] else None for i in range(len(m))]
        yield pd.DataFrame({"id": m[:, 0], "d1": m[:, 1], "d2": m[:, 2], "n": m[:, 3], "grams": grams})


def _sets(fragments: int) -> Callable:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for number, pdf in enumerate(batches):
            parts = [np.frombuffer(g, dtype=np.uint64) & np.uint64(0xFFFFFFFFFFFF0000) | np.uint64(i) for i, g in enumerate(pdf["grams"])]
            meta = np.column_stack([pdf["node"].to_numpy(), pdf["n"].to_numpy()]).astype(np.int64)
            yield _emit(_uid(number), np.sort(np.concatenate(parts)) if parts else np.zeros(0, np.uint64), fragments, meta.tobytes())

    return run


def _prefixes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Texts that still may have a partner: repeated grams by pair fragment, prefix, and the counts of the prefix."""
    for meta, entries, dfs in _batches_of(batches):
        m = np.frombuffer(meta, dtype=np.int64).reshape(-1, 2)
        got = np.bincount((entries & np.uint64(0xFFFF)).astype(np.int64), minlength=len(m))
        at = np.concatenate([[0], np.cumsum(got)])
        out = []
        for i, (node, n) in enumerate(m):
            if got[i] < needed(n):
                continue
            h, d = entries[at[i] : at[i + 1]] >> np.uint64(16), dfs[at[i] : at[i + 1]]
            by = np.lexsort((h, d))[: n - needed(n) + 1 - (n - got[i])]
            h = h.astype(np.int64)
            cut = np.searchsorted(h, [(f << 48) // PAIR_FRAGMENTS for f in range(1, PAIR_FRAGMENTS)])
            out.append((int(node), int(n), int(got[i]), [x.tolist() for x in np.split(h, cut)], h[by].tolist()))
        if out:
            yield pd.DataFrame(out, columns=["node", "n", "r", "parts", "prefix"])


def enough(overlap: Column, n1: Column, n2: Column) -> Column:
    """The similarity in whole numbers: overlap / (n1 + n2 - overlap) >= NUM / DEN."""
    return overlap * (NUM + DEN) >= (n1 + n2) * NUM


def overlaps(pairs: DataFrame, parts: DataFrame) -> DataFrame:
    """(a, b) -> with na, nb, o: the overlap in each fragment, counted separately."""
    right = pairs.join(parts.select(F.col("node").alias("b"), F.col("n").alias("nb"), "f", F.col("grams").alias("gb")), "b")
    left = parts.select(F.col("node").alias("a"), F.col("n").alias("na"), "f", F.col("grams").alias("ga"))
    both = right.join(left, ["a", "f"]).select("a", "b", "na", "nb", "f", F.size(F.array_intersect("ga", "gb")).alias("x"))
    each = [F.coalesce(F.sum(F.when(F.col("f") == i, F.col("x"))), F.lit(0)) for i in range(PAIR_FRAGMENTS)]
    return both.groupBy("a", "b", "na", "nb").agg(F.array(*each).alias("o"))


def total(parts: Column) -> Column:
    return sum((parts[i] for i in range(1, PAIR_FRAGMENTS)), parts[0])


def linked(counted: DataFrame) -> DataFrame:
    """(u, v) of the pairs whose overlaps sum to the similarity."""
    return counted.where(enough(total(F.col("o")), F.col("na"), F.col("nb"))).select(F.col("a").alias("u"), F.col("b").alias("v"))


def most_overlap() -> Column:
    """A bound of the overlap of x and y. Only repeated grams can be shared. Where both have been
    compared with the same leader, they share in each fragment at most the lesser of what each
    shares with it, and the lesser of what each has besides."""
    terms = [F.least(F.col("ox")[i], F.col("oy")[i]) + F.least(F.col("rx")[i] - F.col("ox")[i], F.col("ry")[i] - F.col("oy")[i]) for i in range(PAIR_FRAGMENTS)]
    plain = [F.least(F.col("rx")[i], F.col("ry")[i]) for i in range(PAIR_FRAGMENTS)]
    return F.when((F.col("lx") == F.col("ly")) & F.col("ox").isNotNull() & F.col("oy").isNotNull(), sum(terms[1:], terms[0])).otherwise(sum(plain[1:], plain[0]))


def links_of(sets: DataFrame, scratch: Scratch) -> DataFrame:
    """(u, v): enough verified links between texts to give every component.
    sets: node, n, r (repeated grams), parts (these by fragment), prefix."""
    parts = sets.select("node", "n", F.posexplode("parts").alias("f", "grams"))
    buckets = scratch.table(sets.select("node", "n", "r", F.explode("prefix").alias("h")), "buckets")
    # The first leader has the fewest grams of its own and so lies nearest the middle; the others are drawn.
    it = F.struct("node", "n", "r")
    drawn = [F.min_by(it, F.xxhash64("node", F.lit(i))) for i in range(1, LEADERS)]
    sizes = buckets.groupBy("h").agg(F.count(F.lit(1)).alias("c"), F.array(F.max_by(it, F.struct(F.col("r") / F.col("n"), F.col("node"))), *drawn).alias("leaders")).where("c > 1")
    sizes = scratch.table(sizes, "sizes")
    # A gram that very many texts have in their prefix is a hot key here; there are few such grams.
    hot = sizes.where(F.col("c") >= hot_bound(buckets.count()))
    met = join_by_key(buckets, sizes, hot, ["h"])
    fullest = scratch.table(met.groupBy("node", "n", "r").agg(F.max_by("leaders", F.struct("c", "h")).alias("leaders")), "leaders")
    stars = fullest.select("node", "n", "r", F.posexplode("leaders").alias("i", "x")).withColumn("l", F.col("x.node"))
    stars = stars.where((F.col("l") != F.col("node")) & ((F.col("i") == 0) | enough(F.least("r", "x.r"), F.col("n"), F.col("x.n"))))
    stars = stars.select(F.least("node", "l").alias("a"), F.greatest("node", "l").alias("b")).distinct()
    counted = scratch.table(overlaps(stars, parts), "stars", large=True)
    first = linked(counted)

    roots = components(first, scratch)
    rooted = scratch.table(buckets.join(roots, "node", "left").select("h", "node", "n", F.coalesce("root", "node").alias("root")), "rooted")
    shares = rooted.groupBy("h", "root").agg(F.count(F.lit(1)).alias("c"))
    mixed_up = shares.groupBy("h").agg(F.max_by("root", F.struct("c", "root")).alias("main"), F.count(F.lit(1)).alias("roots")).where("roots > 1").select("h", "main")
    # What each text shares with its first leader bounds what two texts of that leader share.
    led = fullest.select("node", F.col("leaders")[0]["node"].alias("l")).withColumn("a", F.least("node", "l")).withColumn("b", F.greatest("node", "l"))
    led = led.join(counted.select("a", "b", "o"), ["a", "b"], "left").select("node", "l", "o")
    known = sets.select("node", F.transform("parts", F.size).alias("r")).join(led, "node", "left")
    known = known.select("node", "r", "l", F.when(F.col("l") == F.col("node"), F.col("r")).otherwise(F.col("o")).alias("o"))
    here = join_by_key(rooted, mixed_up, mixed_up.join(F.broadcast(hot.select("h")), "h"), ["h"]).join(known, "node")
    aside = here.where("root <> main").select("h", F.col("node").alias("x"), F.col("n").alias("nx"), F.col("root").alias("tx"), F.col("r").alias("rx"), F.col("l").alias("lx"), F.col("o").alias("ox"))
    every = here.select("h", F.col("node").alias("y"), F.col("n").alias("ny"), F.col("root").alias("ty"), F.col("r").alias("ry"), F.col("l").alias("ly"), F.col("o").alias("oy"), "main")
    cond = (F.col("tx") != F.col("ty")) & ((F.col("ty") == F.col("main")) | (F.col("x") < F.col("y"))) & enough(most_overlap(), F.col("nx"), F.col("ny"))
    left, right = aside.alias("p"), every.alias("q")
    cross = left.join(right, (F.col("p.h") == F.col("q.h")) & cond).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
    across = scratch.table(overlaps(cross, parts), "across", large=True)
    scratch.drop(buckets, sizes, fullest, rooted)
    return first.unionByName(linked(across))


def ngram_join(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, n_shingles, component_id."""
    spark = df.sparkSession
    small_batches(spark, 500)
    scratch = Scratch(spark)
    docs = df.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    fragments = max(tasks(spark), size // 6 // FRAGMENT + 1)
    packed = map_pandas(docs, _texts(fragments), ENTRY)
    found = scratch.table(_counted(packed, fragments, _possible, "id long, d1 long, d2 long, n long, grams binary"), "found", large=True)

    sets = found.where(F.col("grams").isNotNull()).select(F.col("d1").alias("node"), "n", "grams").dropDuplicates(["node"])
    sets = scratch.table(sets, "sets", large=True)
    again = _counted(map_pandas(sets, _sets(fragments), ENTRY), fragments, _prefixes, "node long, n long, r long, parts array<array<long>>, prefix array<long>")
    again = scratch.table(again, "prefixes", large=True)
    scratch.drop(sets)
    links = links_of(again, scratch)

    # Texts by their least id; ids that stand at several texts join them.
    own = scratch.table(found.where("n > 0").select("id", F.col("d1").alias("node")).distinct(), "own")
    shared = own.where(F.col("id") != NO_ID).groupBy("id").agg(F.min("node").alias("u"), F.max("node").alias("v")).where("u <> v")
    through = own.join(shared.select("id", F.col("u").alias("w")), "id").select(F.col("w").alias("u"), F.col("node").alias("v")).where("u <> v")
    roots = components(links.unionByName(through), scratch)
    least = own.join(roots, "node", "left").select(F.coalesce("root", "node").alias("root"), "node", F.when(F.col("id") != NO_ID, F.col("id")).alias("id"))
    texts = least.groupBy("node", "root").agg(F.min("id").alias("id"))
    tops = texts.groupBy("root").agg(F.min("id").alias("component_id"))
    by_node = texts.join(tops, "root").select(F.col("node").alias("d1"), "component_id")
    real = F.when(F.col("id") != NO_ID, F.col("id"))
    out = found.select("id", "n", "d1").join(by_node, "d1", "left")
    return out.select(real.cast(df.schema[id_col].dataType).alias(id_col), F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(real).alias("component_id"))
