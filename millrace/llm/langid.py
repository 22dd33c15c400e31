"""Language identification of mixed text.

Words are runs of letters. A word's script (by code-point ranges) narrows the candidate languages
to those that use the script; each candidate scores the word by the log probabilities of its
letter trigrams, word edges included. Viterbi over the document's words, with a penalty for each
switch of language, labels spans. The prediction is the language with most letters in its spans,
the score its share of the letters.

Learning: counts of hashed trigrams per language over a bounded sample of labelled documents, at
most about `per_lang` whole documents of each language, drawn by a hash of id, text and place (documented
parameter), so that many rows with one id, or with none, are drawn as sparsely as others.
A task per language turns counts into scores, so the driver receives and broadcasts one packed row of
`BUCKETS` floats a language and no more; no text crosses the network.

Viterbi is exact. For most documents one language wins outright: if no stretch of words favours
other languages by more than one switch penalty in sum, the single-language path is optimal, which
a running minimum over all documents of a batch shows at once. The rest go through the recursion,
all documents of a batch side by side.

Defined results: null text, or text without letters, is `und` with score 0; letters that no learned
language uses still get the best learned language; ties go to the language first by code point; an
empty table gives an empty result; without any training row all is `und`; a very long text is scored
whole, in one recursion; repeated rows get the same result; of input columns only those carried appear,
and an own column replaces one of its name.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._common import Scratch, crc_of, map_arrow, map_pandas, small_batches

BUCKETS = 1 << 18
#: Nats that a switch of language costs.
SWITCH = 12.0
#: What a word's score loses in a language that does not use the word's script.
FOREIGN = 200.0
#: A language uses a script that has this share of its letters.
SCRIPT_SHARE = 0.02
CHUNK = 1_000_000  # letters and others that are scored at once

# The main code-point ranges of scripts, in natural order.
SCRIPTS = [
    ("latin", 0x0041, 0x024F), ("greek", 0x0370, 0x03FF), ("cyrillic", 0x0400, 0x052F), ("armenian", 0x0530, 0x058F),
    ("hebrew", 0x0590, 0x05FF), ("arabic", 0x0600, 0x06FF), ("devanagari", 0x0900, 0x097F), ("bengali", 0x0980, 0x09FF),
    ("gurmukhi", 0x0A00, 0x0A7F), ("gujarati", 0x0A80, 0x0AFF), ("tamil", 0x0B80, 0x0BFF), ("telugu", 0x0C00, 0x0C7F),
    ("kannada", 0x0C80, 0x0CFF), ("malayalam", 0x0D00, 0x0D7F), ("sinhala", 0x0D80, 0x0DFF), ("thai", 0x0E00, 0x0E7F),
    ("lao", 0x0E80, 0x0EFF), ("myanmar", 0x1000, 0x109F), ("georgian", 0x10A0, 0x10FF), ("ethiopic", 0x1200, 0x137F),
    ("khmer", 0x1780, 0x17FF), ("latin", 0x1E00, 0x1EFF), ("greek", 0x1F00, 0x1FFF), ("kana", 0x3040, 0x30FF),
    ("han", 0x3400, 0x9FFF), ("hangul", 0xAC00, 0xD7AF), ("han", 0x20000, 0x3134F),
]
SCRIPT_NAMES = ["other", *dict.fromkeys(name for name, _, _ in SCRIPTS)]


@lru_cache(maxsize=1)
def tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """By code point: is it a letter, does it belong to words (letters and marks), its script."""
    kind = [unicodedata.category(chr(c))[0] for c in range(0x110000)]
    letter = np.array([k == "L" for k in kind])
    word = np.array([k in "LM" for k in kind])
    script = np.zeros(0x110000, dtype=np.uint8)
    for name, a, b in SCRIPTS:
        script[a : b + 1] = SCRIPT_NAMES.index(name)
    return letter, word, script


@dataclass
class Words:
    """The words of several texts, laid end to end."""

    hashes: np.ndarray  # of each letter's trigram
    starts: np.ndarray  # of each word among the letters
    script: np.ndarray  # of each word
    doc: np.ndarray  # of each word
    begin: np.ndarray  # of each word, characters from its text's start
    end: np.ndarray
    letters: np.ndarray  # of each text


def words_of(texts: list[str]) -> Words:
    letter, word, script = tables()
    points = np.frombuffer("\n".join(["", *[t.lower() for t in texts], ""]).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    lengths = np.array([len(t.lower()) for t in texts], dtype=np.int64)
    offsets = np.concatenate([[1], 1 + np.cumsum(lengths + 1)])[:-1]
    inside = word[points]
    masked = np.where(inside, points, 0).astype(np.uint32)
    at = np.flatnonzero(inside)
    before, here, after = masked[at - 1], masked[at], masked[at + 1]
    mixed = before * np.uint32(73856093) ^ here * np.uint32(19349663) ^ after * np.uint32(83492791)
    mixed ^= mixed >> np.uint32(15)
    starts = np.flatnonzero(before == 0)
    begin = at[starts]
    end = np.append(at[starts[1:] - 1], at[-1:]) + 1 if len(starts) else begin
    doc = np.searchsorted(offsets, begin, side="right") - 1
    letters = np.bincount(np.searchsorted(offsets, at[letter[here]], side="right") - 1, minlength=len(texts)) if len(at) else np.zeros(len(texts), dtype=np.int64)
    return Words((mixed & np.uint32(BUCKETS - 1)).astype(np.int32), starts, script[points[begin]], doc, begin - offsets[doc], end - offsets[doc], letters)


@dataclass
class Model:
    langs: list[str]
    scores: np.ndarray  # languages x BUCKETS
    uses: np.ndarray  # scripts x languages

    def word_scores(self, w: Words) -> np.ndarray:
        out = np.empty((len(w.starts), len(self.langs)), dtype=np.float64)
        for k in range(len(self.langs)):
            out[:, k] = np.add.reduceat(self.scores[k][w.hashes], w.starts) if len(w.starts) else 0
        allowed = self.uses[w.script]
        return out - FOREIGN * (~allowed & allowed.any(axis=1, keepdims=True))


def highest(want: int, n: int) -> int:
    """The 64-bit hash up to which about `want` of n rows are drawn."""
    return min(2**63 - 1, -(2**63) + 2**64 * want // n)


def fit(df: DataFrame, lang_col: str = "lang", text_col: str = "text", id_col: str = "doc_id", per_lang: int = 5000) -> Model:
    """Counts over at most about per_lang documents of each language."""
    rows = df.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    counts = {r[0]: r[1] for r in rows.groupBy(lang_col).count().collect()}
    if not counts:
        return Model([], np.zeros((0, BUCKETS), np.float32), np.zeros((len(SCRIPT_NAMES), 0), bool))
    shares = F.create_map(*[F.lit(x) for lang, n in counts.items() for x in (lang, highest(per_lang, n))])
    # Rows that repeat an id or have none are told apart by their text and their place in the table.
    mark = F.xxhash64(F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.col(text_col), F.monotonically_increasing_id())
    drawn = rows.withColumn("_mark", mark).where(F.col("_mark") <= shares[F.col(lang_col)])

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[str, np.ndarray] = {}
        for pdf in batches:
            for lang, texts in pdf.groupby("lang")["text"]:
                total = sums.setdefault(lang, np.zeros(BUCKETS + len(SCRIPT_NAMES) + 1, dtype=np.int64))
                total[-1] += len(texts)
                for part in chunks(list(texts)):
                    w = words_of(part)
                    total[:BUCKETS] += np.bincount(w.hashes, minlength=BUCKETS)
                    total[BUCKETS:-1] += np.bincount(w.script, weights=w.end - w.begin, minlength=len(SCRIPT_NAMES)).astype(np.int64)
        for lang, total in sums.items():
            at = np.flatnonzero(total)
            yield pd.DataFrame({"lang": lang, "bucket": at, "n": total[at]})

    small_batches(df.sparkSession, 500)
    got = map_pandas(drawn.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text")), count, "lang string, bucket long, n long")
    got = Scratch(df.sparkSession).table(got.groupBy("lang", "bucket").agg(F.sum("n").alias("n")), "grams")
    drawn_of = {r[0] for r in got.where(F.col("bucket") == BUCKETS + len(SCRIPT_NAMES)).select("lang").collect()}
    if none := set(counts) - drawn_of:
        raise ValueError(f"no labelled document was drawn of {sorted(map(str, none))}")
    got = got.where(F.col("bucket") < BUCKETS + len(SCRIPT_NAMES))
    seen = max(1, got.where(F.col("bucket") < BUCKETS).select("bucket").distinct().count())

    def packed(pdf: pd.DataFrame) -> pd.DataFrame:
        n = np.bincount(pdf["bucket"], weights=pdf["n"], minlength=BUCKETS + len(SCRIPT_NAMES))
        grams, scripts = n[:BUCKETS], n[BUCKETS:]
        scores = np.log((grams + 0.5) / (grams.sum() + 0.5 * (seen + 1))).astype(np.float32)
        return pd.DataFrame({"lang": pdf["lang"][:1], "scores": [scores.tobytes()], "uses": [((scripts >= SCRIPT_SHARE * scripts.sum()) & (scripts > 0)).tobytes()]})

    found = {r["lang"]: r for r in got.groupBy("lang").applyInPandas(packed, "lang string, scores binary, uses binary").collect()}
    langs = sorted(found)
    scores = np.array([np.frombuffer(found[x]["scores"], np.float32) for x in langs]).reshape(len(langs), BUCKETS)
    uses = np.array([np.frombuffer(found[x]["uses"], bool) for x in langs]).reshape(len(langs), len(SCRIPT_NAMES))
    return Model(langs, scores, uses.T)


def chunks(texts: list[str]) -> Iterator[list[str]]:
    part, size = [], 0
    for t in texts:
        part.append(t)
        size += len(t) + 1
        if size > CHUNK:
            yield part
            part, size = [], 0
    if part:
        yield part


def viterbi(scores: np.ndarray, doc: np.ndarray, n_docs: int, switch: float = SWITCH) -> np.ndarray:
    """The label of each word, optimal for its document. Documents' words follow one another."""
    n, k = scores.shape
    if not n or k < 2:
        return np.zeros(n, dtype=np.int64)
    first = np.flatnonzero(np.diff(doc, prepend=-1))
    sums = np.add.reduceat(scores, first, axis=0)
    which = np.zeros(n_docs, dtype=np.int64)
    which[doc[first]] = sums.argmax(axis=1)
    labels = which[doc]
    own = np.take_along_axis(scores, labels[:, None], axis=1)[:, 0]
    rest = scores.copy()
    rest[np.arange(n), labels] = -np.inf
    gain = rest.max(axis=1) - own
    size = np.diff(np.append(first, n))
    order = np.repeat(np.arange(len(first)), size)
    run = np.cumsum(gain)
    run -= np.repeat(run[first] - gain[first], size)
    # Each document far below the one before: the running minimum then starts afresh.
    step = 1e3 + 2 * np.abs(run).max()
    low = np.minimum.accumulate(np.minimum(run - gain, run) - step * order) + step * order
    low_before = np.minimum(low, run - gain)
    best = np.maximum.reduceat(run - low_before, first)
    hard = np.flatnonzero(best > switch - 1e-3)
    if len(hard):
        lens = size[hard]
        by = np.argsort(-lens, kind="stable")
        hard, lens = hard[by], lens[by]
        back = np.zeros((lens[0], len(hard), k), dtype=np.uint8 if k < 256 else np.int32)
        value = scores[first[hard]].copy()
        final = np.zeros(len(hard), dtype=np.int64)
        active = len(hard)
        for t in range(1, lens[0] + 1):
            ended = int((lens > t).sum())
            final[ended:active] = value[ended:active].argmax(axis=1)
            active = ended
            if not active:
                break
            v = value[:active]
            top = v.argmax(axis=1)
            over = v[np.arange(active), top][:, None] - switch
            stay = v >= over
            back[t, :active] = np.where(stay, np.arange(k), top[:, None])
            value[:active] = np.where(stay, v, over) + scores[first[hard[:active]] + t]
        for i, (d, m) in enumerate(zip(hard, lens)):
            label = final[i]
            for t in range(m - 1, -1, -1):
                labels[first[d] + t] = label
                label = back[t, i, label]
    return labels


def predict(df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", with_spans: bool = False, carry: list[str] | None = None) -> DataFrame:
    """One row per input row: the carried columns (the id alone if not told), lang_pred, score (and
    spans: start, end in characters of the lower-cased text, lang). Of two columns with one name the
    operator's own stays."""
    spark = df.sparkSession
    small_batches(spark, 500)
    shared = spark.sparkContext.broadcast(model)
    own = [("lang_pred", T.StringType()), ("score", T.DoubleType())]
    if with_spans:
        own.append(("spans", T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("lang", T.StringType())]))))
    names = [c for c in (carry or [id_col]) if c not in dict(own)]
    schema = T.StructType([df.schema[c] for c in names] + [T.StructField(n, t) for n, t in own])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            lang, score, spans = [], [], []
            for part in chunks([t or "" for t in batch.column(batch.num_columns - 1).to_pylist()]):
                w = words_of(part)
                labels = viterbi(m.word_scores(w), w.doc, len(part)) if m.langs else np.zeros(len(w.starts), dtype=np.int64)
                k = max(1, len(m.langs))
                mass = np.bincount(w.doc * k + labels, weights=w.end - w.begin, minlength=len(part) * k).reshape(len(part), k)
                best, total = mass.argmax(axis=1), mass.sum(axis=1)
                known = (w.letters > 0) & (total > 0) & bool(m.langs)
                lang += [m.langs[b] if ok else "und" for b, ok in zip(best, known)]
                score += [float(mass[i, b] / total[i]) if known[i] else 0.0 for i, b in enumerate(best)]
                if with_spans:
                    spans += spans_of(w, labels, len(part), m.langs)
            new = [pa.array(lang, pa.string()), pa.array(score, pa.float64())]
            if with_spans:
                new.append(pa.array(spans, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("lang", pa.string())]))))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *new], names=schema.names)

    text = df.select(*[F.col(f"`{c}`") for c in names], F.col(text_col).cast("string").alias("_text"))
    return map_arrow(text, run, schema)


def spans_of(w: Words, labels: np.ndarray, n: int, langs: list[str]) -> list[list[dict]]:
    out: list[list[dict]] = [[] for _ in range(n)]
    if not langs or not len(labels):
        return out
    edge = np.flatnonzero((np.diff(w.doc, prepend=-1) != 0) | (np.diff(labels, prepend=-1) != 0))
    last = np.append(edge[1:], len(labels)) - 1
    for a, b in zip(edge, last):
        out[w.doc[a]].append({"start": int(w.begin[a]), "end": int(w.end[b]), "lang": langs[labels[a]]})
    return out


def held_out(id_col: str = "doc_id") -> Column:
    return F.pmod(crc_of(id_col), F.lit(4)) == 2


def identify(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", with_spans: bool = False, carry: list[str] | None = None, labelled: DataFrame | None = None) -> DataFrame:
    """Learns from the labelled documents (of `labelled`, if given) that are not held out, predicts all:
    carried columns, held_out, lang_pred, score."""
    model = fit((df if labelled is None else labelled).where(~held_out(id_col)), lang_col, text_col, id_col)
    out = predict(df, model, id_col, text_col, with_spans, carry)
    return out.withColumn("held_out", held_out(id_col))
