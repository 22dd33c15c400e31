"""Harmonic packing of tokenised documents into sequences of at most 1024 tokens.

A document's ids (with a closing id) fill whole sequences first; what is left, under 1024 ids, stays
in one piece as a rule. Remainders are partitioned by reciprocal capacity: class k holds those of
which k fit and k + 1 do not (beyond k = 32 only powers of two), and a bin of class k takes k of them, so
it closes by counting and never by searching. Such a bin has a gap of up to 1/(k+1) of it. A gap of
at most SLACK ids is left as padding; a larger one is filled from a donor, a remainder that is cut
for it: that is the only cut a remainder suffers. Every worker fills its own bins; a piece crosses no
network and the whole operator is one map stage. A worker holds one open bin a class and few bins
that wait for a donor, whatever it reads. At the end of its rows what is open goes end to end into
full sequences, and the last of them is cut at powers of two, which need no padding.

Documents that a worker's file split hands it again after a lost executor are packed the same way;
sequence ids hold the partition number above the worker's own count.

Defined results: null text counts as empty, which is the closing id alone; a very long text is packed
whole, long runs of white space included; repeated rows are packed as often as they occur, null ids
too; an empty table gives an empty result; other columns, of whatever name, are not read.
"""

from __future__ import annotations

import base64
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from ._common import map_arrow, small_batches

SEQUENCE = 1024
#: Read as one id, the first after the ranks, where a text holds it.
END_OF_TEXT = "<|endoftext|>"
#: Ids that a sequence may lack without being filled.
SLACK = 8
#: Classes above this are powers of two.
EXACT = 32
#: Runs of white space from this length are encoded apart from what surrounds them.
BLANKS = 10_000


def default_tokenizer() -> str:
    """The ids of byte_bpe_50k, from the file that lists the same vocabulary as ranks."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


@lru_cache(maxsize=2)
def encoder(path: str):
    """text -> ids. Rank files go to tiktoken, which gives the ids of `tokenizers` several times faster."""
    if path.endswith(".json"):
        from tokenizers import Tokenizer

        tok = Tokenizer.from_file(path)
        return lambda text: tok.encode(text, add_special_tokens=False).ids
    import public_tokenizers
    import regex
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    tok = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={END_OF_TEXT: len(ranks)})
    blanks = regex.compile(r"\p{White_Space}{%d,}" % BLANKS)

    def apart(text: str) -> list[int]:
        """Ids of a text without end marks. Its pattern takes a run of white space but for its last character
        as one piece, so a long run, on which the pattern's engine would overflow, is cut out and encoded by itself."""
        out, at = [], 0
        for run in blanks.finditer(text):
            end = run.end() if run.end() == len(text) else run.end() - 1
            out += tok.encode(text[at : run.start()], disallowed_special=())
            out += tok._encode_single_piece(text[run.start() : end])
            at = end
        return out + tok.encode(text[at:], disallowed_special=())

    def encode(text: str) -> list[int]:
        if len(text) < BLANKS or not blanks.search(text):
            return tok.encode(text, allowed_special="all")
        first, *rest = text.split(END_OF_TEXT)
        out = apart(first)
        for part in rest:
            out += [len(ranks), *apart(part)]
        return out

    return encode


def reciprocal(length: int) -> int:
    """How many pieces of this length a bin of their class takes."""
    k = SEQUENCE // length
    return k if k <= EXACT else 1 << (k.bit_length() - 1)


class Bins:
    """One worker's open bins. A piece is (document, start, ids, ids in the document); `emit` gets
    each with its sequence and offset."""

    def __init__(self, emit):
        self.emit, self.n = emit, 0
        self.open: dict[int, list] = {}
        self.waiting: list[tuple[list, int]] = []
        self.donor: tuple | None = None

    def add(self, doc, ids: np.ndarray) -> None:
        """A whole document: full sequences, then its remainder."""
        total, at = len(ids), 0
        while total - at >= SEQUENCE:
            self.close([(doc, at, ids[at : at + SEQUENCE], total)])
            at += SEQUENCE
        if at == total:
            return
        piece = (doc, at, ids[at:], total)
        if self.waiting:
            self.donor = piece
            self.feed()
            return
        k = reciprocal(total - at)
        bin_ = self.open.setdefault(k, [])
        bin_.append(piece)
        if len(bin_) == k:
            del self.open[k]
            gap = SEQUENCE - sum(len(p[2]) for p in bin_)
            if gap <= SLACK:
                self.close(bin_)
            else:
                self.waiting.append((bin_, gap))
                self.feed()

    def feed(self) -> None:
        """Fills the bins that wait from the donor; what is left of it stays the donor."""
        while self.waiting and self.donor:
            pieces, gap = self.waiting.pop()
            doc, start, ids, total = self.donor
            self.donor = (doc, start + gap, ids[gap:], total) if len(ids) > gap else None
            pieces.append((doc, start, ids[:gap], total))
            gap -= min(gap, len(ids))
            if gap <= SLACK:
                self.close(pieces)
            else:
                self.waiting.append((pieces, gap))

    def close(self, pieces: list) -> None:
        offset = 0
        for doc, start, ids, total in pieces:
            self.emit(doc, start, ids, total, self.n, offset)
            offset += len(ids)
        self.n += 1

    def finish(self) -> None:
        """All that is open, end to end: full sequences, the last one at powers of two."""
        rest = [p for bin_ in [*self.open.values(), *(b for b, _ in self.waiting), [self.donor] * (self.donor is not None)] for p in bin_]
        left = sum(len(p[2]) for p in rest)
        room, now = 0, []
        for doc, start, ids, total in rest:
            while len(ids):
                if not room:
                    room = min(SEQUENCE, 1 << (left.bit_length() - 1))
                part = ids[:room]
                now.append((doc, start, part, total))
                ids, start = ids[len(part) :], start + len(part)
                room, left = room - len(part), left - len(part)
                if not room:
                    self.close(now)
                    now = []
        self.open.clear(), self.waiting.clear()
        self.donor = None


def pack(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer_path: str | None = None, end_id: int = 0, with_ids: bool = False) -> DataFrame:
    """One row per piece: id, start, length, ids_crc32, doc_tokens, sequence_id, offset (and the ids)."""
    small_batches(df.sparkSession, 500)
    path = tokenizer_path or default_tokenizer()
    rows = df.select(df[id_col].alias("id"), df[text_col].cast("string").alias("text"))
    longs = ("start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
    fields = [T.StructField(id_col, df.schema[id_col].dataType)] + [T.StructField(c, T.LongType()) for c in longs]
    if with_ids:
        fields.append(T.StructField("ids", T.ArrayType(T.IntegerType())))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encode = encoder(path)
        base = TaskContext.get().partitionId() << 32
        docs, nums, all_ids, id_type = [], [], [], None

        def emit(doc, start, ids, total, seq, offset):
            docs.append(doc)
            nums.append((start, len(ids), zlib.crc32(ids.tobytes()), total, base + seq, offset))
            if with_ids:
                all_ids.append(ids.astype(np.int32))

        def flush() -> pa.RecordBatch:
            m = np.array(nums, dtype=np.int64).reshape(-1, len(longs))
            cols = [pa.array(docs, type=id_type), *[pa.array(m[:, i]) for i in range(len(longs))]]
            if with_ids:
                cols.append(pa.array(all_ids, type=pa.list_(pa.int32())))
            out = pa.RecordBatch.from_arrays(cols, names=[f.name for f in fields])
            docs.clear(), nums.clear(), all_ids.clear()
            return out

        bins = Bins(emit)
        for batch in batches:
            id_type = batch.column(0).type
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                bins.add(doc, np.array([*encode(text.as_py() or ""), end_id], dtype="<u4"))
                if len(nums) > 20_000:
                    yield flush()
        bins.finish()
        if nums:
            yield flush()

    return map_arrow(rows, run, T.StructType(fields))
