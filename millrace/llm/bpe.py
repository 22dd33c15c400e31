"""Byte-level BPE by longest matches and backtracking, and decoding.

A text falls into pieces by the tokenizer's pattern; each piece is encoded by itself. The tokens that BPE
merges give are the only sequence of tokens whose neighbours are all compatible: two tokens are, if merging
their bytes alone would leave the border between them. So a piece is encoded from the left: at each place
the longest token that begins there, shorter prefixes of it where the border to the token before is not
compatible, and a step back where none is left. Places from which no way leads on are remembered, so that
none is tried twice and a piece takes time in proportion to its length. Which tokens begin at a place, all
at once, is told by an Aho-Corasick automaton over the vocabulary; its keys are bytes read as Latin-1.
Compatibility is decided by undoing merges on both sides of the border and kept for each pair.

Ranks are those of a tiktoken file; a piece that is one token is that token, as there. One map stage; a
worker loads the vocabulary once. Frequent pieces are remembered, up to REMEMBERED of them.

Defined results: null text counts as empty, which has no ids and decodes to no bytes; very long texts, and
very long runs without a border, are encoded whole; special tokens are ordinary text; repeated rows get
equal results; an empty table gives an empty result; input columns pass through, and where one has the
name of an output column the operator's own replaces it. Ids beyond the vocabulary don't decode: an error.
"""

from __future__ import annotations

import base64
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._common import map_arrow, small_batches

#: Pieces, and pairs of tokens, whose results a worker keeps; beyond so many it begins anew.
REMEMBERED = 300_000


def default_ranks() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def tokens_of(path: str) -> list[bytes]:
    """The bytes of each token, by rank."""
    with open(path, "rb") as lines:
        ranks = {int(b): base64.b64decode(a) for a, b in map(bytes.split, lines)}
    return [ranks.get(i, b"") for i in range(max(ranks) + 1)]


class Vocabulary:
    """Tokens by rank, how each came about, and the automaton that finds them."""

    def __init__(self, path: str):
        import ahocorasick

        self.bytes = tokens_of(path)
        ranks = self.rank = {token: rank for rank, token in enumerate(self.bytes) if token}
        self.size = [len(t) for t in self.bytes]
        self.automaton = ahocorasick.Automaton()
        for token, rank in ranks.items():
            self.automaton.add_word(token.decode("latin-1"), rank)
        self.automaton.make_automaton()
        #: The longest shorter token that a token begins with; -1 if none.
        self.shorter = [next((ranks[t[:n]] for n in range(len(t) - 1, 0, -1) if t[:n] in ranks), -1) for t in self.bytes]
        self.known: dict[tuple[int, int], bool] = {}
        self.pieces: dict[str, bytes] = {}
        self.before: dict[str, bytes] = {}
        self.pair: dict[tuple[int, int], int] = {}
        self.halves: list[tuple[int, int]] = [(i, i) for i in range(len(self.bytes))]
        self._learn_merges()

    def _learn_merges(self) -> None:
        """In the order of ranks: the two tokens that a token is merged from, those whose border only this merge crosses."""
        for rank, token in enumerate(self.bytes):
            left = self.shorter[rank]
            while left >= 0:
                right = self.rank.get(token[self.size[left] :])
                if right is not None and left < rank and right < rank and self._border(left, right):
                    self.pair[left, right] = rank
                    self.halves[rank] = (left, right)
                    break
                left = self.shorter[left]

    def _border(self, left: int, right: int) -> bool:
        """Would merging leave the border between two tokens? Their last merges are undone, the later one
        first; a merge across the border that comes before the one undone last would have been made."""
        before = len(self.bytes)
        while True:
            across = self.pair.get((left, right))
            if across is not None and across < before:
                return False
            # Of equal ranks the left one was merged first, so the right one is undone first.
            if left > right:
                inner = self.halves[left][1]
                if inner != left:
                    before, left = left, inner
                    continue
                first = self.halves[right][0]
                if first == right:
                    return True
                before, right = right + 1, first
            else:
                first = self.halves[right][0]
                if first != right:
                    before, right = right + 1, first
                    continue
                inner = self.halves[left][1]
                if inner == left:
                    return True
                before, left = left, inner

    def compatible(self, left: int, right: int) -> bool:
        key = (left, right)
        found = self.known.get(key)
        if found is None:
            if len(self.known) >= REMEMBERED:
                self.known.clear()
            found = self.known[key] = self._border(left, right)
        return found

    def encode_piece(self, piece: bytes) -> list[int]:
        """The ids of one piece, as BPE merges give them."""
        whole = self.rank.get(piece)
        if whole is not None:
            return [whole]
        n, size, shorter, known = len(piece), self.size, self.shorter, self.known
        longest = [-1] * n
        for end, rank in self.automaton.iter(piece.decode("latin-1")):
            longest[end - size[rank] + 1] = rank  # ends only grow: the longest comes last
        out: list[int] = []
        dead: set[int] = set()
        at, token, last = 0, longest[0], -1
        while True:
            while token >= 0:
                end = at + size[token]
                if end not in dead:
                    if last < 0:
                        break
                    fits = known.get((last, token))
                    if fits is None:
                        fits = self.compatible(last, token)
                    if fits:
                        break
                token = shorter[token]
            if token >= 0:
                out.append(token)
                if end == n:
                    return out
                at, last, token = end, token, longest[end]
            elif out:
                dead.add(at)
                token = out.pop()  # which leads nowhere from here, so a shorter one is next
                at -= size[token]
                last = out[-1] if out else -1
            else:
                raise ValueError("the vocabulary has no token for a byte of the text")

    def encode(self, text: str, pattern) -> array:
        """The ids of a text: of each of its pieces, by its own."""
        out = array("i")
        kept = self.pieces
        for piece in pattern.findall(text):
            ids = kept.get(piece)
            if ids is None:
                ids = self.before.get(piece)
                if ids is None:
                    ids = array("i", self.encode_piece(piece.encode())).tobytes()
                if len(piece) < 64:
                    if len(kept) >= REMEMBERED // 2:  # those that came up again stay for another round
                        self.before, self.pieces = kept, {}
                        kept = self.pieces
                    kept[piece] = ids
            out.frombytes(ids)
        return out


@lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


@lru_cache(maxsize=4)
def compiled(pattern: str):
    import regex

    return regex.compile(pattern)


def encode(df: DataFrame, text_col: str = "text", path: str | None = None, pattern: str | None = None, carry: list[str] | None = None) -> DataFrame:
    """The input columns (or those carried) and ids, an array of the text's token ids."""
    import public_tokenizers

    small_batches(df.sparkSession, 500)
    path, pattern = path or default_ranks(), pattern or public_tokenizers.PATTERN
    names = [c for c in (df.columns if carry is None else carry) if c != "ids"]
    rows = df.select(*[F.col(f"`{c}`") for c in names], F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("_text"))
    schema = T.StructType([*[df.schema[c] for c in names], T.StructField("ids", T.ArrayType(T.IntegerType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab, cut = vocabulary(path), compiled(pattern)
        for batch in batches:
            ends, parts = [0], []
            for text in batch.column(batch.num_columns - 1):
                parts.append(np.frombuffer(vocab.encode(text.as_py(), cut), dtype=np.int32))
                ends.append(ends[-1] + len(parts[-1]))
            ids = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(parts) if parts else np.zeros(0, np.int32)))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], ids], names=schema.names)

    return map_arrow(rows, run, schema)


def decode(df: DataFrame, ids_col: str = "ids", path: str | None = None) -> DataFrame:
    """The input columns and decoded, the bytes that the ids stand for; null ids have none."""
    path = path or default_ranks()
    names = [c for c in df.columns if c != "decoded"]
    schema = T.StructType([*[df.schema[c] for c in names], T.StructField("decoded", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = tokens_of(path)
        for batch in batches:
            texts = [b"".join([tokens[i] for i in ids.values.to_numpy(zero_copy_only=False).tolist()]) if ids.is_valid else b"" for ids in batch.column(ids_col)]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in names], pa.array(texts, pa.binary())], names=schema.names)

    return map_arrow(df.select(*[F.col(f"`{c}`") for c in names]), run, schema)
