"""Merkle manifest, conversation trie and byte-level BPE: brute force, round trips, awkward rows, block and task borders."""

import base64
import hashlib
import random
import re
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F


def sha(text):
    return hashlib.sha256(text if isinstance(text, bytes) else text.encode()).hexdigest()


# Merkle manifest

FIELDS = "doc_id long, text string, lang string, source string, n_chars long, path string, leaf int, root string, g int, pos long"


def documents():
    rng = random.Random(5)
    rows = [(i, "w" * rng.randrange(9), rng.choice(["en", "en", "en", "en", "dé", None, "zz"]), rng.choice(["a", None, "b:1"]), rng.choice([None, i]), "p", 1, "r", 2, 3) for i in range(150)]
    rows += [rows[3], rows[3], (7, "other", "en", "a", 2**63 - 1, None, None, None, None, None), (None, "x", "en", None, None, None, None, None, None, None), (None, None, None, None, None, None, None, None, None, None)]
    return rows + [(1000, "é" * 300_000, "alone", "", 0, None, None, None, None, None), (1001, "", "en", "a", -5, None, None, None, None, None)]


def hashed(values):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def climbed(nodes):
    """Levels of a tree, and each leaf's siblings with their sides."""
    levels = [list(nodes)]
    while len(levels[-1]) > 1:
        last = levels[-1]
        levels.append([sha("".join(last[i : i + 2])) for i in range(0, len(last), 2)])
    paths = []
    for i in range(len(nodes)):
        path = []
        for level in levels[:-1]:
            path.append(("L" if i & 1 else "R", level[i ^ 1]) if i ^ 1 < len(level) else None)
            i >>= 1
        paths.append(path)
    return levels[-1][0], paths


def expected_manifest(rows):
    groups = defaultdict(list)
    for r in rows:
        groups[r[2]].append((r[0], hashed((r[0], r[3], r[2], r[4], r[1])), r))
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    tops = {g: climbed([x[1] for x in sorted(groups[g], key=lambda x: (x[0] is not None, x[0] or 0, x[1]))]) for g in order}
    root, above = climbed([tops[g][0] for g in order])
    out = []
    for g, up in zip(order, above):
        ranked = sorted(groups[g], key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
        for (i, leaf, r), path in zip(ranked, tops[g][1]):
            whole = path + up
            hit = i is not None and zlib.crc32(str(i).encode()) % 7 == 0 and r[4] is not None
            node = hashed((i, r[3], r[2], r[4] + 1, r[1])) if hit else leaf
            for step in whole:
                node = sha(node if step is None else step[1] + node if step[0] == "L" else node + step[1])
            out.append((i, leaf, tops[g][0], root, sha("".join(s[1] for s in whole if s)), node, node == root))
    return out


def tamper(m):
    raised = F.when(F.col("n_chars").isNotNull(), F.col("n_chars").cast("decimal(20,0)") + 1)
    hit = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 7 == 0, F.lit(False))
    return F.when(hit, m.leaf_of(*[raised if c == "n_chars" else F.col(c) for c in m.FIELDS]))


@pytest.mark.parametrize("block,few", [(10, 10_000), (2, 10_000), (3, 0)])
def test_manifest(spark, monkeypatch, block, few):
    from millrace.llm import merkle as m

    monkeypatch.setattr(m, "BLOCK", block)
    monkeypatch.setattr(m, "BROADCAST_ROWS", few)
    df = spark.createDataFrame(documents(), FIELDS).repartition(3)
    got = m.manifest(df, carry={"seen": tamper(m)})
    got = got.withColumn("folded", m.fold(F.coalesce("seen", "leaf"), F.col("path"))).withColumn("proof", m.proof(F.col("path")))
    rows = [(r.doc_id, r.leaf, r.subroot, r.root, r.proof, r.folded, r.folded == r.root) for r in got.collect()]
    assert sorted(rows, key=str) == sorted(expected_manifest(documents()), key=str)


def test_manifest_of_nothing_one_row_and_one_group(spark):
    from millrace.llm import merkle as m

    assert m.manifest(spark.createDataFrame([], FIELDS)).count() == 0
    (one,) = m.manifest(spark.createDataFrame(documents()[:1], FIELDS)).collect()
    assert one.leaf == one.subroot == one.root and one.path == []


def test_treehash_holds_a_logarithm_of_its_block():
    from millrace.llm import merkle as m

    held = []
    stacks = []
    begin = m.Treehash.__init__

    def watched(self, level):
        begin(self, level)
        stacks.append(self)

    m.Treehash.__init__ = watched
    try:
        leaves = [sha(str(i)).encode() for i in range(1 << 10)]
        for _ in m.traverse(leaves, 10):
            held.append(sum(len(s.stack) + (s.node is not None) for s in stacks))
    finally:
        m.Treehash.__init__ = begin
    assert max(held) <= 3 * 10


@pytest.mark.parametrize("height", [0, 1, 3, 5])
def test_traversal_of_every_size(height):
    from millrace.llm import merkle as m

    for n in range(1, (1 << height) + 1):
        leaves = [sha(str(i)) for i in range(n)]
        for i, path in enumerate(m.traverse([x.encode() for x in leaves], height)):
            levels = [leaves]
            for h in range(height):
                last = levels[-1]
                sibling = i >> h ^ 1
                assert path[h] == (last[sibling].encode() if sibling < len(last) else None)
                levels.append([sha("".join(last[k : k + 2])) for k in range(0, len(last), 2)])


# Conversation trie

TURNS = "conv_id long, turn long, role string, text string, key string, n_convs int"


def conversations():
    rng = random.Random(9)
    rows = []
    for c in [*range(-3, 45), 60, 61, 75, 400]:
        for t in range(rng.randrange(5)):
            rows.append((c, None if rng.random() < 0.1 and t == 0 else t, rng.choice(["user", "bot", None]), rng.choice(["a b c", "a  b\tc", "hi", "", None, "x"]), "k", 1))
    rows += [(c, t, "user", "the same opening", None, None) for c in range(500, 540) for t in range(1 + c % 2)]
    rows += [(60, 9, "user", "again", None, None)] * 2 + [(None, 1, "user", "nobody's", None, None)] + [(61, 3, "user", "long " * 50_000, None, None)]
    return rows


def expected_trie(rows):
    own = defaultdict(list)
    for c, t, role, text, *_ in rows:
        if c is not None:
            own[c].append((t is not None, t or 0, role or "", sha(f"{len((role or '').encode())}:{role or ''}{text or ''}"), (role or "", text or "")))
    own = {c: [x[-1] for x in sorted(ts)] for c, ts in own.items()}
    built = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        base = c - int(c % 20 if c >= 0 else -(-c % 20))
        built[c] = own.get(base, [])[:h] + turns[h:]
    members = defaultdict(list)
    for c, turns in built.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    kids = defaultdict(list)
    for node in members:
        if node:
            kids[node[:-1]].append(node)

    def below(node):
        return [node] + [x for k in kids[node] for x in below(k)]

    words = lambda node: len(re.findall(r"[^\x20\x09-\x0D]+", node[-1][1])) if node else 0
    out = []
    for node, ms in members.items():
        sub = below(node)
        ends = ",".join(map(str, sorted(c for c in ms if len(built[c]) == len(node))))
        out.append((min(ms), len(node), min(members[node[:-1]]) if node else None, len(ms), len(kids[node]), sum(not kids[x] for x in sub), sum((len(members[x]) - 1) * words(x) for x in sub), sha(ends)))
    return sorted(out, key=str)


@pytest.mark.parametrize("parts,piece,few", [(1, 1 << 20, 9999), (7, 8, 9999), (40, 1, 0)])
def test_trie(spark, monkeypatch, parts, piece, few):
    from millrace.llm import trie as m

    monkeypatch.setattr(m, "PIECE", piece)
    monkeypatch.setattr(m, "BROADCAST_ROWS", few)
    df = spark.createDataFrame(conversations(), TURNS).repartition(3)
    got = m.prefix_trie(m.rebuilt(m.turns_of(df, "conv_id", "turn", "role", "text")), parts)
    rows = [(r.conv_id, r.depth, r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens, r.ends_sha256) for r in got.collect()]
    assert sorted(rows, key=str) == expected_trie(conversations())


def test_trie_of_nothing_and_of_turnless(spark):
    from millrace.llm import trie as m

    assert m.conversation_trie(spark.createDataFrame([], TURNS)).count() == 0
    # 45 keeps nothing of its own one turn where its h is over 0 and conversation 40 is absent.
    c = next(c for c in range(41, 60) if zlib.crc32(str(c).encode()) % 4)
    (root,) = m.conversation_trie(spark.createDataFrame([(c, 0, "user", "x", None, None)], TURNS)).collect()
    assert (root.depth, root.conv_id, root.parent_conv_id, root.n_convs, root.n_leaves, root.ends_sha256) == (0, c, None, 1, 1, sha(str(c)))


def test_sweeps_stitch_wherever_tasks_are_cut():
    from millrace.llm import trie as m

    rng = random.Random(4)
    digest = lambda t: hashlib.sha256(bytes([t])).digest()[: m.WIDE]
    for _ in range(150):
        convs = {rng.randrange(-50, 900): [rng.randrange(3) for _ in range(rng.choice([0, 1, 2, 3, 6]))] for _ in range(rng.randrange(1, 25))}
        convs |= {i: [0, 1, 2] for i in range(1000, 1000 + rng.choice([0, 20]))}
        rows = sorted((b"".join(map(digest, t)), c, t) for c, t in convs.items())
        cuts = sorted(rng.choices(range(len(rows) + 1), k=rng.randrange(6)))
        whole, closed = m.Stitch(), []
        for p, (a, b) in enumerate(zip([0, *cuts], [*cuts, len(rows)])):
            sweep = m.Sweep(p)
            for key, c, t in rows[a:b]:
                sweep.add(c, key, t)
            sweep.finish()
            closed += [r for r in sweep.rows if r["kind"] == "node"]
            for r in sweep.rows:
                if r["kind"] == "open":
                    whole.task(r["open"])
        while whole.path:
            whole.close()
        members = defaultdict(list)
        for c, t in convs.items():
            for d in range(len(t) + 1):
                members[tuple(t[:d])].append(c)
        saved = lambda node: sum((len(ms) - 1) * k[-1] for k, ms in members.items() if k and k[: len(node)] == node)
        assert sorted((r["depth"], r["conv_id"], r["n_convs"], r["saved_tokens"]) for r in [*closed, *whole.rows]) == sorted((len(k), min(ms), len(ms), saved(k)) for k, ms in members.items())


# Byte-level BPE


@pytest.fixture(scope="module")
def tiktoken_encoding():
    import public_tokenizers
    import tiktoken

    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_pieces_are_those_of_merges(tiktoken_encoding):
    from millrace.llm import bpe

    vocab, rng = bpe.vocabulary(bpe.default_ranks()), random.Random(2)
    for _ in range(6000):
        kind = rng.randrange(5)
        if kind == 0:
            piece = b"".join(rng.choice(vocab.bytes) for _ in range(rng.randrange(1, 8)))
        else:
            letters = [b"abc", b" ", bytes(range(256)), b"aeiourstln"][kind - 1]
            piece = bytes(rng.choice(letters) for _ in range(rng.randrange(1, 60)))
        assert vocab.encode_piece(piece) == tiktoken_encoding._encode_single_piece(piece)


def test_other_vocabulary(tmp_path):
    """A small vocabulary where the longest match is often wrong, against merges by rank."""
    from millrace.llm import bpe

    rng = random.Random(8)
    for round_ in range(30):
        tokens = [bytes([c]) for c in b"abcd"]
        while len(tokens) < 40:  # merges as training would list them: any two earlier tokens
            merged = rng.choice(tokens) + rng.choice(tokens)
            if merged not in tokens and len(merged) < 9:
                ranks = {t: i for i, t in enumerate(tokens)}
                if len(merge(merged, ranks | {merged: len(tokens)})) == 1:
                    tokens.append(merged)
        ranks = {t: i for i, t in enumerate(tokens)}
        path = tmp_path / f"{round_}.tiktoken"
        path.write_bytes(b"\n".join(base64.b64encode(t) + b" %d" % i for t, i in ranks.items()))
        vocab = bpe.Vocabulary(str(path))
        for _ in range(200):
            piece = bytes(rng.choice(b"abcd") for _ in range(rng.randrange(1, 30)))
            assert vocab.encode_piece(piece) == merge(piece, ranks)
    with pytest.raises(ValueError):
        vocab.encode_piece(b"az")


def merge(piece, ranks):
    parts = [bytes([c]) for c in piece]
    while True:
        found = min(((ranks[parts[i] + parts[i + 1]], i) for i in range(len(parts) - 1) if parts[i] + parts[i + 1] in ranks), default=None)
        if found is None:
            return [ranks[p] for p in parts]
        i = found[1]
        parts[i : i + 2] = [parts[i] + parts[i + 1]]


def test_encode_and_decode(spark, tiktoken_encoding):
    from millrace.llm import bpe

    texts = [None, "", " ", "a", "Hello, world!  It's 2024\n\n", "<|endoftext|> x", "漢字 かな 😀 é", "\x00\x1f\x85 　", "x" * 20_000, "ab " * 30_000, "don't", "same", "same"]
    df = spark.createDataFrame([(i, t, 5, b"d") for i, t in enumerate(texts)] + [(None, "no id", None, None)], "doc_id long, text string, ids int, decoded binary").repartition(3)
    out = bpe.decode(bpe.encode(df))
    assert out.columns == ["doc_id", "text", "ids", "decoded"]
    rows = out.collect()
    assert len(rows) == len(texts) + 1
    for r in rows:
        assert bytes(r.decoded).decode() == (r.text or "")
        assert r.ids == tiktoken_encoding.encode_ordinary(r.text or "")
    assert bpe.decode(bpe.encode(df.limit(0))).count() == 0
    assert bpe.encode(spark.createDataFrame([(" " * 300_000 + "x",)], "text string")).select(F.size("ids")).first()[0] == 300_000


def test_queries_hold_the_digests(spark, sf, tiktoken_encoding):
    from millrace.llm import queries

    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = queries.op13_byte_bpe(spark, sf).collect()
    assert len(rows) == len(texts)
    for r in rows:
        ids = tiktoken_encoding.encode_ordinary(texts[r.doc_id])
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), sha(" ".join(map(str, ids))), sha(texts[r.doc_id]))
