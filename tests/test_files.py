"""Small documents put in place by rename; tables as HTML; subword boundaries."""

import random

from millrace.operators import tokens
from millrace.sources import tables as src
from millrace.sources.files import Files


def test_put_and_claim(spark, tmp_path):
    f = Files(spark, f"file://{tmp_path}/x")
    assert f.read("a") is None and f.names("d") == []
    for data in (b"one", b"two", b""):
        f.put("a", data)
        assert f.read("a") == data
    assert f.claim("d/1", b"mine") and not f.claim("d/1", b"other") and f.read("d/1") == b"mine"
    assert f.names("d") == ["1"] and f.names("") == ["a", "d"]
    f.delete("a")
    assert f.read("a") is None


def test_html(spark):
    df = spark.createDataFrame([(1, "a<b&c"), (2, None)], "n int, t string").orderBy("n")
    assert src.html(df).split("\n") == ["<table>", "<tr><th>n</th><th>t</th></tr>", "<tr><td>1</td><td>a&lt;b&amp;c</td></tr>", "<tr><td>2</td><td></td></tr>", "</table>"]


def test_a_prompt_that_ends_inside_a_token():
    tok = tokens.SubwordTokenizer()
    full = "Привет, мир"
    ids, spans = tok.encode(full)
    for prompt in ("Приве", "Приве", "Привет,"):
        n, fallback = tokens.boundary(tok.encode(prompt)[0], ids, spans, len(prompt))
        assert spans[n][0] >= len(prompt) or not fallback
    rng = random.Random(3)
    fired = 0
    for _ in range(300):
        text = "".join(rng.choice(["the", " ", "\n", "ing", "ё", "12"]) for _ in range(12)) + " end"
        cut = rng.randrange(1, len(text) - 4)
        ids, spans = tok.encode(text)
        n, fallback = tokens.boundary(tok.encode(text[:cut])[0], ids, spans, cut)
        fired += fallback
        assert not fallback or (spans[n][0] >= cut and all(a < cut for a, _ in spans[:n]))
    assert fired > 30


def test_subword_counts_are_the_public_vocabulary(spark, sf):
    import base64

    import public_tokenizers
    import tiktoken

    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    tik = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    tok = tokens.SubwordTokenizer()
    for r in spark.read.parquet(f"{sf}/conversations.parquet").limit(50).collect():
        assert tok.encode(r["text"])[0] == tik.encode_ordinary(r["text"])
