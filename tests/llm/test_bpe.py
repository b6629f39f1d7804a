import hashlib
import random

import pytest

from tidewell.llm import bpe, common

tiktoken = pytest.importorskip("tiktoken")


@pytest.fixture(scope="module")
def pair():
    c = bpe.codec(common.tokenizer_path(bpe.RANKS))
    return c, tiktoken.Encoding("own", pat_str=bpe.PATTERN, mergeable_ranks=c.ranks, special_tokens={})


def test_as_the_library(pair):
    ours, theirs = pair
    rng = random.Random(2)
    texts = ["".join(rng.choice("aeinst  \n\t'éü0123.,!?中\U0001f600lreh") for _ in range(rng.randint(0, 300))) for _ in range(400)]
    texts += ["a" * 5000, "ab" * 3000, " " * 999, "<|endoftext|>", "", "don't we'll I'm   x", "\u0000\u2028x"]
    got = ours.encode(texts)
    assert got == [theirs.encode_ordinary(t) for t in texts]
    assert [ours.decode(g) for g in got] == [t.encode() for t in texts]
    ours.kept.clear()
    assert ours.encode(texts[:5]) == got[:5]


def test_lower_rank_opens_late():
    """A merge that opens one of lower rank makes the word's later positions wait."""
    import base64
    import os
    import tempfile

    tokens = [bytes([i]) for i in range(256)] + [b"abc", b"bc", b"aa", b"aaaa"]
    with tempfile.NamedTemporaryFile("w", suffix=".tiktoken", delete=False) as f:
        f.writelines(f"{base64.b64encode(t).decode()} {i}\n" for i, t in enumerate(tokens))
    c = bpe.Codec(f.name, r"\S+|\s+")
    e = tiktoken.Encoding("own", pat_str=r"\S+|\s+", mergeable_ranks=c.ranks, special_tokens={})
    os.unlink(f.name)
    rng = random.Random(1)
    texts = ["".join(rng.choice("abc") for _ in range(rng.randint(1, 30))) for _ in range(500)]
    assert c.encode(texts) == [e.encode_ordinary(t) for t in texts]


def test_frames(make, corpus, pair):
    _, theirs = pair
    docs = make(corpus, extra=True)
    got = sorted((str(r.doc_id), r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.digests(docs).collect())
    want = []
    for i, t, _ in corpus:
        ids = theirs.encode_ordinary(t or "")
        want.append((str(i), len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert got == sorted(want)
    # The table has a column ids of its own, which stays.
    found = bpe.encode(docs)
    assert found.columns == [*(c for c in docs.columns if c != "text"), "_ids"]
    back = bpe.decode(found, ids="_ids").collect()
    assert sorted((str(r.doc_id), r.text, r.ids) for r in back) == sorted((str(i), t or "", "x") for i, t, _ in corpus)
    whole = bpe.encoded(docs)
    assert whole.columns == [*(c for c in docs.columns if c != "text"), "_n_tokens", "_ids", "_decoded_sha256"]
    assert {r.n_tokens for r in whole.collect()} == {"x"}
    plain = bpe.decode(bpe.encode(make(corpus))).collect()
    assert sorted((str(r.doc_id), r.text) for r in plain) == sorted((str(i), t or "") for i, t, _ in corpus)
    assert bpe.digests(make([])).count() == 0
