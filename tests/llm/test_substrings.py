import hashlib
import random

import numpy as np
import pytest

from tidewell.llm import substrings, suffix


def brute(rows, n=50):
    last = (1 << 63) - 1
    first, out = {}, []
    for i, t, _ in rows:
        b = (t or "").encode()
        for p in range(len(b) - n + 1):
            s = b[p : p + n]
            first[s] = min(first.get(s, last), last if i is None else i)
    for i, t, _ in rows:
        b = (t or "").encode()
        gone = np.zeros(len(b) + 1, bool)
        for p in range(len(b) - n + 1):
            if first[b[p : p + n]] < (last if i is None else i):
                gone[p : p + n] = True
        left = bytes(c for c, g in zip(b, gone, strict=False) if not g)
        out.append((str(i), len(b), int(gone.sum()), int((np.diff(np.r_[False, gone].astype(int)) == 1).sum()), hashlib.sha256(left).hexdigest()))
    return sorted(out)


def test_as_brute_force(make, corpus, monkeypatch):
    docs = make(corpus, extra=True)
    got = lambda: sorted((str(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in substrings.digests(docs).collect())
    want = brute(corpus)
    assert got() == want
    assert sum(w[2] for w in want) > 1000


def test_hot_names_and_long_texts(make, corpus, monkeypatch):
    """A short line in many texts, each time among other bytes, and texts cut into many pieces."""
    monkeypatch.setattr(substrings, "HOT", 20)
    monkeypatch.setattr(substrings, "CHUNK_BYTES", 3000)
    rng = random.Random(9)
    noise = lambda n: "".join(chr(rng.randrange(97, 123)) for _ in range(n))
    line, shared = noise(40), noise(70)
    rows = [(5000 + i, noise(60) + line + noise(60) + (shared if i % 3 == 0 else ""), "s") for i in range(300)]
    long = noise(9000)
    rows += [(8000, long, "s"), (8001, noise(100) + long[500:8000] + noise(100), "s"), (8002, long[2900:3100], "s"), (4999, noise(20) + line + noise(60), "s")]
    rows += corpus
    got = sorted((str(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in substrings.digests(make(rows)).collect())
    assert got == brute(rows)
    data = np.frombuffer("".join(t for _, t, _ in rows[:300]).encode(), np.uint8)
    offs = np.r_[0, np.cumsum([len(t) for _, t, _ in rows[:300]])]
    _, _, many = substrings._of_chunk(data, *substrings.stretches(data, offs), np.arange(300))
    assert many.max() > 200  # the line's name is hot


def test_rows_grow_with_the_text(make, corpus, monkeypatch):
    """Each chunk once sent a row to each block of 3 MB, so 12 times the text had 144 times the rows; a block is now sorted in parts."""
    rows = lambda total: -(-total // substrings.CHUNK_BYTES) * substrings._buckets(total)
    assert rows(10 << 30) <= 24 * rows(864 << 20)
    monkeypatch.setattr(substrings, "LEAST_BUCKETS", 1)
    monkeypatch.setattr(substrings, "SORT_BYTES", 5000)
    monkeypatch.setattr(substrings, "CHUNK_BYTES", 20_000)
    got = sorted((str(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in substrings.digests(make(corpus)).collect())
    assert got == brute(corpus)


def test_remaining_texts(make):
    twice = "é" * 30 + "x" * 30
    rows = [(2, "A" + twice + "Z", "s"), (1, twice, "s"), (3, None, None), (4, "", None)]
    out = {r.doc_id: r.text for r in substrings.removed(make(rows, extra=True)).collect()}
    assert out == {1: twice, 2: "AZ", 3: None, 4: ""}
    assert substrings.removed(make([])).count() == 0 and substrings.digests(make([])).count() == 0


@pytest.mark.parametrize("period", [16, 64])
def test_suffix_order(period):
    rng = random.Random(3)
    for k in range(40):
        n = rng.randint(0, 900)
        t = bytes(rng.choice(rng.choice([b"ab", b"a", b"abc\0", bytes(range(256))])) for _ in range(n))
        if k % 3 == 0:
            t = (t[:97] * 20)[:n]
        order = [int(i) for b in suffix.sorted_buckets(np.frombuffer(t, np.uint8), period=period, bucket=rng.choice([50, 10**4])) for i in b]
        assert order == sorted(range(n), key=lambda i: t[i:])


def test_cover():
    for v in (4, 16, 64, 100):
        d, _ = suffix.cover(v)
        assert {(a - b) % v for a in d.tolist() for b in d.tolist()} == set(range(v))
