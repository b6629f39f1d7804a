import re
import zlib
from collections import Counter

import pytest

from tidewell.llm import mixing, sharding

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def targets(size):
    order = sorted((s for s in size if s is not None)) + [None] * (None in size)
    w = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    total, full = 1.5 * sum(size.values()), set()
    while True:
        left = total - sum(2 * size[s] for s in full)
        rest = sum(w[s] for s in order if s not in full)
        t = {s: 2.0 * size[s] if s in full else left * w[s] / rest for s in order}
        over = {s for s in order if s not in full and t[s] > 2 * size[s]}
        if not over:
            return t
        full |= over


def test_mixing(make, corpus):
    rows = mixing.plan(make(corpus, extra=True)).collect()
    n = {}
    for _, t, s in corpus:
        n[s] = n.get(s, 0) + len(WORD.findall(t or ""))
    want = targets(n)
    size = Counter((str(i), len(WORD.findall(t or "")), n[s]) for i, t, s in corpus)
    assert Counter((str(r.doc_id), r.size, r.source_size) for r in rows) == size
    by = {n[s]: want[s] for s in n}
    assert all(r.target == pytest.approx(by[r.source_size]) for r in rows)
    for r in rows:
        rate = r.target / r.source_size
        assert r.taken in (r.size * int(rate), r.size * (int(rate) + 1)) and r.taken <= 2 * r.size
    again = mixing.plan(make(corpus).repartition(7)).collect()
    assert Counter((str(r.doc_id), r.taken) for r in again) == Counter((str(r.doc_id), r.taken) for r in rows)
    copies = mixing.copies(make(corpus, extra=True))
    taken = Counter(str(r.doc_id) for r in copies.collect())
    for r in rows:
        if r.size and r.doc_id is not None and r.doc_id != 7:
            assert taken[str(r.doc_id)] == r.taken // r.size
    assert copies.columns == make(corpus, extra=True).columns
    assert mixing.plan(make([])).count() == 0 and mixing.copies(make([])).count() == 0


@pytest.mark.parametrize("extra", [False, True])
def test_sharding(make, corpus, extra):
    rows = sharding.interleave(make(corpus, extra)).collect()
    raw = lambda t: (t or "").encode()
    assert Counter((str(r.doc_id), r["size"], r.text_crc32) for r in rows) == Counter((str(i), len(raw(t)) + 8, zlib.crc32(raw(t))) for i, t, _ in corpus)
    n = Counter(r.shard for r in rows)
    assert set(n) == set(range(24)) and max(n.values()) - min(n.values()) <= 1
    for s in n:
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(n[s]))


def test_shards_match_the_mixture(make):
    rows = [(i, f"t{i}", "hot" if i % 3 == 0 else f"s{i % 7}" if i % 5 else None) for i in range(1200)]
    source = {i: s for i, _, s in rows}
    share = Counter(source.values())
    got = sharding.interleave(make(rows)).collect()
    for s in range(24):
        own = Counter(source[r.doc_id] for r in got if r.shard == s)
        assert all(abs(own[k] - share[k] / 24) <= 1.5 for k in share)


def test_few(make):
    assert sharding.interleave(make([])).count() == 0
    assert sorted(tuple(r)[3:] for r in sharding.interleave(make([(1, "a", None), (2, "b", None)])).collect()) == [(0, 0), (12, 0)]
