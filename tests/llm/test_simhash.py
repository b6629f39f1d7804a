import hashlib
import math
import re
from itertools import combinations

from collections import Counter

import numpy as np
import pytest

from tidewell.llm import simhash


WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def in_order(spark, rows):
    """By id, null first; rows that share one by the hash of their text."""
    df = spark.createDataFrame([(n, t) for n, (_, t, _) in enumerate(rows)], "n int, text string")
    th = {r.n: r.th for r in df.selectExpr("n", "xxhash64(text) AS th").collect()}
    order = sorted(range(len(rows)), key=lambda n: (rows[n][0] is not None, rows[n][0] or 0, th[n]))
    return [rows[n] for n in order]


def plain_fingerprint(text):
    """Votes of every run of three words (or of all words, if fewer), bit by bit; the hash alone is taken from the package."""
    import pyarrow as pa

    from tidewell.llm.textops import mix, shingles, span_hashes, utf8, words

    w = WORD.findall(text.translate(LOW))
    terms = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2)) if len(w) >= 3 else Counter([tuple(w)] if w else [])
    sums = [0.0] * 128
    for term, n in terms.items():
        data, offs = utf8(pa.array([" ".join(term)], pa.large_string()))
        s, e, doc = words(data, offs)
        (h,), _ = shingles(span_hashes(data, s, e), doc, 3)
        second = mix(np.array([h], np.uint64) + np.uint64(0x9E3779B97F4A7C15))[0]
        raw = int(h).to_bytes(8, "little") + int(second).to_bytes(8, "little")
        for k in range(128):
            sums[k] += (1 + math.log(n)) * (1 if raw[k // 8] >> (7 - k % 8) & 1 else -1)
    return "".join("1" if x > simhash.TIE else "0" for x in sums)


def bits(fingerprint):
    return "".join(f"{int(c, 16):04b}" for c in fingerprint)


def near(a, b):
    h = sum(x != y for x, y in zip(a, b, strict=True))
    return max(0.0, math.cos(math.pi * h / 128)) if h else 1.0


def test_edits(spark, make, corpus):
    rows = in_order(spark, corpus)
    texts = [t or "" for _, t, _ in rows]
    docs = make(corpus, extra=True)
    parts = simhash.successors(docs, simhash_run(), "doc_id long, edited string", 2000).collect()
    for size in (1, 1 << 30):
        again = simhash.successors(docs, simhash_run(), "doc_id long, edited string", size).collect()
        assert sorted((str(r.doc_id), r.edited) for r in again) == sorted((str(r.doc_id), r.edited) for r in parts)
    whole = simhash.edits(docs).collect()
    want = []
    for (i, _, _), t, f in zip(rows, texts, texts[1:] + texts[:1], strict=True):
        n = len(t) // 4
        want.append((str(i), t[: len(t) - n] + f[:n]))
    assert sorted((str(r.doc_id), r.edited) for r in parts) == sorted(want)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert sorted((str(r.doc_id), r.n_chars, r.edited_sha256) for r in whole) == sorted((i, len(e), sha(e)) if False else (i, len(t or ""), sha(e)) for (i, e), t in zip(want, texts, strict=True))
    by_text = {}
    for r in whole:
        if r.doc_id is not None:
            by_text.setdefault(dict((a, b) for a, b, _ in corpus if a is not None)[r.doc_id], set()).add(r.fingerprint)
    assert all(len(v) == 1 for v in by_text.values())
    long = [r for r in whole if r.n_chars > 200]
    assert np.mean([r.near_edited for r in long]) > 0.6 and all(0 <= x <= 1 for r in whole for x in (r.near_edited, r.near_next))


def test_fingerprints_and_likeness_as_plain_loops(spark, make, corpus):
    rows = in_order(spark, [r for r in corpus if len(r[1] or "") < 2000])
    texts = [t or "" for _, t, _ in rows]
    got = {}
    for r in simhash.with_near(simhash.edits(make(rows))).collect():
        got.setdefault(str(r.doc_id), []).append(r)
    own = [plain_fingerprint(t) for t in texts]
    count = Counter(own)
    for n, (i, _, _) in enumerate(rows):
        t, f = texts[n], texts[(n + 1) % len(texts)]
        edited = plain_fingerprint(t[: len(t) - len(t) // 4] + f[: len(t) // 4])
        close = sum(m for x, m in count.items() if sum(a != b for a, b in zip(x, own[n], strict=True)) <= simhash.RADIUS) - 1
        want = (own[n], edited, pytest.approx(near(own[n], edited)), pytest.approx(near(own[n], own[(n + 1) % len(own)])), close)
        assert [] != [r for r in got[str(i)] if (bits(r.fingerprint), bits(r.edited_fingerprint), r.near_edited, r.near_next, r.n_near) == want], (i, t[:40], want, [(bits(r.fingerprint), bits(r.edited_fingerprint), r.near_edited, r.near_next, r.n_near) for r in got[str(i)]])
    assert any(r.n_near for x in got.values() for r in x)


def simhash_run():
    import pyarrow as pa

    def run(ids, texts, following):
        after = [*texts[1:], following]
        return pa.table({"doc_id": pa.array(ids, pa.int64()), "edited": pa.array([t[: len(t) - len(t) // 4] + f[: len(t) // 4] for t, f in zip(texts, after, strict=True)], pa.string())})

    return run


def test_few(make):
    assert simhash.edits(make([])).count() == 0 and simhash.with_near(simhash.edits(make([]))).count() == 0
    r = simhash.edits(make([(5, "abcd efgh", None)])).head()
    assert r.edited_sha256 == hashlib.sha256(b"abcd efab").hexdigest() and r.near_next == 1.0


def test_near_pairs(spark):
    rng = np.random.default_rng(2)
    base = rng.integers(0, 256, (12, 16), np.uint8)
    rows = [b.copy() for b in base]
    for b in base:
        for _ in range(6):
            x = np.unpackbits(b)
            x[rng.choice(128, rng.integers(0, 6), replace=False)] ^= 1
            rows.append(np.packbits(x))
    hexes = [r.tobytes().hex() for r in rows]
    bits = {h: np.unpackbits(np.frombuffer(bytes.fromhex(h), np.uint8)) for h in hexes}
    want = {(a, b, int((bits[a] != bits[b]).sum())) for a, b in combinations(sorted(bits), 2) if (bits[a] != bits[b]).sum() <= 3}
    df = spark.createDataFrame([(h,) for h in hexes], "fingerprint string")
    for tile in (2000, 3):
        got = simhash.near_pairs(df, 3, tile=tile).collect()
        assert {tuple(r) for r in got} == want and len(got) == len(want)
    rows = df.unionAll(df.limit(20))
    size = Counter(r.fingerprint for r in rows.collect())
    near_by = {h: size[h] - 1 for h in size}
    for a, b, _ in want:
        near_by[a] += size[b]
        near_by[b] += size[a]
    for tile in (2000, 3):
        assert {r.fingerprint: r.n_near for r in simhash.near_counts(rows, 3, tile=tile).collect()} == {h: n for h, n in near_by.items() if n}
    wide = simhash.near_pairs(df, 3, blocks=5).collect()
    assert {tuple(r) for r in wide} == want and len(wide) == len(want)
