import random
import re

import pytest

from tidewell.llm import minhash
from tidewell.llm.graph import components

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows):
    sets = []
    for i, t, _ in rows:
        w = WORD.findall((t or "").translate(LOW))
        sets.append((i, frozenset(tuple(w[j : j + 5]) for j in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)]) if w else frozenset()))
    parent = {i: i for i, _ in sets if i is not None}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for n, (i, s) in enumerate(sets):
        for j, u in sets[:n]:
            if s and u and i is not None and j is not None and 100 * len(s & u) >= 75 * len(s | u):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return sorted((str(i), len(s), str(find(i) if i is not None else None), i is None or find(i) == i) for i, s in sets)


def got(df):
    return sorted((str(r.doc_id), r.n_shingles, str(r.component_id), r.kept) for r in df.collect())


def test_as_brute_force(make, corpus):
    assert got(minhash.near_duplicates(make(corpus, extra=True))) == brute(corpus)


def test_bridged_groups(make, monkeypatch):
    """Copies at the edge of the threshold, linked through one another alone; long lists go in blocks and tiles."""
    monkeypatch.setattr(minhash, "BLOCK", 7)
    monkeypatch.setattr(minhash, "TILE", 9)
    rng = random.Random(8)
    w = [f"w{rng.randrange(10**6)}" for _ in range(100)]
    rows = []
    for i in range(60):
        rows.append((i, " ".join(w), "s"))
        w = list(w)
        for _ in range(2):
            w[rng.randrange(100)] = f"w{rng.randrange(10**6)}"
    passage = " ".join(f"p{i}" for i in range(60))
    rows += [(100 + i, passage + " " + " ".join(f"w{rng.randrange(10**6)}" for _ in range(rng.randint(20, 60))), "s") for i in range(40)]
    rng.shuffle(rows)
    assert got(minhash.near_duplicates(make(rows))) == brute(rows)


def test_one_stays(make, corpus):
    kept = minhash.keep_one(make(corpus, extra=True))
    assert kept.columns == make(corpus, extra=True).columns
    want = sorted(i for i, _, _, k in brute(corpus) if k)
    want.remove("7")  # two rows with one id and text
    assert sorted(str(r.doc_id) for r in kept.collect()) == want
    assert minhash.near_duplicates(make([])).count() == 0
    assert minhash.near_duplicates(make([(1, None, None)])).count() == 1


def test_one_id_with_two_texts(make):
    """They are one document: 2 is linked with 1 by one of its texts and with 3 by the other."""
    a, b, c = (" ".join(f"{x}{i}" for i in range(40)) for x in "abc")
    rows = [(1, a, "s"), (2, a, "s"), (2, b, "s"), (3, b, "s"), (3, b, "s"), (4, "c", "s"), (4, "c", "s"), (5, c, "s"), (5, None, "s"), (None, a, "s"), (None, a, "s")]
    docs = make(rows, extra=True)
    assert got(minhash.near_duplicates(docs)) == brute(rows)
    kept = sorted((str(r.doc_id), str(r.text)) for r in minhash.keep_one(docs).collect())
    assert kept == sorted([("1", a), ("4", "c"), ("5", c), ("5", "None"), ("None", a), ("None", a)])


def test_long_lists_in_runs(make, monkeypatch):
    monkeypatch.setattr(minhash, "HELD", 50)
    monkeypatch.setattr(minhash, "BLOCK", 30)
    rng = random.Random(4)
    base = [f"w{i}" for i in range(200)]
    rows = [(i, " ".join([*base, *(f"v{rng.randrange(10**6)}" for _ in range(rng.choice([3, 20, 40])))]), "s") for i in range(400)]
    assert got(minhash.near_duplicates(make(rows))) == brute(rows)


@pytest.mark.parametrize("seed", range(3))
def test_components(spark, seed):
    rng = random.Random(seed)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(150)] + [(i, i + 1) for i in range(300, 340)]
    parent = {x: x for e in edges for x in e}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    want = {x: find(x) for e in edges if e[0] != e[1] for x in e}
    rows = components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert {r.id: r.component for r in rows} == want and len(rows) == len(want)
