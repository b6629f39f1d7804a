import math
import random

import numpy as np

from tidewell.llm import maxscore


def brute(rows, k=5):
    v = {}
    for i, x in rows:
        if i is not None and x is not None and all(c is not None and math.isfinite(c) for c in x):
            v.setdefault(i, set()).add(tuple(math.floor(256 * c) for c in x))
    out = []
    for q in sorted(i for i in v if i % 50 == 0):
        for a in v[q]:
            s = sorted({(-sum(x * y for x, y in zip(a, b, strict=False)), i) for i in v if i != q for b in v[i]})[:k]
            out += [(q, r + 1, i, -m) for r, (m, i) in enumerate(s)]
    return sorted(out)


def run(spark, rows, **kw):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    v = maxscore.integers(df)
    return sorted(tuple(r) for r in maxscore.search(v, v.where("vec_id % 50 = 0"), **kw).collect())


def test_as_brute_force(spark):
    rng = random.Random(5)
    rows = [(i, [float(np.float32(rng.gauss(0, 0.2))) for _ in range(24)]) for i in range(400)]
    rows += [(401, rows[3][1]), (402, rows[3][1]), (403, None), (404, [None] * 24), (405, [math.nan] * 24), (406, [math.inf] * 24), (None, rows[0][1]), rows[7], rows[7], (450, [0.0] * 24)]
    assert run(spark, rows) == brute(rows)
    assert run(spark, rows, block=3) == brute(rows)


def test_few_and_large(spark):
    assert run(spark, []) == []
    assert run(spark, [(50, [1.0])]) == []
    big = [(0, [1e6, 2e6]), (1, [3e6, 1.0]), (2, [-1e6, 4e6]), (3, [-1e6, 4e6 - 1.0])]
    assert run(spark, big) == brute(big)
    huge = [(0, [1e12, 2e12]), (1, [3e12, 1.0])]
    assert run(spark, huge) == [(0, 1, 1, 2**63 - 1)]
    short = [(0, [1.0, 1.0]), (1, [2.0]), (2, [0.5, 0.5])]
    assert run(spark, short) == brute(short)


def test_repeated_rows_take_one_place(spark):
    for scale in (1.0, 1e6):  # the second is summed in whole integers
        rows = [(50, [scale, scale])] + [(1, [9 * scale, 9 * scale])] * 6 + [(i, [scale * i / 10, scale]) for i in range(2, 9)]
        v = maxscore.integers(spark.createDataFrame(rows, "vec_id long, embedding array<float>").coalesce(1))
        got = sorted(tuple(r) for r in maxscore.search(v, v.where("vec_id = 50")).collect())
        assert [r[2] for r in got] == [1, 8, 7, 6, 5] and [r[1] for r in got] == [1, 2, 3, 4, 5]
