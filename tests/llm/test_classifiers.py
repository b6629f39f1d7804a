import math
import random
import re
import zlib

import numpy as np
import pytest

from tidewell.llm import quality, toxicity


def sample(spark, make, n=900):
    rng = random.Random(6)
    word = lambda: "".join(rng.choice(["an", "the", "or", "ti", "shon", "ver"]) for _ in range(rng.randint(1, 4)))
    rows, labels = [], []
    for i in range(n):
        w = [word() for _ in range(rng.randint(20, 200))]
        bad, junk = rng.random() < 0.15, rng.random() < 0.2
        if bad:
            for _ in range(3):
                w.insert(rng.randrange(len(w)), rng.choice(["zork", "vlump", "grax"]))
        t = " ".join(x.upper() + "!!" for x in w) if junk else " ".join(w)
        rows.append((i, t, "s"))
        if rng.random() < 0.6:
            labels.append((i, int(not junk), int(bad)))
    rows += [(n, None, None), (n + 1, "", None), (n + 2, "x" * 200_000, None), (None, "the or", None), rows[0]]
    return make(rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), rows, labels


@pytest.mark.parametrize("module,column", [(toxicity, 2), (quality, 1)])
def test_held_out(spark, make, module, column):
    docs, labels, rows, known = sample(spark, make)
    got = module.score(docs, module.train(docs, labels)).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    truth = {x[0]: x[column] for x in known}
    held = [i for i in truth if zlib.crc32(str(i).encode()) % 4 == 2]
    assert held and all(by[i].held_out == (i in held) for i in truth)
    assert np.mean([by[i].predicted == truth[i] for i in held]) > 0.88
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= module.THRESHOLD) for r in got)
    # Held-out labels have no influence.
    flipped = spark.createDataFrame([(i, 1 - q, 1 - t) if i in held else (i, q, t) for i, q, t in known], "doc_id long, quality int, toxic int")
    again = {r.doc_id: r.score for r in module.score(docs, module.train(docs, flipped)).collect()}
    assert all(again[i] == pytest.approx(by[i].score) for i in by)


@pytest.mark.parametrize("module", [toxicity, quality])
def test_no_labels(spark, make, module):
    docs = make([(1, "a b", None), (2, None, None)], extra=True)
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert module.score(docs, module.train(docs, none)).count() == 2
    assert module.score(make([]), module.train(docs, none)).count() == 0


def test_ftrl_as_a_plain_loop():
    """The updates, one feature at a time in dictionaries."""
    rng = random.Random(3)
    texts = [{rng.randrange(40): np.float32(rng.random()) for _ in range(rng.randint(0, 12))} for _ in range(70)]
    good = [float(rng.random() < 0.5) for _ in texts]
    weight = [rng.choice([0.5, 1.5]) for _ in texts]
    alpha, beta, l1, l2 = 0.3, 1.0, 0.02, 0.1
    z, n = {}, {}

    def w_of(i):
        x = z.get(i, 0.0)
        return 0.0 if abs(x) <= l1 else -(x - math.copysign(l1, x)) / ((beta + math.sqrt(n.get(i, 0.0))) / alpha + l2)

    order = np.random.default_rng(3)
    for _ in range(3):
        for t in order.permutation(len(texts)).tolist():
            x = {**{i: float(v) for i, v in texts[t].items()}, "bias": 1.0}
            w = {i: w_of(i) for i in x}
            miss = (1 / (1 + math.exp(-sum(w[i] * v for i, v in x.items()))) - good[t]) * weight[t]
            for i, v in x.items():
                g, old = miss * v, n.get(i, 0.0)
                n[i] = old + g * g
                z[i] = z.get(i, 0.0) + g - (math.sqrt(n[i]) - math.sqrt(old)) / alpha * w[i]
    fs = [np.array(list(t), np.uint32) for t in texts]
    vs = [np.array(list(t.values()), np.float32) for t in texts]
    got = quality.learn(fs, vs, np.array(good), np.array(weight))
    assert got[-1] == pytest.approx(w_of("bias")) and all(got[i] == pytest.approx(w_of(i), abs=1e-12) for i in range(40))
    assert np.count_nonzero(got[40:-1]) == 0 and np.count_nonzero(got[:40]) > 20


def test_risk_as_a_plain_loop():
    """Adam on the non-negative risk, one text and one feature at a time."""
    rng = random.Random(5)
    texts = [sorted(rng.sample(range(12), rng.randint(1, 5))) for _ in range(50)]
    p_rows = [i < 15 and i % 4 != 0 for i in range(50)]
    u_rows = [i >= 15 and i % 7 != 0 for i in range(50)]
    n_p, n_u, prior, rate, decay = sum(p_rows), sum(u_rows), 0.6, 0.15, 1e-3
    soft = lambda x: math.log1p(math.exp(x))
    w, b, m, v, ascents = [0.0] * 12, math.log(prior / (1 - prior)), [0.0] * 13, [0.0] * 13, 0
    for t in range(1, 81):
        z = [sum(w[f] for f in x) + b for x in texts]
        s = [1 / (1 + math.exp(-x)) for x in z]
        negative = sum(soft(z[i]) for i in range(50) if u_rows[i]) / n_u - prior * sum(soft(z[i]) for i in range(50) if p_rows[i]) / n_p
        grad = [decay * x for x in w] + [0.0]
        ascents += negative < 0
        for i, x in enumerate(texts):
            # d/dz of the loss of a positive label is s - 1, of a negative one s.
            g = 0.0
            if p_rows[i]:
                g = prior * (s[i] - 1) / n_p - prior * s[i] / n_p if negative >= 0 else prior * s[i] / n_p
            elif u_rows[i]:
                g = s[i] / n_u if negative >= 0 else -s[i] / n_u
            for f in x:
                grad[f] += g
            grad[12] += g
        for k, g in enumerate(grad):
            m[k], v[k] = 0.9 * m[k] + 0.1 * g, 0.99 * v[k] + 0.01 * g * g
            step = rate * (m[k] / (1 - 0.9**t)) / (math.sqrt(v[k] / (1 - 0.99**t)) + 1e-8)
            if k < 12:
                w[k] -= step
            else:
                b -= step
    row = np.repeat(np.arange(50), [len(x) for x in texts])
    got, bias = toxicity._descend(np.concatenate(texts), row, np.array(p_rows), np.array(u_rows), 12, prior, 80)
    assert ascents and got == pytest.approx(w, rel=1e-6, abs=1e-9) and bias == pytest.approx(b, rel=1e-6)


def test_features_as_plain_sets():
    """Texts share as many hashes as words, beginnings of words and lengths."""
    import pyarrow as pa

    from tidewell.llm.textops import utf8

    rng = random.Random(2)
    texts = [" ".join(rng.choice(["The", "the", "notation", "nota-tion", "élan", "x1", "notations"]) for _ in range(rng.randint(0, 30))) for _ in range(40)] + ["", "??"]

    def plain(t):
        w = [x.encode() for x in re.findall(r"[a-z0-9\u0080-\U0010ffff]+", t.lower())]
        return {("w", x) for x in w} | {(k, x[:k]) for x in w for k in toxicity.PREFIXES if len(x) > k} | {("n", math.floor(2 * math.log2(len(w) + 1)))}

    h, d = toxicity.features(*utf8(pa.array(texts)))
    ours = [set(h[d == i].tolist()) for i in range(len(texts))]
    want = [plain(t) for t in texts]
    assert all(len(ours[i] & ours[j]) == len(want[i] & want[j]) for i in range(len(texts)) for j in range(len(texts)))


def test_repeated_and_odd_labels(spark, make):
    """Repeated and contradictory labels, labels out of range, null or without a document, and an id with two texts."""
    rows = [(i, f"w{i % 5} the shon {'zork' if i % 3 == 0 else 'ti'} " * 5, "s") for i in range(60)] + [(3, "another text", "s"), (3, None, "s")]
    plain = [(i, int(i % 2), int(i % 3 == 0)) for i in range(60)]
    odd = [*plain, *plain[:20], (5, 0, 1), (6, None, None), (7, 9, None), (None, 1, 1), (999, 1, 1)]
    docs, labels = make(rows, extra=True), spark.createDataFrame(odd, "doc_id long, quality int, toxic int")
    for module in (quality, toxicity):
        got = module.score(docs, module.train(docs, labels)).collect()
        assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
        one = {}
        for r in module.score(docs, module.train(docs.repartition(5), labels.repartition(3))).collect():
            one.setdefault(r.doc_id, []).append(r.score)
        assert all(any(r.score == pytest.approx(x) for x in one[r.doc_id]) for r in got)


def test_keep(spark, make):
    docs, labels, _, known = sample(spark, make, 500)
    kept = {r.doc_id for r in quality.keep(docs, quality.train(docs, labels)).collect()}
    assert np.mean([(i in kept) == bool(q) for i, q, _ in known]) > 0.95
