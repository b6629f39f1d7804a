"""Quality by hashed word n-gram logistic regression, trained with follow-the-regularised-leader updates.

A text is cut into words, numbers and runs of punctuation. Features are hashed runs of one and
two of these as written (A-Z as a-z), and of one to three of their shapes (upper, lower or
mixed case, digits, the punctuation itself, and whether the word before is the same). A
feature's value is the root of its share of the text, so texts of any length compare. Training
is FTRL-proximal, one text at a time; the weights are sparse and a score is a sparse dot product.

The fit, in one task, sees at most PER_CLASS texts of each class, chosen by a hash of the id and
weighted back to the classes' shares among all labelled rows outside the held-out fold; of very
long ones as many as training.ENTRIES features allow.
Defined cases: null and empty texts score by the bias alone; texts of any length are scored whole;
a null id is in fold 0; repeated rows score alike; an id labelled with both classes is learnt
once in each, and labels repeated within a class count once; other labels than 0 and 1 (null
among them) and labels without a document are left out; with no labels every score is 0.5 or,
with one class, that class's; ties with the threshold are predicted 1; an empty table gives none;
other columns are carried by keep() and ignored by score(), whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .textops import SPACES, distinct_per_doc, frugal, shingles, slices, span_hashes, utf8
from .training import first_ids, fitted, learnable, scored, sigmoid

BITS = 20
PER_CLASS = 2500
THRESHOLD = 0.7
U = np.uint64

#: Byte classes: 0 space, 1 letter (and all of UTF-8 beyond ASCII), 2 digit, 3 other.
_CLASS = np.full(256, 3, np.uint8)
_CLASS[SPACES] = 0
_CLASS[[*range(65, 91), *range(97, 123), *range(128, 256)]] = 1
_CLASS[48:58] = 2
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_LOWER = np.zeros(256, bool)
_LOWER[97:123] = True


def tokens(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends, texts and classes of the runs of one class of bytes."""
    n = len(data)
    c = _CLASS[data]
    new = np.zeros(n, bool)
    new[1:] = c[1:] != c[:-1]
    new[offs[:-1][offs[:-1] < n]] = True
    s = np.flatnonzero(new)
    e = np.r_[s[1:], n]
    keep = c[s] > 0
    s, e = s[keep], e[keep]
    return s, e, np.searchsorted(offs, s, "right") - 1, c[s]


def features(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets, texts and values."""
    if not len(data):
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(0)
    s, e, doc, kind = tokens(data, offs)
    h = span_hashes(data, s, e)
    upper = np.r_[0, np.cumsum(_UPPER[data])]
    lower = np.r_[0, np.cumsum(_LOWER[data])]
    up, low = upper[e] - upper[s], lower[e] - lower[s]
    shape = np.where(kind == 3, h | U(1), kind.astype(U) * U(64) + (up > 0).astype(U) * U(4) + (up > 1).astype(U) * U(8) + (low > 0).astype(U) * U(16))
    # The word before, over any punctuation between.
    is_word = np.flatnonzero(kind == 1)
    same = np.zeros(len(h), bool)
    if len(is_word) > 1:
        a, b = is_word[:-1], is_word[1:]
        same[b] = (h[a] == h[b]) & (doc[a] == doc[b])
    shape = shape + same.astype(U) * U(1 << 20)
    total = np.bincount(doc, minlength=len(offs) - 1)
    hs, ds = [], []
    for source, runs in ((h, (1, 2)), (shape, (1, 2, 3))):
        for k in runs:
            x, d = shingles(source + U(k * 7919), doc, k, short=False)
            hs.append(x)
            ds.append(d)
    x, d, n = distinct_per_doc((np.concatenate(hs) >> U(64 - BITS)).astype(np.int64), np.concatenate(ds))
    return x, d, np.sqrt(n / total[d])


def learn(fs: list[np.ndarray], vs: list[np.ndarray], good: np.ndarray, weight: np.ndarray, epochs: int = 3, alpha: float = 0.3, beta: float = 1.0, l1: float = 0.02, l2: float = 0.1) -> np.ndarray:
    """Weights by bucket, the bias last, after a fixed order of texts with features fs of the values vs."""
    z, n = np.zeros((1 << BITS) + 1), np.zeros((1 << BITS) + 1)

    def lazy(i):
        return np.where(np.abs(z[i]) <= l1, 0.0, -(z[i] - np.sign(z[i]) * l1) / ((beta + np.sqrt(n[i])) / alpha + l2))

    rng = np.random.default_rng(3)
    for _ in range(epochs):
        for t in rng.permutation(len(fs)).tolist():
            i = np.append(fs[t].astype(np.int64), 1 << BITS)
            x = np.append(vs[t].astype(np.float64), 1.0)
            w = lazy(i)
            g = (sigmoid(w @ x) - good[t]) * weight[t] * x
            root = np.sqrt(n[i])
            n[i] += g * g
            z[i] += g - (np.sqrt(n[i]) - root) / alpha * w
    return lazy(np.arange((1 << BITS) + 1))


def train(docs: DataFrame, labels: DataFrame) -> tuple[np.ndarray, float]:
    known = learnable(labels).where("quality in (0, 1)")
    count = {r.quality: r.n for r in known.groupBy("quality").agg(F.count("*").alias("n")).collect()}
    chosen = [first_ids(known.where(F.col("quality") == q), PER_CLASS, 21 + q).select("doc_id", F.lit(q).alias("y"), "h") for q in (0, 1)]

    def fit(y, fs, vs):
        taken = np.bincount(y, minlength=2)
        weight = np.array([count.get(k, 0) / taken[k] for k in y.tolist()])
        w = learn(fs, vs, y.astype(np.float64), weight / weight.mean())
        on = np.flatnonzero(w)
        return [on.astype(np.int32), w[on].astype(np.float32)]

    model = fitted(docs, chosen[0].unionAll(chosen[1]), features, fit, values=True)
    w = np.zeros((1 << BITS) + 1, np.float32)
    if model:
        w[model[0]] = model[1]
    return w[:-1], float(w[-1])


def score(docs: DataFrame, model: tuple[np.ndarray, float]) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def one(data, offs):
        weights, bias = shared.value
        f, d, v = features(data, offs)
        return sigmoid(np.bincount(d, weights[f] * v, len(offs) - 1) + bias)

    return scored(docs, one, THRESHOLD)


def keep(docs: DataFrame, model: tuple[np.ndarray, float], threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs whose text scores threshold or more, with all their columns."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names = docs.columns

    def run(batches):
        weights, bias = shared.value
        for batch in batches:
            for part in slices(batch, "text"):
                f, d, v = features(*utf8(part.column("text")))
                s = sigmoid(np.bincount(d, weights[f] * v, part.num_rows) + bias)
                good = pa.array(s >= threshold)
                yield pa.RecordBatch.from_arrays([part.column(n).filter(good) for n in names], names)

    return docs.mapInArrow(frugal(run), docs.schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score(docs, train(docs, table(spark, sf_dir, "labels")))
