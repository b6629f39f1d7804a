"""Toxicity by non-negative positive-unlabelled learning.

Positives are confirmed toxic texts, the rest is unlabelled text of any kind. With the class
prior p, the risk is p R+(P) + max(0, R-(U) - p R-(P)): the negative part of the unlabelled
risk is corrected by what positives among them would add, and never falls below zero; where it
would, the step ascends it instead. Several linear numpy classifiers are trained on it from
different seeds and parts of the sample, and their scores averaged.

Features are the distinct words of the whole text (ASCII other than letters and digits
separates, A-Z count as a-z) and their first 4 to 8 bytes, by 32-bit hash; those at least twice
as frequent in positives are kept. A table of BITS bits screens a text's hashes first. One more
feature tells the length, by powers of the root of 2 of the number of words, for a long text
has more chances to hold a word that toxic ones have.

The fit, in one task, sees at most POSITIVES and UNLABELLED rows, chosen by a hash of the id, of
very long texts as many as training.ENTRIES features allow; the prior is counted over all
labelled rows outside the held-out fold. Every text is scored whole.
Defined cases: null and empty texts get the score of no words; texts of any length count whole;
a null id is in fold 0; repeated rows get equal scores; repeated and contradictory labels all
count for the prior, and an id with any label 1 is a positive; with no labels at all every score
is the prior 0; ties with the threshold are predicted 1; an empty table gives none; other
columns are ignored, whatever their names.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .textops import distinct_per_doc, mix, separators, span_hashes, words
from .training import first_ids, fitted, learnable, scored, sigmoid

BITS = 22
POSITIVES = 3000
UNLABELLED = 6000
THRESHOLD = 0.3
PREFIXES = (4, 5, 6, 7, 8)
#: The features that tell a text's length.
LENGTHS = np.unique(mix(np.arange(1, 129, dtype=np.uint64) * np.uint64(0xA24BAED4963EE407)) >> np.uint64(32))
SEPARATORS = separators("".join(chr(i) for i in range(128) if not chr(i).isalnum()))
U = np.uint64


def features(data: np.ndarray, offs: np.ndarray, table: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the length, the distinct words and beginnings of words of each text, and the texts' numbers; of words those in a table of buckets alone, if given."""
    s, e, doc = words(data, offs, SEPARATORS)
    hs, ds = [], []
    for k in (0, *PREFIXES):
        on = slice(None) if not k else np.flatnonzero(e - s > k)
        h = (span_hashes(data, s[on], e[on] if not k else s[on] + k) + (U(k) << U(40))) >> U(32)
        d = doc[on]
        if table is not None:
            hit = table[_bucket(h)]
            h, d = h[hit], d[hit]
        hs.append(h)
        ds.append(d)
    n = np.bincount(doc, minlength=len(offs) - 1)
    hs.append(LENGTHS[np.floor(2 * np.log2(n + 1)).astype(np.int64)])
    ds.append(np.arange(len(n)))
    h, doc, _ = distinct_per_doc(np.concatenate(hs), np.concatenate(ds))
    return h, doc


def _bucket(h: np.ndarray) -> np.ndarray:
    return (h >> U(32 - BITS)).astype(np.int64)


def learn(y: np.ndarray, fs: list[np.ndarray], prior: float, members: int = 3, epochs: int = 80, seed: int = 5) -> tuple[np.ndarray, np.ndarray, float]:
    """Ascending feature hashes, their weights and the bias (members averaged before the sigmoid). y: 1 for positives, 0 for the unlabelled."""
    n_p, n_u, n = int((y == 1).sum()), int((y == 0).sum()), len(y)
    if not n_p or not n_u or prior <= 0:
        return np.zeros(0, np.uint32), np.zeros(0), -35.0 if prior <= 0 else float(np.log(prior / (1 - prior)))

    def telling(p: np.ndarray, u: np.ndarray) -> np.ndarray:
        """What is no likelier in positives than elsewhere can't speak for toxicity."""
        usual = (u + 1.0) * n_p / n_u
        return (p >= max(3, 0.003 * n_p)) & (p > 2.0 * usual)

    seen = np.zeros((2, 1 << BITS), np.int32)
    for k, f in zip(y, fs, strict=True):
        np.add.at(seen[1 - k], _bucket(f.astype(U)), 1)
    table = telling(seen[0], seen[1])
    table[_bucket(LENGTHS)] = True
    kept = [f[table[_bucket(f.astype(U))]] for f in fs]
    row = np.repeat(np.arange(n), [len(f) for f in kept])
    names, col = np.unique(np.concatenate(kept), return_inverse=True)
    chosen = telling(np.bincount(col[y[row] == 1], minlength=len(names)), np.bincount(col[y[row] == 0], minlength=len(names)))
    chosen |= np.isin(names, LENGTHS)
    place = np.cumsum(chosen) - 1
    keep = chosen[col]
    col, row, names = place[col[keep]], row[keep], names[chosen]
    weights, bias = np.zeros(len(names)), 0.0
    rng = np.random.default_rng(seed)
    for _ in range(members):
        part = rng.random(n) < 0.85
        w, b = _descend(col, row, part & (y == 1), part & (y == 0), len(names), prior, epochs)
        weights += w / members
        bias += b / members
    return names, weights, bias


def _descend(col, row, p_rows, u_rows, n_f, prior, epochs, rate=0.15, decay=1e-3):
    """Adam on the non-negative risk with the logistic loss. col and row: the features that texts have; p_rows, u_rows: which texts take part."""
    n = len(p_rows)
    w, b = np.zeros(n_f), float(np.log(prior / (1 - prior)))
    m, v = np.zeros(n_f + 1), np.zeros(n_f + 1)
    for t in range(1, epochs + 1):
        z = np.bincount(row, w[col], n) + b
        s = sigmoid(z)
        negative = np.logaddexp(0, z)
        corrected = negative[u_rows].mean() - prior * negative[p_rows].mean()
        g = np.zeros(n)
        if corrected >= 0:
            g[p_rows] = prior * (s[p_rows] - 1) / p_rows.sum() - prior * s[p_rows] / p_rows.sum()
            g[u_rows] = s[u_rows] / u_rows.sum()
        else:
            g[p_rows] = prior * s[p_rows] / p_rows.sum()
            g[u_rows] = -s[u_rows] / u_rows.sum()
        grad = np.r_[np.bincount(col, g[row], n_f) + decay * w, g.sum()]
        m = 0.9 * m + 0.1 * grad
        v = 0.99 * v + 0.01 * grad * grad
        step = rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
        w, b = w - step[:-1], b - step[-1]
    return w, b


def train(docs: DataFrame, labels: DataFrame) -> tuple[np.ndarray, np.ndarray, float]:
    known = learnable(labels)
    prior = known.where("toxic is not null").agg(F.avg(F.col("toxic").cast("double"))).head()[0] or 0.0
    positive = first_ids(known.where("toxic = 1"), POSITIVES, 11).select("doc_id", F.lit(1).alias("y"), "h")
    rest = first_ids(learnable(docs.select("doc_id")), UNLABELLED, 13).select("doc_id", F.lit(0).alias("y"), "h")
    prior = min(max(prior, 0.0), 0.9)

    def fit(y, fs, vs):
        names, weights, bias = learn(y, fs, prior)
        return [names, weights, np.array([bias])]

    model = fitted(docs, positive.unionAll(rest), features, fit, values=False)
    return (model[0], model[1], float(model[2][0])) if model else learn(np.zeros(0, np.int64), [], prior)


def score(docs: DataFrame, model: tuple[np.ndarray, np.ndarray, float]) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(model)

    memo: dict[str, np.ndarray] = {}

    def one(data, offs):
        names, weights, bias = shared.value
        if "table" not in memo:
            memo["table"] = np.zeros(1 << BITS, bool)
            memo["table"][_bucket(names.astype(U))] = True
        table = memo["table"]
        h, d = features(data, offs, table)
        at = np.minimum(np.searchsorted(names, h), max(0, len(names) - 1))
        hit = names[at] == h if len(names) else np.zeros(len(h), bool)
        return sigmoid(np.bincount(d[hit], weights[at[hit]], len(offs) - 1) + bias)

    return scored(docs, one, THRESHOLD)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score(docs, train(docs, table(spark, sf_dir, "labels")))
