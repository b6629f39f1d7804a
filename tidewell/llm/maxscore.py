"""Exact top-k inner products by MaxScore.

Vectors are read as postings: component t of a vector is the weight of term t. In each shard of
candidates the weights of a term have a least and a greatest value, so a query's gain from a
term lies between two bounds; with the lower bounds as the base, every gain is at least 0 and
its upper bound is the term's score bound. Query terms are ordered by score bound. The
essential ones are the leading terms whose bounds, left out together, could lift a vector that
has none of them to the query's k-th score so far: the rest alone can't. Essential postings are
traversed for the whole shard; the other terms are probed in runs, only for vectors whose sum
so far and the bounds still open reach that score. Shards of a task pass the k-th score on, and
the best k of every task are merged.

Queries are taken in blocks of QUERIES at most; a block is the only thing sent to every task.
Scores are integers below 2 ** 53 in absolute value, where double arithmetic is exact; larger
ones are summed as Python integers, without bounds, and end at the limits of a long.

Defined cases: vectors that are null or hold null, NaN or infinite components take no part,
nor do rows with a null id; a query's own rows (all that have its id) are no candidates for it;
repeated rows count once; shorter vectors end in zeros; ties go to the smaller id; an empty
table gives none.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, table

K = 5
EVERY = 50
SCALE = 256
SHARD = 4096
QUERIES = 8192
RUN = 8


class Tops:
    """The k best (score descending, id ascending) candidates of each query, repeated pairs once."""

    def __init__(self, n: int, k: int):
        self.k = k
        self.score = np.full((n, k), -np.inf, np.longdouble)  # holds 64-bit integers
        self.id = np.full((n, k), np.iinfo(np.int64).max)

    def least(self, q: int) -> float:
        return self.score[q, -1]

    def add(self, q: int, ids: np.ndarray, scores: np.ndarray) -> None:
        s, i = np.r_[self.score[q], scores], np.r_[self.id[q], ids]
        best = np.lexsort((i, -s))
        s, i = s[best], i[best]
        new = np.r_[True, (s[1:] != s[:-1]) | (i[1:] != i[:-1])]
        s, i = s[new][: self.k], i[new][: self.k]
        # Found pairs never get fewer, so places from len(s) on are still free.
        self.score[q, : len(s)], self.id[q, : len(s)] = s, i


def search_shard(q_ids: np.ndarray, q: np.ndarray, ids: np.ndarray, x: np.ndarray, tops: Tops) -> None:
    """Offer the vectors of one shard to every query."""
    low, high = x.min(0), x.max(0)
    columns = np.ascontiguousarray(x.T)
    ends = np.stack([q * low, q * high])
    base, bound = ends.min(0), np.abs(ends[1] - ends[0])
    order = np.argsort(-bound, axis=1, kind="stable")
    for i in range(len(q)):
        least, o = tops.least(i), order[i]
        # open_[j]: what the terms from the j-th on can add to the sum so far, and their base.
        b = bound[i, o] + base[i, o]
        open_ = np.r_[np.cumsum(b[::-1])[::-1], 0.0]
        floor = np.r_[0.0, np.cumsum(base[i, o])]
        if open_[0] < least:
            continue
        essential = int(np.argmax(floor + open_ < least)) if least > -np.inf and (floor + open_ < least).any() else len(o)
        own = o[:essential]
        at, sums = None, q[i, own] @ columns[own]
        j = essential
        while True:
            keep = sums + open_[j] >= least
            if not keep.all():
                at = np.flatnonzero(keep) if at is None else at[keep]
                sums = sums[keep]
            if j == len(o) or not len(sums):
                break
            terms = o[j : j + RUN]
            probed = columns[terms] if at is None else columns[terms][:, at]
            sums = sums + q[i, terms] @ probed
            j = min(len(o), j + RUN)
        if len(sums):
            found = ids if at is None else ids[at]
            other = found != q_ids[i]
            tops.add(i, found[other], sums[other])


def integers(df: DataFrame, id_: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """vec_id and the components floor(SCALE * x), of the rows that take part."""
    v = F.col(vector)
    sound = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < F.lit(float("inf"))))
    whole = F.transform(v, lambda x: F.floor(F.lit(float(SCALE)) * x.cast("double")).cast("double"))
    return df.where(v.isNotNull() & F.col(id_).isNotNull() & sound).select(F.col(id_).cast("long").alias("vec_id"), whole.alias("v"))


def _matrix(column, width: int) -> np.ndarray:
    values = column.flatten().to_numpy(zero_copy_only=False)
    sizes = np.diff(column.offsets.to_numpy())
    if len(sizes) and (sizes == width).all():
        return values.reshape(-1, width)
    out = np.zeros((len(sizes), width))
    for i, (a, n) in enumerate(zip(np.r_[0, np.cumsum(sizes)[:-1]] if len(sizes) else [], sizes, strict=True)):
        out[i, : min(n, width)] = values[a : a + min(n, width)]
    return out


def _exact(q_ids, q, ids, x, tops) -> None:
    """The same by whole integers, for components too large for doubles."""
    for i in range(len(q)):
        s = [sum(int(a) * int(b) for a, b in zip(q[i], row, strict=True)) for row in x]
        s = [max(-(1 << 63) + 1, min((1 << 63) - 1, v)) for v in s]
        best = sorted({(-v, int(d)) for v, d in zip(s, ids, strict=True) if d != q_ids[i]})[: tops.k]
        tops.add(i, np.array([d for _, d in best], np.int64), np.array([-v for v, _ in best], np.longdouble))


def search(vectors: DataFrame, queries: DataFrame, k: int = K, block: int = QUERIES) -> DataFrame:
    """query_id, rank, vec_id and score of the k best of vectors for each of queries (both vec_id and v)."""
    spark = vectors.sparkSession
    queries = cut(queries.distinct())
    n, width = queries.agg(F.count("*"), F.max(F.size("v"))).head()
    parts = None
    edges = queries.approxQuantile("vec_id", [i / -(-n // block) for i in range(1, -(-n // block))], 0.0) if n > block else []
    edges = [None, *sorted(set(edges)), None]
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        own = queries if a is None else queries.where(F.col("vec_id") > a)
        rows = sorted((own if b is None else own.where(F.col("vec_id") <= b)).collect())
        if not rows:
            continue
        q = np.zeros((len(rows), width))
        for i, r in enumerate(rows):
            q[i, : len(r.v)] = r.v
        shared = spark.sparkContext.broadcast((np.array([r.vec_id for r in rows], np.int64), q))

        def run(batches, shared=shared):
            ids, q = shared.value
            tops = Tops(len(ids), k)
            held, held_n = [], 0

            def flush():
                t = pa.Table.from_batches(held).combine_chunks()
                x = _matrix(t.column("v").combine_chunks() if t.column("v").num_chunks != 1 else t.column("v").chunk(0), q.shape[1])
                at = t.column("vec_id").to_numpy()
                for i in range(0, len(at), SHARD):
                    one = x[i : i + SHARD]
                    small = np.abs(one).max(initial=0) * np.abs(q).max(initial=0) * q.shape[1] < 2.0**52
                    (search_shard if small else _exact)(ids, q, at[i : i + SHARD], one, tops)

            for b in batches:
                if b.num_rows:
                    held.append(b)
                    held_n += b.num_rows
                if held_n >= 4 * SHARD:
                    flush()
                    held, held_n = [], 0
            if held:
                flush()
            a, c = np.nonzero(tops.score > -np.inf)
            yield pa.RecordBatch.from_arrays([pa.array(ids[a]), pa.array(tops.id[a, c]), pa.array(tops.score[a, c].astype(np.int64))], ["query_id", "vec_id", "score"])

        found = vectors.mapInArrow(run, "query_id long, vec_id long, score long")
        parts = found if parts is None else parts.unionAll(found)
    if parts is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    # Repeated rows can reach the end from several tasks.
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return parts.distinct().withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = integers(table(spark, sf_dir, "embeddings"))
    return search(vectors, vectors.where(F.col("vec_id") % EVERY == 0))


ORACLE = """
WITH e AS (SELECT vec_id, [CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len([1 FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum([q.v[i] * c.v[i] FOR i IN range(1, len(q.v) + 1)]) AS BIGINT) AS score
  FROM e q JOIN e c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0),
r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INT) AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
