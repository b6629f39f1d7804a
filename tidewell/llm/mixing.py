r"""Mixing sources to target weights.

Words ([^\x20\x09-\x0D]+) are counted for each document and summed for each source. Sources in
code point order (null last) weigh 3, 1, 2, repeating, and share 150 % of all words; no target
exceeds twice its source's words, and the excess is shared anew by weight. That is one level
for all sources: with the sources in order of their cap by weight, those whose cap lies below
the level so far are full, and the level is what is left by the weight that is left.

rate = target / words of the source. A document is emitted floor(rate) times, and once more if
a draw from the md5 of the seed and its id lies below the fraction, so reruns and any
partitioning agree and the expected words of a source are its target.

Defined cases: null and empty texts have size 0 and are drawn like others; a null source is a
source; a null id draws as the text "null"; very long texts count whole; repeated rows draw alike;
an empty table gives none; further columns are carried by copies() and ignored by plan(), whatever
their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD, cut, fresh, maybe_broadcast, table

WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST = 2
SEED = "mix-1"


def n_words(text: str = "text"):
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """source, source_size and target from rows of (source, size). The windows run over one row a source."""
    s = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    i = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    w = F.element_at(F.array(*map(F.lit, weights)), (i % len(weights) + 1).cast("int")).cast("long")
    s = s.select("source", "source_size", i.alias("i"), w.alias("w"))
    rest = Window.orderBy((F.lit(float(most)) * F.col("source_size") / F.col("w")), "i")
    whole = Window.partitionBy()
    s = s.select(
        "source",
        "source_size",
        "i",
        "w",
        F.coalesce(F.sum(F.col("source_size") * most).over(rest.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("full"),
        F.sum("w").over(rest.rowsBetween(Window.currentRow, Window.unboundedFollowing)).alias("left"),
        F.sum("source_size").over(whole).alias("total"),
    )
    level = (F.lit(share) * F.col("total") - F.col("full")) / F.col("left")
    s = s.withColumn("level", level).withColumn("capped", F.col("source_size") * most <= F.col("level") * F.col("w"))
    s = s.withColumn("at", F.min(F.when(~F.col("capped"), F.struct(F.lit(float(most)) * F.col("source_size") / F.col("w"), "i", "level"))).over(whole))
    return s.select(
        "source",
        "source_size",
        F.when(F.col("at").isNull() | F.col("capped"), F.col("source_size").cast("double") * most).otherwise(F.col("at.level") * F.col("w")).alias("target"),
    )


def n_copies(rate, doc_id: str = "doc_id", seed: str = SEED):
    """floor(rate) plus one hash-seeded Bernoulli copy of probability rate - floor(rate)."""
    drawn = F.conv(F.substring(F.md5(F.concat(F.lit(seed + ":"), F.coalesce(F.col(doc_id).cast("string"), F.lit("null")))), 1, 8), 16, 10).cast("long") / F.lit(4294967296.0)
    return (F.floor(rate) + F.when(drawn < rate - F.floor(rate), 1).otherwise(0)).cast("long")


def _rated(left: DataFrame, sized: DataFrame) -> tuple[DataFrame, list[str], Column]:
    """left with its source's size and target, their names, and the rate; a source that is null matches itself."""
    k, s, t = fresh(left, "the_key", "the_size", "the_target")
    key = F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit("-"))
    of = cut(targets(sized).select(key.alias(k), F.col("source_size").alias(s), F.col("target").alias(t)))
    rate = F.when(F.col(s) > 0, F.col(t) / F.col(s)).otherwise(F.lit(0.0))
    return left.withColumn(k, key).join(maybe_broadcast(of), k, "left"), [s, t], rate


def plan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """doc_id, size, source_size, target and taken of every document."""
    sized = cut(docs.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), n_words(text).alias("size")))
    rows, (s, t), rate = _rated(sized, sized)
    return rows.select("doc_id", "size", F.col(s).alias("source_size"), F.col(t).alias("target"), (F.col("size") * n_copies(rate)).alias("taken"))


def copies(docs: DataFrame) -> DataFrame:
    """The mixed corpus: each row of docs as often as the mix takes it, with the columns of docs."""
    sized = cut(docs.select("source", n_words().alias("size")).groupBy("source").agg(F.sum("size").alias("size")))
    rows, _, rate = _rated(docs, sized)
    return rows.select(*docs.columns, F.explode(F.array_repeat(F.lit(1), n_copies(rate).cast("int"))).alias(fresh(docs, "the_copy")[0])).select(*docs.columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plan(table(spark, sf_dir, "documents"))


ORACLE = r"""
WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT source, source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS i FROM s),
x AS (SELECT *, CAST([3, 1, 2][CAST(i % 3 AS INT) + 1] AS BIGINT) AS w FROM w),
y AS (SELECT *, 2.0::DOUBLE * source_size / w AS r, CAST(sum(source_size) OVER () AS DOUBLE) AS total,
  coalesce(sum(source_size * 2) OVER (ORDER BY 2.0::DOUBLE * source_size / w, i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE AS fullsum,
  (sum(w) OVER (ORDER BY 2.0::DOUBLE * source_size / w, i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS restw FROM x),
z AS (SELECT *, (1.5::DOUBLE * total - fullsum) / restw AS level FROM y),
c AS (SELECT *, source_size * 2 <= level * w AS capped FROM z),
t AS (SELECT source, source_size,
  CASE WHEN capped THEN source_size::DOUBLE * 2 ELSE (SELECT level FROM c WHERE NOT capped ORDER BY r, i LIMIT 1) * w END AS target FROM c),
j AS (SELECT d.doc_id, d.size, t.source_size, t.target, CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0.0 END AS rate,
  CAST('0x' || substr(md5('mix-1:' || coalesce(d.doc_id::VARCHAR, 'null')), 1, 8) AS BIGINT) / 4294967296.0::DOUBLE AS u
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
  CAST(size * (floor(rate) + CASE WHEN u < rate - floor(rate) THEN 1 ELSE 0 END) AS BIGINT) AS taken FROM j
"""
