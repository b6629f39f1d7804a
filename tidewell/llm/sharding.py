"""Sharding by proportional stratified interleaving, in DataFrame operations only.

Rows of each source are put in a seeded random order and ranked; the fractional rank
(rank - u) / n, with one seeded u in (0, 1) a source, spreads every source evenly over
0 to 1. Sorted by it, any contiguous cut holds the sources in the corpus's own mixture.
The law is `rows`: the sorted rows are cut so that the counts of two shards differ by one at most.

No rank is taken over a whole source or over all rows in one task: a rank is the number of
rows in earlier hash buckets, from a table of counts, and the place in one's own bucket.
A hot source simply fills more buckets.

Rows without a doc_id are put in order by a hash of their text, and so are rows that share one, so
neither fill one bucket.

Defined cases: a null text has size 8 and crc32 0; texts of any length count whole; a null source
is a source of its own; ids and texts may repeat: rows that agree in all three columns are dealt
like others, each with its own slot; an empty table gives no rows; columns other than the three
used are ignored, whatever their names. The law looks at counts alone, so equal texts (the groups
of the contract) can lie in different shards: rows of one text that a third of the corpus has
could not stay together while counts differ by one at most.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, table

SHARDS = 24
ROWS_PER_BUCKET = 10_000
LEAST_BUCKETS = 1024


def _number(seed: int, text: Column) -> Column:
    """A seeded hash of 60 bits, the same in every engine."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), text)), 1, 15), 16, 10).cast("long")


def interleave(docs: DataFrame, shards: int = SHARDS, seed: int = 17, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """doc_id, size, text_crc32, shard and slot of every row."""
    raw = F.coalesce(F.col(text).cast("binary"), F.lit("").cast("binary"))
    key = F.when(F.col(source).isNull(), F.lit("-")).otherwise(F.concat(F.lit("="), F.col(source).cast("string")))
    # The texts are read once; what the rest needs of them is a narrow table.
    rows = docs.select(F.col(doc_id).alias("doc_id"), (F.octet_length(raw) + F.lit(8)).cast("long").alias("size"), F.crc32(raw).alias("text_crc32"), key.alias("k"))
    rows = cut(rows.withColumn("o", _number(seed, F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.lit(":"), F.col("text_crc32").cast("string")))))
    buckets = max(LEAST_BUCKETS, -(-rows.count() // ROWS_PER_BUCKET))
    rows = rows.withColumn("b", F.pmod("o", F.lit(buckets)))

    by_source = Window.partitionBy("k").orderBy("b")
    before = rows.groupBy("k", "b").agg(F.count("*").alias("n")).select(
        "k",
        "b",
        F.coalesce(F.sum("n").over(by_source.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"),
        F.sum("n").over(Window.partitionBy("k")).alias("of"),
    )
    place = F.row_number().over(Window.partitionBy("k", "b").orderBy("o", F.col("doc_id").asc_nulls_first(), "text_crc32", "size"))
    jitter = (F.pmod(_number(seed, F.col("k")), F.lit(1_000_003)) + F.lit(0.5)) / F.lit(1_000_003.0)
    ranked = rows.join(before, ["k", "b"]).select(
        "doc_id", "size", "text_crc32", "k", "o", ((F.col("before") + place - jitter) / F.col("of")).alias("part")
    )
    ranked = cut(ranked.withColumn("f", F.least(F.floor(F.col("part") * buckets), F.lit(buckets - 1))))

    every = Window.orderBy("f")
    cuts = ranked.groupBy("f").agg(F.count("*").alias("n")).select(
        "f",
        F.coalesce(F.sum("n").over(every.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"),
        F.sum("n").over(every.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("total"),
    )
    within = F.row_number().over(Window.partitionBy("f").orderBy("part", "k", "o", F.col("doc_id").asc_nulls_first(), "text_crc32", "size"))
    placed = ranked.join(cuts, "f").select("doc_id", "size", "text_crc32", "total", (F.col("before") + within - 1).alias("g"))
    return placed.select(
        "doc_id", "size", "text_crc32", F.expr(f"cast(g * {shards} div total as int)").alias("shard"), "g", "total"
    ).select("doc_id", "size", "text_crc32", "shard", F.expr(f"g - (shard * total + {shards - 1}) div {shards}").alias("slot"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = interleave(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


ORACLE = """
WITH c AS (SELECT list(x ORDER BY i) AS tab FROM (SELECT i, list_reduce(list_prepend(i, range(8)), lambda a, b: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END) AS x FROM range(256) r(i))),
t AS (SELECT DISTINCT coalesce(text, '') AS text FROM documents),
h AS (SELECT text, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(regexp_extract_all(hex(encode(text)), '..'), lambda x: CAST('0x' || x AS BIGINT))), lambda a, b: xor(a >> 8, tab[(xor(a, b) & 255) + 1])), 4294967295) AS crc FROM t, c),
d AS (SELECT doc_id, CAST(strlen(h.text) + 8 AS BIGINT) AS size, h.crc AS text_crc32, CASE WHEN source IS NULL THEN '-' ELSE '=' || source END AS k,
  CAST('0x' || substr(md5('17:' || coalesce(doc_id::VARCHAR, 'null') || ':' || h.crc::VARCHAR), 1, 15) AS BIGINT) AS o FROM documents x JOIN h ON h.text = coalesce(x.text, '')),
n AS (SELECT count(*) AS total, greatest(1024, CAST(ceil(count(*) / 10000.0) AS BIGINT)) AS buckets FROM d),
r AS (SELECT d.*, total, row_number() OVER (PARTITION BY k ORDER BY o % buckets, o, doc_id NULLS FIRST, text_crc32, size) AS place, count(*) OVER (PARTITION BY k) AS of_,
  (CAST('0x' || substr(md5('17:' || k), 1, 15) AS BIGINT) % 1000003 + 0.5::DOUBLE) / 1000003.0::DOUBLE AS jitter FROM d, n),
g AS (SELECT *, row_number() OVER (ORDER BY (place - jitter) / of_, k, o, doc_id NULLS FIRST, text_crc32, size) - 1 AS g FROM r)
SELECT doc_id, size, text_crc32, 'rows' AS law, CAST(g * 24 // total AS INT) AS shard, CAST(g - ((g * 24 // total) * total + 23) // 24 AS BIGINT) AS slot, CAST(NULL AS INT) AS grown_shard FROM g
"""
