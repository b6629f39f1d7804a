"""Changelogs as Z-sets: rows with _op and _weight (+1 or -1), their consolidation, aggregates over them, and change-data envelopes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

INSERT, DELETE, BEFORE, AFTER = "insert", "delete", "update_before", "update_after"


def consolidate(df: DataFrame, columns: list[str] | None = None, weight: str = "_weight") -> DataFrame:
    """Distinct rows with their net weight, zero ones left out."""
    cols = columns or [c for c in df.columns if c not in (weight, "_op", "_ts")]
    return df.groupBy(*cols).agg(F.sum(weight).cast("long").alias(weight)).where(F.col(weight) != 0)


def diff(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """The changelog that turns old into new (one row a key in each): inserts, deletes, and pairs for changed rows."""
    values = [c for c in new.columns if c not in keys]
    o = old.select(*keys, F.struct(*values).alias("__o"))
    n = new.select(*keys, F.struct(*values).alias("__n"))
    both = o.join(n, keys, "full").where(~F.col("__o").eqNullSafe(F.col("__n")))
    minus = F.when(F.col("__o").isNotNull(), F.struct(F.when(F.col("__n").isNull(), DELETE).otherwise(BEFORE).alias("_op"), F.lit(-1).alias("_weight"), F.col("__o").alias("v")))
    plus = F.when(F.col("__n").isNotNull(), F.struct(F.when(F.col("__o").isNull(), INSERT).otherwise(AFTER).alias("_op"), F.lit(1).alias("_weight"), F.col("__n").alias("v")))
    out = both.withColumn("__c", F.explode(F.filter(F.array(minus, plus), lambda x: x.isNotNull())))
    return out.select(*keys, "__c._op", "__c._weight", *(F.col(f"__c.v.{v}").alias(v) for v in values))


def retract_min_max(df: DataFrame, keys: list[str], value: str, weight: str = "_weight") -> DataFrame:
    """Least and greatest value among those with a positive net weight."""
    return consolidate(df.select(*keys, value, weight), [*keys, value], weight).where(F.col(weight) > 0).groupBy(*keys).agg(F.min(value).alias("min"), F.max(value).alias("max"))


def retract_first_last(df: DataFrame, keys: list[str], value: str, order: list[str], weight: str = "_weight") -> DataFrame:
    """The earliest and the latest value, by order, among those with a positive net weight."""
    alive = consolidate(df.select(*keys, *order, value, weight), [*keys, *order, value], weight).where(F.col(weight) > 0)
    by = F.struct(*order)
    return alive.groupBy(*keys).agg(F.min_by(value, by).alias("first"), F.max_by(value, by).alias("last"))


def late_retractions(given: DataFrame, late: DataFrame, keys: list[str], merge: dict) -> DataFrame:
    """The changelog that late rows' results make of results given before: a pair for each that changes, an insert for a new one.

    merge says for each value column how an old and a late value become one."""
    values = list(merge)
    old = given.select(*keys, F.struct(*values).alias("__g"))
    new = late.select(*keys, F.struct(*values).alias("__l")).join(old, keys, "left")
    # Only results that late rows touch are compared.
    before = new.where("__g is not null").select(*keys, *(F.col(f"__g.{v}").alias(v) for v in values))
    after = new.select(*keys, *(F.when(F.col("__g").isNull(), F.col(f"__l.{v}")).otherwise(merge[v](F.col(f"__g.{v}"), F.col(f"__l.{v}"))).alias(v) for v in values))
    return diff(before, after, keys)


def upsert_latest(df: DataFrame, keys: list[str], order: list[str], op: str | None = None) -> DataFrame:
    """The table after a log of upserts; with op, keys whose last change is a delete are gone."""
    rest = [c for c in df.columns if c not in keys]
    out = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("__x")).select(*keys, "__x.*")
    return out.where(~F.lower(op).isin("d", "delete")) if op else out


def topk_changelog(before: DataFrame, after: DataFrame, order: list[Column], k: int, keys: list[str]) -> DataFrame:
    """Rank changes of the first k rows between two states: -1 for a row that left its rank, +1 for one that has it now."""

    def top(df: DataFrame) -> DataFrame:
        return df.withColumn("rank", F.row_number().over(Window.orderBy(*order))).where(F.col("rank") <= k)

    # The single-partition window above sees k rows of each task alone: a limit comes first.
    b, a = top(before.orderBy(*order).limit(k)), top(after.orderBy(*order).limit(k))
    return diff(b, a, ["rank"])


def debezium(df: DataFrame, column: str, payload: T.StructType) -> DataFrame:
    """Rows of a JSON envelope (before, after, op, ts_ms): after for c, u and r, before for d, with __op and __ts_ms."""
    kind = T.StructType([T.StructField("before", payload), T.StructField("after", payload), T.StructField("op", T.StringType()), T.StructField("ts_ms", T.LongType())])
    e = df.withColumn("__e", F.from_json(column, kind))
    row = F.when(F.col("__e.op") == "d", F.col("__e.before")).otherwise(F.col("__e.after"))
    return e.withColumn("__row", row).where("__e.op in ('c', 'u', 'r', 'd')").select("__row.*", F.col("__e.op").alias("__op"), F.col("__e.ts_ms").alias("__ts_ms"))


def cdc_changes(df: DataFrame, payload: T.StructType, table: str = "_table", op: str = "_op") -> DataFrame:
    """Z-set rows of a change-data envelope with JSON _before and _after: an update is a pair."""
    before = F.struct(F.lit(-1).alias("_weight"), F.from_json("_before", payload).alias("row"))
    after = F.struct(F.lit(1).alias("_weight"), F.from_json("_after", payload).alias("row"))
    o = F.upper(F.substring(op, 1, 1))
    parts = F.when(o == "D", F.array(before)).when(o == "U", F.array(before, after)).otherwise(F.array(after))
    return df.withColumn("__c", F.explode(parts)).where("__c.row is not null").select(table, op, "_ts_ms", "__c._weight", "__c.row.*")
