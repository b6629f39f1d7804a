"""Event-time windows over epoch milliseconds: tumbling, hopping and session."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def tumble_start(ms: Column, size: int) -> Column:
    """Start of the window [start, start + size) with ms in it; windows are aligned to the epoch, also before it."""
    return ms - F.pmod(ms, F.lit(size))


def tumble(df: DataFrame, ms: str, size: int) -> DataFrame:
    start = tumble_start(F.col(ms), size)
    return df.withColumn("window_start", start).withColumn("window_end", F.col("window_start") + size)


def hop_start(ms: Column, slide: int, size: int) -> Column:
    """The earliest window that holds ms."""
    last = ms - F.pmod(ms, F.lit(slide))
    return last - (F.floor((F.lit(size - 1) - F.pmod(ms, F.lit(slide))) / slide) * slide)


def hop(df: DataFrame, ms: str, slide: int, size: int) -> DataFrame:
    """Each row once for every window of the size that holds it, a window every slide."""
    last = F.col(ms) - F.pmod(F.col(ms), F.lit(slide))
    starts = F.sequence(hop_start(F.col(ms), slide, size), last, F.lit(slide).cast("long"))
    # A size below the slide leaves gaps, which hold no window.
    out = df.withColumn("window_start", F.explode(F.when(hop_start(F.col(ms), slide, size) <= last, starts)))
    return out.withColumn("window_end", F.col("window_start") + size)


def _session_numbers(df: DataFrame, keys: list[str], ms: str, gap: int, bucket_ms: int | None) -> DataFrame:
    """The rows with a time, and __session, a number that rises with the key's sessions.

    With bucket_ms no task needs all rows of a key: rows are looked at by key and time bucket, and
    of each bucket only its last time and its number of session starts meet in the key's order."""
    rows = df.where(F.col(ms).isNotNull())
    if bucket_ms is None:
        order = Window.partitionBy(*keys).orderBy(ms)
        new = F.when(F.col(ms) - F.lag(ms).over(order) < gap, 0).otherwise(1)
        return rows.withColumn("__new", new).withColumn("__session", F.sum("__new").over(order.rangeBetween(Window.unboundedPreceding, 0))).drop("__new")
    rows = rows.withColumn("__bucket", F.floor(F.col(ms) / bucket_ms))
    order, along = Window.partitionBy(*keys, "__bucket").orderBy(ms), Window.partitionBy(*keys).orderBy("__bucket")
    same = [F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}")) for c in (*keys, "__bucket")]

    def met(left: DataFrame, right: DataFrame, column: str) -> DataFrame:
        on = same[0]
        for c in same[1:]:
            on = on & c
        return left.alias("l").join(right.alias("r"), on).select("l.*", f"r.{column}")

    ends = rows.groupBy(*keys, "__bucket").agg(F.max(ms).alias("__last")).withColumn("__before", F.lag("__last").over(along))
    rows = met(rows, ends, "__before")
    new = F.when(F.col(ms) - F.coalesce(F.lag(ms).over(order), "__before") < gap, 0).otherwise(1)
    rows = rows.withColumn("__new", new).drop("__before")
    starts = rows.groupBy(*keys, "__bucket").agg(F.sum("__new").alias("__n")).withColumn("__so_far", F.coalesce(F.sum("__n").over(along.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    rows = met(rows, starts, "__so_far")
    own = F.sum("__new").over(order.rangeBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("__session", F.col("__so_far") + own).drop("__new", "__so_far", "__bucket")


def sessions(df: DataFrame, keys: list[str], ms: str, gap: int, bucket_ms: int | None = None) -> DataFrame:
    """Each row with its session's start and end. An event gap or more after the last one begins a new session; the end is the last event plus gap."""
    out = _session_numbers(df, keys, ms, gap, bucket_ms)
    own = Window.partitionBy(*keys, "__session")
    return out.withColumn("session_start", F.min(ms).over(own)).withColumn("session_end", F.max(ms).over(own) + gap).drop("__session")


def session_agg(df: DataFrame, keys: list[str], ms: str, gap: int, *aggs: Column, bucket_ms: int | None = None) -> DataFrame:
    """One row a session. The session's rows are numbered and then grouped, with partial aggregates; bucket_ms splits hot keys."""
    grouped = _session_numbers(df, keys, ms, gap, bucket_ms).groupBy(*keys, "__session").agg(F.min(ms).alias("session_start"), (F.max(ms) + gap).alias("session_end"), *aggs)
    return grouped.drop("__session")


def window_sorted(df: DataFrame, order: list[Column], keys: list[str] | None = None, limit: int | None = None) -> DataFrame:
    """Rank of each row within its window (and keys), the first limit rows alone if given."""
    by = Window.partitionBy("window_start", *(keys or [])).orderBy(*order)
    out = df.withColumn("rank", F.row_number().over(by))
    return out.where(F.col("rank") <= limit) if limit else out


def closed(df: DataFrame, watermark: int) -> DataFrame:
    """Rows of windows that the watermark has closed: end <= watermark."""
    return df.where(F.col("window_end") <= watermark)
