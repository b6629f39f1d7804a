"""Sorts and limits: global and per-group top k, with explicit null order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


class UnboundedSort(ValueError):
    """ORDER BY without LIMIT on a stream."""


def check_sort(df: DataFrame, limit: int | None) -> None:
    if df.isStreaming and limit is None:
        raise UnboundedSort("ORDER BY on a stream needs a LIMIT, a window or a watermark")


def order(column: str, descending: bool = False, nulls_first: bool = False) -> Column:
    """A sort key; nulls come last in both directions unless said otherwise."""
    c = F.col(column)
    if descending:
        return c.desc_nulls_first() if nulls_first else c.desc_nulls_last()
    return c.asc_nulls_first() if nulls_first else c.asc_nulls_last()


def top_k(df: DataFrame, k: int, *by: Column, offset: int = 0) -> DataFrame:
    check_sort(df, k)
    out = df.orderBy(*by)
    return (out.offset(offset) if offset else out).limit(k)


def top_k_per_group(df: DataFrame, keys: list[str], k: int, *by: Column, rank: str = "rank") -> DataFrame:
    """Spark drops all but k rows a key and task before the shuffle."""
    return df.withColumn(rank, F.row_number().over(Window.partitionBy(*keys).orderBy(*by))).where(F.col(rank) <= k)
