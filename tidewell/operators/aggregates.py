"""Aggregates that need an order, and those over changelogs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _ordered(*by: str | Column) -> Column:
    return F.struct(*(F.col(b) if isinstance(b, str) else b for b in by))


def first_value(value: str, *by: str) -> Column:
    """The value of the earliest row; of equal times, the first to arrive (by: time, arrival)."""
    return F.min_by(F.col(value), _ordered(*by))


def last_value(value: str, *by: str) -> Column:
    """The value of the latest row; of equal times, the last to arrive."""
    return F.max_by(F.col(value), _ordered(*by))


def ohlc(value: str, *by: str) -> list[Column]:
    return [first_value(value, *by).alias("open"), F.max(value).alias("high"), F.min(value).alias("low"), last_value(value, *by).alias("close")]


def sum_or_null(value: str) -> Column:
    return F.sum(value)


def retractable(value: str, weight: str = "_weight") -> dict[str, Column]:
    """count, sum and avg of a changelog's rows with weights +1 and -1."""
    n, s = F.sum(weight), F.sum(F.col(value) * F.col(weight))
    return {"count": n, "sum": s, "avg": F.when(n != 0, s / n)}
