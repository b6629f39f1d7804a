"""Watermarks and late rows."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.time import micros
from ..plans.rewrite import EVENT_TIME


def event_time(column: str, kind: T.DataType) -> Column:
    """A TIMESTAMP for Spark's watermark, from a timestamp, a date or epoch milliseconds; one without a zone counts as UTC in every session."""
    if isinstance(kind, (T.LongType, T.IntegerType)):
        return F.timestamp_millis(F.col(column).cast("long"))
    if isinstance(kind, T.TimestampNTZType):
        return F.timestamp_micros(micros(column))
    return F.col(column).cast("timestamp")


def with_event_time(df: DataFrame, column: str, delay_ms: int, lateness_ms: int = 0) -> DataFrame:
    """df with its event-time column; on a stream, watermarked by the delay and the allowed lateness. Rows without a time are dropped."""
    out = df.withColumn(EVENT_TIME, event_time(column, df.schema[column].dataType)).where(F.col(EVENT_TIME).isNotNull())
    return out.withWatermark(EVENT_TIME, f"{delay_ms + lateness_ms} milliseconds") if df.isStreaming else out


@dataclass
class BoundedWatermark:
    """The largest time seen less a delay; it never falls."""

    delay_ms: int = 0
    value: int | None = None

    def observe(self, ms: int | None) -> int | None:
        if ms is not None and (self.value is None or ms - self.delay_ms > self.value):
            self.value = ms - self.delay_ms
        return self.value

    def advance(self, ms: int) -> int | None:
        """An external watermark."""
        if self.value is None or ms > self.value:
            self.value = ms
        return self.value


@dataclass
class SourceWatermarks:
    """The least watermark of the active sources; a source idle for idle_ms no longer holds the others back; if all are idle, the greatest."""

    idle_ms: int = 30_000
    sources: dict[str, BoundedWatermark] = field(default_factory=dict)
    seen: dict[str, int] = field(default_factory=dict)
    value: int | None = None

    def add(self, name: str, delay_ms: int = 0, now: int = 0) -> None:
        self.sources[name] = BoundedWatermark(delay_ms)
        self.seen[name] = now

    def observe(self, name: str, ms: int | None, now: int) -> int | None:
        self.sources[name].observe(ms)
        self.seen[name] = now
        return self.at(now)

    def at(self, now: int) -> int | None:
        active = [w.value for n, w in self.sources.items() if now - self.seen[n] < self.idle_ms]
        known = [w.value for w in self.sources.values() if w.value is not None]
        if active:
            new = None if None in active else min(active)
        else:
            new = max(known, default=None)
        if new is not None and (self.value is None or new > self.value):
            self.value = new
        return self.value


@dataclass
class AlignmentGroup:
    """Sources whose watermarks may drift apart by max_drift_ms: a source ahead of that is paused, warned of, or loses the excess."""

    max_drift_ms: int = 300_000
    action: str = "pause"

    def judge(self, watermarks: dict[str, int]) -> dict[str, str]:
        low = min(watermarks.values())
        return {n: self.action if w - low > self.max_drift_ms else "go" for n, w in watermarks.items()}

    def excess(self, df: DataFrame, ms: str, low: int) -> DataFrame:
        """The rows that a drop action keeps."""
        return df.where(F.col(ms) <= low + self.max_drift_ms)


def is_late(watermark: int, window_end: int, lateness: int = 0) -> bool:
    """Whether a row for the window comes too late; equality is late."""
    return watermark >= window_end + lateness


class LateSplit:
    """A foreachBatch function that parts each batch into rows in time and late ones; rows without a time are dropped.

    With end (the end of a row's last window) a row is late if the watermark that the batches
    before have reached is at or past end + lateness. Without it, the batch advances the watermark
    first, and rows below it are late. The watermark is kept under path, one version a batch, which
    a new object reads again; a batch that runs twice is parted in the same way."""

    def __init__(self, ms: Column, delay_ms: int, on_time: Callable[[DataFrame, int], None], late: Callable[[DataFrame, int], None] | None, path: str, end: Column | None = None, lateness_ms: int = 0):
        self.ms, self.delay, self.on_time, self.late, self.path, self.end, self.lateness = ms, delay_ms, on_time, late, path, end, lateness_ms
        self.mark = BoundedWatermark(delay_ms)
        self.version: int | None = None
        self.dropped = 0

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        from .state import version_before

        spark = batch.sparkSession
        if self.version is None or self.version >= batch_id:
            self.version = version_before(spark, self.path, batch_id)
            self.mark = BoundedWatermark(self.delay, None if self.version is None else spark.read.parquet(f"{self.path}/v{self.version}").head()[0])
        batch = batch.where(self.ms.isNotNull()).persist()
        try:
            top, before = batch.agg(F.max(self.ms)).head()[0], self.mark.value
            now = self.mark.observe(top)
            if self.end is not None:
                late = F.lit(before is not None) & (F.lit(before) >= self.end + self.lateness)
            else:
                late = F.lit(now is not None) & (self.ms < F.lit(now))
            late = F.coalesce(late, F.lit(False))
            rest = batch.where(late)
            self.on_time(batch.where(~late), batch_id)
            n = rest.count()
            self.dropped += n
            if self.late and n:
                self.late(rest, batch_id)
            spark.createDataFrame([(now,)], "mark long").write.mode("overwrite").parquet(f"{self.path}/v{batch_id}")
            self.version = batch_id
        finally:
            batch.unpersist()
