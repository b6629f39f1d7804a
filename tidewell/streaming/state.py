"""Stateful stream operators: changelogs of results, top k, lag and lead, sorted output, retractions for late data."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..operators.changelog import diff


def version_before(spark, path: str, batch_id: int) -> int | None:
    """The highest version below batch_id under path. Batches run one after another, so it is whole."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    names = [f.getPath().getName() for f in fs.listStatus(folder)] if fs.exists(folder) else []
    return max((int(n[1:]) for n in names if n[0] == "v" and n[1:].isdigit() and int(n[1:]) < batch_id), default=None)


class EmitChanges:
    """A foreachBatch function that turns updated results into a changelog of -1 and +1 rows.

    The last result of each key is a table under path, one version a batch; a batch that runs
    twice reads the version before it and writes the same rows again."""

    def __init__(self, keys: list[str], path: str, sink: Callable[[DataFrame, int], None]):
        self.keys, self.path, self.sink = keys, path, sink
        self.last: int | None = None

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        batch = batch.persist()
        if self.last is None or self.last >= batch_id:
            self.last = version_before(spark, self.path, batch_id)
        before = spark.read.schema(batch.schema).parquet(f"{self.path}/v{self.last}") if self.last is not None else spark.createDataFrame([], batch.schema)
        try:
            touched = before.join(batch.select(*self.keys), self.keys, "left_semi")
            self.sink(diff(touched, batch, self.keys), batch_id)
            before.join(batch.select(*self.keys), self.keys, "left_anti").unionByName(batch).write.mode("overwrite").parquet(f"{self.path}/v{batch_id}")
            self.last = batch_id
        finally:
            batch.unpersist()


class TopK:
    """A foreachBatch function for ORDER BY ... LIMIT k on a stream: the rank changes of each batch.

    State is the k best rows so far (of each key), a table under path, one version a batch, which a
    new object reads again; so a batch costs one top-k of itself."""

    def __init__(self, k: int, order: list[Column], sink: Callable[[DataFrame, int], None], path: str, keys: list[str] | None = None):
        self.k, self.order, self.sink, self.path, self.keys = k, order, sink, path, keys or []
        self.last: int | None = None

    def _top(self, df: DataFrame) -> DataFrame:
        by = Window.partitionBy(*self.keys).orderBy(*self.order)
        if not self.keys:
            df = df.orderBy(*self.order).limit(self.k)
        return df.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= self.k)

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        if self.last is None or self.last >= batch_id:
            self.last = version_before(spark, self.path, batch_id)
        before = spark.read.schema(batch.schema).parquet(f"{self.path}/v{self.last}") if self.last is not None else spark.createDataFrame([], batch.schema)
        new = self._top(before.unionByName(self._top(batch).drop("rank"))).persist()
        try:
            self.sink(diff(self._top(before), new, [*self.keys, "rank"]), batch_id)
            new.drop("rank").write.mode("overwrite").parquet(f"{self.path}/v{batch_id}")
            self.last = batch_id
        finally:
            new.unpersist()


class Lags(StatefulProcessor):
    """lag and lead of a column by event time and key: a row goes out once its lead is known, or, with an event time, at the end of its key's time.

    That end is when the watermark passes the last row held of the key; what still waits then has default as its lead."""

    def __init__(self, order: str, value: str, lag: int, lead: int, columns: list[str], times: list[str] = (), event_time: str | None = None, zone: str = "UTC", default=None):
        self.order, self.value, self.lag, self.lead, self.columns = order, value, lag, lead, columns
        self.times, self.event_time, self.zone, self.default = times, event_time, zone, default

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getListState("held", T.StructType([T.StructField("row", T.StringType()), T.StructField("done", T.BooleanType())]))

    def _frame(self, out: list[dict]) -> pd.DataFrame:
        pdf = pd.DataFrame(out, columns=[*self.columns, "lag", "lead"])
        for c in self.times:
            pdf[c] = pd.to_datetime(pdf[c], unit="us")
        return pdf

    def _rows(self) -> list:
        import json

        return [(json.loads(r[0]), r[1]) for r in self.held.get()] if self.held.exists() else []

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timers) -> Iterator[pd.DataFrame]:
        import json

        new = pd.concat(list(rows))
        all_rows = self._rows() + [(json.loads(x), False) for x in new[self.columns].to_json(orient="records", lines=True, date_unit="us").splitlines() if x]
        all_rows.sort(key=lambda r: r[0][self.order])
        out, keep = [], []
        for i, (row, done) in enumerate(all_rows):
            ready = i + self.lead < len(all_rows)
            if ready and not done:
                before = all_rows[i - self.lag][0][self.value] if i >= self.lag else self.default
                out.append({**row, "lag": before, "lead": all_rows[i + self.lead][0][self.value] if self.lead else None})
            # A row is kept while a later one needs it, or it waits for its lead.
            if not ready or i >= len(all_rows) - self.lag - self.lead:
                keep.append((json.dumps(row), done or ready))
        self.held.put(keep)
        if self.event_time:
            for t in list(self.handle.listTimers()):
                self.handle.deleteTimer(t)
            if not all(done for _, done in keep):
                # pandas has the session's local time; of an hour that comes twice, the later one is sure to be past.
                last = pd.Timestamp(max(row[self.event_time] for row, _ in all_rows), unit="us").tz_localize(self.zone, ambiguous=False, nonexistent="shift_forward")
                self.handle.registerTimer(int(last.timestamp() * 1000))
        yield self._frame(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        import json

        rows, out = self._rows(), []
        for i, (row, done) in enumerate(rows):
            if not done:
                before = rows[i - self.lag][0][self.value] if i >= self.lag else self.default
                out.append({**row, "lag": before, "lead": rows[i + self.lead][0][self.value] if i + self.lead < len(rows) else self.default})
        self.held.put([(json.dumps(row), True) for row, _ in rows])
        yield self._frame(out)

    def close(self) -> None:
        pass


def lag_lead(df: DataFrame, keys: list[str], order: str, value: str, lag: int = 1, lead: int = 0, event_time: str | None = None, default=None) -> DataFrame:
    """The columns of a streaming df with lag and lead of value. Needs the RocksDB state store.

    event_time is the column that df has its watermark on. Without it a key's time has no end:
    the last `lead` rows of each key wait for rows to come."""
    kind = df.schema[value].dataType
    schema = T.StructType([*df.schema.fields, T.StructField("lag", kind), T.StructField("lead", kind)])
    times = [f.name for f in df.schema.fields if isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType))]
    each = Lags(order, value, lag, lead, df.columns, times, event_time, df.sparkSession.conf.get("spark.sql.session.timeZone"), default)
    return df.groupBy(*keys).transformWithStateInPandas(each, schema, "Append", "None" if event_time is None else "EventTime")


class SortedUpTo:
    """A foreachBatch function that passes rows on in order once the watermark is past them; rows at or below the last one are dropped.

    Held rows and the watermark are tables under path, one version a batch, which a new object reads again."""

    def __init__(self, ms: str, delay_ms: int, sink: Callable[[DataFrame, int], None], path: str):
        self.ms, self.delay, self.sink, self.path = ms, delay_ms, sink, path
        self.mark: int | None = None
        self.version: int | None = None

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        if self.version is None or self.version >= batch_id:
            self.version = version_before(spark, self.path, batch_id)
            self.mark = None if self.version is None else spark.read.parquet(f"{self.path}/marks/v{self.version}").head()[0]
        held = batch if self.version is None else batch.unionByName(spark.read.schema(batch.schema).parquet(f"{self.path}/v{self.version}"))
        held = held.where(F.col(self.ms).isNotNull() & (F.lit(True) if self.mark is None else F.col(self.ms) > self.mark)).persist()
        try:
            top = held.agg(F.max(self.ms)).head()[0]
            if top is None:
                return
            mark = max(top - self.delay, self.mark if self.mark is not None else top - self.delay)
            self.sink(held.where(F.col(self.ms) <= mark).orderBy(self.ms), batch_id)
            held.where(F.col(self.ms) > mark).write.mode("overwrite").parquet(f"{self.path}/v{batch_id}")
            spark.createDataFrame([(mark,)], "mark long").write.mode("overwrite").parquet(f"{self.path}/marks/v{batch_id}")
            self.mark, self.version = mark, batch_id
        finally:
            held.unpersist()


class KeyedWatermark(StatefulProcessor):
    """Passes the rows of each key that are not below the key's own watermark, and drops the rest.

    With idle_ms, a key that has had no rows for so long, by the clock, is forgotten, and its next row begins anew."""

    def __init__(self, ms: str, delay_ms: int, idle_ms: int | None = None):
        self.ms, self.delay, self.idle = ms, delay_ms, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.mark = handle.getValueState("mark", T.StructType([T.StructField("ms", T.LongType())]), self.idle)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timers) -> Iterator[pd.DataFrame]:
        mark = self.mark.get()[0] if self.mark.exists() else None
        for pdf in rows:
            new = int(pdf[self.ms].max()) - self.delay
            mark = new if mark is None else max(mark, new)
            yield pdf[pdf[self.ms] >= mark]
        self.mark.update((mark,))

    def close(self) -> None:
        pass


def keyed_watermark(df: DataFrame, keys: list[str], ms: str, delay_ms: int = 5000, idle_ms: int | None = None) -> DataFrame:
    """df without the rows below their key's own watermark; with idle_ms (for queries that keep running) idle keys are evicted. Needs the RocksDB state store."""
    return df.groupBy(*keys).transformWithStateInPandas(KeyedWatermark(ms, delay_ms, idle_ms), df.schema, "Append", "None" if idle_ms is None else "ProcessingTime")
