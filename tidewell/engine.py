"""The engine: SQL statements in, batch results and continuous queries out.

Sources are append-only. One without a connector keeps what is inserted as Parquet files, which
streams read in the order of insertion; one with the files connector reads a folder. A stream is
a Structured Streaming query from its sources to a table of results; run() processes what there
is and stops, start() keeps running. Ad-hoc SELECTs read the sources' present rows.

What a stream has to remember (its place in the sources, keyed state, last results) lies under the
engine's path, so a new Engine on the same path, given the same statements, goes on from there."""

from __future__ import annotations

import queue
import re
import time
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from itertools import islice
from typing import ClassVar

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .functions.time import millis
from .operators.joins import asof_join
from .operators.topk import UnboundedSort, order
from .plans import rewrite
from .plans.catalog import Catalog, Entry
from .plans.ddl import Statement, parse
from .plans.lexer import SqlError, statements, substitute, tokens
from .sources import connectors
from .streaming.ordered import asof_stream, lags_stream
from .streaming.state import EmitChanges, TopK
from .streaming.time import LateSplit, with_event_time


@dataclass
class Subscription:
    """Results of a stream, batch by batch."""

    CHUNK: ClassVar[int] = 10_000

    predicate: str | None = None
    callback: Callable[[list[Row]], None] | None = None
    size: int = 1024
    policy: str = "drop_oldest"
    dropped: int = 0
    _queue: queue.Queue = field(default_factory=queue.Queue)

    def offer(self, batch: DataFrame) -> None:
        """The batch's rows in lists of CHUNK at most, fetched one partition after another; a full queue drops by its policy."""
        rows = (batch.where(self.predicate) if self.predicate else batch).toLocalIterator()
        while part := list(islice(rows, self.CHUNK)):
            if self.callback:
                self.callback(part)
            else:
                self._put(part)

    def _put(self, rows: list[Row]) -> None:
        while self._queue.qsize() >= self.size:
            self.dropped += 1
            if self.policy == "drop_newest":
                return
            self._queue.get_nowait()
        self._queue.put(rows)

    def poll(self) -> list[Row] | None:
        try:
            return self._queue.get_nowait()
        except queue.Empty:
            return None

    def recv(self, timeout_s: float | None = None) -> list[Row]:
        return self._queue.get(timeout=timeout_s)

    def __iter__(self) -> Iterator[list[Row]]:
        while (x := self.poll()) is not None:
            yield x


#: What may follow a relation without being its alias.
_CLAUSES = ("WHERE", "GROUP", "ORDER", "HAVING", "LIMIT", "OFFSET", "JOIN", "INNER", "LEFT", "RIGHT", "FULL", "CROSS", "NATURAL", "ON", "USING", "UNION", "INTERSECT", "EXCEPT", "MINUS", "WINDOW", "SEMI", "ANTI", "LATERAL", "PIVOT", "TABLESAMPLE")


class Writer:
    """Rows for a source or table, pushed size at a time and at the end."""

    def __init__(self, engine: Engine, name: str, size: int):
        self.engine, self.name, self.size, self.rows = engine, name, size, []

    def write(self, *row) -> None:
        self.rows.append(row)
        if len(self.rows) >= self.size:
            self.flush()

    def flush(self) -> None:
        if self.rows:
            self.engine.push(self.name, self.rows)
            self.rows = []

    def __enter__(self) -> Writer:
        return self

    def __exit__(self, kind, *_) -> None:
        if kind is None:
            self.flush()


class Engine:
    def __init__(self, spark: SparkSession, path: str, variables: dict[str, str] | None = None):
        self.spark, self.path, self.variables = spark, path.rstrip("/"), variables or {}
        self.catalog = Catalog()
        self.state = "created"
        self.running: dict[str, object] = {}
        self.subscriptions: dict[str, list[Subscription]] = {}
        self.watermarks: dict[str, int] = {}
        self.connectors: dict[str, tuple[Callable | None, Callable | None]] = {}
        self._seq: dict[str, int] = {}
        self._kept: dict[str, tuple[DataFrame, float]] = {}
        self._folders: dict[str, str] = {}

    # --- statements ----------------------------------------------------------------------------

    def execute(self, sql: str) -> DataFrame | None:
        """Run a script; the last statement's rows, if it has any."""
        out = None
        for one in statements(substitute(sql, self.variables)):
            s = parse(one)
            out = getattr(self, f"_{s.kind}")(s)
        return out

    query = execute

    def _entry(self, s: Statement, sql: str = "") -> None:
        depends = self.catalog.references(sql) if sql else set()
        self.catalog.add(Entry(s.kind, s.name, s, depends), s.replace, s.if_exists)

    def _source(self, s: Statement) -> None:
        if s.schema is None and s.connector is None:
            raise SqlError("a source without a connector needs columns")
        if s.connector not in (None, "files", "memory", "kafka") and self.connectors.get(s.connector, (None,))[0] is None:
            raise SqlError(f"unknown connector: {s.connector}")
        self._entry(s)

    def _table(self, s: Statement) -> None:
        if s.schema is None and s.connector is None:
            raise SqlError("a table without a connector needs columns")
        if "refresh" in s.options:
            connectors.reference_refresh(s.options["refresh"])
        if s.options.get("cache_mode", "full") not in ("full", "partial", "none"):
            raise SqlError("cache_mode is full, partial or none")
        self._entry(s)

    def _stream(self, s: Statement) -> None:
        window = rewrite.find_window(s.query)
        sources = [self.catalog.get(n).statement for n in self.catalog.references(s.query)]
        if s.emit.mode in ("close", "final"):
            if window is None:
                raise SqlError("EMIT ON WINDOW CLOSE and FINAL need a window")
            if not any(x.watermark for x in sources if x.kind == "source") and not any(x.kind in ("stream", "view") for x in sources):
                raise SqlError("EMIT ON WINDOW CLOSE and FINAL need a watermark")
        self._check_streaming(s.query, window)
        if s.late_sink:
            if window is None or len(sources) != 1 or sources[0].kind != "source" or not sources[0].watermark:
                raise SqlError("LATE DATA TO needs a window over one source with a watermark")
            if s.late_sink.lower() not in self.catalog.entries:
                self.catalog.add(Entry("sink", s.late_sink, Statement("sink", s.late_sink), state="passive"))
            self.catalog.get(s.late_sink, "sink")
        if rewrite.top(s.query) is not None and re.search(r"\bGROUP\s+BY\b", s.query, re.I):
            raise SqlError("ORDER BY ... LIMIT on a stream ranks rows, not groups: put the groups in a stream of their own")
        rewrite.lags(s.query)
        self._entry(s, s.query)

    _view = _stream

    def _check_streaming(self, sql: str, window) -> None:
        t, depth, words = tokens(sql), 0, []
        for x in t:
            depth += (x.text == "(") - (x.text == ")")
            if not depth:
                words.append(x.upper)
        text = " ".join(words)
        if " ORDER BY " in f" {text} " and "LIMIT" not in words and window is None:
            raise UnboundedSort("ORDER BY on a stream needs a LIMIT or a window")
        if re.search(r"\b(CROSS|NATURAL) JOIN\b", text):
            raise SqlError("CROSS and NATURAL joins can't run on streams")
        if re.search(r"\bJOIN\b", text) and not re.search(r"\b(ON|USING)\b", text):
            raise SqlError("a join on streams needs a condition")
        if re.search(r"UNBOUNDED\s+FOLLOWING", sql, re.I):
            raise SqlError("UNBOUNDED FOLLOWING can't run on streams")

    def _sink(self, s: Statement) -> None:
        if s.connector not in (None, "files", "memory", "kafka", "postgres", "database", "delta", "iceberg") and self.connectors.get(s.connector, (None, None))[1] is None:
            raise SqlError(f"unknown connector: {s.connector}")
        plain = re.fullmatch(r"\w+", s.query) is not None
        sql = f"SELECT * FROM {s.query}" if plain else s.query
        if plain:
            self.catalog.get(s.query)
        self._entry(s, sql)

    def _drop(self, s: Statement) -> None:
        if s.name.lower() not in self.catalog.entries and s.if_exists:
            return
        kind = {"materialized view": "view"}.get(s.query, s.query)
        self.catalog.get(s.name, kind)
        for name in self.catalog.drop(s.name, s.cascade):
            if (q := self.running.pop(name, None)) is not None:
                q.stop()

    def _show(self, s: Statement) -> DataFrame:
        kinds = {"sources": "source", "sinks": "sink", "streams": "stream", "queries": "stream", "materialized views": "view", "tables": "table"}
        if s.name not in kinds:
            raise SqlError(f"can't show {s.name}")
        rows = [(e.name, e.state, ", ".join(sorted(e.depends)), e.statement.connector or "", str(connectors.masked(e.statement.options))) for e in self.catalog.entries.values() if e.kind == kinds[s.name]]
        return self.spark.createDataFrame(rows, "name string, state string, depends string, connector string, options string")

    def _describe(self, s: Statement) -> DataFrame:
        e = self.catalog.get(s.name)
        df = self.frame(s.name)
        rows = [(f.name, f.dataType.simpleString(), f.nullable, "") for f in df.schema if f.name != rewrite.EVENT_TIME]
        if s.extended:
            mark = e.statement.watermark
            rows += [("# kind", e.kind, False, ""), ("# depends", ", ".join(sorted(e.depends)), False, "")]
            rows += [("# watermark", f"{mark.column} - {mark.delay_ms} ms", False, "")] if mark else []
            rows += [(f"# {k}", str(v), False, "option") for k, v in connectors.masked(e.statement.options).items()]
        return self.spark.createDataFrame(rows, "column_name string, data_type string, nullable boolean, comment string")

    def _explain(self, s: Statement) -> DataFrame:
        inner = parse(s.query)
        rows = [("kind", inner.kind), ("depends", ", ".join(sorted(self.catalog.references(inner.query)))), ("emit", inner.emit.mode)]
        if (w := rewrite.find_window(inner.query)) is not None:
            rows.append(("window", f"{w.kind} of {w.size} ms" + (f" every {w.slide} ms" if w.slide else "")))
        rows.append(("asof", str(rewrite.asof(inner.query) is not None).lower()))
        if inner.query and inner.kind in ("select", "stream", "view"):
            rows.append(("plan", self._sql(inner.query)._jdf.queryExecution().simpleString()))
        return self.spark.createDataFrame(rows, "plan_key string, plan_value string")

    def topology(self) -> str:
        """Every object after what it reads."""
        return "\n".join(f"{n} [{self.catalog.entries[n].kind}] <- {', '.join(sorted(self.catalog.entries[n].depends)) or '-'}" for n in self.catalog.order())

    def _insert(self, s: Statement) -> None:
        e = self.catalog.get(s.name, "source", "table")
        schema = e.statement.schema
        if not s.query.upper().startswith(("VALUES", "SELECT")):
            raise SqlError("INSERT takes VALUES or a query")
        names = s.columns or schema.fieldNames()
        df = self.spark.sql(f"SELECT * FROM ({s.query})") if s.query.upper().startswith("VALUES") else self._sql(s.query)
        if len(df.columns) != len(names):
            raise SqlError(f"{len(df.columns)} values for {len(names)} columns")
        given = dict(zip(names, df.columns, strict=True))
        self.push(s.name, df.select(*(F.col(given[f.name]).cast(f.dataType).alias(f.name) if f.name in given else F.lit(None).cast(f.dataType).alias(f.name) for f in schema)))

    def push(self, name: str, rows: DataFrame | list) -> None:
        """Append rows to a source, or upsert them into a table."""
        e = self.catalog.get(name, "source", "table")
        df = rows if isinstance(rows, DataFrame) else self.spark.createDataFrame(rows, e.statement.schema)
        folder = f"{self.path}/data/{name.lower()}"
        if name.lower() not in self._seq:  # go on from what is stored
            self._mkdirs(folder)
            self._seq[name.lower()] = self.spark.read.schema("__seq long").parquet(folder).agg(F.max("__seq")).head()[0] or 0
        self._seq[name.lower()] += 1
        # Streams see pushes in order, for files are taken by their time.
        df.withColumn("__seq", F.lit(self._seq[name.lower()]).cast("long")).write.mode("append").parquet(folder)

    def writer(self, name: str, size: int = 1000) -> Writer:
        """Gathers rows and pushes them size at a time; use in a with statement."""
        self.catalog.get(name, "source", "table")
        return Writer(self, name, size)

    # --- what users add ------------------------------------------------------------------------

    def register_function(self, name: str, f: Callable, returns: str) -> None:
        """A scalar function of pandas Series for SQL."""
        self.spark.udf.register(name, F.pandas_udf(f, returns))

    def register_aggregate(self, name: str, f: Callable, returns: str) -> None:
        """An aggregate of pandas Series (with type hints, to one number) for SQL over tables and sources' present rows."""
        self.spark.udf.register(name, F.pandas_udf(f, returns))

    def register_table_function(self, name: str, handler: type, returns: str) -> None:
        """A class whose eval() yields rows, for SELECT ... FROM name(...)."""
        self.spark.udtf.register(name, F.udtf(handler, returnType=returns))

    def register_connector(self, name: str, read: Callable | None = None, write: Callable | None = None) -> None:
        """read(spark, options, schema, streaming) gives a source's rows; write(batch, options, batch_id) puts a sink's."""
        self.connectors[name.lower()] = (read, write)

    def get_schema(self, name: str) -> T.StructType:
        return T.StructType([f for f in self.frame(name).schema if f.name != rewrite.EVENT_TIME])

    def names(self, kind: str) -> list[str]:
        """Names of all objects of a kind (source, table, stream, view, sink)."""
        return sorted(e.name for e in self.catalog.entries.values() if e.kind == kind)

    def refresh(self, name: str) -> None:
        """Read a reference table anew when it is next used."""
        self.catalog.get(name, "table")
        self._kept.pop(name.lower(), None)

    def advance(self, source: str, watermark_ms: int) -> None:
        """An external watermark of a source; it never falls."""
        self.watermarks[source.lower()] = max(watermark_ms, self.watermarks.get(source.lower(), watermark_ms))

    def _select(self, s: Statement) -> DataFrame:
        return self._sql(s.query)

    # --- relations -----------------------------------------------------------------------------

    def frame(self, name: str, streaming: bool = False, lateness_ms: int = 0) -> DataFrame:
        """The rows of a source, table, stream or view."""
        e = self.catalog.get(name)
        s = e.statement
        if e.kind in ("stream", "view"):
            return self._sql(s.query, streaming, s.lateness_ms)
        if e.kind == "sink":
            raise SqlError(f"{name} is a sink")
        if name.lower() in self._folders and streaming:
            df = self.spark.readStream.schema(s.schema).option("recursiveFileLookup", "true").parquet(self._folders[name.lower()])
        elif s.connector in self.connectors:
            df = self.connectors[s.connector][0](self.spark, s.options, s.schema, streaming and e.kind == "source")
        elif e.kind == "table" and "refresh" in s.options and s.connector == "files":
            df = self._reference(s)
        elif s.connector == "files":
            df = connectors.read_files(self.spark, s.options | ({"format": s.format} if s.format else {}), s.schema, streaming and e.kind == "source")
        elif s.connector == "kafka":
            reader = (self.spark.readStream if streaming else self.spark.read).format("kafka")
            from .sources.formats import decode

            df = decode(reader.options(**connectors.kafka_source(s.options)).load(), s.format or "json", s.schema, options=s.format_options)
        else:
            folder = f"{self.path}/data/{name.lower()}"
            schema = T.StructType([*s.schema.fields, T.StructField("__seq", T.LongType())])
            self._mkdirs(folder)
            if streaming and e.kind == "source":
                df = self.spark.readStream.schema(schema).parquet(folder).drop("__seq")
            else:
                df = self.spark.read.schema(schema).parquet(folder)
                if s.primary_key:
                    rest = [f.name for f in s.schema if f.name not in s.primary_key]
                    df = df.groupBy(*s.primary_key).agg(F.max_by(F.struct(F.lit(1).alias("__one"), *rest), "__seq").alias("__x")).select(*(F.col(c) if c in s.primary_key else F.col(f"__x.{c}").alias(c) for c in s.schema.fieldNames()))
                else:
                    df = df.drop("__seq")
        if e.kind == "source" and s.watermark:
            df = with_event_time(df, s.watermark.column, s.watermark.delay_ms, lateness_ms)
        return df

    def _reference(self, s: Statement) -> DataFrame:
        """A reference table as it was read last: once (snapshot), after refresh() (manual), or again after so many seconds (periodic).

        What was read is a copy under the engine's path; with cache_mode none the files are read at each use."""
        mode, every = connectors.reference_refresh(s.options["refresh"])
        key, now = s.name.lower(), time.monotonic()
        kept = self._kept.get(key)
        if s.options.get("cache_mode") == "none" or kept is None or (mode == "periodic" and now - kept[1] >= every):
            options = {k: v for k, v in s.options.items() if not k.startswith(("refresh", "cache_"))} | ({"format": s.format} if s.format else {})
            df = connectors.read_files(self.spark, options, s.schema, False)
            if s.options.get("cache_mode") == "none":
                return df
            copy = f"{self.path}/reference/{key}-{uuid.uuid4().hex}"
            df.write.parquet(copy)
            self._kept[key] = (self.spark.read.schema(df.schema).parquet(copy), now)
        return self._kept[key][0]

    def _mkdirs(self, path: str) -> None:
        jvm = self.spark._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(self.spark._jsc.hadoopConfiguration()).mkdirs(p)

    def _sql(self, sql: str, streaming: bool = False, lateness_ms: int = 0) -> DataFrame:
        mark = "NULL" if not self.watermarks else f"timestamp_millis({min(self.watermarks.values())}L)"
        sql = rewrite.call(sql, "WATERMARK", mark)
        if (a := rewrite.asof(sql)) is not None:
            sql, names, frames = self._asof(sql, a, streaming, lateness_ms)
        else:
            names = self.catalog.references(sql)
            frames = {n: self.frame(n, streaming, lateness_ms) for n in names}
        if streaming and (found := rewrite.lags(sql)) is not None:
            if len(names) != 1:
                raise SqlError("LAG and LEAD on streams take one relation")
            (n,) = names
            if rewrite.EVENT_TIME not in frames[n].columns:
                frames[n] = with_event_time(frames[n], found.order, 0)
            frames[n], sql = lags_stream(frames[n], found.keys, found.calls), found.sql
        integers = {f.name.lower() for df in frames.values() for f in df.schema if isinstance(f.dataType, (T.LongType, T.IntegerType))}
        sql = rewrite.renames(rewrite.intervals(sql, integers))
        if rewrite.find_window(sql) is not None:
            w = rewrite.find_window(sql)
            col = w.column.split(".")[-1].strip('`"')
            for n, df in frames.items():
                if rewrite.EVENT_TIME not in df.columns and col in df.columns:
                    frames[n] = with_event_time(df, col, 0)
            sql, _ = rewrite.windows(sql)
        views = {}
        for n in names:
            views[n] = f"__v_{n}_{uuid.uuid4().hex[:8]}"
            frames[n].createOrReplaceTempView(views[n])
        out, at, toks = [], 0, tokens(sql)
        found = self.catalog.relations(sql) if "__asof" not in names else [(t.start, t.end, "__asof") for t in toks if t.value == "__asof"]
        for start, end, n in found:
            i = next(k for k, t in enumerate(toks) if t.start == start)
            after = toks[i + 1].upper if i + 1 < len(toks) else ""
            aliased = re.fullmatch(r"[A-Za-z_`\"].*", after, re.S) and after not in _CLAUSES
            out += [sql[at:start], views[n] + ("" if aliased else f" AS {toks[i].text}")]
            at = end
        return self._tidy(self.spark.sql("".join([*out, sql[at:]])))

    def _asof(self, sql: str, a: rewrite.Asof, streaming: bool, lateness_ms: int) -> tuple[str, set[str], dict[str, DataFrame]]:
        """The query with its ASOF JOIN as one relation. On streams the join waits for the watermark; else it reads both sides' present rows."""
        left, right = self.frame(a.left, streaming, lateness_ms), self.frame(a.right, streaming, lateness_ms)
        keys = [k for k, _ in a.keys]
        right = right.withColumnsRenamed({r: k for k, r in a.keys if r != k})
        if streaming:
            if not (left.isStreaming and right.isStreaming):
                raise SqlError("both sides of an ASOF JOIN in a stream have to be streams")
            sides = [df if rewrite.EVENT_TIME in df.columns else with_event_time(df, t, 0) for df, t in ((left, a.left_time), (right, a.right_time))]
            joined = asof_stream(*sides, keys, a.direction, a.tolerance, suffix=f"_{a.right}")
        else:
            left, right = left.drop(rewrite.EVENT_TIME), right.drop(rewrite.EVENT_TIME)

            def ms(df: DataFrame, column: str):
                return F.col(column).cast("long") if isinstance(df.schema[column].dataType, (T.LongType, T.IntegerType)) else millis(column)

            left, right = left.withColumn("__lt", ms(left, a.left_time)), right.withColumn("__rt", ms(right, a.right_time))
            joined = asof_join(left, right, keys, "__lt", "__rt", a.direction, a.tolerance, suffix=f"_{a.right}").drop("__lt", "__rt")
        clash = {c: f"{c}_{a.right}" for c in left.columns if c not in keys}
        text = rewrite.unqualified(a.sql, a.right_alias, clash | {r: k for k, r in a.keys})
        return rewrite.unqualified(text, a.left_alias, {}).replace("{asof}", "__asof"), {"__asof"}, {"__asof": joined}

    def _tidy(self, df: DataFrame) -> DataFrame:
        return df.drop(rewrite.EVENT_TIME) if rewrite.EVENT_TIME in df.columns and not df.isStreaming else df

    # --- continuous queries --------------------------------------------------------------------

    def start(self) -> None:
        """Keep all streams and sinks running."""
        self._launch(None)

    def run(self) -> None:
        """Process what the sources hold now, through every stream and sink, and return."""
        self._launch({"availableNow": True})
        for q in list(self.running.values()):
            q.awaitTermination()
            if q.exception():
                raise q.exception()
        self.running.clear()

    def _launch(self, trigger: dict | None) -> None:
        if self.state == "stopped":
            raise SqlError("a stopped engine can't start again")
        self.state = "running"
        for name in self.catalog.order():
            e = self.catalog.entries[name]
            if e.statement.late_sink and e.state == "running":
                self._part_late(e, trigger)
            if e.kind in ("stream", "view") and self._unbounded(name) and e.state == "running":
                self.running[name] = self._continuous(e, trigger)
            elif e.kind == "sink" and e.state != "passive":
                self.running[name] = self._continuous(e, trigger)

    def _part_late(self, e: Entry, trigger: dict | None) -> None:
        """Part the rows of a stream's source: those in time go to files that the stream reads, late ones to its late sink."""
        s = e.statement
        (source,) = self.catalog.references(s.query)
        own, w = self.catalog.get(source).statement, rewrite.find_window(s.query)
        df = self.frame(source, True).drop(rewrite.EVENT_TIME)
        column = own.watermark.column
        ms = F.col(column).cast("long") if isinstance(own.schema[column].dataType, (T.LongType, T.IntegerType)) else millis(column)
        folder, sink = f"{self.path}/in_time/{e.name.lower()}", self.catalog.get(s.late_sink, "sink").statement
        self._mkdirs(folder)
        in_time = lambda batch, i: batch.drop("__ms").write.mode("overwrite").parquet(f"{folder}/b{i}")
        late = lambda batch, i: self._write(sink, batch.drop("__ms"), i)
        split = LateSplit(F.col("__ms"), own.watermark.delay_ms, in_time, late, f"{self.path}/late/{e.name.lower()}", F.expr(rewrite.last_end(w, "__ms")), s.lateness_ms)
        q = df.withColumn("__ms", ms).writeStream.foreachBatch(split).option("checkpointLocation", f"{self.path}/checkpoints/{e.name.lower()}__late")
        q = (q.trigger(**trigger) if trigger else q).start()
        if trigger:
            q.awaitTermination()
        else:
            self.running[f"{e.name.lower()}__late"] = q

    def _unbounded(self, name: str) -> bool:
        return any(self.catalog.entries[n].kind == "source" for n in self.catalog.closure({name}) if n in self.catalog.entries)

    def _continuous(self, e: Entry, trigger: dict | None):
        s, name = e.statement, e.name.lower()
        if e.kind == "sink":
            upstream = s.query if re.fullmatch(r"\w+", s.query) else None
            df = self.frame(upstream, True) if upstream else self._sql(s.query, True)
            source = self.catalog.entries.get(upstream.lower()).statement if upstream else s
            emit = source.emit if source.kind in ("stream", "view") else s.emit
        else:
            first = rewrite.top(s.query)
            emit = s.emit
            if s.late_sink:
                (source,) = self.catalog.references(s.query)
                self._folders[source] = f"{self.path}/in_time/{name}"
                try:
                    df = self._sql(s.query, True, s.lateness_ms)
                finally:
                    del self._folders[source]
            elif (each := rewrite.distinct(s.query)) is not None:
                df = self._sql(each, True, s.lateness_ms)
                df = df.dropDuplicates([c for c in df.columns if c != rewrite.EVENT_TIME])
            else:
                df = self._sql(first.sql if first else s.query, True, s.lateness_ms)
        if rewrite.EVENT_TIME in df.columns:
            df = df.drop(rewrite.EVENT_TIME)
        if e.kind == "sink" and s.where:
            df = df.where(s.where)
        aggregates = re.search(r"\bGROUP\s+BY\b", s.query if e.kind != "sink" or not upstream else source.query, re.I) is not None
        update = aggregates and emit.mode in ("update", "changes", "every")
        mode = "update" if update else "append"

        def deliver(batch: DataFrame, batch_id: int) -> None:
            if e.kind == "sink":
                self._write(s, batch, batch_id)
            else:
                connectors.write_files(batch.withColumn("_batch", F.lit(batch_id)), {"path": f"{self.path}/results/{name}"}, batch_id)
            for sub in self.subscriptions.get(name, []):
                sub.offer(batch)

        each = deliver
        if emit.mode == "changes" and aggregates:
            keys = [c for c in df.columns if c in ("window_start", "window_end") or c in self._grouped(s.query)]
            each = EmitChanges(keys, f"{self.path}/changes/{name}", deliver)
        if e.kind != "sink" and first:
            by = [order(o.column, o.descending, o.nulls_first) for o in first.order]
            each = TopK(first.k, by, deliver, f"{self.path}/top/{name}", first.keys)
        w = df.writeStream.foreachBatch(each).outputMode(mode).option("checkpointLocation", f"{self.path}/checkpoints/{name}").queryName(f"{name}_{uuid.uuid4().hex[:6]}")
        if trigger:
            w = w.trigger(**trigger)
        elif emit.every_ms:
            w = w.trigger(processingTime=f"{emit.every_ms} milliseconds")
        return w.start()

    def _grouped(self, sql: str) -> set[str]:
        span = rewrite._group_by(sql)
        return {t.value for t in tokens(sql[span[0] : span[1]]) if t.kind == "name"} if span else set()

    def _write(self, s: Statement, batch: DataFrame, batch_id: int) -> None:
        if s.connector in (None, "memory"):
            connectors.write_files(batch, {"path": f"{self.path}/sinks/{s.name.lower()}"}, batch_id)
        elif s.connector == "files":
            connectors.write_files(batch, s.options | ({"format": s.format} if s.format else {}), batch_id)
        elif s.connector == "kafka":
            connectors.kafka_rows(batch, s.options, s.format or "json", batch_id).write.format("kafka").options(**connectors.kafka_sink(s.options)).save()
        elif s.connector in self.connectors:
            self.connectors[s.connector][1](batch, s.options, batch_id)
        elif s.connector in ("postgres", "database"):
            connectors.write_database(batch, s.options)
        else:
            raise SqlError(f"{s.connector} needs its driver on the class path")

    def results(self, name: str) -> DataFrame:
        """What a stream, view or sink has put out so far."""
        e = self.catalog.get(name, "stream", "view", "sink")
        folder = "sinks" if e.kind == "sink" else "results"
        path = e.statement.options["path"] if e.kind == "sink" and e.statement.connector == "files" else f"{self.path}/{folder}/{name.lower()}"
        reader = self.spark.read.format(e.statement.format or "parquet") if e.kind == "sink" and e.statement.connector == "files" else self.spark.read
        if not self._exists(path):  # nothing has come yet
            return self.spark.createDataFrame([], self.get_schema(name)) if e.kind != "sink" else self.spark.createDataFrame([], "none int").drop("none")
        return reader.load(path).drop("batch", "_batch")

    def _exists(self, path: str) -> bool:
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(p)

    def subscribe(self, name: str, predicate: str | None = None, callback=None, **options) -> Subscription:
        self.catalog.get(name, "stream", "view", "sink")
        sub = Subscription(predicate, callback, **options)
        self.subscriptions.setdefault(name.lower(), []).append(sub)
        return sub

    def pause(self, name: str) -> None:
        self.catalog.get(name, "stream", "view").state = "paused"
        if (q := self.running.pop(name.lower(), None)) is not None:
            q.stop()

    def resume(self, name: str) -> None:
        self.catalog.get(name, "stream", "view").state = "running"

    def stop(self) -> None:
        self.state = "shutting_down"
        for q in self.running.values():
            q.stop()
        self.running.clear()
        self.state = "stopped"

    def metrics(self) -> dict[str, dict]:
        """Rows, batches and watermark of the running queries."""
        out = {}
        for n, q in self.running.items():
            p = q.lastProgress
            out[n] = {"batch": p["batchId"], "rows": p["numInputRows"], "watermark": (p.get("eventTime") or {}).get("watermark")} if p else {"batch": None, "rows": 0, "watermark": None}
        return out | {"uptime": {"state": self.state, "at": time.time()}}
