"""Connectors: files and memory run here; others become the options of Spark's own readers and writers."""

from __future__ import annotations

import random
import time
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

FILE_FORMATS = ("parquet", "orc", "csv", "json", "text")
SECRET = ("password", "secret", "token", "access.key", "sasl.jaas", "account.key", "credential")


class ConnectorError(ValueError):
    """A connector that is unknown or lacks an option."""


def masked(options: dict[str, str]) -> dict[str, str]:
    """Options as SHOW and DESCRIBE may print them."""
    return {k: "***" if any(s in k.lower() for s in SECRET) else v for k, v in options.items()}


def need(options: dict[str, str], *names: str) -> None:
    missing = [n for n in names if not options.get(n)]
    if missing:
        raise ConnectorError(f"missing option: {', '.join(missing)}")


# --- files -------------------------------------------------------------------------------------


def read_files(spark: SparkSession, options: dict[str, str], schema: T.StructType | None, streaming: bool) -> DataFrame:
    need(options, "path")
    fmt = options.get("format", "parquet").lower()
    if fmt in ("debezium", "raw"):  # a record a line
        from .formats import decode

        lines = read_files(spark, options | {"format": "text"}, T.StructType([T.StructField("value", T.StringType())]), streaming)
        return decode(lines, fmt, schema)
    if fmt not in FILE_FORMATS:
        raise ConnectorError(f"unknown file format: {fmt}")
    reader = spark.readStream if streaming else spark.read
    reader = reader.format(fmt)
    if schema is not None and len(schema):
        reader = reader.schema(schema)
    elif streaming:
        reader = reader.schema(spark.read.format(fmt).load(options["path"]).schema)
    for k, v in options.items():
        if k not in ("path", "format"):
            reader = reader.option({"max_files": "maxFilesPerTrigger"}.get(k, k), v)
    return reader.load(options["path"])


def write_files(df: DataFrame, options: dict[str, str], batch_id: int | None = None) -> None:
    """Append rows; with a batch id, the batch's own folder is overwritten, so a batch that runs twice is there once."""
    need(options, "path")
    path = options["path"] if batch_id is None else f"{options['path']}/batch={batch_id}"
    w = df.write.mode("append" if batch_id is None else "overwrite").format(options.get("format", "parquet"))
    w.save(path)


# --- Kafka -------------------------------------------------------------------------------------


def kafka_source(options: dict[str, str]) -> dict[str, str]:
    """Options of Spark's Kafka reader."""
    need(options, "bootstrap.servers")
    if not options.get("topic") and not options.get("topic.pattern"):
        raise ConnectorError("missing option: topic")
    out = {"kafka.bootstrap.servers": options["bootstrap.servers"]}
    out |= {"subscribePattern": options["topic.pattern"]} if options.get("topic.pattern") else {"subscribe": options["topic"]}
    start = options.get("startup.mode", "group").lower()
    if start in ("earliest", "latest"):
        out["startingOffsets"] = start
    elif start == "timestamp":
        need(options, "startup.timestamp.ms")
        out["startingTimestamp"] = options["startup.timestamp.ms"]
    elif start == "specific":
        need(options, "startup.offsets")
        offsets = ", ".join(f'"{p}": {o}' for p, o in (x.split(":") for x in options["startup.offsets"].split(",")))
        out["startingOffsets"] = f'{{"{options["topic"]}": {{{offsets}}}}}'
    elif start != "group":
        raise ConnectorError(f"unknown startup.mode: {start}")
    if options.get("group.id"):
        out["kafka.group.id"] = options["group.id"]
    if options.get("max.poll.records"):
        out["maxOffsetsPerTrigger"] = options["max.poll.records"]
    return out | {k: v for k, v in options.items() if k.startswith("kafka.")}


def kafka_sink(options: dict[str, str]) -> dict[str, str]:
    """Options of Spark's Kafka writer, which delivers at least once."""
    need(options, "bootstrap.servers", "topic")
    if options.get("delivery.guarantee", "at-least-once") not in ("at-least-once", "exactly-once"):
        raise ConnectorError("delivery.guarantee is at-least-once or exactly-once")
    out = {"kafka.bootstrap.servers": options["bootstrap.servers"], "topic": options["topic"], "kafka.acks": options.get("acks", "all")}
    if options.get("compression.type"):
        out["kafka.compression.type"] = options["compression.type"]
    if options.get("delivery.guarantee") == "exactly-once":
        out["kafka.enable.idempotence"] = "true"
    return out


def kafka_rows(df: DataFrame, options: dict[str, str], fmt: str, batch_id: int = 0) -> DataFrame:
    """key, value and (unless the producer is to choose by the key) partition of each row's record.

    partitioner: key-hash (default; the producer hashes the key, and without one spreads records),
    round-robin (rows of a task go to one partition after another) or sticky (a task's rows of a
    batch go to one); the last two need partitions, the topic's number of them."""
    from .formats import encode

    how = options.get("partitioner", "key-hash").lower()
    if how not in ("key-hash", "round-robin", "sticky"):
        raise ConnectorError(f"unknown partitioner: {how}")
    key = options.get("key.column")
    if key and key not in df.columns:
        raise ConnectorError(f"no such key.column: {key}")
    row = F.struct(*(F.col(f"`{c}`") for c in df.columns))
    keys = F.col(f"`{key}`").cast("string") if key else F.lit(None).cast("string")
    if fmt == "avro":
        if key or how != "key-hash":
            raise ConnectorError("Avro records go without key and partition")
        return encode(df, fmt)
    value = F.to_json(row, {"ignoreNullFields": "false"}) if fmt == "json" else F.to_csv(row)
    if how == "key-hash":
        return df.select(keys.alias("key"), value.alias("value"))
    need(options, "partitions")
    n = int(options["partitions"])
    task = F.shiftright(F.monotonically_increasing_id(), 33)
    at = F.monotonically_increasing_id() - F.shiftleft(task, 33)
    part = F.pmod(at + task if how == "round-robin" else F.xxhash64(F.lit(batch_id), task), F.lit(n))
    return df.select(keys.alias("key"), value.alias("value"), part.cast("int").alias("partition"))


COMPATIBILITY = ("NONE", "BACKWARD", "BACKWARD_TRANSITIVE", "FORWARD", "FORWARD_TRANSITIVE", "FULL", "FULL_TRANSITIVE")


def compatible(old: T.StructType, new: T.StructType, level: str) -> bool:
    """Whether a schema may follow another: backward, the new reads old rows; forward, the old reads new ones."""
    if level.upper() not in COMPATIBILITY:
        raise ConnectorError(f"unknown compatibility: {level}")
    level = level.upper().removesuffix("_TRANSITIVE")

    def reads(reader: T.StructType, writer: T.StructType) -> bool:
        have = {f.name: f for f in writer}
        return all((f.name in have and have[f.name].dataType == f.dataType) or (f.name not in have and f.nullable) for f in reader)

    return level == "NONE" or all(reads(*p) for p in {"BACKWARD": [(new, old)], "FORWARD": [(old, new)], "FULL": [(new, old), (old, new)]}[level])


def compatible_with_all(versions: list[T.StructType], new: T.StructType, level: str) -> bool:
    """Whether a schema may be the next version: a transitive level looks at all before, another at the last."""
    return all(compatible(old, new, level) for old in (versions if level.upper().endswith("_TRANSITIVE") else versions[-1:]))


class SchemaRegistry:
    """A registry's HTTP interface, from the driver; schemas are kept by their number, which never changes its meaning."""

    def __init__(self, url: str, timeout_s: float = 10.0, headers: dict[str, str] | None = None):
        self.url, self.timeout, self.headers = url.rstrip("/"), timeout_s, headers or {}
        self.kept: dict[int, str] = {}

    def _call(self, path: str, body: dict | None = None) -> dict:
        import json
        import urllib.error
        import urllib.request

        data = None if body is None else json.dumps(body).encode()
        request = urllib.request.Request(self.url + path, data, {"Content-Type": "application/vnd.schemaregistry.v1+json", **self.headers})  # noqa: S310
        try:
            with urllib.request.urlopen(request, timeout=self.timeout) as answer:  # noqa: S310
                return json.loads(answer.read())
        except urllib.error.HTTPError as e:
            raise ConnectorError(f"schema registry: {e.code} for {path}") from e

    def schema(self, number: int) -> str:
        if number not in self.kept:
            self.kept[number] = self._call(f"/schemas/ids/{number}")["schema"]
        return self.kept[number]

    def latest(self, subject: str) -> tuple[int, str]:
        found = self._call(f"/subjects/{subject}/versions/latest")
        self.kept[found["id"]] = found["schema"]
        return found["id"], found["schema"]

    def register(self, subject: str, schema: str) -> int:
        number = self._call(f"/subjects/{subject}/versions", {"schema": schema})["id"]
        self.kept[number] = schema
        return number

    def compatible(self, subject: str, schema: str) -> bool:
        return self._call(f"/compatibility/subjects/{subject}/versions/latest", {"schema": schema})["is_compatible"]


# --- databases and lake tables -----------------------------------------------------------------


def postgres_writer(options: dict[str, str], columns: list[str]) -> dict[str, str]:
    """url, dbtable and the statement that merges a staging table, for append or upsert."""
    need(options, "hostname", "database", "table.name")
    mode = options.get("write.mode", "append")
    url = f"jdbc:postgresql://{options['hostname']}:{options.get('port', '5432')}/{options['database']}"
    target = f"{options.get('schema.name', 'public')}.{options['table.name']}"
    if mode == "append":
        return {"url": url, "dbtable": target, "merge": ""}
    if mode != "upsert":
        raise ConnectorError(f"unknown write.mode: {mode}")
    need(options, "primary.key")
    keys = [k.strip() for k in options["primary.key"].split(",")]
    rest = [c for c in columns if c not in keys]
    names = ", ".join(f'"{c}"' for c in columns)
    act = "DO UPDATE SET " + ", ".join(f'"{c}" = EXCLUDED."{c}"' for c in rest) if rest else "DO NOTHING"
    staged = f"{target}_staging"
    return {"url": url, "dbtable": staged, "merge": f"INSERT INTO {target} ({names}) SELECT {names} FROM {staged} ON CONFLICT ({', '.join(f'{chr(34)}{k}{chr(34)}' for k in keys)}) {act}"}


def insert_statement(options: dict[str, str], columns: list[str], mark: str = "?") -> str:
    """The INSERT of one row; with write.mode upsert it replaces the row of the same primary key."""
    need(options, "table.name")
    names, keys = ", ".join(f'"{c}"' for c in columns), [k.strip() for k in options.get("primary.key", "").split(",") if k.strip()]
    sql = f"INSERT INTO {options['table.name']} ({names}) VALUES ({', '.join([mark] * len(columns))})"
    mode = options.get("write.mode", "append")
    if mode == "append":
        return sql
    if mode != "upsert" or not keys:
        raise ConnectorError("write.mode is append, or upsert with a primary.key")
    rest = [c for c in columns if c not in keys]
    act = "DO UPDATE SET " + ", ".join(f'"{c}" = excluded."{c}"' for c in rest) if rest else "DO NOTHING"
    return f"{sql} ON CONFLICT ({', '.join(f'{chr(34)}{k}{chr(34)}' for k in keys)}) {act}"


def write_database(df: DataFrame, options: dict[str, str], rows: int = 1000) -> int:
    """Write rows through a Python database driver, one connection and transaction a task; the number of rows.

    driver names its connect function (module:function); connect is what it is given. With
    write.mode upsert a task or batch that runs twice leaves the same rows; append delivers at least once."""
    need(options, "driver", "connect", "table.name")
    statement = insert_statement(options, df.columns, options.get("parameter", "?"))
    module, _, function = options["driver"].partition(":")

    def put(batches):
        import importlib

        import pyarrow as pa

        connection = getattr(importlib.import_module(module), function or "connect")(options["connect"])
        n = 0
        try:
            for b in batches:
                for at in range(0, b.num_rows, rows):
                    part = b.slice(at, rows)
                    connection.cursor().executemany(statement, list(zip(*(c.to_pylist() for c in part.columns), strict=True)))
                    n += part.num_rows
            connection.commit()
        finally:
            connection.close()
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], ["n"])

    return sum(r.n for r in df.mapInArrow(put, "n long").collect())


def lake_writer(options: dict[str, str]) -> dict[str, str]:
    """Options of a Delta or Iceberg write; a writer id makes batches idempotent."""
    need(options, "table.path")
    mode = options.get("write.mode", "append")
    if mode not in ("append", "overwrite", "upsert"):
        raise ConnectorError(f"unknown write.mode: {mode}")
    if mode == "upsert":
        need(options, "merge.key.columns")
    return {"path": options["table.path"], "mode": "append" if mode == "upsert" else mode, "txnAppId": options.get("writer.id", "tidewell")}


def partition_transforms(spec: str) -> list[tuple[str, str, int | None]]:
    """'day(ts), bucket(16, id), truncate(4, name), region' as (transform, column, width)."""
    import re

    out = []
    for part in re.findall(r"\w+\s*\([^)]*\)|\w+", spec):
        m = re.fullmatch(r"(\w+)\s*\(\s*(?:(\d+)\s*,\s*)?(\w+)(?:\s*,\s*(\d+))?\s*\)", part)
        if not m:
            out.append(("identity", part, None))
            continue
        if m[1].lower() not in ("identity", "bucket", "truncate", "year", "month", "day", "hour"):
            raise ConnectorError(f"unknown transform: {m[1]}")
        width = m[2] or m[4]
        if (m[1].lower() in ("bucket", "truncate")) != (width is not None):
            raise ConnectorError(f"{m[1]}: wrong arguments")
        out.append((m[1].lower(), m[3], int(width) if width else None))
    return out


def reference_refresh(text: str) -> tuple[str, int | None]:
    """snapshot, snapshot_plus_cdc, manual or periodic:<seconds>."""
    mode, _, n = text.strip().lower().partition(":")
    if mode == "periodic":
        if not n.isdigit() or int(n) <= 0:
            raise ConnectorError(f"refresh: {text}")
        return mode, int(n)
    if mode not in ("snapshot", "snapshot_plus_cdc", "manual") or n:
        raise ConnectorError(f"refresh: {text}")
    return mode, None


# --- what connectors share ---------------------------------------------------------------------


def retry(f: Callable, attempts: int = 3, base_s: float = 0.1, most_s: float = 10.0, on: tuple = (Exception,), sleep: Callable = time.sleep):
    """The result of f, tried again with growing, jittered pauses."""
    for i in range(attempts):
        try:
            return f()
        except on:
            if i + 1 == attempts:
                raise
            sleep(min(most_s, base_s * 2**i) * random.uniform(0.5, 1.0))


class CircuitOpen(RuntimeError):
    """Calls are refused until the pause is over."""


@dataclass
class CircuitBreaker:
    """Refuses calls after failures in a row, and lets one through after a pause."""

    failures: int = 5
    pause_s: float = 30.0
    clock: Callable[[], float] = time.monotonic
    count: int = field(default=0, init=False)
    opened: float | None = field(default=None, init=False)

    def call(self, f: Callable):
        if self.opened is not None and self.clock() - self.opened < self.pause_s:
            raise CircuitOpen
        try:
            out = f()
        except Exception:
            self.count += 1
            if self.count >= self.failures:
                self.opened = self.clock()
            raise
        self.count, self.opened = 0, None
        return out


@dataclass
class RateLimit:
    """A token bucket."""

    per_s: float
    burst: float
    clock: Callable[[], float] = time.monotonic

    def __post_init__(self) -> None:
        self.left, self.at = self.burst, self.clock()

    def take(self, n: float = 1) -> bool:
        now = self.clock()
        self.left, self.at = min(self.burst, self.left + (now - self.at) * self.per_s), now
        if self.left < n:
            return False
        self.left -= n
        return True
