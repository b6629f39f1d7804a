"""Registered queries that run as scripts through the engine: its statements, continuous queries, sinks and formats.

Each has its own engine folder below the shared one. Streams run over what their sources hold now;
a window is out once the watermark, an hour behind the latest event, has reached its end."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .engine import Engine
from .operators import changelog, joins
from .sources import formats
from .suite import DAY, EV, HOUR, events, folder, read

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_ORACLE: dict[str, str] = {}
_COLUMNS = "event_id BIGINT, ts TIMESTAMP, user_id BIGINT, event_type VARCHAR, value DOUBLE, props VARCHAR"
_WATERMARK = "WATERMARK FOR ts AS ts - INTERVAL '1' HOUR"
#: The watermark once all events are read, in milliseconds.
MARK = f", m AS (SELECT max(ms) - {HOUR} AS wm FROM ev) "


def files(d: str, name: str = "events", more: str = "") -> str:
    """The events table as a source of files. A stream's plain path has to be a folder and the table may be one file, so it is a pattern."""
    return f"CREATE SOURCE {name} ({_COLUMNS}, {_WATERMARK}) FROM files (path = '{d}/events.parque[t]', format = 'parquet'{more});"


def query(sql: str | None):
    def add(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql is not None:
            _ORACLE[f.__name__] = sql
        return f

    return add


def script(name: str, text: str, result: str, oracle: str, then: Callable[[DataFrame], DataFrame] | None = None) -> None:
    """A script over the events source, run, and the results of one of its objects."""

    def run(spark: SparkSession, d: str) -> DataFrame:
        e = Engine(spark, folder(spark), {"DATA": d})
        e.execute(files(d) + text)
        e.run()
        out = e.results(result)
        return then(out) if then else out

    _QUERIES[name], _ORACLE[name] = run, oracle


def batch(name: str, sql: str, oracle: str, tables: str = "") -> None:
    """An ad-hoc query over the events source and tables declared from files."""

    def run(spark: SparkSession, d: str) -> DataFrame:
        e = Engine(spark, folder(spark))
        e.execute(files(d) + "".join(f"CREATE TABLE {t} FROM files (path = '{d}/{t}.parquet', format = 'parquet');" for t in tables.split()))
        return e.execute(sql)

    _QUERIES[name], _ORACLE[name] = run, oracle


def net(keys: list[str], values: list[str]) -> Callable[[DataFrame], DataFrame]:
    """What a changelog amounts to."""
    return lambda df: changelog.consolidate(df, [*keys, *values]).drop("_weight")


# --- windows and EMIT --------------------------------------------------------------------------

script(
    "engine_tumble_close",
    "CREATE STREAM bars AS SELECT event_type, window_start, window_end, count(*) AS n, max(value) AS high FROM events GROUP BY event_type, tumble(ts, INTERVAL '1' HOUR) EMIT ON WINDOW CLOSE",
    "bars",
    EV + MARK + f"SELECT event_type, ms - ms % {HOUR} AS window_start, ms - ms % {HOUR} + {HOUR} AS window_end, count(*) AS n, max(value) AS high FROM ev, m WHERE ms - ms % {HOUR} + {HOUR} <= wm GROUP BY ALL",
)
_HOPS = f"SELECT s AS window_start, count(*) AS n, round(sum(value), 4) AS total FROM (SELECT *, unnest(range(ms - ms % {2 * HOUR} - {8 * HOUR}, ms + 1, {2 * HOUR})) AS s FROM ev), m WHERE s <= ms AND ms < s + {10 * HOUR} AND s + {10 * HOUR} <= wm GROUP BY 1"
for _name, _call, _emit in (("engine_hop_final", "hop", "EMIT FINAL"), ("engine_slide_watermark", "slide", "EMIT AFTER WATERMARK")):
    script(_name, f"CREATE STREAM w AS SELECT window_start, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY {_call}(ts, INTERVAL '2' HOUR, INTERVAL '10' HOUR) {_emit}", "w", EV + MARK + _HOPS)
script(
    "engine_session_close",
    "CREATE STREAM s AS SELECT user_id, window_start, window_end, count(*) AS n FROM events GROUP BY user_id, session(ts, INTERVAL '1' HOUR) EMIT ON WINDOW CLOSE",
    "s",
    EV + MARK[:-1] + f", a AS (SELECT *, CASE WHEN ms - lag(ms) OVER (PARTITION BY user_id ORDER BY ms) < {HOUR} THEN 0 ELSE 1 END AS new FROM ev), b AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ms) AS s FROM a) SELECT user_id, min(ms) AS window_start, max(ms) + {HOUR} AS window_end, count(*) AS n FROM b, m GROUP BY user_id, s, wm HAVING max(ms) + {HOUR} <= wm",
)
_USERS = EV + "SELECT user_id, count(*) AS n, max(value) AS high FROM ev GROUP BY 1"
_last = lambda df: df.groupBy("user_id").agg(F.max("n").alias("n"), F.max_by("high", "n").alias("high"))
script("engine_emit_update", "CREATE CONTINUOUS QUERY u AS SELECT user_id, count(*) AS n, max(value) AS high FROM events GROUP BY user_id EMIT ON UPDATE", "u", _USERS, _last)
script("engine_emit_every", "CREATE STREAM u AS SELECT user_id, count(*) AS n, max(value) AS high FROM events GROUP BY user_id EMIT EVERY INTERVAL '1' SECOND", "u", _USERS, _last)
script("engine_bounds_in_sql", "CREATE STREAM b AS SELECT CAST(tumble(ts, INTERVAL '6' HOUR) AS BIGINT) AS w, count(*) AS n FROM events GROUP BY tumble(ts, INTERVAL '6' HOUR)", "b", EV + MARK + f"SELECT ms - ms % {6 * HOUR} AS w, count(*) AS n FROM ev, m WHERE ms - ms % {6 * HOUR} + {6 * HOUR} <= wm GROUP BY 1")
script("engine_ascending_watermark", "CREATE SOURCE asc_events (event_id BIGINT, ts TIMESTAMP, user_id BIGINT, event_type VARCHAR, value DOUBLE, props VARCHAR, WATERMARK FOR ts) FROM files (path = '${DATA}/events.parque[t]', format = 'parquet'); CREATE STREAM b AS SELECT window_start, count(*) AS n FROM asc_events GROUP BY tumble(ts, INTERVAL '1' DAY) EMIT ON WINDOW CLOSE", "b", EV + f", m AS (SELECT max(ms) AS wm FROM ev) SELECT ms - ms % {DAY} AS window_start, count(*) AS n FROM ev, m WHERE ms - ms % {DAY} + {DAY} <= wm GROUP BY 1")


def halves(spark: SparkSession, d: str, rule: str = "event_id % 3 <> 0") -> list[DataFrame]:
    e = read(spark, d, "events").select("event_id", "ts", "user_id", "event_type", "value", "props")
    return [e.where(rule), e.where(f"NOT ({rule})")]


def two_engines(spark: SparkSession, d: str, text: str, result: str) -> DataFrame:
    """A script whose source gets its rows in two pushes; between them the engine is made anew on its folder."""
    path = folder(spark)
    for rows in halves(spark, d):
        e = Engine(spark, path)
        e.execute(f"CREATE SOURCE events ({_COLUMNS}, {_WATERMARK});" + text)
        e.push("events", rows)
        e.run()
    return e.results(result)


@query(_USERS)
def engine_emit_changes_restart(spark, d):
    return net(["user_id"], ["n", "high"])(two_engines(spark, d, "CREATE STREAM u AS SELECT user_id, count(*) AS n, max(value) AS high FROM events GROUP BY user_id EMIT CHANGES", "u"))


_LATE = EV + f", a AS (SELECT max(ms) - {HOUR} AS wm FROM ev WHERE event_id % 3 <> 0), m AS (SELECT max(ms) - {3 * HOUR} AS wm FROM ev), x AS (SELECT ev.*, event_id % 3 = 0 AND a.wm >= ms - ms % {HOUR} + {HOUR} + {2 * HOUR} AS late FROM ev, a) "
_LATE_SQL = "CREATE STREAM w AS SELECT window_start, count(*) AS n FROM events GROUP BY tumble(ts, INTERVAL '1' HOUR) EMIT ON WINDOW CLOSE ALLOW LATENESS INTERVAL '2' HOUR LATE DATA TO too_late"


@query(_LATE + "SELECT event_id, value FROM x WHERE late")
def engine_late_data(spark, d):
    return two_engines(spark, d, _LATE_SQL, "too_late").select("event_id", "value")


@query(_LATE + f"SELECT ms - ms % {HOUR} AS window_start, count(*) AS n FROM x, m WHERE NOT late AND ms - ms % {HOUR} + {HOUR} <= wm GROUP BY 1")
def engine_allowed_lateness(spark, d):
    return two_engines(spark, d, _LATE_SQL, "w")


# --- ordered streams ---------------------------------------------------------------------------

_TOP = "SELECT event_id, value, CAST(row_number() OVER (ORDER BY value DESC, event_id) AS INT) AS rank FROM events ORDER BY value DESC, event_id LIMIT 7"


@query(_TOP)
def engine_top_k_restart(spark, d):
    return net(["rank"], ["event_id", "value"])(two_engines(spark, d, "CREATE STREAM t AS SELECT event_id, value FROM events ORDER BY value DESC, event_id LIMIT 7", "t"))


@query("SELECT * FROM (SELECT user_id, event_id, value, CAST(row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS INT) AS rank FROM events) WHERE rank <= 2")
def engine_top_k_groups(spark, d):
    sql = "CREATE STREAM t AS SELECT * FROM (SELECT user_id, event_id, value, ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS rn FROM events) WHERE rn < 3"
    return net(["user_id", "rank"], ["event_id", "value"])(two_engines(spark, d, sql, "t"))


script(
    "engine_lag_lead",
    "CREATE STREAM l AS SELECT event_id, LAG(value) OVER (PARTITION BY user_id ORDER BY ts) AS before, LEAD(value, 2, -1.0) OVER (PARTITION BY user_id ORDER BY ts) AS after FROM events",
    "l",
    EV + MARK[:-1] + ", s AS (SELECT *, epoch_us(ts) < wm * 1000 AS settled FROM ev, m), k AS (SELECT *, bool_and(settled) OVER (PARTITION BY user_id) AS over FROM s), w AS (SELECT event_id, over, lag(value) OVER u AS before, lead(value, 2) OVER u AS after, lead(event_id, 2) OVER u AS follows FROM k WHERE settled WINDOW u AS (PARTITION BY user_id ORDER BY ts)) SELECT event_id, before, CASE WHEN follows IS NULL THEN -1.0 ELSE after END AS after FROM w WHERE over OR follows IS NOT NULL",
)


def _quotes(spark: SparkSession, d: str) -> Engine:
    """An engine with the sources trades (all events) and quotes, which a sink of another engine has written."""
    path = folder(spark)
    first = Engine(spark, path + "-a")
    first.execute(files(d) + f"CREATE SINK out FROM (SELECT event_id AS q_id, user_id, ts AS q_ts, value AS bid FROM events) WHERE bid > 100 INTO files (path = '{path}-q') FORMAT parquet")
    first.run()
    e = Engine(spark, path)
    e.execute(files(d, "trades") + f"CREATE SOURCE quotes (q_id BIGINT, user_id BIGINT, q_ts TIMESTAMP, bid DOUBLE, WATERMARK FOR q_ts AS q_ts - INTERVAL '1' HOUR) FROM files (path = '{path}-q', format = 'parquet', recursiveFileLookup = 'true')")
    return e


_ASOF = EV + f", q AS (SELECT event_id AS q_id, user_id, ts AS q_ts, value AS bid FROM ev WHERE value > 100), m AS (SELECT least((SELECT max(ms) FROM ev), (SELECT max(CAST(epoch_us(q_ts) // 1000 AS BIGINT)) FROM q)) - {HOUR} AS wm), t AS (SELECT * FROM ev, m WHERE epoch_us(ts) < wm * 1000) "


@query(_ASOF + f"SELECT t.event_id, CASE WHEN epoch_us(t.ts) - epoch_us(q.q_ts) <= {6 * HOUR * 1000} THEN q.q_id END AS q_id FROM t ASOF LEFT JOIN q ON t.user_id = q.user_id AND t.ts >= q.q_ts")
def engine_asof_stream(spark, d):
    e = _quotes(spark, d)
    e.execute("CREATE STREAM a AS SELECT t.event_id, q.q_id FROM trades t ASOF JOIN quotes q MATCH_CONDITION(t.ts >= q.q_ts AND t.ts - q.q_ts <= INTERVAL '6' HOUR) ON t.user_id = q.user_id")
    e.run()
    return e.results("a")


@query(EV + ", q AS (SELECT event_id AS q_id, user_id, ts AS q_ts, value AS bid FROM ev WHERE value > 100) SELECT ev.event_id, q.q_id, q.bid FROM ev ASOF LEFT JOIN q ON ev.user_id = q.user_id AND ev.ts >= q.q_ts")
def engine_asof_batch(spark, d):
    return _quotes(spark, d).execute("SELECT t.event_id, q.q_id, q.bid FROM trades t ASOF JOIN quotes q ON t.user_id = q.user_id AND t.ts >= q.q_ts")


script(
    "engine_interval_join",
    "CREATE STREAM a AS SELECT event_id, user_id, ts FROM events WHERE event_type = 'click'; CREATE STREAM b AS SELECT event_id AS r_id, user_id AS r_user, ts AS r_ts FROM events WHERE event_type = 'purchase'; CREATE STREAM j AS SELECT a.event_id, b.r_id FROM a JOIN b ON a.user_id = b.r_user AND b.r_ts BETWEEN a.ts - INTERVAL '2' HOUR AND a.ts + INTERVAL '2' HOUR",
    "j",
    "SELECT a.event_id, b.event_id AS r_id FROM events a JOIN events b ON a.user_id = b.user_id AND b.ts BETWEEN a.ts - INTERVAL 2 HOUR AND a.ts + INTERVAL 2 HOUR WHERE a.event_type = 'click' AND b.event_type = 'purchase'",
)

# --- statements --------------------------------------------------------------------------------

script("engine_cascade_sink", "CREATE STREAM big AS SELECT event_id, user_id, event_type, value FROM events WHERE value > 50; CREATE STREAM huge AS SELECT event_id, event_type, value FROM big WHERE value > 100; CREATE SINK out FROM huge WHERE event_type <> 'view'", "out", "SELECT event_id, event_type, value FROM events WHERE value > 100 AND event_type <> 'view'")
script("engine_view", "CREATE STREAM big AS SELECT event_id, user_id, value FROM events WHERE value > 50; CREATE MATERIALIZED VIEW v AS SELECT event_id, value * 2 AS double_value FROM big", "v", "SELECT event_id, value * 2 AS double_value FROM events WHERE value > 50")
script("engine_view_aggregate", "CREATE MATERIALIZED VIEW v AS SELECT event_type, count(*) AS n FROM events GROUP BY event_type EMIT CHANGES", "v", "SELECT event_type, count(*) AS n FROM events GROUP BY 1", net(["event_type"], ["n"]))
script("engine_distinct", "CREATE STREAM k AS SELECT DISTINCT user_id, event_type FROM events", "k", "SELECT DISTINCT user_id, event_type FROM events")
script("engine_union", "CREATE STREAM u AS SELECT event_id, 'a' AS side FROM events WHERE value > 90 UNION ALL SELECT event_id, 'b' AS side FROM events WHERE value < 10", "u", "SELECT event_id, 'a' AS side FROM events WHERE value > 90 UNION ALL SELECT event_id, 'b' FROM events WHERE value < 10")
batch("engine_cte_scope", "WITH events AS (SELECT 1 AS x UNION ALL SELECT 2), e AS (SELECT x FROM events) SELECT x, (SELECT count(*) FROM customer) AS n, 'FROM events watermark()' AS s FROM e", "WITH e AS (SELECT 1 AS x UNION ALL SELECT 2) SELECT x, (SELECT count(*) FROM customer) AS n, 'FROM events watermark()' AS s FROM e", "customer")
batch("engine_cross_join", "SELECT r_name, n_name FROM region CROSS JOIN nation", "SELECT r_name, n_name FROM region CROSS JOIN nation", "region nation")
batch("engine_natural_join", "SELECT n_name, r_name FROM nation NATURAL JOIN (SELECT r_regionkey AS n_regionkey, r_name FROM region) r", "SELECT n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey", "region nation")
batch("engine_output_names", "SELECT e.event_id, e.value AS e_value, c.c_name FROM events e LEFT JOIN customer c ON e.user_id = c.c_custkey AND c.c_acctbal > 0", "SELECT e.event_id, e.value AS e_value, c.c_name FROM events e LEFT JOIN customer c ON e.user_id = c.c_custkey AND c.c_acctbal > 0", "customer")
batch("engine_arrays", "SELECT user_id, x FROM (SELECT user_id, explode(array_sort(collect_set(event_type))) AS x FROM events GROUP BY user_id)", "SELECT DISTINCT user_id, event_type AS x FROM events")
batch("engine_array_functions", "SELECT user_id, element_at(a, 1) AS first_type, array_contains(a, 'click') AS clicks, CARDINALITY(a) AS n FROM (SELECT user_id, array_sort(collect_set(event_type)) AS a FROM events GROUP BY user_id)", "SELECT user_id, a[1] AS first_type, list_contains(a, 'click') AS clicks, CAST(len(a) AS INT) AS n FROM (SELECT user_id, list_sort(list(DISTINCT event_type)) AS a FROM events GROUP BY user_id)")
batch("engine_renamed_functions", "SELECT event_type, VAR(value) IS NOT NULL AS v, round(MEAN(value), 6) AS mean, STRPOS(event_type, 'c') AS at FROM events GROUP BY event_type", "SELECT event_type, var_samp(value) IS NOT NULL AS v, round(avg(value), 6) AS mean, CAST(strpos(event_type, 'c') AS INT) AS at FROM events GROUP BY event_type")


@query(f"SELECT event_id, CAST(epoch_us(ts) // 1000 AS BIGINT) - {2 * HOUR} AS before, CAST(epoch_us(ts) // 1000 AS BIGINT) + 1500 AS after FROM events")
def engine_bigint_intervals(spark, d):
    e = Engine(spark, folder(spark))
    e.execute("CREATE TABLE t (event_id BIGINT, ms BIGINT)")
    e.push("t", events(spark, d).select("event_id", "ms"))
    return e.execute("SELECT event_id, ms - INTERVAL '2' HOUR AS before, ms + INTERVAL '1500' MILLISECOND AS after FROM t")


@query("SELECT user_id AS id, max(event_id) AS event_id, arg_max(value, event_id) AS value, count(*) > 0 AS seen FROM events GROUP BY 1")
def engine_upsert_restart(spark, d):
    path = folder(spark)
    ids = read(spark, d, "events").select("user_id", "event_id", "value")
    for rows in (ids.groupBy("user_id").agg(F.min("event_id"), F.lit(0.0)), ids.groupBy("user_id").agg(F.max("event_id"), F.max_by("value", "event_id"))):
        e = Engine(spark, path)
        e.execute("CREATE TABLE users (id BIGINT PRIMARY KEY, event_id BIGINT, value DOUBLE)")
        e.push("users", rows.toDF("id", "event_id", "value"))
    return e.execute("SELECT id, event_id, value, true AS seen FROM users")


@query("SELECT 'a' AS k, 1.5 AS v, 10 AS n UNION ALL SELECT 'b', NULL, 20 UNION ALL SELECT NULL, 2.5, NULL UNION ALL SELECT event_type, max(value), 0 FROM events GROUP BY 1")
def engine_insert(spark, d):
    e = Engine(spark, folder(spark), {"T": "t"})
    e.execute(files(d) + "CREATE TABLE ${T} (k VARCHAR, v DOUBLE, n INT); INSERT INTO t VALUES ('a', 1.5, 10), ('b', NULL, 20); INSERT INTO t (v) VALUES (2.5); INSERT INTO t SELECT event_type, max(value), 0 FROM events GROUP BY event_type")
    return e.execute("SELECT * FROM t")


@query("SELECT e.event_id, e.value, c_name FROM events e JOIN customer ON user_id = c_custkey")
def engine_lookup_stream(spark, d):
    e = Engine(spark, folder(spark))
    e.execute(files(d) + f"CREATE TABLE customer (c_custkey BIGINT, c_name VARCHAR) FROM files (path = '{d}/customer.parquet', format = 'parquet') WITH (refresh = 'periodic:60', cache_mode = 'full'); CREATE STREAM j AS SELECT e.event_id, e.value, c.c_name FROM events e JOIN customer c ON e.user_id = c.c_custkey")
    e.run()
    return e.results("j")


@query("SELECT 'before' AS at, count(*) AS n FROM customer UNION ALL SELECT 'kept', count(*) FROM customer UNION ALL SELECT 'refreshed', count(*) + 1 FROM customer")
def engine_reference_refresh(spark, d):
    """A manual reference table keeps its rows until it is told to read them again."""
    path = folder(spark)
    read(spark, d, "customer").select("c_custkey").write.parquet(f"{path}-t")
    e = Engine(spark, path)
    e.execute(f"CREATE TABLE c (c_custkey BIGINT) FROM files (path = '{path}-t', format = 'parquet') WITH (refresh = 'manual')")
    count = lambda: e.execute("SELECT count(*) AS n FROM c").head().n
    found = [("before", count())]
    spark.createDataFrame([(-1,)], "c_custkey long").write.mode("append").parquet(f"{path}-t")
    found.append(("kept", count()))
    e.refresh("c")
    found.append(("refreshed", count()))
    return spark.createDataFrame(found, "at string, n long")


@query("SELECT * FROM (VALUES ('source', 'events', ''), ('stream', 'a', 'events'), ('view', 'v', 'a'), ('sink', 'out', 'v'), ('table', 't', '')) x(kind, name, depends)")
def engine_show(spark, d):
    e = Engine(spark, folder(spark))
    e.execute(files(d) + "CREATE TABLE t (a INT); CREATE STREAM a AS SELECT event_id FROM events; CREATE MATERIALIZED VIEW v AS SELECT event_id FROM a; CREATE SINK out FROM v; CREATE STREAM gone AS SELECT event_id FROM a; DROP STREAM gone; DROP TABLE IF EXISTS nothing")
    kinds = {"source": "SOURCES", "stream": "QUERIES", "view": "MATERIALIZED VIEWS", "sink": "SINKS", "table": "TABLES"}
    out = None
    for kind, words in kinds.items():
        one = e.execute(f"SHOW {words}").select(F.lit(kind).alias("kind"), "name", "depends")
        out = one if out is None else out.unionAll(one)
    return out


@query("SELECT * FROM (VALUES ('event_id', 'bigint', true), ('ts', 'timestamp_ntz', true), ('user_id', 'bigint', true), ('event_type', 'string', true), ('value', 'double', true), ('props', 'string', true), ('# kind', 'source', false), ('# watermark', 'ts - 3600000 ms', false)) x(column_name, data_type, nullable)")
def engine_describe(spark, d):
    e = Engine(spark, folder(spark))
    e.execute(files(d))
    return e.execute("DESCRIBE EXTENDED events").where("comment <> 'option' AND column_name <> '# depends'").select("column_name", "data_type", "nullable")


@query("SELECT * FROM (VALUES ('kind', 'stream'), ('depends', 'events'), ('emit', 'close'), ('window', 'tumble of 3600000 ms'), ('asof', 'false'), ('order', 'events, w')) x(plan_key, plan_value)")
def engine_explain(spark, d):
    e = Engine(spark, folder(spark))
    sql = "CREATE STREAM w AS SELECT count(*) AS n FROM events GROUP BY tumble(ts, INTERVAL '1' HOUR) EMIT ON WINDOW CLOSE"
    e.execute(files(d) + sql)
    order = spark.createDataFrame([("order", ", ".join(x.split(" ")[0] for x in e.topology().splitlines()))], "plan_key string, plan_value string")
    return e.execute(f"EXPLAIN {sql}").where("plan_key <> 'plan'").unionAll(order)


@query("SELECT event_id, value FROM events WHERE value > 50 AND event_type IN ('click', 'view')")
def engine_subscription(spark, d):
    """Rows that a subscription's predicate lets through, taken from its queue."""
    e = Engine(spark, folder(spark))
    e.execute(files(d) + "CREATE STREAM s AS SELECT event_id, event_type, value FROM events")
    sub = e.subscribe("s", "value > 50 AND event_type IN ('click', 'view')")
    e.run()
    return spark.createDataFrame([(r.event_id, r.value) for rows in sub for r in rows], "event_id long, value double")


@query(f"SELECT count(*) AS n FROM events WHERE epoch_us(ts) // 1000 < (SELECT max(epoch_us(ts) // 1000) - {HOUR} FROM events)")
def engine_watermark_function(spark, d):
    """An external watermark, in SQL."""
    e = Engine(spark, folder(spark))
    e.execute(files(d))
    last = events(spark, d).agg(F.max("ms")).head()[0]
    e.advance("events", last - HOUR)
    e.advance("events", 0)
    return e.execute("SELECT count(*) AS n FROM events WHERE unix_millis(CAST(ts AS TIMESTAMP)) < unix_millis(watermark())")


@query("SELECT event_id, value * 2 + 1 AS v FROM events")
def engine_scalar_function(spark, d):
    e = Engine(spark, folder(spark))
    e.execute(files(d))

    def twice(x: pd.Series) -> pd.Series:
        return x * 2 + 1

    e.register_function("twice_and_one", twice, "double")
    return e.execute("SELECT event_id, twice_and_one(value) AS v FROM events")


@query("SELECT event_type, round(max(value) - min(value), 6) AS spread FROM events GROUP BY 1")
def engine_aggregate_function(spark, d):
    e = Engine(spark, folder(spark))
    e.execute(files(d))

    def spread(x: pd.Series) -> float:
        return float(x.max() - x.min())

    e.register_aggregate("spread", spread, "double")
    return e.execute("SELECT event_type, round(spread(value), 6) AS spread FROM events GROUP BY event_type")


class _Digits:
    def eval(self, n: int) -> Iterator[tuple[int, int]]:
        for i, x in enumerate(str(n)):
            yield i, int(x)


@query("SELECT c_custkey, CAST(i - 1 AS INT) AS place, CAST(substr(CAST(c_custkey AS VARCHAR), CAST(i AS INT), 1) AS INT) AS digit FROM customer, unnest(range(1, len(CAST(c_custkey AS VARCHAR)) + 1)) u(i)")
def engine_table_function(spark, d):
    e = Engine(spark, folder(spark))
    e.execute(f"CREATE TABLE customer FROM files (path = '{d}/customer.parquet', format = 'parquet')")
    e.register_table_function("digits_of", _Digits, "place int, digit int")
    return e.execute("SELECT c.c_custkey, x.place, x.digit FROM customer c, LATERAL digits_of(c.c_custkey) x")


@query("SELECT event_id, value FROM events WHERE event_id % 2 = 0")
def engine_custom_connector(spark, d):
    """A source and a sink that a user has written."""
    path = folder(spark)
    e = Engine(spark, path)
    e.register_connector("evens", lambda s, options, schema, streaming: (s.readStream.schema(schema) if streaming else s.read.schema(schema)).parquet(options["path"]).where("event_id % 2 = 0"), lambda rows, options, i: rows.write.mode("overwrite").parquet(f"{options['path']}/b{i}"))
    e.execute(f"CREATE SOURCE x ({_COLUMNS}) FROM evens (path = '{d}/events.parque[t]'); CREATE SINK y FROM x INTO evens (path = '{path}-y')")
    e.run()
    return spark.read.option("recursiveFileLookup", "true").parquet(f"{path}-y").select("event_id", "value")


@query("SELECT event_id, value FROM events")
def engine_writer_pause(spark, d):
    """Rows written one by one reach a stream that was paused, resumed and restarted."""
    e = Engine(spark, folder(spark))
    e.execute("CREATE SOURCE x (event_id BIGINT, value DOUBLE); CREATE STREAM s AS SELECT event_id, value FROM x")
    rows = read(spark, d, "events").select("event_id", "value")
    e.push("x", rows.where("event_id >= 20"))
    e.pause("s")
    e.run()
    e.resume("s")
    with e.writer("x", 8) as w:
        for r in rows.where("event_id < 20").collect():
            w.write(r.event_id, r.value)
    e.run()
    return e.results("s")


# --- record formats ----------------------------------------------------------------------------

_RECORDS = T.StructType([T.StructField("event_id", T.LongType(), False), T.StructField("ts", T.TimestampNTZType()), T.StructField("event_type", T.StringType()), T.StructField("value", T.DoubleType())])


def _round_trip(name: str, fmt: str) -> None:
    def run(spark: SparkSession, d: str) -> DataFrame:
        rows = read(spark, d, "events").select("event_id", "ts", "event_type", "value")
        # Avro's bytes are read by the schema that they were written with.
        return formats.decode(formats.encode(rows, fmt), fmt, rows.schema if fmt == "avro" else _RECORDS)

    _QUERIES[name], _ORACLE[name] = run, "SELECT event_id, ts, event_type, value FROM events"


for _f in ("json", "csv", "avro"):
    _round_trip(f"format_{_f}", _f)


@query("SELECT event_id, octet_length(encode(event_type)) AS n FROM events")
def format_raw(spark, d):
    rows = read(spark, d, "events")
    return formats.decode(rows, "raw", None, "event_type", keep=["event_id"]).select("event_id", F.octet_length("value").cast("long").alias("n"))


def _files_of(name: str, fmt: str) -> None:
    """A sink and then a source of files in a format."""

    def run(spark: SparkSession, d: str) -> DataFrame:
        path = folder(spark)
        a, b = Engine(spark, path + "-a"), Engine(spark, path)
        a.execute(files(d) + f"CREATE SINK out FROM (SELECT event_id, user_id, event_type, value FROM events) INTO files (path = '{path}-f') FORMAT {fmt}")
        a.run()
        b.execute(f"CREATE SOURCE x (event_id BIGINT, user_id BIGINT, event_type VARCHAR, value DOUBLE) FROM files (path = '{path}-f', recursiveFileLookup = 'true') FORMAT {fmt}; CREATE STREAM s AS SELECT * FROM x WHERE value > 20")
        b.run()
        return b.results("s")

    _QUERIES[name], _ORACLE[name] = run, "SELECT event_id, user_id, event_type, value FROM events WHERE value > 20"


for _f in ("json", "csv", "orc"):
    _files_of(f"engine_files_{_f}", _f)


@query("SELECT event_id, value, CASE WHEN event_id % 5 = 0 THEN 'd' WHEN event_id % 5 = 1 THEN 'u' ELSE 'c' END AS __op FROM events WHERE event_id % 5 <> 2")
def engine_debezium(spark, d):
    """Envelopes in lines of text, as a source; unknown operations are left out."""
    e = read(spark, d, "events")
    op = F.when(F.col("event_id") % 5 == 0, "d").when(F.col("event_id") % 5 == 1, "u").when(F.col("event_id") % 5 == 2, "x").otherwise("c")
    row, path = F.struct("event_id", "value"), folder(spark)
    e.select(F.to_json(F.struct(F.when(op.isin("d", "u"), row).alias("before"), F.when(op != "d", row).alias("after"), op.alias("op"), F.lit(1).cast("long").alias("ts_ms"))).alias("value")).write.text(f"{path}-z")
    x = Engine(spark, path)
    x.execute(f"CREATE SOURCE changes (event_id BIGINT, value DOUBLE) FROM files (path = '{path}-z') FORMAT debezium; CREATE STREAM s AS SELECT event_id, value, __op FROM changes")
    x.run()
    return x.results("s")


_CDC = "WITH e AS (SELECT user_id, event_id, value, lag(value) OVER (PARTITION BY user_id ORDER BY event_id) AS old FROM events) "


@query(_CDC + "SELECT user_id, arg_max(value, event_id) AS value, CAST(1 AS BIGINT) AS _weight FROM e GROUP BY 1")
def cdc_to_table(spark, d):
    """Inserts and updates of a change log, with row images, amount to the table's present rows."""
    e = read(spark, d, "events").selectExpr("user_id", "event_id", "value", "lag(value) OVER (PARTITION BY user_id ORDER BY event_id) AS old")
    image = lambda v: F.to_json(F.struct("user_id", F.col(v).alias("value")))
    log = e.select(F.lit("users").alias("_table"), F.when(F.col("old").isNull(), "I").otherwise("U").alias("_op"), F.col("event_id").alias("_ts_ms"), F.when(F.col("old").isNotNull(), image("old")).alias("_before"), image("value").alias("_after"))
    rows = changelog.cdc_changes(log, T.StructType([T.StructField("user_id", T.LongType()), T.StructField("value", T.DoubleType())]))
    return changelog.consolidate(rows, ["user_id", "value"])


# --- retractions -------------------------------------------------------------------------------

_HALF = 1_705_276_800_000
_HOURS = "SELECT ms - ms % {hour} AS window_start, count(*) AS n FROM ev {where} GROUP BY 1"


@query(EV + f", a AS ({_HOURS.format(hour=HOUR, where='WHERE event_id % 3 <> 0')}), b AS ({_HOURS.format(hour=HOUR, where='')}) SELECT window_start, 'update_before' AS _op, -1 AS _weight, a.n FROM a JOIN b USING (window_start) WHERE a.n <> b.n UNION ALL SELECT window_start, CASE WHEN a.n IS NULL THEN 'insert' ELSE 'update_after' END, 1, b.n FROM b LEFT JOIN a USING (window_start) WHERE a.n IS DISTINCT FROM b.n")
def late_retraction(spark, d):
    """Windows that late rows change are retracted and given again."""
    e = events(spark, d)
    hours = lambda df: df.groupBy((F.col("ms") - F.pmod("ms", F.lit(HOUR))).alias("window_start")).agg(F.count("*").alias("n"))
    return changelog.late_retractions(hours(e.where("event_id % 3 <> 0")), hours(e.where("event_id % 3 = 0")), ["window_start"], {"n": lambda old, new: old + new})


@query(EV + f", o AS (SELECT user_id, arg_max(value, event_id) AS v FROM ev WHERE ms < {_HALF} GROUP BY 1), n AS (SELECT user_id, arg_max(value, event_id) AS v FROM ev GROUP BY 1) SELECT c_custkey, 'update_before' AS _op, -1 AS _weight, o.v FROM customer JOIN o ON c_custkey = o.user_id JOIN n ON c_custkey = n.user_id WHERE o.v <> n.v UNION ALL SELECT c_custkey, CASE WHEN o.v IS NULL THEN 'insert' ELSE 'update_after' END, 1, n.v FROM customer JOIN n ON c_custkey = n.user_id LEFT JOIN o ON c_custkey = o.user_id WHERE o.v IS DISTINCT FROM n.v")
def temporal_update_retraction(spark, d):
    """A change of the table retracts what a process-time join has put out, and gives the new rows."""
    e = events(spark, d).select("user_id", "event_id", F.col("value").alias("v"), "ms")
    left = read(spark, d, "customer").select("c_custkey", F.col("c_custkey").alias("user_id"))
    return joins.temporal_changes(left, e.where(F.col("ms") < _HALF), e, ["user_id"], ["event_id"], ["c_custkey"], ["v"])


@query(EV + ", z AS (SELECT event_type, ms, event_id, value AS v FROM ev WHERE event_id % 3 <> 0) SELECT event_type, arg_min(v, event_id) AS first_v, arg_max(v, event_id) AS last_v FROM z GROUP BY 1")
def retract_first_last(spark, d):
    e = events(spark, d).select("event_type", "ms", "event_id", F.col("value").alias("v"))
    log = e.withColumn("_weight", F.lit(1)).unionAll(e.where("event_id % 3 = 0").withColumn("_weight", F.lit(-1)))
    return changelog.retract_first_last(log, ["event_type"], "v", ["ms", "event_id"]).withColumnsRenamed({"first": "first_v", "last": "last_v"})


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_ORACLE)

