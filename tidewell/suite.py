"""The registered queries of the engine, each with the same query in standard SQL.

Event times are compared as epoch milliseconds; double sums are rounded on both sides, for
their last digits depend on the order of the rows."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .functions.time import millis
from .operators import changelog, joins, topk, windows
from .operators.aggregates import ohlc, retractable
from .sources.connectors import write_files

Query = Callable[[SparkSession, str], DataFrame]
HOUR = 3_600_000
DAY = 24 * HOUR
_QUERIES: dict[str, Query] = {}
_ORACLE: dict[str, str] = {}


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events with ms, the event time in epoch milliseconds."""
    return read(spark, sf_dir, "events").withColumn("ms", millis("ts"))


def query(sql: str | None = None):
    def add(f: Query) -> Query:
        name = f.__name__
        _QUERIES[name] = f
        if sql is not None:
            _ORACLE[name] = sql
        return f

    return add


def plain(name: str, spark_sql: str, duck_sql: str | None = None, tables: str = "events") -> None:
    """A query that both engines read as SQL."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        frames = {t: (events(spark, sf_dir) if t == "events" else read(spark, sf_dir, t)) for t in tables.split()}
        return spark.sql(spark_sql.format(**{t: "{" + t + "}" for t in frames}), **frames)

    _QUERIES[name] = run
    _ORACLE[name] = EV + (duck_sql or spark_sql).format(**{t: ("ev" if t == "events" else t) for t in tables.split()})


EV = "WITH ev AS (SELECT *, CAST(epoch_us(ts) // 1000 AS BIGINT) AS ms FROM events) "


# --- windows -----------------------------------------------------------------------------------

@query(EV + f"SELECT event_type, ms - ms % {HOUR} AS window_start, arg_min(value, event_id) AS open, max(value) AS high, min(value) AS low, arg_max(value, event_id) AS close, count(*) AS n FROM (SELECT * FROM ev) GROUP BY 1, 2")
def tumble_ohlc(spark, d):
    # event_id follows event time: ties are none and arrival is time order.
    return windows.tumble(events(spark, d), "ms", HOUR).groupBy("event_type", "window_start").agg(*ohlc("value", "event_id"), F.count("*").alias("n"))


@query(EV + f"SELECT user_id, event_type, ms - ms % {DAY} AS window_start, ms - ms % {DAY} + {DAY} AS window_end, count(*) AS n, round(sum(value), 4) AS total FROM ev GROUP BY ALL")
def tumble_multi_key(spark, d):
    return windows.tumble(events(spark, d), "ms", DAY).groupBy("user_id", "event_type", "window_start", "window_end").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


@query(EV + f"SELECT ms - ms % {HOUR} AS window_start, CAST(sum(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) AS BIGINT) AS purchases, CAST(sum(CASE WHEN event_type = 'purchase' THEN 0 ELSE 1 END) AS BIGINT) AS others, round(sum(CASE WHEN value > 50 THEN value ELSE 0 END), 4) AS large FROM ev GROUP BY 1")
def tumble_case_split(spark, d):
    bought = F.col("event_type") == "purchase"
    return windows.tumble(events(spark, d), "ms", HOUR).groupBy("window_start").agg(
        F.sum(F.when(bought, 1).otherwise(0)).alias("purchases"), F.sum(F.when(bought, 0).otherwise(1)).alias("others"), F.round(F.sum(F.when(F.col("value") > 50, F.col("value")).otherwise(0.0)), 4).alias("large")
    )


@query(EV + f"SELECT event_type, s AS window_start, count(*) AS n, round(sum(value), 4) AS total FROM (SELECT *, unnest(range(ms - ms % {2 * HOUR} - {8 * HOUR}, ms + 1, {2 * HOUR})) AS s FROM ev) WHERE s <= ms AND ms < s + {10 * HOUR} GROUP BY 1, 2")
def hop_fanout(spark, d):
    return windows.hop(events(spark, d), "ms", 2 * HOUR, 10 * HOUR).groupBy("event_type", "window_start").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


@query(EV + f"SELECT ms - ms % {2 * HOUR} - {8 * HOUR} AS window_start, count(*) AS n FROM ev GROUP BY 1")
def hop_earliest_start(spark, d):
    return events(spark, d).groupBy(windows.hop_start(F.col("ms"), 2 * HOUR, 10 * HOUR).alias("window_start")).agg(F.count("*").alias("n"))


_SESSIONS = """, a AS (SELECT *, CASE WHEN ms - lag(ms) OVER (PARTITION BY user_id ORDER BY ms) < {gap} THEN 0 ELSE 1 END AS new FROM ev),
b AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ms) AS s FROM a)
SELECT user_id, min(ms) AS session_start, max(ms) + {gap} AS session_end, count(*) AS n, round(sum(value), 4) AS total FROM b GROUP BY user_id, s"""


@query(EV + _SESSIONS.format(gap=HOUR))
def session_basic(spark, d):
    return windows.session_agg(events(spark, d), ["user_id"], "ms", HOUR, F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


@query(EV + _SESSIONS.format(gap=HOUR).replace("PARTITION BY user_id ", "PARTITION BY event_type ").replace("SELECT user_id,", "SELECT event_type,").replace("GROUP BY user_id, s", "GROUP BY event_type, s"))
def session_hot_keys(spark, d):
    """Five keys hold all rows; time buckets spread them."""
    return windows.session_agg(events(spark, d), ["event_type"], "ms", HOUR, F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"), bucket_ms=DAY)


@query("WITH v AS (SELECT unnest([0, 10000, 20000, 29999, 40000]) AS ms), g AS (SELECT ms, CASE WHEN ms - lag(ms) OVER (ORDER BY ms) < 10000 THEN 0 ELSE 1 END AS n FROM v), s AS (SELECT ms, sum(n) OVER (ORDER BY ms) AS k FROM g) SELECT CAST(min(ms) AS BIGINT) AS session_start, CAST(max(ms) + 10000 AS BIGINT) AS session_end, count(*) AS n FROM s GROUP BY k")
def session_boundary(spark, d):
    v = spark.createDataFrame([(1, x) for x in (0, 10000, 20000, 29999, 40000)], "k int, ms long")
    return windows.session_agg(v, ["k"], "ms", 10000, F.count("*").alias("n")).drop("k")


@query(EV + f"SELECT DISTINCT ms - ms % {6 * HOUR} AS window_start, ms - ms % {6 * HOUR} + {6 * HOUR} AS window_end FROM ev")
def window_bounds_ms(spark, d):
    return windows.tumble(events(spark, d), "ms", 6 * HOUR).select("window_start", "window_end").distinct()


@query(EV + f", w AS (SELECT max(ms) - {HOUR} AS wm FROM ev) SELECT ms - ms % {DAY} AS window_start, ms - ms % {DAY} + {DAY} AS window_end, count(*) AS n FROM ev, w WHERE ms - ms % {DAY} + {DAY} <= wm GROUP BY ALL")
def eowc_closed_only(spark, d):
    e = events(spark, d)
    mark = e.agg((F.max("ms") - HOUR).alias("wm")).head()[0]
    return windows.closed(windows.tumble(e, "ms", DAY), mark).groupBy("window_start", "window_end").agg(F.count("*").alias("n"))


@query(EV + f", h AS (SELECT ms - ms % {HOUR} AS window_start, count(*) AS n, max(value) AS high FROM ev GROUP BY 1) SELECT window_start - window_start % {DAY} AS day_start, CAST(sum(n) AS BIGINT) AS n, max(high) AS high, count(*) AS hours FROM h GROUP BY 1")
def cascade_hour_to_day(spark, d):
    hourly = windows.tumble(events(spark, d), "ms", HOUR).groupBy("window_start").agg(F.count("*").alias("n"), F.max("value").alias("high"))
    return hourly.groupBy(windows.tumble_start(F.col("window_start"), DAY).alias("day_start")).agg(F.sum("n").alias("n"), F.max("high").alias("high"), F.count("*").alias("hours"))


@query(EV + f", r AS (SELECT *, ms - ms % {HOUR} AS window_start, row_number() OVER (PARTITION BY ms - ms % {HOUR} ORDER BY value DESC, event_id) AS rank FROM ev) SELECT window_start, CAST(rank AS INT) AS rank, event_id, value FROM r WHERE rank <= 3")
def window_local_sort(spark, d):
    return windows.window_sorted(windows.tumble(events(spark, d), "ms", HOUR), [F.desc("value"), F.asc("event_id")], limit=3).select("window_start", "rank", "event_id", "value")


# --- aggregates --------------------------------------------------------------------------------

plain("agg_basic", "SELECT event_type, count(*) AS n, count(value) AS n_value, round(sum(value), 4) AS total, min(value) AS low, max(value) AS high, round(avg(value), 6) AS mean FROM {events} GROUP BY event_type")
plain("agg_distinct", "SELECT event_type, count(DISTINCT user_id) AS users, count(DISTINCT ms - ms % 86400000) AS days FROM {events} GROUP BY event_type")
plain("agg_filter", "SELECT user_id, count(*) FILTER (WHERE value > 50) AS n_large, round(sum(value) FILTER (WHERE event_type = 'click'), 4) AS clicks FROM {events} GROUP BY user_id")
plain("agg_stddev_var", "SELECT event_type, round(stddev_samp(value), 6) AS sd, round(stddev_pop(value), 6) AS sd_pop, round(var_samp(value), 4) AS va, round(var_pop(value), 4) AS va_pop FROM {events} GROUP BY event_type")
plain(
    "agg_median_percentile",
    "SELECT event_type, round(median(value), 6) AS med, round(percentile_cont(0.9) WITHIN GROUP (ORDER BY value), 6) AS p90, percentile_disc(0.25) WITHIN GROUP (ORDER BY value) AS q1 FROM {events} GROUP BY event_type",
    "SELECT event_type, round(median(value), 6) AS med, round(quantile_cont(value, 0.9), 6) AS p90, quantile_disc(value, 0.25) AS q1 FROM {events} GROUP BY event_type",
)
plain("agg_bool", "SELECT user_id, bool_and(value > 1) AS all_over, bool_or(value > 99) AS any_over FROM {events} GROUP BY user_id")
plain(
    "agg_listagg",
    "SELECT c_nationkey, listagg(c_mktsegment, ',') WITHIN GROUP (ORDER BY c_custkey) AS segments FROM {customer} GROUP BY c_nationkey",
    "SELECT c_nationkey, string_agg(c_mktsegment, ',' ORDER BY c_custkey) AS segments FROM {customer} GROUP BY c_nationkey",
    "customer",
)
plain(
    "agg_array",
    "SELECT n_regionkey, size(collect_list(n_name)) AS n, concat_ws('|', sort_array(collect_list(n_name))) AS names FROM {nation} GROUP BY n_regionkey",
    "SELECT n_regionkey, CAST(len(array_agg(n_name)) AS INT) AS n, array_to_string(list_sort(array_agg(n_name)), '|') AS names FROM {nation} GROUP BY n_regionkey",
    "nation",
)
plain("agg_corr_regr", "SELECT l_returnflag, round(corr(l_quantity, l_extendedprice), 6) AS c, round(covar_samp(l_quantity, l_discount), 6) AS cv, round(covar_pop(l_quantity, l_discount), 6) AS cvp, round(regr_slope(l_extendedprice, l_quantity), 3) AS slope, round(regr_intercept(l_extendedprice, l_quantity), 1) AS icpt FROM {lineitem} GROUP BY l_returnflag", tables="lineitem")
plain("agg_bit", "SELECT event_type, bit_and(event_id) AS a, bit_or(event_id) AS o, bit_xor(event_id) AS x FROM {events} GROUP BY event_type")
plain("agg_first_last", "SELECT user_id, min_by(value, struct(ms, event_id)) AS first_v, max_by(value, struct(ms, event_id)) AS last_v FROM {events} GROUP BY user_id", "SELECT user_id, arg_min(value, (ms, event_id)) AS first_v, arg_max(value, (ms, event_id)) AS last_v FROM {events} GROUP BY user_id")
plain("agg_having", "SELECT o_custkey, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM {orders} GROUP BY o_custkey HAVING count(*) >= 2 AND sum(o_totalprice) > 250000", tables="orders")
plain("agg_cube", "SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS qty FROM {lineitem} GROUP BY CUBE (l_returnflag, l_linestatus)", tables="lineitem")
plain("agg_rollup", "SELECT event_type, user_id, count(*) AS n FROM {events} GROUP BY ROLLUP (event_type, user_id)")
plain("agg_grouping_sets", "SELECT o_orderstatus, o_orderpriority, count(*) AS n, max(o_totalprice) AS high FROM {orders} GROUP BY GROUPING SETS ((o_orderstatus), (o_orderpriority), ())", tables="orders")


# An estimate can't be compared by value: what is compared is that it lies within its stated error of the exact one.
@query("SELECT event_type, count(*) AS n, true AS users_near, true AS median_near, true AS p95_near FROM events GROUP BY 1")
def agg_approx(spark, d):
    e, half = events(spark, d), F.lit(0.05)
    near = lambda estimate, exact: F.abs(estimate - exact) <= half * exact
    return e.groupBy("event_type").agg(
        F.count("*").alias("n"),
        near(F.approx_count_distinct("user_id", 0.01), F.count_distinct("user_id")).alias("users_near"),
        near(F.percentile_approx("value", 0.5, 10000), F.percentile("value", 0.5)).alias("median_near"),
        near(F.percentile_approx("value", 0.95, 10000), F.percentile("value", 0.95)).alias("p95_near"),
    )


# --- joins -------------------------------------------------------------------------------------

_PAIR = EV + ", l AS (SELECT event_id, user_id, ms, value FROM ev WHERE event_type = 'click'), r AS (SELECT event_id AS r_id, user_id AS r_user, ms AS r_ms, value AS r_value FROM ev WHERE event_type = 'purchase') "


def _sides(spark, d):
    e = events(spark, d)
    left = e.where("event_type = 'click'").select("event_id", "user_id", "ms", "value")
    right = e.where("event_type = 'purchase'").select(F.col("event_id").alias("r_id"), "user_id", F.col("ms").alias("r_ms"), F.col("value").alias("r_value"))
    return left, right


def _interval(how: str, name: str) -> None:
    def run(spark, d):
        left, right = _sides(spark, d)
        return joins.interval_join(left, right, ["user_id"], "ms", "r_ms", 2 * HOUR, how=how, buckets=how in ("inner", "left")).select("event_id", "r_id", "value", "r_value")

    _QUERIES[name] = run
    _ORACLE[name] = _PAIR + f"SELECT event_id, r_id, value, r_value FROM l {how.upper()} JOIN r ON user_id = r_user AND r_ms BETWEEN ms - {2 * HOUR} AND ms + {2 * HOUR}"


for _how in ("inner", "left", "right", "full"):
    _interval(_how, f"interval_{_how}")

_BACK = "SELECT l.event_id, {r} FROM l {how} r ON l.user_id = r.r_user AND l.ms >= r.r_ms"


def _asof(name: str, sql: str, **options) -> None:
    def run(spark, d):
        left, right = _sides(spark, d)
        return joins.asof_join(left, right, ["user_id"], "ms", "r_ms", right_order="r_id", **options).select("event_id", "r_id", "r_ms")

    _QUERIES[name] = run
    _ORACLE[name] = _PAIR + sql


_asof("asof_backward", "SELECT event_id, r_id, r_ms FROM l ASOF LEFT JOIN r ON user_id = r_user AND ms >= r_ms")
_asof("asof_forward", "SELECT event_id, r_id, r_ms FROM l ASOF LEFT JOIN r ON user_id = r_user AND ms <= r_ms", direction="forward")
_asof("asof_inner", "SELECT event_id, r_id, r_ms FROM l ASOF JOIN r ON user_id = r_user AND ms >= r_ms", how="inner")
_asof("asof_tolerance", f"SELECT event_id, CASE WHEN ms - r_ms <= {6 * HOUR} THEN r_id END AS r_id, CASE WHEN ms - r_ms <= {6 * HOUR} THEN r_ms END AS r_ms FROM l ASOF LEFT JOIN r ON user_id = r_user AND ms >= r_ms", tolerance=6 * HOUR)
_asof(
    "asof_nearest",
    ", b AS (SELECT event_id, r_id AS b_id, r_ms AS b_ms FROM l ASOF LEFT JOIN r ON user_id = r_user AND ms >= r_ms), f AS (SELECT event_id, ms, r_id AS f_id, r_ms AS f_ms FROM l ASOF LEFT JOIN r ON user_id = r_user AND ms <= r_ms) SELECT event_id, CASE WHEN b_id IS NOT NULL AND (f_id IS NULL OR ms - b_ms <= f_ms - ms) THEN b_id ELSE f_id END AS r_id, CASE WHEN b_id IS NOT NULL AND (f_id IS NULL OR ms - b_ms <= f_ms - ms) THEN b_ms ELSE f_ms END AS r_ms FROM b JOIN f USING (event_id)".lstrip(),
    direction="nearest",
)


for _d in ("backward", "forward", "nearest"):  # time buckets spread hot keys
    _asof(f"asof_{_d}_hot_keys", _ORACLE[f"asof_{_d}"].removeprefix(_PAIR), direction=_d, bucket_ms=DAY)


@query(_PAIR + "SELECT event_id, value, r_value AS rate FROM l ASOF JOIN r ON user_id = r_user AND ms >= r_ms")
def temporal_event_time(spark, d):
    left, right = _sides(spark, d)
    return joins.temporal_join(left, right, ["user_id"], "ms", "r_ms", version_order="r_id").select("event_id", "value", F.col("r_value").alias("rate"))


@query(_PAIR + "SELECT event_id, value, v.rate FROM l JOIN (SELECT r_user, arg_max(r_value, (r_ms, r_id)) AS rate FROM r GROUP BY r_user) v ON user_id = r_user")
def temporal_latest(spark, d):
    left, right = _sides(spark, d)
    return joins.process_time_join(left, right, ["user_id"], "r_ms", "r_id").select("event_id", "value", F.col("r_value").alias("rate"))


@query(_PAIR + "SELECT r_user AS user_id, r_id FROM (SELECT *, row_number() OVER (PARTITION BY r_user ORDER BY r_ms DESC, r_id DESC) AS n FROM r) WHERE n <= 3")
def temporal_recent_versions(spark, d):
    return joins.recent_versions(_sides(spark, d)[1], ["user_id"], 3, "r_ms", "r_id").select("user_id", "r_id")


@query("SELECT o_orderkey, c_name, c_mktsegment FROM orders JOIN customer ON o_custkey = c_custkey")
def lookup_inner(spark, d):
    return joins.lookup_join(read(spark, d, "orders"), read(spark, d, "customer"), {"o_custkey": "c_custkey"}, "inner").select("o_orderkey", "c_name", "c_mktsegment")


@query("SELECT o_orderkey, c_name FROM orders LEFT JOIN (SELECT * FROM customer WHERE c_acctbal > 0) ON o_custkey = c_custkey")
def lookup_left(spark, d):
    return joins.lookup_join(read(spark, d, "orders"), read(spark, d, "customer").where("c_acctbal > 0"), {"o_custkey": "c_custkey"}).select("o_orderkey", "c_name")


plain("multi_join_3way", "SELECT n_name, o_orderstatus, count(*) AS n, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey JOIN {customer} ON o_custkey = c_custkey JOIN {nation} ON c_nationkey = n_nationkey GROUP BY n_name, o_orderstatus", tables="lineitem orders customer nation")
plain("join_using", "SELECT user_id, a.n AS clicks, b.n AS others FROM (SELECT user_id, count(*) AS n FROM {events} WHERE event_type = 'click' GROUP BY user_id) a JOIN (SELECT user_id, count(*) AS n FROM {events} WHERE event_type <> 'click' GROUP BY user_id) b USING (user_id)")
plain("semi", "SELECT c_custkey, c_name FROM {customer} WHERE EXISTS (SELECT 1 FROM {orders} WHERE o_custkey = c_custkey AND o_totalprice > 200000)", tables="customer orders")
plain("anti", "SELECT c_custkey, c_name FROM {customer} WHERE NOT EXISTS (SELECT 1 FROM {orders} WHERE o_custkey = c_custkey AND o_totalprice > 300000)", tables="customer orders")


# --- analytic functions ------------------------------------------------------------------------

plain("row_number", "SELECT event_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ms, event_id) AS BIGINT) AS rn FROM {events}")
plain("rank_dense", "SELECT o_orderkey, CAST(rank() OVER (PARTITION BY o_orderstatus ORDER BY o_orderpriority) AS BIGINT) AS r, CAST(dense_rank() OVER (PARTITION BY o_orderstatus ORDER BY o_orderpriority) AS BIGINT) AS dr FROM {orders}", tables="orders")
plain("ntile_percent", "SELECT c_custkey, CAST(ntile(4) OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS BIGINT) AS q, round(percent_rank() OVER (PARTITION BY c_nationkey ORDER BY c_custkey), 6) AS pr, round(cume_dist() OVER (PARTITION BY c_nationkey ORDER BY c_custkey), 6) AS cd FROM {customer}", tables="customer")
plain("lag_lead", "SELECT event_id, lag(value) OVER (PARTITION BY user_id ORDER BY ms, event_id) AS p, lead(value, 2, -1.0) OVER (PARTITION BY user_id ORDER BY ms, event_id) AS nx FROM {events}", "SELECT event_id, lag(value) OVER (PARTITION BY user_id ORDER BY ms, event_id) AS p, lead(value, 2, CAST(-1.0 AS DOUBLE)) OVER (PARTITION BY user_id ORDER BY ms, event_id) AS nx FROM {events}")
plain("first_last_nth", "SELECT event_id, first_value(value) OVER w AS f, last_value(value) OVER w AS l, nth_value(value, 2) OVER w AS n2 FROM {events} WINDOW w AS (PARTITION BY user_id ORDER BY ms, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)")
plain("frame_moving_avg", "SELECT event_id, round(avg(value) OVER (PARTITION BY event_type ORDER BY ms, event_id ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 6) AS ma FROM {events}")
plain("frame_moving_avg_users", "SELECT event_id, round(avg(value) OVER (PARTITION BY user_id ORDER BY ms, event_id ROWS BETWEEN 2 PRECEDING AND 1 FOLLOWING), 6) AS ma FROM {events}")
plain("frame_running_sum", "SELECT event_id, round(sum(value) OVER (PARTITION BY user_id ORDER BY ms, event_id ROWS UNBOUNDED PRECEDING), 4) AS rs, count(*) OVER (PARTITION BY user_id ORDER BY ms, event_id ROWS UNBOUNDED PRECEDING) AS n FROM {events}")
plain("frame_rolling_max", "SELECT event_id, max(value) OVER (PARTITION BY event_type ORDER BY ms, event_id ROWS BETWEEN 5 PRECEDING AND 1 FOLLOWING) AS hi, min(value) OVER (PARTITION BY event_type ORDER BY ms, event_id ROWS BETWEEN 5 PRECEDING AND 1 FOLLOWING) AS lo FROM {events}")
plain("frame_range", "SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY ms RANGE BETWEEN 3600000 PRECEDING AND CURRENT ROW) AS n_hour FROM {events}")


# --- sorts, limits, sets, scalars --------------------------------------------------------------

@query("SELECT event_id, value FROM events ORDER BY value DESC NULLS LAST, event_id LIMIT 10")
def topk_global(spark, d):
    return topk.top_k(read(spark, d, "events").select("event_id", "value"), 10, topk.order("value", True), topk.order("event_id"))


@query("SELECT event_type, CAST(rank AS INT) AS rank, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY value DESC, event_id) AS rank FROM events) WHERE rank <= 3")
def topk_per_group(spark, d):
    return topk.top_k_per_group(read(spark, d, "events"), ["event_type"], 3, topk.order("value", True), topk.order("event_id")).select("event_type", "rank", "event_id", "value")


@query("SELECT k, v, CAST(row_number() OVER (ORDER BY v ASC NULLS LAST, k) AS INT) AS up, CAST(row_number() OVER (ORDER BY v DESC NULLS LAST, k) AS INT) AS down FROM (VALUES (1, 5), (2, NULL), (3, 1), (4, NULL), (5, 9)) t(k, v)")
def order_nulls(spark, d):
    t = spark.createDataFrame([(1, 5), (2, None), (3, 1), (4, None), (5, 9)], "k int, v int")
    return t.select("k", "v", F.row_number().over(Window.orderBy(topk.order("v"), "k")).alias("up"), F.row_number().over(Window.orderBy(topk.order("v", True), "k")).alias("down"))


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20 OFFSET 5")
def limit_offset(spark, d):
    return topk.top_k(read(spark, d, "orders").select("o_orderkey", "o_totalprice"), 20, topk.order("o_totalprice", True), topk.order("o_orderkey"), offset=5)


plain("filter_predicates", "SELECT event_id, value FROM {events} WHERE value BETWEEN 10 AND 90 AND event_type IN ('click', 'view') AND NOT (user_id = 3) AND value IS NOT NULL AND event_type LIKE '%i%'")
plain("distinct_rows", "SELECT DISTINCT user_id, event_type FROM {events}")
plain("union_all", "SELECT c_nationkey AS k FROM {customer} UNION ALL SELECT s_nationkey AS k FROM {supplier}", tables="customer supplier")
plain("union_distinct", "SELECT c_nationkey AS k FROM {customer} UNION SELECT s_nationkey AS k FROM {supplier}", tables="customer supplier")
plain("intersect_rows", "SELECT c_nationkey AS k FROM {customer} INTERSECT SELECT s_nationkey AS k FROM {supplier}", tables="customer supplier")
plain("except_rows", "SELECT n_nationkey AS k FROM {nation} EXCEPT SELECT s_nationkey AS k FROM {supplier} WHERE s_acctbal > 9000", tables="nation supplier")
plain("cte_subquery", "SELECT c_custkey, t.total FROM {customer} JOIN (SELECT o_custkey, round(sum(o_totalprice), 2) AS total FROM {orders} GROUP BY o_custkey) t ON c_custkey = t.o_custkey WHERE t.total > (SELECT 2 * avg(o_totalprice) FROM {orders})", tables="customer orders")
plain("correlated_subquery", "SELECT o_orderkey FROM {orders} o WHERE o_totalprice = (SELECT max(o_totalprice) FROM {orders} i WHERE i.o_custkey = o.o_custkey)", tables="orders")
plain(
    "scalar_string",
    "SELECT p_partkey, upper(p_name) AS u, lower(p_brand) AS l, trim(concat('  ', p_type, ' ')) AS t, substr(p_name, 2, 4) AS s, length(p_name) AS n, replace(p_type, ' ', '_') AS r, split_part(p_type, ' ', 1) AS sp, lpad(p_brand, 12, '*') AS lp, left(p_name, 3) AS le, right(p_name, 3) AS ri, startswith(p_name, 'a') AS sw, instr(p_name, 'e') AS i, concat_ws('-', p_brand, p_type) AS c FROM {part}",
    "SELECT p_partkey, upper(p_name) AS u, lower(p_brand) AS l, trim(concat('  ', p_type, ' ')) AS t, substr(p_name, 2, 4) AS s, CAST(length(p_name) AS INT) AS n, replace(p_type, ' ', '_') AS r, split_part(p_type, ' ', 1) AS sp, lpad(p_brand, 12, '*') AS lp, left(p_name, 3) AS le, right(p_name, 3) AS ri, starts_with(p_name, 'a') AS sw, CAST(instr(p_name, 'e') AS INT) AS i, concat_ws('-', p_brand, p_type) AS c FROM {part}",
    "part",
)
plain(
    "scalar_math",
    "SELECT event_id, abs(value - 50) AS a, CAST(ceil(value) AS BIGINT) AS c, CAST(floor(value) AS BIGINT) AS f, round(sqrt(value), 6) AS q, round(power(value, 2), 4) AS p, round(ln(value + 1), 6) AS l, event_id % 7 AS m, greatest(value, 50.0D) AS g, least(value, 50.0D) AS le, event_id div 7 AS d FROM {events}",
    "SELECT event_id, abs(value - 50) AS a, CAST(ceil(value) AS BIGINT) AS c, CAST(floor(value) AS BIGINT) AS f, round(sqrt(value), 6) AS q, round(power(value, 2), 4) AS p, round(ln(value + 1), 6) AS l, event_id % 7 AS m, greatest(value, 50.0::DOUBLE) AS g, least(value, 50.0::DOUBLE) AS le, event_id // 7 AS d FROM {events}",
)
plain(
    "scalar_date",
    "SELECT o_orderkey, unix_millis(CAST(date_trunc('month', o_orderdate) AS TIMESTAMP)) div 1000 AS month_s, CAST(extract(YEAR FROM o_orderdate) AS INT) AS y, CAST(extract(MONTH FROM o_orderdate) AS INT) AS m, CAST(extract(DAY FROM o_orderdate) AS INT) AS dd, CAST(o_orderdate + INTERVAL 3 DAYS AS DATE) AS later FROM {orders}",
    "SELECT o_orderkey, CAST(epoch(date_trunc('month', o_orderdate)) AS BIGINT) AS month_s, CAST(extract(YEAR FROM o_orderdate) AS INT) AS y, CAST(extract(MONTH FROM o_orderdate) AS INT) AS m, CAST(extract(DAY FROM o_orderdate) AS INT) AS dd, CAST(o_orderdate + INTERVAL 3 DAYS AS DATE) AS later FROM {orders}",
    "orders",
)
plain("scalar_conditional", "SELECT event_id, CASE WHEN value < 25 THEN 'low' WHEN value < 75 THEN 'mid' ELSE 'high' END AS band, coalesce(nullif(event_type, 'click'), 'none') AS kind, (user_id IS DISTINCT FROM 3) AS other FROM {events}")
plain("json_props", "SELECT event_id, CAST(get_json_object(props, '$.k') AS INT) AS k FROM {events}", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM {events}")
plain("compiled_subset", "SELECT event_id, CAST(value AS BIGINT) AS v, (value + 1) * 2 - value / 4 AS e, (value > 10 AND user_id <> 2) OR event_type = 'view' AS b, value IS NULL AS nn FROM {events} WHERE ms >= 1704067200000", "SELECT event_id, CAST(trunc(value) AS BIGINT) AS v, (value + 1) * 2 - value / 4 AS e, (value > 10 AND user_id <> 2) OR event_type = 'view' AS b, value IS NULL AS nn FROM {events} WHERE ms >= 1704067200000")


# --- changelogs --------------------------------------------------------------------------------

_LOG = EV + ", z AS (SELECT user_id, event_type, CAST(floor(value) AS BIGINT) AS v, CASE WHEN event_id % 3 = 0 THEN -1 ELSE 1 END AS w FROM ev) "


def _log(spark, d):
    return events(spark, d).select("user_id", "event_type", F.floor("value").alias("v"), F.when(F.col("event_id") % 3 == 0, -1).otherwise(1).alias("_weight"))


@query(_LOG + "SELECT user_id, event_type, v, CAST(sum(w) AS BIGINT) AS _weight FROM z GROUP BY 1, 2, 3 HAVING sum(w) <> 0")
def zset_consolidate(spark, d):
    return changelog.consolidate(_log(spark, d))


@query(_LOG + "SELECT event_type, CAST(sum(w) AS BIGINT) AS n, CAST(sum(w * v) AS BIGINT) AS total, round(CASE WHEN sum(w) <> 0 THEN sum(w * v) / sum(w) END, 6) AS mean FROM z GROUP BY 1")
def retract_sum_count_avg(spark, d):
    r = retractable("v")
    return _log(spark, d).groupBy("event_type").agg(r["count"].alias("n"), r["sum"].alias("total"), F.round(r["avg"], 6).alias("mean"))


@query(_LOG + "SELECT event_type, min(v) AS min, max(v) AS max FROM (SELECT event_type, v FROM z GROUP BY 1, 2 HAVING sum(w) > 0) GROUP BY 1")
def retract_min_max(spark, d):
    return changelog.retract_min_max(_log(spark, d), ["event_type"], "v")


_HALF = 1_705_276_800_000


@query(EV + f", a AS (SELECT user_id, count(*) AS n FROM ev WHERE ms < {_HALF} GROUP BY 1), b AS (SELECT user_id, count(*) AS n FROM ev GROUP BY 1) SELECT user_id, CASE WHEN b.n IS NULL THEN 'delete' ELSE 'update_before' END AS _op, -1 AS _weight, a.n FROM a LEFT JOIN b USING (user_id) WHERE a.n IS DISTINCT FROM b.n UNION ALL SELECT user_id, CASE WHEN a.n IS NULL THEN 'insert' ELSE 'update_after' END, 1, b.n FROM b LEFT JOIN a USING (user_id) WHERE a.n IS DISTINCT FROM b.n")
def changelog_diff(spark, d):
    e = events(spark, d)
    return changelog.diff(e.where(F.col("ms") < _HALF).groupBy("user_id").agg(F.count("*").alias("n")), e.groupBy("user_id").agg(F.count("*").alias("n")), ["user_id"])


_TOP = "SELECT CAST(row_number() OVER (ORDER BY value DESC, event_id) AS INT) AS rank, event_id, value FROM ev {w} ORDER BY value DESC, event_id LIMIT 5"


@query(EV + f", a AS ({_TOP.format(w=f'WHERE ms < {_HALF}')}), b AS ({_TOP.format(w='')}) SELECT rank, CASE WHEN b.event_id IS NULL THEN 'delete' ELSE 'update_before' END AS _op, -1 AS _weight, a.event_id, a.value FROM a LEFT JOIN b USING (rank) WHERE a.event_id IS DISTINCT FROM b.event_id UNION ALL SELECT rank, CASE WHEN a.event_id IS NULL THEN 'insert' ELSE 'update_after' END, 1, b.event_id, b.value FROM b LEFT JOIN a USING (rank) WHERE a.event_id IS DISTINCT FROM b.event_id")
def topk_changelog(spark, d):
    e = events(spark, d).select("event_id", "value", "ms")
    cols = ["event_id", "value"]
    return changelog.topk_changelog(e.where(F.col("ms") < _HALF).select(*cols), e.select(*cols), [F.desc("value"), F.asc("event_id")], 5, ["event_id"])


@query("SELECT event_id, value, CASE WHEN event_id % 5 = 0 THEN 'd' WHEN event_id % 5 = 1 THEN 'u' ELSE 'c' END AS __op, CAST(epoch_us(ts) // 1000 AS BIGINT) AS __ts_ms FROM events")
def debezium_decode(spark, d):
    e = events(spark, d)
    op = F.when(F.col("event_id") % 5 == 0, "d").when(F.col("event_id") % 5 == 1, "u").otherwise("c")
    row = F.struct("event_id", "value")
    envelope = e.select(F.to_json(F.struct(F.when(op.isin("d", "u"), row).alias("before"), F.when(op != "d", row).alias("after"), op.alias("op"), F.col("ms").alias("ts_ms"))).alias("j"))
    return changelog.debezium(envelope, "j", T.StructType([T.StructField("event_id", T.LongType()), T.StructField("value", T.DoubleType())]))


@query("SELECT user_id, arg_max(event_id, event_id) AS event_id, arg_max(value, event_id) AS value FROM events GROUP BY 1")
def upsert_latest(spark, d):
    return changelog.upsert_latest(read(spark, d, "events").select("user_id", "event_id", "value"), ["user_id"], ["event_id"])


# --- streams, run over what there is and read back -----------------------------------------------


def folder(spark: SparkSession) -> str:
    """A new folder in the one that all executors share; a local one only where driver and executors are one process."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a shared folder")
        base = tempfile.mkdtemp(prefix="tidewell-")
    return f"{base}/engine-{uuid.uuid4().hex}"


def _stream(spark, d) -> DataFrame:
    """events as a stream, with its event time and no watermark yet."""
    schema = read(spark, d, "events").schema
    # A pattern, for a stream's plain path has to be a folder and the table may be one file.
    return spark.readStream.schema(schema).parquet(f"{d}/events.parque[t]").withColumn("ms", millis("ts")).withColumn("at", F.timestamp_millis("ms"))


def _run(df: DataFrame, mode: str = "append") -> DataFrame:
    """The rows that a streaming query puts out until its source is read. Executors write them to the shared folder; the driver holds none."""
    spark, base = df.sparkSession, folder(df.sparkSession)
    q = df.writeStream.foreachBatch(lambda batch, i: write_files(batch, {"path": f"{base}/out"}, i)).option("checkpointLocation", f"{base}/state").outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()
    state = spark._jvm.org.apache.hadoop.fs.Path(f"{base}/state")
    fs = state.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.delete(state, True)  # no later query goes on from it
    if not fs.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{base}/out")):  # no batch has come
        return spark.createDataFrame([], df.schema)
    return spark.read.schema(df.schema).parquet(f"{base}/out").select(*df.columns)


@query(EV + f", m AS (SELECT max(ms) - {HOUR} AS wm FROM ev) SELECT event_type, ms - ms % {HOUR} AS window_start, count(*) AS n, max(value) AS high FROM ev, m WHERE ms - ms % {HOUR} + {HOUR} <= wm GROUP BY 1, 2")
def stream_tumble_append(spark, d):
    s = _stream(spark, d).withWatermark("at", "1 hour").groupBy("event_type", F.window("at", "1 hour")).agg(F.count("*").alias("n"), F.max("value").alias("high"))
    return _run(s.select("event_type", F.unix_millis("window.start").alias("window_start"), "n", "high"))


@query(EV + f", m AS (SELECT max(ms) - {HOUR} AS wm FROM ev) SELECT s AS window_start, count(*) AS n FROM (SELECT *, unnest(range(ms - ms % {2 * HOUR} - {8 * HOUR}, ms + 1, {2 * HOUR})) AS s FROM ev), m WHERE s <= ms AND ms < s + {10 * HOUR} AND s + {10 * HOUR} <= wm GROUP BY 1")
def stream_hop_append(spark, d):
    s = _stream(spark, d).withWatermark("at", "1 hour").groupBy(F.window("at", "10 hours", "2 hours")).agg(F.count("*").alias("n"))
    return _run(s.select(F.unix_millis("window.start").alias("window_start"), "n"))


@query(EV + _SESSIONS.format(gap=HOUR).replace("SELECT user_id, min(ms)", f", m AS (SELECT max(ms) - {HOUR} AS wm FROM ev) SELECT user_id, min(ms)").replace("FROM b GROUP BY user_id, s", f"FROM b, m GROUP BY user_id, s, wm HAVING max(ms) + {HOUR} <= wm"))
def stream_session(spark, d):
    # A gap less a microsecond, for an event exactly a gap later begins a new session.
    own = F.session_window("at", f"{HOUR * 1000 - 1} microseconds")
    s = _stream(spark, d).withWatermark("at", "1 hour").groupBy("user_id", own.alias("w")).agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return _run(s.select("user_id", F.unix_millis("w.start").alias("session_start"), F.expr("(unix_micros(w.end) + 1) div 1000").alias("session_end"), "n", "total"))


@query(_PAIR + f"SELECT event_id, r_id FROM l JOIN r ON user_id = r_user AND r_ms BETWEEN ms - {2 * HOUR} AND ms + {2 * HOUR}")
def stream_interval_join(spark, d):
    e = _stream(spark, d)
    left = e.where("event_type = 'click'").select("event_id", "user_id", "at").withWatermark("at", "1 hour")
    right = e.where("event_type = 'purchase'").select(F.col("event_id").alias("r_id"), F.col("user_id").alias("r_user"), F.col("at").alias("r_at")).withWatermark("r_at", "1 hour")
    return _run(left.join(right, F.expr("user_id = r_user AND r_at BETWEEN at - INTERVAL 2 HOURS AND at + INTERVAL 2 HOURS")).select("event_id", "r_id"))


@query(EV + f", m AS (SELECT max(ms) - {HOUR} AS wm FROM ev), h AS (SELECT ms - ms % {HOUR} AS s, count(*) AS n FROM ev, m WHERE ms - ms % {HOUR} + {HOUR} <= wm GROUP BY 1), x AS (SELECT s - s % {DAY} AS day_start, CAST(sum(n) AS BIGINT) AS n FROM h GROUP BY 1) SELECT day_start, x.n FROM x, m WHERE day_start + {DAY} <= wm")
def stream_cascade(spark, d):
    hourly = _stream(spark, d).withWatermark("at", "1 hour").groupBy(F.window("at", "1 hour")).agg(F.count("*").alias("n"))
    daily = hourly.groupBy(F.window(F.window_time("window"), "1 day").alias("w")).agg(F.sum("n").alias("n"))
    return _run(daily.select(F.unix_millis("w.start").alias("day_start"), "n"))


@query(EV + "SELECT user_id, count(*) AS n, max(value) AS high FROM ev GROUP BY 1")
def stream_emit_update(spark, d):
    out = _run(_stream(spark, d).groupBy("user_id").agg(F.count("*").alias("n"), F.max("value").alias("high")), "update")
    return out.groupBy("user_id").agg(F.max("n").alias("n"), F.max_by("high", "n").alias("high"))


@query("SELECT DISTINCT user_id, event_type FROM events")
def stream_distinct(spark, d):
    return _run(_stream(spark, d).select("user_id", "event_type", "at").withWatermark("at", "40 days").dropDuplicatesWithinWatermark(["user_id", "event_type"]).select("user_id", "event_type"))


@query(EV + "SELECT e.event_id, e.value, c_name FROM ev e JOIN customer ON user_id = c_custkey")
def stream_lookup_join(spark, d):
    return _run(joins.lookup_join(_stream(spark, d), read(spark, d, "customer"), {"user_id": "c_custkey"}, "inner").select("event_id", "value", "c_name"))


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_ORACLE)
