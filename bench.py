"""Runs the headline queries over $BENCH_SF_DIR on local[$BENCH_CPUS] and prints one JSON line.

Batch queries are run once to warm up and then measured; their rows are written nowhere (no-op), so
nothing reaches the driver. The six streams (HOP, two TUMBLE, SESSION, an interval join and an ASOF
join) run at once, as continuous queries of one engine that write their results to files.
six_streams_sec is their time from the first start to the last end, planning and start included,
rows_per_s the event rows that all six have read and finished by that time; working_rows_per_s
counts the slowest query's micro-batches alone, without starts and ends. Each stream's own time
counts as its query's. six_batch_rows_per_s is the rate of the first six batch queries one after
another."""

from __future__ import annotations

import json
import os
import shutil
import tempfile
import time

HEADLINE = (
    "tumble_ohlc", "hop_fanout", "session_basic", "tumble_case_split", "interval_inner", "asof_backward",
    "asof_nearest", "interval_full", "temporal_event_time", "agg_stddev_var", "agg_median_percentile", "agg_cube", "multi_join_3way",
    "topk_per_group", "frame_moving_avg", "lag_lead", "zset_consolidate", "changelog_diff", "debezium_decode", "stream_tumble_append", "stream_session", "stream_interval_join",
)
STREAMS = """
CREATE SOURCE events (event_id BIGINT, ts TIMESTAMP, user_id BIGINT, event_type VARCHAR, value DOUBLE, WATERMARK FOR ts AS ts - INTERVAL '1' HOUR) FROM files (path = '${DATA}/events.parque[t]', format = 'parquet');
CREATE SOURCE quotes (q_id BIGINT, user_id BIGINT, q_ts TIMESTAMP, bid DOUBLE, WATERMARK FOR q_ts AS q_ts - INTERVAL '1' HOUR) FROM files (path = '${PATH}/quotes', format = 'parquet');
CREATE STREAM hops AS SELECT event_type, window_start, count(*) AS n, avg(value) AS mean FROM events GROUP BY event_type, hop(ts, INTERVAL '2' HOUR, INTERVAL '10' HOUR) EMIT ON WINDOW CLOSE;
CREATE STREAM bars AS SELECT event_type, window_start, count(*) AS n, max(value) AS high, min(value) AS low FROM events GROUP BY event_type, tumble(ts, INTERVAL '5' HOUR) EMIT ON WINDOW CLOSE;
CREATE STREAM split AS SELECT user_id, window_start, sum(CASE WHEN event_type = 'purchase' THEN value ELSE 0 END) AS bought, sum(CASE WHEN event_type = 'purchase' THEN 0 ELSE value END) AS rest FROM events GROUP BY user_id, tumble(ts, INTERVAL '5' HOUR) EMIT ON WINDOW CLOSE;
CREATE STREAM visits AS SELECT user_id, window_start, window_end, count(*) AS n FROM events GROUP BY user_id, session(ts, INTERVAL '2' HOUR) EMIT ON WINDOW CLOSE;
CREATE STREAM clicks AS SELECT event_id, user_id, ts FROM events WHERE event_type = 'click';
CREATE STREAM buys AS SELECT event_id AS b_id, user_id AS b_user, ts AS b_ts FROM events WHERE event_type = 'purchase';
CREATE STREAM pairs AS SELECT c.event_id, b.b_id FROM clicks c JOIN buys b ON c.user_id = b.b_user AND b.b_ts BETWEEN c.ts - INTERVAL '2' HOUR AND c.ts + INTERVAL '2' HOUR;
CREATE STREAM priced AS SELECT t.event_id, q.bid FROM events t ASOF JOIN quotes q MATCH_CONDITION(t.ts >= q.q_ts) ON t.user_id = q.user_id
"""
SIX = ("hops", "bars", "split", "visits", "pairs", "priced")


def streams(spark, sf: str) -> tuple[float, dict[str, float], float, int]:
    """Seconds of the six streams together and of each, the longest that one's micro-batches took, and the rows put out."""
    from tidewell.engine import Engine

    path = tempfile.mkdtemp(prefix="tidewell-bench-")
    try:
        spark.read.parquet(f"{sf}/events.parquet").where("event_type = 'purchase'").selectExpr("event_id AS q_id", "user_id", "ts AS q_ts", "value AS bid").write.parquet(f"{path}/quotes")
        e = Engine(spark, path, {"DATA": sf, "PATH": path})
        e.execute(STREAMS)
        e.pause("clicks")
        e.pause("buys")
        began = time.perf_counter()
        e._launch({"availableNow": True})
        took, busy, left = {}, 0.0, dict(e.running)
        while left:
            for name, q in list(left.items()):
                if not q.isActive:
                    if q.exception():
                        raise q.exception()
                    took[f"engine_{name}"] = round(time.perf_counter() - began, 3)
                    busy = max(busy, sum(p["durationMs"]["triggerExecution"] for p in q.recentProgress) / 1000)
                    del left[name]
            time.sleep(0.01)
        return time.perf_counter() - began, took, busy, sum(e.results(n).count() for n in SIX)
    finally:
        shutil.rmtree(path, ignore_errors=True)


def main() -> None:
    from pyspark.sql import SparkSession

    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "4")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "8g").config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    from tidewell import suite

    queries, times = suite.queries(), {}
    n = spark.read.parquet(f"{sf}/events.parquet").count()
    for name in HEADLINE:
        for measured in (False, True):
            began = time.perf_counter()
            queries[name](spark, sf).write.format("noop").mode("overwrite").save()
            if measured:
                times[name] = round(time.perf_counter() - began, 3)
    batch = sum(times.values())
    streams(spark, sf)
    six, each, busy, rows = streams(spark, sf)
    first = sum(times[q] for q in HEADLINE[:6])
    print(json.dumps({"metric": "total_query_seconds", "value": round(batch, 3), "unit": "sec", "queries": times | each, "sf": sf, "cpus": int(cpus), "six_streams_sec": round(six, 3), "six_streams_rows_out": rows, "rows_per_s": round(n / six), "working_rows_per_s": round(n / busy), "six_batch_rows_per_s": round(n / first)}))


if __name__ == "__main__":
    main()
