import json
import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewell.functions.time import interval_ms, millis
from tidewell.operators import aggregates, changelog, joins, topk, windows


def rows(df, *cols):
    return sorted((tuple(r) for r in (df.select(*cols) if cols else df).collect()), key=str)


def test_tumble_before_epoch(spark):
    df = spark.createDataFrame([(-1,), (0,), (4999,), (5000,), (-5000,)], "ms long")
    assert rows(windows.tumble(df, "ms", 5000), "ms", "window_start") == sorted([(-1, -5000), (0, 0), (4999, 0), (5000, 5000), (-5000, -5000)], key=str)


@pytest.mark.parametrize("slide,size", [(2, 10), (3, 10), (10, 10), (4, 2)])
def test_hop_holds_each_event(spark, slide, size):
    df = spark.createDataFrame([(x,) for x in range(-15, 30)], "ms long")
    want = [(x, s) for x in range(-15, 30) for s in range(-60, 60) if s % slide == 0 and s <= x < s + size]
    assert rows(windows.hop(df, "ms", slide, size), "ms", "window_start") == sorted(want, key=str)


def test_session_boundary_and_bridge(spark):
    df = spark.createDataFrame([("a", 0), ("a", 10), ("b", 0), ("b", 9), ("c", 0), ("c", 16), ("c", 8), ("d", None)], "k string, ms long")
    got = rows(windows.session_agg(df, ["k"], "ms", 10, F.count("*").alias("n")), "k", "session_start", "session_end", "n")
    assert got == [("a", 0, 10, 1), ("a", 10, 20, 1), ("b", 0, 19, 2), ("c", 0, 26, 3)]
    marked = rows(windows.sessions(df, ["k"], "ms", 10), "k", "ms", "session_start")
    assert ("c", 16, 0) in marked and ("a", 10, 10) in marked


def asof_brute(left, right, direction, tol, how):
    out = []
    for i, (k, t) in enumerate(left):
        c = [(rt, j) for j, (rk, rt) in enumerate(right) if rk == k and k is not None and rt is not None and t is not None]
        back = max((x for x in c if x[0] <= t), default=None)
        ahead = min((x for x in c if x[0] >= t), default=None)
        m = back if direction == "backward" else ahead
        if direction == "nearest":
            b_ok = back and (tol is None or t - back[0] <= tol)
            f_ok = ahead and (tol is None or ahead[0] - t <= tol)
            m = back if b_ok and (not f_ok or t - back[0] <= ahead[0] - t) else ahead if f_ok else None
        elif m and tol is not None and abs(t - m[0]) > tol:
            m = None
        if m or how == "left":
            out.append((i, m[1] if m else None))
    return sorted(out, key=str)


@pytest.mark.parametrize("direction", ["backward", "forward", "nearest"])
@pytest.mark.parametrize("tol", [None, 3])
@pytest.mark.parametrize("how", ["left", "inner"])
def test_asof(spark, direction, tol, how):
    rng = random.Random(1)
    left = [(rng.choice("abc"), rng.randrange(40)) for _ in range(80)] + [(None, 3), ("z", 1), ("a", None)]
    right = [(rng.choice("abc"), rng.randrange(40)) for _ in range(60)] + [(None, 3), ("a", None)]
    lf = spark.createDataFrame([(k, t, i) for i, (k, t) in enumerate(left)], "k string, t long, lid int")
    rf = spark.createDataFrame([(k, t, i) for i, (k, t) in enumerate(right)], "k string, rt long, rid int")
    got = rows(joins.asof_join(lf, rf, ["k"], "t", "rt", direction, tol, how, right_order="rid"), "lid", "rid")
    assert got == asof_brute(left, right, direction, tol, how)


@pytest.mark.parametrize("how", ["inner", "left", "right", "full"])
@pytest.mark.parametrize("buckets", [False, True])
def test_interval_join(spark, how, buckets):
    left = [("a", 10), ("a", 20), ("b", 5), (None, 1)]
    right = [("a", 15), ("a", 25), ("a", 26), ("c", 1), (None, 1)]
    lf = spark.createDataFrame([(k, t, i) for i, (k, t) in enumerate(left)], "k string, t long, lid int")
    rf = spark.createDataFrame([(k, t, i) for i, (k, t) in enumerate(right)], "k string, t long, rid int")
    pairs = [(i, j) for i, (k, t) in enumerate(left) for j, (rk, rt) in enumerate(right) if k == rk and k and abs(t - rt) <= 5]
    if how in ("left", "full"):
        pairs += [(i, None) for i in range(len(left)) if i not in {p[0] for p in pairs}]
    if how in ("right", "full"):
        pairs += [(None, j) for j in range(len(right)) if j not in {p[1] for p in pairs}]
    out = joins.interval_join(lf, rf, ["k"], "t", "right_t" if False else "t", 5, how=how, buckets=buckets)
    assert rows(out, "lid", "rid") == sorted(pairs, key=str) and "right_t" in out.columns


def test_temporal(spark):
    rates = spark.createDataFrame([("x", 0, 1.0), ("x", 10, 2.0), ("y", 5, 3.0)], "cur string, vf long, rate double")
    o = spark.createDataFrame([("x", 9), ("x", 10), ("y", 1)], "cur string, t long")
    assert rows(joins.temporal_join(o, rates, ["cur"], "t", "vf"), "cur", "t", "rate") == [("x", 10, 2.0), ("x", 9, 1.0)]
    assert rows(joins.process_time_join(o, rates, ["cur"], "vf"), "t", "rate") == [(1, 3.0), (10, 2.0), (9, 2.0)]
    assert joins.recent_versions(rates, ["cur"], 1, "vf").count() == 2


def test_first_last_ties(spark):
    df = spark.createDataFrame([(1, 0, 10), (1, 1, 20), (2, 2, 30), (2, 3, 40)], "t long, seq long, v long")
    got = df.agg(aggregates.first_value("v", "t", "seq"), aggregates.last_value("v", "t", "seq")).head()
    assert tuple(got) == (10, 40)


def test_changelog(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "k int, v string")
    new = spark.createDataFrame([(1, "a"), (2, "x"), (4, "d")], "k int, v string")
    got = rows(changelog.diff(old, new, ["k"]), "k", "_op", "_weight", "v")
    assert got == [(2, "update_after", 1, "x"), (2, "update_before", -1, "b"), (3, "delete", -1, "c"), (4, "insert", 1, "d")]
    log = spark.createDataFrame([("a", 1, 1), ("a", 9, 1), ("a", 9, -1), ("a", 2, 1)], "k string, v int, _weight int")
    assert rows(changelog.retract_min_max(log, ["k"], "v")) == [("a", 1, 2)]
    assert rows(changelog.consolidate(log)) == [("a", 1, 1), ("a", 2, 1)]


def test_envelopes(spark):
    payload = T.StructType([T.StructField("id", T.IntegerType()), T.StructField("v", T.StringType())])
    e = [{"op": "c", "after": {"id": 1, "v": "a"}, "ts_ms": 5}, {"op": "d", "before": {"id": 2, "v": "b"}, "ts_ms": 6}, {"op": "r", "after": {"id": 3, "v": None}, "ts_ms": 7}]
    df = spark.createDataFrame([(json.dumps(x),) for x in e], "j string")
    assert rows(changelog.debezium(df, "j", payload)) == [(1, "a", "c", 5), (2, "b", "d", 6), (3, None, "r", 7)]
    cdc = spark.createDataFrame([("t", "I", 1, None, '{"id":1,"v":"a"}'), ("t", "U", 2, '{"id":1,"v":"a"}', '{"id":1,"v":"b"}'), ("t", "D", 3, '{"id":1,"v":"b"}', None)], "_table string, _op string, _ts_ms long, _before string, _after string")
    z = changelog.cdc_changes(cdc, payload)
    assert changelog.consolidate(z.select("id", "v", "_weight")).count() == 0 and z.count() == 4
    up = spark.createDataFrame([(1, 1, "c", "x"), (1, 2, "d", "x"), (2, 1, "c", "y")], "id int, seq int, op string, v string")
    assert rows(changelog.upsert_latest(up, ["id"], ["seq"], "op"), "id") == [(2,)]


def test_top_k(spark):
    df = spark.createDataFrame([("a", 3), ("a", None), ("a", 5), ("b", 1)], "g string, v int")
    assert [r.v for r in topk.top_k(df, 2, topk.order("v", True)).collect()] == [5, 3]
    assert [r.v for r in topk.top_k(df, 1, topk.order("v", nulls_first=True)).collect()] == [None]
    assert rows(topk.top_k_per_group(df, ["g"], 1, topk.order("v", True)), "g", "v") == [("a", 5), ("b", 1)]
    before = spark.createDataFrame([(1, 10), (2, 9)], "id int, v int")
    after = spark.createDataFrame([(1, 10), (2, 9), (3, 11)], "id int, v int")
    got = rows(changelog.topk_changelog(before, after, [F.desc("v")], 2, ["id"]), "rank", "_weight", "id")
    assert got == [(1, -1, 1), (1, 1, 3), (2, -1, 2), (2, 1, 1)]


def test_time(spark):
    assert interval_ms("5 SECOND") == 5000 and interval_ms("1 hour 30 minutes") == 5_400_000 and interval_ms("7") == 7000
    with pytest.raises(ValueError):
        interval_ms("1 MONTH")
    df = spark.sql("SELECT TIMESTAMP_NTZ'1969-12-31 23:59:59.9995' AS t")
    assert df.select(millis("t").alias("m")).head().m == -1
