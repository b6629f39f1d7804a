import os
import time

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewell.sources import connectors, formats
from tidewell.streaming import state
from tidewell.streaming.time import AlignmentGroup, BoundedWatermark, LateSplit, SourceWatermarks, is_late


def write(spark, path, batches, schema):
    """One file a batch, in order of time."""
    for i, b in enumerate(batches):
        tmp = f"{path}-{i}"
        spark.createDataFrame(b, schema).coalesce(1).write.parquet(tmp)
        os.makedirs(path, exist_ok=True)
        name = next(f for f in os.listdir(tmp) if f.endswith(".parquet"))
        os.rename(f"{tmp}/{name}", f"{path}/{i:03}.parquet")
        os.utime(f"{path}/{i:03}.parquet", (time.time() - 1000 + i, time.time() - 1000 + i))


def run(spark, path, schema, each, tmp, transform=lambda df: df, mode="append"):
    s = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)
    q = transform(s).writeStream.foreachBatch(each).outputMode(mode).option("checkpointLocation", tmp).trigger(availableNow=True).start()
    q.awaitTermination()
    assert q.exception() is None


def test_late_split(spark, tmp_path):
    write(spark, f"{tmp_path}/in", [[(100,), (200,)], [(150,), (300,), (200,)], [(None,), (290,)]], "ms long")
    good, late = [], []
    split = LateSplit(F.col("ms"), 10, lambda b, i: good.extend(r.ms for r in b.collect()), lambda b, i: late.extend(r.ms for r in b.collect()), f"{tmp_path}/s")
    run(spark, f"{tmp_path}/in", "ms long", split, f"{tmp_path}/c")
    assert sorted(good) == [200, 290, 300] and sorted(late) == [100, 150, 200] and split.dropped == 3


def test_late_split_by_window_goes_on(spark, tmp_path):
    """Every batch has a new object, which reads the watermark that the one before has left."""
    good, late = [], []
    end = F.floor(F.col("ms") / 100) * 100 + 100
    for i, rows in enumerate([[100, 205], [150, 199, 301], [205, 290, 310, None], [250, 310]]):
        split = LateSplit(F.col("ms"), 0, lambda b, i: good.extend((i, r.ms) for r in b.collect()), lambda b, i: late.extend((i, r.ms) for r in b.collect()), f"{tmp_path}/s", end, 5)
        split(spark.createDataFrame([(x,) for x in rows], "ms long"), i)
    # After batch 0 the watermark is 205: the window up to 200 and 5 more are over; after batch 2 it is 310.
    assert sorted(late) == [(1, 150), (1, 199), (3, 250)]
    assert sorted(good) == [(0, 100), (0, 205), (1, 301), (2, 205), (2, 290), (2, 310), (3, 310)]


def test_emit_changes(spark, tmp_path):
    write(spark, f"{tmp_path}/in", [[("a", 1)], [("a", 2), ("b", 1)], [("c", 1)]], "k string, v int")
    out = []
    each = state.EmitChanges(["k"], f"{tmp_path}/state", lambda b, i: out.extend((i, r.k, r._op, r._weight, r.n) for r in b.collect()))
    run(spark, f"{tmp_path}/in", "k string, v int", each, f"{tmp_path}/c", lambda s: s.groupBy("k").agg(F.count("*").alias("n")), "update")
    assert sorted(out) == [(0, "a", "insert", 1, 1), (1, "a", "update_after", 1, 2), (1, "a", "update_before", -1, 1), (1, "b", "insert", 1, 1), (2, "c", "insert", 1, 1)]


def test_stream_top_k(spark, tmp_path):
    write(spark, f"{tmp_path}/in", [[(1, 5), (2, 7)], [(3, 6)], [(4, 1)]], "id int, v int")
    out = []
    top = state.TopK(2, [F.desc("v")], lambda b, i: out.extend((i, r["rank"], r._weight, r.id) for r in b.collect()), f"{tmp_path}/s")
    run(spark, f"{tmp_path}/in", "id int, v int", top, f"{tmp_path}/c")
    assert sorted(out) == [(0, 1, 1, 2), (0, 2, 1, 1), (1, 2, -1, 1), (1, 2, 1, 3)]
    # A new object goes on from the last version; a batch that runs twice gives the same rows.
    for _ in range(2):
        again = []
        state.TopK(2, [F.desc("v")], lambda b, i: again.extend((r["rank"], r._weight, r.id) for r in b.collect()), f"{tmp_path}/s")(spark.createDataFrame([(5, 9)], "id int, v int"), 3)
        assert sorted(again) == [(1, -1, 2), (1, 1, 5), (2, -1, 3), (2, 1, 2)]


def test_lag_lead(spark, tmp_path):
    write(spark, f"{tmp_path}/in", [[("a", 1, 10.0), ("a", 2, 20.0)], [("a", 3, 30.0)], [("a", 4, 40.0), ("b", 1, 1.0)]], "k string, t long, v double")
    out = []
    run(spark, f"{tmp_path}/in", "k string, t long, v double", lambda b, i: out.extend((r.k, r.t, r.lag, r.lead) for r in b.collect()), f"{tmp_path}/c", lambda s: state.lag_lead(s, ["k"], "t", "v", 1, 1))
    none = lambda x: None if x != x else x
    assert sorted((k, t, none(a) if a is not None else None, b) for k, t, a, b in out) == [("a", 1, None, 20.0), ("a", 2, 10.0, 30.0), ("a", 3, 20.0, 40.0)]


def test_sorted_up_to(spark, tmp_path):
    write(spark, f"{tmp_path}/in", [[(5,), (1,)], [(3,), (9,)], [(2,), (20,)]], "ms long")
    out = []
    each = state.SortedUpTo("ms", 3, lambda b, i: out.extend(r.ms for r in b.collect()), f"{tmp_path}/state")
    run(spark, f"{tmp_path}/in", "ms long", each, f"{tmp_path}/c")
    assert out == [1, 3, 5, 9]


def test_keyed_watermark(spark, tmp_path):
    write(spark, f"{tmp_path}/in", [[("a", 100), ("b", 10)], [("a", 50), ("b", 9), ("a", 99)]], "k string, ms long")
    out = []
    run(spark, f"{tmp_path}/in", "k string, ms long", lambda b, i: out.extend(tuple(r) for r in b.collect()), f"{tmp_path}/c", lambda s: state.keyed_watermark(s, ["k"], "ms", 5))
    assert sorted(out) == [("a", 100), ("a", 99), ("b", 10), ("b", 9)] or sorted(out) == sorted([("a", 100), ("a", 99), ("b", 10), ("b", 9)])


def test_watermarks():
    w = BoundedWatermark(10)
    assert [w.observe(x) for x in (100, 50, None, 120)] == [90, 90, 90, 110] and w.advance(5) == 110
    s = SourceWatermarks(idle_ms=30)
    s.add("a"), s.add("b")
    assert s.observe("a", 100, 1) is None
    assert s.observe("b", 50, 2) == 50
    assert s.observe("a", 200, 40) == 200 and s.at(100) == 200
    assert is_late(10, 10) and not is_late(9, 10) and not is_late(10, 10, 1)
    g = AlignmentGroup(10, "drop")
    assert g.judge({"a": 0, "b": 11, "c": 10}) == {"a": "go", "b": "drop", "c": "go"}


def test_connectors():
    assert connectors.kafka_source({"bootstrap.servers": "h:1", "topic": "t", "startup.mode": "specific", "startup.offsets": "0:5,1:7"})["startingOffsets"] == '{"t": {"0": 5, "1": 7}}'
    with pytest.raises(connectors.ConnectorError):
        connectors.kafka_source({"topic": "t"})
    assert connectors.kafka_sink({"bootstrap.servers": "h", "topic": "t", "delivery.guarantee": "exactly-once"})["kafka.enable.idempotence"] == "true"
    merge = connectors.postgres_writer({"hostname": "h", "database": "d", "table.name": "t", "write.mode": "upsert", "primary.key": "id"}, ["id", "v"])["merge"]
    assert 'ON CONFLICT ("id") DO UPDATE SET "v" = EXCLUDED."v"' in merge
    assert connectors.partition_transforms("day(ts), bucket(16, id), truncate(name, 4), region") == [("day", "ts", None), ("bucket", "id", 16), ("truncate", "name", 4), ("identity", "region", None)]
    assert connectors.reference_refresh("periodic:60") == ("periodic", 60)
    assert connectors.masked({"password": "x", "path": "p"}) == {"password": "***", "path": "p"}
    calls = []
    with pytest.raises(ZeroDivisionError):
        connectors.retry(lambda: calls.append(1) or 1 / 0, 3, sleep=lambda s: None)
    assert len(calls) == 3
    now = [0.0]
    b = connectors.CircuitBreaker(2, 10, lambda: now[0])
    for _ in range(2):
        with pytest.raises(ZeroDivisionError):
            b.call(lambda: 1 / 0)
    with pytest.raises(connectors.CircuitOpen):
        b.call(lambda: 1)
    now[0] = 11
    assert b.call(lambda: 1) == 1
    r = connectors.RateLimit(1, 2, lambda: now[0])
    assert [r.take(), r.take(), r.take()] == [True, True, False]


def test_formats(spark):
    from pyspark.sql import types as T

    schema = T.StructType([T.StructField("a", T.IntegerType(), False), T.StructField("b", T.StringType())])
    df = spark.createDataFrame([('{"a": 1, "b": "x"}',), ('{"a": 2}',)], "value string")
    assert sorted(tuple(r) for r in formats.decode(df, "json", schema).collect()) == [(1, "x"), (2, None)]
    with pytest.raises(Exception, match="missing value of a"):
        formats.decode(spark.createDataFrame([('{"b": "x"}',)], "value string"), "json", schema).collect()
    assert formats.decode(spark.createDataFrame([("1;z",)], "value string"), "csv", schema, options={"delimiter": ";"}).collect()[0].b == "z"
    assert formats.encode(spark.createDataFrame([(1, None)], "a int, b string"), "json").head().value == '{"a":1,"b":null}'
    old = T.StructType([T.StructField("a", T.IntegerType())])
    assert connectors.compatible(old, T.StructType([*old.fields, T.StructField("c", T.StringType())]), "BACKWARD")
    assert not connectors.compatible(old, T.StructType([T.StructField("c", T.StringType(), False)]), "FULL")


def test_sorted_up_to_goes_on_in_a_new_object(spark, tmp_path):
    out = []
    for i, b in enumerate([[(5,), (1,)], [(3,), (9,)], [(2,), (7,), (20,)]]):
        each = state.SortedUpTo("ms", 3, lambda b, i: out.extend(r.ms for r in b.collect()), f"{tmp_path}/state")
        each(spark.createDataFrame(b, "ms long"), i)
    assert out == [1, 3, 5, 7, 9]


def test_lag_lead_at_the_end_of_time(spark, tmp_path):
    write(spark, f"{tmp_path}/in", [[("a", 1, 10.0), ("a", 2, 20.0)], [("b", 3, 1.0), ("a", 3, 30.0)], [("c", 60, 5.0)], [("c", 61, 6.0)]], "k string, t long, v double")
    out = []
    lag_lead = lambda s: state.lag_lead(s.withColumn("at", F.timestamp_millis("t")).withWatermark("at", "10 milliseconds"), ["k"], "t", "v", 1, 2, event_time="at", default=-1.0)
    run(spark, f"{tmp_path}/in", "k string, t long, v double", lambda b, i: out.extend((r.k, r.t, r.lag, r.lead, r["at"].microsecond) for r in b.collect()), f"{tmp_path}/c", lag_lead)
    # c waits: the watermark stands at 51.
    assert sorted(out) == [("a", 1, -1.0, 30.0, 1000), ("a", 2, 10.0, -1.0, 2000), ("a", 3, 20.0, -1.0, 3000), ("b", 3, -1.0, -1.0, 3000)]


def test_schema_registry():
    import json
    import threading
    from http.server import BaseHTTPRequestHandler, HTTPServer

    calls, known = [], {1: '"string"'}

    class Registry(BaseHTTPRequestHandler):
        def answer(self, body, code=200):
            self.send_response(code)
            self.end_headers()
            self.wfile.write(json.dumps(body).encode())

        def do_GET(self):
            calls.append(self.path)
            if self.path == "/subjects/s/versions/latest":
                self.answer({"id": max(known), "schema": known[max(known)]})
            elif (n := int(self.path.rsplit("/", 1)[1])) in known:
                self.answer({"schema": known[n]})
            else:
                self.answer({}, 404)

        def do_POST(self):
            schema = json.loads(self.rfile.read(int(self.headers["Content-Length"])))["schema"]
            if self.path.startswith("/compat"):
                self.answer({"is_compatible": schema != '"int"'})
            else:
                known[len(known) + 1] = schema
                self.answer({"id": len(known)})

        def log_message(self, *a):
            pass

    server = HTTPServer(("127.0.0.1", 0), Registry)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    try:
        r = connectors.SchemaRegistry(f"http://127.0.0.1:{server.server_port}/")
        assert r.schema(1) == r.schema(1) == '"string"' and calls == ["/schemas/ids/1"]
        assert r.register("s", '"long"') == 2 and r.latest("s") == (2, '"long"')
        assert r.compatible("s", '"long"') and not r.compatible("s", '"int"')
        with pytest.raises(connectors.ConnectorError):
            r.schema(9)
    finally:
        server.shutdown()


def test_compatibility_levels():
    def of(text):
        return T.StructType([T.StructField(x.rstrip("?"), T.LongType(), x.endswith("?")) for x in text.split()])

    one, two, three = of("a"), of("a b?"), of("a b? c")
    assert connectors.compatible(one, two, "BACKWARD") and connectors.compatible(one, two, "FULL") and not connectors.compatible(two, three, "BACKWARD")
    last = of("b?")
    assert connectors.compatible_with_all([of("a?"), of("")], last, "BACKWARD_TRANSITIVE")
    assert connectors.compatible_with_all([of("b c"), of("b?")], of("b?"), "FORWARD") and not connectors.compatible_with_all([of("b c"), of("b?")], of("b?"), "FORWARD_TRANSITIVE")
    with pytest.raises(connectors.ConnectorError):
        connectors.compatible(one, two, "SOMETIMES")


def test_kafka_partitioners(spark):
    df = spark.range(40).selectExpr("id", "id % 3 AS k").repartition(4)
    rows = connectors.kafka_rows(df, {"key.column": "k"}, "json").collect()
    assert sorted(r.key for r in rows) == sorted(str(i % 3) for i in range(40)) and '{"id":7,"k":1}' in {r.value for r in rows}
    spread = connectors.kafka_rows(df, {"partitioner": "round-robin", "partitions": "5"}, "csv").groupBy("partition").count().collect()
    assert {r.partition for r in spread} == set(range(5)) and all(4 <= r["count"] <= 12 for r in spread)
    sticky = connectors.kafka_rows(df, {"partitioner": "sticky", "partitions": "5"}, "json", 3)
    assert max(r.n for r in sticky.withColumn("task", F.spark_partition_id()).groupBy("task").agg(F.count_distinct("partition").alias("n")).collect()) == 1
    for wrong in ({"partitioner": "odd"}, {"partitioner": "sticky"}, {"key.column": "z"}):
        with pytest.raises(connectors.ConnectorError):
            connectors.kafka_rows(df, wrong, "json")
