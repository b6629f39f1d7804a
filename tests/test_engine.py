import pytest

from tidewell.engine import Engine
from tidewell.operators.topk import UnboundedSort
from tidewell.plans.lexer import SqlError


@pytest.fixture
def engine(spark, tmp_path):
    e = Engine(spark, str(tmp_path))
    e.execute("CREATE SOURCE trades (symbol VARCHAR NOT NULL, price DOUBLE, volume BIGINT, ts BIGINT NOT NULL, WATERMARK FOR ts AS ts - INTERVAL '0' SECOND)")
    return e


def rows(df, *cols):
    return sorted(tuple(r) for r in (df.select(*cols) if cols else df).collect())


def test_select_and_having(engine):
    engine.execute("INSERT INTO trades VALUES ('A', 100, 1, 0), ('A', 200, 1, 1), ('B', 50, 1, 2), ('B', 30, 1, 3), ('C', 500, 1, 4)")
    assert rows(engine.execute("SELECT symbol, SUM(price) AS s FROM trades GROUP BY symbol HAVING SUM(price) > 100")) == [("A", 300.0), ("C", 500.0)]
    assert rows(engine.execute("SELECT symbol FROM trades t WHERE t.price > 150")) == [("A",), ("C",)]
    assert rows(engine.execute("SELECT count(*) AS n FROM trades WHERE ts <= 4 - 1")) == [(4,)]


def test_windows_in_batch(engine):
    engine.execute("INSERT INTO trades VALUES ('A', 1, 1, 500), ('A', 3, 1, 900), ('A', 5, 1, 1500)")
    sql = "SELECT symbol, window_start, window_end, count(*) AS n FROM trades GROUP BY symbol, tumble(ts, INTERVAL '1' SECOND)"
    assert rows(engine.execute(sql)) == [("A", 0, 1000, 2), ("A", 1000, 2000, 1)]
    hop = "SELECT window_start, count(*) AS n FROM trades GROUP BY hop(ts, INTERVAL '500' MILLISECOND, INTERVAL '1' SECOND)"
    assert rows(engine.execute(hop)) == [(0, 2), (500, 2), (1000, 1), (1500, 1)]
    ses = "SELECT window_start, window_end, count(*) AS n FROM trades GROUP BY session(ts, INTERVAL '600' MILLISECOND)"
    assert rows(engine.execute(ses)) == [(500, 1500, 2), (1500, 2100, 1)]
    cast = "SELECT CAST(tumble(ts, INTERVAL '1' SECOND) AS BIGINT) AS w, max(price) AS hi FROM trades GROUP BY tumble(ts, INTERVAL '1' SECOND)"
    assert rows(engine.execute(cast)) == [(0, 3.0), (1000, 5.0)]


def test_interval_on_bigint(engine):
    engine.execute("INSERT INTO trades VALUES ('A', 1, 1, 5000)")
    assert rows(engine.execute("SELECT ts - INTERVAL '2' SECOND AS before FROM trades")) == [(3000,)]


def test_emit_on_window_close(engine):
    engine.execute("CREATE STREAM w AS SELECT symbol, window_start, count(*) AS n FROM trades GROUP BY symbol, tumble(ts, INTERVAL '1' SECOND) EMIT ON WINDOW CLOSE")
    engine.execute("INSERT INTO trades VALUES ('A', 1, 1, 500)")
    engine.run()
    engine.execute("INSERT INTO trades VALUES ('A', 1, 1, 700), ('A', 1, 1, 2500)")
    engine.run()
    engine.run()
    assert rows(engine.results("w")) == [("A", 0, 2)]


def test_emit_changes_pairs(engine):
    engine.execute("CREATE STREAM c AS SELECT symbol, count(*) AS n FROM trades GROUP BY symbol EMIT CHANGES")
    sub = engine.subscribe("c")
    for v in ("('A', 1, 1, 500)", "('A', 1, 1, 700), ('B', 1, 1, 800)"):
        engine.execute(f"INSERT INTO trades VALUES {v}")
    engine.run()
    got = [tuple(r[c] for c in ("symbol", "_op", "_weight", "n")) for batch in sub for r in batch]
    total = {}
    for s, _, w, n in got:
        total[s, n] = total.get((s, n), 0) + w
    assert {k for k, w in total.items() if w} == {("A", 2), ("B", 1)}


def test_filter_stream_sink_and_cascade(engine, tmp_path):
    engine.execute(f"""
    CREATE STREAM big AS SELECT symbol, price, ts FROM trades WHERE price > 10;
    CREATE STREAM huge AS SELECT symbol, price FROM big WHERE price > 100;
    CREATE SINK out FROM huge WHERE symbol <> 'Z' INTO files (path = '{tmp_path}/out') FORMAT json;
    INSERT INTO trades VALUES ('A', 5, 1, 1), ('B', 50, 1, 2), ('C', 500, 1, 3), ('Z', 900, 1, 4);
    """)
    engine.run()
    assert rows(engine.results("big"), "symbol") == [("B",), ("C",), ("Z",)]
    assert rows(engine.results("out"), "symbol") == [("C",)]
    assert "big [stream] <- trades" in engine.topology()


def test_asof(engine):
    engine.execute("""
    CREATE SOURCE quotes (symbol VARCHAR, ts BIGINT, bid DOUBLE, ask DOUBLE);
    INSERT INTO trades VALUES ('oak', 7, 20, 40), ('oak', 9, 21, 65), ('elm', 3, 5, 55), ('fir', 1, 1, 5);
    INSERT INTO quotes VALUES ('oak', 33, 6, 8), ('oak', 64, 8.5, 9.5), ('elm', 41, 2, 4), ('elm', 56, 9, 9);
    """)
    sql = "SELECT t.symbol, t.price, q.bid, q.ts AS qts FROM trades t ASOF JOIN quotes q MATCH_CONDITION(t.ts >= q.ts {more}) ON t.symbol = q.symbol"
    want = [("oak", 7.0, 6.0, 33), ("oak", 9.0, 8.5, 64), ("elm", 3.0, 2.0, 41), ("fir", 1.0, None, None)]
    key = lambda x: tuple(str(v) for v in x)
    got = lambda s: sorted((tuple(r) for r in engine.execute(s).collect()), key=key)
    assert got(sql.format(more="")) == sorted(want, key=key)
    near = [("oak", 7.0, 6.0, 33), ("oak", 9.0, 8.5, 64), ("elm", 3.0, None, None), ("fir", 1.0, None, None)]
    assert got(sql.format(more="AND t.ts - q.ts <= 10")) == sorted(near, key=key)
    other = "SELECT t.symbol, t.price, q.bid, q.ts AS qts FROM trades t ASOF JOIN quotes q ON t.symbol = q.symbol AND t.ts >= q.ts"
    assert got(other) == sorted(want, key=key)


def test_table_upsert(engine):
    engine.execute("CREATE TABLE products (id INT PRIMARY KEY, name VARCHAR, price DOUBLE); INSERT INTO products VALUES (1, 'a', 1.0); INSERT INTO products VALUES (1, 'b', 2.0)")
    assert rows(engine.execute("SELECT * FROM products")) == [(1, "b", 2.0)]


@pytest.mark.parametrize(
    "sql,error",
    [
        ("CREATE STREAM x AS SELECT * FROM trades EMIT ON WINDOW CLOSE", SqlError),
        ("CREATE STREAM x AS SELECT * FROM trades ORDER BY price", UnboundedSort),
        ("CREATE STREAM x AS SELECT * FROM trades a CROSS JOIN trades b", SqlError),
        ("CREATE SOURCE trades (a INT)", SqlError),
        ("CREATE SOURCE y (a ARRAY)", SqlError),
        ("CREATE SOURCE y (a VARCHAR, WATERMARK FOR a)", SqlError),
        ("CREATE SOURCE y (a INT) WITH (channel = 'spsc')", SqlError),
        ("DROP SOURCE nothing", SqlError),
        ("SELECT ${MISSING}", SqlError),
        ("CREATE STREAM x AS SELECT count(*) FROM trades GROUP BY tumble(ts, INTERVAL '1' MONTH)", ValueError),
    ],
)
def test_rejected(engine, sql, error):
    with pytest.raises(error):
        engine.execute(sql)


def test_catalog(engine):
    engine.execute("CREATE STREAM s AS SELECT symbol FROM trades; CREATE MATERIALIZED VIEW v AS SELECT symbol FROM s")
    with pytest.raises(SqlError):
        engine.execute("DROP SOURCE trades")
    assert [r.name for r in engine.execute("SHOW SOURCES").collect()] == ["trades"]
    assert [r.column_name for r in engine.execute("DESCRIBE trades").collect()] == ["symbol", "price", "volume", "ts"]
    assert ("kind", "select") in [tuple(r) for r in engine.execute("EXPLAIN SELECT * FROM trades").collect()]
    engine.execute("DROP SOURCE trades CASCADE")
    assert not engine.catalog.entries
    engine.execute("DROP STREAM IF EXISTS s")
    engine.stop()
    with pytest.raises(SqlError):
        engine.start()


def test_multi_join(engine):
    engine.execute("""
    CREATE TABLE orders (id INT, customer_id INT, product_code VARCHAR); CREATE TABLE customers (id INT, name VARCHAR); CREATE TABLE products (code VARCHAR, label VARCHAR);
    INSERT INTO orders VALUES (1, 10, 'x'), (2, 11, 'y'); INSERT INTO customers VALUES (10, 'ann'), (11, 'bob'); INSERT INTO products VALUES ('x', 'X'), ('y', 'Y');
    """)
    sql = "SELECT o.id, c.name, p.label FROM orders o JOIN customers c ON o.customer_id = c.id JOIN products p ON o.product_code = p.code"
    assert rows(engine.execute(sql)) == [(1, "ann", "X"), (2, "bob", "Y")]


def test_emit_changes_over_two_runs(engine):
    engine.execute("CREATE STREAM c AS SELECT symbol, count(*) AS n FROM trades GROUP BY symbol EMIT CHANGES")
    for v in ("('A', 1, 1, 500), ('B', 1, 1, 500)", "('A', 1, 1, 700)", "('B', 1, 1, 900)"):
        engine.execute(f"INSERT INTO trades VALUES {v}")
        engine.run()
    got = rows(engine.results("c"), "symbol", "n", "_weight")
    assert got == [("A", 1, -1), ("A", 1, 1), ("A", 2, 1), ("B", 1, -1), ("B", 1, 1), ("B", 2, 1)]


def test_common_table_expressions_hide_sources(engine):
    engine.execute("INSERT INTO trades VALUES ('A', 1, 1, 5)")
    sql = "WITH trades AS (SELECT 1 AS x), b (y) AS (SELECT x + 1 FROM trades) SELECT x, y FROM trades, b"
    assert rows(engine.execute(sql)) == [(1, 2)]
    assert engine.catalog.references(sql) == set()
    inner = "SELECT (WITH trades AS (SELECT 7 AS x) SELECT x FROM trades) AS a, count(*) AS n FROM trades"
    assert rows(engine.execute(inner)) == [(7, 1)] and engine.catalog.references(inner) == {"trades"}
    own = "WITH trades AS (SELECT symbol FROM trades) SELECT * FROM trades"
    assert rows(engine.execute(own)) == [("A",)]


def test_literals_stay(engine):
    engine.execute("CREATE SOURCE quotes (symbol VARCHAR, ts BIGINT, bid DOUBLE); INSERT INTO trades VALUES ('A', 1, 1, 5); INSERT INTO quotes VALUES ('A', 4, 9)")
    assert rows(engine.execute("SELECT 'watermark() FROM trades' AS x, watermark() IS NULL AS n FROM trades")) == [("watermark() FROM trades", True)]
    sql = "SELECT 't.price q.bid' AS x, t.ts AS a, q.ts AS b FROM trades t ASOF JOIN quotes q ON t.symbol = q.symbol AND t.ts >= q.ts"
    assert rows(engine.execute(sql)) == [("t.price q.bid", 5, 4)]
    assert engine.catalog.references("SELECT x IS DISTINCT FROM trades FROM a") == set()


def test_asof_stream_in_batches(spark, tmp_path):
    """Rows pushed a few at a time, out of order, to engines made anew, match as in one batch."""
    import random

    rng = random.Random(4)
    trades = [(rng.choice("ABC"), float(i), rng.randrange(1000)) for i in range(40)]
    quotes = [(rng.choice("ABC"), float(i), rng.randrange(1000)) for i in range(40)]
    for direction, op in (("back", ">="), ("ahead", "<=")):
        path = f"{tmp_path}/{direction}"
        for i in range(5):
            e = Engine(spark, path)
            e.execute("CREATE SOURCE t (symbol VARCHAR, price DOUBLE, ts BIGINT, WATERMARK FOR ts AS ts - INTERVAL '2' SECOND); CREATE SOURCE q (symbol VARCHAR, bid DOUBLE, qt BIGINT, WATERMARK FOR qt AS qt - INTERVAL '2' SECOND)")
            e.execute(f"CREATE STREAM j AS SELECT t.symbol, t.price, q.bid FROM t ASOF JOIN q MATCH_CONDITION(t.ts {op} q.qt AND t.ts - q.qt <= 300) ON t.symbol = q.symbol")
            end = [("Z", 0.0, 100_000)] if i == 4 else []
            e.push("t", trades[i * 8 : i * 8 + 8] + end)
            e.push("q", quotes[i * 8 : i * 8 + 8] + end)
            e.run()
        got = sorted((r.price, r.bid) for r in e.results("j").where("symbol <> 'Z'").collect())
        want = []
        for s, p, t in trades:
            near = [(x, b) for k, b, x in quotes if k == s and (0 <= t - x <= 300 if op == ">=" else 0 <= x - t <= 300)]
            times = {x for x, _ in near}
            best = (max(times) if op == ">=" else min(times)) if times else None
            want.append((p, {b for x, b in near if x == best}))
        assert len(got) == 40
        assert all(a == b and (x in y if y else x is None) for (a, x), (b, y) in zip(got, sorted(want, key=lambda r: r[0]), strict=True))


def test_lag_lead_in_batches(spark, tmp_path):
    for i, part in enumerate([[("a", 1.0, 10), ("a", 3.0, 30)], [("a", 2.0, 20), ("b", 9.0, 25)], [("a", 4.0, 3000), ("a", 5.0, 9000)]]):
        e = Engine(spark, str(tmp_path))
        e.execute("CREATE SOURCE t (k VARCHAR, v DOUBLE, ts BIGINT, WATERMARK FOR ts AS ts - INTERVAL '1' SECOND)")
        e.execute("CREATE STREAM l AS SELECT k, v, LAG(v, 2, 0.5) OVER (PARTITION BY k ORDER BY ts) AS p, LEAD(k) OVER (PARTITION BY k ORDER BY ts) AS n FROM t")
        e.push("t", part)
        e.run()
        if i == 1:
            assert e.results("l").count() == 0
    key = lambda r: tuple(str(x) for x in r)
    assert sorted((tuple(r) for r in e.results("l").collect()), key=key) == sorted([("a", 1.0, 0.5, "a"), ("a", 2.0, 0.5, "a"), ("a", 3.0, 1.0, "a"), ("b", 9.0, 0.5, None)], key=key)


@pytest.mark.parametrize("sql", ["CREATE STREAM x AS SELECT symbol, LAG(price) OVER (PARTITION BY symbol ORDER BY ts DESC) AS p FROM trades", "CREATE STREAM x AS SELECT symbol, count(*) AS n FROM trades GROUP BY symbol ORDER BY n LIMIT 3", "CREATE STREAM x AS SELECT symbol FROM trades LATE DATA TO y"])
def test_streams_refused_at_creation(engine, sql):
    with pytest.raises(SqlError):
        engine.execute(sql)


def test_database_sink(engine, tmp_path):
    import sqlite3

    db = f"{tmp_path}/x.db"
    with sqlite3.connect(db) as c:
        c.execute('CREATE TABLE "out" ("symbol" TEXT PRIMARY KEY, "price" REAL)')
    engine.execute(f"CREATE STREAM s AS SELECT symbol, price FROM trades WHERE price > 1; CREATE SINK o FROM s INTO database (driver = 'sqlite3:connect', connect = '{db}', table.name = 'out', write.mode = 'upsert', primary.key = 'symbol')")
    for v in ("('A', 2, 1, 5), ('B', 3, 1, 5), ('C', 1, 1, 5)", "('A', 7, 1, 6)"):
        engine.execute(f"INSERT INTO trades VALUES {v}")
        engine.run()
    with sqlite3.connect(db) as c:
        assert sorted(c.execute('SELECT * FROM "out"').fetchall()) == [("A", 7.0), ("B", 3.0)]


def test_avro_of_all_types(spark):
    import datetime
    import decimal

    from tidewell.sources import avro

    schema = "a int not null, b bigint, c double, d string, e binary, f boolean, g decimal(20,3), h date, i timestamp_ntz, j timestamp, k array<string>, l map<string,int>, m struct<x:int,y:array<double>>, n float"
    at = datetime.datetime(1969, 12, 31, 23, 59, 59, 999999)
    full = (-5, -(2**62), 1.25, "é\n", b"\x00\xff", True, decimal.Decimal("-12345678901234567.891"), datetime.date(1960, 2, 29), at, at.replace(tzinfo=datetime.UTC), ["a", None], {"k": 1, "n": None}, (3, [0.5]), 0.5)
    data = [full, (300, *[None] * 13), (0, 64, -0.0, "", b"", False, decimal.Decimal("0.128"), datetime.date(1970, 1, 1), at, at.replace(tzinfo=datetime.UTC), [], {}, (None, None), 1.0)]
    df = spark.createDataFrame(data, schema)
    back = avro.decode(avro.encode(df, 7), df.schema)
    assert back.schema == df.schema and sorted(map(str, back.collect())) == sorted(map(str, df.collect()))
    assert {bytes(r.value)[:5] for r in avro.encode(df, 7).collect()} == {b"\x00\x00\x00\x00\x07"}


def test_push_of_many_partitions_and_sequence(spark, tmp_path):
    e = Engine(spark, str(tmp_path))
    e.execute("CREATE TABLE t (id BIGINT PRIMARY KEY, v INT)")
    e.push("t", spark.range(1000).selectExpr("id", "1 AS v").repartition(5))
    again = Engine(spark, str(tmp_path))
    again.execute("CREATE TABLE t (id BIGINT PRIMARY KEY, v INT); INSERT INTO t VALUES (7, 2)")
    assert rows(again.execute("SELECT v, count(*) AS n FROM t GROUP BY v")) == [(1, 999), (2, 1)]
