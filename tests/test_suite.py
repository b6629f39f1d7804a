"""Every registered query against DuckDB on the smallest tables."""

import os
from pathlib import Path

import pytest

from tidewell import suite, suite_engine

DATA = Path(os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001"))
pytestmark = pytest.mark.skipif(not DATA.exists(), reason="no test tables")
duckdb = pytest.importorskip("duckdb")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for p in DATA.iterdir():
        c.sql(f"CREATE VIEW {p.stem} AS FROM '{p}'")
    return c


def cells(df):
    cols = sorted(df.columns)
    x = df[cols].astype(object).where(df[cols].notna(), None)
    return sorted(map(tuple, x.map(lambda v: repr(float(v)) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)[:10] if hasattr(v, "year") else str(v)).to_numpy().tolist()))


QUERIES = suite.queries() | suite_engine.queries()
ORACLE = suite.oracle_sql() | suite_engine.oracle_sql()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    got = QUERIES[name](spark, str(DATA)).toPandas()
    sql = ORACLE.get(name)
    if sql is None:
        assert len(got)
        return
    want = con.sql(sql).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert cells(got) == cells(want)


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


def test_stream_results_stay_with_the_executors(spark):
    """The driver once held all rows of a stream in its memory sink; they are files that all executors see, and no state is left."""
    for name in ("stream_session", "stream_emit_update"):
        plan = QUERIES[name](spark, str(DATA))._jdf.queryExecution().optimizedPlan().toString()
        assert "MemoryPlan" not in plan and "parquet" in plan
    files = suite._run(suite._stream(spark, str(DATA)).select("event_id")).inputFiles()
    (base,) = {Path(f.removeprefix("file:")).parents[2] for f in files}
    assert [p.name for p in base.iterdir()] == ["out"]


def test_stream_without_files_has_no_rows(spark, tmp_path):
    source = spark.readStream.schema("a long").parquet(str(tmp_path))
    out = suite._run(source)
    assert out.columns == ["a"] and out.count() == 0
