"""Registered queries against their SQL in DuckDB."""

import os

import duckdb
import pytest

import __spark_entry__ as entry

FOLDER = "/root/testdata/sf0.001"
NAMES = sorted(entry.catalog.SQL)

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="test tables absent")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in sorted(f[:-8] for f in os.listdir(FOLDER) if f.endswith(".parquet")):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{FOLDER}/{name}.parquet')")
    return con


def rows(names, data):
    order = sorted(range(len(names)), key=lambda i: names[i])
    kept = [[r[i] for i in order] for r in data]
    return sorted(kept, key=lambda r: [(x is None, x != x if isinstance(x, float) else False, str(type(x)), x if isinstance(x, (int, float)) else repr(x)) for x in r])


def same(a, b):
    """Doubles may differ by one in the sixth place, where a tie goes either way."""
    if isinstance(a, float) and isinstance(b, float):
        return a == b or abs(a - b) < 1.5e-6 or (a != a and b != b)
    return a == b


@pytest.mark.parametrize("name", NAMES)
def test_equals_sql(spark, duck, name):
    df = entry.queries()[name](spark, FOLDER)
    got = [tuple(r) for r in df.collect()]
    cursor = duck.execute(entry.oracle_sql()[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == sorted(df.columns)
    want = rows(names, cursor.fetchall())
    got = rows(df.columns, got)
    assert len(got) == len(want)
    for x, y in zip(got, want, strict=True):
        assert all(map(same, x, y)), (x, y)
    assert got


def test_checked_queries_have_no_python_in_their_plan(spark):
    for name in ("score_batch", "tfidf_weights", "contributions", "strip_html", "slice_metrics", "queue_page"):
        plan = entry.queries()[name](spark, FOLDER)._jdf.queryExecution().optimizedPlan().toString()
        assert "PythonUDF" not in plan and "MapInPandas" not in plan


def test_entry_has_rows(spark):
    out = entry.entry(spark)
    assert out.count() == 200 and "decision" in out.columns
    assert set(entry.oracle_sql()) <= set(entry.queries())
