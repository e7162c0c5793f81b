"""Every query against its expected result, and what its plan must not hold."""

import math

import duckdb
import pytest

import __spark_entry__ as entry

FOLDER = "/root/testdata/sf0.001"
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages"
    " benchmark labels conversations"
).split()
TYPES = {"bigint": "BIGINT", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN"}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{FOLDER}/{name}.parquet'")
    yield con
    con.close()


def plain(value):
    return None if isinstance(value, float) and math.isnan(value) else value


from failtriage.plans.catalog import QUERIES  # noqa: E402


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = entry.queries()[name](spark, FOLDER)
    plan = df._jdf.queryExecution().executedPlan().toString()
    for operator in ("BatchEvalPython", "ArrowEvalPython", "CartesianProduct", "BroadcastNestedLoopJoin"):
        assert operator not in plan
    columns = sorted(df.columns)
    got = sorted(repr(tuple(r[c] for c in columns)) for r in df.collect())
    cursor = duck.execute(entry.oracle_sql()[name])
    names = [c[0] for c in cursor.description]
    assert sorted(names) == columns
    assert {c: TYPES[t] for c, t in df.dtypes} == {c[0]: str(c[1]) for c in cursor.description}
    order = [names.index(c) for c in columns]
    expected = sorted(repr(tuple(plain(row[i]) for i in order)) for row in cursor.fetchall())
    assert got == expected
    assert got


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_every_query_has_an_expected_result():
    assert set(QUERIES) <= set(entry.oracle_sql())
