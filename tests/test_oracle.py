"""Every query gives the rows of its SQL twin on the small tables."""

from __future__ import annotations

from collections import Counter

import duckdb
import pytest

import __spark_entry__ as entry_points

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()
SQL = entry_points.oracle_sql()
BUILDERS = entry_points.queries()


@pytest.fixture(scope="module")
def duck(small_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{small_dir}/{t}.parquet'")
    return con


def _bag(rows):
    plain = lambda v: (None if v != v else v + 0.0) if isinstance(v, float) else v
    return Counter(tuple(plain(v) for v in row) for row in rows)


@pytest.mark.parametrize("key", sorted(BUILDERS))
def test_query(key, spark, small_dir, duck):
    df = BUILDERS[key](spark, small_dir)
    plan = df._jdf.queryExecution().executedPlan().toString()
    for costly in ("CartesianProduct", "BroadcastNestedLoopJoin", "PythonUDF", "BatchEvalPython"):
        assert costly not in plan
    columns = sorted(df.columns)
    ours = [tuple(r) for r in df.select(*columns).collect()]
    if key not in SQL:
        assert ours
        return
    result = duck.execute(SQL[key])
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    place = [names.index(c) for c in columns]
    theirs = [tuple(row[i] for i in place) for row in result.fetchall()]
    assert _bag(ours) == _bag(theirs)


def test_flagship(spark):
    assert entry_points.entry(spark).count() > 0
