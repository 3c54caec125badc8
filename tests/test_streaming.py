"""Streams end where the batch ends; rows behind the watermark are dropped; keyed tables survive restarts."""

from __future__ import annotations

import datetime as dt
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from siteledger.operators import cleaning
from siteledger.streaming import jobs
from siteledger.streaming.store import KeyedTable

D = dt.date
SCHEMA = (
    "project_id string, log_id string, date date, hours_st double, hours_ot double, "
    "hourly_rate double, burden_multiplier double"
)


def _row(log, day, st=1.0):
    return ("P", log, day, st, 0.0, 10.0, 1.0)


def _stream(spark, path, delay):
    schema = spark.createDataFrame([], SCHEMA).schema
    return jobs.stream_weekly_cost(jobs.labor_stream(spark, path, schema), delay)


def test_late_row_is_dropped(spark, tmp_path):
    src, out, state = (str(tmp_path / n) for n in ("src", "out", "state"))
    first = [_row("a", D(2024, 1, 1)), _row("b", D(2024, 1, 3)), _row("c", D(2024, 3, 1))]
    spark.createDataFrame(first, SCHEMA).write.parquet(src)
    jobs.run_available(_stream(spark, src, "7 days"), out, state)
    late = [_row("late", D(2024, 1, 2), 5.0), _row("d", D(2024, 6, 1))]
    spark.createDataFrame(late, SCHEMA).write.mode("append").parquet(src)
    jobs.run_available(_stream(spark, src, "7 days"), out, state)
    got = {r["week_start"]: r["total_labor_cost"] for r in spark.read.parquet(out).collect()}
    assert got[D(2024, 1, 1)] == 20.0
    assert got[D(2024, 2, 26)] == 10.0


def test_dedup_across_runs(spark, tmp_path):
    src, out, state = (str(tmp_path / n) for n in ("src", "out", "state"))
    schema = spark.createDataFrame([], SCHEMA).schema
    for rows in ([_row("a", D(2024, 1, 1)), _row("a", D(2024, 1, 2))], [_row("a", D(2024, 1, 3)),
                                                                       _row("b", D(2024, 1, 3))]):
        spark.createDataFrame(rows, SCHEMA).write.mode("append").parquet(src)
        stream = jobs.stream_labor_dedup(jobs.labor_stream(spark, src, schema))
        jobs.run_available(stream, out, state)
    assert sorted(r["log_id"] for r in spark.read.parquet(out).collect()) == ["a", "b"]


def test_refresh_keeps_newest(spark, tmp_path):
    src, root, state = (str(tmp_path / n) for n in ("src", "table", "state"))
    schema = spark.createDataFrame([], "k string, v bigint").schema
    table = jobs.refreshed(spark, root, schema, ["k"], 4)
    for rows in ([("a", 1), ("b", 1), (None, 7)], [("a", 2)], [("c", 9), ("c", 8)]):
        spark.createDataFrame(rows, schema).write.mode("append").parquet(src)
        jobs.merge_stream(spark.readStream.schema(schema).parquet(src), table, state)
    got = {r["k"]: r["v"] for r in table.read().collect()}
    assert got == {"a": 2, "b": 1, None: 7, "c": 8}


def test_first_rows_are_those_of_the_batch(spark, tmp_path):
    """Files in any order of days leave the rows that batch duplicate removal leaves."""
    src, root, state = (str(tmp_path / n) for n in ("src", "table", "state"))
    schema = spark.createDataFrame([], SCHEMA).schema
    rows = [_row(f"L{k % 7}", D(2024, 1, 1) + dt.timedelta(days=-k * 5 % 37), float(k % 3)) for k in range(40)]
    rows += [("P", "L1", None, 1.0, None, 10.0, 1.0), ("P", "L9", None, 2.0, 0.0, 10.0, 1.0)]
    table = jobs.first_rows(spark, root, schema, 3)
    for k in range(0, len(rows), 9):
        spark.createDataFrame(rows[k : k + 9], SCHEMA).write.mode("append").parquet(src)
        jobs.merge_stream(spark.readStream.schema(schema).parquet(src), table, state)
    expected = cleaning.dedup_labor(spark.createDataFrame(rows, SCHEMA))
    assert sorted(map(str, table.read().collect())) == sorted(map(str, expected.collect()))


# ---- the keyed table

KV = "k bigint, v bigint, `a.b` string"


def _table(spark, root, buckets=4):
    return KeyedTable(spark, root, spark.createDataFrame([], KV).schema, ["k"], [F.col("v").desc(), F.col("`a.b`")], buckets)


def _rows(spark, pairs):
    return spark.createDataFrame([(k, v, f"x{v}") for k, v in pairs], KV)


def _state(table):
    return {r["k"]: r["v"] for r in table.read().collect()}


def _files(root, pattern="data/*/*/*.parquet"):
    return sorted(str(p) for p in Path(root).glob(pattern))


def test_merges_rewrite_touched_buckets_only(spark, tmp_path):
    root = str(tmp_path / "t")
    table = _table(spark, root, 16)
    table.merge(_rows(spark, [(k, 1) for k in range(200)]), 0)
    before = table.live()
    table.merge(_rows(spark, [(3, 5), (3, 4)]), 1)
    after = table.live()
    assert len(before) == 16 and sum(before[b] != after[b] for b in before) == 1
    assert _state(table) == {k: 5 if k == 3 else 1 for k in range(200)}
    assert {r["k"]: r["v"] for r in table.read(0).collect()}[3] == 1


def test_reads_do_not_grow_with_batches(spark, tmp_path):
    table = _table(spark, str(tmp_path / "t"), 2)
    for b in range(6):
        table.merge(_rows(spark, [(k, b) for k in range(30)]), b)
    assert len(table.read().inputFiles()) <= 2 and _state(table) == {k: 5 for k in range(30)}
    assert table.vacuum(keep=2) == 8 and len(_files(tmp_path / "t")) <= 4
    assert _state(table) == {k: 5 for k in range(30)} and len(table.read(4).inputFiles()) <= 2
    table.merge(_rows(spark, [(1, 99)]), 6)
    assert _state(table)[1] == 99


@pytest.mark.parametrize("step", ["write", "commit", "after"])
def test_a_restart_at_any_step_changes_nothing(spark, tmp_path, monkeypatch, step):
    src, root, state = (str(tmp_path / n) for n in ("src", "t", "state"))
    schema = spark.createDataFrame([], KV).schema
    table = _table(spark, root)
    run = lambda t: jobs.merge_stream(spark.readStream.schema(schema).parquet(src), t, state)
    _rows(spark, [(k, 1) for k in range(50)]).write.parquet(src)
    run(table)
    real = KeyedTable._commit

    def stopped(self, batch, live):
        if step == "commit":
            raise RuntimeError("lost")
        real(self, batch, live)
        raise RuntimeError("lost")

    def unwritten(self, live):
        raise RuntimeError("lost")

    with monkeypatch.context() as m:
        if step == "write":
            m.setattr(KeyedTable, "_read", unwritten)
        else:
            m.setattr(KeyedTable, "_commit", stopped)
        _rows(spark, [(k, 2) for k in range(0, 50, 3)]).write.mode("append").parquet(src)
        with pytest.raises(Exception, match="lost"):
            run(table)
    expected = {k: 2 if k % 3 == 0 else 1 for k in range(50)}
    assert _state(table) == (expected if step == "after" else {k: 1 for k in range(50)})
    run(table)
    assert _state(table) == expected
    run(table)
    assert _state(table) == expected and table._commits() == [0, 1]


def test_empty_batches_and_wrong_buckets(spark, tmp_path):
    root = str(tmp_path / "t")
    table = _table(spark, root)
    assert table.read().count() == 0 and table.vacuum() == 0
    table.merge(_rows(spark, [(1, 1)]).limit(0), 0)
    assert table.read().count() == 0
    table.merge(_rows(spark, [(None, 1), (None, 2)]), 1)
    assert _state(table) == {None: 2}
    with pytest.raises(ValueError, match="buckets"):
        _table(spark, root, 5).read()
