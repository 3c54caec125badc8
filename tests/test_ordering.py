"""Distributed totals, ranks and quantiles against brute force, with a hot key."""

from __future__ import annotations

import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from siteledger.operators import ordering
from siteledger.operators.ordering import exact_quantiles, global_rank, running_total


def _rows(n=3000, seed=7):
    rng = random.Random(seed)
    # One owner holds most rows, and values repeat heavily.
    return [
        ("hot" if rng.random() < 0.7 else f"o{rng.randrange(5)}", rng.randrange(40), i)
        for i in range(n)
    ]


@pytest.mark.parametrize("partitions", ["1", "7", "50"])
def test_running_total_and_rank(spark, partitions):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        rows = _rows()
        df = spark.createDataFrame(rows, "owner string, v bigint, id bigint")
        order = [F.col("v").desc(), F.col("id").asc()]
        got = {
            r["id"]: r["total"]
            for r in running_total(df, ["owner"], order, F.col("v"), "total").collect()
        }
        want, sums = {}, defaultdict(int)
        for owner, v, i in sorted(rows, key=lambda r: (-r[1], r[2])):
            sums[owner] += v
            want[i] = sums[owner]
        assert got == want
        ranks = {r["id"]: r["rank"] for r in global_rank(df, order, "rank").collect()}
        best = sorted(rows, key=lambda r: (-r[1], r[2]))
        assert ranks == {r[2]: n for n, r in enumerate(best, 1)}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


@pytest.mark.parametrize("n", [1, 2, 5, 1000])
def test_quantiles_match_numpy(spark, n):
    rng = random.Random(n)
    values = [(round(rng.gauss(0, 10), 2), None if i % 7 == 6 else float(i % 3)) for i in range(n)]
    df = spark.createDataFrame(values, "a double, b double")
    wanted = {"a": [0.1, 0.25, 0.5], "b": [0.9, 0.75]}
    got = {(r["metric"], r["q"]): r["value"] for r in exact_quantiles(df, wanted).collect()}
    for i, (metric, qs) in enumerate(wanted.items()):
        known = [v[i] for v in values if v[i] is not None]
        for q in qs:
            assert got[(metric, q)] == pytest.approx(np.quantile(known, q), rel=1e-12, abs=1e-12)


def test_quantiles_of_nothing(spark):
    df = spark.createDataFrame([], "a double")
    assert exact_quantiles(df, {"a": [0.5]}).collect() == []


@pytest.mark.parametrize("few", [1, 3, 1000])
def test_quantiles_of_odd_values(spark, monkeypatch, few):
    monkeypatch.setattr(ordering, "FEW", few)
    monkeypatch.setattr(ordering, "PARTS", 4)
    rng = random.Random(few)
    tail = [rng.choice([-1, 1]) * 10.0 ** rng.randint(-300, 300) for _ in range(150)] + [1e308, -1e308, 5e-324, 0.0, -0.0]
    same = [7.25] * 120 + [8.0] * 30 + [7.25000000000001] * 5
    ends = [float("inf")] * 3 + [float("-inf")] * 2 + [float("nan")] * 4 + [None] * 6 + [float(i) for i in range(140)]
    rows = list(zip(tail, same, ends, strict=True))
    df = spark.createDataFrame(rows, "a double, `b.x` double, c double").repartition(5)
    qs = [0.0, 0.01, 0.1, 0.25, 0.5, 0.75, 0.9, 0.99, 1.0]
    wanted = {"a": qs, "b.x": qs, "c": [0.0, 0.05, 0.5, 0.9, 1.0]}
    got = {(r["metric"], r["q"]): r["value"] for r in exact_quantiles(df, wanted).collect()}
    for metric, column in (("a", tail), ("b.x", same), ("c", [x for x in ends if x is not None and x == x])):
        known = sorted(column)
        for q in wanted[metric]:
            place = q * (len(known) - 1)
            low, high = known[int(np.floor(place))], known[int(np.ceil(place))]
            assert got[metric, q] == (low if low == high else low + (high - low) * (place - np.floor(place)))


def test_quantiles_shuffle_no_values(spark):
    df = spark.range(100_000).selectExpr("CAST(id AS DOUBLE) AS a")
    assert exact_quantiles(df, {"a": [0.5]}).first()["value"] == 49_999.5
    values = ordering._by_interval(df.selectExpr("'a' AS metric", "a AS value"), [ordering._Interval("a", 0.0, 5.0, 6, 0, [1])])
    assert "Exchange" not in values._jdf.queryExecution().executedPlan().toString()
