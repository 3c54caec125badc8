"""Exact top-k in many small blocks and lanes against brute force, and what the bounds leave out."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from siteledger.llm import topk


def clustered(seed: int, n: int, dim: int, spread: float) -> np.ndarray:
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(12, dim))
    return centres[rng.integers(0, 12, n)] + rng.normal(size=(n, dim)) * spread


def expected(rows: list[tuple], k: int) -> dict:
    x = np.floor(256 * np.array([r[1] for r in rows], np.float32).astype(float)).astype(np.int64)
    ids = np.array([r[0] for r in rows])
    out = {}
    for j in np.flatnonzero(ids % 7 == 0).tolist():
        s = x @ x[j]
        order = [i for i in np.lexsort((ids, -s)).tolist() if ids[i] != ids[j]][:k]
        out |= {(int(ids[j]), place + 1): (int(ids[i]), int(s[i])) for place, i in enumerate(order)}
    return out


@pytest.mark.parametrize("spread", [0.05, 3.0])
def test_many_blocks_and_lanes(spark, monkeypatch, spread):
    for name, value in (("BLOCK", 8), ("LANE_ROWS", 20), ("QUERY_ROWS", 9), ("STEP", 4), ("TOGETHER", 1)):
        monkeypatch.setattr(topk, name, value)
    x = clustered(1, 400, 6, spread)
    x[100:220] = x[100]  # one vector is a third of all
    rows = [(i, v.tolist(), 1, 2) for i, v in enumerate(x)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>, lane int, uid int").repartition(6)
    got = {(r.query_id, r.rank): (r.vec_id, r.score) for r in topk.top_k(table, F.col("vec_id") % 7 == 0, k=6).collect()}
    assert got == expected(rows, 6)


def test_few_candidates_and_several_lengths(spark):
    rows = [(0, [1.0, 2.0], 1), (1, [3.0, 1.0], 1), (7, [1.0], 1), (14, [0.5] * 3, 1), (15, [1e5] * 3, 1)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, own int")
    got = {(r.query_id, r.rank): (r.vec_id, r.score) for r in topk.top_k(table, F.col("vec_id") % 7 == 0).collect()}
    assert got == {(0, 1): (1, 5 * 256 * 256), (14, 1): (15, 3 * 128 * 25_600_000)}


def test_bounds_leave_out_clustered_blocks():
    x = np.floor(256 * clustered(2, 3000, 16, 0.05))
    pivots = topk.chosen_pivots(x[:400], 48)
    far = topk.distances(x, pivots)
    home = far.argmin(1)
    blocks = []
    for h in np.unique(home).tolist():
        rows = np.flatnonzero(home == h)
        beside = np.sort(topk.distances(pivots[h][None], pivots)[0].argsort(kind="stable")[: topk.NEAR])
        f = far[rows].astype(np.float32)
        blocks.append(
            {"n": len(rows), "norm": float((x[rows] ** 2).sum(1).max()), "ids": rows, "beside": beside, "x": x[rows],
             "near": f[:, beside], "low": f.min(0), "high": f.max(0)}
        )
    q = x[:40]
    best = topk.Best(np.arange(40), np.full(40, -np.inf), 5)
    scored = topk.search(best, q, far[:40].astype(np.float32), blocks)
    assert scored < 0.4 * 40 * 3000
    for j in range(40):
        s = (x @ q[j]).astype(np.int64)
        order = [i for i in np.lexsort((np.arange(3000), -s)).tolist() if i != j][:5]
        mine = best.q == j
        assert list(zip(best.id[mine], best.score[mine], strict=True)) == [(i, s[i]) for i in order]


def test_scores_beyond_exact_floats():
    x = np.array([[2.0**40, 1.0], [2.0**20, 3.0]])
    assert topk.products(x, x[1:]).tolist() == [[2**60 + 3], [2**40 + 9]]
