"""Exact top-k by inner product with pivot-table elimination.

Vectors are turned into whole numbers, floor(scale * x). Pivots, far apart in a bounded sample, number about the
square root of the rows (MOST_PIVOTS at most). Each row is filed under its nearest pivot, and rows of one pivot
are packed in order of their distance to it, so a block is a narrow shell. A block carries the least and largest
distance of its rows to every pivot, and the rows' own distances to the NEAR pivots closest to its home.

By the triangle inequality the largest difference between a query's and a row's (or a block's) distances is the best
lower bound on the distance of the two, and with the norms it bounds their inner product from above. A task holds some
query and some candidate blocks. It takes candidate blocks in the order of their bounds, leaves out queries whose k-th
score is above a block's bound, then rows whose own bound no query of the block reaches; what is left is scored
by one exact matrix product. Equal bounds are still scored, since ties go to the smaller id.

First each query meets only the lane of its home pivot; its k-th score there is what all other lanes start to prune
with. Lanes and query parts are as many as the rows need (LANE_ROWS, QUERY_ROWS each) and at least as many as there are
cores, so a task's memory does not grow with the table and the number of tasks does. A stated share of all rows as
queries makes the number of pairs grow with the square of the table; bounds only lower its factor, much on
clustered vectors and little on random ones.

Scores are exact: products go through 64-bit floats while all sums stay below 2^53, and
through Python integers beyond; a score that does not fit 64 bits is an error.

Defined results: vectors that are null, empty, or hold a null or non-finite component, and rows with a null
id, take no part. Vectors of different lengths are never compared. Of repeated ids each
row is a candidate of its own, but a query never meets rows with its own id; a repeated query id is asked once per
row, and its rows are ranked together. With fewer than k candidates all are given. Extra columns take no part. An
empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siteledger.llm.storage import staged

LEAST_PIVOTS, MOST_PIVOTS, NEAR = 16, 512, 8
#: Rows of the sample that pivots are drawn from, per pivot.
DRAWN = 8
BLOCK, LANE_ROWS, QUERY_ROWS, STEP = 1024, 131_072, 32_768, 512
#: Blocks of one pivot that stay in one lane.
TOGETHER = 8


def _usable(vectors: DataFrame, id_col: str, vector_col: str, scale: int) -> DataFrame:
    whole = F.transform(F.col(f"`{vector_col}`"), lambda x: F.floor(x.cast("double") * scale).cast("double"))
    fine = F.forall(
        F.col(f"`{vector_col}`"),
        lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < F.lit(float("inf"))),
    )
    return vectors.filter(F.col(f"`{id_col}`").isNotNull() & (F.size(f"`{vector_col}`") > 0) & fine).select(
        F.col(f"`{id_col}`").cast("long").alias("id"), whole.alias("v"), F.size(f"`{vector_col}`").alias("dim")
    )


def chosen_pivots(x: np.ndarray, n: int) -> np.ndarray:
    """n rows of x far apart: each next one is farthest from those before."""
    near, picked = np.full(len(x), np.inf), []
    at = 0
    for _ in range(min(n, len(x))):
        picked.append(at)
        near = np.minimum(near, ((x - x[at]) ** 2).sum(1))
        at = int(near.argmax())
        if near[at] == 0:
            break
    return x[picked]


def distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Distances of rows to pivots (rows, pivots)."""
    square = (x * x).sum(1)[:, None] + (pivots * pivots).sum(1) - 2 * (x @ pivots.T)
    return np.sqrt(np.maximum(square, 0))


def slack(norm: float, far: float) -> float:
    """What rounding can take from a bound: sums of squares, roots, and distances kept in 32 bits."""
    return 1 + 1e-9 * norm + 1e-6 * far * far


def _by_dim(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Ids and vectors of a batch, one length after the other."""
    dims, ids, values = np.array(batch.column("dim")), np.array(batch.column("id")), batch.column("v")
    for dim in np.unique(dims).tolist():
        rows = np.flatnonzero(dims == dim)
        x = np.asarray(values.take(pa.array(rows)).flatten(), np.float64).reshape(-1, dim)
        yield dim, ids[rows], x


def _filed(pivots: dict[int, np.ndarray]):
    """Rows with their nearest pivot and the distance to it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for dim, ids, x in _by_dim(batch):
                far = distances(x, pivots[dim])
                home = far.argmin(1)
                yield pa.RecordBatch.from_pydict(
                    {
                        "dim": np.full(len(ids), dim, np.int32),
                        "home": home.astype(np.int32),
                        "far": far[np.arange(len(ids)), home],
                        "id": ids.astype(np.int64),
                        "x": pa.array([r.tobytes() for r in x.astype("<f8")], pa.binary()),
                    }
                )

    return run


_BLOCK = "dim int, home int, part int, n int, ids binary, x binary, low binary, high binary, near binary, norm double"


def _blocks(pivots: dict[int, np.ndarray]):
    """Runs of rows of one home, which come in the order of their distance to it, as blocks."""

    def block(dim: int, home: int, part: int, ids: list, rows: list) -> dict:
        x = np.frombuffer(b"".join(rows), "<f8").reshape(-1, dim)
        far = distances(x, pivots[dim]).astype("<f4")
        beside = distances(pivots[dim][home][None], pivots[dim])[0].argsort(kind="stable")[:NEAR]
        near = np.sort(beside)
        return {
            "dim": dim, "home": home, "part": part, "n": len(ids), "ids": np.array(ids, "<i8").tobytes(), "x": x.tobytes(),
            "low": far.min(0).tobytes(), "high": far.max(0).tobytes(), "near": np.ascontiguousarray(far[:, near]).tobytes(),
            "norm": float((x * x).sum(1).max()),
        }

    kinds = pa.schema(
        [("dim", pa.int32()), ("home", pa.int32()), ("part", pa.int32()), ("n", pa.int32())]
        + [(c, pa.binary()) for c in ("ids", "x", "low", "high", "near")] + [("norm", pa.float64())]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, part, ids, rows = None, 0, [], []
        for batch in batches:
            columns = (batch.column(c).to_pylist() for c in ("dim", "home", "id", "x"))
            for dim, home, i, row in zip(*columns, strict=True):
                if at != (dim, home) or len(ids) == BLOCK:
                    if ids:
                        yield pa.RecordBatch.from_pylist([block(*at, part, ids, rows)], kinds)
                    part = part + 1 if at == (dim, home) else 0
                    at, ids, rows = (dim, home), [], []
                ids.append(i)
                rows.append(row)
        if ids:
            yield pa.RecordBatch.from_pylist([block(*at, part, ids, rows)], kinds)

    return run


def products(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Exact inner products of whole-number rows of x with rows of q."""
    if x.shape[1] * np.abs(x).max(initial=0) * np.abs(q).max(initial=0) < 2**53:
        return (x @ q.T).astype(np.int64)
    exact = [[sum(int(a) * int(b) for a, b in zip(one, other, strict=True)) for other in q.tolist()] for one in x.tolist()]
    return np.array(exact, np.int64).reshape(len(x), len(q))


def bounds(q_norm: np.ndarray, q_far: np.ndarray, low: np.ndarray, high: np.ndarray, norm: float) -> np.ndarray:
    """Upper bounds of the inner products of queries with any row of a block."""
    gap = np.maximum(low - q_far, q_far - high).max(1)
    gap = np.maximum(gap, 0).astype(float)
    return (q_norm + norm - gap * gap) / 2 + slack(q_norm.max(initial=0) + norm, max(q_far.max(initial=0), high.max(initial=0)))


class Best:
    """The k best rows (score, id) of each of some queries so far; ties go to the smaller id."""

    def __init__(self, q_ids: np.ndarray, least: np.ndarray, k: int):
        self.q_ids, self.k, self.least = q_ids, k, least.astype(float)
        self.q = self.score = self.id = np.zeros(0, np.int64)

    def add(self, which: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> None:
        """scores: (rows, len(which)) of rows `ids` with the queries `which`."""
        good = (scores >= self.least[which]) & (ids[:, None] != self.q_ids[which])
        if good.sum() > 8 * self.k * len(which) and len(ids) > self.k:
            least = np.partition(np.where(good, scores, np.iinfo(np.int64).min), -self.k, axis=0)[-self.k]
            good &= scores >= least
        row, column = np.nonzero(good)
        if not len(row):
            return
        q = np.r_[self.q, which[column]]
        score, found = np.r_[self.score, scores[row, column]], np.r_[self.id, ids[row]]
        order = np.lexsort((found, -score, q))
        q, score, found = q[order], score[order], found[order]
        place = np.arange(len(q)) - np.searchsorted(q, q)
        keep = place < self.k
        self.q, self.score, self.id = q[keep], score[keep], found[keep]
        full = place == self.k - 1
        self.least[q[full]] = np.maximum(self.least[q[full]], score[full])


def search(best: Best, q: np.ndarray, q_far: np.ndarray, blocks: list[dict]) -> int:
    """Scores what the bounds leave of `blocks` for the queries of `best`; the number of pairs scored."""
    q_norm, scored = (q * q).sum(1), 0
    upper = np.array([bounds(q_norm, q_far, b["low"], b["high"], b["norm"]) for b in blocks]).reshape(len(blocks), len(q))
    for b in np.argsort(-upper.max(1, initial=-np.inf), kind="stable"):
        block = blocks[b]
        which = np.flatnonzero(upper[b] >= best.least)
        if not len(which):
            continue
        # Distances to the pivots beside the block's home bound each row on its own.
        gap = np.zeros((block["n"], len(which)), np.float32)
        for column, pivot in zip(block["near"].T, block["beside"], strict=True):
            np.maximum(gap, np.abs(column[:, None] - q_far[which, pivot]), out=gap)
        room = q_norm[which] + block["norm"] - 2 * (best.least[which] - slack(q_norm.max() + block["norm"], float(q_far.max())))
        rows = np.flatnonzero((gap * gap <= np.maximum(room, 0) * (1 + 1e-6)).any(1))
        if len(rows):
            scored += len(rows) * len(which)
            best.add(which, products(block["x"][rows], q[which]), block["ids"][rows])
    return scored


def _opened(batches: pa.Table, pivots: np.ndarray, dim: int) -> list[dict]:
    out = []
    for r in batches.to_pylist():
        beside = np.sort(distances(pivots[r["home"]][None], pivots)[0].argsort(kind="stable")[:NEAR])
        out.append(
            {
                "n": r["n"], "norm": r["norm"], "ids": np.frombuffer(r["ids"], "<i8"), "beside": beside,
                "x": np.frombuffer(r["x"], "<f8").reshape(-1, dim), "near": np.frombuffer(r["near"], "<f4").reshape(r["n"], -1),
                "low": np.frombuffer(r["low"], "<f4"), "high": np.frombuffer(r["high"], "<f4"),
            }
        )
    return out


_FOUND = pa.schema([("uid", pa.int64()), ("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])


def _searched(pivots: dict[int, np.ndarray], k: int):
    """Queries of one part against the blocks of one lane."""

    def run(queries: pa.Table, blocks: pa.Table) -> pa.Table:
        out = [_FOUND.empty_table()]
        dim = queries.column("dim")[0].as_py() if queries.num_rows else 0
        opened = _opened(blocks, pivots[dim], dim) if queries.num_rows and blocks.num_rows else []
        for some in (queries.slice(a, STEP) for a in range(0, queries.num_rows if opened else 0, STEP)):
            q = np.frombuffer(b"".join(some.column("x").to_pylist()), "<f8").reshape(-1, dim)
            least = np.array([-np.inf if v is None else v for v in some.column("least").to_pylist()])
            best = Best(np.array(some.column("id")), least, k)
            search(best, q, distances(q, pivots[dim]).astype(np.float32), opened)
            uid = np.array(some.column("uid"))
            out.append(pa.table([uid[best.q], best.q_ids[best.q], best.id, best.score], schema=_FOUND))
        return pa.concat_tables(out)

    return run


def _pivots(every: DataFrame) -> tuple[dict[int, np.ndarray], dict[int, int]]:
    """Pivots by vector length, from a bounded sample, and the rows of each length."""
    rows = {r["dim"]: r["n"] for r in every.groupBy("dim").agg(F.count("*").alias("n")).collect()}
    pivots = {}
    for dim, n in rows.items():
        number = int(np.clip(np.sqrt(n), LEAST_PIVOTS, MOST_PIVOTS))
        drawn = every.filter(F.col("dim") == dim).select("v").orderBy(F.xxhash64("v")).limit(DRAWN * number).collect()
        pivots[dim] = chosen_pivots(np.array([r["v"] for r in drawn], np.float64), number)
    return pivots, rows


def top_k(
    vectors: DataFrame, queries: Column, k: int = 5, scale: int = 256,
    id_col: str = "vec_id", vector_col: str = "embedding",
) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k largest of each row where `queries` holds."""
    spark = vectors.sparkSession
    every = staged(_usable(vectors, id_col, vector_col, scale), "topk-vectors")
    asked = _usable(vectors.filter(queries), id_col, vector_col, scale)
    pivots, rows = _pivots(every)
    kind = "dim int, home int, far double, id long, x binary"
    filed = every.mapInArrow(_filed(pivots), kind)
    order = ("dim", "home", "far", "id")
    blocks = filed.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_blocks(pivots), _BLOCK)
    lanes = max(-(-sum(rows.values()) // LANE_ROWS), 2 * spark.sparkContext.defaultParallelism)
    # The rows of one pivot may be a third of all: they are dealt out by range and by place in it.
    lane = F.xxhash64("dim", "home", F.spark_partition_id(), F.expr(f"part DIV {TOGETHER}"))
    blocks = staged(blocks.withColumn("lane", F.pmod(lane, F.lit(lanes)).cast("int")), "topk-blocks")
    asked = staged(asked.mapInArrow(_filed(pivots), kind).withColumn("uid", F.monotonically_increasing_id()), "topk-queries")
    parts = max(1, -(-asked.count() // QUERY_ROWS))
    asked = asked.withColumn("q_part", F.pmod(F.xxhash64("uid"), F.lit(parts)).cast("int"))
    asked = asked.join(blocks.groupBy("dim", "home").agg(F.min("lane").alias("own")), ["dim", "home"])
    schema = "uid long, query_id long, vec_id long, score long"

    def met(some: DataFrame) -> DataFrame:
        """some: queries with the `lane` they go to. Every lane and part is one bounded group."""
        keys = ("dim", "lane", "q_part")
        each = blocks.withColumn("q_part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
        left, right = some.groupBy(*keys), each.groupBy(*keys)
        return staged(left.cogroup(right).applyInArrow(_searched(pivots, k), schema), "topk-found")

    home = met(asked.withColumn("lane", F.col("own")).withColumn("least", F.lit(None).cast("double")))
    least = home.groupBy("uid").agg(F.expr(f"IF(count(*) >= {k}, min(score), NULL)").cast("double").alias("least"))
    others = asked.join(least, "uid", "left").withColumn("lane", F.explode(F.sequence(F.lit(0), F.lit(lanes - 1))))
    found = home.unionByName(met(others.filter("lane <> own")))
    place = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", place).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
