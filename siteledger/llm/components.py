"""Connected components of a graph of any size.

Union-find runs inside each task and leaves a forest of the links the task holds; what
remains is joined over tasks by alternating two star operations: every node hangs its larger,
then its smaller neighbours on the smallest one near it, until only stars are left. Neighbours
are never collected: each step is a minimum per node and a join.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siteledger.llm.storage import staged


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        top = x
        while (up := parent.get(top, top)) != top:
            top = up
        while (up := parent.get(x, x)) != top:
            parent[x] = top
            x = up
        return top

    def out() -> pa.RecordBatch:
        pairs = [(x, r) for x in parent if (r := root(x)) != x]
        u, v = np.array(pairs, np.int64).reshape(-1, 2).T
        return pa.RecordBatch.from_pydict({"u": u, "v": v})

    for batch in batches:
        for u, v in zip(batch.column("u").to_pylist(), batch.column("v").to_pylist(), strict=True):
            a, b = root(u), root(v)
            if a != b:
                parent[max(a, b)] = min(a, b)
            parent.setdefault(min(a, b), min(a, b))
        if len(parent) > 500_000:  # bounded memory: links given so far stay valid
            yield out()
            parent.clear()
    yield out()


def _toward_smallest(links: DataFrame, both: bool) -> DataFrame:
    """Hangs neighbours on the smallest: all larger ones (both), or all smaller ones."""
    sides = links
    if both:
        sides = links.union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = sides.groupBy("u").agg(F.min("v").alias("m"))
    joined = sides.join(least, "u")
    if both:
        hung = joined.filter("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v"))
    else:
        hung = joined.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        hung = hung.union(least.select("u", F.col("m").alias("v")))
    return hung.filter("u <> v").select(
        F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")
    ).distinct()


def _are_stars(links: DataFrame) -> bool:
    """Whether every larger node hangs on one smaller node, which itself hangs on none."""
    ends = links.select(F.col("u").alias("node"), F.lit(1).alias("up"))
    ends = ends.union(links.select("v", F.lit(0)))
    ends = ends.groupBy("node").agg(F.sum("up").alias("ups"), F.min("up").alias("least"))
    return ends.filter("ups > 1 OR (ups = 1 AND least = 0)").agg(F.count("*")).first()[0] == 0


def components(links: DataFrame) -> DataFrame:
    """node, root: the smallest node reachable, for every node of links (u, v).

    Links of a node to itself, repeated links and links with a null say nothing.
    """
    links = links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    links = links.filter("u IS NOT NULL AND u > v").filter("v IS NOT NULL")
    links = staged(links.mapInArrow(_forest, "u long, v long").distinct(), "star")
    while not _are_stars(links):
        large = staged(_toward_smallest(links, both=True), "star")
        links = staged(_toward_smallest(large, both=False), "star")
    nodes = links.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return nodes.union(links.select("v", "v").distinct())
