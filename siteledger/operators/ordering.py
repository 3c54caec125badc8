"""Exact running totals, ranks and quantiles over any number of rows.

A window without a partition key would put every row in one task, and a window per
key would do the same to a hot key. For totals and ranks rows are range-partitioned by their order,
each range is summed on its own, and only one small row per range and key is
combined into offsets. Quantiles need no order of all rows: counts narrow down the few values that matter.
"""

from __future__ import annotations

import math
import tempfile
import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siteledger.functions.sql import join_alike


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder the cluster names; a temporary one only in local mode."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    folder = tempfile.mkdtemp(prefix="siteledger-")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def scratch_path(spark: SparkSession, label: str) -> str:
    return f"{checkpoint_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"


#: With it, Spark deletes what a job has shuffled when the job ends, not when the driver happens to collect garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def freeze(df: DataFrame) -> DataFrame:
    """Write `df` as Parquet to the shared folder and read it back.

    Later reads see the same rows even if an executor is lost, the lineage is cut,
    and columns can still be pruned. What was shuffled to make `df` is deleted.
    """
    spark = df.sparkSession
    path = scratch_path(spark, "frozen")
    was = spark.conf.get(CLEANUP)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEANUP, was)
    return spark.read.schema(df.schema).parquet(path)


def running_total(
    df: DataFrame, keys: list[str], order: list[Column], value: Column, name: str
) -> DataFrame:
    """Adds the running total of `value` in `order` within `keys` as `name`.

    `order` must be total within `keys`. Keys must not be NULL.
    """
    ranges = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    spread = [F.col(k).asc() for k in keys] + order
    ranged = freeze(
        df.withColumn("_value", value)
        .repartitionByRange(ranges, *spread)
        .withColumn("_range", F.spark_partition_id())
        .withColumn("_all", F.lit(0))
    )
    group = keys or ["_all"]
    before = W.partitionBy(*group).orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    offsets = (
        ranged.groupBy(*group, "_range")
        .agg(F.sum("_value").alias("_sum"))
        .withColumn("_offset", F.coalesce(F.sum("_sum").over(before), F.lit(0)))
        .drop("_sum")
    )
    within = (
        W.partitionBy(*group, "_range")
        .orderBy(*order)
        .rowsBetween(W.unboundedPreceding, W.currentRow)
    )
    local = ranged.withColumn("_local", F.sum("_value").over(within))
    # A row per range, or per range and key: the latter grow with the keys.
    joined = join_alike(local, offsets, [*keys, "_range"], "inner") if keys else local.join(offsets, [*group, "_range"])
    return (
        joined.withColumn(name, F.col("_offset") + F.col("_local"))
        .drop("_value", "_range", "_all", "_offset", "_local")
    )


def global_rank(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """Numbers all rows 1..n in `order`, without gaps or repeats."""
    return running_total(df, [], order, F.lit(1).cast("bigint"), name)


#: Parts that an interval of values is cut into, and values of one interval that are fetched.
PARTS, FEW = 1024, 1000


@dataclass
class _Interval:
    """Values from low to high of a metric: `n` of them, after `before` smaller ones; ranks still looked for."""

    metric: str
    low: float
    high: float
    n: int
    before: int
    ranks: list[int]

    def holds(self) -> str:
        # repr gives the shortest text that is read back as the same double.
        return f"metric = '{self.metric}' AND value BETWEEN {self.low!r}D AND {self.high!r}D"

    def part(self) -> str:
        """Never falls as the value grows. Halves where the width itself would be infinite."""
        scale = " * 0.5D" if math.isinf(self.high - self.low) else ""
        low, high = f"{self.low!r}D{scale}", f"{self.high!r}D{scale}"
        return f"CAST(least({PARTS - 1}, floor((value{scale} - {low}) / ({high} - {low}) * {PARTS})) AS INT)"


def _by_interval(values: DataFrame, some: list[_Interval]) -> DataFrame:
    whens = " ".join(f"WHEN {x.holds()} THEN {i}" for i, x in enumerate(some))
    return values.withColumn("i", F.expr(f"CASE {whens} END")).filter("i IS NOT NULL")


def exact_quantiles(df: DataFrame, wanted: dict[str, list[float]]) -> DataFrame:
    """Linearly interpolated quantiles as rows (metric, q, value); NULL and NaN are ignored.

    Nothing is sorted or shuffled by value. The values between the least and the largest are counted in PARTS equal
    parts, each task on its own; parts that hold a wanted rank are cut again, from their own least to their own largest
    value, until one value or at most FEW are left. A pass adds up at most PARTS counts per interval, and there are
    at most two intervals per wanted quantile. Usually two or three passes do; each can only shrink an interval.
    """
    spark = df.sparkSession
    narrow = freeze(df.select(*(F.nanvl(F.col(f"`{c}`").cast("double"), F.lit(None)).alias(c) for c in wanted)))
    pairs = F.explode(F.array(*(F.struct(F.lit(c).alias("metric"), F.col(f"`{c}`").alias("value")) for c in wanted)))
    values = narrow.select(pairs.alias("p")).select("p.*").filter("value IS NOT NULL")
    finite = "abs(value) < double('infinity')"
    ends = values.groupBy("metric").agg(
        F.expr(f"min(IF({finite}, value, NULL)) AS low"), F.expr(f"max(IF({finite}, value, NULL)) AS high"),
        F.expr("count_if(value = -double('infinity')) AS under"), F.expr(f"count_if({finite}) AS n"), F.count("*").alias("total"),
    ).collect()
    found: dict[tuple[str, int], float] = {}
    open_: list[_Interval] = []
    totals = {r["metric"]: r["total"] for r in ends}
    for r in ends:
        ranks = {int(f(q * (r["total"] - 1))) for q in wanted[r["metric"]] for f in (math.floor, math.ceil)}
        for k in ranks:
            found[r["metric"], k] = -math.inf if k < r["under"] else math.inf
        inside = sorted(k for k in ranks if r["under"] <= k < r["under"] + r["n"])
        if inside:
            open_.append(_Interval(r["metric"], r["low"], r["high"], r["n"], r["under"], inside))
    while open_:
        few = [x for x in open_ if x.low == x.high or x.n <= FEW]
        open_ = [x for x in open_ if x not in few]
        listed = [x for x in few if x.low < x.high]
        got: dict[int, list[float]] = {i: [] for i in range(len(listed))}
        if listed:
            for r in _by_interval(values, listed).select("i", "value").collect():
                got[r["i"]].append(r["value"])
        for i, x in enumerate(listed):
            seen = sorted(got[i])
            found |= {(x.metric, k): seen[k - x.before] for k in x.ranks}
        found |= {(x.metric, k): x.low for x in few if x.low == x.high for k in x.ranks}
        if not open_:
            break
        parts = " ".join(f"WHEN {i} THEN {x.part()}" for i, x in enumerate(open_))
        counted = _by_interval(values, open_).groupBy("i", F.expr(f"CASE i {parts} END").alias("part")).agg(
            F.count("*").alias("n"), F.min("value").alias("low"), F.max("value").alias("high")
        )
        cut = sorted(counted.collect(), key=lambda r: (r["i"], r["part"]))
        smaller, before = [], {i: x.before for i, x in enumerate(open_)}
        for r in cut:
            x, start = open_[r["i"]], before[r["i"]]
            before[r["i"]] += r["n"]
            if inside := [k for k in x.ranks if start <= k < start + r["n"]]:
                smaller.append(_Interval(x.metric, r["low"], r["high"], r["n"], start, inside))
        open_ = smaller
    rows = []
    for metric, qs in wanted.items():
        for q in qs if metric in totals else ():
            place = q * (totals[metric] - 1)
            low, high = found[metric, math.floor(place)], found[metric, math.ceil(place)]
            # Equal neighbours give their own value, also infinite ones.
            rows.append((metric, float(q), low if low == high else low + (high - low) * (place - math.floor(place))))
    return spark.createDataFrame(rows, "metric string, q double, value double")
