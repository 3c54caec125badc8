"""Exact duplicates by content sort.

Rows are range-partitioned by their normalised text with sampled splitters and sorted on disk where memory is
short, so that equal texts become neighbours. Each row is compared with the one before it over the whole text; where
they differ a run of equal texts begins. A run's size and the row that stays are read off it in place.

The splitters' key is the text's first LEAD characters and a 64-bit hash of all of it, so what travels to the driver stays
small for texts of any length; rows that agree in both are sorted by the text itself. A text that a bounded sample
shows to be frequent (HOT times among SAMPLE rows) is cut into PARTS runs by a hash of the id; the runs of the few
such texts, and of no others, are added up and compared once more.

Defined results: a null text is empty, and empty texts are equal to each other. Rows with a
null id come last in their group and stay only if no other row has an id. Of repeated rows
(same text and id) one stays. Very long texts are compared and hashed as a whole. Extra columns are kept by
`deduplicate`, whatever they are called. An empty table gives an empty result.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siteledger.llm.storage import staged

#: Characters of the text that lead the sort key.
LEAD = 64
#: Rows looked at for frequent texts, how often a frequent one is among them, and the runs it is cut into.
SAMPLE, HOT, PARTS = 20_000, 20, 512


def normalised(text: Column) -> Column:
    """Lower-cases A-Z only; null becomes empty."""
    return F.translate(
        F.coalesce(text, F.lit("")), string.ascii_uppercase, string.ascii_lowercase
    )


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The rows of `docs` as `row`, with id, normalised text and the sort key."""
    rows = docs.select(
        F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"),
        F.col(f"`{id_col}`").alias("id"),
        normalised(F.col(f"`{text_col}`")).alias("norm"),
    )
    return rows.select("*", F.left("norm", F.lit(LEAD)).alias("lead"), F.xxhash64("norm").alias("h"))


def _frequent(rows: DataFrame) -> list[int]:
    """Hashes of the texts that are frequent in a sample; at most SAMPLE / HOT."""
    drawn = rows.select("h", F.xxhash64(F.lit("sample"), "id").alias("place")).orderBy("place", "h").limit(SAMPLE)
    counts = drawn.groupBy("h").agg(F.count("*").alias("n")).filter(F.col("n") >= HOT)
    return sorted(r["h"] for r in counts.collect())


def _first(keep: str) -> Column:
    return F.col("id").desc_nulls_last() if keep == "largest" else F.col("id").asc_nulls_last()


def _runs(rows: DataFrame, hot: list[int], keep: str) -> DataFrame:
    """Each row of `_keyed` with its run: `place` in it, its `best` id and `size`; `hot` if other runs may be equal.

    The windows ask for rows of a key together, as the ranges on that key already are: nothing is shuffled again.
    """
    rows = rows.withColumn("hot", F.col("h").isin(hot) if hot else F.lit(False))
    part = F.when(F.col("hot"), F.pmod(F.xxhash64("id"), F.lit(PARTS))).otherwise(0)
    rows = rows.withColumn("part", part.cast("int")).withColumn("sha", F.unhex(F.sha2("norm", 256)))
    # A constant part would be dropped from the windows but not from the ranges, and all be shuffled twice.
    key = ("lead", "h", "part") if hot else ("lead", "h")
    beside = W.partitionBy(*key).orderBy("norm", _first(keep))
    head = ~F.col("norm").eqNullSafe(F.lag("norm").over(beside))
    sorted_ = rows.repartitionByRange(*key).withColumn("head", head.cast("int"))
    run = F.sum("head").over(beside.rowsBetween(W.unboundedPreceding, W.currentRow))
    sorted_ = sorted_.withColumn("run", run).drop("norm", "head")
    inside = W.partitionBy(*key, "run")
    return sorted_.select(
        "row", "id", "h", "sha", "hot",
        F.row_number().over(inside.orderBy(_first(keep))).alias("place"),
        F.first("id").over(inside.orderBy(_first(keep))).alias("best"),
        F.count("*").over(inside).alias("size"),
    )


def _better(keep: str) -> Column:
    return F.max("best") if keep == "largest" else F.min("best")


def groups(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "largest"
) -> DataFrame:
    """One row per row of `docs`: id, keep_id, group_size, kept, text_sha256.

    keep: "largest" or "smallest" id of the equal texts.
    """
    rows = _keyed(docs.select(f"`{id_col}`", f"`{text_col}`"), id_col, text_col)
    hot = _frequent(rows)
    found = _runs(rows, hot, keep).drop("row")
    if hot:
        found = staged(found, "content-runs")
        # One row per run of a frequent text: PARTS of each of at most SAMPLE / HOT texts.
        whole = found.filter("hot AND place = 1").groupBy("h", "sha").agg(
            _better(keep).alias("keep_id"), F.sum("size").alias("group_size"), F.lit(True).alias("cut")
        )
        found = found.join(F.broadcast(whole), ["h", "sha"], "left")
        best = F.when(F.col("cut"), F.col("keep_id")).otherwise(F.col("best"))
        found = found.withColumns({"best": best, "size": F.coalesce("group_size", "size")})
    return found.select(
        F.col("id").alias(id_col),
        F.col("best").alias("keep_id"),
        F.col("size").alias("group_size"),
        ((F.col("place") == 1) & F.col("id").eqNullSafe(F.col("best"))).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
    )


def deduplicate(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "largest"
) -> DataFrame:
    """The rows of `docs` that stay, with their own columns."""
    rows = _keyed(docs, id_col, text_col)
    hot = _frequent(rows)
    heads = _runs(rows, hot, keep).filter("place = 1")
    if hot:
        # What stays of each frequent text, from its rows alone.
        frequent = rows.filter(F.col("h").isin(hot)).select("id", "h", F.unhex(F.sha2("norm", 256)).alias("sha"))
        whole = frequent.withColumnRenamed("id", "best").groupBy("h", "sha").agg(_better(keep).alias("keep_id"))
        heads = heads.join(F.broadcast(whole.withColumn("cut", F.lit(True))), ["h", "sha"], "left")
        # Rows without an id hash alike, so they are in one run.
        heads = heads.filter("cut IS NULL OR id <=> keep_id")
    return heads.select("row.*")
