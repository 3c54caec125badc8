"""Streaming twins of the labor stages, and a scheduled refresh."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siteledger.functions.numbers import labor_cost_decimal
from siteledger.operators.cleaning import first_by_date
from siteledger.streaming.store import BUCKETS, KeyedTable


def labor_stream(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """New labor files as they arrive; the event time is the work date at 0:00 UTC."""
    return (
        spark.readStream.schema(schema)
        .parquet(path)
        .withColumn("event_time", F.timestamp_seconds(F.unix_date("date") * 86400))
    )


def stream_labor_dedup(labor: DataFrame, delay: str = "30 days") -> DataFrame:
    """First row per log id; ids are remembered for `delay` of event time."""
    return labor.withWatermark("event_time", delay).dropDuplicatesWithinWatermark(["log_id"])


def stream_weekly_cost(labor: DataFrame, delay: str = "7 days") -> DataFrame:
    """Labor cost per project and Monday week; rows later than `delay` are dropped."""
    cost = labor_cost_decimal(
        *[F.col(c) for c in ("hours_st", "hours_ot", "hourly_rate", "burden_multiplier")]
    )
    # The epoch was a Thursday: four days later is a Monday.
    week = F.window("event_time", "7 days", startTime="4 days")
    return (
        labor.withWatermark("event_time", delay)
        .groupBy("project_id", week)
        .agg(F.sum(cost).cast("double").alias("total_labor_cost"))
        .select(
            "project_id",
            F.date_from_unix_date(
                F.floor(F.unix_seconds("window.start") / 86400).cast("int")
            ).alias("week_start"),
            "total_labor_cost",
        )
    )


def run_available(stream: DataFrame, out: str, state: str) -> None:
    """Process what is there, append it to `out`, and stop."""
    (
        stream.writeStream.format("parquet")
        .outputMode("append")
        .option("checkpointLocation", state)
        .trigger(availableNow=True)
        .start(out)
        .awaitTermination()
    )


def merge_stream(updates: DataFrame, table: KeyedTable, state: str) -> None:
    """Merges what is there into `table`, batch by batch, and stops."""

    def merge(batch: DataFrame, batch_id: int) -> None:
        if "batch_id" in table.schema.names:
            batch = batch.withColumn("batch_id", F.lit(batch_id).cast("long"))
        table.merge(batch, batch_id)

    (
        updates.writeStream.foreachBatch(merge)
        .option("checkpointLocation", state)
        .trigger(availableNow=True)
        .start()
        .awaitTermination()
    )


def first_rows(spark: SparkSession, root: str, schema: T.StructType, buckets: int = BUCKETS) -> KeyedTable:
    """A table that keeps of every log id the row that batch duplicate removal keeps: the earliest by date.

    Unlike `stream_labor_dedup`, which gives out the first row to arrive and forgets ids after its delay, the row
    may be replaced when an earlier one comes late.
    """
    return KeyedTable(spark, root, schema, ["log_id"], first_by_date(schema.names), buckets)


def refreshed(spark: SparkSession, root: str, schema: T.StructType, keys: list[str], buckets: int = BUCKETS) -> KeyedTable:
    """A table of the newest version of every key; within a batch the least row in the order of all columns."""
    order = [F.col("batch_id").desc(), *(F.col(f"`{c}`").asc_nulls_last() for c in schema.names)]
    whole = T.StructType([*schema.fields, T.StructField("batch_id", T.LongType())])
    return KeyedTable(spark, root, whole, keys, order, buckets)
