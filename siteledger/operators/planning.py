"""Ranks and capacity plans over all actions of the portfolio."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siteledger.operators.ordering import global_rank, running_total
from siteledger.rules import Rules


def _best_first() -> list:
    return [F.col("roi_score").desc_nulls_last(), F.col("action_id").asc()]


def rank_actions(roi: DataFrame) -> DataFrame:
    """Numbers every action 1..n by return on hours."""
    return global_rank(roi, _best_first(), "global_rank")


def week_capacity_plan(roi: DataFrame, rules: Rules) -> DataFrame:
    """Per owner, best actions first until the week's hours are used up.

    An owner may hold most of the portfolio's actions, so hours are summed with the
    distributed running total and no list per owner is cut short.
    """
    whens = " ".join(f"WHEN '{o}' THEN {h}D" for o, h in rules.capacity_hours.items())
    hours = F.col("hours").cast("decimal(18,6)")
    summed = running_total(roi, ["owner"], _best_first(), hours, "hours_used")
    return summed.withColumn("hours_used", F.col("hours_used").cast("double")).withColumn(
        "is_planned", F.expr(f"COALESCE(hours_used <= CASE owner {whens} END, false)")
    )
