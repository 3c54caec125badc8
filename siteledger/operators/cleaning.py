"""Cleaning: typed projections, spelling maps, duplicate removal, quality counts."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siteledger.functions.numbers import count_when
from siteledger.functions.sql import day, mapped, number
from siteledger.rules import CATEGORY_MAP, ROLE_MAP, Rules


def normalize_role(name: str = "role") -> str:
    return mapped(name, ROLE_MAP)


def normalize_category(name: str = "material_category") -> str:
    return mapped(name, CATEGORY_MAP)


def first_by_date(columns: list[str]) -> list[Column]:
    """The order of the rows of a log id: by date, then by all other columns."""
    rest = [c for c in columns if c not in ("log_id", "date")]
    return [F.col(c).asc_nulls_last() for c in ["date", *rest]]


def dedup_labor(labor: DataFrame) -> DataFrame:
    """First row per log id by date; all other columns break ties.

    The `row <= 1` filter lets Spark keep one row per log id on each task before
    the shuffle, so a log id repeated a billion times still costs one row a task.
    """
    first = W.partitionBy("log_id").orderBy(*first_by_date(labor.columns))
    return (
        labor.filter("log_id IS NOT NULL")
        .withColumn("_row", F.row_number().over(first))
        .filter("_row <= 1")
        .drop("_row")
    )


def without_last(labor: DataFrame, unread: tuple[str, ...]) -> DataFrame:
    """`labor` without the columns at its end that nobody reads.

    The last columns of `first_by_date` only choose among rows that agree in all others, so `dedup_labor` keeps the
    same values without them. A column before one that is read stays.
    """
    kept = list(labor.columns)
    while kept[-1] in unread:
        kept.pop()
    return labor.select(*kept)


def clean_labor(labor: DataFrame) -> DataFrame:
    numbers = ("hours_st", "hours_ot", "hourly_rate", "burden_multiplier")
    return dedup_labor(labor).filter("project_id IS NOT NULL").selectExpr(
        "project_id", "log_id", f"{day(labor, 'date')} AS date", "employee_id",
        f"{normalize_role()} AS role", "sov_line_id",
        *[f"{number(labor, c)} AS {c}" for c in numbers],
        *[c for c in ("work_area", "cost_code") if c in labor.columns],
    )


def clean_materials(materials: DataFrame) -> DataFrame:
    """Recomputes `total_cost` and keeps the stated one for audit."""
    quantity, unit_cost = number(materials, "quantity"), number(materials, "unit_cost")
    return materials.filter("project_id IS NOT NULL AND delivery_id IS NOT NULL").selectExpr(
        "project_id", "delivery_id", f"{day(materials, 'date')} AS date", "sov_line_id",
        f"{normalize_category()} AS material_category", "item_description",
        f"{quantity} AS quantity", "unit", f"{unit_cost} AS unit_cost",
        f"{quantity} * {unit_cost} AS total_cost",
        f"{number(materials, 'total_cost')} AS total_cost_original",
        "po_number", "vendor", "received_by", "condition_notes",
    )


def materials_export(clean: DataFrame) -> DataFrame:
    return clean.drop("total_cost_original")


def clean_change_orders(orders: DataFrame) -> DataFrame:
    return orders.filter("project_id IS NOT NULL AND co_number IS NOT NULL").selectExpr(
        "project_id", "co_number", f"{day(orders, 'date_submitted')} AS date_submitted",
        "reason_category", "description", f"{number(orders, 'amount')} AS amount", "status",
        "related_rfi", "affected_sov_lines",
        f"{number(orders, 'labor_hours_impact')} AS labor_hours_impact",
        f"{number(orders, 'schedule_impact_days')} AS schedule_impact_days",
        "submitted_by", "approved_by",
    )


def clean_rfis(rfis: DataFrame) -> DataFrame:
    return rfis.filter("project_id IS NOT NULL AND rfi_number IS NOT NULL").selectExpr(
        "project_id", "rfi_number", f"{day(rfis, 'date_submitted')} AS date_submitted",
        "subject", "submitted_by", "assigned_to", "priority", "status",
        f"{day(rfis, 'date_required')} AS date_required",
        f"{day(rfis, 'date_responded')} AS date_responded", "response_summary",
        "cost_impact", "schedule_impact",
    )


def labor_valid_rows(clean: DataFrame) -> DataFrame:
    return clean.dropna(
        subset=[
            "project_id", "sov_line_id", "hours_st", "hours_ot", "hourly_rate",
            "burden_multiplier",
        ]
    )


def material_valid_rows(clean: DataFrame) -> DataFrame:
    return clean.dropna(subset=["project_id", "sov_line_id", "total_cost"])


# ---- quality counts: (dataset, metric, value) rows --------------------------


def _metrics(dataset: str, df: DataFrame, *aggs: Column) -> DataFrame:
    """One-row aggregate turned into metric rows."""
    wide = df.agg(*aggs)
    return wide.unpivot([], wide.columns, "metric", "value").select(
        F.lit(dataset).alias("dataset"), "metric", F.col("value").cast("bigint").alias("value")
    )


def labor_quality(raw: DataFrame) -> DataFrame:
    """All four counts from one grouping by log id.

    The row that `dedup_labor` keeps is the least one, NULLs last, of its id.
    """
    order = ["date", *[c for c in raw.columns if c not in ("log_id", "date")]]
    place = F.struct(*[x for c in order for x in (F.col(c).isNull(), F.col(c))])
    logs = raw.groupBy("log_id").agg(
        F.count(F.lit(1)).alias("n"),
        F.expr(f"count_if(role <> {normalize_role()}) AS roles"),
        F.min_by(F.col("project_id").isNotNull(), place).alias("stays"),
    )
    total = lambda c: F.coalesce(F.sum(c), F.lit(0))
    return _metrics(
        "labor_logs",
        logs,
        total("n").alias("input_rows"),
        (total("n") - F.count("log_id")).alias("duplicates_removed"),
        total("roles").alias("roles_normalized"),
        count_when(F.col("log_id").isNotNull() & F.col("stays")).alias("output_rows"),
    )


def material_quality(raw: DataFrame, rules: Rules) -> DataFrame:
    drift = f"{number(raw, 'quantity')} * {number(raw, 'unit_cost')} - {number(raw, 'total_cost')}"
    kept = F.col("project_id").isNotNull() & F.col("delivery_id").isNotNull()
    return _metrics(
        "material_deliveries",
        raw,
        F.count(F.lit(1)).alias("input_rows"),
        F.expr(
            f"count_if(material_category <> {normalize_category()}) AS categories_normalized"
        ),
        F.expr(f"count_if(abs({drift}) > {rules.cost_discrepancy}) AS costs_recalculated"),
        count_when(kept).alias("output_rows"),
    )


def _in_out(dataset: str, raw: DataFrame, key: str) -> DataFrame:
    kept = F.col("project_id").isNotNull() & F.col(key).isNotNull()
    return _metrics(
        dataset,
        raw,
        F.count(F.lit(1)).alias("input_rows"),
        count_when(kept).alias("output_rows"),
    )


def co_rfi_quality(orders: DataFrame, rfis: DataFrame) -> DataFrame:
    return _in_out("change_orders", orders, "co_number").unionByName(
        _in_out("rfis", rfis, "rfi_number")
    )


def quality_report(tables: Mapping[str, DataFrame], rules: Rules) -> DataFrame:
    return (
        labor_quality(tables["labor_logs"])
        .unionByName(material_quality(tables["material_deliveries"], rules))
        .unionByName(co_rfi_quality(tables["change_orders"], tables["rfis"]))
    )
