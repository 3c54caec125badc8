"""Roll-ups of the cleaned tables to project, cost line and week."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siteledger.functions.sql import LABOR_COST, exact_sum, join_alike, ratio
from siteledger.rules import CO_REJECTED_HEALTH, RFI_CLOSED_HEALTH, TRUE_WORDS, Rules

MONDAY = "CAST(date_trunc('week', {0}) AS DATE)"


def _by(df: DataFrame, keys: list[str], *exprs: str) -> DataFrame:
    return df.groupBy(*keys).agg(*[F.expr(e) for e in exprs])


def _in(words: list[str]) -> str:
    return "(" + ", ".join(f"'{w}'" for w in words) + ")"


def _distinct_counts(names: dict[str, str]) -> list[str]:
    return [f"count(DISTINCT {c}) AS {alias}" for c, alias in names.items()]


CUBE_KEYS = ["project_id", "sov_line_id", "week_start", "employee_id", "role"]


def _total(c: str) -> str:
    return f"SUM(CAST({c} AS DECIMAL(28,6)))"


CUBE_VALUES = {
    "n": "count(1)",
    "st": _total("hours_st"),
    "ot": _total("hours_ot"),
    "rate": _total("hourly_rate"),
    "burden": _total("burden_multiplier"),
    "cost": f"SUM({LABOR_COST})",
    "first_date": "min(date)",
    "last_date": "max(date)",
}


def labor_cube(
    labor: DataFrame, keys: list[str] = CUBE_KEYS, values: list[str] = list(CUBE_VALUES)
) -> DataFrame:
    """Labor by project, line, week, employee and role.

    Every labor summary is a roll-up of this table, so the logs are read and shuffled
    once. Counting several distinct columns makes Spark copy each row once per column;
    here that copy happens on cube rows, and a hot project is spread over its lines,
    weeks, employees and roles before anything is grouped by project.
    """
    weeks = labor.selectExpr("*", f"{MONDAY.format('date')} AS week_start")
    return _by(weeks, keys, *[f"{CUBE_VALUES[v]} AS {v}" for v in values])


def labor_costs(labor: DataFrame) -> DataFrame:
    """The cube with what the cost readers need alone: hours and cost by project, line, week and employee.

    A cube is nearly as long as the logs, so each column that nobody reads is paid for in the shuffle and in the file.
    """
    return labor_cube(labor, CUBE_KEYS[:4], ["st", "ot", "cost"])


def labor_cost(costs: DataFrame, keys: list[str], distinct: dict[str, str] | None = None) -> DataFrame:
    return _by(
        costs, keys,
        *_distinct_counts(distinct or {}),
        "CAST(sum(st) AS DOUBLE) AS total_hours_st",
        "CAST(sum(ot) AS DOUBLE) AS total_hours_ot",
        "CAST(sum(cost) AS DOUBLE) AS total_labor_cost",
    )


def _labor_rollup(cube: DataFrame, keys: list[str], distinct: dict[str, str]) -> DataFrame:
    st, ot = "total_hours_st", "total_hours_ot"
    return _by(
        cube, keys,
        "sum(n) AS num_logs",
        *_distinct_counts(distinct),
        "CAST(sum(st) AS DOUBLE) AS total_hours_st",
        "CAST(sum(ot) AS DOUBLE) AS total_hours_ot",
        f"{ratio('sum(rate)', 'sum(n)')} AS avg_hourly_rate",
        f"{ratio('sum(burden)', 'sum(n)')} AS avg_burden_multiplier",
        "CAST(sum(cost) AS DOUBLE) AS total_labor_cost",
        "min(first_date) AS first_date",
        "max(last_date) AS last_date",
    ).selectExpr(
        "*",
        f"{st} + {ot} * 1.5D AS total_effective_hours",
        f"{ratio(ot, f'{st} + {ot}')} AS ot_share_of_raw_hours",
    )


_LABOR_COUNTS = {"employee_id": "num_employees", "role": "num_roles"}


def labor_project_summary(cube: DataFrame) -> DataFrame:
    return _labor_rollup(
        cube, ["project_id"], {**_LABOR_COUNTS, "sov_line_id": "num_sov_lines"}
    )


def labor_project_sov_summary(cube: DataFrame) -> DataFrame:
    return _labor_rollup(cube, ["project_id", "sov_line_id"], _LABOR_COUNTS)


def labor_project_week_summary(cube: DataFrame) -> DataFrame:
    return _labor_rollup(cube, ["project_id", "week_start"], _LABOR_COUNTS)


def delivery_costs(material: DataFrame) -> DataFrame:
    """Cost of deliveries by project, line and week: all that the cost readers need, one narrow table for all of them."""
    return _by(
        material.selectExpr("project_id", "sov_line_id", f"{MONDAY.format('date')} AS week_start", "total_cost"),
        ["project_id", "sov_line_id", "week_start"],
        "SUM(CAST(total_cost AS DECIMAL(28,6))) AS cost",
    )


def material_cost(costs: DataFrame, keys: list[str]) -> DataFrame:
    return _by(costs, keys, "CAST(sum(cost) AS DOUBLE) AS total_material_cost")


def _material_rollup(material: DataFrame, keys: list[str], distinct: dict[str, str]) -> DataFrame:
    """Sums and exact distinct counts by `keys`, straight from the deliveries.

    Spark copies a row once per counted column, and each copy carries that column alone. Copies combine in
    their task before the shuffle: the sums to a row per group, lines, categories and vendors to a row per value.
    Only the ids, which are nearly unique, travel in full, as (group, id). A cube of all counted columns would be
    as long and as wide as the deliveries, and a second pass over the ids would come on top.
    """
    return _by(
        material.selectExpr("*", f"{MONDAY.format('date')} AS week_start"), keys,
        "count(1) AS num_deliveries",
        *_distinct_counts({"delivery_id": "num_unique_deliveries", **distinct}),
        f"{exact_sum('quantity')} AS total_quantity",
        f"{ratio('SUM(CAST(unit_cost AS DECIMAL(28,6)))', 'COUNT(unit_cost)')} AS avg_unit_cost",
        f"{exact_sum('total_cost')} AS total_material_cost",
        "min(date) AS first_delivery_date",
        "max(date) AS last_delivery_date",
    )


_MATERIAL_COUNTS = {"material_category": "num_material_categories", "vendor": "num_vendors"}
_MATERIAL_LINES = {**_MATERIAL_COUNTS, "sov_line_id": "num_sov_lines"}


def material_project_summary(material: DataFrame) -> DataFrame:
    return _material_rollup(material, ["project_id"], _MATERIAL_LINES)


def material_project_sov_summary(material: DataFrame) -> DataFrame:
    return _material_rollup(material, ["project_id", "sov_line_id"], _MATERIAL_COUNTS)


def material_project_week_summary(material: DataFrame) -> DataFrame:
    return _material_rollup(material, ["project_id", "week_start"], _MATERIAL_LINES)


STATUS = "lower(trim(status))"


def change_summary(orders: DataFrame) -> DataFrame:
    value = lambda s: exact_sum(f"CASE WHEN {STATUS} = '{s}' THEN amount ELSE 0D END")
    return _by(
        orders, ["project_id"],
        "count(1) AS total_change_orders",
        *[f"count_if({STATUS} = '{s}') AS {s}_cos" for s in ("approved", "pending", "rejected")],
        f"{exact_sum('amount')} AS total_co_value",
        f"{value('approved')} AS approved_value",
        f"{value('rejected')} AS rejected_value",
        f"{exact_sum('schedule_impact_days')} AS total_schedule_impact",
        f"{exact_sum('labor_hours_impact')} AS total_labor_impact",
    )


def rfi_counts(rfis: DataFrame) -> DataFrame:
    return _by(rfis, ["project_id"], "count(1) AS total_rfis")


def linked_rfis(orders: DataFrame) -> DataFrame:
    return _by(
        orders.filter("trim(related_rfi) <> ''"), ["project_id"],
        "count(DISTINCT related_rfi) AS rfis_linked_to_cos",
    )


def rfi_summary(counts: DataFrame, linked: DataFrame, rules: Rules) -> DataFrame:
    links = "COALESCE(rfis_linked_to_cos, 0L)"
    return join_alike(counts, linked, "project_id", "left").selectExpr(
        "project_id",
        "total_rfis",
        f"{links} AS rfis_linked_to_cos",
        f"CASE WHEN total_rfis > {rules.rfi_level_high} THEN 'HIGH' "
        f"WHEN total_rfis > {rules.rfi_level_medium} THEN 'MEDIUM' ELSE 'LOW' END AS rfi_level",
        f"COALESCE({ratio(links, 'total_rfis')}, 0D) AS rfi_to_co_ratio",
    )


def budget_rollup(budget: DataFrame) -> DataFrame:
    parts = {
        "est_labor": "estimated_labor_cost",
        "est_material": "estimated_material_cost",
        "est_equip": "estimated_equipment_cost",
        "est_sub": "estimated_sub_cost",
    }
    sums = [f"COALESCE({exact_sum(c)}, 0D) AS {alias}" for alias, c in parts.items()]
    return _by(budget, ["project_id"], *sums).selectExpr(
        "*", f"{' + '.join(parts)} AS total_budget"
    )


def co_health_summary(orders: DataFrame) -> DataFrame:
    """Approved, rejected and everything else; an unknown amount counts as zero."""
    bucket = (
        f"CASE WHEN {STATUS} = 'approved' THEN 'approved' "
        f"WHEN {STATUS} IN {_in(CO_REJECTED_HEALTH)} THEN 'rejected' ELSE 'pending' END"
    )
    names = {
        "approved": "co_approved_value", "pending": "pending_co_value",
        "rejected": "co_rejected_value",
    }
    value = lambda b: exact_sum(f"CASE WHEN bucket = '{b}' THEN COALESCE(amount, 0D) ELSE 0D END")
    return _by(
        orders.selectExpr("project_id", "amount", f"{bucket} AS bucket"), ["project_id"],
        *[f"count_if(bucket = '{b}') AS co_{b}_count" for b in names],
        *[f"{value(b)} AS {alias}" for b, alias in names.items()],
    )


def rfi_health_summary(rfis: DataFrame, as_of: dt.date) -> DataFrame:
    truthy = f"COALESCE(lower(trim(cost_impact)) IN {_in(TRUE_WORDS)}, false)"
    is_open = f"NOT COALESCE({STATUS} IN {_in(RFI_CLOSED_HEALTH)}, false)"
    age = f"datediff(DATE'{as_of.isoformat()}', date_submitted)"
    open_age = (
        f"CASE WHEN {is_open} AND date_submitted IS NOT NULL THEN greatest({age}, 0) END"
    )
    return _by(
        rfis, ["project_id"],
        "count(1) AS rfi_count",
        f"count_if({truthy}) AS rfi_cost_impact_count",
        "count_if(lower(trim(priority)) IN ('high', 'critical')) AS rfi_high_critical",
        f"count_if({is_open}) AS rfi_open",
        f"CAST(max({open_age}) AS DOUBLE) AS max_open_rfi_age",
    )


def billing_max(billing: DataFrame) -> DataFrame:
    return _by(
        billing, ["project_id"],
        "max(cumulative_billed) AS cumulative_billed", "true AS billing_data_available",
    )


def billing_sum(billing: DataFrame) -> DataFrame:
    return _by(billing, ["project_id"], f"{exact_sum('period_total')} AS total_billed")


def rfi_by_week(rfis: DataFrame) -> DataFrame:
    week = MONDAY.format("date_submitted")
    labeled = rfis.filter("date_submitted IS NOT NULL").selectExpr(
        "project_id", "rfi_number",
        f"concat(CAST({week} AS STRING), '/', CAST(date_add({week}, 6) AS STRING)) AS week",
    )
    return _by(labeled, ["project_id", "week"], "count(rfi_number) AS rfi_count")
