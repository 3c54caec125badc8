"""Actual against budget, by cost line, week and project."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siteledger.functions.sql import exact_mean, exact_sum, join_alike, ratio

LINE = ["project_id", "sov_line_id"]


def _by(df: DataFrame, keys: list[str], *exprs: str) -> DataFrame:
    return df.groupBy(*keys).agg(*[F.expr(e) for e in exprs])


def _zero(x: str) -> str:
    return f"COALESCE({x}, 0D)"


def _against(actual: str, budget: str, variance: str) -> list[str]:
    return [
        f"{actual} - {budget} AS {variance}",
        f"{ratio(f'{actual} - {budget}', budget)} AS pct_overrun",
    ]


LABOR_DETAILS = [
    "total_effective_hours", "avg_hourly_rate", "avg_burden_multiplier",
    "ot_share_of_raw_hours", "first_date", "last_date",
]


def labor_vs_budget(labor_sov: DataFrame, budget: DataFrame) -> DataFrame:
    plan = budget.select(
        *LINE, "estimated_labor_hours", "estimated_labor_cost", "productivity_factor",
        "key_assumptions",
    )
    return join_alike(labor_sov, plan, LINE, "left").selectExpr(
        *LINE,
        "total_labor_cost AS actual_labor_cost",
        "total_hours_st", "total_hours_ot",
        *[c for c in LABOR_DETAILS if c in labor_sov.columns],
        "estimated_labor_hours AS budget_labor_hours",
        "estimated_labor_cost AS budget_labor_cost",
        "productivity_factor", "key_assumptions",
        *_against("total_labor_cost", "estimated_labor_cost", "labor_variance"),
    )


MATERIAL_DETAILS = [
    "num_deliveries", "num_unique_deliveries", "num_material_categories", "num_vendors",
    "total_quantity", "avg_unit_cost", "first_delivery_date", "last_delivery_date",
]


def material_vs_budget(material_sov: DataFrame, budget: DataFrame) -> DataFrame:
    plan = budget.select(
        *LINE, "estimated_material_cost", "productivity_factor", "key_assumptions"
    )
    return join_alike(material_sov, plan, LINE, "left").selectExpr(
        *LINE,
        "total_material_cost AS actual_material_cost",
        *[c for c in MATERIAL_DETAILS if c in material_sov.columns],
        "estimated_material_cost AS budget_material_cost",
        "productivity_factor", "key_assumptions",
        *_against("total_material_cost", "estimated_material_cost", "material_variance"),
    )


def project_weekly_summary(labor_week: DataFrame, material_week: DataFrame) -> DataFrame:
    key = ["project_id", "week_start"]
    both = labor_week.select(*key, "total_labor_cost").join(
        material_week.select(*key, "total_material_cost"), key, "full_outer"
    )
    return both.selectExpr(
        *key,
        f"{_zero('total_labor_cost')} AS labor_cost",
        f"{_zero('total_material_cost')} AS material_cost",
    ).selectExpr(
        "*", "labor_cost + material_cost AS total_cost"
    ).selectExpr(
        "*",
        f"{ratio('labor_cost', 'total_cost')} AS labor_pct",
        f"{ratio('material_cost', 'total_cost')} AS material_pct",
    )


def variance_full_outer(labor_vb: DataFrame, material_vb: DataFrame) -> DataFrame:
    labor = labor_vb.selectExpr(
        *LINE, "actual_labor_cost", "labor_variance", "pct_overrun AS labor_pct_overrun"
    )
    material = material_vb.selectExpr(
        *LINE, "actual_material_cost", "material_variance", "pct_overrun AS material_pct_overrun"
    )
    return labor.join(material, LINE, "full_outer")


def project_cost_summary(lines: DataFrame) -> DataFrame:
    labor = _zero(exact_sum("labor_variance"))
    material = _zero(exact_sum("material_variance"))
    return _by(
        lines, ["project_id"],
        f"{labor} AS total_labor_variance",
        f"{material} AS total_material_variance",
        f"{labor} + {material} AS total_variance",
        f"{exact_mean('labor_pct_overrun')} AS avg_labor_pct_overrun",
        f"{exact_mean('material_pct_overrun')} AS avg_material_pct_overrun",
    )


def cost_summary(lines: DataFrame) -> DataFrame:
    """`total_cost` stays NULL for a project with only labor or only material."""
    labor, material = exact_sum("actual_labor_cost"), exact_sum("actual_material_cost")
    return _by(
        lines, ["project_id"],
        f"{labor} AS total_labor_cost",
        f"{material} AS total_material_cost",
        f"{labor} + {material} AS total_cost",
    )


def cost_summary_labor_only(labor_vb: DataFrame) -> DataFrame:
    labor = exact_sum("actual_labor_cost")
    return _by(
        labor_vb, ["project_id"],
        f"{labor} AS total_labor_cost", "0D AS total_material_cost", f"{labor} AS total_cost",
    )


def project_billing_analysis(costs: DataFrame, billed: DataFrame) -> DataFrame:
    gap = "total_billed - total_cost"
    return join_alike(costs, billed, "project_id", "left").selectExpr(
        "*", f"{gap} AS billing_gap", f"{ratio(gap, 'total_cost')} AS margin_pct"
    )


def project_full_analysis(billing: DataFrame, changes: DataFrame) -> DataFrame:
    return join_alike(billing, changes, "project_id", "left").selectExpr(
        "*",
        f"{ratio('rejected_value', 'total_co_value')} AS rejected_value_ratio",
        f"{ratio('rejected_cos', 'total_change_orders')} AS rejected_count_ratio",
    )


def project_analysis_w_rfi(full: DataFrame, rfi: DataFrame) -> DataFrame:
    return join_alike(full, rfi, "project_id", "left")


def labor_rollup(labor_vb: DataFrame) -> DataFrame:
    actual, budget = exact_sum("actual_labor_cost"), exact_sum("budget_labor_cost")
    st, ot = exact_sum("total_hours_st"), exact_sum("total_hours_ot")
    return _by(
        labor_vb, ["project_id"],
        f"{_zero(actual)} AS labor_actual_cost",
        f"{_zero(budget)} AS labor_budget_cost",
        f"{_zero(exact_sum('labor_variance'))} AS labor_variance",
        f"{exact_mean('pct_overrun')} AS labor_avg_pct_overrun",
        f"{ot} AS labor_ot_hours",
        f"{st} AS labor_st_hours",
        f"{ratio(actual, budget)} AS labor_burn_ratio",
        f"{ratio(ot, f'{st} + {ot}')} AS labor_ot_share",
    )


def material_rollup(material_vb: DataFrame) -> DataFrame:
    actual, budget = exact_sum("actual_material_cost"), exact_sum("budget_material_cost")
    return _by(
        material_vb, ["project_id"],
        f"{_zero(actual)} AS material_actual_cost",
        f"{_zero(budget)} AS material_budget_cost",
        f"{_zero(exact_sum('material_variance'))} AS material_variance",
        f"{exact_mean('pct_overrun')} AS material_avg_pct_overrun",
        f"{ratio(actual, budget)} AS material_burn_ratio",
    )


def sov_budget_vs_actual(
    budget: DataFrame, labor_sov: DataFrame, material_sov: DataFrame
) -> DataFrame:
    """Budget lines with labor and material spent on them; unbudgeted lines drop out."""
    plan = f"{_zero('estimated_labor_cost')} + {_zero('estimated_material_cost')}"
    spent = f"{_zero('total_labor_cost')} + {_zero('total_material_cost')}"
    return (
        budget.join(labor_sov.select(*LINE, "total_labor_cost"), LINE, "left")
        .join(material_sov.select(*LINE, "total_material_cost"), LINE, "left")
        .selectExpr(*LINE, f"{plan} AS budgeted", f"{spent} AS actual")
    )
