"""Project health: weekly trends and the wide per-project projection."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siteledger.functions.sql import exact_sum, join_alike, ratio

RECENT_WEEKS = 4


def _by_recency(weekly: DataFrame) -> DataFrame:
    """Weeks numbered from the newest. Rows are weekly already, so a project's window
    holds one row per calendar week, however large the project is."""
    newest = "OVER (PARTITION BY project_id ORDER BY week_start DESC NULLS LAST)"
    return weekly.selectExpr("*", f"row_number() {newest} AS _row")


RECENT = f"week_start IS NOT NULL AND _row <= {RECENT_WEEKS}"
PRIOR = f"week_start IS NOT NULL AND _row BETWEEN {RECENT_WEEKS + 1} AND {2 * RECENT_WEEKS}"


def _mean_when(condition: str, value: str) -> str:
    kept = f"CASE WHEN {condition} THEN {value} END"
    return ratio(f"SUM(CAST({kept} AS DECIMAL(28,6)))", f"COUNT({kept})")


def _change(recent: str, prior: str) -> str:
    return f"COALESCE({ratio(f'{recent} - {prior}', prior)}, 0D)"


def weekly_cost_trend(weekly: DataFrame) -> DataFrame:
    trend = _by_recency(weekly).groupBy("project_id").agg(
        F.expr("count(week_start) AS active_weeks"),
        F.expr(f"COALESCE({_mean_when(RECENT, 'total_cost')}, 0D) AS recent"),
        F.expr(f"{_mean_when(PRIOR, 'total_cost')} AS earlier"),
    )
    return trend.selectExpr(
        "project_id", "active_weeks", "recent", "COALESCE(earlier, recent) AS prior"
    ).selectExpr(
        "project_id", "active_weeks", "recent AS recent_weekly_cost_avg",
        "prior AS prior_weekly_cost_avg",
        f"{_change('recent', 'prior')} AS burn_rate_acceleration",
    )


def weekly_labor_trend(labor_week: DataFrame) -> DataFrame:
    st, ot = "COALESCE(total_hours_st, 0D)", "COALESCE(total_hours_ot, 0D)"
    crew = "COALESCE(num_employees, 0L)"

    def share(condition: str) -> str:
        hours = exact_sum(f"CASE WHEN {condition} THEN {st} + {ot} END")
        overtime = exact_sum(f"CASE WHEN {condition} THEN {ot} END")
        return (
            f"CASE WHEN {hours} > 0 THEN {ratio(overtime, hours)} "
            f"WHEN count_if({condition}) > 0 THEN 0D END"
        )

    trend = _by_recency(labor_week).groupBy("project_id").agg(
        F.expr(f"COALESCE({share(RECENT)}, 0D) AS recent_ot"),
        F.expr(f"{share(PRIOR)} AS earlier_ot"),
        F.expr(f"COALESCE({_mean_when(RECENT, crew)}, 0D) AS recent_crew"),
        F.expr(f"{_mean_when(PRIOR, crew)} AS earlier_crew"),
    )
    return trend.selectExpr(
        "project_id", "recent_ot", "COALESCE(earlier_ot, recent_ot) AS prior_ot",
        "recent_crew", "COALESCE(earlier_crew, recent_crew) AS prior_crew",
    ).selectExpr(
        "project_id", "recent_ot AS recent_ot_share", "prior_ot AS prior_ot_share",
        "recent_ot - prior_ot AS overtime_spike", "recent_crew AS recent_crew_size",
        "prior_crew AS prior_crew_size",
        f"{_change('recent_crew', 'prior_crew')} AS crew_size_spike",
    )


COUNT_DEFAULTS = [
    "co_approved_count", "co_pending_count", "co_rejected_count", "rfi_count",
    "rfi_cost_impact_count", "rfi_high_critical", "rfi_open", "active_weeks",
]
AMOUNT_DEFAULTS = [
    "est_labor", "est_material", "est_equip", "est_sub", "total_budget",
    "actual_labor_cost", "actual_material_cost", "co_approved_value", "pending_co_value",
    "co_rejected_value", "max_open_rfi_age", "cumulative_billed",
    "recent_weekly_cost_avg", "prior_weekly_cost_avg", "burn_rate_acceleration",
    "recent_ot_share", "prior_ot_share", "overtime_spike", "recent_crew_size",
    "prior_crew_size", "crew_size_spike", "total_hours_st", "total_hours_ot",
]
RATIO_DEFAULTS = [
    "bid_margin", "realized_margin_pct", "labor_overrun_pct", "material_overrun_pct",
    "budget_coverage", "ot_share", "labor_burn_ratio", "material_burn_ratio",
    "approved_co_pct", "rejected_co_pct", "pending_co_pct", "rfi_cost_impact_rate",
    "rfi_per_million_contract", "forecast_to_complete_trend",
]


def project_health_join(
    contracts: DataFrame, budget: DataFrame, labor: DataFrame, material: DataFrame,
    orders: DataFrame, rfis: DataFrame, billing: DataFrame, cost_trend: DataFrame,
    labor_trend: DataFrame,
) -> DataFrame:
    """Contracts with one row of every per-project summary; all joins share one key."""
    sides = [
        budget,
        labor.selectExpr("project_id", "total_labor_cost AS actual_labor_cost",
                         "total_hours_st", "total_hours_ot"),
        material.selectExpr("project_id", "total_material_cost AS actual_material_cost"),
        orders, rfis, billing, cost_trend, labor_trend,
    ]
    start = contracts.select("project_id", "project_name", "original_contract_value", "gc_name")
    return reduce(lambda a, b: join_alike(a, b, "project_id", "left"), sides, start)


def _filled(df: DataFrame, defaults: dict[str, str]) -> DataFrame:
    return df.selectExpr(
        *[f"COALESCE({c}, {defaults[c]}) AS {c}" if c in defaults else c for c in df.columns]
    )


def fill_defaults(joined: DataFrame) -> DataFrame:
    return _filled(
        joined,
        dict.fromkeys(COUNT_DEFAULTS, "0L") | dict.fromkeys(AMOUNT_DEFAULTS, "0D")
        | {"billing_data_available": "false"},
    )


def fill_ratios(df: DataFrame) -> DataFrame:
    return _filled(df, dict.fromkeys(RATIO_DEFAULTS, "0D"))


def _clip01(x: str) -> str:
    return f"CASE WHEN {x} IS NOT NULL THEN least(greatest({x}, 0D), 1D) END"


def health_columns(filled: DataFrame) -> DataFrame:
    """Margins, overruns, progress, billing gap and forecast; ratios may be NULL."""
    contract, budget, tracked = "original_contract_value", "total_budget", "actual_tracked_cost"
    labor, material, adjusted = "actual_labor_cost", "actual_material_cost", "adjusted_contract"
    billed = _clip01(ratio("cumulative_billed", adjusted))
    return (
        filled.selectExpr(
            "*",
            f"{labor} + {material} AS {tracked}",
            f"COALESCE({contract}, 0D) + co_approved_value AS {adjusted}",
        )
        .selectExpr(
            "*",
            f"1 - {ratio(budget, contract)} AS bid_margin",
            f"{adjusted} - ({tracked} + est_equip + est_sub) AS realized_margin_dollars",
            f"({ratio(labor, 'est_labor')} - 1) * 100 AS labor_overrun_pct",
            f"({ratio(material, 'est_material')} - 1) * 100 AS material_overrun_pct",
            f"{_clip01(ratio(tracked, budget))} AS pct_complete",
            f"CASE WHEN billing_data_available THEN {billed} END AS pct_billed",
            f"{ratio(budget, contract)} AS budget_coverage",
            f"{ratio('total_hours_ot', 'total_hours_st + total_hours_ot')} AS ot_share",
            f"{ratio(labor, 'est_labor')} AS labor_burn_ratio",
            f"{ratio(material, 'est_material')} AS material_burn_ratio",
            f"{ratio('co_approved_value', contract)} AS approved_co_pct",
            f"{ratio('co_rejected_value', contract)} AS rejected_co_pct",
            f"{ratio('pending_co_value', contract)} AS pending_co_pct",
            f"{ratio('rfi_cost_impact_count', 'rfi_count')} AS rfi_cost_impact_rate",
            f"{ratio('rfi_count', f'{contract} / 1000000')} AS rfi_per_million_contract",
        )
        .selectExpr(
            "*",
            f"{ratio('realized_margin_dollars', adjusted)} AS realized_margin_pct",
            "pct_complete - pct_billed AS billing_gap_pct",
            "CAST(ceil(greatest(0D, 1 - COALESCE(pct_complete, 0D)) * active_weeks) AS DOUBLE) "
            "AS remaining_weeks",
        )
        .selectExpr(
            "*",
            f"{tracked} + recent_weekly_cost_avg * remaining_weeks "
            "AS forecast_cost_at_completion",
            f"{tracked} + prior_weekly_cost_avg * remaining_weeks "
            "AS prior_forecast_cost_at_completion",
        )
        .selectExpr(
            "*",
            f"forecast_cost_at_completion - {budget} AS forecast_to_complete",
            "COALESCE("
            + ratio("forecast_cost_at_completion - prior_forecast_cost_at_completion", budget)
            + ", 0D) AS forecast_to_complete_trend",
        )
    )


def project_health(joined: DataFrame) -> DataFrame:
    return fill_ratios(health_columns(fill_defaults(joined)))
