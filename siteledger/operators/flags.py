"""Triggers, severity and portfolio indicators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siteledger.functions.sql import exact_mean, exact_sum, ratio, text_list
from siteledger.rules import Rules


def trigger_conditions(rules: Rules) -> dict[str, str]:
    """The eight triggers by id, none of them NULL."""
    margin, coverage = "realized_margin_pct", "budget_coverage"
    labor, material = "labor_overrun_pct", "material_overrun_pct"
    raw = {
        "underwater": "actual_tracked_cost > adjusted_contract",
        "material_blowout": f"{material} > {rules.material_overrun_pct}D",
        "labor_overrun": f"{labor} > {rules.labor_overrun_pct}D",
        "rejected_co_exposure":
            f"co_rejected_value > original_contract_value * {rules.rejected_co_exposure}D "
            f"AND {margin} < {rules.severity_watch}D",
        "budget_coverage":
            f"{coverage} < {rules.coverage_min}D OR {coverage} > {rules.coverage_max}D",
        "compound_overrun":
            f"{labor} > 0 AND {material} > {rules.compound_material_overrun_pct}D",
        "rfi_cost_impact_count": f"rfi_cost_impact_count > {rules.rfi_cost_impact_count}",
        "rfi_cost_impact_rate":
            f"{ratio('rfi_cost_impact_count', 'rfi_count')} > {rules.rfi_cost_impact_rate}D",
    }
    return {name: f"COALESCE({cond}, false)" for name, cond in raw.items()}


def severity(margin: str, rules: Rules) -> str:
    return (
        f"CASE WHEN {margin} < {rules.severity_critical}D THEN 'Critical' "
        f"WHEN {margin} < {rules.severity_warning}D THEN 'Warning' ELSE 'Watch' END"
    )


def severity_normalize(name: str) -> str:
    clean = f"lower(trim({name}))"
    return f"CASE WHEN {clean} IN ('critical', 'warning', 'watch') THEN {clean} ELSE 'watch' END"


def with_triggers(health: DataFrame, rules: Rules) -> DataFrame:
    fired = text_list(*[(c, f"'{name}'") for name, c in trigger_conditions(rules).items()])
    return health.selectExpr("*", f"{fired} AS fired_triggers").selectExpr(
        "*", "CAST(size(fired_triggers) AS BIGINT) AS trigger_count"
    )


def any_trigger(rules: Rules) -> str:
    return " OR ".join(trigger_conditions(rules).values())


def flagged_projects(health: DataFrame, rules: Rules) -> DataFrame:
    return with_triggers(health.filter(any_trigger(rules)), rules).selectExpr(
        "*", f"{severity('realized_margin_pct', rules)} AS severity"
    )


_SUMS = {
    "total_contract": "original_contract_value",
    "total_budget": "total_budget",
    "total_cos_approved": "co_approved_value",
    "total_adjusted": "adjusted_contract",
    "total_actual_labor": "actual_labor_cost",
    "total_actual_material": "actual_material_cost",
    "total_rejected_cos": "co_rejected_value",
}
_MEANS = {
    "avg_bid_margin": "bid_margin",
    "avg_realized_margin": "realized_margin_pct",
    "avg_material_overrun_pct": "material_overrun_pct",
    "avg_labor_overrun_pct": "labor_overrun_pct",
}


def _kpis() -> list[str]:
    return [
        "count(1) AS total_projects",
        *[f"{exact_sum(c)} AS {alias}" for alias, c in _SUMS.items()],
        *[f"{exact_mean(c)} AS {alias}" for alias, c in _MEANS.items()],
        "count_if(actual_tracked_cost > adjusted_contract) AS underwater_count",
        "count_if(bid_margin < 0) AS negative_bid_margin_count",
    ]


def portfolio_kpis(health: DataFrame) -> DataFrame:
    return health.agg(*[F.expr(e) for e in _kpis()])


def portfolio_summary(health: DataFrame, rules: Rules) -> DataFrame:
    """The indicators and the number of flagged projects, in one pass."""
    flagged = f"count_if({any_trigger(rules)}) AS total_flagged"
    return health.agg(*[F.expr(e) for e in [*_kpis(), flagged]])
