"""Documents of the model steps, built from the tables: diagnoses, and the compressed input of the portfolio plan.

A portfolio input covers one contractor. It holds only lists with a fixed limit (the best actions, causes by label,
sectors); project lists of any length stay tables (`gc_projects`, `completed_projects`, `root_cause_projects`).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siteledger.functions.sql import exact_mean, exact_sum
from siteledger.operators.portfolio import AT_RISK, WORTH, with_portfolio_sector
from siteledger.rules import Rules

_KEEP_NULLS = "map('ignoreNullFields', 'false')"


def diagnosis_documents(briefs: DataFrame) -> DataFrame:
    """project_id, document: the rule-based diagnosis of each flagged project."""
    gap = "COALESCE(greatest(contract_value * billing_gap, 0D), 0D)"
    snapshot = (
        "named_struct('contract_value', contract_value, 'estimated_cost', estimated_cost_total, "
        "'actual_cost', actual_cost_total, 'realized_margin_pct', realized_margin, 'labor_actual', labor_actual, "
        "'labor_estimated', labor_budget, 'material_actual', material_actual, 'material_estimated', material_budget, "
        "'billing_complete_pct', percent_billed, 'retention_held', retention_held, 'project_stage', project_stage)"
    )
    found = (
        "transform(root_causes, c -> named_struct('label', c.label, 'category', c.category, 'impact_dollars', "
        "c.impact_dollars, 'confidence', c.confidence, 'evidence', c.evidence))"
    )
    assessment = (
        f"named_struct('billing_recovery_possible', {gap} > 0, 'billing_recovery_estimate', {gap}, "
        "'change_order_recovery_possible', co_pending_value > 0, 'change_order_recovery_estimate', co_pending_value, "
        "'retention_recovery_possible', retention_held > 0, 'retention_amount', retention_held, "
        "'remaining_margin_protection_possible', project_stage <> 'complete', "
        f"'total_estimated_recoverable', {gap} + co_pending_value + retention_held)"
    )
    whole = (
        "named_struct('project_id', id, 'project_name', name, 'severity', upper(severity), 'headline', headline, "
        f"'financial_snapshot', {snapshot}, 'root_causes', {found}, 'recoverability_assessment', {assessment}, "
        "'missing_data', filter(array(IF(billing_data_available, NULL, 'billing_history')), m -> m IS NOT NULL), "
        "'diagnosis_confidence', 0.55D)"
    )
    return briefs.selectExpr("id AS project_id", f"to_json({whole}, {_KEEP_NULLS}) AS document")


def _per_gc(rows: DataFrame, key: str, *exprs: str) -> DataFrame:
    return rows.groupBy(*key.split()).agg(*[F.expr(e) for e in exprs])


def portfolio_inputs(briefs: DataFrame, actions: DataFrame, rules: Rules) -> DataFrame:
    """gc_name, document: totals, best actions, groupings and capacities of each contractor's flagged projects."""
    known = with_portfolio_sector(briefs).withColumn("gc_name", F.expr("COALESCE(gc_name, 'Unknown')"))
    known = known.withColumn("at_risk", F.expr(AT_RISK))
    totals = _per_gc(
        known, "gc_name",
        "count(1) AS n",
        *(f"count_if(severity = '{s}') AS {s}" for s in ("critical", "warning", "watch")),
        *(
            f"COALESCE({exact_sum(c)}, 0D) AS {c}"
            for c in ("contract_value", "at_risk", "total_recoverable_estimate", "retention_held", "co_pending_value", "co_rejected_value")
        ),
    )
    best = W.partitionBy("gc_name").orderBy(F.expr(WORTH).desc(), "action_id")
    fields = (
        "action_id", "project_id", "project_name", "gc_name", "sector", "project_stage", "realized_margin_pct", "action",
        "owner", "financial_logic", "estimated_recovery_dollars", "urgency", "effort", "time_to_cash_days", "confidence",
        "linked_root_cause", "original_priority",
    )
    listed = (
        actions.withColumn("gc_name", F.expr("COALESCE(gc_name, 'Unknown')"))
        .withColumn("place", F.row_number().over(best))
        .filter(F.col("place") <= rules.top_actions)
        .groupBy("gc_name")
        .agg(F.expr(f"transform(array_sort(collect_list(struct(place, struct({', '.join(fields)}) AS a))), x -> x.a) AS all_actions"))
    )
    sectors = _per_gc(
        known, "gc_name sector", "count(1) AS project_count", f"COALESCE({exact_sum('at_risk')}, 0D) AS total_at_risk",
        f"COALESCE({exact_mean('realized_margin')}, 0D) AS avg_margin_pct",
    )
    sectors = _per_gc(
        sectors, "gc_name",
        "map_from_entries(array_sort(collect_list(struct(sector, struct(project_count, total_at_risk, avg_margin_pct))))) AS by_sector",
    )
    causes = known.selectExpr("gc_name", "sector", "inline(root_causes)")
    patterns = _per_gc(
        causes, "gc_name label", "min(category) AS category", "count(1) AS count",
        f"COALESCE({exact_sum('impact_dollars')}, 0D) AS total_impact_dollars", "array_sort(collect_set(sector)) AS sectors_affected",
    ).withColumn(
        "is_likely_systemic",
        F.expr(f"count >= {rules.systemic_projects} OR size(sectors_affected) >= {rules.systemic_sectors}"),
    )
    patterns = _per_gc(
        patterns, "gc_name",
        "array_sort(collect_list(struct(label, category, count, total_impact_dollars, is_likely_systemic, sectors_affected))) AS patterns",
    )
    stats = (
        "named_struct('total_flagged_projects', n, 'severity_counts', struct(critical, warning, watch), "
        "'total_contract_value', contract_value, 'total_dollars_at_risk', at_risk, 'total_theoretical_recovery', "
        "total_recoverable_estimate, 'total_retention_held', retention_held, 'total_pending_cos', co_pending_value, "
        "'total_rejected_cos', co_rejected_value)"
    )
    group = (
        "named_struct('project_count', n, 'total_contract_value', contract_value, 'total_at_risk', at_risk, "
        "'total_pending_cos', co_pending_value, 'total_rejected_cos', co_rejected_value)"
    )
    hours = ", ".join(f"'{o}', named_struct('available_hours', {float(h)}D, 'headcount', 1)" for o, h in rules.capacity_hours.items())
    whole = (
        f"named_struct('portfolio_stats', {stats}, 'all_actions', COALESCE(all_actions, array()), "
        f"'projects_by_gc', map(gc_name, {group}), 'projects_by_sector', by_sector, "
        f"'root_cause_patterns', COALESCE(patterns, array()), 'resource_capacity', named_struct({hours}))"
    )
    joined = totals.join(listed, "gc_name", "left").join(sectors, "gc_name", "left").join(patterns, "gc_name", "left")
    return joined.selectExpr("gc_name", f"to_json({whole}, {_KEEP_NULLS}) AS document")
