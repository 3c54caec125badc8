"""Portfolio totals, groupings and briefs over project analyses.

`briefs` has one row per flagged project with its causes and actions in arrays;
`actions` and `causes` are the same as rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siteledger.functions.sql import exact_mean, exact_sum, sector
from siteledger.rules import (
    NO_CAUSE, SECTORS_PORTFOLIO, SECTORS_PORTFOLIO_DEFAULT, URGENCY_ORDER, WEEK_DAYS, Rules,
)


def _agg(df: DataFrame, *exprs: str) -> DataFrame:
    return df.agg(*[F.expr(e) for e in exprs])


def _by(df: DataFrame, keys: list[str], *exprs: str) -> DataFrame:
    return df.groupBy(*keys).agg(*[F.expr(e) for e in exprs])


AT_RISK = "greatest(0D, actual_cost_total - estimated_cost_total)"
SEVERITY_COUNTS = [
    f"count_if(severity = '{s}') AS {s}_count" for s in ("critical", "warning", "watch")
]


def with_portfolio_sector(briefs: DataFrame) -> DataFrame:
    name = sector("name", SECTORS_PORTFOLIO, SECTORS_PORTFOLIO_DEFAULT)
    return briefs.withColumn("sector", F.expr(name))


def portfolio_stats(briefs: DataFrame) -> DataFrame:
    return _agg(
        briefs,
        "count(1) AS total_flagged_projects",
        *SEVERITY_COUNTS,
        f"COALESCE({exact_sum('contract_value')}, 0D) AS total_contract_value",
        f"COALESCE({exact_sum(AT_RISK)}, 0D) AS total_dollars_at_risk",
        f"COALESCE({exact_sum('total_recoverable_estimate')}, 0D) AS total_theoretical_recovery",
        f"COALESCE({exact_sum('retention_held')}, 0D) AS total_retention_held",
        f"COALESCE({exact_sum('co_pending_value')}, 0D) AS total_pending_cos",
        f"COALESCE({exact_sum('co_rejected_value')}, 0D) AS total_rejected_cos",
    )


def all_actions(briefs: DataFrame) -> DataFrame:
    """Every action with the context of its project.

    An action without a probability takes the confidence of its analysis, if briefs have that column, else 0.7.
    """
    confidence = "confidence" if "confidence" in briefs.columns else "CAST(NULL AS DOUBLE)"
    return with_portfolio_sector(briefs).selectExpr(
        "id AS project_id", "name AS project_name", "gc_name", "sector", "project_stage",
        "realized_margin AS realized_margin_pct", "percent_billed", "current_margin_dollars",
        f"{confidence} AS analysis_confidence", "posexplode(recovery_actions) AS (pos, a)",
    ).selectExpr(
        "project_id || '_' || CAST(pos + 1 AS STRING) AS action_id", "project_id",
        "project_name", "gc_name", "sector", "project_stage", "realized_margin_pct", "a.action",
        "COALESCE(a.owner, 'Project Manager') AS owner", "a.financial_logic",
        "a.estimated_recovery_dollars", "COALESCE(a.urgency, 'this_month') AS urgency",
        "a.effort", "a.time_to_cash_days",
        "COALESCE(NULLIF(a.probability_of_success, 0D), analysis_confidence, 0.7D) AS confidence",
        "a.cost_to_execute_hours", "a.expected_value", "a.recovery_type",
        "a.linked_root_cause", "CAST(pos + 1 AS BIGINT) AS original_priority",
    )


def action_context(actions: DataFrame, flagged: DataFrame) -> DataFrame:
    """Action rows with the contractor and change-order values of their project."""
    side = flagged.selectExpr(
        "project_id", "gc_name", "pending_co_value AS co_pending_value", "co_rejected_value"
    )
    return actions.select("project_id", "id", "expected_value").join(side, "project_id", "left")


def projects_by_gc(briefs: DataFrame) -> DataFrame:
    named = briefs.withColumn("gc_name", F.expr("COALESCE(gc_name, 'Unknown')"))
    return _by(
        named, ["gc_name"],
        "count(1) AS project_count",
        f"{exact_sum('contract_value')} AS total_contract_value",
        f"{exact_sum(AT_RISK)} AS total_at_risk",
        f"{exact_sum('co_pending_value')} AS total_pending_cos",
        f"{exact_sum('co_rejected_value')} AS total_rejected_cos",
    )


def gc_projects(briefs: DataFrame) -> DataFrame:
    """The projects behind each contractor, as rows: a contractor may hold any number."""
    return briefs.selectExpr(
        "COALESCE(gc_name, 'Unknown') AS gc_name", "id AS project_id", "name AS project_name",
        "realized_margin AS realized_margin_pct", "co_pending_value AS pending_co_value",
        "co_rejected_value AS rejected_co_value",
    )


def sector_cause_counts(briefs: DataFrame) -> DataFrame:
    rows = with_portfolio_sector(briefs).selectExpr("sector", "explode(root_causes.label) AS label")
    return _by(rows, ["sector", "label"], "count(1) AS projects")


def projects_by_sector(briefs: DataFrame) -> DataFrame:
    """Totals per sector with its three most common causes."""
    totals = _by(
        with_portfolio_sector(briefs), ["sector"],
        "count(1) AS project_count",
        f"{exact_sum(AT_RISK)} AS total_at_risk",
        f"COALESCE({exact_mean('realized_margin')}, 0D) AS avg_margin_pct",
    )
    common = W.partitionBy("sector").orderBy(F.col("projects").desc(), F.col("label").asc())
    top = (
        sector_cause_counts(briefs)
        .withColumn("_row", F.row_number().over(common))
        .filter("_row <= 3")
        .groupBy("sector")
        .agg(F.expr("array_sort(collect_list(struct(_row, label))).label AS common_root_causes"))
    )
    return totals.join(top, "sector", "left")


def root_cause_patterns(briefs: DataFrame, rules: Rules) -> DataFrame:
    """Count, dollars and sectors per cause; the sector list has at most six names."""
    rows = with_portfolio_sector(briefs).selectExpr("sector", "inline(root_causes)")
    per_cause = _by(
        rows, ["label"],
        "min(category) AS category",
        "count(1) AS cause_count",
        f"{exact_sum('impact_dollars')} AS total_impact_dollars",
        "array_sort(collect_set(sector)) AS sectors_affected",
    )
    return per_cause.withColumn(
        "is_likely_systemic",
        F.expr(
            f"cause_count >= {rules.systemic_projects} "
            f"OR size(sectors_affected) >= {rules.systemic_sectors}"
        ),
    )


def root_cause_aggregate(causes: DataFrame) -> DataFrame:
    return _by(
        causes, ["label"],
        "min(category) AS category",
        "count(1) AS cause_count",
        f"{exact_sum('impact_dollars')} AS total_impact",
    )


def root_cause_projects(causes: DataFrame) -> DataFrame:
    """The projects behind each cause, as rows: a cause may hold any number."""
    return causes.select("label", "project_id", "impact_dollars")


def analysis_portfolio_summary(briefs: DataFrame) -> DataFrame:
    return _agg(
        briefs,
        "count(1) AS project_count",
        *SEVERITY_COUNTS,
        f"{exact_sum('actual_cost_total - estimated_cost_total')} AS total_dollars_at_risk",
        f"{exact_sum('total_recoverable_estimate')} AS total_estimated_recoverable_dollars",
    )


def top_projects(briefs: DataFrame, order: str, n: int = 5) -> DataFrame:
    return (
        briefs.orderBy(F.col(order).desc_nulls_last(), F.col("id").asc())
        .limit(n)
        .selectExpr("id AS project_id", "name AS project_name", "severity", order)
    )


def completed_projects(briefs: DataFrame, rules: Rules) -> DataFrame:
    return briefs.filter(f"percent_billed >= {rules.stage_complete}").selectExpr(
        "id AS project_id", "percent_billed"
    )


def high_loss_projects(briefs: DataFrame, rules: Rules) -> DataFrame:
    return briefs.filter(f"realized_margin < {rules.high_loss_margin}").selectExpr(
        "id AS project_id", "realized_margin"
    )


WORTH = "COALESCE(estimated_recovery_dollars, 0D) * COALESCE(NULLIF(confidence, 0D), 0.7D)"


def top_actions_by_value(actions: DataFrame, rules: Rules) -> DataFrame:
    """The portfolio's best actions by recovery times confidence."""
    return (
        actions.withColumn("weighted_value", F.expr(WORTH))
        .orderBy(F.col("weighted_value").desc(), F.col("action_id").asc())
        .limit(rules.top_actions)
        .select("action_id", "project_id", "weighted_value")
    )


def urgency_rank(urgency: str = "urgency") -> str:
    whens = " ".join(f"WHEN '{u}' THEN {i}" for i, u in enumerate(URGENCY_ORDER))
    return f"CASE {urgency} {whens} ELSE {len(URGENCY_ORDER)} END"


def top_actions(rows: DataFrame, n: int = 8) -> DataFrame:
    """Best expected value first, then urgency; `action_rank` numbers the n rows kept."""
    worth = "COALESCE(NULLIF(expected_value, 0D), estimated_recovery_dollars, 0D)"
    best = (
        rows.withColumn("_worth", F.expr(worth))
        .withColumn("_urgency", F.expr(urgency_rank()))
        .orderBy(F.col("_worth").desc(), "_urgency", "project_id", "priority")
        .limit(n)
    )
    # n rows at most: gathered into one array only to number them.
    listed = best.agg(
        F.expr(
            "array_sort(collect_list(struct(-_worth AS worth, _urgency, project_id, priority, "
            "project_name, severity, action, owner, urgency, cost_to_execute_hours, "
            "estimated_recovery_dollars, expected_value))) AS best"
        )
    )
    return listed.selectExpr("posexplode(best) AS (pos, b)").selectExpr(
        "CAST(pos + 1 AS BIGINT) AS action_rank", "b.project_id", "b.project_name",
        "b.severity", "b.priority", "b.action", "b.owner", "b.urgency",
        "b.cost_to_execute_hours", "b.estimated_recovery_dollars", "b.expected_value",
    )


def owner_hours(top: DataFrame) -> DataFrame:
    urgent = top.filter("urgency IN ('immediate', 'this_week')")
    return _by(urgent, ["owner"], f"{exact_sum('cost_to_execute_hours')} AS hours")


def week_plan(top: DataFrame) -> DataFrame:
    """The first five urgent actions of the top list, Monday to Friday."""
    urgent = top.filter("urgency IN ('immediate', 'this_week')").agg(
        F.expr("slice(array_sort(collect_list(struct(action_rank, project_id, project_name, "
               "action, owner, cost_to_execute_hours, expected_value))), 1, 5) AS plan")
    )
    days = ", ".join(f"'{d}'" for d in WEEK_DAYS)
    return urgent.selectExpr("posexplode(plan) AS (pos, a)").selectExpr(
        f"element_at(array({days}), pos + 1) AS day", "a.project_id", "a.project_name",
        "a.action AS action_summary", "a.owner", "a.cost_to_execute_hours AS hours_required",
        "a.expected_value AS expected_recovery",
    )


def portfolio_brief(rows: DataFrame, top: DataFrame) -> DataFrame:
    urgent = "urgency IN ('immediate', 'this_week')"
    month = "urgency IN ('immediate', 'this_week', 'this_month')"
    pick = lambda cond: f"COALESCE({exact_sum(f'CASE WHEN {cond} THEN expected_value END')}, 0D)"
    cash = _agg(top, f"{pick(urgent)} AS cash_this_week", f"{pick(month)} AS cash_in_30_days")
    totals = _agg(
        rows,
        f"COALESCE({exact_sum('expected_value')}, 0D) AS achievable_recovery",
        f"COALESCE({exact_sum('estimated_recovery_dollars')}, 0D) AS theoretical_recovery",
    )
    return totals.withColumn(
        "_cash", cash.select(F.struct("cash_this_week", "cash_in_30_days")).scalar()
    ).selectExpr("achievable_recovery", "theoretical_recovery", "_cash.*")


# The sentences of the next three functions.


def deprioritize(briefs: DataFrame) -> DataFrame:
    loss = "abs(least(0D, current_margin_dollars))"
    return briefs.filter(
        f"project_stage = 'complete' AND {loss} > 0 "
        f"AND total_recoverable_estimate < {loss} * 0.15D"
    ).selectExpr(
        "id AS project_id", "name AS project_name",
        "'Project is effectively in closeout with limited upside beyond retention or unresolved "
        "commercial paper.' AS reason",
        "total_recoverable_estimate AS theoretical_recovery",
        "'Limit effort to retention and unresolved change orders.' AS recommended_action",
    )


def top_systemic_issue(causes: DataFrame) -> DataFrame:
    """The most common cause as a sentence; always one row."""
    counts = _by(causes, ["label"], "count(1) AS projects")
    return (
        counts.orderBy(F.col("projects").desc(), F.col("label").asc())
        .limit(1)
        .agg(F.expr(f"COALESCE(max(label), '{NO_CAUSE}') AS label"))
        .selectExpr(
            "'Top systemic issue' AS title",
            "label || ' is the most common pattern across flagged projects.' AS description",
        )
    )


def blockers(briefs: DataFrame) -> DataFrame:
    seen = _agg(
        briefs,
        "COALESCE(bool_or(co_rejected_value > 0), false) AS rejected",
        "COALESCE(bool_or(billing_data_available AND billing_gap > 0.05), false) AS trapped",
    )
    texts = (
        "concat(CASE WHEN rejected THEN array('Executive escalation is needed on rejected "
        "commercial items.') ELSE array() END, CASE WHEN trapped THEN array('Cash is trapped "
        "behind percent-complete certification and invoice timing.') ELSE array() END)"
    )
    fallback = "array('Project teams need a tighter owner-by-owner action cadence.')"
    return seen.selectExpr(
        f"explode(CASE WHEN size({texts}) = 0 THEN {fallback} ELSE {texts} END) AS blocker"
    )


def api_summary(summary: DataFrame, briefs: DataFrame) -> DataFrame:
    """Portfolio header: indicators of all projects and totals of the flagged ones."""
    flagged = _agg(
        briefs,
        "count_if(severity = 'critical') AS critical_count",
        f"COALESCE({exact_sum('money_at_risk')}, 0D) AS total_exposure",
    )
    recoverable = _agg(
        briefs.selectExpr("inline(recovery_actions)"),
        f"COALESCE({exact_sum('expected_value')}, 0D) AS total_recoverable",
    )
    return summary.withColumn(
        "_flagged", flagged.select(F.struct("critical_count", "total_exposure")).scalar()
    ).withColumn("total_recoverable", recoverable.scalar()).selectExpr(
        "total_projects", "total_contract AS total_value", "avg_bid_margin",
        "avg_realized_margin", "total_flagged AS flagged_count", "_flagged.critical_count",
        "_flagged.total_exposure", "total_recoverable",
    )


def ranked_projects(briefs: DataFrame) -> DataFrame:
    """Attention list, then all projects by priority; a project keeps its first place."""
    attention = top_projects(briefs, "sort_key").selectExpr(
        "project_id", "0 AS source", "sort_key AS score"
    )
    everyone = briefs.selectExpr("id AS project_id", "1 AS source", "priority_score AS score")
    first = W.partitionBy("project_id").orderBy("source")
    return (
        attention.unionByName(everyone)
        .withColumn("_row", F.row_number().over(first))
        .filter("_row <= 1")
        .drop("_row")
    )


# ---- planning formulas ------------------------------------------------------------


def action_roi(actions: DataFrame, rules: Rules) -> DataFrame:
    effort = " ".join(f"WHEN '{e}' THEN {h}D" for e, h in rules.effort_hours.items())
    hours = (
        f"COALESCE(cost_to_execute_hours, CASE effort {effort} ELSE {rules.default_hours}D END)"
    )
    return actions.selectExpr(
        "*", f"{hours} AS hours", "estimated_recovery_dollars * confidence AS weighted_recovery"
    ).selectExpr("*", "try_divide(weighted_recovery, hours) AS roi_score")


def gc_bundles(by_gc: DataFrame, rules: Rules) -> DataFrame:
    return by_gc.withColumn(
        "bundle_value", F.expr("total_pending_cos + total_rejected_cos")
    ).filter(
        f"project_count >= {rules.gc_bundle_projects} "
        f"AND bundle_value > {rules.gc_bundle_dollars}"
    )


def systemic_issues(briefs: DataFrame, rules: Rules) -> DataFrame:
    """Causes seen in many projects, or often within one sector."""
    per_sector = sector_cause_counts(briefs)
    return _by(
        per_sector, ["label"],
        "sum(projects) AS cause_count",
        "max(projects) AS most_in_one_sector",
    ).filter(
        f"cause_count >= {rules.systemic_projects} "
        f"OR most_in_one_sector >= {rules.systemic_sectors}"
    )


def resource_conflicts(roi: DataFrame, rules: Rules) -> DataFrame:
    whens = " ".join(f"WHEN '{o}' THEN {h}D" for o, h in rules.capacity_hours.items())
    urgent = roi.filter("urgency IN ('immediate', 'this_week')")
    return (
        _by(urgent, ["owner"], f"{exact_sum('hours')} AS hours_needed")
        .withColumn("capacity_hours", F.expr(f"CASE owner {whens} END"))
        .withColumn("load_ratio", F.expr("try_divide(hours_needed, capacity_hours)"))
        .withColumn("is_overloaded", F.expr(f"COALESCE(load_ratio > {rules.overload_ratio}, false)"))
    )


def strategic_triage(briefs: DataFrame) -> DataFrame:
    """Almost fully billed at a heavy loss, or little to recover against the loss."""
    loss = "greatest(0D, -current_margin_dollars)"
    spent = "(percent_billed > 0.90 AND realized_margin < -0.50)"
    little = f"({loss} > 0 AND total_recoverable_estimate < 0.05D * {loss})"
    return briefs.filter(f"{spent} OR {little}").selectExpr(
        "id AS project_id", f"COALESCE({spent}, false) AS billed_at_heavy_loss",
        f"COALESCE({little}, false) AS little_to_recover", "total_recoverable_estimate",
        f"{loss} AS loss",
    )


def recovery_kind(actions: DataFrame) -> DataFrame:
    """Splits change orders into approved, pending and rejected for the discount table."""
    return actions.withColumn(
        "discount_kind",
        F.expr(
            "CASE WHEN recovery_type = 'change_order' AND confidence <= 0.3 "
            "THEN 'rejected_change_order' WHEN recovery_type = 'change_order' "
            "THEN 'pending_change_order' ELSE recovery_type END"
        ),
    )


def cash_flow(actions: DataFrame, rules: Rules) -> DataFrame:
    odds = " ".join(f"WHEN '{k}' THEN {p}D" for k, p in rules.type_probability.items())
    discounted = recovery_kind(actions).selectExpr(
        "CASE WHEN time_to_cash_days <= 7 THEN 'week_1' "
        "WHEN time_to_cash_days <= 30 THEN 'weeks_2_to_4' "
        "WHEN time_to_cash_days <= 60 THEN 'month_2' WHEN time_to_cash_days <= 90 "
        "THEN 'month_3' ELSE 'beyond_90_days' END AS bucket",
        "estimated_recovery_dollars",
        f"estimated_recovery_dollars * CASE discount_kind {odds} ELSE confidence END AS discounted",
    )
    return _by(
        discounted, ["bucket"], "count(1) AS actions",
        f"{exact_sum('estimated_recovery_dollars')} AS gross_recovery",
        f"{exact_sum('discounted')} AS expected_recovery",
    )


def achievability(plan: DataFrame, systemic: DataFrame) -> DataFrame:
    """Expected recovery less systemic causes and less what capacity defers.

    `plan` holds every action with `is_planned`; urgent actions left out are deferred.
    """
    labels = systemic.select(F.col("label").alias("linked_root_cause"), F.lit(True).alias("sys"))
    marked = plan.join(labels, "linked_root_cause", "left").selectExpr(
        "estimated_recovery_dollars", "weighted_recovery",
        "CASE WHEN sys AND recovery_type = 'operational' THEN weighted_recovery END AS stuck",
        "CASE WHEN NOT COALESCE(sys AND recovery_type = 'operational', false) AND NOT is_planned "
        "AND urgency IN ('immediate', 'this_week') THEN weighted_recovery END AS deferred",
    )
    return _agg(
        marked,
        f"COALESCE({exact_sum('estimated_recovery_dollars')}, 0D) AS theoretical",
        f"COALESCE({exact_sum('weighted_recovery')}, 0D) AS expected",
        f"COALESCE({exact_sum('stuck')}, 0D) AS non_recoverable",
        f"COALESCE({exact_sum('deferred')}, 0D) AS deferred",
    ).selectExpr(
        "*", "expected - non_recoverable - deferred AS achievable"
    ).selectExpr("*", "try_divide(achievable, theoretical) AS achievability_rate")
