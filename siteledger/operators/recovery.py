"""Deterministic root causes, recovery actions and briefs, one row per project.

A project has at most three causes and five actions, so they stay in arrays on the
project row: every brief below is a projection, without a shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siteledger.functions.sql import percent, ratio, sector, short_dollars
from siteledger.rules import (
    SECTORS_PROJECT, SECTORS_PROJECT_DEFAULT, URGENCY_FACTOR, Rules,
)


def stage_case(share: str, rules: Rules) -> str:
    return (
        f"CASE WHEN {share} >= {rules.stage_complete}D THEN 'complete' "
        f"WHEN {share} >= {rules.stage_late}D THEN 'late' "
        f"WHEN {share} >= {rules.stage_active}D THEN 'active' ELSE 'early' END"
    )


def project_base(flagged: DataFrame, rules: Rules) -> DataFrame:
    """The flagged row in project terms: margins, money at risk, stage, retention."""
    progress = f"COALESCE(pct_complete, least({ratio('actual_tracked_cost', 'total_budget')}, 1D), 0D)"
    return (
        flagged.selectExpr(
            "project_id AS id",
            "project_name AS name",
            f"{sector('project_name', SECTORS_PROJECT, SECTORS_PROJECT_DEFAULT)} AS sector",
            "gc_name",
            "COALESCE(original_contract_value, 0D) AS contract_value",
            "bid_margin",
            "realized_margin_pct AS realized_margin",
            "CASE WHEN lower(trim(severity)) IN ('critical', 'warning', 'watch') "
            "THEN lower(trim(severity)) ELSE 'watch' END AS severity",
            "fired_triggers",
            "est_labor AS labor_budget",
            "actual_labor_cost AS labor_actual",
            "est_material AS material_budget",
            "actual_material_cost AS material_actual",
            "billing_data_available",
            "CASE WHEN billing_data_available THEN billing_gap_pct END AS billing_gap",
            "CASE WHEN billing_data_available THEN pct_billed END AS percent_billed",
            f"{progress} AS percent_complete",
            "co_approved_value",
            "pending_co_value AS co_pending_value",
            "co_rejected_value",
            "0D AS trigger_score",
            "false AS should_realert",
        )
        .selectExpr(
            "*",
            "realized_margin - bid_margin AS margin_delta",
            "contract_value * realized_margin AS realized_margin_dollars",
            "labor_budget + material_budget AS estimated_cost_total",
            "labor_actual + material_actual AS actual_cost_total",
            "labor_actual - labor_budget AS labor_overrun",
            "material_actual - material_budget AS material_overrun",
            f"COALESCE(contract_value * percent_billed * {rules.retention_rate}D, 0D) "
            "AS retention_held",
            f"{stage_case('COALESCE(percent_billed, percent_complete)', rules)} AS project_stage",
        )
        .selectExpr(
            "*",
            "greatest(0D, actual_cost_total - estimated_cost_total) AS money_at_risk",
            "CASE WHEN contract_value <> 0 THEN contract_value - actual_cost_total ELSE 0D END "
            "AS current_margin_dollars",
        )
    )


UNBILLED = "greatest(0D, COALESCE(contract_value * billing_gap, 0D))"


def _cause(label: str, category: str, impact: str, confidence: float, rank: int,
           evidence: str, summary: str) -> str:
    return (
        f"CASE WHEN {impact} > 0 THEN named_struct('rule', {rank}, 'label', '{label}', "
        f"'category', '{category}', 'impact_dollars', {impact}, 'confidence', {confidence}D, "
        f"'evidence', array({evidence}), 'summary', {summary}) END"
    )


def root_causes(base: DataFrame) -> DataFrame:
    """Adds `root_causes`: the three largest by dollars."""
    commercial = "greatest(0D, co_pending_value + co_rejected_value)"
    versus = lambda kind: (
        f"'{kind} actual ' || {short_dollars(kind.lower() + '_actual')} || ' vs estimate ' || "
        f"{short_dollars(kind.lower() + '_budget')} || '.'"
    )
    head = lambda label, impact, noun: f"'{label} | ' || {short_dollars(impact)} || ' {noun} | ' || "
    done, billed = percent("percent_complete"), percent("percent_billed")
    causes = [
        _cause("Labor Overrun", "labor", "labor_overrun", 0.65, 1, versus("Labor"),
               head("Labor Overrun", "labor_overrun", "impact") + versus("Labor")),
        _cause("Material Overrun", "material", "material_overrun", 0.60, 2, versus("Material"),
               head("Material Overrun", "material_overrun", "impact") + versus("Material")),
        _cause("Underbilling / Cash Lag", "billing", UNBILLED, 0.70, 3,
               f"'Project is ' || {done} || ' complete but only ' || {billed} || ' billed.'",
               head("Underbilling / Cash Lag", UNBILLED, "opportunity")
               + f"{done} || ' complete vs ' || {billed} || ' billed.'"),
        _cause("Change Order Recovery Failure", "change_order", commercial, 0.58, 4,
               "'Pending + rejected change-order exposure totals ' || "
               f"{short_dollars(commercial)} || '.'",
               head("Change Order Recovery Failure", commercial, "exposure")
               + "'Pending + rejected change-order value remains unresolved.'"),
    ]
    largest_first = (
        "(a, b) -> CASE WHEN a.impact_dollars > b.impact_dollars THEN -1 "
        "WHEN a.impact_dollars < b.impact_dollars THEN 1 WHEN a.rule < b.rule THEN -1 ELSE 1 END"
    )
    listed = f"filter(array({', '.join(causes)}), c -> c IS NOT NULL)"
    return base.withColumn(
        "root_causes", F.expr(f"slice(array_sort({listed}, {largest_first}), 1, 3)")
    )


def _action(rule: int, when: str, action: str, owner: str, logic: str, amount: str,
            urgency: str, effort: str, days: str, cause: str, hours: int, odds: str,
            kind: str, blockers: str) -> str:
    return (
        f"CASE WHEN {when} THEN named_struct('rule', {rule}, 'id', 'action-{rule}', "
        f"'action', {action}, 'owner', {owner}, 'financial_logic', {logic}, "
        f"'estimated_recovery_dollars', {amount}, 'urgency', '{urgency}', 'effort', '{effort}', "
        f"'time_to_cash_days', CAST({days} AS BIGINT), 'linked_root_cause', '{cause}', "
        f"'cost_to_execute_hours', {hours}D, 'expected_value', {amount} * {odds}, "
        f"'recovery_type', '{kind}', 'probability_of_success', {odds}, "
        f"'blocking_items', array({blockers})) END"
    )


def recovery_actions(base: DataFrame) -> DataFrame:
    """Adds `recovery_actions`: up to five, best expected value first."""
    rejected_first = "(co_rejected_value >= co_pending_value AND co_rejected_value > 0)"
    pick = lambda a, b: f"(CASE WHEN {rejected_first} THEN {a} ELSE {b} END)"
    pursuit = pick("co_rejected_value", "co_pending_value")
    running = "project_stage IN ('early', 'active')"
    labor = "least(labor_overrun * 0.2D, greatest(contract_value * 0.03D, 25000D))"
    material = "least(material_overrun * 0.15D, greatest(contract_value * 0.02D, 15000D))"
    gap = percent("billing_gap")
    actions = [
        _action(1, f"billing_data_available AND {UNBILLED} > 0",
                f"'Submit catch-up billing for the ' || {gap} || ' earned-but-unbilled gap.'",
                "'Finance'",
                f"'Work is ahead of billing by ' || {gap} || ', leaving ' || "
                f"{short_dollars(UNBILLED)} || ' earned but not yet invoiced.'",
                UNBILLED, "immediate", "low", "14", "Underbilling / Cash Lag", 2, "0.95D",
                "billing", "'Percent-complete signoff'"),
        _action(2, "co_pending_value > 0 OR co_rejected_value > 0",
                pick("'Escalate the largest unresolved commercial package and resubmit with "
                     "field evidence.'",
                     "'Package pending change orders into a single decision-ready commercial "
                     "package.'"),
                pick("'Executive'", "'Project Manager'"),
                f"'Unresolved commercial exposure totals ' || {short_dollars(pursuit)} || "
                "' and is the cleanest non-operational recovery lever left.'",
                pursuit, "this_week", "medium", pick("45", "30"),
                "Change Order Recovery Failure", 8, pick("0.3D", "0.6D"), "change_order",
                "'Backup documentation', "
                + pick("'Executive signoff'", "'Owner response'")),
        _action(3, "billing_data_available AND retention_held > 0 "
                "AND project_stage IN ('late', 'complete')",
                "'Prepare and submit retention release package.'", "'Finance'",
                f"'Retention of ' || {short_dollars('retention_held')} || "
                "' is tied up and should convert once closeout conditions are satisfied.'",
                "retention_held", "this_month", "low", "30", "Underbilling / Cash Lag", 2,
                "0.85D", "retention", "'Closeout paperwork'"),
        _action(4, f"{running} AND labor_overrun > 25000",
                "'Reset the labor plan on the highest-variance scopes and cut overtime-driven "
                "bleed.'", "'Operations'",
                f"'Labor is already over by ' || {short_dollars('labor_overrun')} || "
                f"'; a production reset can still protect roughly ' || {short_dollars(labor)} || "
                "' on unfinished work.'",
                labor, "immediate", "medium", "21", "Labor Overrun", 8, "0.5D", "operational",
                "'Updated reforecast', 'Crew plan approval'"),
        _action(5, f"{running} AND material_overrun > 25000",
                "'Audit remaining buyout and freeze non-essential material spend on open "
                "commitments.'", "'Project Manager'",
                f"'Material is over by ' || {short_dollars('material_overrun')} || "
                "'; tightening open commitments can still protect about ' || "
                f"{short_dollars(material)} || '.'",
                material, "this_week", "medium", "30", "Material Overrun", 8, "0.45D",
                "operational", "'Vendor quote review'"),
    ]
    worth = lambda v: f"COALESCE(NULLIF({v}.expected_value, 0D), {v}.estimated_recovery_dollars, 0D)"
    best_first = (
        f"(a, b) -> CASE WHEN {worth('a')} > {worth('b')} THEN -1 "
        f"WHEN {worth('a')} < {worth('b')} THEN 1 WHEN a.rule < b.rule THEN -1 ELSE 1 END"
    )
    listed = f"filter(array({', '.join(actions)}), a -> a IS NOT NULL)"
    return base.withColumn("recovery_actions", F.expr(f"array_sort({listed}, {best_first})"))


def cause_rows(projects: DataFrame) -> DataFrame:
    return projects.selectExpr(
        "id AS project_id", "sector", "posexplode(root_causes) AS (pos, c)"
    ).selectExpr(
        "project_id", "sector", "CAST(pos + 1 AS BIGINT) AS cause_rank", "c.label", "c.category",
        "c.impact_dollars", "c.confidence", "c.evidence", "c.summary",
    )


def action_rows(projects: DataFrame) -> DataFrame:
    return projects.selectExpr(
        "id AS project_id", "name AS project_name", "severity",
        "posexplode(recovery_actions) AS (pos, a)",
    ).selectExpr(
        "project_id", "project_name", "severity", "CAST(pos + 1 AS BIGINT) AS priority", "a.id",
        "a.action", "a.owner", "a.financial_logic", "a.estimated_recovery_dollars", "a.urgency",
        "a.effort", "a.time_to_cash_days", "a.linked_root_cause", "a.cost_to_execute_hours",
        "a.expected_value", "a.recovery_type", "a.probability_of_success", "a.blocking_items",
    )


def normalize_actions(actions: DataFrame, default_confidence: float = 0.7) -> DataFrame:
    """Defaults for actions that come from a document rather than from the rules."""
    return actions.selectExpr(
        "project_id",
        "COALESCE(id, 'action-' || CAST(priority AS STRING)) AS id",
        "priority",
        "trim(COALESCE(action, '')) AS action",
        "COALESCE(owner, 'Project Manager') AS owner",
        "COALESCE(urgency, 'this_month') AS urgency",
        "COALESCE(estimated_recovery_dollars, 0D) AS amount",
        f"COALESCE(probability_of_success, {default_confidence}D) AS probability_of_success",
        "COALESCE(expected_value, COALESCE(estimated_recovery_dollars, 0D) * "
        f"COALESCE(probability_of_success, {default_confidence}D)) AS expected_value",
    )


def normalize_causes(causes: DataFrame) -> DataFrame:
    """Label default, cleaned evidence and a one-line summary."""
    label = "COALESCE(NULLIF(trim(label), ''), 'Unspecified issue')"
    proof = "filter(transform(evidence, e -> trim(e)), e -> e <> '')"
    impact = f"CASE WHEN impact_dollars > 0 THEN {short_dollars('impact_dollars')} || ' impact' END"
    return causes.selectExpr(
        "project_id", "cause_rank", f"{label} AS label",
        "COALESCE(trim(category), 'unknown') AS category", "impact_dollars", "confidence",
        f"{proof} AS evidence",
        f"concat_ws(' | ', {label}, {impact}, get({proof}, 0)) AS summary",
    )


def _total(condition: str = "true") -> str:
    amounts = f"filter(recovery_actions, a -> {condition})"
    return (
        f"CAST(aggregate({amounts}, CAST(0 AS DECIMAL(38,6)), (s, a) -> "
        "CAST(s + CAST(a.estimated_recovery_dollars AS DECIMAL(28,6)) AS DECIMAL(38,6))) "
        "AS DOUBLE)"
    )


def project_mode(stage: str, recovery_type: str) -> str:
    return (
        f"CASE WHEN {stage} = 'complete' THEN 'closeout_only' "
        f"WHEN {recovery_type} IN ('billing', 'retention') THEN 'accelerate_cash' "
        f"WHEN {recovery_type} IN ('change_order', 'claim') THEN 'commercial_recovery' "
        f"WHEN {recovery_type} = 'operational' THEN 'protect_margin' "
        f"WHEN {stage} = 'late' THEN 'commercial_recovery' ELSE 'protect_margin' END"
    )


def project_briefs(projects: DataFrame) -> DataFrame:
    """Mode, recovery by timing, profit impact, headline and forecasts."""
    money = short_dollars
    now = _total("a.urgency = 'immediate'")
    soon = _total("a.urgency IN ('this_week', 'this_month')")
    later = _total("a.urgency NOT IN ('immediate', 'this_week', 'this_month')")
    facts = projects.selectExpr(
        "*",
        "get(recovery_actions, 0) AS primary_action",
        f"{_total()} AS total_recoverable_estimate",
        f"NULLIF({now}, 0D) AS recovery_immediate",
        f"NULLIF({soon}, 0D) AS recovery_near_term",
        f"NULLIF({later}, 0D) AS recovery_long_term",
        "CASE WHEN current_margin_dollars < 0 THEN abs(current_margin_dollars) END "
        "AS break_even_recovery_needed",
    ).selectExpr(
        "*",
        f"{project_mode('project_stage', 'primary_action.recovery_type')} AS project_mode",
        "current_margin_dollars + total_recoverable_estimate AS projected_margin_dollars",
        "COALESCE(recovery_immediate, 0D) + COALESCE(recovery_near_term, 0D) AS cash_in_30_days",
        "COALESCE(primary_action.estimated_recovery_dollars, 0D) AS primary_amount",
    )
    recoverable, primary = money("total_recoverable_estimate"), money("primary_amount")
    return facts.selectExpr(
        "*",
        "CASE project_mode "
        f"WHEN 'accelerate_cash' THEN 'Cash is trapped on this job. Fastest path is recovering ' "
        f"|| {recoverable} || ' through billing and closeout actions.' "
        "WHEN 'commercial_recovery' THEN 'Commercial recovery is now the main lever. The best "
        f"remaining upside is ' || {recoverable} || '.' "
        "WHEN 'closeout_only' THEN 'Operational fixes are mostly gone. Focus the team on ' || "
        f"{recoverable} || ' of closeout recovery.' "
        "ELSE 'Margin is still protectable on this project. The highest-value next move is worth '"
        f" || {primary} || '.' END AS headline",
        "CASE WHEN current_margin_dollars < 0 THEN 'Without action, this project is on track to "
        f"close at a loss of ' || {money('abs(current_margin_dollars)')} || '.' "
        "ELSE 'Without action, margin likely stays near ' || "
        f"{money('current_margin_dollars')} || ' with limited upside.' END "
        "AS forecast_if_no_action",
        "'With focused execution, the project can recover ' || "
        f"{recoverable} || ' and move to ' || {money('projected_margin_dollars')} || "
        "' in projected margin dollars.' AS forecast_with_action",
    ).selectExpr(
        "*",
        "headline || ' Primary move: ' || "
        "COALESCE(primary_action.action, 'No primary action identified.') || ' (' || "
        f"{primary} || ' opportunity).' AS executive_brief",
        f"{sort_key()} AS sort_key",
        f"{priority_score()} AS priority_score",
    )


def sort_key() -> str:
    """Attention order of projects: value of the first action, money at risk, alerts."""
    urgency = " ".join(f"WHEN '{u}' THEN {f}D" for u, f in URGENCY_FACTOR.items())
    return (
        "COALESCE(NULLIF(primary_action.expected_value, 0D), "
        "primary_action.estimated_recovery_dollars, 0D) * "
        f"CASE primary_action.urgency {urgency} ELSE 1.0D END + money_at_risk "
        "+ trigger_score * 1000D + CASE WHEN should_realert THEN 50000D ELSE 0D END"
    )


def priority_score() -> str:
    value = (
        "COALESCE(primary_action.expected_value, primary_action.estimated_recovery_dollars, 0D)"
    )
    share = lambda x, weight: (
        f"CASE WHEN contract_value > 0 THEN try_divide({x}, contract_value) * 100D * {weight}D "
        "ELSE 0D END"
    )
    return (
        "abs(margin_delta) * 100D + COALESCE(billing_gap, 0D) * 100D * 0.6D + "
        f"{share('(labor_overrun + material_overrun)', 0.4)} + {share(value, 1.1)} + "
        f"CASE WHEN {value} > 0 THEN greatest(0D, 20D - least("
        "CAST(COALESCE(primary_action.time_to_cash_days, 45) AS DOUBLE), 20D)) ELSE 0D END"
    )


def apply_analysis(projects: DataFrame, analyses: DataFrame) -> DataFrame:
    """Overlays the newest analysis of each project; its fields win where stated.

    `analyses`: project_id, analyzed_on, headline, project_stage, retention_held,
    total_recoverable_estimate, confidence.
    """
    newest = W.partitionBy("project_id").orderBy(
        F.col("analyzed_on").desc_nulls_last(), F.col("headline").asc_nulls_last()
    )
    latest = (
        analyses.withColumn("_row", F.row_number().over(newest))
        .filter("_row <= 1")
        .selectExpr(
            "project_id AS id", "headline AS a_headline", "project_stage AS a_stage",
            "retention_held AS a_retention", "confidence AS a_confidence",
            "total_recoverable_estimate AS a_total",
        )
    )
    return (
        projects.join(latest, "id", "left")
        .withColumns(
            {
                "headline": F.expr("COALESCE(a_headline, headline)"),
                "project_stage": F.expr("COALESCE(a_stage, project_stage)"),
                "retention_held": F.expr("COALESCE(a_retention, retention_held)"),
                "total_recoverable_estimate": F.expr(
                    "COALESCE(a_total, total_recoverable_estimate)"
                ),
                "analysis_confidence": F.expr("COALESCE(a_confidence, 0.55D)"),
            }
        )
        .drop("a_headline", "a_stage", "a_retention", "a_confidence", "a_total")
    )


def action_queue(briefs: DataFrame) -> DataFrame:
    """Primary, next three and remaining actions, without repeats, first five."""
    queue = (
        "slice(array_distinct(concat(slice(recovery_actions, 1, 1), "
        "slice(recovery_actions, 2, 3), recovery_actions)), 1, 5)"
    )
    return briefs.filter("size(recovery_actions) > 0").selectExpr(
        "id AS project_id", f"posexplode({queue}) AS (pos, a)"
    ).selectExpr("project_id", "CAST(pos + 1 AS BIGINT) AS queue_rank", "a.id", "a.action")
