"""Queries over root causes, recovery actions, briefs and the portfolio."""

from __future__ import annotations

from functools import partial

from pyspark.sql import functions as F

from siteledger.operators import causes, flags, planning, portfolio, recovery
from siteledger.plans import catalog
from siteledger.plans.oracle_views import (
    SECTOR_A, SECTOR_B, dsum, pct_text, rmean, short_usd, view,
)

# ---- project base, causes, actions ---------------------------------------------------

_STAGE = """CASE WHEN COALESCE(percent_billed, percent_complete) >= 0.95 THEN 'complete'
  WHEN COALESCE(percent_billed, percent_complete) >= 0.75 THEN 'late'
  WHEN COALESCE(percent_billed, percent_complete) >= 0.15 THEN 'active' ELSE 'early' END"""
query = partial(catalog.query, share=True)

view("v_base", f"""
SELECT *, greatest(0, actual_cost_total - estimated_cost_total) AS money_at_risk,
  CASE WHEN contract_value <> 0 THEN contract_value - actual_cost_total ELSE 0 END
    AS current_margin_dollars
FROM (SELECT *, realized_margin - bid_margin AS margin_delta,
    contract_value * realized_margin AS realized_margin_dollars,
    labor_budget + material_budget AS estimated_cost_total,
    labor_actual + material_actual AS actual_cost_total,
    labor_actual - labor_budget AS labor_overrun,
    material_actual - material_budget AS material_overrun,
    COALESCE(contract_value * percent_billed * 0.1::DOUBLE, 0) AS retention_held,
    {_STAGE} AS project_stage
  FROM (SELECT project_id AS id, project_name AS name, {SECTOR_B} AS sector, gc_name,
      COALESCE(original_contract_value, 0) AS contract_value, bid_margin,
      realized_margin_pct AS realized_margin, lower(severity) AS severity, fired_triggers,
      est_labor AS labor_budget, actual_labor_cost AS labor_actual,
      est_material AS material_budget, actual_material_cost AS material_actual,
      billing_data_available,
      CASE WHEN billing_data_available THEN billing_gap_pct END AS billing_gap,
      CASE WHEN billing_data_available THEN pct_billed END AS percent_billed,
      COALESCE(pct_complete, least(actual_tracked_cost / NULLIF(total_budget, 0), 1), 0)
        AS percent_complete,
      co_approved_value, pending_co_value AS co_pending_value, co_rejected_value,
      CAST(0 AS DOUBLE) AS trigger_score, FALSE AS should_realert
    FROM v_flagged))""")
_UNBILLED = "greatest(0, COALESCE(contract_value * billing_gap, 0))"
_CO = "greatest(0, co_pending_value + co_rejected_value)"


def _versus(kind: str) -> str:
    k = kind.lower()
    return (f"'{kind} actual ' || {short_usd(k + '_actual')} || ' vs estimate ' || "
            f"{short_usd(k + '_budget')} || '.'")


_DONE, _BILLED = pct_text("percent_complete"), pct_text("percent_billed")
view("v_causes", f"""
WITH raw AS (
  SELECT id, sector, name, 1 AS rule, 'Labor Overrun' AS label, 'labor' AS category,
    labor_overrun AS impact_dollars, 0.65::DOUBLE AS confidence, {_versus('Labor')} AS evidence,
    'Labor Overrun | ' || {short_usd('labor_overrun')} || ' impact | ' || {_versus('Labor')}
      AS summary FROM v_base WHERE labor_overrun > 0
  UNION ALL SELECT id, sector, name, 2, 'Material Overrun', 'material', material_overrun, 0.60,
    {_versus('Material')}, 'Material Overrun | ' || {short_usd('material_overrun')}
      || ' impact | ' || {_versus('Material')} FROM v_base WHERE material_overrun > 0
  UNION ALL SELECT id, sector, name, 3, 'Underbilling / Cash Lag', 'billing', {_UNBILLED}, 0.70,
    'Project is ' || {_DONE} || ' complete but only ' || {_BILLED} || ' billed.',
    'Underbilling / Cash Lag | ' || {short_usd(_UNBILLED)} || ' opportunity | ' || {_DONE}
      || ' complete vs ' || {_BILLED} || ' billed.' FROM v_base WHERE {_UNBILLED} > 0
  UNION ALL SELECT id, sector, name, 4, 'Change Order Recovery Failure', 'change_order', {_CO},
    0.58, 'Pending + rejected change-order exposure totals ' || {short_usd(_CO)} || '.',
    'Change Order Recovery Failure | ' || {short_usd(_CO)} || ' exposure | Pending + rejected '
      || 'change-order value remains unresolved.' FROM v_base WHERE {_CO} > 0)
SELECT id AS project_id, sector, name, cause_rank, label, category, impact_dollars, confidence,
  evidence, summary
FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY id ORDER BY impact_dollars DESC, rule)
  AS cause_rank FROM raw) WHERE cause_rank <= 3""")

_REJ = "(co_rejected_value >= co_pending_value AND co_rejected_value > 0)"
_PURSUIT = f"(CASE WHEN {_REJ} THEN co_rejected_value ELSE co_pending_value END)"
_ODDS = f"(CASE WHEN {_REJ} THEN 0.3::DOUBLE ELSE 0.6::DOUBLE END)"
_LABOR = "least(labor_overrun * 0.2::DOUBLE, greatest(contract_value * 0.03::DOUBLE, 25000))"
_MATERIAL = ("least(material_overrun * 0.15::DOUBLE, "
             "greatest(contract_value * 0.02::DOUBLE, 15000))")
_GAP = pct_text("billing_gap")
view("v_actions", f"""
WITH raw AS (
  SELECT id AS pid, name, severity, 1 AS rule,
    'Submit catch-up billing for the ' || {_GAP} || ' earned-but-unbilled gap.' AS action,
    'Finance' AS owner, 'Work is ahead of billing by ' || {_GAP} || ', leaving '
      || {short_usd(_UNBILLED)} || ' earned but not yet invoiced.' AS financial_logic,
    {_UNBILLED} AS amount, 'immediate' AS urgency, 'low' AS effort, 14 AS days,
    'Underbilling / Cash Lag' AS cause, 2 AS hours, 0.95::DOUBLE AS odds, 'billing' AS kind,
    'Percent-complete signoff' AS blocking_items
  FROM v_base WHERE billing_data_available AND {_UNBILLED} > 0
  UNION ALL SELECT id, name, severity, 2, CASE WHEN {_REJ} THEN
    'Escalate the largest unresolved commercial package and resubmit with field evidence.'
    ELSE 'Package pending change orders into a single decision-ready commercial package.' END,
    CASE WHEN {_REJ} THEN 'Executive' ELSE 'Project Manager' END,
    'Unresolved commercial exposure totals ' || {short_usd(_PURSUIT)}
      || ' and is the cleanest non-operational recovery lever left.',
    {_PURSUIT}, 'this_week', 'medium', CASE WHEN {_REJ} THEN 45 ELSE 30 END,
    'Change Order Recovery Failure', 8, {_ODDS}, 'change_order', 'Backup documentation | '
      || CASE WHEN {_REJ} THEN 'Executive signoff' ELSE 'Owner response' END
  FROM v_base WHERE co_pending_value > 0 OR co_rejected_value > 0
  UNION ALL SELECT id, name, severity, 3, 'Prepare and submit retention release package.',
    'Finance', 'Retention of ' || {short_usd('retention_held')}
      || ' is tied up and should convert once closeout conditions are satisfied.',
    retention_held, 'this_month', 'low', 30, 'Underbilling / Cash Lag', 2, 0.85, 'retention',
    'Closeout paperwork'
  FROM v_base WHERE billing_data_available AND retention_held > 0
    AND project_stage IN ('late', 'complete')
  UNION ALL SELECT id, name, severity, 4,
    'Reset the labor plan on the highest-variance scopes and cut overtime-driven bleed.',
    'Operations', 'Labor is already over by ' || {short_usd('labor_overrun')}
      || '; a production reset can still protect roughly ' || {short_usd(_LABOR)}
      || ' on unfinished work.',
    {_LABOR}, 'immediate', 'medium', 21, 'Labor Overrun', 8, 0.5, 'operational',
    'Updated reforecast | Crew plan approval'
  FROM v_base WHERE project_stage IN ('early', 'active') AND labor_overrun > 25000
  UNION ALL SELECT id, name, severity, 5,
    'Audit remaining buyout and freeze non-essential material spend on open commitments.',
    'Project Manager', 'Material is over by ' || {short_usd('material_overrun')}
      || '; tightening open commitments can still protect about ' || {short_usd(_MATERIAL)} || '.',
    {_MATERIAL}, 'this_week', 'medium', 30, 'Material Overrun', 8, 0.45, 'operational',
    'Vendor quote review'
  FROM v_base WHERE project_stage IN ('early', 'active') AND material_overrun > 25000)
SELECT pid AS project_id, name AS project_name, severity,
  ROW_NUMBER() OVER (PARTITION BY pid
    ORDER BY COALESCE(NULLIF(amount * odds, 0), amount, 0) DESC, rule) AS priority,
  'action-' || rule AS id, action, owner, financial_logic,
  amount AS estimated_recovery_dollars, urgency, effort, CAST(days AS BIGINT) AS time_to_cash_days,
  cause AS linked_root_cause, CAST(hours AS DOUBLE) AS cost_to_execute_hours,
  amount * odds AS expected_value, kind AS recovery_type, odds AS probability_of_success,
  blocking_items
FROM raw""")

query("project_base", lambda p: p.project_base, "SELECT * FROM v_base")
query("root_causes", lambda p: p.cause_rows, "SELECT * EXCLUDE (name) FROM v_causes")
query("cause_candidates",
      lambda p: p.cause_rows.select("project_id", "cause_rank", "category", "impact_dollars"),
      "SELECT project_id, cause_rank, category, impact_dollars FROM v_causes")
query("recovery_actions", lambda p: p.action_rows, "SELECT * FROM v_actions")
query("recoverability", lambda p: causes.recoverability(p.project_base), f"""
SELECT id AS project_id, {_UNBILLED} AS billing_recovery,
  co_pending_value AS change_order_recovery, retention_held AS retention_amount,
  project_stage <> 'complete' AS margin_protectable,
  {_UNBILLED} + co_pending_value + retention_held AS total_recoverable FROM v_base""")
query("normalize_action",
      lambda p: recovery.normalize_actions(p.action_rows.selectExpr(
          "project_id", "CASE WHEN priority > 1 THEN id END AS id", "priority",
          "' ' || action AS action", "CASE WHEN owner <> 'Executive' THEN owner END AS owner",
          "CASE WHEN effort = 'low' THEN urgency END AS urgency", "estimated_recovery_dollars",
          "CASE WHEN priority = 1 THEN expected_value END AS expected_value",
          "CASE WHEN recovery_type <> 'billing' THEN probability_of_success END "
          "AS probability_of_success")), """
SELECT project_id, CASE WHEN priority > 1 THEN id ELSE 'action-1' END AS id, priority, action,
  CASE WHEN owner <> 'Executive' THEN owner ELSE 'Project Manager' END AS owner,
  CASE WHEN effort = 'low' THEN urgency ELSE 'this_month' END AS urgency,
  estimated_recovery_dollars AS amount,
  CASE WHEN recovery_type <> 'billing' THEN probability_of_success ELSE 0.7::DOUBLE END
    AS probability_of_success,
  CASE WHEN priority = 1 THEN expected_value ELSE estimated_recovery_dollars
    * CASE WHEN recovery_type <> 'billing' THEN probability_of_success ELSE 0.7::DOUBLE END END
    AS expected_value
FROM v_actions""")
query("normalize_cause",
      lambda p: recovery.normalize_causes(p.cause_rows.selectExpr(
          "project_id", "cause_rank", "CASE WHEN cause_rank = 1 THEN label END AS label",
          "CASE WHEN cause_rank < 3 THEN category END AS category",
          "CASE WHEN cause_rank < 3 THEN impact_dollars END AS impact_dollars", "confidence",
          "concat(array('  '), evidence) AS evidence")), f"""
SELECT project_id, cause_rank,
  CASE WHEN cause_rank = 1 THEN label ELSE 'Unspecified issue' END AS label,
  CASE WHEN cause_rank < 3 THEN category ELSE 'unknown' END AS category,
  CASE WHEN cause_rank < 3 THEN impact_dollars END AS impact_dollars, confidence, evidence,
  concat_ws(' | ', CASE WHEN cause_rank = 1 THEN label ELSE 'Unspecified issue' END,
    CASE WHEN cause_rank < 3 THEN {short_usd('impact_dollars')} || ' impact' END, evidence)
    AS summary
FROM v_causes""")

# ---- briefs --------------------------------------------------------------------------

_FACTOR = """CASE urgency WHEN 'immediate' THEN 1.25::DOUBLE WHEN 'this_week' THEN 1.1::DOUBLE
  WHEN 'this_month' THEN 1.0::DOUBLE WHEN 'ongoing' THEN 0.85::DOUBLE ELSE 1.0::DOUBLE END"""


def _amount_if(cond: str) -> str:
    return dsum(f"CASE WHEN {cond} THEN estimated_recovery_dollars ELSE 0 END")


_NEAR = "urgency IN ('this_week', 'this_month')"
view("v_briefs", f"""
WITH sums AS (
  SELECT project_id, {dsum('estimated_recovery_dollars')} AS total,
    NULLIF({_amount_if("urgency = 'immediate'")}, 0) AS now, NULLIF({_amount_if(_NEAR)}, 0) AS near
  FROM v_actions GROUP BY 1),
facts AS (
  SELECT b.*, f.* EXCLUDE (project_id), COALESCE(total, 0) AS total_recoverable_estimate,
    now AS recovery_immediate, near AS recovery_near_term,
    CAST(NULL AS DOUBLE) AS recovery_long_term,
    CASE WHEN current_margin_dollars < 0 THEN abs(current_margin_dollars) END
      AS break_even_recovery_needed,
    CASE WHEN project_stage = 'complete' THEN 'closeout_only'
      WHEN p_kind IN ('billing', 'retention') THEN 'accelerate_cash'
      WHEN p_kind = 'change_order' THEN 'commercial_recovery'
      WHEN p_kind = 'operational' THEN 'protect_margin'
      WHEN project_stage = 'late' THEN 'commercial_recovery' ELSE 'protect_margin' END
      AS project_mode,
    current_margin_dollars + COALESCE(total, 0) AS projected_margin_dollars,
    COALESCE(now, 0) + COALESCE(near, 0) AS cash_in_30_days,
    COALESCE(p_amount, 0) AS primary_amount
  FROM v_base b LEFT JOIN sums s ON b.id = s.project_id
  LEFT JOIN (SELECT project_id, recovery_type AS p_kind, estimated_recovery_dollars AS p_amount,
      expected_value AS p_expected, action AS p_action, time_to_cash_days AS p_days,
      {_FACTOR} AS p_factor
    FROM v_actions WHERE priority = 1) f ON b.id = f.project_id),
told AS (
  SELECT *, CASE project_mode WHEN 'accelerate_cash'
      THEN 'Cash is trapped on this job. Fastest path is recovering '
        || {short_usd('total_recoverable_estimate')} || ' through billing and closeout actions.'
      WHEN 'commercial_recovery' THEN 'Commercial recovery is now the main lever. The best '
        || 'remaining upside is ' || {short_usd('total_recoverable_estimate')} || '.'
      WHEN 'closeout_only' THEN 'Operational fixes are mostly gone. Focus the team on '
        || {short_usd('total_recoverable_estimate')} || ' of closeout recovery.'
      ELSE 'Margin is still protectable on this project. The highest-value next move is worth '
        || {short_usd('primary_amount')} || '.' END AS headline,
    CASE WHEN current_margin_dollars < 0 THEN 'Without action, this project is on track to close '
        || 'at a loss of ' || {short_usd('abs(current_margin_dollars)')} || '.'
      ELSE 'Without action, margin likely stays near ' || {short_usd('current_margin_dollars')}
        || ' with limited upside.' END AS forecast_if_no_action,
    'With focused execution, the project can recover ' || {short_usd('total_recoverable_estimate')}
      || ' and move to ' || {short_usd('projected_margin_dollars')}
      || ' in projected margin dollars.' AS forecast_with_action
  FROM facts)
SELECT *, headline || ' Primary move: ' || COALESCE(p_action, 'No primary action identified.')
    || ' (' || {short_usd('primary_amount')} || ' opportunity).' AS executive_brief,
  COALESCE(NULLIF(p_expected, 0), p_amount, 0) * COALESCE(p_factor, 1) + money_at_risk
    + trigger_score * 1000 AS sort_key,
  abs(margin_delta) * 100 + COALESCE(billing_gap, 0) * 100 * 0.6::DOUBLE
    + CASE WHEN contract_value > 0 THEN (labor_overrun + material_overrun) / contract_value * 100
      * 0.4::DOUBLE ELSE 0 END
    + CASE WHEN contract_value > 0 THEN COALESCE(p_expected, p_amount, 0) / contract_value * 100
      * 1.1::DOUBLE ELSE 0 END
    + CASE WHEN COALESCE(p_expected, p_amount, 0) > 0
      THEN greatest(0, 20 - least(CAST(COALESCE(p_days, 45) AS DOUBLE), 20)) ELSE 0 END
    AS priority_score
FROM told""")

for _key, _cols in {
    "project_mode": ["project_stage", "project_mode"],
    "recovery_by_timing": ["recovery_immediate", "recovery_near_term", "recovery_long_term"],
    "profit_impact": ["current_margin_dollars", "projected_margin_dollars",
                      "total_recoverable_estimate", "break_even_recovery_needed"],
    "money_brief": ["project_mode", "recovery_immediate", "cash_in_30_days",
                    "total_recoverable_estimate", "break_even_recovery_needed"],
    "headline_forecasts": ["headline", "forecast_if_no_action", "forecast_with_action",
                           "executive_brief"],
    "project_sort_key": ["sort_key"],
    "priority_score": ["priority_score"],
}.items():
    query(_key, lambda p, cols=_cols: p.briefs.select("id", *cols),
          f"SELECT id, {', '.join(_cols)} FROM v_briefs")

query("apply_analysis",
      lambda p: recovery.apply_analysis(
          p.briefs.select("id", "headline", "project_stage", "retention_held",
                          "total_recoverable_estimate"),
          p.briefs.filter("severity = 'critical'").selectExpr(
              "id AS project_id",
              "explode(array(DATE'2024-01-01', DATE'2024-02-01')) AS analyzed_on",
              "'Reviewed: ' || headline AS headline", "project_stage", "0.8D AS confidence",
              "CAST(NULL AS DOUBLE) AS retention_held", "total_recoverable_estimate")
          .selectExpr("project_id", "analyzed_on", "retention_held", "total_recoverable_estimate",
                      "confidence", "headline || ' ' || analyzed_on AS headline",
                      "CASE WHEN analyzed_on > DATE'2024-01-15' THEN 'late' END AS project_stage")),
      """
SELECT id, CASE WHEN severity = 'critical' THEN 'Reviewed: ' || headline || ' 2024-02-01'
    ELSE headline END AS headline,
  CASE WHEN severity = 'critical' THEN 'late' ELSE project_stage END AS project_stage,
  retention_held, total_recoverable_estimate,
  CASE WHEN severity = 'critical' THEN 0.8::DOUBLE ELSE 0.55::DOUBLE END AS analysis_confidence
FROM v_briefs""")
query("action_queue", lambda p: recovery.action_queue(p.briefs),
      "SELECT project_id, priority AS queue_rank, id, action FROM v_actions WHERE priority <= 5")

# ---- portfolio -----------------------------------------------------------------------

_SEV = ", ".join(f"COUNT(*) FILTER (severity = '{s}') AS {s}_count"
                 for s in ("critical", "warning", "watch"))
_SECTOR = SECTOR_A.replace("project_name", "name")
view("v_all_actions", f"""
SELECT a.project_id || '_' || a.priority AS action_id, a.project_id, project_name, gc_name,
  {SECTOR_A} AS sector, project_stage, realized_margin AS realized_margin_pct, action, owner,
  financial_logic, estimated_recovery_dollars, urgency, effort, time_to_cash_days,
  probability_of_success AS confidence, cost_to_execute_hours, expected_value, recovery_type,
  linked_root_cause, priority AS original_priority
FROM v_actions a JOIN v_base b ON a.project_id = b.id""")
view("v_by_gc", f"""
SELECT gc_name, COUNT(*) AS project_count, {dsum('contract_value')} AS total_contract_value,
  {dsum('money_at_risk')} AS total_at_risk, {dsum('co_pending_value')} AS total_pending_cos,
  {dsum('co_rejected_value')} AS total_rejected_cos
FROM v_base GROUP BY 1""")
view("v_sector_causes", f"""
SELECT sector, label, COUNT(*) AS projects FROM (SELECT {_SECTOR} AS sector, label FROM v_causes)
GROUP BY 1, 2""")
view("v_top8", """
SELECT * FROM (SELECT ROW_NUMBER() OVER (ORDER BY
    COALESCE(NULLIF(expected_value, 0), estimated_recovery_dollars, 0) DESC,
    CASE urgency WHEN 'immediate' THEN 0 WHEN 'this_week' THEN 1 WHEN 'this_month' THEN 2
      WHEN 'ongoing' THEN 3 ELSE 4 END, project_id, priority) AS action_rank,
  project_id, project_name, severity, priority, action, owner, urgency, cost_to_execute_hours,
  estimated_recovery_dollars, expected_value FROM v_actions) WHERE action_rank <= 8""")
view("v_label_counts", f"""
SELECT label, MIN(category) AS category, COUNT(*) AS cause_count,
  {dsum('impact_dollars')} AS impact FROM v_causes GROUP BY 1""")
view("v_systemic", """
SELECT label, CAST(SUM(projects) AS BIGINT) AS cause_count, MAX(projects) AS most_in_one_sector
FROM v_sector_causes GROUP BY 1 HAVING SUM(projects) >= 5 OR MAX(projects) >= 3""")

query("portfolio_stats", lambda p: portfolio.portfolio_stats(p.briefs), f"""
SELECT COUNT(*) AS total_flagged_projects, {_SEV},
  COALESCE({dsum('contract_value')}, 0) AS total_contract_value,
  COALESCE({dsum('money_at_risk')}, 0) AS total_dollars_at_risk,
  COALESCE({dsum('total_recoverable_estimate')}, 0) AS total_theoretical_recovery,
  COALESCE({dsum('retention_held')}, 0) AS total_retention_held,
  COALESCE({dsum('co_pending_value')}, 0) AS total_pending_cos,
  COALESCE({dsum('co_rejected_value')}, 0) AS total_rejected_cos FROM v_briefs""")
query("all_actions", lambda p: p.all_actions, "SELECT * FROM v_all_actions")
query("action_enrichment", lambda p: portfolio.action_context(p.action_rows, p.flagged), """
SELECT project_id, a.id, expected_value, gc_name, co_pending_value, co_rejected_value
FROM v_actions a JOIN v_base b ON a.project_id = b.id""")
query("projects_by_gc", lambda p: p.projects_by_gc, "SELECT * FROM v_by_gc")
query("gc_projects", lambda p: portfolio.gc_projects(p.briefs), """
SELECT gc_name, id AS project_id, name AS project_name, realized_margin AS realized_margin_pct,
  co_pending_value AS pending_co_value, co_rejected_value AS rejected_co_value FROM v_base""")
query("projects_by_sector", lambda p: portfolio.projects_by_sector(p.briefs), f"""
SELECT * FROM (SELECT {_SECTOR} AS sector, COUNT(*) AS project_count,
    {dsum('money_at_risk')} AS total_at_risk, {rmean('realized_margin')} AS avg_margin_pct
  FROM v_base GROUP BY 1)
LEFT JOIN (SELECT sector, string_agg(label, ' | ' ORDER BY rn) AS common_root_causes
  FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY sector ORDER BY projects DESC, label) AS rn
    FROM v_sector_causes) WHERE rn <= 3 GROUP BY 1) USING (sector)""")
query("root_cause_patterns",
      lambda p: portfolio.root_cause_patterns(p.briefs, p.rules), """
SELECT label, category, l.cause_count, impact AS total_impact_dollars, sectors_affected,
  l.cause_count >= 5 OR n >= 3 AS is_likely_systemic
FROM v_label_counts l JOIN (SELECT label, string_agg(sector, ' | ' ORDER BY sector)
  AS sectors_affected, COUNT(*) AS n FROM v_sector_causes GROUP BY 1) USING (label)""")
query("root_cause_aggregate", lambda p: portfolio.root_cause_aggregate(p.cause_rows),
      "SELECT label, category, cause_count, impact AS total_impact FROM v_label_counts")
query("root_cause_projects", lambda p: portfolio.root_cause_projects(p.cause_rows),
      "SELECT label, project_id, impact_dollars FROM v_causes")
query("analysis_portfolio_summary", lambda p: portfolio.analysis_portfolio_summary(p.briefs), f"""
SELECT COUNT(*) AS project_count, {_SEV},
  {dsum('actual_cost_total - estimated_cost_total')} AS total_dollars_at_risk,
  {dsum('total_recoverable_estimate')} AS total_estimated_recoverable_dollars FROM v_briefs""")
query("top_projects_5",
      lambda p: portfolio.top_projects(p.briefs, "total_recoverable_estimate"), """
SELECT id AS project_id, name AS project_name, severity, total_recoverable_estimate FROM v_briefs
ORDER BY total_recoverable_estimate DESC, id LIMIT 5""")
query("top_attention_5", lambda p: portfolio.top_projects(p.briefs, "sort_key"), """
SELECT id AS project_id, name AS project_name, severity, sort_key FROM v_briefs
ORDER BY sort_key DESC, id LIMIT 5""")
query("completed_projects", lambda p: portfolio.completed_projects(p.briefs, p.rules),
      "SELECT id AS project_id, percent_billed FROM v_base WHERE percent_billed >= 0.95")
query("high_loss_projects", lambda p: portfolio.high_loss_projects(p.briefs, p.rules),
      "SELECT id AS project_id, realized_margin FROM v_base WHERE realized_margin < -0.5")
query("top_actions_50", lambda p: portfolio.top_actions_by_value(p.all_actions, p.rules), """
SELECT action_id, project_id, estimated_recovery_dollars * confidence AS weighted_value
FROM v_all_actions ORDER BY 3 DESC, 1 LIMIT 50""")
query("top_actions_8", lambda p: p.top_actions, "SELECT * FROM v_top8")
query("owner_hours", lambda p: portfolio.owner_hours(p.top_actions), f"""
SELECT owner, {dsum('cost_to_execute_hours')} AS hours FROM v_top8
WHERE urgency IN ('immediate', 'this_week') GROUP BY 1""")
query("week_plan", lambda p: portfolio.week_plan(p.top_actions), """
SELECT ['Monday', 'Tuesday', 'Wednesday', 'Thursday', 'Friday'][rn] AS day, project_id,
  project_name, action AS action_summary, owner, cost_to_execute_hours AS hours_required,
  expected_value AS expected_recovery
FROM (SELECT *, ROW_NUMBER() OVER (ORDER BY action_rank) AS rn FROM v_top8
  WHERE urgency IN ('immediate', 'this_week')) WHERE rn <= 5""")
query("portfolio_brief", lambda p: portfolio.portfolio_brief(p.action_rows, p.top_actions), f"""
SELECT COALESCE({dsum('expected_value')}, 0) AS achievable_recovery,
  COALESCE({dsum('estimated_recovery_dollars')}, 0) AS theoretical_recovery,
  (SELECT COALESCE({dsum('expected_value')}, 0) FROM v_top8
    WHERE urgency IN ('immediate', 'this_week')) AS cash_this_week,
  (SELECT COALESCE({dsum('expected_value')}, 0) FROM v_top8
    WHERE urgency IN ('immediate', 'this_week', 'this_month')) AS cash_in_30_days
FROM v_actions""")
query("deprioritize", lambda p: portfolio.deprioritize(p.briefs), """
SELECT id AS project_id, name AS project_name, 'Project is effectively in closeout with limited '
  || 'upside beyond retention or unresolved commercial paper.' AS reason,
  total_recoverable_estimate AS theoretical_recovery,
  'Limit effort to retention and unresolved change orders.' AS recommended_action
FROM v_briefs WHERE project_stage = 'complete' AND current_margin_dollars < 0
  AND total_recoverable_estimate < abs(current_margin_dollars) * 0.15::DOUBLE""")
query("top_systemic_issue", lambda p: portfolio.top_systemic_issue(p.cause_rows), """
SELECT 'Top systemic issue' AS title,
  label || ' is the most common pattern across flagged projects.' AS description
FROM v_label_counts ORDER BY cause_count DESC, label LIMIT 1""")
query("blockers", lambda p: portfolio.blockers(p.briefs), """
SELECT 'Executive escalation is needed on rejected commercial items.' AS blocker
WHERE EXISTS (SELECT 1 FROM v_base WHERE co_rejected_value > 0)
UNION ALL SELECT 'Cash is trapped behind percent-complete certification and invoice timing.'
WHERE EXISTS (SELECT 1 FROM v_base WHERE billing_gap > 0.05)
UNION ALL SELECT 'Project teams need a tighter owner-by-owner action cadence.'
WHERE NOT EXISTS (SELECT 1 FROM v_base WHERE co_rejected_value > 0 OR billing_gap > 0.05)""")
query("api_summary",
      lambda p: portfolio.api_summary(flags.portfolio_summary(p.health_table, p.rules), p.briefs), f"""
SELECT total_projects, total_contract AS total_value, avg_bid_margin, avg_realized_margin,
  (SELECT COUNT(*) FROM v_flagged) AS flagged_count,
  (SELECT COUNT(*) FROM v_base WHERE severity = 'critical') AS critical_count,
  (SELECT COALESCE({dsum('money_at_risk')}, 0) FROM v_base) AS total_exposure,
  (SELECT COALESCE({dsum('expected_value')}, 0) FROM v_actions) AS total_recoverable
FROM v_kpis""")
query("ranked_projects", lambda p: portfolio.ranked_projects(p.briefs), """
SELECT b.id AS project_id, CASE WHEN t.id IS NOT NULL THEN 0 ELSE 1 END AS source,
  COALESCE(t.sort_key, priority_score) AS score
FROM v_briefs b LEFT JOIN (SELECT id, sort_key FROM v_briefs ORDER BY sort_key DESC, id LIMIT 5) t
  ON b.id = t.id""")

# ---- planning ------------------------------------------------------------------------

view("v_roi", """
SELECT *, weighted_recovery / hours AS roi_score FROM (
  SELECT *, cost_to_execute_hours AS hours,
    estimated_recovery_dollars * confidence AS weighted_recovery FROM v_all_actions)""")
view("v_plan", """
SELECT *, COALESCE(hours_used <= CASE owner WHEN 'Project Manager' THEN 40 WHEN 'Finance' THEN 20
  WHEN 'Operations' THEN 30 WHEN 'Executive' THEN 10 END, FALSE) AS is_planned
FROM (SELECT *, SUM(hours) OVER (PARTITION BY owner ORDER BY roi_score DESC, action_id
  ROWS UNBOUNDED PRECEDING) AS hours_used FROM v_roi)""")

query("action_roi", lambda p: p.action_roi, "SELECT * FROM v_roi")
query("global_rank",
      lambda p: planning.rank_actions(p.action_roi).select(
          "action_id", "roi_score", "global_rank"), """
SELECT action_id, roi_score, ROW_NUMBER() OVER (ORDER BY roi_score DESC, action_id) AS global_rank
FROM v_roi""")
query("gc_bundles", lambda p: portfolio.gc_bundles(p.projects_by_gc, p.rules), """
SELECT *, total_pending_cos + total_rejected_cos AS bundle_value FROM v_by_gc
WHERE project_count >= 3 AND total_pending_cos + total_rejected_cos > 100000""")
query("systemic_issues", lambda p: p.systemic_issues, "SELECT * FROM v_systemic")
query("resource_conflicts", lambda p: portfolio.resource_conflicts(p.action_roi, p.rules), f"""
SELECT *, hours_needed / capacity_hours AS load_ratio,
  COALESCE(hours_needed / capacity_hours > 1.2, FALSE) AS is_overloaded
FROM (SELECT owner, {dsum('hours')} AS hours_needed, CAST(CASE owner WHEN 'Project Manager' THEN 40
    WHEN 'Finance' THEN 20 WHEN 'Operations' THEN 30 WHEN 'Executive' THEN 10 END AS DOUBLE)
    AS capacity_hours
  FROM v_roi WHERE urgency IN ('immediate', 'this_week') GROUP BY 1)""")
query("week_capacity_plan",
      lambda p: p.week_capacity_plan.select(
          "action_id", "owner", "hours", "hours_used", "is_planned"),
      "SELECT action_id, owner, hours, hours_used, is_planned FROM v_plan")
query("strategic_triage", lambda p: portfolio.strategic_triage(p.briefs), """
SELECT * FROM (SELECT id AS project_id,
    COALESCE(percent_billed > 0.90 AND realized_margin < -0.50, FALSE) AS billed_at_heavy_loss,
    current_margin_dollars < 0 AND total_recoverable_estimate
      < 0.05::DOUBLE * -current_margin_dollars AS little_to_recover,
    total_recoverable_estimate, greatest(0, -current_margin_dollars) AS loss FROM v_briefs)
WHERE billed_at_heavy_loss OR little_to_recover""")
view("v_cash_flow", f"""
SELECT bucket, COUNT(*) AS actions, {dsum('estimated_recovery_dollars')} AS gross_recovery,
  {dsum('discounted')} AS expected_recovery
FROM (SELECT *, CASE WHEN time_to_cash_days <= 7 THEN 'week_1' WHEN time_to_cash_days <= 30
    THEN 'weeks_2_to_4' WHEN time_to_cash_days <= 60 THEN 'month_2'
    WHEN time_to_cash_days <= 90 THEN 'month_3' ELSE 'beyond_90_days' END AS bucket,
  estimated_recovery_dollars * CASE WHEN recovery_type = 'billing' THEN 0.95::DOUBLE
    WHEN recovery_type = 'retention' THEN 0.85::DOUBLE
    WHEN recovery_type = 'change_order' AND confidence <= 0.3 THEN 0.3::DOUBLE
    WHEN recovery_type = 'change_order' THEN 0.6::DOUBLE ELSE confidence END AS discounted
  FROM v_all_actions) GROUP BY 1""")
query("cash_flow", lambda p: portfolio.cash_flow(p.all_actions, p.rules),
      "SELECT * FROM v_cash_flow")
query("achievability",
      lambda p: portfolio.achievability(p.week_capacity_plan, p.systemic_issues), f"""
SELECT *, achievable / NULLIF(theoretical, 0) AS achievability_rate FROM (
  SELECT *, expected - non_recoverable - deferred AS achievable FROM (
    SELECT {dsum('estimated_recovery_dollars')} AS theoretical,
      {dsum('weighted_recovery')} AS expected,
      COALESCE({dsum('CASE WHEN stuck THEN weighted_recovery END')}, 0) AS non_recoverable,
      COALESCE({dsum('CASE WHEN NOT stuck AND late THEN weighted_recovery END')}, 0) AS deferred
    FROM (SELECT *, recovery_type = 'operational'
        AND linked_root_cause IN (SELECT label FROM v_systemic) AS stuck,
        NOT is_planned AND urgency IN ('immediate', 'this_week') AS late FROM v_plan)))""")
