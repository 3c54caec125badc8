"""Queries over health, flags, risk, causes and diagnosis."""

from __future__ import annotations

from functools import partial

from pyspark.sql import functions as F

from siteledger.operators import causes, flags, health
from siteledger.plans import catalog
from siteledger.plans.oracle_views import dmean, dsum, fix, rmean, view
from siteledger.rules import CAUSE_ACTIONS

query = partial(catalog.query, share=True)

view("v_cost_trend", f"""
WITH numbered AS (
  SELECT *, ROW_NUMBER() OVER (PARTITION BY project_id ORDER BY week_start DESC) AS rn
  FROM v_weekly WHERE week_start IS NOT NULL),
means AS (
  SELECT project_id,
    {dmean('CASE WHEN rn <= 4 THEN total_cost END')} AS recent,
    {dmean('CASE WHEN rn BETWEEN 5 AND 8 THEN total_cost END')} AS prior
  FROM numbered GROUP BY 1),
active AS (SELECT project_id, COUNT(DISTINCT week_start) AS active_weeks FROM v_weekly GROUP BY 1)
SELECT project_id, active_weeks, COALESCE(recent, 0) AS recent_weekly_cost_avg,
  COALESCE(prior, recent, 0) AS prior_weekly_cost_avg,
  COALESCE((COALESCE(recent, 0) - COALESCE(prior, recent, 0))
    / NULLIF(COALESCE(prior, recent, 0), 0), 0) AS burn_rate_acceleration
FROM active LEFT JOIN means USING (project_id)""")
_ST = dsum("CASE WHEN {c} THEN total_hours_st + total_hours_ot END")
_OT = dsum("CASE WHEN {c} THEN total_hours_ot END")


def _share(c: str) -> str:
    st, ot = _ST.format(c=c), _OT.format(c=c)
    return f"CASE WHEN {st} > 0 THEN {ot} / {st} WHEN COUNT(*) FILTER ({c}) > 0 THEN 0 END"


view("v_labor_trend", f"""
WITH numbered AS (
  SELECT *, ROW_NUMBER() OVER (PARTITION BY project_id ORDER BY week_start DESC) AS rn
  FROM v_labor_week WHERE week_start IS NOT NULL),
means AS (
  SELECT project_id, COALESCE({_share('rn <= 4')}, 0) AS r_ot,
    {_share('rn BETWEEN 5 AND 8')} AS p_ot,
    COALESCE({dmean('CASE WHEN rn <= 4 THEN num_employees END')}, 0) AS r_crew,
    {dmean('CASE WHEN rn BETWEEN 5 AND 8 THEN num_employees END')} AS p_crew
  FROM numbered GROUP BY 1)
SELECT project_id, r_ot AS recent_ot_share, COALESCE(p_ot, r_ot) AS prior_ot_share,
  r_ot - COALESCE(p_ot, r_ot) AS overtime_spike, r_crew AS recent_crew_size,
  COALESCE(p_crew, r_crew) AS prior_crew_size,
  COALESCE((r_crew - COALESCE(p_crew, r_crew)) / NULLIF(COALESCE(p_crew, r_crew), 0), 0)
    AS crew_size_spike
FROM means""")

_COUNTS = ", ".join(f"COALESCE({c}, 0) AS {c}" for c in health.COUNT_DEFAULTS)
_AMOUNTS = ", ".join(f"COALESCE({c}, 0.0::DOUBLE) AS {c}" for c in health.AMOUNT_DEFAULTS)
view("v_health_joined", """
SELECT c.project_id, project_name, original_contract_value, gc_name,
  b.* EXCLUDE (project_id), total_labor_cost AS actual_labor_cost, total_hours_st, total_hours_ot,
  total_material_cost AS actual_material_cost, o.* EXCLUDE (project_id), r.* EXCLUDE (project_id),
  cumulative_billed, billing_data_available, ct.* EXCLUDE (project_id), lt.* EXCLUDE (project_id)
FROM v_contracts c
LEFT JOIN v_budget b ON c.project_id = b.project_id
LEFT JOIN v_labor_project l ON c.project_id = l.project_id
LEFT JOIN v_material_project m ON c.project_id = m.project_id
LEFT JOIN v_co_health o ON c.project_id = o.project_id
LEFT JOIN v_rfi_health r ON c.project_id = r.project_id
LEFT JOIN v_billing_max bm ON c.project_id = bm.project_id
LEFT JOIN v_cost_trend ct ON c.project_id = ct.project_id
LEFT JOIN v_labor_trend lt ON c.project_id = lt.project_id""")
view("v_health_filled", f"""
SELECT project_id, project_name, original_contract_value, gc_name,
  COALESCE(billing_data_available, FALSE) AS billing_data_available, {_COUNTS}, {_AMOUNTS}
FROM v_health_joined""")
view("v_health_raw", """
SELECT *,
  forecast_cost_at_completion - total_budget AS forecast_to_complete,
  COALESCE((forecast_cost_at_completion - prior_forecast_cost_at_completion)
    / NULLIF(total_budget, 0), 0) AS forecast_to_complete_trend
FROM (SELECT *,
    actual_tracked_cost + recent_weekly_cost_avg * remaining_weeks AS forecast_cost_at_completion,
    actual_tracked_cost + prior_weekly_cost_avg * remaining_weeks
      AS prior_forecast_cost_at_completion
  FROM (SELECT *,
      realized_margin_dollars / NULLIF(adjusted_contract, 0) AS realized_margin_pct,
      pct_complete - pct_billed AS billing_gap_pct,
      ceil(greatest(0.0::DOUBLE, 1 - COALESCE(pct_complete, 0)) * active_weeks)
        AS remaining_weeks
    FROM (SELECT *,
        1 - total_budget / NULLIF(original_contract_value, 0) AS bid_margin,
        adjusted_contract - (actual_tracked_cost + est_equip + est_sub)
          AS realized_margin_dollars,
        (actual_labor_cost / NULLIF(est_labor, 0) - 1) * 100 AS labor_overrun_pct,
        (actual_material_cost / NULLIF(est_material, 0) - 1) * 100 AS material_overrun_pct,
        CASE WHEN total_budget <> 0 THEN least(greatest(actual_tracked_cost / total_budget,
          0.0::DOUBLE), 1.0::DOUBLE) END AS pct_complete,
        CASE WHEN billing_data_available AND adjusted_contract <> 0 THEN
          least(greatest(cumulative_billed / adjusted_contract, 0.0::DOUBLE), 1.0::DOUBLE) END
          AS pct_billed,
        total_budget / NULLIF(original_contract_value, 0) AS budget_coverage,
        total_hours_ot / NULLIF(total_hours_st + total_hours_ot, 0) AS ot_share,
        actual_labor_cost / NULLIF(est_labor, 0) AS labor_burn_ratio,
        actual_material_cost / NULLIF(est_material, 0) AS material_burn_ratio,
        co_approved_value / NULLIF(original_contract_value, 0) AS approved_co_pct,
        co_rejected_value / NULLIF(original_contract_value, 0) AS rejected_co_pct,
        pending_co_value / NULLIF(original_contract_value, 0) AS pending_co_pct,
        CAST(rfi_cost_impact_count AS DOUBLE) / NULLIF(rfi_count, 0) AS rfi_cost_impact_rate,
        rfi_count / NULLIF(original_contract_value / 1000000, 0) AS rfi_per_million_contract
      FROM (SELECT *, actual_labor_cost + actual_material_cost AS actual_tracked_cost,
          COALESCE(original_contract_value, 0) + co_approved_value AS adjusted_contract
        FROM v_health_filled))))""")
_RATIOS = ", ".join(f"COALESCE({c}, 0.0::DOUBLE) AS {c}" for c in health.RATIO_DEFAULTS)
view("v_health", f"SELECT * REPLACE ({_RATIOS}) FROM v_health_raw")

query("weekly_cost_trend", lambda p: p.cost_trend, "SELECT * FROM v_cost_trend")
query("weekly_labor_trend", lambda p: p.labor_trend, "SELECT * FROM v_labor_trend")
query("project_health_join", lambda p: p.health_joined, "SELECT * FROM v_health_joined")
query("fill_defaults", lambda p: health.fill_defaults(p.health_joined),
      "SELECT * FROM v_health_filled")
query("health_columns", lambda p: health.health_columns(health.fill_defaults(p.health_joined)),
      "SELECT * FROM v_health_raw")
query("fill_ratios",
      lambda p: health.fill_ratios(
          health.health_columns(health.fill_defaults(p.health_joined))
      ).select("project_id", *health.RATIO_DEFAULTS),
      f"SELECT project_id, {', '.join(health.RATIO_DEFAULTS)} FROM v_health")
query("project_health", lambda p: p.health, "SELECT * FROM v_health")

# ---- flags ------------------------------------------------------------------------

TRIGGERS = {
    "underwater": "actual_tracked_cost > adjusted_contract",
    "material_blowout": "material_overrun_pct > 150",
    "labor_overrun": "labor_overrun_pct > 50",
    "rejected_co_exposure":
        "co_rejected_value > original_contract_value * 0.05::DOUBLE AND realized_margin_pct < 0.10",
    "budget_coverage": "budget_coverage < 0.88 OR budget_coverage > 1.10",
    "compound_overrun": "labor_overrun_pct > 0 AND material_overrun_pct > 100",
    "rfi_cost_impact_count": "rfi_cost_impact_count > 25",
    "rfi_cost_impact_rate":
        "CAST(rfi_cost_impact_count AS DOUBLE) / NULLIF(rfi_count, 0) > 0.35",
}
_FIRED = ", ".join(f"CASE WHEN {cond} THEN '{name}' END" for name, cond in TRIGGERS.items())
_ANY = " OR ".join(f"({cond})" for cond in TRIGGERS.values())
SEVERITY = """CASE WHEN realized_margin_pct < -0.10 THEN 'Critical'
  WHEN realized_margin_pct < 0 THEN 'Warning' ELSE 'Watch' END"""
view("v_flagged", f"""
SELECT *, {SEVERITY} AS severity, concat_ws(' | ', {_FIRED}) AS fired_triggers,
  CAST({' + '.join(f"CASE WHEN {c} THEN 1 ELSE 0 END" for c in TRIGGERS.values())} AS BIGINT)
    AS trigger_count
FROM v_health WHERE {_ANY}""")
view("v_kpis", f"""
SELECT COUNT(*) AS total_projects, {dsum('original_contract_value')} AS total_contract,
  {dsum('total_budget')} AS total_budget, {dsum('co_approved_value')} AS total_cos_approved,
  {dsum('adjusted_contract')} AS total_adjusted,
  {dsum('actual_labor_cost')} AS total_actual_labor,
  {dsum('actual_material_cost')} AS total_actual_material,
  {dsum('co_rejected_value')} AS total_rejected_cos,
  {rmean('bid_margin')} AS avg_bid_margin, {rmean('realized_margin_pct')} AS avg_realized_margin,
  {rmean('material_overrun_pct')} AS avg_material_overrun_pct,
  {rmean('labor_overrun_pct')} AS avg_labor_overrun_pct,
  COUNT(*) FILTER (actual_tracked_cost > adjusted_contract) AS underwater_count,
  COUNT(*) FILTER (bid_margin < 0) AS negative_bid_margin_count
FROM v_health""")

query("flagged_projects", lambda p: p.flagged, "SELECT * FROM v_flagged")
query("severity",
      lambda p: p.health.selectExpr(
          "project_id", f"{flags.severity('realized_margin_pct', p.rules)} AS severity"),
      f"SELECT project_id, {SEVERITY} AS severity FROM v_health")
query("severity_normalize",
      lambda p: p.tables["rfis"].selectExpr(
          "rfi_number", f"{flags.severity_normalize('priority')} AS severity"),
      """SELECT rfi_number, CASE WHEN lower(trim(priority)) IN ('critical', 'warning', 'watch')
      THEN lower(trim(priority)) ELSE 'watch' END AS severity FROM v_rfis""")
query("fired_triggers",
      lambda p: flags.with_triggers(p.health, p.rules).select(
          "project_id", "fired_triggers", "trigger_count"),
      f"""SELECT h.project_id, COALESCE(fired_triggers, '') AS fired_triggers,
      COALESCE(trigger_count, 0) AS trigger_count
      FROM v_health h LEFT JOIN v_flagged f ON h.project_id = f.project_id""")
query("portfolio_kpis", lambda p: flags.portfolio_kpis(p.health), "SELECT * FROM v_kpis")
query("portfolio_summary", lambda p: flags.portfolio_summary(p.health, p.rules),
      "SELECT *, (SELECT COUNT(*) FROM v_flagged) AS total_flagged FROM v_kpis")

# ---- risk -------------------------------------------------------------------------


def _quantile(metric: str, q: float) -> str:
    """Linear interpolation over sorted values, from row numbers."""
    name = f"{metric}_q{round(q * 100)}"
    return f"""(SELECT MAX(CASE WHEN rn = floor(pos) THEN v END)
    + (MAX(CASE WHEN rn = ceil(pos) THEN v END) - MAX(CASE WHEN rn = floor(pos) THEN v END))
      * (MAX(pos) - floor(MAX(pos)))
  FROM (SELECT v, rn, {q}::DOUBLE * (n - 1) AS pos FROM (
    SELECT CAST({metric} AS DOUBLE) AS v, ROW_NUMBER() OVER (ORDER BY {metric}) - 1 AS rn,
      COUNT(*) OVER () AS n FROM v_analysis_rfi WHERE {metric} IS NOT NULL))) AS {name}"""


_QS = {"billing_gap": (0.10, 0.25, 0.50), "margin_pct": (0.10, 0.25, 0.50),
       "rejected_value_ratio": (0.90, 0.75), "total_rfis": (0.90, 0.75)}
view("v_limits", "SELECT " + ", ".join(_quantile(m, q) for m, qs in _QS.items() for q in qs))


def _score(metric: str, op: str, points: list[tuple[int, int]]) -> str:
    whens = " ".join(f"WHEN {metric} {op} {metric}_q{q} THEN {pt}" for q, pt in points)
    return f"CAST(CASE {whens} ELSE 0 END AS BIGINT)"


view("v_components", f"""
SELECT v_analysis_rfi.*,
  {_score('billing_gap', '<=', [(10, 40), (25, 30), (50, 15)])} AS billing_score,
  {_score('margin_pct', '<=', [(10, 30), (25, 20), (50, 10)])} AS margin_score,
  {_score('rejected_value_ratio', '>=', [(90, 20), (75, 10)])} AS change_order_score,
  {_score('total_rfis', '>=', [(90, 10), (75, 5)])} AS rfi_score
FROM v_analysis_rfi, v_limits""")
view("v_risk", """
SELECT *, CASE WHEN risk_score >= 70 THEN 'HIGH' WHEN risk_score >= 40 THEN 'MEDIUM' ELSE 'LOW' END
    AS risk_level,
  CASE WHEN top = 0 THEN 'Low Risk / No Clear Driver' ELSE concat_ws(', ',
    CASE WHEN billing_score = top THEN 'Underbilling / Financial Loss' END,
    CASE WHEN margin_score = top THEN 'Execution Inefficiency' END,
    CASE WHEN change_order_score = top THEN 'Change Order Failure' END,
    CASE WHEN rfi_score = top THEN 'Coordination Issues' END) END AS main_issue,
  CASE WHEN risk_score = 0
    THEN 'No major risk signals detected relative to the rest of the portfolio.'
    ELSE upper(phrases[1]) || substring(phrases, 2) || '.' END AS explanation
FROM (SELECT *, billing_score + margin_score + change_order_score + rfi_score AS risk_score,
    greatest(billing_score, margin_score, change_order_score, rfi_score) AS top,
    concat_ws('; ',
      CASE WHEN billing_score > 0 THEN 'project is underbilled relative to cost' END,
      CASE WHEN margin_score > 0 THEN 'project margin is unusually weak' END,
      CASE WHEN change_order_score > 0
        THEN 'rejected change orders are contributing to unrecovered work' END,
      CASE WHEN rfi_score > 0 THEN 'high RFI volume suggests coordination issues' END) AS phrases
  FROM v_components)""")

query("risk_quantiles", lambda p: p.risk_limits, "SELECT * FROM v_limits")
query("risk_components", lambda p: p.risk_components, "SELECT * FROM v_components")
query("risk_score",
      lambda p: p.risk_scores.select("project_id", "risk_score", "risk_level"),
      "SELECT project_id, risk_score, risk_level FROM v_risk")
query("main_issue", lambda p: p.risk_scores.select("project_id", "main_issue"),
      "SELECT project_id, main_issue FROM v_risk")
query("risk_explanation", lambda p: p.risk_scores.select("project_id", "explanation"),
      "SELECT project_id, explanation FROM v_risk")
query("project_risk_scores", lambda p: p.risk_scores,
      "SELECT * EXCLUDE (top, phrases) FROM v_risk")

# ---- management causes -------------------------------------------------------------

_KEEP = """h.project_id, project_name, gc_name, original_contract_value, adjusted_contract,
  total_budget, actual_tracked_cost, cumulative_billed, realized_margin_pct, pending_co_pct,
  max_open_rfi_age, overtime_spike, burn_rate_acceleration, crew_size_spike,
  forecast_to_complete_trend"""
view("v_triggers", """SELECT project_id, replace(fired_triggers, ' | ', '; ') AS fired_triggers
FROM v_flagged""")
view("v_management_joined", f"""
SELECT {_KEEP}, risk_score, risk_level, main_issue, c.approved_value, c.rejected_value,
  s.total_rfis, labor_burn_ratio, labor_avg_pct_overrun, material_burn_ratio,
  material_avg_pct_overrun, fired_triggers
FROM (SELECT * EXCLUDE (labor_burn_ratio, material_burn_ratio) FROM v_health) h
LEFT JOIN (SELECT project_id, risk_score, risk_level, main_issue FROM v_risk) k
  ON h.project_id = k.project_id
LEFT JOIN v_change_summary c ON h.project_id = c.project_id
LEFT JOIN v_rfi_summary s ON h.project_id = s.project_id
LEFT JOIN v_labor_rollup l ON h.project_id = l.project_id
LEFT JOIN v_material_rollup m ON h.project_id = m.project_id
LEFT JOIN v_triggers t ON h.project_id = t.project_id""")


def _r3(x: str) -> str:
    return f"round_even({x}, 3)"


def _floor0(x: str) -> str:
    return f"CASE WHEN {x} IS NOT NULL THEN greatest({x}, 0.0::DOUBLE) END"


_FLOORED = ["labor_burn_ratio", "material_burn_ratio", "labor_avg_pct_overrun",
            "material_avg_pct_overrun"]
view("v_metrics", f"""
SELECT * REPLACE ({_floor0('pending_co_pct')} AS pending_co_pct,
    {', '.join(f'{_r3(_floor0(c))} AS {c}' for c in _FLOORED)},
    {_r3('realized_margin_pct')} AS realized_margin_pct,
    {_r3('forecast_to_complete_trend')} AS forecast_to_complete_trend),
  adjusted_contract - cumulative_billed AS billing_gap,
  {_r3(_floor0('((adjusted_contract - cumulative_billed) / NULLIF(adjusted_contract, 0))'))}
    AS billing_gap_pct,
  {_r3(_floor0('(approved_value / NULLIF(original_contract_value, 0))'))} AS approved_co_pct,
  {_r3(_floor0('(rejected_value / NULLIF(original_contract_value, 0))'))} AS rejected_co_pct,
  {_r3('actual_tracked_cost / NULLIF(total_budget, 0)')} AS cost_vs_budget
FROM v_management_joined""")


def _p1(x: str) -> str:
    return fix(f"{x} * 100", 1) + " || '%'"


_ACTIONS = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in CAUSE_ACTIONS.items())
view("v_classified", f"""
SELECT *, CASE management_cause
    WHEN 'Billing / collections' THEN 'Billing gap is ' || {_p1('billing_gap_pct')}
      || ' of adjusted contract'
    WHEN 'Unrecovered change orders' THEN 'Rejected COs are ' || {_p1('rejected_co_pct')}
      || ' of original contract'
    WHEN 'Scope / estimating' THEN 'Approved COs are ' || {_p1('approved_co_pct')}
      || ' of original contract'
    WHEN 'Labor execution' THEN 'Labor burn ratio is ' || {fix('labor_burn_ratio', 2)}
      || 'x budget'
    WHEN 'Material / procurement' THEN 'Material avg overrun is '
      || {_p1('material_avg_pct_overrun')}
    WHEN 'Coordination / RFIs' THEN 'Project has ' || CAST(COALESCE(total_rfis, 0) AS VARCHAR)
      || ' RFIs'
    WHEN 'Margin erosion / review' THEN 'Realized margin is ' || {_p1('realized_margin_pct')}
    ELSE 'No single issue clearly dominates' END AS evidence,
  CASE management_cause {_ACTIONS} ELSE 'Review project' END AS recommended_action,
  CASE WHEN severity_score <= 1 THEN 'Low' WHEN severity_score <= 3 THEN 'Moderate'
    WHEN severity_score <= 6 THEN 'High' WHEN severity_score <= 20 THEN 'Critical' END AS severity
FROM (SELECT *, CASE WHEN billing_gap_pct > 0.15 THEN 'Billing / collections'
    WHEN rejected_co_pct > 0.03 THEN 'Unrecovered change orders'
    WHEN approved_co_pct > 0.10 THEN 'Scope / estimating'
    WHEN labor_burn_ratio > 1.10 THEN 'Labor execution'
    WHEN material_avg_pct_overrun > 0.10 THEN 'Material / procurement'
    WHEN total_rfis > 50 THEN 'Coordination / RFIs'
    WHEN realized_margin_pct < 0 THEN 'Margin erosion / review'
    ELSE 'Mixed / monitor' END AS management_cause,
  CAST(3 * COALESCE((billing_gap_pct > 0.15)::INT, 0)
    + 3 * COALESCE((rejected_co_pct > 0.03)::INT, 0)
    + 2 * COALESCE((approved_co_pct > 0.10)::INT, 0)
    + 2 * COALESCE((labor_burn_ratio > 1.10)::INT, 0)
    + 2 * COALESCE((material_avg_pct_overrun > 0.10)::INT, 0)
    + COALESCE((total_rfis > 50)::INT, 0)
    + 3 * COALESCE((realized_margin_pct < 0)::INT, 0) AS BIGINT) AS severity_score
  FROM v_metrics)""")
_NULLS = {"alert_class": "VARCHAR", "trigger_score": "DOUBLE", "primary_trigger": "VARCHAR",
          "supporting_triggers": "VARCHAR", "why_now": "VARCHAR"}
_SUMMARY = ", ".join(
    f"CAST(NULL AS {_NULLS[c]}) AS {c}" if c in _NULLS else c for c in causes.SUMMARY_COLUMNS
)
view("v_management", f"SELECT {_SUMMARY} FROM v_classified")

query("trigger_text",
      lambda p: p.flagged.select(
          "project_id", causes.trigger_text(F.col("fired_triggers")).alias("fired_triggers")),
      "SELECT * FROM v_triggers")
query("management_join", lambda p: p.management_joined, "SELECT * FROM v_management_joined")
query("management_metrics", lambda p: p.management_metrics, "SELECT * FROM v_metrics")
for _key, _cols in {
    "management_cause": ["management_cause"],
    "evidence_text": ["management_cause", "evidence"],
    "recommended_action": ["management_cause", "recommended_action"],
    "severity_score": ["severity_score"],
    "severity_bin": ["severity_score", "severity"],
}.items():
    query(_key, lambda p, cols=_cols: p.classified.select("project_id", *cols),
          f"SELECT project_id, {', '.join(_cols)} FROM v_classified")
query("management_project_summary", lambda p: p.management, "SELECT * FROM v_management")
query("cause_counts", lambda p: causes.cause_counts(p.management), """
SELECT 'management_cause' AS dimension, management_cause AS label, COUNT(*) AS projects
FROM v_management GROUP BY 2
UNION ALL SELECT 'severity', severity, COUNT(*) FROM v_management GROUP BY 2""")

query("abnormal_signals",
      lambda p: causes.abnormal_signals(p.health, p.rules).select(
          "project_id", "abnormal_signals"), """
SELECT project_id, concat_ws(' | ',
  CASE WHEN labor_burn_ratio > 1.3 THEN 'labor_overrun' END,
  CASE WHEN material_burn_ratio > 1.3 THEN 'material_overrun' END,
  CASE WHEN bid_margin - realized_margin_pct > 0.05 THEN 'margin_below_bid' END,
  CASE WHEN billing_gap_pct > 0.10 THEN 'billing_behind' END,
  CASE WHEN rejected_co_pct > 0.05 THEN 'rejected_change_orders' END,
  CASE WHEN pending_co_pct > 0.10 THEN 'pending_change_orders' END,
  CASE WHEN ot_share > 0.25 THEN 'overtime' END,
  CASE WHEN recent_crew_size > prior_crew_size * 1.5::DOUBLE THEN 'crew_size' END)
  AS abnormal_signals
FROM v_health""")
