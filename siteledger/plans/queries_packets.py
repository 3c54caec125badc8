"""Queries over packets, text evidence and drill-downs."""

from __future__ import annotations

from functools import partial

from pyspark.sql import functions as F

from siteledger.functions import stages
from siteledger.operators import evidence, packets
from siteledger.plans import catalog
from siteledger.plans.oracle_views import (
    AS_OF, LABOR_COST, dsum, fix, has_any, pct_text, usd, view,
)
from siteledger.rules import ISSUE_KEYWORDS, SCHEDULE_NOTE_WORDS, SCHEDULE_REASON_WORDS

query = catalog.query
shared = partial(catalog.query, share=True)

# ---- labor, deliveries, lines ----------------------------------------------------------

view("v_p_labor", f"""
SELECT project_id, round_even(CAST(SUM({LABOR_COST}) AS DOUBLE), 2) AS labor_actual,
  round_even({dsum('hours_ot')} / NULLIF({dsum('hours_st')} + {dsum('hours_ot')}, 0), 4)
    AS overtime_share
FROM v_labor GROUP BY 1""")
view("v_p_crew", """
SELECT project_id, CAST(MAX(crew) AS DOUBLE) AS crew_size_peak FROM (
  SELECT project_id, date, COUNT(DISTINCT employee_id) AS crew FROM v_labor GROUP BY 1, 2)
GROUP BY 1""")
view("v_p_codes", f"""
SELECT project_id, cost_code, CAST(SUM({LABOR_COST}) AS DOUBLE) AS code_cost FROM v_labor
GROUP BY 1, 2""")
view("v_p_top_codes", f"""
SELECT project_id, string_agg(cost_code || ' (' || {usd('code_cost')} || ' labor)', ' | '
  ORDER BY rn) AS top_cost_codes
FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY project_id ORDER BY code_cost DESC, cost_code)
  AS rn FROM v_p_codes) WHERE rn <= 5 GROUP BY 1""")
view("v_p_lines", f"""
WITH a AS (SELECT project_id, sov_line_id, {dsum('c')} AS actual FROM (
    SELECT project_id, sov_line_id, CAST({LABOR_COST} AS DOUBLE) AS c FROM v_labor
    UNION ALL SELECT project_id, sov_line_id, total_cost FROM v_materials) GROUP BY 1, 2),
b AS (SELECT project_id, sov_line_id, {dsum('''estimated_labor_cost + estimated_material_cost
    + estimated_equipment_cost + estimated_sub_cost''')} AS budget FROM v_sov_budget GROUP BY 1, 2)
SELECT COALESCE(a.project_id, b.project_id) AS project_id,
  COALESCE(a.sov_line_id, b.sov_line_id) AS sov_line_id, COALESCE(actual, 0) AS actual,
  COALESCE(budget, 0) AS budget, COALESCE(actual, 0) - COALESCE(budget, 0) AS variance,
  COALESCE(description, CAST(line_number AS VARCHAR),
    COALESCE(a.sov_line_id, b.sov_line_id)) AS description
FROM a FULL OUTER JOIN b ON a.project_id = b.project_id AND a.sov_line_id = b.sov_line_id
LEFT JOIN v_sov s ON s.project_id = COALESCE(a.project_id, b.project_id)
  AND s.sov_line_id = COALESCE(a.sov_line_id, b.sov_line_id)""")
view("v_p_top_lines", f"""
SELECT project_id, string_agg(description || ': variance ' || {usd('variance')}, ' | ' ORDER BY rn)
  AS top_sov_variances
FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY project_id ORDER BY variance DESC, sov_line_id)
  AS rn FROM v_p_lines) WHERE rn <= 5 AND variance > 0 GROUP BY 1""")
view("v_p_cluster", """
SELECT project_id, CAST(MAX(n) AS DOUBLE) / SUM(n) >= 0.4 AS delivery_clustering_signal FROM (
  SELECT project_id, strftime(date, '%Y-%m') AS m, COUNT(*) AS n FROM v_materials GROUP BY 1, 2)
GROUP BY 1""")

query("packet_labor_actual",
      lambda p: p.labor_actual.select("project_id", "labor_actual"),
      "SELECT project_id, labor_actual FROM v_p_labor")
query("packet_overtime_share",
      lambda p: p.labor_actual.select("project_id", "overtime_share"),
      "SELECT project_id, overtime_share FROM v_p_labor")
query("crew_size_peak", lambda p: evidence.crew_size_peak(p.labor_clean), "SELECT * FROM v_p_crew")
query("cost_code_totals", lambda p: p.cost_code_totals, "SELECT * FROM v_p_codes")
query("top_cost_codes", lambda p: evidence.top_cost_codes(p.cost_code_totals, p.rules),
      "SELECT * FROM v_p_top_codes")
query("sov_full_variance", lambda p: p.sov_full_variance, "SELECT * FROM v_p_lines")
query("top_sov_variances", lambda p: evidence.top_sov_variances(p.sov_full_variance, p.rules),
      "SELECT * FROM v_p_top_lines")
query("sov_id_union",
      lambda p: evidence.sov_id_union(p.labor_clean, p.materials, p.tables["sov_budget"]), """
SELECT project_id, sov_line_id FROM v_labor UNION SELECT project_id, sov_line_id FROM v_materials
UNION SELECT project_id, sov_line_id FROM v_sov_budget""")
query("delivery_clustering", lambda p: evidence.delivery_clustering(p.materials, p.rules),
      "SELECT * FROM v_p_cluster")

# ---- change orders, RFIs, notes ----------------------------------------------------------

_BUCKET = """CASE WHEN lower(trim(status)) IN ('approved', 'executed', 'issued') THEN 'approved'
  WHEN lower(trim(status)) IN ('rejected', 'denied', 'void') THEN 'rejected' ELSE 'pending' END"""
_CO_SUMS = ", ".join(
    f"COUNT(*) FILTER (b = '{b}') AS {b}_count, round_even("
    f"{dsum(f'''CASE WHEN b = '{b}' THEN amount END''')}, 2) AS {b}_value"
    for b in ("approved", "pending", "rejected")
)
view("v_p_co", f"""
SELECT project_id, {_CO_SUMS} FROM (SELECT *, {_BUCKET} AS b FROM v_change_orders) GROUP BY 1""")
view("v_p_reasons", """
SELECT project_id, string_agg(reason_category, ' | ' ORDER BY rn) AS top_reasons
FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY project_id ORDER BY n DESC, reason_category) AS rn
  FROM (SELECT project_id, reason_category, COUNT(*) AS n FROM v_change_orders
    WHERE trim(reason_category) <> '' GROUP BY 1, 2)) WHERE rn <= 2 GROUP BY 1""")
_CO_PARTS = ", ".join(
    f"CASE WHEN {b}_count > 0 THEN {b}_count || ' {b} COs totaling ' || {usd(b + '_value')} END"
    for b in ("approved", "pending", "rejected")
)
view("v_p_co_text", f"""
SELECT project_id, NULLIF(concat_ws('. ', {_CO_PARTS},
  'Most common drivers: ' || replace(top_reasons, ' | ', ', ')), '') AS change_order_summary
FROM v_p_co LEFT JOIN v_p_reasons USING (project_id)""")
_YES = "IN ('true', 'yes', '1', 'y')"
view("v_p_rfi", f"""
SELECT project_id, COUNT(*) AS rfi_total,
  COUNT(*) FILTER (lower(status) NOT IN ('closed', 'answered')) AS rfi_open,
  COUNT(*) FILTER (lower(priority) = 'high') AS rfi_high,
  COUNT(*) FILTER (lower(cost_impact) {_YES} OR lower(schedule_impact) {_YES}) AS rfi_impacted,
  COUNT(*) FILTER (lower(schedule_impact) {_YES}) AS rfi_schedule
FROM v_rfis GROUP BY 1""")
view("v_p_rfi_text", """
SELECT project_id, concat_ws('. ', rfi_total || ' RFIs total',
  CASE WHEN rfi_open > 0 THEN rfi_open || ' still open' END,
  CASE WHEN rfi_high > 0 THEN rfi_high || ' marked high priority' END,
  CASE WHEN rfi_impacted > 0 THEN rfi_impacted || ' show cost or schedule impact' END,
  'Key topics: ' || topics) AS rfi_summary
FROM v_p_rfi LEFT JOIN (SELECT project_id, string_agg(t, '; ' ORDER BY rn) AS topics
  FROM (SELECT project_id, trim(regexp_replace(subject, '\\s+', ' ', 'g')) AS t, ROW_NUMBER() OVER
      (PARTITION BY project_id ORDER BY date_submitted, rfi_number) AS rn FROM v_rfis)
  WHERE rn <= 2 GROUP BY 1) USING (project_id)""")


def _note_score(text: str) -> str:
    return " + ".join(f"CAST({has_any(text, kws)} AS BIGINT)" for kws in ISSUE_KEYWORDS.values())


_CLEAN = r"trim(regexp_replace(content, '[\s\x0B\x1c-\x1f\x{85}\pZ]+', ' ', 'g'))"
_SNIP = "CASE WHEN length(clean) <= 140 THEN clean ELSE rtrim(clean[:137]) || '...' END"
view("v_p_note_scores", f"SELECT *, {_note_score('content')} AS note_score FROM v_field_notes")
view("v_p_top_notes", """
SELECT project_id, date, content, note_score, rn AS note_rank FROM (SELECT *, ROW_NUMBER() OVER
  (PARTITION BY project_id ORDER BY note_score DESC, date DESC, content) AS rn
  FROM v_p_note_scores) WHERE rn <= 6""")
view("v_p_note_firsts", f"""
WITH told AS (SELECT project_id, note_rank, {_SNIP} AS snippet,
    ({_note_score('clean')}) > 0 AS notable, {has_any('clean', ISSUE_KEYWORDS['owner_scope'])} AS scope
  FROM (SELECT *, {_CLEAN} AS clean FROM v_p_top_notes) WHERE clean <> ''),
numbered AS (SELECT *,
    CASE WHEN notable THEN SUM(notable::INT) OVER w END AS nn,
    CASE WHEN scope THEN SUM(scope::INT) OVER w END AS ns
  FROM told WINDOW w AS (PARTITION BY project_id ORDER BY note_rank ROWS UNBOUNDED PRECEDING))
SELECT *,
  ROW_NUMBER() OVER (PARTITION BY project_id, notable, snippet ORDER BY note_rank) AS dn,
  ROW_NUMBER() OVER (PARTITION BY project_id, scope, snippet ORDER BY note_rank) AS ds
FROM numbered""")
view("v_p_notes", """
SELECT project_id, string_agg(snippet, ' | ' ORDER BY note_rank) FILTER (nn <= 3)
    AS field_notes_summary,
  COALESCE(string_agg(snippet, ' | ' ORDER BY note_rank) FILTER (ns <= 5 AND ds = 1), '')
    AS missing_scope_signals,
  COALESCE(string_agg(snippet, ' | ' ORDER BY note_rank) FILTER (nn <= 5 AND dn = 1), '')
    AS notable_events
FROM v_p_note_firsts GROUP BY 1""")
view("v_p_note_lists", """
SELECT project_id, list(snippet ORDER BY note_rank) FILTER (ns <= 5 AND ds = 1) AS missing_scope_signals_list,
  list(snippet ORDER BY note_rank) FILTER (nn <= 5 AND dn = 1) AS notable_events_list
FROM v_p_note_firsts GROUP BY 1""")
view("v_p_hits", f"""
SELECT project_id, COUNT(*) FILTER ({has_any('content', SCHEDULE_NOTE_WORDS)}) AS note_hits
FROM v_field_notes GROUP BY 1""")
view("v_p_signals", f"""
SELECT project_id, concat_ws(' | ',
  CASE WHEN rfi_schedule > 0 THEN rfi_schedule || ' RFIs show schedule impact' END,
  CASE WHEN urgent > 0 THEN urgent || ' change orders reference acceleration or schedule pressure'
    END,
  CASE WHEN note_hits > 0 THEN note_hits || ' field notes mention delay, access, or rework' END)
  AS schedule_pressure_signals
FROM (SELECT project_id, COUNT(*) FILTER ({has_any('reason_category', SCHEDULE_REASON_WORDS)})
    AS urgent FROM v_change_orders GROUP BY 1)
FULL OUTER JOIN v_p_rfi USING (project_id) FULL OUTER JOIN v_p_hits USING (project_id)""")
view("v_p_recent", """
SELECT project_id, string_agg(trim(content), ' | ' ORDER BY rn) AS field_note_summary FROM (
  SELECT *, ROW_NUMBER() OVER (PARTITION BY project_id ORDER BY rn5) AS rn FROM (
    SELECT *, ROW_NUMBER() OVER (PARTITION BY project_id ORDER BY date DESC, content) AS rn5
    FROM v_field_notes) WHERE rn5 <= 5 AND trim(content) <> '') WHERE rn <= 3 GROUP BY 1""")

query("packet_co_summary", lambda p: p.packet_co_summary, "SELECT * FROM v_p_co")
query("co_reason_top2", lambda p: p.co_reason_top2, "SELECT * FROM v_p_reasons")
query("co_summary_text",
      lambda p: evidence.co_summary_text(p.packet_co_summary, p.co_reason_top2),
      "SELECT * FROM v_p_co_text")
query("packet_rfi_counts", lambda p: p.packet_rfi_counts, "SELECT * FROM v_p_rfi")
query("rfi_summary_text",
      lambda p: evidence.rfi_summary_text(p.rfis, p.packet_rfi_counts, p.rules),
      "SELECT * FROM v_p_rfi_text")
query("note_score", lambda p: evidence.note_scores(p.tables["field_notes"]),
      "SELECT * FROM v_p_note_scores")
query("top_field_notes", lambda p: p.top_field_notes.withColumn(
    "note_rank", F.col("note_rank").cast("bigint")), "SELECT * FROM v_p_top_notes")
query("field_notes_summary", lambda p: p.field_notes_summary, "SELECT * FROM v_p_notes")
query("keyword_hits", lambda p: evidence.keyword_hits(p.tables["field_notes"]),
      "SELECT * FROM v_p_hits")
query("schedule_signals", lambda p: p.schedule_signals, "SELECT * FROM v_p_signals")
query("recent_notes", lambda p: p.recent_notes, "SELECT * FROM v_p_recent")

# ---- billing and the packet ----------------------------------------------------------------

view("v_p_latest", """
SELECT project_id, application_number, period_end, cumulative_billed, retention_held, status
FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY project_id ORDER BY period_end DESC,
  application_number DESC) AS rn FROM v_billing_history) WHERE rn = 1""")
view("v_p_last_app", """
SELECT project_id, CAST(MAX(CAST(application_number AS BIGINT)) AS VARCHAR) AS latest_application
FROM v_billing_line_items GROUP BY 1""")
view("v_p_progress", f"""
SELECT project_id, round_even({dsum('scheduled_value * pct_complete')} / {dsum('scheduled_value')},
  2) AS percent_complete
FROM v_billing_line_items l JOIN v_p_last_app a USING (project_id)
WHERE application_number = latest_application GROUP BY 1""")
view("v_p_est", f"""
SELECT project_id, round_even({dsum('estimated_labor_cost')}, 2) AS labor_estimated,
  round_even({dsum('estimated_material_cost')}, 2) AS material_estimated,
  round_even({dsum('estimated_equipment_cost')} + {dsum('estimated_sub_cost')}, 2)
    AS other_cost_estimated FROM v_sov_budget GROUP BY 1""")
view("v_p_fin", f"""
SELECT *, round_even(estimated_margin_dollars / NULLIF(contract_value, 0) * 100, 2)
    AS estimated_margin_pct,
  round_even(realized_margin_dollars / NULLIF(contract_value, 0) * 100, 2) AS realized_margin_pct
FROM (SELECT *, round_even(contract_value - estimated_cost_total, 2) AS estimated_margin_dollars,
    round_even(contract_value - actual_cost_total, 2) AS realized_margin_dollars,
    round_even(labor_actual - labor_estimated, 2) AS labor_variance,
    round_even(material_actual - material_estimated, 2) AS material_variance,
    round_even(labor_actual / NULLIF(labor_estimated, 0), 2) AS labor_overrun_multiple,
    round_even(material_actual / NULLIF(material_estimated, 0), 2) AS material_overrun_multiple
  FROM (SELECT c.project_id, project_name, gc_name, substantial_completion_date,
      original_contract_value AS contract_value, labor_estimated, labor_actual,
      material_estimated, material_actual, other_cost_estimated, overtime_share,
      round_even(labor_estimated + material_estimated + other_cost_estimated, 2)
        AS estimated_cost_total,
      CASE WHEN COALESCE(labor_actual, material_actual) IS NOT NULL
        THEN COALESCE(labor_actual, 0) + COALESCE(material_actual, 0) END AS actual_cost_total
    FROM v_contracts c LEFT JOIN v_p_est e ON c.project_id = e.project_id
    LEFT JOIN v_p_labor l ON c.project_id = l.project_id
    LEFT JOIN (SELECT project_id, round_even({dsum('total_cost')}, 2) AS material_actual
      FROM v_materials GROUP BY 1) m ON c.project_id = m.project_id))""")
view("v_p_billing", """
SELECT *, round_even(percent_complete - billing_complete_pct, 2) AS billing_gap_pct FROM (
  SELECT f.*, b.* EXCLUDE (project_id), percent_complete,
    round_even(cumulative_billed / NULLIF(contract_value, 0) * 100, 2) AS billing_complete_pct
  FROM v_p_fin f LEFT JOIN v_p_latest b ON f.project_id = b.project_id
  LEFT JOIN v_p_progress g ON f.project_id = g.project_id)""")


def _stage100(c: str) -> str:
    return (f"CASE WHEN {c} >= 95 THEN 'complete' WHEN {c} >= 75 THEN 'late' "
            f"WHEN {c} >= 15 THEN 'active' ELSE 'early' END")


view("v_packet", f"""
SELECT project_id, project_name, project_stage, gc_name AS customer,
  substantial_completion_date AS delivery_status, contract_value, estimated_cost_total,
  actual_cost_total, estimated_margin_dollars, estimated_margin_pct, realized_margin_dollars,
  realized_margin_pct, labor_estimated, labor_actual, material_estimated, material_actual,
  other_cost_estimated, cumulative_billed AS billed_to_date, billing_complete_pct,
  percent_complete, billing_gap_pct, retention_held, COALESCE(approved_count, 0)
    AS approved_count, approved_value, COALESCE(pending_count, 0) AS pending_count, pending_value,
  COALESCE(rejected_count, 0) AS rejected_count, rejected_value,
  COALESCE(missing_scope_signals, '') AS missing_scope_signals, crew_size_peak, overtime_share,
  delivery_clustering_signal, COALESCE(top_cost_codes, '') AS top_cost_codes,
  COALESCE(top_sov_variances, '') AS top_sov_variances,
  COALESCE(schedule_pressure_signals, '') AS schedule_pressure_signals, field_notes_summary,
  rfi_summary, change_order_summary,
  NULLIF(concat_ws('. ', 'Latest application #' || application_number, 'status ' || status,
    'billing is ' || {fix('billing_complete_pct', 1)} || '% of contract',
    'work progress is ' || {fix('percent_complete', 1)} || '% complete',
    CASE WHEN retention_held <> 0 THEN 'retention held ' || {usd('retention_held')} END), '')
    AS billing_notes_summary,
  COALESCE(notable_events, '') AS notable_events,
  CASE WHEN labor_variance IS NULL AND material_variance IS NULL THEN NULL
    WHEN material_variance IS NULL OR labor_variance >= material_variance THEN 'labor'
    ELSE 'material' END AS largest_variance_bucket,
  greatest(labor_variance, material_variance) AS largest_variance_dollars,
  labor_overrun_multiple, material_overrun_multiple,
  COALESCE(billing_complete_pct >= 95, FALSE) AS is_billing_nearly_complete,
  project_stage = 'complete' AS is_project_effectively_complete,
  COALESCE(NULLIF(concat_ws(' | ', CASE WHEN billing_gap_pct > 5 THEN 'billing_acceleration' END,
    CASE WHEN approved_value > 0 THEN 'approved_change_order_recovery' END,
    CASE WHEN pending_value > 0 THEN 'pending_change_order_recovery' END,
    CASE WHEN retention_held > 0 THEN 'retention_release' END,
    CASE WHEN project_stage NOT IN ('complete', 'unknown')
      THEN 'remaining_work_margin_protection' END), ''), 'limited_recovery_only')
    AS recovery_paths_available
FROM (SELECT *, CASE WHEN substantial_completion_date <= {AS_OF} THEN 'complete'
    WHEN percent_complete IS NOT NULL THEN {_stage100('percent_complete')}
    WHEN billing_complete_pct IS NOT NULL THEN {_stage100('billing_complete_pct')}
    ELSE 'unknown' END AS project_stage FROM v_p_billing)
LEFT JOIN v_p_co USING (project_id) LEFT JOIN v_p_co_text USING (project_id)
LEFT JOIN v_p_crew USING (project_id) LEFT JOIN v_p_top_codes USING (project_id)
LEFT JOIN v_p_top_lines USING (project_id) LEFT JOIN v_p_cluster USING (project_id)
LEFT JOIN v_p_signals USING (project_id) LEFT JOIN v_p_notes USING (project_id)
LEFT JOIN v_p_rfi_text USING (project_id)""")

query("latest_billing", lambda p: p.latest_billing, "SELECT * FROM v_p_latest")
query("latest_application",
      lambda p: evidence.latest_application(p.tables["billing_line_items"]),
      "SELECT * FROM v_p_last_app")
query("weighted_pct_complete", lambda p: p.weighted_pct_complete, "SELECT * FROM v_p_progress")
query("packet_financials", lambda p: p.packet_financials, "SELECT * FROM v_p_fin")
query("packet_billing", lambda p: p.packet_billing, "SELECT * FROM v_p_billing")
shared("project_packet", lambda p: packets.flat_packet(p.packet), "SELECT * FROM v_packet")
for _key, _cols in {
    "billing_summary_text": ["billing_notes_summary"],
    "stage_full": ["project_stage"],
    "recovery_paths_a": ["project_stage", "recovery_paths_available"],
    "largest_variance": ["largest_variance_bucket", "largest_variance_dollars"],
}.items():
    query(_key, lambda p, cols=_cols: packets.flat_packet(p.packet).select("project_id", *cols),
          f"SELECT project_id, {', '.join(_cols)} FROM v_packet")

_ROWS = " UNION ALL ".join(
    f"SELECT project_id, '{name}' AS table_name, COUNT(*) AS row_count FROM {v} GROUP BY 1"
    for name, v in {
        "contracts": "v_contracts", "labor_logs": "v_labor",
        "material_deliveries": "v_materials", "sov_budget": "v_sov_budget", "sov": "v_sov",
        "change_orders": "v_change_orders", "rfis": "v_rfis",
        "billing_history": "v_billing_history",
        "billing_line_items": "v_billing_line_items", "field_notes": "v_field_notes",
    }.items()
)
view("v_table_rows", _ROWS)
query("row_counts", lambda p: p.row_counts, "SELECT * FROM v_table_rows")

# ---- legacy and hybrid packets -----------------------------------------------------------------

_B = "billing_complete_pct"
view("v_legacy", f"""
SELECT *, billed_to_date * 0.1::DOUBLE AS retention_held,
  CASE WHEN billing_gap_pct > 0 THEN billing_gap_pct * contract_value END
    AS unbilled_approved_amount,
  COALESCE({_B} >= 0.90, FALSE) AS is_billing_nearly_complete,
  COALESCE({_B} >= 0.95, FALSE) AS is_project_effectively_complete,
  concat_ws(' | ', CASE WHEN billing_gap_pct > 0.05 THEN 'billing_acceleration' END,
    CASE WHEN pending_value > 0 THEN 'pending_change_orders' END,
    CASE WHEN rejected_value > 0 THEN 'rejected_co_escalation' END,
    CASE WHEN {_B} < 0.95 THEN 'retention_release' END,
    CASE WHEN {_B} IS NULL OR {_B} < 0.75 THEN 'operational_efficiency' END)
    AS recovery_paths_available
FROM (SELECT *, percent_complete - {_B} AS billing_gap_pct,
    CASE WHEN contract_value <> 0 THEN contract_value * {_B} END AS billed_to_date,
    CASE WHEN contract_value <> 0 THEN contract_value * estimated_margin_pct END
      AS estimated_margin_dollars,
    CASE WHEN contract_value <> 0 THEN contract_value * realized_margin_pct END
      AS realized_margin_dollars,
    CASE WHEN {_B} IS NULL THEN 'unknown' WHEN {_B} >= 0.95 THEN 'complete'
      WHEN {_B} >= 0.75 THEN 'late' WHEN {_B} >= 0.15 THEN 'active' ELSE 'early' END
      AS project_stage
  FROM (SELECT project_id, project_name, gc_name AS customer,
      COALESCE(original_contract_value, 0) AS contract_value,
      est_labor + est_material AS estimated_cost_total,
      actual_labor_cost + actual_material_cost AS actual_cost_total,
      bid_margin AS estimated_margin_pct, realized_margin_pct,
      CASE WHEN billing_data_available THEN pct_billed END AS {_B},
      CASE WHEN total_budget > 0 THEN least(actual_tracked_cost / total_budget, 1) ELSE 0 END
        AS percent_complete,
      co_approved_count AS approved_count, co_approved_value AS approved_value,
      co_pending_count AS pending_count, pending_co_value AS pending_value,
      co_rejected_count AS rejected_count, co_rejected_value AS rejected_value,
      actual_labor_cost / NULLIF(est_labor, 0) AS labor_overrun_multiple,
      actual_material_cost / NULLIF(est_material, 0) AS material_overrun_multiple
    FROM v_flagged))""")
shared("legacy_packet", lambda p: packets.legacy_packet(p.flagged, p.rules),
       "SELECT * FROM v_legacy")
shared("recovery_paths_b",
       lambda p: packets.legacy_packet(p.flagged, p.rules).select(
           "project_id", "recovery_paths_available"),
       "SELECT project_id, recovery_paths_available FROM v_legacy")

_CO3 = ", ".join(
    f"COUNT(*) FILTER (lower(trim(status)) = '{s}') AS {s}_count, "
    f"{dsum(f'''CASE WHEN lower(trim(status)) = '{s}' THEN amount ELSE 0 END''')} AS {s}_value"
    for s in ("approved", "pending", "rejected")
)
view("v_co_totals", f"SELECT project_id, {_CO3} FROM v_change_orders GROUP BY 1")
query("co_totals_by_status", lambda p: p.co_totals, "SELECT * FROM v_co_totals")
_Z = ", ".join(f"COALESCE({s}_{k}, 0) AS {s}_{k}" for s in ("approved", "pending", "rejected")
               for k in ("count", "value"))
_PARTS = {"change_orders": "co_number", "rfis": "rfi_number",
          "field_notes": "date DESC NULLS LAST, author"}
for _s, _order in _PARTS.items():
    _item = ", ".join(f"'{c}': {c}" for c in packets.DETAILS[_s])
    view(f"v_parts_{_s}", f"""
SELECT project_id, (rn - 1) // {packets.PART_ITEMS} + 1 AS part,
  CAST(to_json(list({{{_item}}} ORDER BY rn)) AS VARCHAR) AS {_s}
FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY project_id ORDER BY {_order} NULLS LAST, tie) AS rn
  FROM (SELECT *, {packets.detail_tie(_s, 'VARCHAR')} AS tie FROM v_{_s}))
GROUP BY 1, 2""")
view("v_parts", """
SELECT * FROM v_parts_change_orders FULL OUTER JOIN v_parts_rfis USING (project_id, part)
FULL OUTER JOIN v_parts_field_notes USING (project_id, part)""")
_LISTS = ", ".join(f"COALESCE(d.{s}, '[]') AS {s}" for s in packets.DETAILS)
shared("hybrid_packet",
       lambda p: p.hybrid_packet.withColumns(
           {s: F.to_json(s, {"ignoreNullFields": "false"}) for s in packets.DETAILS}), f"""
SELECT m.project_id, COALESCE(d.part, 1) AS part, project_name, gc_name AS customer, risk_level,
  severity, realized_margin_pct, cost_vs_budget, labor_burn_ratio, labor_avg_pct_overrun,
  material_avg_pct_overrun, billing_gap_pct, approved_co_pct, rejected_co_pct, pending_co_pct, {_Z},
  overtime_spike, burn_rate_acceleration, crew_size_spike, forecast_to_complete_trend,
  COALESCE(n, 0) AS field_notes_count, COALESCE(r.total_rfis, 0) AS rfi_count, max_open_rfi_age,
  alert_class, trigger_score, primary_trigger, supporting_triggers, fired_triggers, why_now,
  main_issue, management_cause, evidence, recommended_action, {_LISTS}
FROM v_management m LEFT JOIN v_co_totals c ON m.project_id = c.project_id
LEFT JOIN v_rfi_counts r ON m.project_id = r.project_id
LEFT JOIN (SELECT project_id, COUNT(*) AS n FROM v_field_notes GROUP BY 1) f
  ON m.project_id = f.project_id
LEFT JOIN v_parts d ON m.project_id = d.project_id""")
query("detail_union",
      lambda p: packets.detail_union(
          p.tables["change_orders"], p.tables["rfis"], p.tables["field_notes"]), """
SELECT project_id, 'change_orders' AS section, co_number AS item_id, date_submitted AS item_date,
  description AS title, status, amount, reason_category AS kind FROM v_change_orders
UNION ALL SELECT project_id, 'rfis', rfi_number, date_submitted, subject, status, NULL, priority
FROM v_rfis
UNION ALL SELECT project_id, 'field_notes', author, date, content, NULL, NULL, note_type
FROM v_field_notes""")

# ---- drill-down ----------------------------------------------------------------------------------

_RATE = "COALESCE(avg_hourly_rate, 0) * COALESCE(avg_burden_multiplier, 1)"
view("v_weeks_cost", f"""
SELECT project_id, week_start, round_even(COALESCE(total_hours_st, 0) * ({_RATE}), 0) AS regular,
  round_even(COALESCE(total_hours_ot, 0) * ({_RATE}) * 1.5::DOUBLE, 0) AS overtime
FROM v_labor_week""".replace("* (COALESCE(avg_hourly_rate, 0) * COALESCE(avg_burden_multiplier, 1))",
                             "* COALESCE(avg_hourly_rate, 0) * COALESCE(avg_burden_multiplier, 1)"))
view("v_days_open", f"""
SELECT project_id, rfi_number AS id, lower(trim(status)) AS status,
  CAST(CASE WHEN date_responded IS NOT NULL
    AND lower(trim(status)) NOT IN ('open', 'pending response')
    THEN date_responded - date_submitted ELSE {AS_OF} - date_submitted END AS BIGINT) AS days_open,
  subject AS description, priority, cost_impact FROM v_rfis""")
view("v_retention", """
SELECT id AS project_id, CASE WHEN billing_data_available AND r = 0 AND percent_billed >= 0.95
  THEN contract_value * percent_billed * 0.1::DOUBLE ELSE r END AS retention_held
FROM (SELECT b.*, COALESCE(l.retention_held, b.retention_held) AS r
  FROM v_base b LEFT JOIN v_p_latest l ON b.id = l.project_id)""")
query("labor_by_week", lambda p: p.labor_by_week, "SELECT * FROM v_weeks_cost")
query("overtime_cost_ratio", lambda p: packets.overtime_cost_ratio(p.labor_by_week), f"""
SELECT project_id, {dsum('overtime')} / NULLIF({dsum('regular')} + {dsum('overtime')}, 0)
  AS overtime_cost_ratio FROM v_weeks_cost GROUP BY 1""")
query("rfi_days_open", lambda p: p.rfi_days_open, "SELECT * FROM v_days_open")
query("days_open",
      lambda p: p.rfis.select("rfi_number", stages.days_open(
          F.col("date_submitted"), F.col("date_responded"), F.lower(F.trim("status")), p.as_of
      ).alias("days_open")), "SELECT id AS rfi_number, days_open FROM v_days_open")
shared("retention_estimate", lambda p: p.retention, "SELECT * FROM v_retention")
shared("project_drilldown",
       lambda p: packets.project_drilldown(
           p.project_base, p.co_totals, p.retention, p.recent_notes, p.row_counts), f"""
SELECT b.* EXCLUDE (retention_held, fired_triggers, co_approved_value, co_pending_value,
    co_rejected_value), COALESCE(approved_value, co_approved_value) AS co_approved_value,
  COALESCE(pending_value, co_pending_value) AS co_pending_value,
  COALESCE(rejected_value, co_rejected_value) AS co_rejected_value, r.retention_held,
  field_note_summary, enriched_sources
FROM v_base b LEFT JOIN v_co_totals c ON b.id = c.project_id
LEFT JOIN v_retention r ON b.id = r.project_id LEFT JOIN v_p_recent n ON b.id = n.project_id
LEFT JOIN (SELECT project_id, string_agg(table_name, ' | ' ORDER BY table_name)
  AS enriched_sources FROM ({_ROWS}) GROUP BY 1) s ON b.id = s.project_id""")
query("sov_overruns_5", lambda p: packets.sov_overruns(p.sov_budget_vs_actual), f"""
SELECT project_id, line_rank, sov_line_id || ': ' || {usd('actual - budgeted')} || ' variance'
  AS overrun
FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY project_id ORDER BY sov_line_id) AS line_rank
  FROM v_line_actuals WHERE actual > budgeted) WHERE line_rank <= 5""")
_AMOUNTS = ", ".join(f"CASE WHEN {s}_value <> 0 THEN {usd(s + '_value')} || ' {s}' END"
                     for s in ("approved", "pending", "rejected"))
query("brief_texts", lambda p: packets.brief_texts(p.tables["change_orders"], p.tables["rfis"]),
      f"""
SELECT project_id, co_text, rfi_text
FROM (SELECT project_id, NULLIF(concat_ws(', ', {_AMOUNTS}), '') AS co_text FROM v_co_totals)
FULL OUTER JOIN (SELECT project_id, CASE WHEN o > 0 THEN o || ' open RFIs out of ' || n || ' total'
    ELSE n || ' RFIs, all resolved' END AS rfi_text
  FROM (SELECT project_id, COUNT(*) AS n, COUNT(*) FILTER (status = 'open') AS o
    FROM v_days_open GROUP BY 1)) USING (project_id)""")


def _n_usd(x: str) -> str:
    return (f"CASE WHEN {x} IS NULL THEN 'N/A' WHEN abs({x}) >= 1000000 THEN '$' || "
            f"{fix(f'{x} / 1000000', 2)} || 'M' ELSE '$' || {fix(f'{x} / 1000', 0)} || 'K' END")


def _n_pct(x: str) -> str:
    return f"CASE WHEN {x} IS NULL THEN 'N/A' ELSE {pct_text(x)} END"


def _cost_line(label: str, k: str) -> str:
    return (f"'  {label} Budget: ' || {_n_usd(k + '_budget')} || ' | Actual: ' || "
            f"{_n_usd(k + '_actual')} || ' | Overrun: ' || {_n_usd(k + '_overrun')}")


_LINES = [
    "'PROJECT: ' || id || ' -- ' || name", "'SECTOR: ' || sector",
    f"'CONTRACT VALUE: ' || {_n_usd('contract_value')}", "'MARGIN ANALYSIS'",
    f"'  Bid Margin:      ' || {_n_pct('bid_margin')}",
    f"'  Realized Margin: ' || {_n_pct('realized_margin')}",
    f"'  Margin Erosion:  ' || {_n_pct('abs(margin_delta)')} || ' below bid'",
    "'  Severity:        ' || upper(severity)", "'COST BREAKDOWN'",
    _cost_line("Labor    --", "labor"), _cost_line("Material --", "material"),
    "'BILLING STATUS'", f"'  % Complete: ' || {_n_pct('percent_complete')}",
    f"'  % Billed:   ' || CASE WHEN billing_data_available THEN {_n_pct('percent_billed')} "
    "ELSE 'N/A (billing history unavailable)' END",
    f"'  Billing Gap: ' || CASE WHEN billing_data_available THEN {_n_pct('billing_gap')} || ' (' "
    f"|| {_n_usd('contract_value * COALESCE(billing_gap, 0)')} || ' unbilled)' ELSE 'N/A' END",
    "'FIELD NOTES'", "COALESCE(field_note_summary, 'None available.')",
]
_HEADER = " UNION ALL ".join(
    f"SELECT id AS project_id, 1 AS section, '{i:04d}' AS line_key, {x} AS line FROM head"
    for i, x in enumerate(_LINES)
)
shared("project_context",
       lambda p: packets.project_context(
           p.project_base, p.recent_notes, p.tables["change_orders"], p.rfi_days_open), f"""
SELECT * FROM (WITH head AS (SELECT b.*, field_note_summary FROM v_base b
    LEFT JOIN v_p_recent n ON b.id = n.project_id),
  cos AS (SELECT c.* FROM v_change_orders c WHERE project_id IN (SELECT id FROM head)),
  waiting AS (SELECT * FROM v_days_open WHERE status = 'open'
    AND project_id IN (SELECT id FROM head))
{_HEADER}
UNION ALL SELECT id, 2, '', 'CHANGE ORDERS (' || COALESCE(n, 0) || ')'
    || CASE WHEN n IS NULL THEN chr(10) || '  None' ELSE '' END
  FROM head LEFT JOIN (SELECT project_id, COUNT(*) AS n FROM cos GROUP BY 1) k
    ON id = k.project_id
UNION ALL SELECT project_id, 2, co_number, '  ' || co_number || ' [' || upper(status) || '] '
    || {_n_usd('amount')} || ' -- ' || description FROM cos
UNION ALL SELECT id, 3, '', 'OPEN RFIs'
    || CASE WHEN n IS NULL THEN chr(10) || '  None' ELSE '' END
  FROM head LEFT JOIN (SELECT project_id, COUNT(*) AS n FROM waiting GROUP BY 1) w
    ON head.id = w.project_id
UNION ALL SELECT project_id, 3, id, '  ' || id || ' -- open ' || days_open || 'd -- '
    || description FROM waiting)""")
