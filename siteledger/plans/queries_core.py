"""Queries over cleaning, roll-ups, variances, health, flags, risk and causes."""

from __future__ import annotations

from siteledger.operators import cleaning, summaries, variance
from siteledger.plans.catalog import query
from siteledger.plans.oracle_views import (
    AS_OF, CATEGORY, LABOR_COST, ROLE, dmean, dsum, rmean, view,
)

# ---- cleaning ----------------------------------------------------------------

view("v_labor_first", """
SELECT * EXCLUDE (rn) FROM (
  SELECT *, ROW_NUMBER() OVER (PARTITION BY log_id ORDER BY date, project_id, employee_id, role,
    sov_line_id, hours_st, hours_ot, hourly_rate, burden_multiplier, work_area, cost_code) AS rn
  FROM v_labor_logs) WHERE rn = 1 AND log_id IS NOT NULL""")
view("v_labor", f"""
SELECT * REPLACE ({ROLE} AS role) FROM v_labor_first WHERE project_id IS NOT NULL""")
view("v_materials", f"""
SELECT project_id, delivery_id, date, sov_line_id, {CATEGORY} AS material_category,
  item_description, quantity, unit, unit_cost, quantity * unit_cost AS total_cost,
  total_cost AS total_cost_original, po_number, vendor, received_by, condition_notes
FROM v_material_deliveries WHERE project_id IS NOT NULL AND delivery_id IS NOT NULL""")

query("normalize_role",
      lambda p: p.tables["labor_logs"].selectExpr(
          "log_id", "role", f"{cleaning.normalize_role()} AS canonical_role"),
      f"SELECT log_id, role, {ROLE} AS canonical_role FROM v_labor_logs")
query("normalize_category",
      lambda p: p.tables["material_deliveries"].selectExpr(
          "delivery_id", "material_category",
          f"{cleaning.normalize_category()} AS canonical_category"),
      f"""SELECT delivery_id, material_category, {CATEGORY} AS canonical_category
      FROM v_material_deliveries""")
query("dedup_labor", lambda p: cleaning.dedup_labor(p.tables["labor_logs"]),
      "SELECT * FROM v_labor_first")
query("clean_labor", lambda p: p.labor_clean, "SELECT * FROM v_labor")
query("clean_materials", lambda p: p.materials_clean, "SELECT * FROM v_materials")
query("materials_export", lambda p: p.materials,
      "SELECT * EXCLUDE (total_cost_original) FROM v_materials")
query("clean_change_orders", lambda p: p.change_orders, "SELECT * FROM v_change_orders")
query("clean_rfis", lambda p: p.rfis, "SELECT * FROM v_rfis")

LABOR_QUALITY = f"""
SELECT 'labor_logs' AS dataset, 'input_rows' AS metric, COUNT(*) AS value FROM v_labor_logs
UNION ALL SELECT 'labor_logs', 'duplicates_removed', COUNT(*) - COUNT(DISTINCT log_id)
  FROM v_labor_logs
UNION ALL SELECT 'labor_logs', 'roles_normalized', COUNT(*) FROM v_labor_logs
  WHERE role <> ({ROLE})
UNION ALL SELECT 'labor_logs', 'output_rows', COUNT(*) FROM v_labor"""
MATERIAL_QUALITY = f"""
SELECT 'material_deliveries' AS dataset, 'input_rows' AS metric, COUNT(*) AS value
  FROM v_material_deliveries
UNION ALL SELECT 'material_deliveries', 'categories_normalized', COUNT(*)
  FROM v_material_deliveries WHERE material_category <> ({CATEGORY})
UNION ALL SELECT 'material_deliveries', 'costs_recalculated', COUNT(*)
  FROM v_material_deliveries WHERE abs(quantity * unit_cost - total_cost) > 10
UNION ALL SELECT 'material_deliveries', 'output_rows', COUNT(*) FROM v_materials"""
CO_RFI_QUALITY = """
SELECT 'change_orders' AS dataset, 'input_rows' AS metric, COUNT(*) AS value FROM v_change_orders
UNION ALL SELECT 'change_orders', 'output_rows', COUNT(co_number) FROM v_change_orders
UNION ALL SELECT 'rfis', 'input_rows', COUNT(*) FROM v_rfis
UNION ALL SELECT 'rfis', 'output_rows', COUNT(rfi_number) FROM v_rfis"""
query("labor_quality", lambda p: cleaning.labor_quality(p.tables["labor_logs"]), LABOR_QUALITY)
query("material_quality",
      lambda p: cleaning.material_quality(p.tables["material_deliveries"], p.rules),
      MATERIAL_QUALITY)
query("co_rfi_quality",
      lambda p: cleaning.co_rfi_quality(p.tables["change_orders"], p.tables["rfis"]),
      CO_RFI_QUALITY)
query("quality_report", lambda p: cleaning.quality_report(p.tables, p.rules),
      f"{LABOR_QUALITY} UNION ALL {MATERIAL_QUALITY} UNION ALL {CO_RFI_QUALITY}")
query("labor_valid_rows", lambda p: p.labor_valid,
      "SELECT * FROM v_labor WHERE sov_line_id IS NOT NULL AND hourly_rate IS NOT NULL")
query("material_valid_rows", lambda p: p.materials_valid,
      """SELECT * EXCLUDE (total_cost_original) FROM v_materials
      WHERE sov_line_id IS NOT NULL AND total_cost IS NOT NULL""")

# ---- roll-ups ------------------------------------------------------------------

LABOR_AGGS = f"""
  {dsum('hours_st')} AS total_hours_st, {dsum('hours_ot')} AS total_hours_ot,
  {dsum('hours_st')} + {dsum('hours_ot')} * 1.5 AS total_effective_hours,
  {dmean('hourly_rate')} AS avg_hourly_rate, {dmean('burden_multiplier')} AS avg_burden_multiplier,
  CAST(SUM({LABOR_COST}) AS DOUBLE) AS total_labor_cost,
  MIN(date) AS first_date, MAX(date) AS last_date,
  {dsum('hours_ot')} / NULLIF({dsum('hours_st')} + {dsum('hours_ot')}, 0)
    AS ot_share_of_raw_hours"""
LABOR_COUNTS = """COUNT(*) AS num_logs, COUNT(DISTINCT employee_id) AS num_employees,
  COUNT(DISTINCT role) AS num_roles"""
MATERIAL_AGGS = f"""COUNT(*) AS num_deliveries, COUNT(DISTINCT delivery_id) AS num_unique_deliveries,
  COUNT(DISTINCT material_category) AS num_material_categories,
  COUNT(DISTINCT vendor) AS num_vendors, {dsum('quantity')} AS total_quantity,
  {dmean('unit_cost')} AS avg_unit_cost, {dsum('total_cost')} AS total_material_cost,
  MIN(date) AS first_delivery_date, MAX(date) AS last_delivery_date"""
SOV_COUNT = "COUNT(DISTINCT sov_line_id) AS num_sov_lines"
WEEK = "CAST(date_trunc('week', date) AS DATE) AS week_start"

view("v_labor_project", f"""SELECT project_id, {LABOR_COUNTS}, {SOV_COUNT}, {LABOR_AGGS}
FROM v_labor GROUP BY 1""")
view("v_labor_sov", f"""SELECT project_id, sov_line_id, {LABOR_COUNTS}, {LABOR_AGGS}
FROM v_labor GROUP BY 1, 2""")
view("v_labor_week", f"""SELECT project_id, {WEEK}, {LABOR_COUNTS}, {LABOR_AGGS}
FROM v_labor GROUP BY 1, 2""")
view("v_material_project", f"""SELECT project_id, {MATERIAL_AGGS}, {SOV_COUNT}
FROM v_materials GROUP BY 1""")
view("v_material_sov", f"""SELECT project_id, sov_line_id, {MATERIAL_AGGS}
FROM v_materials GROUP BY 1, 2""")
view("v_material_week", f"""SELECT project_id, {WEEK}, {MATERIAL_AGGS}, {SOV_COUNT}
FROM v_materials GROUP BY 1, 2""")
view("v_change_summary", f"""
SELECT project_id, COUNT(*) AS total_change_orders,
  COUNT(*) FILTER (lower(trim(status)) = 'approved') AS approved_cos,
  COUNT(*) FILTER (lower(trim(status)) = 'pending') AS pending_cos,
  COUNT(*) FILTER (lower(trim(status)) = 'rejected') AS rejected_cos,
  {dsum('amount')} AS total_co_value,
  {dsum("CASE WHEN lower(trim(status)) = 'approved' THEN amount ELSE 0 END")} AS approved_value,
  {dsum("CASE WHEN lower(trim(status)) = 'rejected' THEN amount ELSE 0 END")} AS rejected_value,
  {dsum('schedule_impact_days')} AS total_schedule_impact,
  {dsum('labor_hours_impact')} AS total_labor_impact
FROM v_change_orders GROUP BY 1""")
view("v_rfi_counts", "SELECT project_id, COUNT(*) AS total_rfis FROM v_rfis GROUP BY 1")
view("v_linked_rfis", """
SELECT project_id, COUNT(DISTINCT related_rfi) AS rfis_linked_to_cos FROM v_change_orders
WHERE related_rfi IS NOT NULL AND trim(related_rfi) <> '' GROUP BY 1""")
view("v_rfi_summary", """
SELECT project_id, total_rfis, COALESCE(rfis_linked_to_cos, 0) AS rfis_linked_to_cos,
  CASE WHEN total_rfis > 50 THEN 'HIGH' WHEN total_rfis > 20 THEN 'MEDIUM' ELSE 'LOW' END
    AS rfi_level,
  CASE WHEN total_rfis = 0 THEN 0 ELSE CAST(COALESCE(rfis_linked_to_cos, 0) AS DOUBLE)
    / total_rfis END AS rfi_to_co_ratio
FROM v_rfi_counts LEFT JOIN v_linked_rfis USING (project_id)""")
view("v_budget", f"""
SELECT *, est_labor + est_material + est_equip + est_sub AS total_budget FROM (
  SELECT project_id, COALESCE({dsum('estimated_labor_cost')}, 0) AS est_labor,
    COALESCE({dsum('estimated_material_cost')}, 0) AS est_material,
    COALESCE({dsum('estimated_equipment_cost')}, 0) AS est_equip,
    COALESCE({dsum('estimated_sub_cost')}, 0) AS est_sub
  FROM v_sov_budget GROUP BY 1)""")
view("v_co_health", f"""
SELECT project_id, COUNT(*) FILTER (b = 'a') AS co_approved_count,
  COUNT(*) FILTER (b = 'p') AS co_pending_count, COUNT(*) FILTER (b = 'r') AS co_rejected_count,
  {dsum("CASE WHEN b = 'a' THEN amount ELSE 0 END")} AS co_approved_value,
  {dsum("CASE WHEN b = 'p' THEN amount ELSE 0 END")} AS pending_co_value,
  {dsum("CASE WHEN b = 'r' THEN amount ELSE 0 END")} AS co_rejected_value
FROM (SELECT project_id, COALESCE(amount, 0) AS amount,
    CASE WHEN lower(trim(status)) = 'approved' THEN 'a'
      WHEN lower(trim(status)) IN ('rejected', 'denied') THEN 'r' ELSE 'p' END AS b
  FROM v_change_orders) GROUP BY 1""")
view("v_rfi_health", f"""
SELECT project_id, COUNT(*) AS rfi_count,
  COUNT(*) FILTER (lower(trim(cost_impact)) IN ('true', 'yes', '1', 'y')) AS rfi_cost_impact_count,
  COUNT(*) FILTER (lower(trim(priority)) IN ('high', 'critical')) AS rfi_high_critical,
  COUNT(*) FILTER (is_open) AS rfi_open,
  CAST(MAX(CASE WHEN is_open THEN greatest({AS_OF} - date_submitted, 0) END) AS DOUBLE)
    AS max_open_rfi_age
FROM (SELECT *, lower(trim(status)) NOT IN ('closed', 'resolved', 'answered', 'complete')
  AS is_open FROM v_rfis) GROUP BY 1""")
view("v_billing_max", """SELECT project_id, MAX(cumulative_billed) AS cumulative_billed,
  TRUE AS billing_data_available FROM v_billing_history GROUP BY 1""")
view("v_billing_sum", f"""SELECT project_id, {dsum('period_total')} AS total_billed
FROM v_billing_history GROUP BY 1""")

query("labor_project_summary", lambda p: p.labor_project, "SELECT * FROM v_labor_project")
query("labor_project_sov_summary", lambda p: p.labor_sov, "SELECT * FROM v_labor_sov")
query("labor_project_week_summary", lambda p: p.labor_week, "SELECT * FROM v_labor_week")
query("material_project_summary", lambda p: p.material_project, "SELECT * FROM v_material_project")
query("material_project_sov_summary", lambda p: p.material_sov, "SELECT * FROM v_material_sov")
query("material_project_week_summary", lambda p: p.material_week, "SELECT * FROM v_material_week")
query("change_summary", lambda p: p.change_summary, "SELECT * FROM v_change_summary")
query("rfi_counts", lambda p: p.rfi_counts, "SELECT * FROM v_rfi_counts")
query("linked_rfis", lambda p: p.linked_rfis, "SELECT * FROM v_linked_rfis")
query("rfi_summary", lambda p: p.rfi_summary, "SELECT * FROM v_rfi_summary")
query("budget_rollup", lambda p: p.budget, "SELECT * FROM v_budget")
query("co_health_summary", lambda p: p.co_health, "SELECT * FROM v_co_health")
query("rfi_health_summary", lambda p: p.rfi_health, "SELECT * FROM v_rfi_health")
query("billing_max", lambda p: p.billing_max, "SELECT * FROM v_billing_max")
query("billing_sum", lambda p: p.billing_sum, "SELECT * FROM v_billing_sum")
query("rfi_by_week", lambda p: summaries.rfi_by_week(p.rfis), """
SELECT project_id, CAST(w AS VARCHAR) || '/' || CAST(w + 6 AS VARCHAR) AS week,
  COUNT(rfi_number) AS rfi_count
FROM (SELECT *, CAST(date_trunc('week', date_submitted) AS DATE) AS w FROM v_rfis
  WHERE date_submitted IS NOT NULL) GROUP BY 1, 2""")

# ---- actual against budget -------------------------------------------------------

view("v_labor_vb", """
SELECT l.project_id, l.sov_line_id, total_labor_cost AS actual_labor_cost, total_hours_st,
  total_hours_ot, total_effective_hours, avg_hourly_rate, avg_burden_multiplier,
  ot_share_of_raw_hours, first_date, last_date, estimated_labor_hours AS budget_labor_hours,
  estimated_labor_cost AS budget_labor_cost, productivity_factor, key_assumptions,
  total_labor_cost - estimated_labor_cost AS labor_variance,
  (total_labor_cost - estimated_labor_cost) / NULLIF(estimated_labor_cost, 0) AS pct_overrun
FROM v_labor_sov l LEFT JOIN v_sov_budget b
  ON l.project_id = b.project_id AND l.sov_line_id = b.sov_line_id""")
view("v_material_vb", """
SELECT m.project_id, m.sov_line_id, total_material_cost AS actual_material_cost, num_deliveries,
  num_unique_deliveries, num_material_categories, num_vendors, total_quantity, avg_unit_cost,
  first_delivery_date, last_delivery_date, estimated_material_cost AS budget_material_cost,
  productivity_factor, key_assumptions,
  total_material_cost - estimated_material_cost AS material_variance,
  (total_material_cost - estimated_material_cost) / NULLIF(estimated_material_cost, 0)
    AS pct_overrun
FROM v_material_sov m LEFT JOIN v_sov_budget b
  ON m.project_id = b.project_id AND m.sov_line_id = b.sov_line_id""")
view("v_weekly", """
SELECT project_id, week_start, labor_cost, material_cost, labor_cost + material_cost AS total_cost,
  labor_cost / NULLIF(labor_cost + material_cost, 0) AS labor_pct,
  material_cost / NULLIF(labor_cost + material_cost, 0) AS material_pct
FROM (SELECT COALESCE(l.project_id, m.project_id) AS project_id,
    COALESCE(l.week_start, m.week_start) AS week_start,
    COALESCE(total_labor_cost, 0) AS labor_cost, COALESCE(total_material_cost, 0) AS material_cost
  FROM v_labor_week l FULL OUTER JOIN v_material_week m
    ON l.project_id = m.project_id AND l.week_start = m.week_start)""")
view("v_variance_lines", """
SELECT COALESCE(l.project_id, m.project_id) AS project_id,
  COALESCE(l.sov_line_id, m.sov_line_id) AS sov_line_id, actual_labor_cost, labor_variance,
  l.pct_overrun AS labor_pct_overrun, actual_material_cost, material_variance,
  m.pct_overrun AS material_pct_overrun
FROM v_labor_vb l FULL OUTER JOIN v_material_vb m
  ON l.project_id = m.project_id AND l.sov_line_id = m.sov_line_id""")
view("v_cost_summary", f"""
SELECT project_id, {dsum('actual_labor_cost')} AS total_labor_cost,
  {dsum('actual_material_cost')} AS total_material_cost,
  {dsum('actual_labor_cost')} + {dsum('actual_material_cost')} AS total_cost
FROM v_variance_lines GROUP BY 1""")
view("v_billing_analysis", """
SELECT project_id, total_labor_cost, total_material_cost, total_cost, total_billed,
  total_billed - total_cost AS billing_gap,
  (total_billed - total_cost) / NULLIF(total_cost, 0) AS margin_pct
FROM v_cost_summary LEFT JOIN v_billing_sum USING (project_id)""")
view("v_full_analysis", """
SELECT b.*, total_change_orders, approved_cos, pending_cos, rejected_cos, total_co_value,
  approved_value, rejected_value, total_schedule_impact, total_labor_impact,
  rejected_value / NULLIF(total_co_value, 0) AS rejected_value_ratio,
  CAST(rejected_cos AS DOUBLE) / NULLIF(total_change_orders, 0) AS rejected_count_ratio
FROM v_billing_analysis b LEFT JOIN v_change_summary c ON b.project_id = c.project_id""")
view("v_analysis_rfi", """
SELECT f.*, total_rfis, rfis_linked_to_cos, rfi_level, rfi_to_co_ratio
FROM v_full_analysis f LEFT JOIN v_rfi_summary r ON f.project_id = r.project_id""")
view("v_labor_rollup", f"""
SELECT project_id, COALESCE({dsum('actual_labor_cost')}, 0) AS labor_actual_cost,
  COALESCE({dsum('budget_labor_cost')}, 0) AS labor_budget_cost,
  COALESCE({dsum('labor_variance')}, 0) AS labor_variance,
  {rmean('pct_overrun')} AS labor_avg_pct_overrun,
  {dsum('total_hours_ot')} AS labor_ot_hours, {dsum('total_hours_st')} AS labor_st_hours,
  {dsum('actual_labor_cost')} / NULLIF({dsum('budget_labor_cost')}, 0) AS labor_burn_ratio,
  {dsum('total_hours_ot')} / NULLIF({dsum('total_hours_st')} + {dsum('total_hours_ot')}, 0)
    AS labor_ot_share
FROM v_labor_vb GROUP BY 1""")
view("v_material_rollup", f"""
SELECT project_id, COALESCE({dsum('actual_material_cost')}, 0) AS material_actual_cost,
  COALESCE({dsum('budget_material_cost')}, 0) AS material_budget_cost,
  COALESCE({dsum('material_variance')}, 0) AS material_variance,
  {rmean('pct_overrun')} AS material_avg_pct_overrun,
  {dsum('actual_material_cost')} / NULLIF({dsum('budget_material_cost')}, 0)
    AS material_burn_ratio
FROM v_material_vb GROUP BY 1""")
view("v_line_actuals", """
SELECT b.project_id, b.sov_line_id,
  COALESCE(estimated_labor_cost, 0) + COALESCE(estimated_material_cost, 0) AS budgeted,
  COALESCE(total_labor_cost, 0) + COALESCE(total_material_cost, 0) AS actual
FROM v_sov_budget b
LEFT JOIN v_labor_sov l ON b.project_id = l.project_id AND b.sov_line_id = l.sov_line_id
LEFT JOIN v_material_sov m ON b.project_id = m.project_id AND b.sov_line_id = m.sov_line_id""")

query("labor_vs_budget", lambda p: p.labor_vs_budget, "SELECT * FROM v_labor_vb")
query("material_vs_budget", lambda p: p.material_vs_budget, "SELECT * FROM v_material_vb")
query("project_weekly_summary", lambda p: p.weekly, "SELECT * FROM v_weekly")
query("variance_full_outer", lambda p: p.variance_lines, "SELECT * FROM v_variance_lines")
query("project_cost_summary", lambda p: p.project_cost_summary, f"""
SELECT project_id, COALESCE({dsum('labor_variance')}, 0) AS total_labor_variance,
  COALESCE({dsum('material_variance')}, 0) AS total_material_variance,
  COALESCE({dsum('labor_variance')}, 0) + COALESCE({dsum('material_variance')}, 0)
    AS total_variance,
  {rmean('labor_pct_overrun')} AS avg_labor_pct_overrun,
  {rmean('material_pct_overrun')} AS avg_material_pct_overrun
FROM v_variance_lines GROUP BY 1""")
query("cost_summary", lambda p: p.cost_summary, "SELECT * FROM v_cost_summary")
query("cost_summary_labor_only", lambda p: variance.cost_summary_labor_only(p.labor_vs_budget),
      f"""SELECT project_id, {dsum('actual_labor_cost')} AS total_labor_cost,
      CAST(0 AS DOUBLE) AS total_material_cost, {dsum('actual_labor_cost')} AS total_cost
      FROM v_labor_vb GROUP BY 1""")
query("project_billing_analysis", lambda p: p.billing_analysis,
      "SELECT * FROM v_billing_analysis")
query("project_full_analysis", lambda p: p.full_analysis, "SELECT * FROM v_full_analysis")
query("project_analysis_w_rfi", lambda p: p.analysis_w_rfi, "SELECT * FROM v_analysis_rfi")
query("labor_rollup", lambda p: p.labor_rollup, "SELECT * FROM v_labor_rollup")
query("material_rollup", lambda p: p.material_rollup, "SELECT * FROM v_material_rollup")
query("sov_budget_vs_actual", lambda p: p.sov_budget_vs_actual, "SELECT * FROM v_line_actuals")
