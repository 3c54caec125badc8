"""DuckDB text of the shared stages, used only to check the Spark results."""

from __future__ import annotations

import re

from siteledger.rules import (
    CATEGORY_MAP, ISSUE_KEYWORDS, ROLE_MAP, SECTORS_PORTFOLIO, SECTORS_PORTFOLIO_DEFAULT,
    SECTORS_PROJECT, SECTORS_PROJECT_DEFAULT,
)

AS_OF = "DATE '2024-02-15'"


def dsum(x: str, kind: str = "DECIMAL(18,6)") -> str:
    return f"CAST(SUM(CAST({x} AS {kind})) AS DOUBLE)"


def dmean(x: str, kind: str = "DECIMAL(18,6)") -> str:
    return f"CAST(SUM(CAST({x} AS {kind})) AS DOUBLE) / NULLIF(COUNT({x}), 0)"


def rmean(x: str) -> str:
    return dmean(x, "DECIMAL(28,10)")


def fix(x: str, n: int) -> str:
    return f"CAST(CAST(round_even({x}, {n}) AS DECIMAL(28,{n})) AS VARCHAR)"


def usd(x: str) -> str:
    return (
        f"COALESCE('$' || format('{{:,}}', CAST(round_even({x}, 0) AS BIGINT)), 'unavailable')"
    )


def short_usd(x: str) -> str:
    return (
        f"CASE WHEN {x} IS NULL THEN '$0' WHEN abs({x}) >= 1000000 THEN '$' || "
        f"{fix(f'({x}) / 1000000', 2)} || 'M' WHEN abs({x}) >= 1000 THEN '$' || "
        f"{fix(f'({x}) / 1000', 0)} || 'K' ELSE {usd(x)} END"
    )


def pct_text(x: str) -> str:
    return f"{fix(f'COALESCE({x}, 0) * 100', 1)} || '%'"


def _case_map(col: str, mapping: dict[str, str]) -> str:
    whens = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in mapping.items())
    return f"CASE {col} {whens} ELSE {col} END"


def has_any(col: str, kws: list[str]) -> str:
    return "(" + " OR ".join(f"contains(lower({col}), '{k}')" for k in kws) + ")"


def sector(col: str, sectors: list, default: str) -> str:
    whens = " ".join(f"WHEN {has_any(col, kws)} THEN '{name}'" for name, kws in sectors)
    return f"CASE {whens} ELSE '{default}' END"


ROLE = _case_map("role", ROLE_MAP)
CATEGORY = _case_map("material_category", CATEGORY_MAP)
SECTOR_A = sector("project_name", SECTORS_PORTFOLIO, SECTORS_PORTFOLIO_DEFAULT)
SECTOR_B = sector("project_name", SECTORS_PROJECT, SECTORS_PROJECT_DEFAULT)
LABOR_COST = (
    "(CAST(hours_st AS DECIMAL(8,4)) + CAST(hours_ot AS DECIMAL(8,4)) * CAST(1.5 AS DECIMAL(2,1)))"
    " * CAST(hourly_rate AS DECIMAL(10,4)) * CAST(burden_multiplier AS DECIMAL(8,4))"
)

VIEWS: dict[str, str] = {}


def view(name: str, sql: str) -> None:
    VIEWS[name] = sql


def oracle(sql: str) -> str:
    """Full statement: the views `sql` needs, in order, then `sql`."""
    needed: set[str] = set()
    text = sql
    for name in reversed(list(VIEWS)):
        if re.search(rf"\b{name}\b", text):
            needed.add(name)
            text += " " + VIEWS[name]
    ctes = ",\n".join(f"{n} AS ({VIEWS[n]})" for n in VIEWS if n in needed)
    return f"WITH {ctes}\n{sql}" if ctes else sql


# ---- the ten inputs ---------------------------------------------------------

view("v_contracts", """
SELECT 'PRJ-' || CAST(c_custkey AS VARCHAR) AS project_id,
  CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 'Mercy Hospital ' WHEN 'BUILDING' THEN 'Office Tower '
    WHEN 'FURNITURE' THEN 'Elementary School ' WHEN 'HOUSEHOLD' THEN 'Multifamily Housing '
    ELSE 'Plant ' END || CAST(c_custkey AS VARCHAR) AS project_name,
  n_name AS gc_name,
  CAST(CASE WHEN c_custkey % 97 = 0 THEN 0 ELSE 210000 + (c_custkey * 7919 % 21 - 10) * 3000 END
    AS DOUBLE) AS original_contract_value,
  CAST(0.10 AS DOUBLE) AS retention_pct,
  CASE c_custkey % 4 WHEN 0 THEN DATE '2023-06-30' WHEN 1 THEN DATE '2024-02-15'
    WHEN 2 THEN DATE '2025-12-31' ELSE CAST(NULL AS DATE) END AS substantial_completion_date
FROM customer JOIN nation ON c_nationkey = n_nationkey""")
view("v_labor_logs", """
SELECT 'PRJ-' || CAST(o_custkey AS VARCHAR) AS project_id,
  'L-' || CAST(l_orderkey AS VARCHAR) || '-' || CAST(l_linenumber AS VARCHAR) AS log_id,
  CAST(l_shipdate AS DATE) AS date, 'E-' || CAST(l_suppkey AS VARCHAR) AS employee_id,
  CASE l_partkey % 6 WHEN 0 THEN 'JM Pipefitter' WHEN 1 THEN 'Fmn' WHEN 2 THEN 'Helper'
    WHEN 3 THEN 'DDC Tech' WHEN 4 THEN 'Foreman' ELSE 'Journeyman Sheet Metal' END AS role,
  'SOV-' || CAST(l_partkey % 8 AS VARCHAR) AS sov_line_id,
  l_quantity % 9 AS hours_st,
  CASE WHEN l_returnflag = 'R' THEN l_quantity % 4 ELSE CAST(0 AS DOUBLE) END AS hours_ot,
  CAST((30 + l_partkey % 41) * 20 AS DOUBLE) AS hourly_rate,
  CAST(1.3 + CAST(l_tax AS DECIMAL(8,4)) AS DOUBLE) AS burden_multiplier,
  'A-' || CAST(l_linenumber AS VARCHAR) AS work_area,
  'CC-' || CAST(l_suppkey % 7 AS VARCHAR) AS cost_code
FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_linenumber IN (1, 2, 3, 5)""")
view("v_material_deliveries", """
SELECT 'PRJ-' || CAST(o_custkey AS VARCHAR) AS project_id,
  'D-' || CAST(l_orderkey AS VARCHAR) || '-' || CAST(l_linenumber AS VARCHAR) AS delivery_id,
  CAST(l_shipdate AS DATE) AS date, 'SOV-' || CAST(l_partkey % 8 AS VARCHAR) AS sov_line_id,
  CASE l_partkey % 6 WHEN 0 THEN 'CONTROLS' WHEN 1 THEN 'Duct Work' WHEN 2 THEN 'Equip.'
    WHEN 3 THEN 'insul' WHEN 4 THEN 'Pipe' ELSE 'Piping' END AS material_category,
  'item ' || CAST(l_partkey AS VARCHAR) AS item_description,
  l_quantity % 10 + 1 AS quantity, 'EA' AS unit, CAST((20 + l_partkey % 50) * 20 AS DOUBLE) AS unit_cost,
  CAST((l_quantity % 10 + 1) * (20 + l_partkey % 50) * 20
    + CASE WHEN l_suppkey % 10 = 0 THEN 25 ELSE 0 END AS DOUBLE) AS total_cost,
  'PO-' || CAST(l_orderkey AS VARCHAR) AS po_number, 'V-' || CAST(l_suppkey AS VARCHAR) AS vendor,
  CAST(NULL AS VARCHAR) AS received_by,
  CASE WHEN l_returnflag = 'R' THEN 'damaged' ELSE 'good' END AS condition_notes
FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_linenumber IN (4, 6, 7)""")
view("v_lines", """
SELECT c_custkey, c_acctbal, unnest(generate_series(0, 7)) AS line FROM customer""")
view("v_sov_budget", """
SELECT 'PRJ-' || CAST(c_custkey AS VARCHAR) AS project_id,
  'SOV-' || CAST(line AS VARCHAR) AS sov_line_id,
  CAST(10 + line AS DOUBLE) AS estimated_labor_hours,
  CAST(6000 + (c_custkey * 31 + line * 17) % 13 * 1500 AS DOUBLE) AS estimated_labor_cost,
  CAST(5000 + (c_custkey * 13 + line * 7) % 11 * 1000 AS DOUBLE) AS estimated_material_cost,
  CAST(2000 + c_custkey % 5 * 400 AS DOUBLE) AS estimated_equipment_cost,
  CAST(c_custkey % 3 * 800 AS DOUBLE) AS estimated_sub_cost,
  CAST(1 AS DOUBLE) AS productivity_factor, 'standard' AS key_assumptions
FROM v_lines WHERE line < 7 OR c_acctbal >= 0""")
view("v_sov", """
SELECT 'PRJ-' || CAST(c_custkey AS VARCHAR) AS project_id,
  'SOV-' || CAST(line AS VARCHAR) AS sov_line_id, CAST(line AS BIGINT) AS line_number,
  CASE WHEN line % 4 = 3 THEN CAST(NULL AS VARCHAR) ELSE 'Scope ' || CAST(line AS VARCHAR) END
    AS description
FROM v_lines""")
view("v_change_orders", """
SELECT 'PRJ-' || CAST(o_custkey AS VARCHAR) AS project_id,
  'CO-' || CAST(o_orderkey AS VARCHAR) AS co_number, CAST(o_orderdate AS DATE) AS date_submitted,
  CASE o_orderpriority WHEN '1-URGENT' THEN 'Acceleration' WHEN '2-HIGH' THEN 'Owner request'
    WHEN '3-MEDIUM' THEN 'Design error' WHEN '5-LOW' THEN 'Phasing' ELSE '' END AS reason_category,
  'change ' || CAST(o_orderkey AS VARCHAR) AS description,
  CAST(CAST(CAST(o_totalprice AS DECIMAL(18,2)) * CAST(0.0120 AS DECIMAL(6,4)) AS DECIMAL(18,2))
    AS DOUBLE) AS amount,
  CASE o_orderstatus WHEN 'F' THEN 'Approved' WHEN 'O' THEN ' pending ' ELSE 'REJECTED' END
    AS status,
  CASE WHEN o_orderkey % 2 = 0 THEN 'RFI-' || CAST(o_orderkey % 500 AS VARCHAR) ELSE '' END
    AS related_rfi,
  'SOV-' || CAST(o_orderkey % 8 AS VARCHAR) AS affected_sov_lines,
  CAST(o_orderkey % 40 AS DOUBLE) AS labor_hours_impact,
  CAST(o_orderkey % 7 AS DOUBLE) AS schedule_impact_days,
  'PM' AS submitted_by, CAST(NULL AS VARCHAR) AS approved_by
FROM orders""")
view("v_rfis", """
SELECT 'PRJ-' || CAST(user_id AS VARCHAR) AS project_id,
  'RFI-' || CAST(event_id AS VARCHAR) AS rfi_number, CAST(ts AS DATE) AS date_submitted,
  'Subject  ' || event_type || ' ' || CAST(event_id AS VARCHAR) AS subject,
  'field' AS submitted_by, 'engineer' AS assigned_to,
  CASE event_type WHEN 'error' THEN 'Critical' WHEN 'purchase' THEN 'High' ELSE 'Normal' END
    AS priority,
  CASE event_id % 5 WHEN 0 THEN 'Open' WHEN 1 THEN 'Closed' WHEN 2 THEN 'Resolved'
    WHEN 3 THEN 'Pending Response' ELSE 'Answered' END AS status,
  CAST(ts AS DATE) AS date_required,
  CASE WHEN event_id % 5 IN (1, 2, 4) THEN DATE '2024-02-05' ELSE CAST(NULL AS DATE) END
    AS date_responded,
  CAST(NULL AS VARCHAR) AS response_summary,
  CASE WHEN event_type IN ('click', 'error') THEN 'Yes' ELSE 'No' END AS cost_impact,
  CASE WHEN event_type = 'error' THEN 'true' ELSE 'false' END AS schedule_impact
FROM events""")
view("v_monthly", """
SELECT o_custkey, CAST(date_trunc('month', o_orderdate) AS DATE) AS month,
  MAX(CAST(o_orderdate AS DATE)) AS period_end,
  SUM(CAST(CAST(o_totalprice AS DECIMAL(18,2)) * CAST(0.0800 AS DECIMAL(6,4)) AS DECIMAL(18,2)))
    AS billed,
  SUM(CAST(CAST(o_totalprice AS DECIMAL(18,2)) * CAST(0.0080 AS DECIMAL(6,4)) AS DECIMAL(18,2)))
    AS held,
  MIN(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END) AS all_paid
FROM orders GROUP BY 1, 2""")
view("v_applications", """
SELECT *, CAST(ROW_NUMBER() OVER (PARTITION BY o_custkey ORDER BY month) AS BIGINT) AS app,
  SUM(billed) OVER (PARTITION BY o_custkey ORDER BY month ROWS UNBOUNDED PRECEDING)
    AS billed_to_date,
  SUM(held) OVER (PARTITION BY o_custkey ORDER BY month ROWS UNBOUNDED PRECEDING) AS held_to_date
FROM v_monthly""")
view("v_billing_history", """
SELECT 'PRJ-' || CAST(o_custkey AS VARCHAR) AS project_id, app AS application_number, period_end,
  CAST(billed AS DOUBLE) AS period_total, CAST(billed_to_date AS DOUBLE) AS cumulative_billed,
  CAST(held_to_date AS DOUBLE) AS retention_held,
  CASE WHEN all_paid = 1 THEN 'Paid' ELSE 'Submitted' END AS status
FROM v_applications""")
view("v_billing_line_items", """
SELECT 'PRJ-' || CAST(o_custkey AS VARCHAR) AS project_id,
  CAST(app AS VARCHAR) AS application_number, 'SOV-' || CAST(line AS VARCHAR) AS sov_line_id,
  CAST(16000 + line * 2000 AS DOUBLE) AS scheduled_value,
  CAST(LEAST(app * 9 + line, 100) AS DOUBLE) AS pct_complete
FROM (SELECT o_custkey, app, unnest(generate_series(0, 7)) AS line FROM v_applications)""")
view("v_field_notes", """
SELECT 'PRJ-' || CAST((doc_id % 100) AS VARCHAR) AS project_id,
  CASE doc_id % 3 WHEN 0 THEN DATE '2024-01-05' WHEN 1 THEN DATE '2024-01-12'
    ELSE DATE '2024-01-19' END AS date,
  source AS author, lang AS note_type,
  CASE doc_id % 6 WHEN 0 THEN 'Crew delay, area not ready. ' WHEN 1
    THEN 'Owner request, extra work. ' WHEN 2 THEN 'Rework after layout issue. '
    WHEN 3 THEN 'Shortage, lead time. ' ELSE '' END || text AS content
FROM documents""")
