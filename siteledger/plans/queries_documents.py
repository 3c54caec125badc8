"""Documents of the model steps: rules compiled from their schemas, and what is read out of a plan."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siteledger.operators import model_documents, optimization, portfolio, schema_rules
from siteledger.operators.document_schemas import DIAGNOSIS, PORTFOLIO_INPUT
from siteledger.plans.catalog import query
from siteledger.plans.oracle_views import SECTOR_A, dsum, view
from siteledger.plans.portfolio import Portfolio

# ---- rules ---------------------------------------------------------------------------


def _replaced(text: str, *pairs: tuple[str, str]) -> str:
    for pattern, other in pairs:
        text = f"regexp_replace({text}, r'{pattern}', '{other}')"
    return text


def _by_digit(key: str, faults: dict[int, str]) -> str:
    whens = " ".join(f"WHEN '{d}' THEN {text}" for d, text in faults.items())
    return f"CASE right({key}, 1) {whens} ELSE document END"


def _faulty_diagnoses(p: Portfolio) -> DataFrame:
    """Diagnoses with a fault that depends on the last digit of the project's id."""
    first = r'("root_causes":\[)(\{.*?\})(,\{.*?\})*\],"recoverability'
    faults = {
        0: _replaced("document", (r'"project_name":"[^"]*"', '"project_name":17')),
        1: _replaced("document", (r'"headline":"[^"]*",', "")),
        2: _replaced("document", (r'"severity":"C', '"severity":"c'), (r'"severity":"W', '"severity":"w')),
        3: _replaced("document", (r'"diagnosis_confidence":0.55', '"diagnosis_confidence":1.5')),
        4: _replaced("document", (r'"diagnosis_confidence":0.55', '"diagnosis_confidence":-1')),
        5: _replaced("document", (first, r'"root_causes":[],"recoverability')),
        6: _replaced("document", (first, r'$1$2,$2,$2,$2],"recoverability')),
        7: _replaced("document", (r'\}$', ',"note":"x","financial notes":null}')),
        8: _replaced("document", (r'"evidence":\[[^\]]*\]', '"evidence":[]'), (r'"retention_recovery_possible":(true|false)', '"retention_recovery_possible":null')),
        9: "substring(document, 1, length(document) - 1)",
    }
    documents = model_documents.diagnosis_documents(p.briefs)
    return documents.select("project_id", F.expr(_by_digit("project_id", faults)).alias("document"))


view("v_diagnoses", """
SELECT id AS project_id, RIGHT(id, 1) AS digit, COUNT(c.project_id) AS causes
FROM v_briefs b LEFT JOIN v_causes c ON b.id = c.project_id GROUP BY 1, 2""")
query("diagnosis_rules",
      lambda p: schema_rules.schema_violations(_faulty_diagnoses(p), DIAGNOSIS, "project_id"), """
SELECT project_id, '$.project_name' AS path, 'type' AS rule FROM v_diagnoses WHERE digit = '0'
UNION ALL SELECT project_id, '$.headline', 'required' FROM v_diagnoses WHERE digit = '1'
UNION ALL SELECT project_id, '$.severity', 'enum' FROM v_diagnoses WHERE digit = '2'
UNION ALL SELECT project_id, '$.diagnosis_confidence', 'maximum' FROM v_diagnoses WHERE digit = '3'
UNION ALL SELECT project_id, '$.diagnosis_confidence', 'minimum' FROM v_diagnoses WHERE digit = '4'
UNION ALL SELECT project_id, '$.root_causes', 'minItems' FROM v_diagnoses
  WHERE digit <> '9' AND (causes = 0 OR digit = '5')
UNION ALL SELECT project_id, '$.root_causes', 'maxItems' FROM v_diagnoses WHERE digit = '6' AND causes > 0
UNION ALL SELECT project_id, '$.' || UNNEST(['note', 'financial notes']), 'additionalProperties' FROM v_diagnoses
  WHERE digit = '7'
UNION ALL SELECT project_id, '$.root_causes[' || UNNEST(RANGE(causes)) || '].evidence', 'minItems' FROM v_diagnoses
  WHERE digit = '8'
UNION ALL SELECT project_id, '$.recoverability_assessment.retention_recovery_possible', 'type' FROM v_diagnoses
  WHERE digit = '8'
UNION ALL SELECT project_id, '$', 'json' FROM v_diagnoses WHERE digit = '9'""", share=True)


def _faulty_inputs(p: Portfolio) -> DataFrame:
    """Portfolio inputs with a fault that depends on the last digit of the contractor's name."""
    faults = {
        0: _replaced("document", (r'"total_flagged_projects":(\d+)', '"total_flagged_projects":"$1"')),
        1: _replaced("document", (r'"owner":"[^"]*"', '"owner":"Nobody"')),
        2: _replaced("document", (r'"resource_capacity":\{', '"resource_capacity":{"Intern":{"headcount":2},')),
        3: _replaced("document", (r'"project_count":(\d+)', '"project_count":$1.5')),
        4: _replaced("document", (r'"root_cause_patterns":\[.*\],"resource', '"resource')),
        5: _replaced("document", (r'"urgency":"[^"]*",', '"note":1,')),
        6: _replaced("document", (r'"effort":"[^"]*"', '"effort":null'), (r'"count":(\d+)', '"count":$1.0')),
        7: _replaced("document", (r'"headcount":1', '"headcount":null'), (r'"confidence":[0-9.]+', '"confidence":7')),
        8: "concat(document, ']')",
    }
    documents = model_documents.portfolio_inputs(p.briefs, p.all_actions, p.rules)
    return documents.select("gc_name", F.expr(_by_digit("gc_name", faults)).alias("document"))


view("v_inputs", """
SELECT g.gc_name, RIGHT(g.gc_name, 1) AS digit, LEAST(50, COUNT(a.action_id)) AS actions
FROM v_by_gc g LEFT JOIN (SELECT COALESCE(gc_name, 'Unknown') AS gc_name, action_id FROM v_all_actions) a
  ON g.gc_name = a.gc_name GROUP BY 1, 2""")
view("v_input_actions", """
SELECT gc_name, digit, '$.all_actions[' || UNNEST(RANGE(actions)) || '].' AS path FROM v_inputs""")
query("portfolio_input_rules",
      lambda p: schema_rules.schema_violations(_faulty_inputs(p), PORTFOLIO_INPUT, "gc_name"), f"""
SELECT gc_name, '$.portfolio_stats.total_flagged_projects' AS path, 'type' AS rule FROM v_inputs WHERE digit = '0'
UNION ALL SELECT gc_name, path || 'owner', 'enum' FROM v_input_actions WHERE digit = '1'
UNION ALL SELECT gc_name, '$.resource_capacity.Intern', 'additionalProperties' FROM v_inputs WHERE digit = '2'
UNION ALL SELECT gc_name, '$.projects_by_gc.' || gc_name || '.project_count', 'type' FROM v_inputs WHERE digit = '3'
UNION ALL SELECT DISTINCT gc_name, '$.projects_by_sector.' || sector || '.project_count', 'type'
  FROM (SELECT COALESCE(gc_name, 'Unknown') AS gc_name, {SECTOR_A.replace("project_name", "name")} AS sector FROM v_base)
  WHERE RIGHT(gc_name, 1) = '3'
UNION ALL SELECT gc_name, '$.root_cause_patterns', 'required' FROM v_inputs WHERE digit = '4'
UNION ALL SELECT gc_name, path || 'urgency', 'required' FROM v_input_actions WHERE digit = '5'
UNION ALL SELECT gc_name, path || 'note', 'additionalProperties' FROM v_input_actions WHERE digit = '5'
UNION ALL SELECT gc_name, '$.resource_capacity.' || UNNEST(['Project Manager', 'Finance', 'Operations',
  'Executive']) || '.headcount', 'type' FROM v_inputs WHERE digit = '7'
UNION ALL SELECT gc_name, path || 'confidence', 'maximum' FROM v_input_actions WHERE digit = '7'
UNION ALL SELECT gc_name, '$', 'json' FROM v_inputs WHERE digit = '8'""", share=True)

# ---- optimisation documents ----------------------------------------------------------


def _document(p: Portfolio) -> DataFrame:
    low = portfolio.deprioritize(p.briefs)
    return optimization.optimization_document(
        p.all_actions, portfolio.portfolio_brief(p.action_rows, p.top_actions), portfolio.cash_flow(p.all_actions, p.rules),
        portfolio.gc_bundles(p.projects_by_gc, p.rules), p.systemic_issues, low, p.rules,
    )


def _names(p: Portfolio) -> DataFrame:
    return p.briefs.selectExpr("id AS project_id", "name AS project_name")


view("v_ranked", """
SELECT *, expected_value AS told_value FROM (SELECT *, ROW_NUMBER() OVER (
    ORDER BY COALESCE(estimated_recovery_dollars, 0) * COALESCE(NULLIF(confidence, 0), 0.7::DOUBLE) DESC,
    action_id) AS r FROM v_all_actions) WHERE r <= 50""")
view("v_week", """
SELECT *, ['Monday', 'Tuesday', 'Wednesday', 'Thursday', 'Friday'][n] AS day FROM (
  SELECT *, ROW_NUMBER() OVER (ORDER BY r) AS n FROM v_ranked WHERE urgency IN ('immediate', 'this_week'))
WHERE n <= 5""")
view("v_low", """
SELECT *, ROW_NUMBER() OVER (ORDER BY theoretical_recovery DESC, project_id) AS place FROM (
  SELECT id AS project_id, name AS project_name, total_recoverable_estimate AS theoretical_recovery,
    'Project is effectively in closeout with limited upside beyond retention or unresolved commercial paper.'
      AS reason, 'Limit effort to retention and unresolved change orders.' AS recommended_action
  FROM v_briefs WHERE project_stage = 'complete' AND current_margin_dollars < 0
    AND total_recoverable_estimate < abs(current_margin_dollars) * 0.15::DOUBLE)
QUALIFY place <= 50""")
view("v_told", f"""
SELECT COALESCE({dsum('expected_value')}, 0) AS achievable,
  CAST(COALESCE({dsum('estimated_recovery_dollars')}, 0) AS DECIMAL(28,2)) AS theoretical FROM v_actions""")
view("v_common", "SELECT label FROM v_systemic ORDER BY cause_count DESC, label DESC LIMIT 1")

query("optimization_views", lambda p: optimization.optimization_views(_document(p)), """
SELECT 'portfolio' AS doc_id, 'actions' AS view, r AS place, project_id AS item, action AS detail,
  CASE WHEN r % 3 <> 0 THEN expected_value END AS amount FROM v_ranked WHERE r <= 20
UNION ALL SELECT 'portfolio', 'this_week', n, day, owner, COALESCE(cost_to_execute_hours, 0) FROM v_week
UNION ALL SELECT 'portfolio', 'cash_flow', NULL, bucket, NULL, expected_recovery FROM v_cash_flow""",
      share=True)

view("v_bundles", """
SELECT *, ROW_NUMBER() OVER (ORDER BY bundle_value DESC, gc_name) AS place FROM (
  SELECT gc_name, project_count, total_pending_cos + total_rejected_cos AS bundle_value FROM v_by_gc
  WHERE project_count >= 3 AND total_pending_cos + total_rejected_cos > 100000)""")
view("v_issues", "SELECT *, ROW_NUMBER() OVER (ORDER BY cause_count DESC, label) AS place FROM v_systemic")
query("optimization_insights", lambda p: optimization.insight_views(_document(p)), """
SELECT 'portfolio' AS doc_id, * FROM (
  SELECT 'executive_summary' AS section, NULL::BIGINT AS place, 'key_insight_1' AS field,
    'Recover the best actions first.' AS text, NULL::DOUBLE AS amount
  UNION ALL SELECT 'executive_summary', NULL, 'key_insight_3', 'Bundle what one contractor owes.', NULL
  UNION ALL SELECT 'executive_summary', NULL, 'total_achievable_recovery', NULL, achievable FROM v_told
  UNION ALL SELECT 'executive_summary', NULL, 'total_theoretical_recovery', theoretical::VARCHAR, NULL FROM v_told
  UNION ALL SELECT 'strategic_insights', 1, 'insight_type', 'systemic', NULL
  UNION ALL SELECT 'strategic_insights', 1, 'title', 'Most common cause', NULL
  UNION ALL SELECT 'strategic_insights', 1, 'description', label, NULL FROM v_common
  UNION ALL SELECT 'gc_negotiation_bundles', place, 'gc_name', gc_name, NULL FROM v_bundles WHERE place <= 50
  UNION ALL SELECT 'gc_negotiation_bundles', place, 'project_count', NULL, project_count FROM v_bundles WHERE place <= 50
  UNION ALL SELECT 'gc_negotiation_bundles', place, 'bundle_value', NULL, bundle_value FROM v_bundles WHERE place <= 50
  UNION ALL SELECT 'systemic_issues', place, 'label', label, NULL FROM v_issues WHERE place <= 50
  UNION ALL SELECT 'systemic_issues', place, 'cause_count', NULL, cause_count FROM v_issues WHERE place <= 50
  UNION ALL SELECT 'deprioritized_projects', place, 'project_id', project_id, NULL FROM v_low
  UNION ALL SELECT 'deprioritized_projects', place, 'project_name', project_name, NULL FROM v_low
  UNION ALL SELECT 'deprioritized_projects', place, 'reason', reason, NULL FROM v_low
  UNION ALL SELECT 'deprioritized_projects', place, 'theoretical_recovery', NULL, theoretical_recovery FROM v_low
  UNION ALL SELECT 'deprioritized_projects', place, 'recommended_action', recommended_action, NULL FROM v_low)
WHERE text IS NOT NULL OR amount IS NOT NULL""", share=True)

_BRIEF_ACTIONS = """
SELECT 'portfolio' AS doc_id, r AS place, action_id AS id, r AS priority, project_id, project_name, action,
  CASE WHEN r % 5 = 0 THEN 'Project Manager' ELSE owner END AS owner,
  CASE WHEN r % 7 = 0 THEN 'this_month' ELSE urgency END AS urgency, effort,
  COALESCE(estimated_recovery_dollars, 0) AS estimated_recovery_dollars, odds AS probability_of_success,
  CASE WHEN r % 3 = 0 OR expected_value IS NULL THEN COALESCE(estimated_recovery_dollars, 0) * odds
    ELSE expected_value END AS expected_value, time_to_cash_days, cost_to_execute_hours
FROM (SELECT *, CASE WHEN r % 4 = 0 THEN 0.7::DOUBLE ELSE COALESCE(confidence, 0.7::DOUBLE) END AS odds
  FROM v_ranked) WHERE r <= 8"""
query("optimization_brief_actions",
      lambda p: optimization.brief_actions(_document(p), _names(p)), _BRIEF_ACTIONS, share=True)
query("optimization_attention",
      lambda p: optimization.attention(_document(p), p.briefs.selectExpr(
          "id AS project_id", "name AS project_name", "severity", "sort_key")), """
SELECT 'portfolio' AS doc_id, project_id, name AS project_name, severity, sort_key,
  ROW_NUMBER() OVER (ORDER BY r) AS place
FROM (SELECT project_id, MIN(r) AS r FROM v_ranked WHERE r <= 8 GROUP BY 1) f
JOIN v_briefs b ON f.project_id = b.id QUALIFY place <= 5""", share=True)
query("optimization_brief", lambda p: optimization.brief(_document(p), _names(p)), f"""
SELECT 'portfolio' AS doc_id, * FROM (
  SELECT 'executive_brief' AS field, NULL::BIGINT AS place, NULL::VARCHAR AS item,
    'Recover the best actions first. Bundle what one contractor owes.' AS detail, NULL::DOUBLE AS amount
  UNION ALL SELECT 'optimization_available', NULL, NULL, 'true', NULL
  UNION ALL SELECT 'cash_this_week', NULL, NULL, NULL,
    COALESCE(SUM(expected_recovery) FILTER (bucket = 'week_1'), 0) FROM v_cash_flow
  UNION ALL SELECT 'cash_in_30_days', NULL, NULL, NULL, COALESCE(SUM(expected_recovery) FILTER (bucket = 'week_1'), 0)
    + COALESCE(SUM(expected_recovery) FILTER (bucket = 'weeks_2_to_4'), 0) FROM v_cash_flow
  UNION ALL SELECT 'achievable_recovery', NULL, NULL, NULL, achievable FROM v_told
  UNION ALL SELECT 'theoretical_recovery', NULL, NULL, NULL, theoretical::DOUBLE FROM v_told
  UNION ALL SELECT 'top_actions', place, id, action, expected_value FROM ({_BRIEF_ACTIONS})
  UNION ALL SELECT 'this_week_plan', n, project_id, concat_ws(' | ', day, project_name, action, owner),
    COALESCE(expected_value, 0) FROM v_week
  UNION ALL SELECT 'owner_plan', ROW_NUMBER() OVER (ORDER BY hours DESC, owner), owner, NULL, hours FROM (
    SELECT owner, SUM(cost_to_execute_hours) AS hours FROM v_ranked
    WHERE urgency IN ('immediate', 'this_week') GROUP BY 1) WHERE hours > 0
  UNION ALL SELECT * FROM (SELECT 'projects_requiring_exec_attention', ROW_NUMBER() OVER (ORDER BY r) AS place, project_id,
    name, NULL FROM (SELECT project_id, MIN(r) AS r FROM v_ranked WHERE r <= 8 GROUP BY 1) f
    JOIN v_briefs b ON f.project_id = b.id QUALIFY place <= 5)
  UNION ALL SELECT 'projects_to_deprioritize', place, project_id, reason, theoretical_recovery FROM v_low
  UNION ALL SELECT 'strategic_insights', 1, 'Most common cause', label, NULL FROM v_common
  UNION ALL SELECT 'biggest_blockers', 1, NULL, 'Finance is short of hours.', NULL)""", share=True)
