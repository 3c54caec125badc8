"""Schemas of the documents that go to and come from a language model, in the terms of `schema_rules`."""

from __future__ import annotations

from siteledger.operators.documents import ALLOWED

# Field names, types, limits and words of the published documents.
TEXT = {"type": "string"}
TEXTS = {"type": "array", "items": TEXT}
FLAG = {"type": "boolean"}
NUMBER = {"type": "number"}
COUNT = {"type": "integer"}
MAYBE_NUMBER = {"type": ["number", "null"]}
MAYBE_TEXT = {"type": ["string", "null"]}
SHARE = {"type": "number", "minimum": 0, "maximum": 1}
STAGE = {"type": "string", "enum": ALLOWED["stage"]}
CATEGORY = {"type": "string", "enum": ALLOWED["category"]}


def record(properties: dict, required: list[str] = (), closed: bool = False) -> dict:
    out = {"type": "object", "properties": properties}
    if required:
        out["required"] = list(required)
    return out | ({"additionalProperties": False} if closed else {})


_SNAPSHOT = {
    "contract_value": MAYBE_NUMBER,
    "estimated_cost": MAYBE_NUMBER,
    "actual_cost": MAYBE_NUMBER,
    "realized_margin_pct": MAYBE_NUMBER,
    "labor_actual": MAYBE_NUMBER,
    "labor_estimated": MAYBE_NUMBER,
    "material_actual": MAYBE_NUMBER,
    "material_estimated": MAYBE_NUMBER,
    "billing_complete_pct": MAYBE_NUMBER,
    "retention_held": MAYBE_NUMBER,
    "project_stage": STAGE,
}
_CAUSE = {
    "label": TEXT,
    "category": CATEGORY,
    "impact_dollars": MAYBE_NUMBER,
    "confidence": SHARE,
    "evidence": TEXTS | {"minItems": 1},
    "counter_evidence": TEXTS,
}
_RECOVERABLE = {
    "billing_recovery_possible": FLAG,
    "billing_recovery_estimate": MAYBE_NUMBER,
    "change_order_recovery_possible": FLAG,
    "change_order_recovery_estimate": MAYBE_NUMBER,
    "retention_recovery_possible": FLAG,
    "retention_amount": MAYBE_NUMBER,
    "remaining_margin_protection_possible": FLAG,
    "total_estimated_recoverable": MAYBE_NUMBER,
}
DIAGNOSIS = record(
    {
        "project_id": TEXT,
        "project_name": TEXT,
        "severity": {"type": "string", "enum": ALLOWED["severity"]},
        "headline": TEXT,
        "financial_snapshot": record(_SNAPSHOT, [*_SNAPSHOT]),
        "root_causes": {
            "type": "array",
            "minItems": 1,
            "maxItems": 3,
            "items": record(_CAUSE, [c for c in _CAUSE if c != "counter_evidence"]),
        },
        "recoverability_assessment": record(_RECOVERABLE, [c for c in _RECOVERABLE if c.endswith("_possible")]),
        "missing_data": TEXTS,
        "diagnosis_confidence": SHARE,
    },
    [
        "project_id", "project_name", "severity", "headline", "financial_snapshot", "root_causes",
        "recoverability_assessment", "diagnosis_confidence",
    ],
    closed=True,
)

_STATS = {
    "total_flagged_projects": COUNT,
    "severity_counts": record({"critical": COUNT, "warning": COUNT, "watch": COUNT}),
    "total_contract_value": NUMBER,
    "total_dollars_at_risk": NUMBER,
    "total_theoretical_recovery": NUMBER,
    "total_retention_held": MAYBE_NUMBER,
    "total_pending_cos": MAYBE_NUMBER,
    "total_rejected_cos": MAYBE_NUMBER,
}
_ACTION = {
    "action_id": TEXT,
    "project_id": TEXT,
    "project_name": TEXT,
    "gc_name": MAYBE_TEXT,
    "sector": MAYBE_TEXT,
    "project_stage": STAGE,
    "realized_margin_pct": MAYBE_NUMBER,
    "action": TEXT,
    "owner": {"type": "string", "enum": ALLOWED["owner"]},
    "financial_logic": MAYBE_TEXT,
    "estimated_recovery_dollars": MAYBE_NUMBER,
    "urgency": {"type": "string", "enum": ALLOWED["urgency"]},
    "effort": {"type": ["string", "null"], "enum": ["low", "medium", "high", None]},
    "time_to_cash_days": {"type": ["integer", "null"]},
    "confidence": SHARE,
    "linked_root_cause": MAYBE_TEXT,
    "original_priority": COUNT,
}
_GC = {
    "project_count": COUNT,
    "total_contract_value": NUMBER,
    "total_at_risk": NUMBER,
    "total_pending_cos": NUMBER,
    "total_rejected_cos": NUMBER,
    "projects": {
        "type": "array",
        "items": record(
            {
                "project_id": TEXT,
                "project_name": TEXT,
                "realized_margin_pct": MAYBE_NUMBER,
                "pending_co_value": MAYBE_NUMBER,
                "rejected_co_value": MAYBE_NUMBER,
            }
        ),
    },
}
_SECTOR = {"project_count": COUNT, "total_at_risk": NUMBER, "avg_margin_pct": NUMBER, "common_root_causes": TEXTS}
_PATTERN = {
    "label": TEXT,
    "category": CATEGORY,
    "count": COUNT,
    "total_impact_dollars": NUMBER,
    "affected_projects": TEXTS,
    "is_likely_systemic": FLAG,
    "sectors_affected": TEXTS,
}
PORTFOLIO_INPUT = record(
    {
        "portfolio_stats": record(
            _STATS,
            [
                "total_flagged_projects", "severity_counts", "total_contract_value", "total_dollars_at_risk",
                "total_theoretical_recovery",
            ],
            closed=True,
        ),
        "all_actions": {
            "type": "array",
            "items": record(
                _ACTION,
                [
                    "action_id", "project_id", "project_name", "gc_name", "sector", "project_stage", "action", "owner",
                    "estimated_recovery_dollars", "urgency", "confidence",
                ],
                closed=True,
            ),
        },
        "projects_by_gc": {"type": "object", "additionalProperties": record(_GC)},
        "projects_by_sector": {"type": "object", "additionalProperties": record(_SECTOR)},
        "root_cause_patterns": {"type": "array", "items": record(_PATTERN)},
        "resource_capacity": record(
            {o: record({"available_hours": NUMBER, "headcount": COUNT}) for o in ALLOWED["owner"]}, closed=True
        ),
        "completed_project_ids": TEXTS,
        "high_loss_project_ids": TEXTS,
    },
    ["portfolio_stats", "all_actions", "projects_by_gc", "root_cause_patterns", "resource_capacity"],
    closed=True,
)
