"""The ten input tables: columns, types and which of them must be there."""

from __future__ import annotations

from pyspark.sql import types as T


_TYPES = {
    "string": T.StringType(),
    "double": T.DoubleType(),
    "date": T.DateType(),
    "bigint": T.LongType(),
}


def _schema(text: str) -> T.StructType:
    pairs = [column.split() for column in text.split(",")]
    return T.StructType([T.StructField(name, _TYPES[kind]) for name, kind in pairs])


SCHEMAS: dict[str, T.StructType] = {
    "contracts": _schema(
        "project_id string, project_name string, gc_name string, "
        "original_contract_value double, retention_pct double, "
        "substantial_completion_date date"
    ),
    "labor_logs": _schema(
        "project_id string, log_id string, date date, employee_id string, role string, "
        "sov_line_id string, hours_st double, hours_ot double, hourly_rate double, "
        "burden_multiplier double, work_area string, cost_code string"
    ),
    "material_deliveries": _schema(
        "project_id string, delivery_id string, date date, sov_line_id string, "
        "material_category string, item_description string, quantity double, unit string, "
        "unit_cost double, total_cost double, po_number string, vendor string, "
        "received_by string, condition_notes string"
    ),
    "sov_budget": _schema(
        "project_id string, sov_line_id string, estimated_labor_hours double, "
        "estimated_labor_cost double, estimated_material_cost double, "
        "estimated_equipment_cost double, estimated_sub_cost double, "
        "productivity_factor double, key_assumptions string"
    ),
    "sov": _schema(
        "project_id string, sov_line_id string, line_number bigint, description string"
    ),
    "change_orders": _schema(
        "project_id string, co_number string, date_submitted date, reason_category string, "
        "description string, amount double, status string, related_rfi string, "
        "affected_sov_lines string, labor_hours_impact double, schedule_impact_days double, "
        "submitted_by string, approved_by string"
    ),
    "rfis": _schema(
        "project_id string, rfi_number string, date_submitted date, subject string, "
        "submitted_by string, assigned_to string, priority string, status string, "
        "date_required date, date_responded date, response_summary string, "
        "cost_impact string, schedule_impact string"
    ),
    "billing_history": _schema(
        "project_id string, application_number bigint, period_end date, period_total double, "
        "cumulative_billed double, retention_held double, status string"
    ),
    "billing_line_items": _schema(
        "project_id string, application_number string, sov_line_id string, "
        "scheduled_value double, pct_complete double"
    ),
    "field_notes": _schema(
        "project_id string, date date, author string, note_type string, content string"
    ),
}

REQUIRED_TABLES = ["contracts", "labor_logs", "sov_budget"]
OPTIONAL_TABLES = [name for name in SCHEMAS if name not in REQUIRED_TABLES]

# Columns a file must bring to be accepted.
REQUIRED_COLUMNS: dict[str, list[str]] = {
    "contracts": ["project_id", "project_name", "original_contract_value"],
    "labor_logs": [
        "project_id", "log_id", "date", "employee_id", "role", "sov_line_id",
        "hours_st", "hours_ot", "hourly_rate", "burden_multiplier",
    ],
    "billing_history": ["project_id", "period_total", "cumulative_billed"],
    "billing_line_items": ["project_id"],
    "change_orders": ["project_id", "co_number", "amount", "status"],
    "material_deliveries": [
        "project_id", "delivery_id", "date", "sov_line_id", "material_category",
        "item_description", "quantity", "unit_cost", "total_cost",
    ],
    "rfis": ["project_id", "rfi_number", "date_submitted", "status"],
    "field_notes": ["project_id", "date"],
    "sov": ["project_id", "sov_line_id"],
    "sov_budget": [
        "project_id", "sov_line_id", "estimated_labor_cost", "estimated_material_cost",
    ],
}

# What is lost when an optional table is absent.
FEATURES = {
    "billing_history": "Billing history analysis",
    "billing_line_items": "Billing line item details",
    "change_orders": "Change order tracking and analysis",
    "material_deliveries": "Material cost tracking",
    "rfis": "RFI analysis and tracking",
    "field_notes": "Field note summaries",
    "sov": "Schedule of Values breakdown",
}

