"""Thresholds, maps and weights used by the operators.

Everything below is a fixed value: results are only right with these numbers,
words and patterns.
"""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass, field


@dataclass(frozen=True)
class Rules:
    # cleaning
    cost_discrepancy: float = 10.0
    overtime_multiplier: float = 1.5
    # stages and billing
    retention_rate: float = 0.10
    stage_complete: float = 0.95
    stage_late: float = 0.75
    stage_active: float = 0.15
    billing_nearly_complete: float = 0.90
    billing_complete: float = 0.95
    # severity and flags
    severity_critical: float = -0.10
    severity_warning: float = 0.00
    severity_watch: float = 0.10
    material_overrun_pct: float = 150.0
    labor_overrun_pct: float = 50.0
    compound_material_overrun_pct: float = 100.0
    rejected_co_exposure: float = 0.05
    coverage_min: float = 0.88
    coverage_max: float = 1.10
    rfi_cost_impact_count: int = 25
    rfi_cost_impact_rate: float = 0.35
    rfi_level_high: int = 50
    rfi_level_medium: int = 20
    # abnormal signals
    abnormal_cost_multiple: float = 1.3
    abnormal_margin_delta: float = 0.05
    abnormal_billing_gap: float = 0.10
    abnormal_overtime_share: float = 0.25
    abnormal_crew_multiple: float = 1.5
    pending_co_stale: float = 0.10
    billing_gap_recovery: float = 0.05
    delivery_clustering: float = 0.40
    # risk points
    risk_high: int = 70
    risk_medium: int = 40
    billing_points: tuple = (40, 30, 15)
    margin_points: tuple = (30, 20, 10)
    change_order_points: tuple = (20, 10)
    rfi_points: tuple = (10, 5)
    # text limits
    note_chars: int = 140
    subject_chars: int = 80
    top_notes: int = 6
    top_sov_variances: int = 5
    top_cost_codes: int = 5
    # portfolio planning
    capacity_hours: dict = field(
        default_factory=lambda: {
            "Project Manager": 40.0,
            "Finance": 20.0,
            "Operations": 30.0,
            "Executive": 10.0,
        }
    )
    effort_hours: dict = field(
        default_factory=lambda: {"low": 2.0, "medium": 8.0, "high": 24.0}
    )
    default_hours: float = 8.0
    overload_ratio: float = 1.2
    gc_bundle_dollars: float = 100000.0
    gc_bundle_projects: int = 3
    systemic_projects: int = 5
    systemic_sectors: int = 3
    high_loss_margin: float = -0.50
    top_actions: int = 50
    type_probability: dict = field(
        default_factory=lambda: {
            "billing": 0.95,
            "approved_change_order": 0.90,
            "pending_change_order": 0.60,
            "rejected_change_order": 0.30,
            "retention": 0.85,
            "claim": 0.40,
        }
    )


DEFAULT_RULES = Rules()
DEFAULT_AS_OF = dt.date(2024, 2, 15)

# Crew role spellings and their canonical names.
ROLE_MAP = {
    "JM Pipefitter": "Journeyman Pipefitter",
    "J. Pipefitter": "Journeyman Pipefitter",
    "Pipefitter JM": "Journeyman Pipefitter",
    "Journeyman P.F.": "Journeyman Pipefitter",
    "Sheet Metal JM": "Journeyman Sheet Metal",
    "J. Sheet Metal": "Journeyman Sheet Metal",
    "JM Sheet Metal": "Journeyman Sheet Metal",
    "Journeyman S.M.": "Journeyman Sheet Metal",
    "Apprentice 2nd Yr": "Apprentice 2nd Year",
    "App 2nd Year": "Apprentice 2nd Year",
    "Apprentice - 2nd": "Apprentice 2nd Year",
    "Apprentice 4th Yr": "Apprentice 4th Year",
    "App 4th Year": "Apprentice 4th Year",
    "Apprentice - 4th": "Apprentice 4th Year",
    "4th Yr Apprentice": "Apprentice 4th Year",
    "Controls Tech": "Controls Technician",
    "DDC Tech": "Controls Technician",
    "Ctrl Technician": "Controls Technician",
    "Controls Specialist": "Controls Technician",
    "Fmn": "Foreman",
    "Lead Foreman": "Foreman",
    "General Foreman": "Foreman",
    "Helper": "Helper/Laborer",
}

# Material category spellings and their canonical names.
CATEGORY_MAP = {
    "CONTROLS": "Controls",
    "Control": "Controls",
    "Controls/BAS": "Controls",
    "controls": "Controls",
    "DUCTWORK": "Ductwork",
    "Duct Work": "Ductwork",
    "duct work": "Ductwork",
    "ductwork": "Ductwork",
    "EQUIPMENT": "Equipment",
    "Equip.": "Equipment",
    "equip": "Equipment",
    "equipment": "Equipment",
    "INSULATION": "Insulation",
    "Insul.": "Insulation",
    "insul": "Insulation",
    "insulation": "Insulation",
    "PIPING": "Piping",
    "Pipe": "Piping",
    "pipe": "Piping",
    "piping": "Piping",
}

# Issue categories and the words that signal them in field notes.
ISSUE_KEYWORDS = {
    "delay": ["delay", "delayed", "behind schedule", "schedule slip", "late"],
    "access": ["access", "area not ready", "blocked", "restricted"],
    "rework": ["rework", "redo", "revised", "replace", "correction"],
    "coordination": ["coordination", "conflict", "collision", "layout issue"],
    "owner_scope": ["owner request", "directed work", "out of scope", "extra work"],
    "material": ["shortage", "expedite", "substitution", "lead time", "delivery issue"],
}
SCHEDULE_REASON_WORDS = ["acceleration", "schedule", "phasing", "sequence"]
SCHEDULE_NOTE_WORDS = ["delay", "behind", "access", "rework"]

# Status words.
TRUE_WORDS = ["true", "yes", "1", "y"]
CO_APPROVED_WIDE = ["approved", "executed", "issued"]
CO_REJECTED_WIDE = ["rejected", "denied", "void"]
CO_REJECTED_HEALTH = ["rejected", "denied"]
RFI_CLOSED_HEALTH = ["closed", "resolved", "answered", "complete"]
RFI_CLOSED_PACKET = ["closed", "answered"]

# Sector keywords, first match wins.
SECTORS_PORTFOLIO = [
    ("Healthcare", ["hospital", "medical", "health", "mercy"]),
    ("K-12 Education", ["school", "elementary", "middle", "education"]),
    ("Data Center", ["data center", "colocation"]),
    ("Commercial Office", ["office", "tower", "corporate", "campus"]),
    ("Multifamily Residential", ["housing", "residential", "apartment", "multifamily"]),
]
SECTORS_PORTFOLIO_DEFAULT = "Other"
SECTORS_PROJECT = [
    ("Healthcare", ["hospital", "medical", "health", "clinic"]),
    ("K-12 Education", ["school", "university", "education", "k-12", "middle"]),
    ("Data Center", ["data center", "datacenter"]),
    ("Commercial Office", ["office", "commercial", "tower"]),
    (
        "Multifamily Residential",
        ["housing", "residential", "apartment", "multifamily", "condo"],
    ),
]
SECTORS_PROJECT_DEFAULT = "HVAC"

# Management causes and the action advised for each.
CAUSE_ACTIONS = {
    "Billing / collections": "Accelerate billing, closeout, and collections follow-up",
    "Unrecovered change orders": "Require tighter approval before extra work proceeds",
    "Scope / estimating": "Strengthen bid review, scope coverage, and preconstruction",
    "Labor execution": "Review crew productivity, OT, and field supervision",
    "Material / procurement": "Review buyout, deliveries, and material budgeting",
    "Coordination / RFIs": "Escalate drawing review, RFI aging, and PM coordination",
    "Margin erosion / review": "Do full project review to isolate cost and recovery issues",
    "Mixed / monitor": "Monitor project and review multiple risk signals",
}

# Risk labels and phrases.
RISK_LABELS = {
    "billing_score": "Underbilling / Financial Loss",
    "margin_score": "Execution Inefficiency",
    "change_order_score": "Change Order Failure",
    "rfi_score": "Coordination Issues",
}
RISK_PHRASES = {
    "billing_score": "project is underbilled relative to cost",
    "margin_score": "project margin is unusually weak",
    "change_order_score": "rejected change orders are contributing to unrecovered work",
    "rfi_score": "high RFI volume suggests coordination issues",
}
RISK_NONE_LABEL = "Low Risk / No Clear Driver"
RISK_NONE_TEXT = (
    "No major risk signals detected relative to the rest of the portfolio."
)

# Fixed value: what stands for the most common cause where there is none.
NO_CAUSE = "Cash recovery work"
WEEK_DAYS = ["Monday", "Tuesday", "Wednesday", "Thursday", "Friday"]
URGENCY_FACTOR = {"immediate": 1.25, "this_week": 1.1, "this_month": 1.0, "ongoing": 0.85}
URGENCY_ORDER = ["immediate", "this_week", "this_month", "ongoing"]
