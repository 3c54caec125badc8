"""Management causes, severity bins and rule-based diagnosis."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siteledger.functions.numbers import at_least_zero, half_even, ratio
from siteledger.functions.sql import join_alike
from siteledger.functions.texts import fixed, when_list
from siteledger.rules import CAUSE_ACTIONS, Rules


def management_join(
    health: DataFrame, risk: DataFrame, changes: DataFrame, rfi: DataFrame,
    labor: DataFrame, material: DataFrame, triggers: DataFrame,
) -> DataFrame:
    keep = [
        "project_id", "project_name", "gc_name", "original_contract_value",
        "adjusted_contract", "total_budget", "actual_tracked_cost", "cumulative_billed",
        "realized_margin_pct", "pending_co_pct", "max_open_rfi_age", "overtime_spike",
        "burn_rate_acceleration", "crew_size_spike", "forecast_to_complete_trend",
    ]
    sides = [
        risk.select("project_id", "risk_score", "risk_level", "main_issue"),
        changes.select("project_id", "approved_value", "rejected_value"),
        rfi.select("project_id", "total_rfis"),
        labor.select("project_id", "labor_burn_ratio", "labor_avg_pct_overrun"),
        material.select("project_id", "material_burn_ratio", "material_avg_pct_overrun"),
        triggers.select("project_id", trigger_text(F.col("fired_triggers")).alias("fired_triggers")),
    ]
    joined = health.select(*keep)
    for side in sides:
        joined = join_alike(joined, side, "project_id", "left")
    return joined


def trigger_text(triggers: Column) -> Column:
    return F.array_join(F.filter(triggers, lambda t: t != ""), "; ")


def management_metrics(joined: DataFrame) -> DataFrame:
    """Rounding comes before classification: it decides borderline projects."""
    c = F.col
    gap = c("adjusted_contract") - c("cumulative_billed")
    raw = joined.withColumns(
        {
            "billing_gap": gap,
            "billing_gap_pct": ratio(gap, c("adjusted_contract")),
            "approved_co_pct": ratio(c("approved_value"), c("original_contract_value")),
            "rejected_co_pct": ratio(c("rejected_value"), c("original_contract_value")),
            "cost_vs_budget": ratio(c("actual_tracked_cost"), c("total_budget")),
        }
    )
    floored = [
        "billing_gap_pct", "approved_co_pct", "rejected_co_pct", "pending_co_pct",
        "labor_burn_ratio", "material_burn_ratio", "labor_avg_pct_overrun",
        "material_avg_pct_overrun",
    ]
    rounded = [
        "realized_margin_pct", "cost_vs_budget", "billing_gap_pct", "approved_co_pct",
        "rejected_co_pct", "labor_burn_ratio", "material_burn_ratio",
        "labor_avg_pct_overrun", "material_avg_pct_overrun", "forecast_to_complete_trend",
    ]
    return raw.withColumns({n: at_least_zero(c(n)) for n in floored}).withColumns(
        {n: half_even(c(n), 3) for n in rounded}
    )


def _signals() -> list[tuple[str, Column, int]]:
    """Cause, condition and severity points, in order of precedence."""
    c = F.col
    return [
        ("Billing / collections", c("billing_gap_pct") > 0.15, 3),
        ("Unrecovered change orders", c("rejected_co_pct") > 0.03, 3),
        ("Scope / estimating", c("approved_co_pct") > 0.10, 2),
        ("Labor execution", c("labor_burn_ratio") > 1.10, 2),
        ("Material / procurement", c("material_avg_pct_overrun") > 0.10, 2),
        ("Coordination / RFIs", c("total_rfis") > 50, 1),
        ("Margin erosion / review", c("realized_margin_pct") < 0, 3),
    ]


def management_cause() -> Column:
    cause = F.lit("Mixed / monitor")
    for label, cond, _ in reversed(_signals()):
        cause = F.when(cond, label).otherwise(cause)
    return cause


def severity_score() -> Column:
    total = F.lit(0)
    for _, cond, points in _signals():
        total = total + F.when(cond, points).otherwise(0)
    return total.cast("bigint")


def severity_bin(score: Column) -> Column:
    return (
        F.when(score <= 1, "Low").when(score <= 3, "Moderate")
        .when(score <= 6, "High").when(score <= 20, "Critical")
    )


# The sentences by cause.


def evidence_text(cause: Column) -> Column:
    c, lit = F.col, F.lit
    share = lambda name: F.concat(fixed(c(name) * 100, 1), lit("%"))
    return (
        F.when(cause == "Billing / collections",
               F.concat(lit("Billing gap is "), share("billing_gap_pct"),
                        lit(" of adjusted contract")))
        .when(cause == "Unrecovered change orders",
              F.concat(lit("Rejected COs are "), share("rejected_co_pct"),
                       lit(" of original contract")))
        .when(cause == "Scope / estimating",
              F.concat(lit("Approved COs are "), share("approved_co_pct"),
                       lit(" of original contract")))
        .when(cause == "Labor execution",
              F.concat(lit("Labor burn ratio is "), fixed(c("labor_burn_ratio"), 2),
                       lit("x budget")))
        .when(cause == "Material / procurement",
              F.concat(lit("Material avg overrun is "), share("material_avg_pct_overrun")))
        .when(cause == "Coordination / RFIs",
              F.concat(lit("Project has "), F.coalesce(c("total_rfis"), lit(0)).cast("string"),
                       lit(" RFIs")))
        .when(cause == "Margin erosion / review",
              F.concat(lit("Realized margin is "), share("realized_margin_pct")))
        .otherwise("No single issue clearly dominates")
    )


def recommended_action(cause: Column) -> Column:
    table = F.create_map(*[F.lit(x) for x in chain.from_iterable(CAUSE_ACTIONS.items())])
    return F.coalesce(F.try_element_at(table, cause), F.lit("Review project"))


def classify(metrics: DataFrame) -> DataFrame:
    cause = F.col("management_cause")
    return (
        metrics.withColumn("management_cause", management_cause())
        .withColumns(
            {
                "evidence": evidence_text(cause),
                "recommended_action": recommended_action(cause),
                "severity_score": severity_score(),
            }
        )
        .withColumn("severity", severity_bin(F.col("severity_score")))
    )


# Columns of the management table.
SUMMARY_COLUMNS = [
    "project_id", "project_name", "gc_name", "risk_level", "risk_score", "main_issue",
    "alert_class", "trigger_score", "primary_trigger", "supporting_triggers",
    "fired_triggers", "why_now", "realized_margin_pct", "cost_vs_budget",
    "billing_gap_pct", "approved_co_pct", "rejected_co_pct", "pending_co_pct",
    "total_rfis", "max_open_rfi_age", "labor_burn_ratio", "labor_avg_pct_overrun",
    "material_avg_pct_overrun", "overtime_spike", "burn_rate_acceleration",
    "crew_size_spike", "forecast_to_complete_trend", "management_cause", "evidence",
    "recommended_action", "severity",
]


def management_project_summary(classified: DataFrame) -> DataFrame:
    """Four trigger columns stay NULL: nothing upstream fills them."""
    none = F.lit(None)
    open_columns = {
        "alert_class": none.cast("string"),
        "trigger_score": none.cast("double"),
        "primary_trigger": none.cast("string"),
        "supporting_triggers": none.cast("string"),
        "why_now": none.cast("string"),
    }
    return classified.withColumns(open_columns).select(*SUMMARY_COLUMNS)


def cause_counts(summary: DataFrame) -> DataFrame:
    """Projects per cause and per severity, as rows (dimension, label, projects)."""
    both = F.explode(
        F.array(
            *[
                F.struct(F.lit(d).alias("dimension"), F.col(d).alias("label"))
                for d in ("management_cause", "severity")
            ]
        )
    )
    return (
        summary.select(both.alias("p")).select("p.*")
        .groupBy("dimension", "label")
        .agg(F.count(F.lit(1)).alias("projects"))
    )


# ---- rule-based diagnosis ----------------------------------------------------


def abnormal_signals(health: DataFrame, rules: Rules) -> DataFrame:
    """`crew_size_expected` is optional; the prior four weeks stand in for it."""
    c = F.col
    multiple, crew = rules.abnormal_cost_multiple, rules.abnormal_crew_multiple
    signals = when_list(
        (c("labor_burn_ratio") > multiple, F.lit("labor_overrun")),
        (c("material_burn_ratio") > multiple, F.lit("material_overrun")),
        (c("bid_margin") - c("realized_margin_pct") > rules.abnormal_margin_delta,
         F.lit("margin_below_bid")),
        (c("billing_gap_pct") > rules.abnormal_billing_gap, F.lit("billing_behind")),
        (c("rejected_co_pct") > rules.rejected_co_exposure, F.lit("rejected_change_orders")),
        (c("pending_co_pct") > rules.pending_co_stale, F.lit("pending_change_orders")),
        (c("ot_share") > rules.abnormal_overtime_share, F.lit("overtime")),
        (c("recent_crew_size") > c("prior_crew_size") * crew, F.lit("crew_size")),
    )
    return health.withColumn("abnormal_signals", signals)


def recoverability(projects: DataFrame) -> DataFrame:
    """What can still be recovered per project, by path."""
    c = F.col
    gap = F.coalesce(
        F.greatest(c("contract_value") * c("billing_gap"), F.lit(0.0)), F.lit(0.0)
    )
    return projects.select(
        c("id").alias("project_id"),
        gap.alias("billing_recovery"),
        c("co_pending_value").alias("change_order_recovery"),
        c("retention_held").alias("retention_amount"),
        (c("project_stage") != "complete").alias("margin_protectable"),
        (gap + c("co_pending_value") + c("retention_held")).alias("total_recoverable"),
    )
