"""The stage graph: ten input tables in, every derived table as a lazy DataFrame."""

from __future__ import annotations

import datetime as dt
from collections import ChainMap
from collections.abc import Mapping
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession

from siteledger.operators import (
    causes, cleaning, evidence, flags, health, packets, planning, portfolio, recovery, risk,
    summaries, variance,
)
from siteledger.operators.ordering import freeze
from siteledger.rules import DEFAULT_AS_OF, DEFAULT_RULES, Rules
from siteledger.sources.readers import empty_table
from siteledger.sources.schemas import SCHEMAS


class Portfolio:
    """Stages are built on first use.

    With `share`, the stages that many others read are written once to the shared
    folder and read back; without, everything stays one lazy plan.
    """

    def __init__(
        self,
        tables: Mapping[str, DataFrame],
        rules: Rules = DEFAULT_RULES,
        as_of: dt.date = DEFAULT_AS_OF,
        share: bool = False,
    ):
        missing = [name for name in SCHEMAS if name not in tables]
        empty = {name: empty_table(SparkSession.active(), name) for name in missing}
        self.tables = ChainMap(empty, tables)
        self.rules = rules
        self.as_of = as_of
        self.share = share

    def _stage(self, df: DataFrame) -> DataFrame:
        return freeze(df) if self.share else df

    # cleaning
    @cached_property
    def labor_clean(self) -> DataFrame:
        return cleaning.clean_labor(self.tables["labor_logs"])

    @cached_property
    def materials_clean(self) -> DataFrame:
        return cleaning.clean_materials(self.tables["material_deliveries"])

    @cached_property
    def materials(self) -> DataFrame:
        return cleaning.materials_export(self.materials_clean)

    @cached_property
    def change_orders(self) -> DataFrame:
        return cleaning.clean_change_orders(self.tables["change_orders"])

    @cached_property
    def rfis(self) -> DataFrame:
        return cleaning.clean_rfis(self.tables["rfis"])

    @cached_property
    def labor_valid(self) -> DataFrame:
        return cleaning.labor_valid_rows(self.labor_clean)

    @cached_property
    def materials_valid(self) -> DataFrame:
        return cleaning.material_valid_rows(self.materials)

    # summaries
    @cached_property
    def labor_table(self) -> DataFrame:
        """Valid labor, deduplicated once, with the columns of the cubes alone."""
        logs = cleaning.without_last(self.tables["labor_logs"], ("work_area", "cost_code"))
        valid = cleaning.labor_valid_rows(cleaning.clean_labor(logs))
        return self._stage(valid.drop("log_id", "work_area", "cost_code"))

    @cached_property
    def labor_cube(self) -> DataFrame:
        return self._stage(summaries.labor_cube(self.labor_table))

    @cached_property
    def labor_costs(self) -> DataFrame:
        return self._stage(summaries.labor_costs(self.labor_table))

    @cached_property
    def labor_project(self) -> DataFrame:
        return summaries.labor_project_summary(self.labor_cube)

    @cached_property
    def labor_sov(self) -> DataFrame:
        return summaries.labor_project_sov_summary(self.labor_cube)

    @cached_property
    def labor_week(self) -> DataFrame:
        return summaries.labor_project_week_summary(self.labor_cube)

    @cached_property
    def labor_project_cost(self) -> DataFrame:
        return summaries.labor_cost(self.labor_costs, ["project_id"])

    @cached_property
    def labor_sov_cost(self) -> DataFrame:
        return summaries.labor_cost(self.labor_costs, ["project_id", "sov_line_id"])

    @cached_property
    def labor_week_cost(self) -> DataFrame:
        return summaries.labor_cost(
            self.labor_costs, ["project_id", "week_start"], {"employee_id": "num_employees"}
        )

    @cached_property
    def delivery_costs(self) -> DataFrame:
        return self._stage(summaries.delivery_costs(self.materials_valid))

    @cached_property
    def material_project_cost(self) -> DataFrame:
        return summaries.material_cost(self.delivery_costs, ["project_id"])

    @cached_property
    def material_sov_cost(self) -> DataFrame:
        return summaries.material_cost(self.delivery_costs, ["project_id", "sov_line_id"])

    @cached_property
    def material_week_cost(self) -> DataFrame:
        return summaries.material_cost(self.delivery_costs, ["project_id", "week_start"])

    @cached_property
    def material_project(self) -> DataFrame:
        return summaries.material_project_summary(self.materials_valid)

    @cached_property
    def material_sov(self) -> DataFrame:
        return summaries.material_project_sov_summary(self.materials_valid)

    @cached_property
    def material_week(self) -> DataFrame:
        return summaries.material_project_week_summary(self.materials_valid)

    @cached_property
    def change_summary(self) -> DataFrame:
        return summaries.change_summary(self.change_orders)

    @cached_property
    def rfi_counts(self) -> DataFrame:
        return summaries.rfi_counts(self.rfis)

    @cached_property
    def linked_rfis(self) -> DataFrame:
        return summaries.linked_rfis(self.change_orders)

    @cached_property
    def rfi_summary(self) -> DataFrame:
        return summaries.rfi_summary(self.rfi_counts, self.linked_rfis, self.rules)

    @cached_property
    def budget(self) -> DataFrame:
        return summaries.budget_rollup(self.tables["sov_budget"])

    @cached_property
    def co_health(self) -> DataFrame:
        return summaries.co_health_summary(self.tables["change_orders"])

    @cached_property
    def rfi_health(self) -> DataFrame:
        return summaries.rfi_health_summary(self.tables["rfis"], self.as_of)

    @cached_property
    def billing_max(self) -> DataFrame:
        return summaries.billing_max(self.tables["billing_history"])

    @cached_property
    def billing_sum(self) -> DataFrame:
        return summaries.billing_sum(self.tables["billing_history"])

    # actual against budget
    @cached_property
    def labor_vs_budget(self) -> DataFrame:
        return variance.labor_vs_budget(self.labor_sov, self.tables["sov_budget"])

    @cached_property
    def material_vs_budget(self) -> DataFrame:
        return variance.material_vs_budget(self.material_sov, self.tables["sov_budget"])

    @cached_property
    def labor_cost_vs_budget(self) -> DataFrame:
        return self._stage(variance.labor_vs_budget(self.labor_sov_cost, self.tables["sov_budget"]))

    @cached_property
    def material_cost_vs_budget(self) -> DataFrame:
        return self._stage(
            variance.material_vs_budget(self.material_sov_cost, self.tables["sov_budget"])
        )

    @cached_property
    def weekly(self) -> DataFrame:
        return variance.project_weekly_summary(self.labor_week_cost, self.material_week_cost)

    @cached_property
    def variance_lines(self) -> DataFrame:
        return variance.variance_full_outer(self.labor_cost_vs_budget, self.material_cost_vs_budget)

    @cached_property
    def project_cost_summary(self) -> DataFrame:
        return variance.project_cost_summary(self.variance_lines)

    @cached_property
    def cost_summary(self) -> DataFrame:
        return variance.cost_summary(self.variance_lines)

    @cached_property
    def billing_analysis(self) -> DataFrame:
        return variance.project_billing_analysis(self.cost_summary, self.billing_sum)

    @cached_property
    def full_analysis(self) -> DataFrame:
        return variance.project_full_analysis(self.billing_analysis, self.change_summary)

    @cached_property
    def analysis_w_rfi(self) -> DataFrame:
        return variance.project_analysis_w_rfi(self.full_analysis, self.rfi_summary)

    @cached_property
    def analysis_table(self) -> DataFrame:
        """The analysis for plans that read it more than once."""
        return self._stage(self.analysis_w_rfi)

    @cached_property
    def labor_rollup(self) -> DataFrame:
        return variance.labor_rollup(self.labor_cost_vs_budget)

    @cached_property
    def material_rollup(self) -> DataFrame:
        return variance.material_rollup(self.material_cost_vs_budget)

    @cached_property
    def sov_budget_vs_actual(self) -> DataFrame:
        return variance.sov_budget_vs_actual(
            self.tables["sov_budget"], self.labor_sov_cost, self.material_sov_cost
        )

    # health and flags
    @cached_property
    def cost_trend(self) -> DataFrame:
        return self._stage(health.weekly_cost_trend(self.weekly))

    @cached_property
    def labor_trend(self) -> DataFrame:
        return self._stage(health.weekly_labor_trend(self.labor_week_cost))

    @cached_property
    def health_joined(self) -> DataFrame:
        return health.project_health_join(
            self.tables["contracts"], self.budget, self.labor_project_cost,
            self.material_project_cost,
            self.co_health, self.rfi_health, self.billing_max, self.cost_trend,
            self.labor_trend,
        )

    @cached_property
    def health(self) -> DataFrame:
        return health.project_health(self.health_joined)

    @cached_property
    def health_table(self) -> DataFrame:
        """Health for plans that read it more than once."""
        return self._stage(self.health)

    @cached_property
    def flagged(self) -> DataFrame:
        return flags.flagged_projects(self.health, self.rules)

    # risk and causes
    @cached_property
    def risk_limits(self) -> DataFrame:
        return risk.risk_quantiles(self.analysis_table)

    @cached_property
    def risk_components(self) -> DataFrame:
        return risk.risk_components(self.analysis_table, self.risk_limits, self.rules)

    @cached_property
    def risk_scores(self) -> DataFrame:
        return risk.risk_scores(self.risk_components, self.rules)

    @cached_property
    def management_joined(self) -> DataFrame:
        return causes.management_join(
            self.health_table, self.risk_scores, self.change_summary, self.rfi_summary,
            self.labor_rollup, self.material_rollup,
            flags.flagged_projects(self.health_table, self.rules),
        )

    @cached_property
    def management_metrics(self) -> DataFrame:
        return causes.management_metrics(self.management_joined)

    @cached_property
    def classified(self) -> DataFrame:
        return causes.classify(self.management_metrics)

    @cached_property
    def management(self) -> DataFrame:
        return causes.management_project_summary(self.classified)

    # recovery: causes, actions and briefs of flagged projects
    @cached_property
    def project_base(self) -> DataFrame:
        return recovery.project_base(self.flagged, self.rules)

    @cached_property
    def projects(self) -> DataFrame:
        return self._stage(recovery.recovery_actions(recovery.root_causes(self.project_base)))

    @cached_property
    def briefs(self) -> DataFrame:
        return recovery.project_briefs(self.projects)

    @cached_property
    def cause_rows(self) -> DataFrame:
        return recovery.cause_rows(self.projects)

    @cached_property
    def action_rows(self) -> DataFrame:
        return recovery.action_rows(self.projects)

    # portfolio
    @cached_property
    def all_actions(self) -> DataFrame:
        return portfolio.all_actions(self.briefs)

    @cached_property
    def action_roi(self) -> DataFrame:
        return portfolio.action_roi(self.all_actions, self.rules)

    @cached_property
    def top_actions(self) -> DataFrame:
        return portfolio.top_actions(self.action_rows)

    @cached_property
    def projects_by_gc(self) -> DataFrame:
        return portfolio.projects_by_gc(self.briefs)

    @cached_property
    def systemic_issues(self) -> DataFrame:
        return portfolio.systemic_issues(self.briefs, self.rules)

    @cached_property
    def week_capacity_plan(self) -> DataFrame:
        return planning.week_capacity_plan(self.action_roi, self.rules)

    # packets
    @cached_property
    def labor_packet_clean(self) -> DataFrame:
        """Deduplicated labor, read by several packet parts."""
        return self._stage(self.labor_clean)

    @cached_property
    def materials_packet(self) -> DataFrame:
        """Cleaned deliveries, read by several packet parts."""
        return self._stage(self.materials)

    @cached_property
    def labor_actual(self) -> DataFrame:
        return evidence.labor_actual(self.labor_packet_clean)

    @cached_property
    def cost_code_totals(self) -> DataFrame:
        return evidence.cost_code_totals(self.labor_packet_clean)

    @cached_property
    def sov_full_variance(self) -> DataFrame:
        return evidence.sov_full_variance(
            self.labor_packet_clean, self.materials_packet, self.tables["sov_budget"],
            self.tables["sov"],
        )

    @cached_property
    def packet_co_summary(self) -> DataFrame:
        return evidence.packet_co_summary(self.change_orders)

    @cached_property
    def co_reason_top2(self) -> DataFrame:
        return evidence.co_reason_top2(self.change_orders)

    @cached_property
    def packet_rfi_counts(self) -> DataFrame:
        return evidence.packet_rfi_counts(self.rfis)

    @cached_property
    def top_field_notes(self) -> DataFrame:
        return evidence.top_field_notes(self.tables["field_notes"], self.rules)

    @cached_property
    def field_notes_summary(self) -> DataFrame:
        return evidence.field_notes_summary(self.top_field_notes, self.rules)

    @cached_property
    def schedule_signals(self) -> DataFrame:
        return evidence.schedule_signals(
            self.change_orders, self.packet_rfi_counts,
            evidence.keyword_hits(self.tables["field_notes"]),
        )

    @cached_property
    def latest_billing(self) -> DataFrame:
        return evidence.latest_billing(self.tables["billing_history"])

    @cached_property
    def weighted_pct_complete(self) -> DataFrame:
        return evidence.weighted_pct_complete(self.tables["billing_line_items"])

    @cached_property
    def packet_financials(self) -> DataFrame:
        return packets.packet_financials(
            self.tables["contracts"], packets.packet_estimates(self.tables["sov_budget"]),
            self.labor_actual, self.materials_packet,
        )

    @cached_property
    def packet_billing(self) -> DataFrame:
        return packets.packet_billing(
            self.packet_financials, self.latest_billing, self.weighted_pct_complete
        )

    @cached_property
    def packet(self) -> DataFrame:
        parts = [
            self.packet_co_summary,
            evidence.co_summary_text(self.packet_co_summary, self.co_reason_top2),
            evidence.crew_size_peak(self.labor_packet_clean),
            evidence.top_cost_codes(self.cost_code_totals, self.rules),
            evidence.top_sov_variances(self.sov_full_variance, self.rules),
            evidence.delivery_clustering(self.materials_packet, self.rules),
            self.schedule_signals,
            self.field_notes_summary,
            evidence.rfi_summary_text(self.rfis, self.packet_rfi_counts, self.rules),
        ]
        return packets.project_packet(self.packet_billing, parts, self.rules, self.as_of)

    @cached_property
    def row_counts(self) -> DataFrame:
        cleaned = {
            "labor_logs": self.labor_packet_clean, "material_deliveries": self.materials_packet,
            "change_orders": self.change_orders, "rfis": self.rfis,
        }
        return evidence.row_counts(
            {name: cleaned.get(name, self.tables[name]) for name in SCHEMAS}
        )

    @cached_property
    def co_totals(self) -> DataFrame:
        return packets.co_totals_by_status(self.tables["change_orders"])

    @cached_property
    def hybrid_packet(self) -> DataFrame:
        items = packets.packet_items(*[self.tables[name] for name in packets.DETAILS])
        return packets.hybrid_packet(
            self.management, self.co_totals, self.rfi_counts, self.tables["field_notes"], items
        )

    @cached_property
    def labor_by_week(self) -> DataFrame:
        return packets.labor_by_week(self.labor_week)

    @cached_property
    def rfi_days_open(self) -> DataFrame:
        return packets.rfi_days_open(self.tables["rfis"], self.as_of)

    @cached_property
    def recent_notes(self) -> DataFrame:
        return evidence.recent_notes(self.tables["field_notes"])

    @cached_property
    def retention(self) -> DataFrame:
        return packets.retention_estimate(self.project_base, self.latest_billing, self.rules)
