"""One evidence document per project, and the rows that belong to it.

Nested arrays hold only lists with a fixed limit. Whole child tables (all notes, all
change orders, all RFIs) stay rows keyed by project and section, or come in parts with a
fixed number of items, because one project may own a large part of them.
"""

from __future__ import annotations

import datetime as dt
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siteledger.functions.sql import (
    day, dollars, exact_sum, fixed, half_even, join_alike, percent, ratio, text_list,
)
from siteledger.functions.variants import is_kind, leaf_amount, leaf_text
from siteledger.operators.evidence import billing_summary_text
from siteledger.operators.ordering import running_total
from siteledger.operators.recovery import stage_case
from siteledger.rules import Rules


def _known_sum(*cols: str) -> str:
    total = " + ".join(f"COALESCE({c}, 0D)" for c in cols)
    return f"CASE WHEN COALESCE({', '.join(cols)}) IS NOT NULL THEN {total} END"


ESTIMATES = ["labor_estimated", "material_estimated", "other_cost_estimated"]


def packet_estimates(budget: DataFrame) -> DataFrame:
    parts = {
        "labor_estimated": "estimated_labor_cost",
        "material_estimated": "estimated_material_cost",
        "equipment": "estimated_equipment_cost",
        "sub": "estimated_sub_cost",
    }
    sums = [F.expr(f"{half_even(exact_sum(c), 2)} AS {alias}") for alias, c in parts.items()]
    return budget.groupBy("project_id").agg(*sums).selectExpr(
        "project_id", "labor_estimated", "material_estimated",
        f"{half_even(_known_sum('equipment', 'sub'), 2)} AS other_cost_estimated",
    )


def packet_financials(
    contracts: DataFrame, estimates: DataFrame, labor: DataFrame, materials: DataFrame
) -> DataFrame:
    """Estimates, actuals and margins; a total skips unknown parts."""
    material = materials.groupBy("project_id").agg(
        F.expr(f"{half_even(exact_sum('total_cost'), 2)} AS material_actual")
    )
    pct = lambda v: half_even(ratio(v, "contract_value") + " * 100", 2)
    times = lambda a, e: half_even(ratio(a, e), 2)
    joined = reduce(
        lambda a, b: join_alike(a, b, "project_id", "left"), [contracts, estimates, labor, material]
    )
    return (
        joined.selectExpr(
            "project_id", "project_name", "gc_name", "substantial_completion_date",
            "original_contract_value AS contract_value", "labor_estimated", "labor_actual",
            "material_estimated", "material_actual", "other_cost_estimated", "overtime_share",
            f"{half_even(_known_sum(*ESTIMATES), 2)} AS estimated_cost_total",
            f"{_known_sum('labor_actual', 'material_actual')} AS actual_cost_total",
        )
        .selectExpr(
            "*",
            f"{half_even('contract_value - estimated_cost_total', 2)} AS estimated_margin_dollars",
            f"{half_even('contract_value - actual_cost_total', 2)} AS realized_margin_dollars",
            f"{half_even('labor_actual - labor_estimated', 2)} AS labor_variance",
            f"{half_even('material_actual - material_estimated', 2)} AS material_variance",
            f"{times('labor_actual', 'labor_estimated')} AS labor_overrun_multiple",
            f"{times('material_actual', 'material_estimated')} AS material_overrun_multiple",
        )
        .selectExpr(
            "*",
            f"{pct('estimated_margin_dollars')} AS estimated_margin_pct",
            f"{pct('realized_margin_dollars')} AS realized_margin_pct",
        )
    )


def packet_billing(
    financials: DataFrame, latest: DataFrame, progress: DataFrame
) -> DataFrame:
    return (
        join_alike(join_alike(financials, latest, "project_id", "left"), progress, "project_id", "left")
        .withColumn(
            "billing_complete_pct",
            F.expr(half_even(f"{ratio('cumulative_billed', 'contract_value')} * 100", 2)),
        )
        .withColumn("billing_gap_pct", F.expr(half_even("percent_complete - billing_complete_pct", 2)))
    )


def stage_full(as_of: dt.date, rules: Rules) -> str:
    late = f"substantial_completion_date <= DATE'{as_of.isoformat()}'"
    by_share = lambda c: f"WHEN {c} IS NOT NULL THEN {stage_case(f'{c} / 100', rules)}"
    return (
        f"CASE WHEN {late} THEN 'complete' {by_share('percent_complete')} "
        f"{by_share('billing_complete_pct')} ELSE 'unknown' END"
    )


def recovery_paths_a(rules: Rules) -> str:
    paths = text_list(
        (f"billing_gap_pct > {rules.billing_gap_recovery * 100}", "'billing_acceleration'"),
        ("approved_value > 0", "'approved_change_order_recovery'"),
        ("pending_value > 0", "'pending_change_order_recovery'"),
        ("retention_held > 0", "'retention_release'"),
        ("project_stage NOT IN ('complete', 'unknown')", "'remaining_work_margin_protection'"),
    )
    return f"CASE WHEN size({paths}) = 0 THEN array('limited_recovery_only') ELSE {paths} END"


def recovery_paths_b(rules: Rules, billed: str, gap: str, pending: str, rejected: str) -> str:
    return text_list(
        (f"{gap} > {rules.billing_gap_recovery}", "'billing_acceleration'"),
        (f"{pending} > 0", "'pending_change_orders'"),
        (f"{rejected} > 0", "'rejected_co_escalation'"),
        (f"{billed} < {rules.billing_complete}", "'retention_release'"),
        (f"{billed} IS NULL OR {billed} < {rules.stage_late}", "'operational_efficiency'"),
    )


LARGEST = (
    "CASE WHEN labor_variance >= COALESCE(material_variance, labor_variance) THEN 'labor' "
    "WHEN material_variance IS NOT NULL THEN 'material' END"
)


def project_packet(
    billing: DataFrame, evidence: list[DataFrame], rules: Rules, as_of: dt.date
) -> DataFrame:
    """All packet fields as plain columns; `evidence` has one row per project each."""
    joined = reduce(lambda a, b: join_alike(a, b, "project_id", "left"), evidence, billing)
    lists = [
        "missing_scope_signals", "top_cost_codes", "top_sov_variances",
        "schedule_pressure_signals", "notable_events",
    ]
    counts = ["approved_count", "pending_count", "rejected_count"]
    filled = joined.withColumns(
        {c: F.expr(f"COALESCE({c}, CAST(array() AS ARRAY<STRING>))") for c in lists}
        | {c: F.expr(f"COALESCE({c}, 0L)") for c in counts}
        | {"project_stage": F.expr(stage_full(as_of, rules))}
    )
    return filled.withColumns(
        {
            "project_name": F.expr("COALESCE(NULLIF(project_name, ''), project_id)"),
            "largest_variance_bucket": F.expr(LARGEST),
            "largest_variance_dollars": F.expr("greatest(labor_variance, material_variance)"),
            "is_billing_nearly_complete": F.expr("COALESCE(billing_complete_pct >= 95, false)"),
            "is_project_effectively_complete": F.expr("project_stage = 'complete'"),
            "recovery_paths_available": F.expr(recovery_paths_a(rules)),
            "billing_notes_summary": F.expr(billing_summary_text()),
        }
    )


# Sections and field names of the packet document.
SECTIONS = {
    "project": ["project_id", "project_name", "project_stage", "gc_name AS customer",
                "substantial_completion_date AS delivery_status"],
    "financials": [
        "contract_value", "estimated_cost_total", "actual_cost_total",
        "estimated_margin_dollars", "estimated_margin_pct", "realized_margin_dollars",
        "realized_margin_pct", "labor_estimated", "labor_actual", "material_estimated",
        "material_actual", "other_cost_estimated"],
    "billing": ["cumulative_billed AS billed_to_date", "billing_complete_pct",
                "percent_complete", "billing_gap_pct", "retention_held"],
    "change_orders": ["approved_count", "approved_value", "pending_count", "pending_value",
                      "rejected_count", "rejected_value", "missing_scope_signals"],
    "operations": ["crew_size_peak", "overtime_share", "delivery_clustering_signal",
                   "top_cost_codes", "top_sov_variances", "schedule_pressure_signals"],
    "text_evidence": ["field_notes_summary", "rfi_summary", "change_order_summary",
                      "billing_notes_summary", "notable_events"],
    "diagnostic_signals": [
        "largest_variance_bucket", "largest_variance_dollars", "labor_overrun_multiple",
        "material_overrun_multiple", "is_billing_nearly_complete",
        "is_project_effectively_complete", "recovery_paths_available"],
}


def flat_packet(packet: DataFrame) -> DataFrame:
    return packet.selectExpr(*[c for cols in SECTIONS.values() for c in cols])


def nested_packet(packet: DataFrame, counts: DataFrame) -> DataFrame:
    """The packet as one document per project; `row_counts` has one entry per table."""
    trace = counts.groupBy("project_id").agg(
        F.expr("map_from_entries(array_sort(collect_list(struct(table_name, row_count)))) "
               "AS row_counts")
    )
    sections = [f"struct({', '.join(cols)}) AS {name}" for name, cols in SECTIONS.items()]
    return join_alike(packet, trace, "project_id", "left").selectExpr(
        "project_id", *sections,
        "struct(map_keys(row_counts) AS tables_used, row_counts) AS source_trace",
    )


def packet_leaves(documents: DataFrame) -> DataFrame:
    """Every value of the packet documents as a row: project_id, section, field, place, text, amount.

    An array has one row with its length and one per item, whose place counts from 1; a map has one row per entry,
    with the field's name before the entry's. Null values are rows with neither text nor amount.
    """
    sections = documents.selectExpr(
        "project_id", "explode(map_entries(try_cast(try_parse_json(packet) AS MAP<STRING, VARIANT>))) AS s"
    )
    fields = sections.selectExpr(
        "project_id", "s.key AS section", "explode(map_entries(try_cast(s.value AS MAP<STRING, VARIANT>))) AS f"
    )
    items, entries = "try_cast(f.value AS ARRAY<VARIANT>)", "map_entries(try_cast(f.value AS MAP<STRING, VARIANT>))"
    leaf = lambda x: f"{leaf_text(x)} AS text, {leaf_amount(x)} AS amount"
    none = "CAST(NULL AS BIGINT) AS place"
    rows = (
        f"CASE WHEN {is_kind('f.value', 'ARRAY')} THEN concat("
        f"array(struct(f.key AS field, {none}, CAST(NULL AS STRING) AS text, CAST(size({items}) AS DOUBLE) AS amount)), "
        f"transform({items}, (x, i) -> struct(f.key AS field, CAST(i + 1 AS BIGINT) AS place, {leaf('x')}))) "
        f"WHEN {is_kind('f.value', 'OBJECT')} THEN "
        f"transform({entries}, e -> struct(f.key || '.' || e.key AS field, {none}, {leaf('e.value')})) "
        f"ELSE array(struct(f.key AS field, {none}, {leaf('f.value')})) END"
    )
    return fields.selectExpr("project_id", "section", f"inline({rows})")


def legacy_packet(flagged: DataFrame, rules: Rules) -> DataFrame:
    """Packet fields from a flagged row alone, on a 0-1 scale."""
    billed = "CASE WHEN billing_data_available THEN pct_billed END"
    base = flagged.selectExpr(
        "project_id", "project_name", "gc_name AS customer",
        "COALESCE(original_contract_value, 0D) AS contract_value",
        "est_labor + est_material AS estimated_cost_total",
        "actual_labor_cost + actual_material_cost AS actual_cost_total",
        "bid_margin AS estimated_margin_pct", "realized_margin_pct",
        f"{billed} AS billing_complete_pct",
        "CASE WHEN total_budget > 0 THEN least(actual_tracked_cost / total_budget, 1D) "
        "ELSE 0D END AS percent_complete",
        "co_approved_count AS approved_count", "co_approved_value AS approved_value",
        "co_pending_count AS pending_count", "pending_co_value AS pending_value",
        "co_rejected_count AS rejected_count", "co_rejected_value AS rejected_value",
        f"{ratio('actual_labor_cost', 'est_labor')} AS labor_overrun_multiple",
        f"{ratio('actual_material_cost', 'est_material')} AS material_overrun_multiple",
    ).selectExpr(
        "*",
        "percent_complete - billing_complete_pct AS billing_gap_pct",
        "CASE WHEN contract_value <> 0 THEN contract_value * billing_complete_pct END "
        "AS billed_to_date",
        "CASE WHEN contract_value <> 0 THEN contract_value * estimated_margin_pct END "
        "AS estimated_margin_dollars",
        "CASE WHEN contract_value <> 0 THEN contract_value * realized_margin_pct END "
        "AS realized_margin_dollars",
        f"CASE WHEN billing_complete_pct IS NULL THEN 'unknown' ELSE "
        f"{stage_case('billing_complete_pct', rules)} END AS project_stage",
    )
    paths = recovery_paths_b(
        rules, "billing_complete_pct", "billing_gap_pct", "pending_value", "rejected_value"
    )
    return base.selectExpr(
        "*",
        f"billed_to_date * {rules.retention_rate}D AS retention_held",
        "CASE WHEN billing_gap_pct > 0 THEN billing_gap_pct * contract_value END "
        "AS unbilled_approved_amount",
        f"COALESCE(billing_complete_pct >= {rules.billing_nearly_complete}, false) "
        "AS is_billing_nearly_complete",
        f"COALESCE(billing_complete_pct >= {rules.billing_complete}, false) "
        "AS is_project_effectively_complete",
        f"{paths} AS recovery_paths_available",
    )


# ---- whole child tables ------------------------------------------------------------


def detail_union(orders: DataFrame, rfis: DataFrame, notes: DataFrame) -> DataFrame:
    """All change orders, RFIs and notes in one shape, one row each."""
    rows = [
        orders.selectExpr(
            "project_id", "'change_orders' AS section", "co_number AS item_id",
            "date_submitted AS item_date", "description AS title", "status",
            "amount", "reason_category AS kind"),
        rfis.selectExpr(
            "project_id", "'rfis' AS section", "rfi_number AS item_id",
            "date_submitted AS item_date", "subject AS title", "status",
            "CAST(NULL AS DOUBLE) AS amount", "priority AS kind"),
        notes.selectExpr(
            "project_id", "'field_notes' AS section", "author AS item_id", "date AS item_date",
            "content AS title", "CAST(NULL AS STRING) AS status",
            "CAST(NULL AS DOUBLE) AS amount", "note_type AS kind"),
    ]
    return reduce(lambda a, b: a.unionByName(b), rows)


def co_totals_by_status(orders: DataFrame) -> DataFrame:
    status = "lower(trim(status))"
    aggs = []
    for s in ("approved", "pending", "rejected"):
        value = exact_sum(f"CASE WHEN {status} = '{s}' THEN amount ELSE 0D END")
        aggs += [f"count_if({status} = '{s}') AS {s}_count", f"{value} AS {s}_value"]
    return orders.groupBy("project_id").agg(*[F.expr(a) for a in aggs])


# The fields of an item in the lists of a hybrid packet, and the items of a list in one part.
DETAILS = {
    "change_orders": ["co_number", "description", "amount", "status", "reason_category"],
    "rfis": ["rfi_number", "subject", "status", "priority", "cost_impact"],
    "field_notes": ["date", "author", "note_type", "content"],
}
PART_ITEMS = 50


def detail_tie(section: str, text: str = "STRING") -> str:
    """A short text in place of all fields of an item, to sort by; also valid for the SQL twin."""
    money = "CAST(TRY_CAST(amount AS DECIMAL(28,6)) AS {0})".format(text)
    value = lambda c: money if c == "amount" else f"CAST({c} AS {text})"
    known = [f"CASE WHEN {c} IS NULL THEN 'n' ELSE 'v' || {value(c)} END" for c in DETAILS[section]]
    return f"md5(concat_ws('|', {', '.join(known)}))"


def packet_items(orders: DataFrame, rfis: DataFrame, notes: DataFrame) -> DataFrame:
    """All change orders, RFIs and notes, one row each, with what they are sorted by: notes by their newest day first."""
    newest = {"field_notes": day(notes, "date")}
    number = {"change_orders": "co_number", "rfis": "rfi_number", "field_notes": "author"}
    rows = [
        df.filter("project_id IS NOT NULL").selectExpr(
            "project_id", f"'{section}' AS section", f"{newest.get(section, 'CAST(NULL AS DATE)')} AS day",
            f"{number[section]} AS number", f"{detail_tie(section)} AS tie",
            f"struct({', '.join(DETAILS[section])}) AS {section}",
        )
        for section, df in zip(DETAILS, (orders, rfis, notes))
    ]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), rows)


def packet_parts(items: DataFrame, size: int = PART_ITEMS) -> DataFrame:
    """The items of a project in parts: part k has the k-th `size` items of every section, in order.

    Items are numbered over ranges of all projects, so that a large project is no single task at any step.
    """
    order = [F.col("day").desc_nulls_last(), F.col("number").asc_nulls_last(), F.col("tie").asc()]
    one = F.lit(1).cast("bigint")
    numbered = running_total(items, ["project_id", "section"], order, one, "place")
    lists = [
        f"transform(array_sort(collect_list(CASE WHEN section = '{s}' THEN struct(place, {s} AS item) END)), "
        f"x -> x.item) AS {s}"
        for s in DETAILS
    ]
    return (
        numbered.withColumn("part", F.expr(f"(place - 1) DIV {size} + 1"))
        .groupBy("project_id", "part")
        .agg(*[F.expr(x) for x in lists])
    )


def in_parts(head: DataFrame, items: DataFrame, size: int = PART_ITEMS) -> DataFrame:
    """Every row of `head` once for each part of its project; one part with empty lists if there is none.

    Rows meet their parts by project and part, so that the parts of a large project are never in one task. How many
    parts there are is counted from the items, without their texts and their order.
    """
    counts = items.groupBy("project_id", "section").agg(F.count(F.lit(1)).alias("n"))
    last = counts.groupBy("project_id").agg(F.expr(f"(max(n) - 1) DIV {size} + 1 AS _parts"))
    repeated = join_alike(head, last, "project_id", "left").selectExpr(
        *head.columns, "explode(sequence(1L, COALESCE(_parts, 1L))) AS part"
    )
    joined = join_alike(repeated, packet_parts(items, size), ["project_id", "part"], "left")
    return joined.withColumns({s: F.coalesce(F.col(s), F.array()) for s in DETAILS})


def hybrid_packet(
    management: DataFrame, co_totals: DataFrame, rfi_counts: DataFrame, notes: DataFrame,
    items: DataFrame | None = None, size: int = PART_ITEMS,
) -> DataFrame:
    """Management row with exact change-order totals, counts of the detail rows and the rows themselves.

    `items` has all change orders, RFIs and notes (`packet_items`), which come in parts of `size`; each part repeats
    the fields of the project. Without `items` there are the fields alone; those that `management` lacks are left out.
    """
    own = lambda *names: [c for c in names if c in management.columns]
    note_counts = notes.groupBy("project_id").agg(F.expr("count(1) AS field_notes_count"))
    totals = ["approved_count", "pending_count", "rejected_count"]
    values = ["approved_value", "pending_value", "rejected_value"]
    joined = reduce(
        lambda a, b: join_alike(a, b, "project_id", "left"),
        [management.drop("total_rfis"), co_totals, rfi_counts, note_counts],
    )
    head = joined.fillna(0, [*totals, "total_rfis", "field_notes_count"]).fillna(0.0, values).select(
        "project_id", "project_name", F.col("gc_name").alias("customer"), "risk_level", "severity",
        "realized_margin_pct", "cost_vs_budget", "labor_burn_ratio", "labor_avg_pct_overrun",
        "material_avg_pct_overrun", "billing_gap_pct", "approved_co_pct", "rejected_co_pct",
        *own("pending_co_pct"), *totals, *values, "overtime_spike", "burn_rate_acceleration",
        "crew_size_spike", *own("forecast_to_complete_trend"), "field_notes_count",
        F.col("total_rfis").alias("rfi_count"),
        *own("max_open_rfi_age", "alert_class", "trigger_score", "primary_trigger",
             "supporting_triggers", "fired_triggers", "why_now"),
        "main_issue", "management_cause", "evidence", "recommended_action",
    )
    return head if items is None else in_parts(head, items, size)


# ---- drill-down --------------------------------------------------------------------


def labor_by_week(labor_week: DataFrame) -> DataFrame:
    rate = "COALESCE(avg_hourly_rate, 0D) * COALESCE(avg_burden_multiplier, 1D)"
    return labor_week.selectExpr(
        "project_id", "week_start",
        f"{half_even(f'COALESCE(total_hours_st, 0D) * {rate}', 0)} AS regular",
        f"{half_even(f'COALESCE(total_hours_ot, 0D) * {rate} * 1.5D', 0)} AS overtime",
    )


def overtime_cost_ratio(weeks: DataFrame) -> DataFrame:
    ot, st = exact_sum("overtime"), exact_sum("regular")
    return weeks.groupBy("project_id").agg(
        F.expr(f"{ratio(ot, f'{st} + {ot}')} AS overtime_cost_ratio")
    )


def rfi_days_open(rfis: DataFrame, as_of: dt.date) -> DataFrame:
    status = "COALESCE(NULLIF(lower(trim(status)), ''), 'unknown')"
    answered = f"date_responded IS NOT NULL AND {status} NOT IN ('open', 'pending response')"
    return rfis.selectExpr(
        "project_id", "rfi_number AS id", f"{status} AS status",
        f"CAST(CASE WHEN {answered} THEN datediff(date_responded, date_submitted) "
        f"ELSE datediff(DATE'{as_of.isoformat()}', date_submitted) END AS BIGINT) AS days_open",
        "COALESCE(subject, '') AS description", "COALESCE(priority, '') AS priority",
        "cost_impact",
    )


def retention_estimate(base: DataFrame, latest: DataFrame, rules: Rules) -> DataFrame:
    """Stated retention of the last application, else a share of what was billed."""
    stated = latest.selectExpr("project_id AS id", "retention_held AS stated", "true AS has_billing")
    estimate = f"contract_value * percent_billed * {rules.retention_rate}D"
    return base.join(stated, "id", "left").selectExpr(
        "id AS project_id",
        "CASE WHEN has_billing THEN COALESCE(stated, retention_held) ELSE retention_held END AS r",
        "billing_data_available", "percent_billed", "contract_value",
    ).selectExpr(
        "project_id",
        f"CASE WHEN billing_data_available AND r = 0 AND percent_billed >= "
        f"{rules.billing_complete} THEN {estimate} ELSE r END AS retention_held",
    )


def project_drilldown(
    base: DataFrame, co_totals: DataFrame, retention: DataFrame, notes: DataFrame,
    counts: DataFrame,
) -> DataFrame:
    """Header row of the drill-down; its child rows are separate tables."""
    totals = co_totals.selectExpr(
        "project_id AS id", "approved_value", "pending_value", "rejected_value"
    )
    sources = counts.groupBy("project_id").agg(
        F.expr("array_sort(collect_set(table_name)) AS enriched_sources")
    )
    by_id = lambda df: df.withColumnRenamed("project_id", "id")
    return (
        base.drop("retention_held", "fired_triggers")
        .join(totals, "id", "left")
        .join(by_id(retention), "id", "left")
        .join(by_id(notes), "id", "left")
        .join(by_id(sources), "id", "left")
        .withColumn("co_approved_value", F.expr("COALESCE(approved_value, co_approved_value)"))
        .withColumn("co_pending_value", F.expr("COALESCE(pending_value, co_pending_value)"))
        .withColumn("co_rejected_value", F.expr("COALESCE(rejected_value, co_rejected_value)"))
        .drop("approved_value", "pending_value", "rejected_value")
    )


def sov_overruns(lines: DataFrame, n: int = 5) -> DataFrame:
    """The first lines over budget, in line order."""
    order = W.partitionBy("project_id").orderBy("sov_line_id")
    return (
        lines.filter("actual > budgeted")
        .withColumn("line_rank", F.row_number().over(order).cast("bigint"))
        .filter(F.col("line_rank") <= n)
        .selectExpr(
            "project_id", "line_rank",
            f"sov_line_id || ': ' || {dollars('actual - budgeted')} || ' variance' AS overrun",
        )
    )


def brief_texts(orders: DataFrame, rfis: DataFrame) -> DataFrame:
    """Short change-order and RFI sentences of the drill-down packet."""
    totals = co_totals_by_status(orders)
    amounts = ", ".join(
        f"CASE WHEN {s}_value <> 0 THEN {dollars(s + '_value')} || ' {s}' END"
        for s in ("approved", "pending", "rejected")
    )
    co = totals.selectExpr("project_id", f"NULLIF(concat_ws(', ', {amounts}), '') AS co_text")
    counts = rfis.groupBy("project_id").agg(
        F.expr("count(1) AS total"), F.expr("count_if(lower(trim(status)) = 'open') AS open")
    )
    rfi = counts.selectExpr(
        "project_id",
        "CASE WHEN open > 0 THEN CAST(open AS STRING) || ' open RFIs out of ' || "
        "CAST(total AS STRING) || ' total' ELSE CAST(total AS STRING) || ' RFIs, all resolved' "
        "END AS rfi_text",
    )
    return co.join(rfi, "project_id", "full_outer")


def _usd(x: str) -> str:
    return (
        f"CASE WHEN {x} IS NULL THEN 'N/A' WHEN abs({x}) >= 1000000 THEN "
        f"'$' || {fixed(f'{x} / 1000000', 2)} || 'M' ELSE "
        f"'$' || {fixed(f'{x} / 1000', 0)} || 'K' END"
    )


def _pct(x: str) -> str:
    return f"CASE WHEN {x} IS NULL THEN 'N/A' ELSE {percent(x)} END"


def project_context(
    base: DataFrame, notes: DataFrame, orders: DataFrame, rfis: DataFrame
) -> DataFrame:
    """The plain-text project brief as lines (section, line key, text).

    A project may own any number of change orders, so the text is not glued into one
    value; sorting by project, section and key gives the document.
    """
    unbilled = _usd("contract_value * COALESCE(billing_gap, 0D)")
    gap = (
        f"CASE WHEN billing_data_available THEN {_pct('billing_gap')} || ' (' || {unbilled} || "
        "' unbilled)' ELSE 'N/A' END"
    )
    billed = (
        f"CASE WHEN billing_data_available THEN {_pct('percent_billed')} "
        "ELSE 'N/A (billing history unavailable)' END"
    )
    cost = lambda label, key: (
        f"'  {label} Budget: ' || {_usd(key + '_budget')} || ' | Actual: ' || "
        f"{_usd(key + '_actual')} || ' | Overrun: ' || {_usd(key + '_overrun')}"
    )
    lines = [
        "'PROJECT: ' || id || ' -- ' || name",
        "'SECTOR: ' || sector",
        f"'CONTRACT VALUE: ' || {_usd('contract_value')}",
        "'MARGIN ANALYSIS'",
        f"'  Bid Margin:      ' || {_pct('bid_margin')}",
        f"'  Realized Margin: ' || {_pct('realized_margin')}",
        f"'  Margin Erosion:  ' || {_pct('abs(margin_delta)')} || ' below bid'",
        "'  Severity:        ' || upper(severity)",
        "'COST BREAKDOWN'",
        cost("Labor    --", "labor"),
        cost("Material --", "material"),
        "'BILLING STATUS'",
        f"'  % Complete: ' || {_pct('percent_complete')}",
        f"'  % Billed:   ' || {billed}",
        f"'  Billing Gap: ' || {gap}",
        "'FIELD NOTES'",
        "COALESCE(field_note_summary, 'None available.')",
    ]
    head = base.join(notes.withColumnRenamed("project_id", "id"), "id", "left")
    header = head.selectExpr("id", f"posexplode(array({', '.join(lines)})) AS (pos, line)").selectExpr(
        "id AS project_id", "1 AS section", "lpad(CAST(pos AS STRING), 4, '0') AS line_key", "line"
    )
    ids = base.selectExpr("id AS project_id")
    own = lambda df: df.join(ids, "project_id", "left_semi")
    totals = own(orders).groupBy("project_id").agg(F.expr("count(1) AS n"))
    co_head = ids.join(totals, "project_id", "left").selectExpr(
        "project_id", "2 AS section", "'' AS line_key",
        "'CHANGE ORDERS (' || CAST(COALESCE(n, 0L) AS STRING) || ')' || "
        "CASE WHEN n IS NULL THEN '\\n  None' ELSE '' END AS line",
    )
    co_lines = own(orders).selectExpr(
        "project_id", "2 AS section", "co_number AS line_key",
        f"'  ' || co_number || ' [' || upper(COALESCE(status, '')) || '] ' || "
        f"{_usd('COALESCE(amount, 0D)')} || ' -- ' || COALESCE(description, '') AS line",
    )
    waiting = own(rfis).filter("status = 'open'")
    open_counts = waiting.groupBy("project_id").agg(F.expr("count(1) AS n"))
    rfi_head = ids.join(open_counts, "project_id", "left").selectExpr(
        "project_id", "3 AS section", "'' AS line_key",
        "'OPEN RFIs' || CASE WHEN n IS NULL THEN '\\n  None' ELSE '' END AS line",
    )
    rfi_lines = waiting.selectExpr(
        "project_id", "3 AS section", "id AS line_key",
        "'  ' || id || ' -- open ' || COALESCE(CAST(days_open AS STRING), '?') || 'd -- ' || "
        "description AS line",
    )
    return reduce(
        lambda a, b: a.unionByName(b), [header, co_head, co_lines, rfi_head, rfi_lines]
    )
