"""Per-project evidence taken from logs, deliveries, change orders, RFIs and notes.

Every function returns at most one row per project. Top-k lists are cut with a
row-number filter, which Spark applies on each task before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siteledger.functions.numbers import NUMBER_PATTERN
from siteledger.functions.sql import dollars, exact_sum, fixed, half_even, join_alike, mentions, ratio, text_list
from siteledger.functions.texts import BLANKS
from siteledger.rules import (
    CO_APPROVED_WIDE, CO_REJECTED_WIDE, ISSUE_KEYWORDS, RFI_CLOSED_PACKET,
    SCHEDULE_NOTE_WORDS, SCHEDULE_REASON_WORDS, TRUE_WORDS, Rules,
)


def _by(df: DataFrame, keys: list[str], *exprs: str) -> DataFrame:
    return df.groupBy(*keys).agg(*[F.expr(e) for e in exprs])


def _in(words: list[str]) -> str:
    return "(" + ", ".join(f"'{w}'" for w in words) + ")"


def _truthy(name: str) -> str:
    return f"COALESCE(lower(trim({name})) IN {_in(TRUE_WORDS)}, false)"


def _top(df: DataFrame, order: list, n: int, keys: str = "project_id") -> DataFrame:
    ranked = df.withColumn("_rank", F.row_number().over(W.partitionBy(keys).orderBy(*order)))
    return ranked.filter(F.col("_rank") <= n)


# Missing hours count as zero; rows without a rate or burden cost nothing known.
ROW_COST = (
    "(COALESCE(CAST(hours_st AS DECIMAL(10,4)), 0) + COALESCE(CAST(hours_ot AS "
    "DECIMAL(10,4)), 0) * CAST(1.5 AS DECIMAL(2,1))) * CAST(hourly_rate AS DECIMAL(12,4)) "
    "* CAST(burden_multiplier AS DECIMAL(8,4))"
)


def labor_actual(labor: DataFrame) -> DataFrame:
    st, ot = exact_sum("COALESCE(hours_st, 0D)"), exact_sum("COALESCE(hours_ot, 0D)")
    return _by(
        labor, ["project_id"],
        f"{half_even(f'CAST(SUM({ROW_COST}) AS DOUBLE)', 2)} AS labor_actual",
        f"{half_even(ratio(ot, f'{st} + {ot}'), 4)} AS overtime_share",
    )


def crew_size_peak(labor: DataFrame) -> DataFrame:
    """Most distinct employees on one day: counted per day, then the maximum."""
    daily = _by(
        labor.filter("date IS NOT NULL AND employee_id IS NOT NULL"), ["project_id", "date"],
        "count(DISTINCT employee_id) AS crew",
    )
    return _by(daily, ["project_id"], "CAST(max(crew) AS DOUBLE) AS crew_size_peak")


def cost_code_totals(labor: DataFrame) -> DataFrame:
    """Labor cost per project and cost code."""
    coded = labor.withColumn("cost_code", F.trim("cost_code")).filter("cost_code <> ''")
    return _by(
        coded, ["project_id", "cost_code"], f"CAST(SUM({ROW_COST}) AS DOUBLE) AS code_cost"
    ).filter("code_cost IS NOT NULL")


def top_cost_codes(totals: DataFrame, rules: Rules) -> DataFrame:
    best = _top(totals, [F.col("code_cost").desc(), F.col("cost_code")], rules.top_cost_codes)
    text = f"cost_code || ' (' || {dollars('code_cost')} || ' labor)'"
    return _by(
        best, ["project_id"],
        f"array_sort(collect_list(struct(_rank, {text} AS t))).t AS top_cost_codes",
    )


def sov_id_union(labor: DataFrame, materials: DataFrame, budget: DataFrame) -> DataFrame:
    """Every cost line that has labor, material or budget, once."""
    lines = [
        df.selectExpr("project_id", "trim(sov_line_id) AS sov_line_id")
        for df in (labor, materials, budget)
    ]
    both = lines[0].unionByName(lines[1]).unionByName(lines[2])
    return both.filter("sov_line_id <> ''").distinct()


def sov_full_variance(
    labor: DataFrame, materials: DataFrame, budget: DataFrame, sov: DataFrame
) -> DataFrame:
    """Actual minus budget on every cost line that has either, with its description.

    Each side is summed per line first; the union then adds at most three rows a line.
    """
    plan = " + ".join(
        f"COALESCE(estimated_{part}_cost, 0D)" for part in ("labor", "material", "equipment", "sub")
    )
    key = ["project_id", "trim(sov_line_id) AS sov_line_id"]
    sides = [
        labor.selectExpr(*key, f"CAST({ROW_COST} AS DOUBLE) AS actual", "CAST(NULL AS DOUBLE) AS plan")
        .filter("actual IS NOT NULL"),
        materials.selectExpr(*key, "total_cost AS actual", "CAST(NULL AS DOUBLE) AS plan")
        .filter("actual IS NOT NULL"),
        budget.selectExpr(*key, "CAST(NULL AS DOUBLE) AS actual", f"{plan} AS plan"),
    ]
    rows = sides[0].unionByName(sides[1]).unionByName(sides[2]).filter("sov_line_id <> ''")
    summed = _by(
        rows, ["project_id", "sov_line_id"],
        f"COALESCE({exact_sum('actual')}, 0D) AS actual",
        f"COALESCE({exact_sum('plan')}, 0D) AS budget",
    ).withColumn("variance", F.expr("actual - budget"))
    names = _by(
        sov, ["project_id", "sov_line_id"],
        "max(COALESCE(NULLIF(description, ''), CAST(line_number AS STRING))) AS description",
    )
    return join_alike(summed, names, ["project_id", "sov_line_id"], "left").withColumn(
        "description", F.expr("COALESCE(NULLIF(description, ''), sov_line_id)")
    )


def top_sov_variances(variances: DataFrame, rules: Rules) -> DataFrame:
    """Five largest first, then only those over budget."""
    order = [F.col("variance").desc(), F.col("sov_line_id")]
    best = _top(variances, order, rules.top_sov_variances).filter("variance > 0")
    text = f"description || ': variance ' || {dollars('variance')}"
    return _by(
        best, ["project_id"],
        f"array_sort(collect_list(struct(_rank, {text} AS t))).t AS top_sov_variances",
    )


def delivery_clustering(materials: DataFrame, rules: Rules) -> DataFrame:
    monthly = _by(
        materials.filter("date IS NOT NULL").withColumn(
            "month", F.expr("date_format(date, 'yyyy-MM')")
        ),
        ["project_id", "month"], "count(1) AS n",
    )
    return _by(
        monthly, ["project_id"],
        f"{ratio('max(n)', 'sum(n)')} >= {rules.delivery_clustering}D AS delivery_clustering_signal",
    )


def packet_co_summary(orders: DataFrame) -> DataFrame:
    """Three status buckets; a bucket without orders has no value."""
    status = "COALESCE(lower(trim(status)), '')"
    bucket = (
        f"CASE WHEN {status} IN {_in(CO_APPROVED_WIDE)} THEN 'approved' "
        f"WHEN {status} IN {_in(CO_REJECTED_WIDE)} THEN 'rejected' ELSE 'pending' END"
    )
    sums = []
    for b in ("approved", "pending", "rejected"):
        value = exact_sum(f"CASE WHEN bucket = '{b}' THEN COALESCE(amount, 0D) END")
        sums += [f"count_if(bucket = '{b}') AS {b}_count", f"{half_even(value, 2)} AS {b}_value"]
    return _by(orders.withColumn("bucket", F.expr(bucket)), ["project_id"], *sums)


def co_reason_top2(orders: DataFrame) -> DataFrame:
    counts = _by(
        orders.withColumn("reason", F.trim("reason_category")).filter("reason <> ''"),
        ["project_id", "reason"], "count(1) AS n",
    )
    best = _top(counts, [F.col("n").desc(), F.col("reason")], 2)
    return _by(
        best, ["project_id"],
        "array_sort(collect_list(struct(_rank, reason))).reason AS top_reasons",
    )


def co_summary_text(summary: DataFrame, reasons: DataFrame) -> DataFrame:
    parts = [
        f"CASE WHEN {b}_count > 0 THEN CAST({b}_count AS STRING) || ' {b} COs totaling ' || "
        f"{dollars(b + '_value')} END"
        for b in ("approved", "pending", "rejected")
    ]
    drivers = "'Most common drivers: ' || NULLIF(array_join(top_reasons, ', '), '')"
    return join_alike(summary, reasons, "project_id", "left").selectExpr(
        "project_id", f"NULLIF(concat_ws('. ', {', '.join(parts)}, {drivers}), '') "
        "AS change_order_summary",
    )


def packet_rfi_counts(rfis: DataFrame) -> DataFrame:
    return _by(
        rfis, ["project_id"],
        "count(1) AS rfi_total",
        f"count_if(COALESCE(lower(status), '') NOT IN {_in(RFI_CLOSED_PACKET)}) AS rfi_open",
        "count_if(lower(priority) = 'high') AS rfi_high",
        f"count_if({_truthy('cost_impact')} OR {_truthy('schedule_impact')}) AS rfi_impacted",
        f"count_if({_truthy('schedule_impact')}) AS rfi_schedule",
    )


def rfi_summary_text(rfis: DataFrame, counts: DataFrame, rules: Rules) -> DataFrame:
    """Counts and the subjects of the first two RFIs by date and number."""
    order = [F.col("date_submitted").asc_nulls_last(), F.col("rfi_number").asc_nulls_last()]
    subject = _truncated(_squished("subject"), rules.subject_chars)
    first = _by(
        _top(rfis.select("project_id", "date_submitted", "rfi_number", "subject"), order, 2)
        .filter("subject <> ''"),
        ["project_id"],
        f"array_join(array_sort(collect_list(struct(_rank, {subject} AS t))).t, '; ') AS topics",
    )
    n = lambda c: f"CAST({c} AS STRING)"
    return join_alike(counts, first, "project_id", "left").selectExpr(
        "project_id",
        f"concat_ws('. ', {n('rfi_total')} || ' RFIs total', "
        f"CASE WHEN rfi_open > 0 THEN {n('rfi_open')} || ' still open' END, "
        f"CASE WHEN rfi_high > 0 THEN {n('rfi_high')} || ' marked high priority' END, "
        f"CASE WHEN rfi_impacted > 0 THEN {n('rfi_impacted')} || "
        "' show cost or schedule impact' END, 'Key topics: ' || topics) AS rfi_summary",
    )


# ---- field notes --------------------------------------------------------------------


def _squished(name: str) -> str:
    return f"trim(regexp_replace(COALESCE({name}, ''), r'{BLANKS}', ' '))"


def _truncated(text: str, limit: int) -> str:
    return (
        f"CASE WHEN length({text}) <= {limit} THEN {text} "
        f"ELSE rtrim(substring({text}, 1, {limit - 3})) || '...' END"
    )


def note_score_sql(low: str) -> str:
    """Number of issue categories a lower-case text touches."""
    return " + ".join(
        f"CAST({mentions(low, kws, lowered=True)} AS BIGINT)" for kws in ISSUE_KEYWORDS.values()
    )


def note_scores(notes: DataFrame) -> DataFrame:
    low = notes.selectExpr("*", "lower(content) AS _low")
    return low.selectExpr(*notes.columns, f"{note_score_sql('_low')} AS note_score")


def top_field_notes(notes: DataFrame, rules: Rules) -> DataFrame:
    """Six best-scored notes per project; newer first, then by text."""
    order = [F.col("note_score").desc(), F.col("date").desc_nulls_last(), F.col("content")]
    return _top(
        note_scores(notes).select("project_id", "date", "content", "note_score"),
        order, rules.top_notes,
    ).withColumnRenamed("_rank", "note_rank")


def field_notes_summary(top_notes: DataFrame, rules: Rules) -> DataFrame:
    """Snippets, scope signals and events from the top notes (six a project at most)."""
    told = top_notes.selectExpr(
        "project_id", "note_rank", f"{_squished('content')} AS clean"
    ).selectExpr("*", "lower(clean) AS low").selectExpr(
        "project_id", "note_rank", f"{_truncated('clean', rules.note_chars)} AS snippet",
        f"({note_score_sql('low')}) > 0 AS notable",
        f"{mentions('low', ISSUE_KEYWORDS['owner_scope'], lowered=True)} AS scope",
    )
    listed = _by(
        told, ["project_id"],
        "filter(array_sort(collect_list(struct(note_rank, snippet, notable, scope))), "
        "n -> n.snippet <> '') AS notes",
    )
    pick = lambda flag, n: f"slice(filter(notes, n -> n.{flag}).snippet, 1, {n})"
    return listed.selectExpr(
        "project_id",
        f"NULLIF(array_join({pick('notable', 3)}, ' | '), '') AS field_notes_summary",
        f"array_distinct({pick('scope', 5)}) AS missing_scope_signals",
        f"array_distinct({pick('notable', 5)}) AS notable_events",
    )


def keyword_hits(notes: DataFrame) -> DataFrame:
    return _by(
        notes, ["project_id"],
        f"count_if({mentions('content', SCHEDULE_NOTE_WORDS)}) AS note_hits",
    )


def recent_notes(notes: DataFrame) -> DataFrame:
    """Newest five notes; the first three with text, joined."""
    order = [F.col("date").desc_nulls_last(), F.col("content").asc_nulls_last()]
    newest = _top(notes.select("project_id", "date", "content"), order, 5)
    listed = _by(
        newest.filter("trim(content) <> ''"), ["project_id"],
        "array_sort(collect_list(struct(_rank, trim(content) AS t))).t AS texts",
    )
    return listed.selectExpr(
        "project_id", "array_join(slice(texts, 1, 3), ' | ') AS field_note_summary"
    )


def schedule_signals(
    orders: DataFrame, rfi_counts: DataFrame, note_hits: DataFrame
) -> DataFrame:
    urgent = mentions("reason_category", SCHEDULE_REASON_WORDS)
    per_project = _by(orders, ["project_id"], f"count_if({urgent}) AS urgent_cos")
    joined = per_project.join(
        rfi_counts.select("project_id", "rfi_schedule"), "project_id", "full_outer"
    ).join(note_hits, "project_id", "full_outer")
    n = lambda c: f"CAST({c} AS STRING)"
    signals = text_list(
        ("rfi_schedule > 0", f"{n('rfi_schedule')} || ' RFIs show schedule impact'"),
        ("urgent_cos > 0", f"{n('urgent_cos')} || ' change orders reference acceleration or "
         "schedule pressure'"),
        ("note_hits > 0", f"{n('note_hits')} || ' field notes mention delay, access, or rework'"),
    )
    return joined.selectExpr("project_id", f"{signals} AS schedule_pressure_signals")


# ---- billing ------------------------------------------------------------------------


def latest_billing(billing: DataFrame) -> DataFrame:
    """The newest application by period end and number."""
    row = "struct(application_number, period_end, cumulative_billed, retention_held, status)"
    key = "struct(period_end, application_number, cumulative_billed)"
    return _by(billing, ["project_id"], f"max_by({row}, {key}) AS b").selectExpr(
        "project_id", "b.*"
    )


def _application_key() -> str:
    """Numeric application numbers rank above text ones."""
    text = "trim(COALESCE(CAST(application_number AS STRING), ''))"
    is_number = f"{text} RLIKE r'{NUMBER_PATTERN}'"
    number = f"CASE WHEN {is_number} THEN TRY_CAST({text} AS DOUBLE) ELSE -1D END"
    return f"struct({is_number} AS is_number, {number} AS number, {text} AS text)"


def latest_application(lines: DataFrame) -> DataFrame:
    return _by(
        lines.select("project_id", "application_number").distinct(), ["project_id"],
        f"max({_application_key()}).text AS latest_application",
    )


def weighted_pct_complete(lines: DataFrame) -> DataFrame:
    """Value-weighted progress of the latest application only.

    Lines are summed per application first, then the latest one is picked; both steps
    combine on each task before the shuffle.
    """
    known = "scheduled_value IS NOT NULL AND pct_complete IS NOT NULL"
    per_app = _by(
        lines, ["project_id", "application_number"],
        exact_sum(f"CASE WHEN {known} THEN scheduled_value * pct_complete END") + " AS earned",
        exact_sum(f"CASE WHEN {known} THEN scheduled_value END") + " AS value",
    )
    return _by(
        per_app, ["project_id"], f"max_by(struct(earned, value), {_application_key()}) AS latest"
    ).selectExpr(
        "project_id",
        f"{half_even(ratio('latest.earned', 'latest.value'), 2)} AS percent_complete",
    )


def billing_summary_text() -> str:
    """One sentence on billing, from the latest application and the packet percents."""
    return (
        "NULLIF(concat_ws('. ', 'Latest application #' || CAST(application_number AS STRING), "
        f"'status ' || status, 'billing is ' || {fixed('billing_complete_pct', 1)} || "
        f"'% of contract', 'work progress is ' || {fixed('percent_complete', 1)} || "
        "'% complete', CASE WHEN retention_held <> 0 THEN 'retention held ' || "
        f"{dollars('retention_held')} END), '')"
    )


def row_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """Rows per project and table, as rows; tables without rows do not appear."""
    counts = None
    for name, df in tables.items():
        one = _by(df.filter("project_id IS NOT NULL"), ["project_id"], "count(1) AS row_count")
        one = one.selectExpr("project_id", f"'{name}' AS table_name", "row_count")
        counts = one if counts is None else counts.unionByName(one)
    return counts
