"""Queries over scalar functions, sources, sinks, documents and streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siteledger.functions import numbers, stages, texts
from siteledger.operators import cleaning, documents, packets, portfolio, risk
from siteledger.operators.ordering import scratch_path
from siteledger.plans import catalog
from siteledger.plans.catalog import query
from siteledger.plans.oracle_views import (
    LABOR_COST, SECTOR_A, SECTOR_B, pct_text, short_usd, usd,
)
from siteledger.plans.portfolio import Portfolio
from siteledger.rules import (
    SECTORS_PORTFOLIO, SECTORS_PORTFOLIO_DEFAULT, SECTORS_PROJECT, SECTORS_PROJECT_DEFAULT,
    TRUE_WORDS,
)
from siteledger.sources import readers, writers
from siteledger.sources.schemas import REQUIRED_COLUMNS, SCHEMAS
from siteledger.streaming import jobs

# ---- scalar functions ----------------------------------------------------------------

_HOURS = ("hours_st", "hours_ot", "hourly_rate", "burden_multiplier")
query("labor_cost",
      lambda p: p.tables["labor_logs"].select(
          "log_id", numbers.labor_cost(*[F.col(c) for c in _HOURS]).alias("labor_cost")),
      f"SELECT log_id, CAST({LABOR_COST} AS DOUBLE) AS labor_cost FROM v_labor_logs")
query("safe_divide",
      lambda p: p.tables["labor_logs"].select(
          "log_id", numbers.ratio(F.col("hours_st"), F.col("hours_ot")).alias("quotient")),
      "SELECT log_id, hours_st / NULLIF(hours_ot, 0) AS quotient FROM v_labor_logs")
query("pct",
      lambda p: p.tables["billing_history"].select(
          "project_id", "application_number",
          numbers.percent_points(F.col("period_total"), F.col("cumulative_billed")).alias("pct"),
          numbers.multiple(F.col("cumulative_billed"), F.col("period_total")).alias("multiple"),
          numbers.difference(F.col("cumulative_billed"), F.col("period_total"))
          .alias("difference")), """
SELECT project_id, application_number,
  round_even(period_total / NULLIF(cumulative_billed, 0) * 100, 2) AS pct,
  round_even(cumulative_billed / NULLIF(period_total, 0), 2) AS multiple,
  round_even(cumulative_billed - period_total, 2) AS difference FROM v_billing_history""")
query("parse_date_multi",
      lambda p: p.tables["change_orders"].select(
          "co_number", F.explode(F.array(
              F.col("date_submitted").cast("string"),
              F.date_format("date_submitted", "M/d/yyyy"),
              F.date_format("date_submitted", "yyyy/M/d"), F.lit("soon"))).alias("text"))
      .select("co_number", "text", stages.parse_date_multi(F.col("text")).alias("parsed")), """
SELECT co_number, unnest([CAST(date_submitted AS VARCHAR), strftime(date_submitted, '%-m/%-d/%Y'),
    strftime(date_submitted, '%Y/%-m/%-d'), 'soon']) AS text,
  unnest([date_submitted, date_submitted, date_submitted, NULL]) AS parsed FROM v_change_orders""")
query("parse_date_loose",
      lambda p: p.tables["change_orders"].select(
          "co_number", F.explode(F.array(
              F.col("date_submitted").cast("string"),
              F.date_format("date_submitted", "MM/dd/yyyy"))).alias("date"))
      .transform(lambda d: d.select(
          "co_number", F.col("date").alias("text"), numbers.date(d, "date").alias("parsed"))), """
SELECT co_number, unnest([CAST(date_submitted AS VARCHAR),
    strftime(date_submitted, '%m/%d/%Y')]) AS text,
  unnest([date_submitted, NULL]) AS parsed FROM v_change_orders""")
query("truthy",
      lambda p: p.tables["rfis"].select(
          "rfi_number", texts.truthy(F.col("cost_impact"), TRUE_WORDS).alias("cost"),
          texts.truthy(F.col("schedule_impact"), TRUE_WORDS).alias("schedule")), """
SELECT rfi_number, lower(trim(cost_impact)) IN ('true', 'yes', '1', 'y') AS cost,
  lower(trim(schedule_impact)) IN ('true', 'yes', '1', 'y') AS schedule FROM v_rfis""")
query("clip",
      lambda p: p.tables["billing_history"].select(
          "project_id", "application_number",
          numbers.clip01(F.col("cumulative_billed") / 100000).alias("share"),
          numbers.at_least_zero(F.col("period_total") - 20000).alias("excess")), """
SELECT project_id, application_number,
  least(greatest(cumulative_billed / 100000, 0::DOUBLE), 1::DOUBLE) AS share,
  greatest(period_total - 20000, 0::DOUBLE) AS excess FROM v_billing_history""")
query("status_normalize",
      lambda p: p.tables["change_orders"].select(
          "co_number", texts.status_or_unknown(F.col("status")).alias("status"),
          texts.status_or_unknown(F.col("reason_category")).alias("reason")), """
SELECT co_number, lower(trim(status)) AS status,
  COALESCE(NULLIF(lower(trim(reason_category)), ''), 'unknown') AS reason FROM v_change_orders""")
query("coerce_numeric",
      lambda p: p.tables["labor_logs"].selectExpr(
          "log_id", "explode(array(CAST(hours_st AS STRING), '12f', 'nan', '1,200', '', "
          "concat(' ', CAST(hourly_rate AS STRING), ' '))) AS text")
      .transform(lambda d: d.select("log_id", "text", numbers.number(d, "text").alias("value"))), """
SELECT log_id, unnest([CAST(hours_st AS VARCHAR), '12f', 'nan', '1,200', '',
    ' ' || CAST(hourly_rate AS VARCHAR) || ' ']) AS text,
  unnest([hours_st, NULL, NULL, NULL, NULL, hourly_rate]) AS value FROM v_labor_logs""")
_SQUISH = r"trim(regexp_replace(content, '[\s\x0B\x1c-\x1f\x{85}\pZ]+', ' ', 'g'))"
query("squish",
      lambda p: p.tables["field_notes"].select(
          "project_id", "date", texts.squish(F.col("content")).alias("clean")),
      f"SELECT project_id, date, {_SQUISH} AS clean FROM v_field_notes")
query("truncate",
      lambda p: p.tables["field_notes"].select(
          "project_id", "date",
          texts.truncate(texts.squish(F.col("content")), p.rules.note_chars).alias("snippet")),
      f"""SELECT project_id, date, CASE WHEN length(c) <= 140 THEN c
      ELSE rtrim(c[:137]) || '...' END AS snippet
      FROM (SELECT *, {_SQUISH} AS c FROM v_field_notes)""")
query("money",
      lambda p: p.tables["billing_history"].select(
          "project_id", "application_number",
          texts.dollars(F.col("cumulative_billed")).alias("dollars"),
          texts.short_dollars(F.col("cumulative_billed")).alias("short"),
          texts.percent(F.col("period_total") / F.col("cumulative_billed")).alias("percent")), f"""
SELECT project_id, application_number, {usd('cumulative_billed')} AS dollars,
  {short_usd('cumulative_billed')} AS short,
  {pct_text('period_total / cumulative_billed')} AS percent FROM v_billing_history""")
query("sector_a",
      lambda p: p.tables["contracts"].select("project_id", texts.first_sector(
          F.col("project_name"), SECTORS_PORTFOLIO, SECTORS_PORTFOLIO_DEFAULT).alias("sector")),
      f"SELECT project_id, {SECTOR_A} AS sector FROM v_contracts")
query("sector_b",
      lambda p: p.tables["contracts"].select("project_id", texts.first_sector(
          F.col("project_name"), SECTORS_PROJECT, SECTORS_PROJECT_DEFAULT).alias("sector")),
      f"SELECT project_id, {SECTOR_B} AS sector FROM v_contracts")
query("stage_from_pct",
      lambda p: p.tables["billing_line_items"].select(
          "project_id", "application_number", "sov_line_id",
          stages.stage_of(F.col("pct_complete"), p.rules, 100).alias("stage"),
          stages.stage_or_unknown(F.lit(None).cast("double"), p.rules).alias("no_stage")), """
SELECT project_id, application_number, sov_line_id, CASE WHEN pct_complete >= 95 THEN 'complete'
  WHEN pct_complete >= 75 THEN 'late' WHEN pct_complete >= 15 THEN 'active' ELSE 'early' END
  AS stage, 'unknown' AS no_stage FROM v_billing_line_items""")
query("unique_preserve_order",
      lambda p: p.tables["change_orders"].select(
          "co_number", texts.first_distinct(F.array(
              "affected_sov_lines", "reason_category", "affected_sov_lines", "related_rfi"))
          .alias("words")), """
SELECT co_number, concat_ws(' | ', affected_sov_lines, NULLIF(reason_category, ''),
  NULLIF(related_rfi, '')) AS words FROM v_change_orders""")
query("win_01",
      lambda p: cleaning.dedup_labor(p.tables["labor_logs"]).select("log_id", "date"),
      "SELECT log_id, date FROM v_labor_first")
query("sort_01",
      lambda p: p.risk_scores.select("project_id", "risk_score", "billing_gap").orderBy(
          F.col("risk_score").desc(), F.col("billing_gap").asc_nulls_last(), "project_id"),
      "SELECT project_id, risk_score, billing_gap FROM v_risk ORDER BY 2 DESC, 3, 1", share=True)

# ---- sources: written by Spark from the given tables, then read back --------------------


def _spark(p: Portfolio) -> SparkSession:
    return p.tables["contracts"].sparkSession


def _as_csv(p: Portfolio, name: str) -> str:
    path = scratch_path(_spark(p), name)
    writers.write_table(p.tables[name], path, "csv")
    return path


def _through_csv(p: Portfolio, name: str) -> DataFrame:
    return readers.scan_table(_spark(p), _as_csv(p, name), name)


def _cleaned_or_raw(p: Portfolio) -> DataFrame:
    """Change orders twice: from the raw file alone, and with a cleaned file next to an empty raw one."""
    spark, there = _spark(p), _as_csv(p, "change_orders")
    none = scratch_path(spark, "empty")
    writers.write_table(p.tables["change_orders"].limit(0), none, "csv")
    raw = readers.cleaned_or_raw(spark, scratch_path(spark, "absent"), there, "change_orders")
    return raw.unionAll(readers.cleaned_or_raw(spark, there, none, "change_orders"))


def _optional(p: Portfolio) -> DataFrame:
    spark = _spark(p)
    there = readers.scan_optional(spark, _as_csv(p, "rfis"), "rfis", required=True)
    return there.unionByName(
        readers.scan_optional(spark, scratch_path(spark, "absent"), "rfis", required=False))


query("scan_csv", lambda p: _through_csv(p, "labor_logs"), "SELECT * FROM v_labor_logs")
query("scan_optional", _optional, "SELECT * FROM v_rfis")
query("scan_reindex",
      lambda p: readers.conform(
          p.tables["contracts"].drop("retention_pct", "gc_name"), "contracts"), """
SELECT * REPLACE (NULL::DOUBLE AS retention_pct, NULL::VARCHAR AS gc_name) FROM v_contracts""")
query("empty_fallback",
      lambda p: Portfolio(
          {k: p.tables[k] for k in SCHEMAS if k not in ("change_orders", "rfis", "field_notes",
                                                        "material_deliveries", "billing_history")},
          p.rules, p.as_of).billing_analysis, """
SELECT project_id, total_labor_cost, CAST(NULL AS DOUBLE) AS total_material_cost,
  CAST(NULL AS DOUBLE) AS total_cost, CAST(NULL AS DOUBLE) AS total_billed,
  CAST(NULL AS DOUBLE) AS billing_gap, CAST(NULL AS DOUBLE) AS margin_pct
FROM v_cost_summary WHERE total_labor_cost IS NOT NULL""")
query("cleaned_or_raw", _cleaned_or_raw,
      "SELECT * FROM v_change_orders UNION ALL SELECT * FROM v_change_orders")


def _json_docs(p: Portfolio) -> DataFrame:
    path = scratch_path(_spark(p), "docs")
    writers.write_json(p.flagged.select("project_id", "severity", "realized_margin_pct"), path)
    schema = p.flagged.select("project_id", "severity", "realized_margin_pct").schema
    return readers.scan_json_docs(_spark(p), path, schema)


query("scan_json_docs", _json_docs,
      "SELECT project_id, severity, realized_margin_pct FROM v_flagged", share=True)


def _json_with_nan(p: Portfolio) -> DataFrame:
    """Applications whose retention is NaN where no money is held."""
    path = scratch_path(_spark(p), "nan")
    held = F.when(F.col("retention_held") > 0, F.col("retention_held")).otherwise(F.lit(float("nan")))
    rows = p.tables["billing_history"].select("project_id", "application_number", held.alias("held"))
    writers.write_json(rows, path)
    return readers.scan_json_docs(_spark(p), path, rows.schema)


query("write_json", _json_with_nan, """
SELECT project_id, application_number, CASE WHEN retention_held > 0 THEN retention_held END AS held
FROM v_billing_history""")


def _bundles(p: Portfolio) -> DataFrame:
    """Deliveries split into one folder per category, found again by pattern."""
    root = scratch_path(_spark(p), "bundles")
    labeled = p.tables["material_deliveries"].select(
        "project_id", "delivery_id", F.col("material_category").alias("bundle"))
    labeled.write.option("header", True).partitionBy("bundle").csv(root)
    return readers.scan_bundle_csv(_spark(p), root, "*").select(
        "project_id", "delivery_id",
        F.regexp_replace(F.url_decode("bundle"), "^bundle=", "").alias("bundle"))


query("project_bundles", _bundles, """
SELECT project_id, delivery_id, material_category AS bundle FROM v_material_deliveries""")

query("infer_project_id",
      lambda p: p.tables["material_deliveries"].groupBy("po_number").agg(
          readers.infer_project_id(
              F.when(F.col("condition_notes") == "damaged", F.col("project_id")),
              F.col("po_number")).alias("inferred")), """
SELECT po_number, COALESCE(MIN(CASE WHEN condition_notes = 'damaged' THEN project_id END),
  po_number) AS inferred FROM v_material_deliveries GROUP BY 1""")
_FILES = ["billing_line_items_all.csv", "Billing.csv", "CO-log.csv", "change_orders.json",
          "contract.csv", "daily-log.csv", "labor.csv", "materials.json", "rfi_list.csv",
          "sov_budget.csv", "sov.csv", "schedule-of-values.csv", "budget.csv"]
_NAMES = ["billing_line_items", "billing_history", "change_orders", "change_orders", "change_orders",
          "field_notes", "labor_logs", "material_deliveries", "rfis", "sov_budget", "sov", "sov",
          "budget"]
query("canonical_table_name",
      lambda p: p.tables["contracts"].select("project_id", F.explode(F.array(
          *[F.concat(F.lit("/data/"), "project_id", F.lit(f"/{f}")) for f in _FILES]))
          .alias("path")).select(
              "project_id", "path",
              readers.canonical_table_name(F.col("path")).alias("table_name")), f"""
SELECT project_id, '/data/' || project_id || '/' || unnest({_FILES}) AS path,
  unnest({_NAMES}) AS table_name FROM v_contracts""")


def _json_tables(p: Portfolio) -> DataFrame:
    """Change orders as small JSON tables: a list, and a list under a key."""
    record = F.struct("project_id", "status")
    return p.tables["change_orders"].select(
        "co_number",
        F.explode(F.array(
            F.to_json(F.array(record)),
            F.concat(F.lit('{"version": "1", "rows": '), F.to_json(F.array(record)), F.lit("}")),
            F.lit('{"version": "1"}'))).alias("text"))


query("normalize_json_table",
      lambda p: _json_tables(p).select(
          "co_number", F.explode(readers.normalize_json_table(F.col("text"))).alias("r")).select(
              "co_number", F.col("r")["project_id"].alias("project_id"),
              F.col("r")["status"].alias("status")), """
SELECT co_number, project_id, status FROM v_change_orders
UNION ALL SELECT co_number, project_id, status FROM v_change_orders""")
query("flagged_ids",
      lambda p: readers.flagged_ids(
          documents.analysis_documents(p.briefs).select(F.to_json(F.struct("*")).alias("value"))),
      "SELECT project_id FROM v_flagged", share=True)
query("parse_id_list",
      lambda p: readers.parse_id_list(
          p.tables["contracts"].select(
              F.concat(F.lit(" , "), "project_id", F.lit(", "), "gc_name").alias("ids")), "ids"),
      "SELECT project_id FROM v_contracts UNION SELECT gc_name FROM v_contracts")
query("project_subset",
      lambda p: readers.project_subset(p.tables["change_orders"], p.flagged),
      """SELECT * FROM v_change_orders
      WHERE project_id IN (SELECT project_id FROM v_flagged)""", share=True)


def _availability(p: Portfolio) -> DataFrame:
    folder = scratch_path(_spark(p), "inputs")
    for name in ("contracts", "sov_budget", "rfis"):
        writers.write_table(p.tables[name], f"{folder}/{name}_all.csv", "csv")
    return readers.data_availability(_spark(p), folder).select(
        "table_name", "required", "present", "degraded")


query("data_availability", _availability, """
SELECT name AS table_name, name IN ('contracts', 'labor_logs', 'sov_budget') AS required,
  name IN ('contracts', 'sov_budget', 'rfis') AS present,
  name NOT IN ('contracts', 'labor_logs', 'sov_budget', 'rfis') AS degraded
FROM (SELECT unnest(['contracts', 'labor_logs', 'material_deliveries', 'sov_budget', 'sov',
  'change_orders', 'rfis', 'billing_history', 'billing_line_items', 'field_notes']) AS name)""")
query("required_columns",
      lambda p: readers.required_columns(
          {k: p.tables[k].drop("project_id", "cumulative_billed") for k in REQUIRED_COLUMNS}),
      " UNION ALL ".join(
          f"SELECT '{name}' AS table_name, COUNT(*) AS rows_checked, "
          f"'{' | '.join(c for c in cols if c in ('project_id', 'cumulative_billed'))}' AS missing "
          f"FROM v_{name}" for name, cols in REQUIRED_COLUMNS.items()))


def _checked(p: Portfolio) -> DataFrame:
    risk.require_columns(p.analysis_w_rfi, ["project_id", *risk.WANTED])
    return p.analysis_w_rfi.select("project_id", *risk.WANTED)


query("required_input_columns", _checked,
      "SELECT project_id, billing_gap, margin_pct, rejected_value_ratio, total_rfis "
      "FROM v_analysis_rfi")


def _written(p: Portfolio, name: str) -> DataFrame:
    path = scratch_path(_spark(p), name)
    writers.write_table(p.tables[name], path)
    return _spark(p).read.schema(SCHEMAS[name]).parquet(path)


query("write_table", lambda p: _written(p, "billing_history"), "SELECT * FROM v_billing_history")


def _manifest(p: Portfolio) -> DataFrame:
    """Each packet's path is looked up again among the files of the folder."""
    path = scratch_path(_spark(p), "packets")
    writers.write_packets(packets.nested_packet(p.packet, p.row_counts), path)
    written = _spark(p).read.parquet(path)
    manifest = writers.packet_manifest(written)
    files = _spark(p).read.format("binaryFile").load(path).select(F.col("path").alias("packet_path"))
    local = F.regexp_replace("packet_path", "^file:/+", "file:/")
    found = manifest.withColumn("packet_path", local).join(
        files.select(local.alias("packet_path")), "packet_path", "left_semi")
    return found.drop("packet_path").withColumn(
        "project_count", writers.manifest_header(manifest).scalar())


query("packets_and_manifest", _manifest, """
SELECT project_id, project_name, project_stage,
  (SELECT COUNT(*) FROM v_packet) AS project_count FROM v_packet""", share=True)


def _unfolded() -> str:
    """Every field of `v_packet` as the rows that its place in the document gives."""
    lists = ("missing_scope_signals", "top_cost_codes", "top_sov_variances", "schedule_pressure_signals",
             "notable_events", "recovery_paths_available")
    texts = ("project_id", "project_name", "project_stage", "customer", "delivery_status", "delivery_clustering_signal",
             "field_notes_summary", "rfi_summary", "change_order_summary", "billing_notes_summary",
             "largest_variance_bucket", "is_billing_nearly_complete", "is_project_effectively_complete")
    parts = []
    for section, columns in packets.SECTIONS.items():
        for name in (c.rpartition(" AS ")[2] for c in columns):
            head = f"SELECT project_id, '{section}' AS section, '{name}' AS field"
            if name in lists:
                # Notes may hold the separator, so their lists are taken before they are joined.
                notes = name in ("missing_scope_signals", "notable_events")
                items = (f"COALESCE({name}_list, [])" if notes else
                         f"CASE WHEN {name} = '' THEN [] ELSE string_split({name}, ' | ') END")
                known = "v_packet LEFT JOIN v_p_note_lists USING (project_id)" if notes else "v_packet"
                parts.append(f"{head}, NULL::BIGINT AS place, NULL::VARCHAR AS text, len({items})::DOUBLE AS amount FROM {known}")
                parts.append(f"{head}, UNNEST(RANGE(1, len({items}) + 1)), UNNEST({items}), NULL FROM {known}")
            elif name in texts:
                parts.append(f"{head}, NULL::BIGINT AS place, {name}::VARCHAR AS text, NULL::DOUBLE AS amount FROM v_packet")
            else:
                parts.append(f"{head}, NULL, NULL, {name}::DOUBLE FROM v_packet")
    trace = "SELECT r.project_id, 'source_trace' AS section"
    known = "v_table_rows r JOIN v_packet USING (project_id)"
    parts.append(f"{trace}, 'row_counts.' || table_name, NULL, NULL, row_count::DOUBLE FROM {known}")
    parts.append(f"{trace}, 'tables_used', ROW_NUMBER() OVER (PARTITION BY r.project_id ORDER BY table_name), table_name, NULL FROM {known}")
    parts.append(f"{trace}, 'tables_used', NULL, NULL, COUNT(*)::DOUBLE FROM {known} GROUP BY 1")
    return "\nUNION ALL ".join(parts)


query("project_packet_documents",
      lambda p: packets.packet_leaves(writers.packet_documents(packets.nested_packet(p.packet, p.row_counts))),
      _unfolded(), share=True)

# ---- documents ----------------------------------------------------------------------------


def _responses(p: Portfolio) -> DataFrame:
    """Documents wrapped as raw answers; early projects get a cut-off one."""
    body = F.to_json(F.struct("*"))
    stage = F.col("financial_snapshot.project_stage")
    wrapped = (
        F.when(stage == "complete", F.concat(F.lit("Here it is:\n```json\n"), body, F.lit("\n```")))
        .when(stage == "late", F.concat(F.lit("Analysis: "), body, F.lit(" -- done")))
        .when(stage == "active", body)
        .otherwise(F.concat(F.lit("Sorry: "), F.regexp_replace(body, r"\}+$", "")))
    )
    return documents.analysis_documents(p.briefs).select("project_id", wrapped.alias("response"))


query("extract_json",
      lambda p: documents.parse_documents(_responses(p)).select(
          "project_id", F.col("doc").isNotNull().alias("readable"),
          F.col("doc.headline").alias("headline")), """
SELECT id AS project_id, project_stage <> 'early' AS readable,
  CASE WHEN project_stage <> 'early' THEN headline END AS headline FROM v_briefs""", share=True)


def _faulty_documents(p: Portfolio) -> DataFrame:
    """Documents with faults that depend on the project's stage."""
    stage = F.col("financial_snapshot.project_stage")
    return documents.analysis_documents(p.briefs).withColumns(
        {
            "severity": F.when(stage == "late", F.lower("severity")).otherwise(F.col("severity")),
            "headline": F.when(stage != "complete", F.col("headline")),
            "confidence": F.when(stage == "active", F.lit(1.5)).otherwise(F.col("confidence")),
        }
    ).withColumn("doc", F.struct("*"))


query("document_rules", lambda p: documents.violations(_faulty_documents(p)), """
SELECT id AS project_id, 'root_causes_count' AS rule FROM v_briefs
WHERE id NOT IN (SELECT project_id FROM v_causes)
UNION ALL SELECT id, 'recovery_actions_count' FROM v_briefs
WHERE id NOT IN (SELECT project_id FROM v_actions)
UNION ALL SELECT id, 'severity_word' FROM v_briefs WHERE project_stage = 'late'
UNION ALL SELECT id, 'missing_headline' FROM v_briefs WHERE project_stage = 'complete'
UNION ALL SELECT id, 'confidence_range' FROM v_briefs WHERE project_stage = 'active'""", share=True)
_SCORED = """
SELECT f.project_id, CASE WHEN project_stage = 'early' THEN 'unreadable'
    WHEN id NOT IN (SELECT project_id FROM v_causes) OR id NOT IN (SELECT project_id FROM v_actions)
    THEN 'invalid' ELSE 'ok' END AS outcome,
  CASE WHEN project_stage <> 'early' THEN headline END AS headline,
  CASE WHEN project_stage <> 'early' THEN upper(b.severity) END AS severity,
  CASE WHEN project_stage <> 'early' THEN total_recoverable_estimate END
    AS total_recoverable_estimate
FROM v_flagged f JOIN v_briefs b ON f.project_id = b.id"""
query("score_responses",
      lambda p: documents.score_responses(
          p.briefs.selectExpr("id AS project_id"), _responses(p)), _SCORED, share=True)
query("response_counts",
      lambda p: documents.response_counts(documents.score_responses(
          p.briefs.selectExpr("id AS project_id"), _responses(p))),
      f"SELECT outcome, COUNT(*) AS projects FROM ({_SCORED}) GROUP BY 1", share=True)


# ---- streams: run to the end over files that Spark wrote from the given tables ----------------


def _labor_files(p: Portfolio, df: DataFrame) -> tuple[str, DataFrame]:
    path = scratch_path(_spark(p), "labor-files")
    writers.write_table(df, path)
    return path, jobs.labor_stream(_spark(p), path, df.schema)


def _run(p: Portfolio, stream: DataFrame) -> DataFrame:
    out, state = scratch_path(_spark(p), "out"), scratch_path(_spark(p), "state")
    jobs.run_available(stream, out, state)
    return _spark(p).read.schema(stream.schema).parquet(out)


def _stream_dedup(p: Portfolio) -> DataFrame:
    """The log arrives in three files, its latest days first."""
    spark, labor = _spark(p), p.tables["labor_logs"].filter("log_id IS NOT NULL")
    path, root, state = (scratch_path(spark, n) for n in ("labor-files", "labor-first", "state"))
    table = jobs.first_rows(spark, root, labor.schema, 8)
    for days in ("date >= DATE '1999-01-01'", "date < DATE '1999-01-01' AND date >= DATE '1997-01-01'",
                 "date IS NULL OR date < DATE '1997-01-01'"):
        labor.filter(days).write.mode("append").parquet(path)
        jobs.merge_stream(spark.readStream.schema(labor.schema).parquet(path), table, state)
    return table.read()


def _stream_weekly(p: Portfolio) -> DataFrame:
    _, stream = _labor_files(p, p.labor_valid)
    return _run(p, jobs.stream_weekly_cost(stream))


def _stream_refresh(p: Portfolio) -> DataFrame:
    """Two refreshes: stale costs first, then the real ones."""
    spark, path = _spark(p), scratch_path(_spark(p), "weekly-files")
    root, state = scratch_path(spark, "weekly"), scratch_path(spark, "state")
    weeks = p.labor_week.select("project_id", "week_start", "total_labor_cost")
    table = jobs.refreshed(spark, root, weeks.schema, ["project_id", "week_start"], 8)
    for version in (weeks.withColumn("total_labor_cost", F.lit(0.0)), weeks):
        version.write.mode("append").parquet(path)
        jobs.merge_stream(spark.readStream.schema(weeks.schema).parquet(path), table, state)
    return table.read().drop("batch_id")


query("stream_labor_dedup", _stream_dedup, "SELECT * FROM v_labor_first")
query("stream_weekly_cost", _stream_weekly, """
SELECT project_id, week_start, total_labor_cost FROM v_labor_week
WHERE week_start + 7 <= (SELECT MAX(date) FROM v_labor) - 7""")
query("stream_refresh", _stream_refresh,
      "SELECT project_id, week_start, total_labor_cost FROM v_labor_week")
