"""The ten input tables derived from the star-schema test tables.

A project is a customer; labor and deliveries are order lines; change orders and
pay applications are orders; RFIs are events; field notes are documents.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siteledger.functions.sql import join_alike

COST_LINES = 8


# Stated, so that no job is needed to read a schema.
_STAR = {
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, "
    "c_mktsegment string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, "
    "o_totalprice double, o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, "
    "l_quantity double, l_extendedprice double, l_discount double, l_tax double, "
    "l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, "
    "value double, props string",
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
}


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.schema(_STAR[name]).parquet(f"{sf_dir}/{name}.parquet")


PROJECT = "'PRJ-' || CAST({key} AS STRING) AS project_id"


def _project(key: str) -> str:
    return PROJECT.format(key=key)


def _cents(name: str, factor: str) -> str:
    return (
        f"CAST(CAST({name} AS DECIMAL(18,2)) * CAST({factor} AS DECIMAL(6,4)) AS DECIMAL(18,2))"
    )


LINES = f"explode(sequence(0, {COST_LINES - 1})) AS line"


def contracts(spark: SparkSession, sf_dir: str) -> DataFrame:
    customer = _read(spark, sf_dir, "customer")
    nation = _read(spark, sf_dir, "nation").selectExpr("n_nationkey AS c_nationkey", "n_name")
    return customer.join(nation, "c_nationkey").selectExpr(
        _project("c_custkey"),
        "CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 'Mercy Hospital ' "
        "WHEN 'BUILDING' THEN 'Office Tower ' WHEN 'FURNITURE' THEN 'Elementary School ' "
        "WHEN 'HOUSEHOLD' THEN 'Multifamily Housing ' ELSE 'Plant ' END "
        "|| CAST(c_custkey AS STRING) AS project_name",
        "n_name AS gc_name",
        "CAST(IF(c_custkey % 97 = 0, 0, 210000 + (c_custkey * 7919 % 21 - 10) * 3000) AS DOUBLE) "
        "AS original_contract_value",
        "0.10D AS retention_pct",
        "CASE c_custkey % 4 WHEN 0 THEN DATE'2023-06-30' WHEN 1 THEN DATE'2024-02-15' "
        "WHEN 2 THEN DATE'2025-12-31' END AS substantial_completion_date",
    )


def _order_lines(spark: SparkSession, sf_dir: str, numbers: str) -> DataFrame:
    lineitem = _read(spark, sf_dir, "lineitem").filter(f"l_linenumber IN ({numbers})")
    orders = _read(spark, sf_dir, "orders").selectExpr("o_orderkey AS l_orderkey", "o_custkey")
    return join_alike(lineitem, orders, "l_orderkey", "inner")


def labor_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _order_lines(spark, sf_dir, "1, 2, 3, 5").selectExpr(
        _project("o_custkey"),
        "concat('L-', l_orderkey, '-', l_linenumber) AS log_id",
        "CAST(l_shipdate AS DATE) AS date",
        "concat('E-', l_suppkey) AS employee_id",
        "CASE l_partkey % 6 WHEN 0 THEN 'JM Pipefitter' WHEN 1 THEN 'Fmn' WHEN 2 THEN 'Helper' "
        "WHEN 3 THEN 'DDC Tech' WHEN 4 THEN 'Foreman' ELSE 'Journeyman Sheet Metal' END AS role",
        f"concat('SOV-', l_partkey % {COST_LINES}) AS sov_line_id",
        "l_quantity % 9 AS hours_st",
        "IF(l_returnflag = 'R', l_quantity % 4, 0D) AS hours_ot",
        "CAST((30 + l_partkey % 41) * 20 AS DOUBLE) AS hourly_rate",
        "CAST(1.3 + CAST(l_tax AS DECIMAL(8,4)) AS DOUBLE) AS burden_multiplier",
        "concat('A-', l_linenumber) AS work_area",
        "concat('CC-', l_suppkey % 7) AS cost_code",
    )


def material_deliveries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _order_lines(spark, sf_dir, "4, 6, 7").selectExpr(
        _project("o_custkey"),
        "concat('D-', l_orderkey, '-', l_linenumber) AS delivery_id",
        "CAST(l_shipdate AS DATE) AS date",
        f"concat('SOV-', l_partkey % {COST_LINES}) AS sov_line_id",
        "CASE l_partkey % 6 WHEN 0 THEN 'CONTROLS' WHEN 1 THEN 'Duct Work' WHEN 2 THEN 'Equip.' "
        "WHEN 3 THEN 'insul' WHEN 4 THEN 'Pipe' ELSE 'Piping' END AS material_category",
        "concat('item ', l_partkey) AS item_description",
        "l_quantity % 10 + 1 AS quantity",
        "'EA' AS unit",
        "CAST((20 + l_partkey % 50) * 20 AS DOUBLE) AS unit_cost",
        "(l_quantity % 10 + 1) * ((20 + l_partkey % 50) * 20) "
        "+ IF(l_suppkey % 10 = 0, 25D, 0D) AS total_cost",
        "concat('PO-', l_orderkey) AS po_number",
        "concat('V-', l_suppkey) AS vendor",
        "CAST(NULL AS STRING) AS received_by",
        "IF(l_returnflag = 'R', 'damaged', 'good') AS condition_notes",
    )


def sov_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eight cost lines a project; customers in the red have no budget for the last."""
    return (
        _read(spark, sf_dir, "customer")
        .selectExpr("c_custkey", "c_acctbal", LINES)
        .filter(f"line < {COST_LINES - 1} OR c_acctbal >= 0")
        .selectExpr(
            _project("c_custkey"),
            "concat('SOV-', line) AS sov_line_id",
            "CAST(10 + line AS DOUBLE) AS estimated_labor_hours",
            "CAST(6000 + (c_custkey * 31 + line * 17) % 13 * 1500 AS DOUBLE) "
            "AS estimated_labor_cost",
            "CAST(5000 + (c_custkey * 13 + line * 7) % 11 * 1000 AS DOUBLE) "
            "AS estimated_material_cost",
            "CAST(2000 + c_custkey % 5 * 400 AS DOUBLE) AS estimated_equipment_cost",
            "CAST(c_custkey % 3 * 800 AS DOUBLE) AS estimated_sub_cost",
            "1D AS productivity_factor",
            "'standard' AS key_assumptions",
        )
    )


def sov(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        _read(spark, sf_dir, "customer")
        .selectExpr("c_custkey", LINES)
        .selectExpr(
            _project("c_custkey"),
            "concat('SOV-', line) AS sov_line_id",
            "CAST(line AS BIGINT) AS line_number",
            "IF(line % 4 = 3, NULL, concat('Scope ', line)) AS description",
        )
    )


def change_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "orders").selectExpr(
        _project("o_custkey"),
        "concat('CO-', o_orderkey) AS co_number",
        "CAST(o_orderdate AS DATE) AS date_submitted",
        "CASE o_orderpriority WHEN '1-URGENT' THEN 'Acceleration' WHEN '2-HIGH' "
        "THEN 'Owner request' WHEN '3-MEDIUM' THEN 'Design error' WHEN '5-LOW' THEN 'Phasing' "
        "ELSE '' END AS reason_category",
        "concat('change ', o_orderkey) AS description",
        f"CAST({_cents('o_totalprice', '0.0120')} AS DOUBLE) AS amount",
        "CASE o_orderstatus WHEN 'F' THEN 'Approved' WHEN 'O' THEN ' pending ' ELSE 'REJECTED' END "
        "AS status",
        "IF(o_orderkey % 2 = 0, concat('RFI-', o_orderkey % 500), '') AS related_rfi",
        f"concat('SOV-', o_orderkey % {COST_LINES}) AS affected_sov_lines",
        "CAST(o_orderkey % 40 AS DOUBLE) AS labor_hours_impact",
        "CAST(o_orderkey % 7 AS DOUBLE) AS schedule_impact_days",
        "'PM' AS submitted_by",
        "CAST(NULL AS STRING) AS approved_by",
    )


def rfis(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "events").selectExpr(
        _project("user_id"),
        "concat('RFI-', event_id) AS rfi_number",
        "CAST(ts AS DATE) AS date_submitted",
        "concat('Subject  ', event_type, ' ', event_id) AS subject",
        "'field' AS submitted_by",
        "'engineer' AS assigned_to",
        "CASE event_type WHEN 'error' THEN 'Critical' WHEN 'purchase' THEN 'High' ELSE 'Normal' END "
        "AS priority",
        "CASE event_id % 5 WHEN 0 THEN 'Open' WHEN 1 THEN 'Closed' WHEN 2 THEN 'Resolved' "
        "WHEN 3 THEN 'Pending Response' ELSE 'Answered' END AS status",
        "CAST(ts AS DATE) AS date_required",
        "IF(event_id % 5 IN (1, 2, 4), DATE'2024-02-05', NULL) AS date_responded",
        "CAST(NULL AS STRING) AS response_summary",
        "IF(event_type IN ('click', 'error'), 'Yes', 'No') AS cost_impact",
        "IF(event_type = 'error', 'true', 'false') AS schedule_impact",
    )


def _applications(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One pay application per customer and month.

    Orders are summed per month first, so the running totals below see at most one
    row per calendar month and project, however many orders a customer has.
    """
    monthly = (
        _read(spark, sf_dir, "orders")
        .groupBy("o_custkey", F.expr("CAST(date_trunc('month', o_orderdate) AS DATE) AS month"))
        .agg(
            F.expr("max(CAST(o_orderdate AS DATE)) AS period_end"),
            F.expr(f"sum({_cents('o_totalprice', '0.0800')}) AS billed"),
            F.expr(f"sum({_cents('o_totalprice', '0.0080')}) AS held"),
            F.expr("min(IF(o_orderstatus = 'F', 1, 0)) AS all_paid"),
        )
    )
    by_month = "OVER (PARTITION BY o_custkey ORDER BY month)"
    so_far = "OVER (PARTITION BY o_custkey ORDER BY month ROWS UNBOUNDED PRECEDING)"
    return monthly.selectExpr(
        "o_custkey", "period_end", "billed", "all_paid",
        f"CAST(row_number() {by_month} AS BIGINT) AS app",
        f"sum(billed) {so_far} AS billed_to_date",
        f"sum(held) {so_far} AS held_to_date",
    )


def billing_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _applications(spark, sf_dir).selectExpr(
        _project("o_custkey"),
        "app AS application_number",
        "period_end",
        "CAST(billed AS DOUBLE) AS period_total",
        "CAST(billed_to_date AS DOUBLE) AS cumulative_billed",
        "CAST(held_to_date AS DOUBLE) AS retention_held",
        "IF(all_paid = 1, 'Paid', 'Submitted') AS status",
    )


def billing_line_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        _applications(spark, sf_dir)
        .selectExpr("o_custkey", "app", LINES)
        .selectExpr(
            _project("o_custkey"),
            "CAST(app AS STRING) AS application_number",
            "concat('SOV-', line) AS sov_line_id",
            "CAST(16000 + line * 2000 AS DOUBLE) AS scheduled_value",
            "CAST(least(app * 9 + line, 100) AS DOUBLE) AS pct_complete",
        )
    )


def field_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "documents").selectExpr(
        _project("(doc_id % 100)"),
        "CASE doc_id % 3 WHEN 0 THEN DATE'2024-01-05' WHEN 1 THEN DATE'2024-01-12' "
        "ELSE DATE'2024-01-19' END AS date",
        "source AS author",
        "lang AS note_type",
        "CASE doc_id % 6 WHEN 0 THEN 'Crew delay, area not ready. ' WHEN 1 "
        "THEN 'Owner request, extra work. ' WHEN 2 THEN 'Rework after layout issue. ' "
        "WHEN 3 THEN 'Shortage, lead time. ' ELSE '' END || text AS content",
    )


_MAKERS = {
    make.__name__: make
    for make in (
        contracts, labor_logs, material_deliveries, sov_budget, sov, change_orders, rfis,
        billing_history, billing_line_items, field_notes,
    )
}


class FixtureTables(Mapping):
    """The ten tables by name, each built when first asked for."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self._spark, self._dir = spark, sf_dir
        self._built: dict[str, DataFrame] = {}

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self._built:
            self._built[name] = _MAKERS[name](self._spark, self._dir)
        return self._built[name]

    def __contains__(self, name: object) -> bool:
        return name in _MAKERS

    def __iter__(self) -> Iterator[str]:
        return iter(_MAKERS)

    def __len__(self) -> int:
        return len(_MAKERS)


def load(spark: SparkSession, sf_dir: str) -> FixtureTables:
    return FixtureTables(spark, sf_dir)
