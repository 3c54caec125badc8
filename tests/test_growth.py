"""What must not grow with the tables: broadcasts, rows of one writing task, work repeated for each field."""

from __future__ import annotations

import glob
import json
import time

import pytest
from pyspark.sql import functions as F

from siteledger.llm import components
from siteledger.operators import causes, cleaning, documents, evidence, ordering, packets, summaries, variance
from siteledger.plans import portfolio
from siteledger.plans.registry import QUERIES
from siteledger.rules import DEFAULT_RULES
from siteledger.sources import fixtures
from siteledger.sources.readers import empty_table
from siteledger.sources.schemas import SCHEMAS
from siteledger.streaming import store
from siteledger.streaming.store import KeyedTable

LINE = "project_id string, sov_line_id string"


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def lines(spark, *extra):
    """Eight lines a project; Spark takes them for the few bytes of the range."""
    return spark.range(3).selectExpr("id", "explode(sequence(0, 7)) AS line").selectExpr(
        "'P' || id AS project_id", "'S' || line AS sov_line_id", *extra
    )


def labor(spark, budget):
    spent = lines(
        spark, "CAST(line AS DOUBLE) AS total_labor_cost", "1D AS total_hours_st", "0D AS total_hours_ot",
        "1D AS total_effective_hours", "1D AS avg_hourly_rate", "1D AS avg_burden_multiplier",
        "0D AS ot_share_of_raw_hours", "DATE'2024-01-01' AS first_date", "DATE'2024-01-01' AS last_date",
    )
    return variance.labor_vs_budget(spent, budget)


def material(spark, budget):
    return variance.material_vs_budget(lines(spark, "CAST(line AS DOUBLE) AS total_material_cost"), budget)


def full(spark, budget):
    names = lines(spark, "line AS line_number", "CAST(NULL AS STRING) AS description")
    return evidence.sov_full_variance(
        empty_table(spark, "labor_logs"), empty_table(spark, "material_deliveries").withColumn("total_cost", F.lit(0.0)),
        budget, names,
    )


@pytest.mark.parametrize("make", [labor, material, full])
def test_cost_lines_are_never_broadcast(spark, make):
    amounts = ("labor_hours", "labor_cost", "material_cost", "equipment_cost", "sub_cost")
    budget = lines(
        spark, *(f"5D AS estimated_{a}" for a in amounts), "1D AS productivity_factor", "'k' AS key_assumptions"
    )
    joined = make(spark, budget)
    assert "Broadcast" not in plan_of(joined)
    assert joined.count() == 24


def test_projects_are_never_broadcast(spark):
    health = spark.createDataFrame(
        [("P1", "a", "g", *[1.0] * 12), ("P2", "b", "g", *[2.0] * 12)],
        "project_id string, project_name string, gc_name string, original_contract_value double, adjusted_contract double, "
        "total_budget double, actual_tracked_cost double, cumulative_billed double, realized_margin_pct double, "
        "pending_co_pct double, max_open_rfi_age double, overtime_spike double, burn_rate_acceleration double, "
        "crew_size_spike double, forecast_to_complete_trend double",
    )
    side = lambda *columns: spark.range(1, 2).selectExpr("'P' || id AS project_id", *columns)
    joined = causes.management_join(
        health, side("1L AS risk_score", "'LOW' AS risk_level", "'x' AS main_issue"),
        side("1D AS approved_value", "1D AS rejected_value"), side("1L AS total_rfis"),
        side("1D AS labor_burn_ratio", "1D AS labor_avg_pct_overrun"),
        side("1D AS material_burn_ratio", "1D AS material_avg_pct_overrun"), side("array('t') AS fired_triggers"),
    )
    assert "Broadcast" not in plan_of(joined)
    assert {r.project_id: r.risk_score for r in joined.collect()} == {"P1": 1, "P2": None}


def test_summaries_by_project_are_never_broadcast(spark):
    side = lambda *columns: spark.range(1, 3).selectExpr("'P' || id AS project_id", *columns)
    billing = variance.project_billing_analysis(side("4D AS total_cost"), side("5D AS total_billed"))
    changes = side("2D AS total_co_value", "1D AS rejected_value", "2L AS total_change_orders", "1L AS rejected_cos")
    rfi = summaries.rfi_summary(side("3L AS total_rfis"), side("1L AS rfis_linked_to_cos"), DEFAULT_RULES)
    joined = variance.project_analysis_w_rfi(variance.project_full_analysis(billing, changes), rfi)
    assert "Broadcast" not in plan_of(joined)
    assert [(r.project_id, r.billing_gap, r.rejected_value_ratio, r.total_rfis) for r in joined.orderBy("project_id").collect()] == [
        ("P1", 1.0, 0.5, 3), ("P2", 1.0, 0.5, 3)
    ]


def test_parts_of_packets_are_never_broadcast(spark):
    side = lambda *columns: spark.range(1, 3).selectExpr("'P' || id AS project_id", *columns)
    amounts = ("realized_margin_pct", "cost_vs_budget", "labor_burn_ratio", "labor_avg_pct_overrun",
               "material_avg_pct_overrun", "billing_gap_pct", "approved_co_pct", "rejected_co_pct", "overtime_spike",
               "burn_rate_acceleration", "crew_size_spike")
    texts = ("project_name", "gc_name", "risk_level", "severity", "main_issue", "management_cause", "evidence", "recommended_action")
    management = side("9L AS total_rfis", *[f"1D AS {a}" for a in amounts], *[f"'x' AS {t}" for t in texts])
    states = ("approved", "pending", "rejected")
    totals = side(*[f"1L AS {s}_count" for s in states], *[f"2D AS {s}_value" for s in states])
    joined = packets.hybrid_packet(management, totals, side("3L AS total_rfis"), side("'n' AS content"))
    assert "Broadcast" not in plan_of(joined)
    assert [(r.approved_value, r.rfi_count, r.field_notes_count) for r in joined.collect()] == [(2.0, 3, 1)] * 2


def test_a_hybrid_packet_has_all_orders_rfis_and_notes(spark):
    """In parts of two, each field of each item, in order, whatever the partitions; a project without items has one part."""
    orders = [("P1", f"C{i}", "d", 5.0 + i, "Approved", None) for i in (2, 0, 4, 1, 3)] + [("P2", "C1", None, None, None, None)] * 2
    rfis = [("P1", "R2", "s", "Open", "High", "Yes"), ("P1", "R1", None, None, None, None), (None, "R9", "s", "Open", "High", "No")]
    notes = [("P1", "2024-01-02", "a", "daily", "old"), ("P1", "2024-01-03", "a", "daily", "new"), ("P1", None, None, None, "none"),
             ("P9", "2024-01-01", "a", "daily", "of no project")]
    tables = [
        spark.createDataFrame(rows, "project_id string, " + kinds).repartition(3)
        for rows, kinds in (
            (orders, "co_number string, description string, amount double, status string, reason_category string"),
            (rfis, "rfi_number string, subject string, status string, priority string, cost_impact string"),
            (notes, "date string, author string, note_type string, content string"),
        )
    ]
    numbers = ("realized_margin_pct", "cost_vs_budget", "labor_burn_ratio", "labor_avg_pct_overrun", "material_avg_pct_overrun",
               "billing_gap_pct", "approved_co_pct", "rejected_co_pct", "pending_co_pct", "overtime_spike", "burn_rate_acceleration",
               "crew_size_spike", "forecast_to_complete_trend", "max_open_rfi_age", "trigger_score")
    texts = ("project_name", "gc_name", "risk_level", "severity", "alert_class", "primary_trigger", "supporting_triggers",
             "fired_triggers", "why_now", "main_issue", "management_cause", "evidence", "recommended_action")
    management = spark.range(1, 4).selectExpr(
        "'P' || id AS project_id", "9L AS total_rfis", *[f"1D AS {n}" for n in numbers], *[f"'x' AS {t}" for t in texts]
    )
    items, rfi_counts = packets.packet_items(*tables), summaries.rfi_counts(tables[1])
    made = packets.hybrid_packet(management, packets.co_totals_by_status(tables[0]), rfi_counts, tables[2], items, 2)
    assert "Broadcast" not in plan_of(made)
    rows = made.orderBy("project_id", "part").collect()
    assert [(r.project_id, r.part) for r in rows] == [("P1", 1), ("P1", 2), ("P1", 3), ("P2", 1), ("P3", 1)]
    assert all((r.fired_triggers, r.pending_co_pct, r.max_open_rfi_age, r.forecast_to_complete_trend) == ("x", 1, 1, 1) for r in rows)
    assert [(r.approved_count, r.approved_value, r.rfi_count, r.field_notes_count) for r in rows[:3]] == [(5, 35.0, 2, 3)] * 3
    plain = lambda r: {s: [tuple(x) for x in r[s]] for s in packets.DETAILS}
    co = lambda i: (f"C{i}", "d", 5.0 + i, "Approved", None)
    assert [plain(r) for r in rows] == [
        {"change_orders": [co(0), co(1)], "rfis": [("R1", None, None, None, None), ("R2", "s", "Open", "High", "Yes")],
         "field_notes": [("2024-01-03", "a", "daily", "new"), ("2024-01-02", "a", "daily", "old")]},
        {"change_orders": [co(2), co(3)], "rfis": [], "field_notes": [(None, None, None, "none")]},
        {"change_orders": [co(4)], "rfis": [], "field_notes": []},
        {"change_orders": [("C1", None, None, None, None)] * 2, "rfis": [], "field_notes": []},
        {"change_orders": [], "rfis": [], "field_notes": []},
    ]


def test_the_hybrid_query_gives_every_row_of_its_projects(spark, tmp_path):
    for name, sql in STAR.items():
        spark.sql(sql).write.parquet(str(tmp_path / f"{name}.parquet"))
    rows = QUERIES["hybrid_packet"].build(spark, str(tmp_path)).collect()
    found = {s: sorted(x[k] for r in rows for x in json.loads(r[s])) for s, k in
             {"change_orders": "co_number", "rfis": "rfi_number", "field_notes": "content"}.items()}
    assert found["change_orders"] == sorted(f"CO-{i}" for i in range(12))
    assert found["rfis"] == sorted(f"RFI-{i}" for i in range(9))
    assert len(found["field_notes"]) == 3 and all(t.endswith("Rework") for t in found["field_notes"])


def test_orders_are_never_broadcast(spark, tmp_path):
    spark.sql(
        "SELECT id AS o_orderkey, id % 2 AS o_custkey FROM range(4)"
    ).write.parquet(str(tmp_path / "orders.parquet"))
    spark.sql(
        "SELECT id AS l_orderkey, 1L AS l_partkey, 2L AS l_suppkey, 1 AS l_linenumber, 3D AS l_quantity, 1D AS l_extendedprice, "
        "0D AS l_discount, 0.02D AS l_tax, 'N' AS l_returnflag, 'O' AS l_linestatus, "
        "TIMESTAMP_NTZ'2024-01-01 00:00:00' AS l_shipdate FROM range(3)"
    ).write.parquet(str(tmp_path / "lineitem.parquet"))
    logs = fixtures.labor_logs(spark, str(tmp_path))
    assert "Broadcast" not in plan_of(logs)
    assert sorted((r.project_id, r.log_id) for r in logs.collect()) == [("PRJ-0", "L-0-1"), ("PRJ-0", "L-2-1"), ("PRJ-1", "L-1-1")]


STAR = {
    "nation": "SELECT 0 AS n_nationkey, 'N' AS n_name, 0 AS n_regionkey",
    "customer": "SELECT id AS c_custkey, 'c' AS c_name, 0 AS c_nationkey, 1D AS c_acctbal, 'BUILDING' AS c_mktsegment FROM range(3)",
    "orders": "SELECT id AS o_orderkey, id % 3 AS o_custkey, 'F' AS o_orderstatus, 900D AS o_totalprice, "
    "TIMESTAMP_NTZ'2024-01-02 00:00:00' AS o_orderdate, '2-HIGH' AS o_orderpriority FROM range(12)",
    "lineitem": "SELECT id % 12 AS l_orderkey, id AS l_partkey, id AS l_suppkey, CAST(id DIV 12 + 1 AS INT) AS l_linenumber, "
    "8D AS l_quantity, 1D AS l_extendedprice, 0D AS l_discount, 0.02D AS l_tax, 'N' AS l_returnflag, 'O' AS l_linestatus, "
    "TIMESTAMP_NTZ'2024-01-03 00:00:00' AS l_shipdate FROM range(60)",
    "events": "SELECT id AS event_id, TIMESTAMP_NTZ'2024-01-04 00:00:00' AS ts, id % 3 AS user_id, 'error' AS event_type, "
    "1D AS value, '{}' AS props FROM range(9)",
    "documents": "SELECT id AS doc_id, 'Rework' AS text, 'en' AS lang, 'src0' AS source, 6L AS n_chars FROM range(6)",
}


@pytest.mark.parametrize("key", ["project_cost_summary", "hybrid_packet", "sort_01"])
def test_whole_queries_broadcast_nations_alone(spark, tmp_path, monkeypatch, key):
    """Whatever the threshold: frozen stages and the last plan join all but the nations by merging."""
    for name, sql in STAR.items():
        spark.sql(sql).write.parquet(str(tmp_path / f"{name}.parquet"))
    plans = []
    for module in (portfolio, ordering):
        monkeypatch.setattr(module, "freeze", lambda df, f=module.freeze: plans.append(plan_of(df)) or f(df))
    was = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "1g")
    try:
        made = QUERIES[key].build(spark, str(tmp_path))
        plans.append(plan_of(made))
        rows = made.count()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", was)
    joins = [line for plan in plans for line in plan.splitlines() if "Broadcast" in line and "Join" in line]
    assert [line for line in joins if "c_nationkey" not in line] == []
    assert any("SortMergeJoin" in plan for plan in plans) and rows == 3


def test_packets_read_the_deliveries_once(spark, monkeypatch):
    shared = []
    monkeypatch.setattr(portfolio, "freeze", lambda df: shared.append(df) or df)
    p = portfolio.Portfolio({name: empty_table(spark, name) for name in SCHEMAS}, share=True)
    packets.nested_packet(p.packet, p.row_counts)
    assert sum("material_category" in df.columns for df in shared) == 1


def test_frozen_stages_leave_no_shuffle_files(spark, tmp_path, monkeypatch):
    disk = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    monkeypatch.setattr(ordering, "scratch_path", lambda _, label: str(tmp_path / label))

    def shuffled():
        files = disk.getAllFiles()
        return {n for n in (files.apply(i).getName() for i in range(files.size())) if n.startswith("shuffle_")}

    was = spark.conf.get(ordering.CLEANUP)
    before = shuffled()
    frozen = ordering.freeze(spark.range(1000).selectExpr("id % 7 AS k").groupBy("k").count())
    until = time.time() + 20
    while (left := shuffled() - before) and time.time() < until:
        time.sleep(0.2)
    assert left == set()
    assert spark.conf.get(ordering.CLEANUP) == was
    assert {(r.k, r["count"]) for r in frozen.collect()} == {(k, 143 if k < 6 else 142) for k in range(7)}


def test_management_shares_narrow_stages(spark, monkeypatch):
    """Logs, cube and cost lines are written once, each with the columns that its readers need; so is the analysis."""
    shared = []
    monkeypatch.setattr(portfolio, "freeze", lambda df: shared.append(df.columns) or df)
    p = portfolio.Portfolio({name: empty_table(spark, name) for name in SCHEMAS}, share=True)
    assert p.management_metrics.count() == 0
    assert [c for c in shared if "employee_id" in c] == [
        ["project_id", "date", "employee_id", "role", "sov_line_id", "hours_st", "hours_ot", "hourly_rate", "burden_multiplier"],
        ["project_id", "sov_line_id", "week_start", "employee_id", "st", "ot", "cost"],
    ]
    assert sum("rejected_value_ratio" in c for c in shared) == 1
    assert sum("labor_variance" in c for c in shared) == sum("material_variance" in c for c in shared) == 1


def test_unread_columns_at_the_end_choose_no_log(spark):
    rows = [("L1", "2024-01-02", 5.0, "b", "A-1"), ("L1", "2024-01-02", 4.0, "c", "A-2"), ("L1", "2024-01-02", 4.0, "a", "A-3"),
            ("L2", None, None, None, None), ("L2", None, 1.0, "z", None)]
    logs = spark.createDataFrame(rows, "log_id string, date string, hours_st double, cost_code string, work_area string")
    short = cleaning.without_last(logs, ("work_area", "cost_code"))
    assert short.columns == ["log_id", "date", "hours_st"]
    assert cleaning.without_last(logs, ("cost_code",)).columns == logs.columns
    kept = lambda df: sorted((r.log_id, r.hours_st) for r in cleaning.dedup_labor(df).collect())
    assert kept(short) == kept(logs) == [("L1", 4.0), ("L2", 1.0)]


def test_stars_need_no_further_round(spark, monkeypatch):
    made = []
    monkeypatch.setattr(components, "staged", lambda df, label, f=components.staged: made.append(label) or f(df, label))
    star = spark.createDataFrame([(n, 1) for n in range(2, 9)] + [(11, 10)], "u long, v long").repartition(3)
    assert {(r.node, r.root) for r in components.components(star).collect()} == {
        *((n, 1) for n in range(1, 9)), (10, 10), (11, 10)
    }
    assert len(made) == 1
    chain = spark.createDataFrame([(n + 1, n) for n in range(40)], "u long, v long").repartition(7)
    assert {(r.node, r.root) for r in components.components(chain).collect()} == {(n, 0) for n in range(41)}


def test_a_document_is_searched_and_parsed_once(spark):
    texts = [
        ("a", 'x {"no": 1}\n```json\n{"headline":\n"one", "confidence": 0.5}\n``` {'),
        ("b", 'say\n{"headline":\n"two"} done'),
        ("c", "none"), ("d", None), ("e", '{"headline": "cut'),
    ]
    responses = spark.createDataFrame(texts, "project_id string, response string").repartition(1)
    parsed = documents.parse_documents(responses)
    used = parsed.select("project_id", "doc.headline", "doc.confidence", F.col("doc").isNotNull().alias("readable"))
    plan = used._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("from_json(") == 1
    assert plan.count("regexp_extract(") <= 3
    assert parsed.columns == ["project_id", "response", "doc"]
    got = {r.project_id: (r.headline, r.confidence, r.readable) for r in used.collect()}
    assert got == {"a": ("one", 0.5, True), "b": ("two", None, True), **dict.fromkeys("cde", (None, None, False))}


def test_a_bucket_is_written_by_several_tasks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(store, "TASK_ROWS", 500, raising=False)
    schema = spark.createDataFrame([], "k long, v long").schema
    table = KeyedTable(spark, str(tmp_path / "t"), schema, ["k"], [F.col("v").asc()], 2)
    table.merge(spark.range(4000).selectExpr("id AS k", "id AS v"), 0)
    table.merge(spark.range(2000).selectExpr("id * 4 AS k", "-1L AS v"), 1)
    first = glob.glob(str(tmp_path / "t/data/*0-*/_bucket=*/*.parquet"))
    sizes = [spark.read.parquet(f).count() for f in first]
    assert sum(sizes) == 4000
    assert len(sizes) == 8 and max(sizes) < 700
    rows = {r.k: r.v for r in table.read().collect()}
    assert len(rows) == 5000 and table.read().count() == 5000
    assert all(rows[k] == (-1 if k % 4 == 0 else k) for k in rows)
