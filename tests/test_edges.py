"""Thresholds, dirty input, missing tables and ties on hand-made rows."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siteledger.functions import numbers, stages, texts
from siteledger.operators import cleaning, documents, evidence, flags, health, recovery, risk
from siteledger.operators import portfolio, summaries
from siteledger.plans.portfolio import Portfolio
from siteledger.rules import DEFAULT_RULES as RULES
from siteledger.sources import fixtures, readers, writers
from siteledger.sources.schemas import OPTIONAL_TABLES, REQUIRED_TABLES, SCHEMAS

D = dt.date


def one(df, expr):
    return [r[0] for r in df.select(expr).collect()]


def test_dirty_numbers(spark):
    texts_in = ["12f", "nan", "1,200", "", " 12 ", "1e3", "-.5", "7.", None]
    df = spark.createDataFrame([(t,) for t in texts_in], "x string")
    assert one(df, numbers.number(df, "x")) == [None] * 4 + [12.0, 1000.0, -0.5, 7.0, None]


def test_dates(spark):
    df = spark.createDataFrame(
        [("2024-01-02",), ("1/2/2024",), ("2024/01/02",), ("bad",), (None,)], "x string")
    day = D(2024, 1, 2)
    assert one(df, stages.parse_date_multi(F.col("x"))) == [day, day, day, None, None]
    assert one(df, numbers.date(df, "x")) == [day, None, None, None, None]


def test_half_even_and_text(spark):
    df = spark.createDataFrame([(2.5,), (1234.5,), (999.0,), (12500.0,), (2_500_000.0,)], "x double")
    assert one(df, texts.dollars(F.col("x"))) == ["$2", "$1,234", "$999", "$12,500", "$2,500,000"]
    assert one(df, texts.short_dollars(F.col("x"))) == ["$2", "$1K", "$999", "$12K", "$2.50M"]


def test_squish_and_truncate(spark):
    df = spark.createDataFrame([("  a \tb\n c ",), ("x" * 200,), ("",)], "x string")
    assert one(df, texts.squish(F.col("x")))[0] == "a b c"
    cut = one(df, texts.truncate(F.col("x"), 140))
    assert cut[1] == "x" * 137 + "..." and cut[2] == ""


@pytest.mark.parametrize("share,stage", [
    (0.1499, "early"), (0.15, "active"), (0.7499, "active"), (0.75, "late"), (0.95, "complete"),
    (None, "unknown")])
def test_stage_limits(spark, share, stage):
    df = spark.createDataFrame([(share,)], "x double")
    assert one(df, stages.stage_or_unknown(F.col("x"), RULES)) == [stage]


def _health(spark, **values):
    base = dict(
        project_id="P", realized_margin_pct=0.2, budget_coverage=1.0, labor_overrun_pct=0.0,
        material_overrun_pct=0.0, original_contract_value=100.0, co_rejected_value=0.0,
        rfi_cost_impact_count=0, rfi_count=0, actual_tracked_cost=1.0, adjusted_contract=2.0)
    base.update(values)
    return spark.createDataFrame([tuple(base.values())], list(base))


@pytest.mark.parametrize("values,fired", [
    ({}, []),
    ({"actual_tracked_cost": 2.0}, []),
    ({"actual_tracked_cost": 2.01}, ["underwater"]),
    ({"material_overrun_pct": 150.0}, []),
    ({"material_overrun_pct": 150.1}, ["material_blowout"]),
    ({"labor_overrun_pct": 50.0}, []),
    ({"labor_overrun_pct": 50.1}, ["labor_overrun"]),
    ({"co_rejected_value": 6.0, "realized_margin_pct": 0.10}, []),
    ({"co_rejected_value": 6.0, "realized_margin_pct": 0.09}, ["rejected_co_exposure"]),
    ({"co_rejected_value": 5.0, "realized_margin_pct": 0.09}, []),
    ({"budget_coverage": 0.88}, []), ({"budget_coverage": 0.87}, ["budget_coverage"]),
    ({"budget_coverage": 1.10}, []), ({"budget_coverage": 1.11}, ["budget_coverage"]),
    ({"labor_overrun_pct": 0.1, "material_overrun_pct": 100.1}, ["compound_overrun"]),
    ({"rfi_cost_impact_count": 25, "rfi_count": 100}, []),
    ({"rfi_cost_impact_count": 26, "rfi_count": 100}, ["rfi_cost_impact_count"]),
    ({"rfi_cost_impact_count": 7, "rfi_count": 20}, []),
    ({"rfi_cost_impact_count": 8, "rfi_count": 20}, ["rfi_cost_impact_rate"]),
])
def test_trigger_limits(spark, values, fired):
    df = _health(spark, **values)
    assert flags.with_triggers(df, RULES).head()["fired_triggers"] == fired
    assert flags.flagged_projects(df, RULES).count() == (1 if fired else 0)


def test_dedup_keeps_first_and_is_idempotent(spark):
    rows = [("L1", D(2024, 1, 2), "P", 2.0), ("L1", D(2024, 1, 1), "P", 9.0),
            ("L1", D(2024, 1, 1), "P", 3.0), (None, D(2024, 1, 1), "P", 1.0)]
    df = spark.createDataFrame(rows * 50, "log_id string, date date, project_id string, h double")
    once = cleaning.dedup_labor(df)
    assert [tuple(r) for r in once.collect()] == [("L1", D(2024, 1, 1), "P", 3.0)]
    assert cleaning.dedup_labor(once).count() == 1


@pytest.mark.parametrize("weeks", [1, 4, 5, 8, 12])
def test_trend_by_weeks(spark, weeks):
    rows = [("P", D(2024, 1, 1) + dt.timedelta(weeks=i), float(i + 1)) for i in range(weeks)]
    df = spark.createDataFrame(rows + [("P", None, 99.0)],
                               "project_id string, week_start date, total_cost double")
    got = health.weekly_cost_trend(df).head()
    costs = [r[2] for r in rows]
    recent = sum(costs[-4:]) / len(costs[-4:])
    earlier = costs[max(0, weeks - 8):max(0, weeks - 4)]
    prior = sum(earlier) / len(earlier) if earlier else recent
    assert got["active_weeks"] == weeks
    assert got["recent_weekly_cost_avg"] == pytest.approx(recent)
    assert got["prior_weekly_cost_avg"] == pytest.approx(prior)
    assert got["burn_rate_acceleration"] == pytest.approx((recent - prior) / prior)


def test_change_order_buckets_differ(spark):
    statuses = ["approved", "EXECUTED", " void", "denied", "", None, "rejected", "pending"]
    df = spark.createDataFrame(
        [("P", s, 1.0) for s in statuses], "project_id string, status string, amount double")
    df = df.selectExpr("*", "0D AS schedule_impact_days", "0D AS labor_hours_impact")
    narrow = summaries.change_summary(df).head()
    assert (narrow["approved_cos"], narrow["pending_cos"], narrow["rejected_cos"]) == (1, 1, 1)
    mid = summaries.co_health_summary(df).head()
    assert (mid["co_approved_count"], mid["co_pending_count"], mid["co_rejected_count"]) == (1, 5, 2)
    wide = evidence.packet_co_summary(df).head()
    assert (wide["approved_count"], wide["pending_count"], wide["rejected_count"]) == (2, 3, 3)


def test_latest_application_prefers_numbers(spark):
    rows = [("P", "2", 10.0, 50.0), ("P", "10", 10.0, 70.0), ("P", "A", 10.0, 99.0),
            ("P", None, 10.0, 1.0), ("P", "10", None, 5.0)]
    df = spark.createDataFrame(
        rows, "project_id string, application_number string, scheduled_value double, "
        "pct_complete double")
    assert evidence.latest_application(df).head()["latest_application"] == "10"
    assert evidence.weighted_pct_complete(df).head()["percent_complete"] == 70.0


def test_notes(spark):
    rows = [("P", D(2024, 1, i + 1), t) for i, t in enumerate(
        ["nothing", "delay and rework", "owner request: " + "y" * 200, "  ", "plate", "access",
         "shortage", "redo"])]
    df = spark.createDataFrame(rows, "project_id string, date date, content string")
    top = evidence.top_field_notes(df, RULES)
    assert top.count() == 6
    assert top.filter("note_rank = 1").head()["content"] == "delay and rework"
    told = evidence.field_notes_summary(top, RULES).head()
    assert told["field_notes_summary"].startswith("delay and rework | ")
    assert len(told["missing_scope_signals"]) == 1
    assert told["missing_scope_signals"][0].endswith("...")


def test_documents(spark):
    good = '{"project_id": "P", "severity": "WATCH"}'
    raw = [f"x ```json\n{good}\n``` y", f"so: {good} ok", good, "{broken", "none", None]
    df = spark.createDataFrame([(str(i), t) for i, t in enumerate(raw)], "project_id string, response string")
    got = documents.parse_documents(df).orderBy("project_id")
    assert [r[0] for r in got.select(F.col("doc").isNotNull()).collect()] == [
        True, True, True, False, False, False]
    rules = {r["rule"] for r in documents.violations(got).collect()}
    assert "missing_headline" in rules and "severity_word" not in rules


def test_risk_ties(spark):
    df = spark.createDataFrame([(10, 10, 0, 0), (0, 0, 0, 0)], list(RISK_COLUMNS))
    got = df.select(risk.main_issue(), risk.risk_explanation()).collect()
    assert got[0][0] == "Underbilling / Financial Loss, Execution Inefficiency"
    assert got[1][0] == "Low Risk / No Clear Driver"
    assert got[0][1].startswith("Project is underbilled")


RISK_COLUMNS = ("billing_score", "margin_score", "change_order_score", "rfi_score")


def test_required_columns_raise(spark):
    with pytest.raises(ValueError):
        risk.require_columns(spark.createDataFrame([(1,)], ["project_id"]), ["billing_gap"])


@pytest.mark.parametrize("absent", OPTIONAL_TABLES)
def test_missing_optional_table(spark, small_dir, absent):
    tables = {k: v for k, v in fixtures.load(spark, small_dir).items() if k != absent}
    p = Portfolio(tables)
    assert p.flagged.count() > 0
    assert p.analysis_w_rfi.count() > 0


def test_csv_round_trip_and_missing(spark, tmp_path):
    rows = [("P", D(2024, 1, 1), "a", "t", 'two\nlines, "quoted"'), ("P", None, "", None, " x ")]
    df = spark.createDataFrame(rows, SCHEMAS["field_notes"])
    writers.write_table(df, str(tmp_path / "field_notes_all.csv"), "csv")
    back = readers.scan_optional(spark, str(tmp_path / "field_notes_all.csv"), "field_notes", True)
    assert sorted(map(tuple, back.collect()), key=str) == sorted(rows, key=str)
    assert readers.scan_optional(spark, str(tmp_path / "no.csv"), "rfis", False).count() == 0
    with pytest.raises(FileNotFoundError):
        readers.scan_optional(spark, str(tmp_path / "no.csv"), "rfis", True)


def test_capacity_and_conservation(spark, small_dir):
    p = Portfolio(fixtures.load(spark, small_dir), share=True)
    plan = p.week_capacity_plan
    used = {r[0]: r[1] for r in plan.filter("is_planned").groupBy("owner").agg(F.sum("hours")).collect()}
    assert used and all(h <= RULES.capacity_hours[o] for o, h in used.items())
    labor = [df.agg(F.sum("total_labor_cost")).head()[0]
             for df in (p.labor_project, p.labor_sov, p.labor_week)]
    assert labor[1] == pytest.approx(labor[0]) and labor[2] == pytest.approx(labor[0])
    scores = p.risk_scores.agg(F.min("risk_score"), F.max("risk_score")).head()
    assert scores[0] >= 0 and scores[1] <= 100


def test_same_result_for_any_partitioning(spark, small_dir):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    seen = []
    try:
        for n in ("1", "7", "60"):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            p = Portfolio(fixtures.load(spark, small_dir))
            seen.append(sorted(map(str, p.health.collect())))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert seen[0] == seen[1] == seen[2]


def test_rules_for_running_projects(spark):
    base = dict(id="P", name="n", contract_value=1_000_000.0, billing_data_available=True,
                billing_gap=0.1, percent_complete=0.6, percent_billed=0.5, retention_held=50_000.0,
                co_pending_value=100.0, co_rejected_value=100.0, labor_overrun=200_000.0,
                material_overrun=25_000.0, labor_actual=1.0, labor_budget=1.0, material_actual=1.0,
                material_budget=1.0, project_stage="active", severity="watch", sector="HVAC")
    df = spark.createDataFrame([tuple(base.values())], list(base))
    got = recovery.action_rows(recovery.recovery_actions(recovery.root_causes(df)))
    rows = {r["id"]: r for r in got.collect()}
    assert set(rows) == {"action-1", "action-2", "action-4"}
    assert rows["action-2"]["owner"] == "Executive"
    assert rows["action-4"]["estimated_recovery_dollars"] == 30_000.0
    assert [rows[k]["priority"] for k in ("action-1", "action-4", "action-2")] == [1, 2, 3]


def test_large_amounts_are_summed(spark):
    from siteledger.functions import numbers, sql

    df = spark.createDataFrame([(1e12,), (1e15,), (3.0,), (1e-6,), (None,)], "x double")
    text = df.selectExpr(f"{sql.exact_sum('x')} AS s").first().s
    column = df.select(numbers.exact_sum(F.col("x")).alias("s")).first().s
    assert text == column == 1e12 + 1e15 + 3.000001


def test_long_hours_have_a_cost(spark):
    from siteledger.functions import sql
    from siteledger.operators import evidence

    row = "12000D AS hours_st, 0D AS hours_ot, 1D AS hourly_rate, 1D AS burden_multiplier"
    df = spark.sql(f"SELECT {row}")
    got = df.selectExpr(f"{sql.LABOR_COST} AS a", f"{evidence.ROW_COST} AS b").first()
    assert float(got.a) == float(got.b) == 12000.0


def test_partial_dates_are_not_dates(spark):
    from siteledger.functions import numbers, sql

    df = spark.createDataFrame([("2024",), ("2024-01",), ("2024-01-05",), (" 2024-01-05 ",)], "d string")
    got = df.select(F.expr(sql.day(df, "d")).alias("a"), numbers.date(df, "d").alias("b")).collect()
    assert [r.a is None for r in got] == [r.b is None for r in got] == [True, True, False, False]


def test_csv_in_two_column_orders_is_an_error(spark, tmp_path):
    (tmp_path / "a.csv").write_text("project_id,hours\nP1,5\n")
    (tmp_path / "b.csv").write_text("hours,project_id\n7,P2\n")
    with pytest.raises(Exception, match="(?i)header"):
        readers.scan_csv(spark, str(tmp_path)).collect()


def test_indented_json_array(spark, tmp_path):
    (tmp_path / "a.json").write_text('[\n  {"x": "1"},\n  {"x": "2"}\n]\n')
    schema = T.StructType([T.StructField("x", T.StringType())])
    got = readers.scan_json_docs(spark, str(tmp_path), schema, whole_files=True).collect()
    assert [r.x for r in got] == ["1", "2"]


def test_json_layout_is_seen_and_corrupt_records_are_told(spark, tmp_path):
    (tmp_path / "a.json").write_text('\n[\n  {"x": "1"},\n  {"x": "2"}\n]\n')
    (tmp_path / "b.json").write_text('{"x": "1"}\n\n[{"x": "2"}, {"x": "3"}]\n')
    (tmp_path / "c.json").write_text('{"x": "1"}\n{"x": \n{"x": "3", "n": "many"}\n{"n": 4}\n')
    schema = spark.createDataFrame([], "x string, n int").schema
    read = lambda name: [r.x for r in readers.scan_json_docs(spark, str(tmp_path / name), schema).collect()]
    assert read("a.json") == ["1", "2"] and read("b.json") == ["1", "2", "3"]
    with pytest.raises(Exception, match="MALFORMED"):
        read("c.json")
    corrupt = readers.corrupt_json(spark, str(tmp_path / "c.json"), schema).collect()
    assert sorted(r.record.strip() for r in corrupt) == ['{"x":', '{"x": "3", "n": "many"}']
    assert all(r.path.endswith("c.json") for r in corrupt)
    assert readers.corrupt_json(spark, str(tmp_path / "a.json"), schema).count() == 0


def test_no_cause_has_its_own_text(spark):
    none = spark.createDataFrame([], "label string")
    text = "Cash recovery work is the most common pattern across flagged projects."
    assert portfolio.top_systemic_issue(none).first().description == text


def test_actions_fall_back_on_the_confidence_of_their_analysis(spark):
    action = "named_struct('action', 'a', 'owner', 'o', 'financial_logic', 'f', 'estimated_recovery_dollars', 1D, 'urgency', 'u', " \
        "'effort', 'low', 'time_to_cash_days', 1L, 'probability_of_success', {}, 'cost_to_execute_hours', 1D, 'expected_value', 1D, " \
        "'recovery_type', 'r', 'linked_root_cause', 'l')"
    briefs = spark.range(3).selectExpr(
        "CAST(id AS STRING) AS id", "'n' AS name", "'g' AS gc_name", "'late' AS project_stage", "0D AS realized_margin", "0D AS percent_billed",
        "0D AS current_margin_dollars", "IF(id = 2, NULL, 0.4D) AS confidence",
        f"array({action.format('IF(id = 0, 0.9D, NULL)')}) AS recovery_actions",
    )
    odds = lambda df: {r.project_id: r.confidence for r in portfolio.all_actions(df).collect()}
    assert odds(briefs) == {"0": 0.9, "1": 0.4, "2": 0.7}
    assert odds(briefs.drop("confidence")) == {"0": 0.9, "1": 0.7, "2": 0.7}


def test_delivery_rollups_shuffle_ids_once(spark):
    rows = [
        ("P1", "L1", dt.date(2024, 1, 2), "D1", "Steel", "V1", 2.0, 3.0, 6.0),
        ("P1", "L1", dt.date(2024, 1, 3), "D1", "Steel", "V2", 1.0, None, 5.0),
        ("P1", "L2", None, "D2", None, "V1", 1.0, 1.0, 1.0),
        ("P1", "L2", None, "D2", "Wood", None, None, 1.0, 1e12),
    ]
    table = spark.createDataFrame(
        rows,
        "project_id string, sov_line_id string, date date, delivery_id string, material_category string, "
        "vendor string, quantity double, unit_cost double, total_cost double",
    )
    got = summaries.material_project_summary(table)
    r = got.first()
    assert (r.num_deliveries, r.num_unique_deliveries, r.num_sov_lines) == (4, 2, 2)
    assert (r.num_material_categories, r.num_vendors, r.total_quantity) == (2, 2, 4.0)
    assert (r.avg_unit_cost, r.total_material_cost) == (5 / 3, 1e12 + 12)
    weeks = {x.week_start: x for x in summaries.material_project_week_summary(table).collect()}
    assert weeks[None].num_unique_deliveries == 1 and weeks[None].num_deliveries == 2
    assert weeks[dt.date(2024, 1, 1)].num_unique_deliveries == 1
    # One shuffle of combined copies, one of the sums per group.
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") <= 3
    costs = summaries.delivery_costs(table)
    assert summaries.material_cost(costs, ["project_id"]).first().total_material_cost == 1e12 + 12
    plan = summaries.material_cost(costs, ["project_id"])._jdf.queryExecution().executedPlan().toString()
    assert "vendor" not in plan.split("Scan")[0] and plan.count("Exchange hashpartitioning") <= 2


def test_labor_quality_counts_what_cleaning_keeps(spark):
    rows = [
        ("a", "P1", dt.date(2024, 1, 2), "Foreman"), ("a", None, dt.date(2024, 1, 1), "x"),
        ("b", None, None, "x"), ("b", "P1", dt.date(2024, 1, 1), None), (None, "P1", None, "x"),
    ]
    wide = spark.createDataFrame(rows, "log_id string, project_id string, date date, role string")
    raw = readers.conform(wide, "labor_logs")
    got = {r.metric: r.value for r in cleaning.labor_quality(raw).collect()}
    assert got["input_rows"] == 5 and got["duplicates_removed"] == 3
    assert got["output_rows"] == cleaning.clean_labor(raw).count() == 1
    none = {r.metric: r.value for r in cleaning.labor_quality(raw.limit(0)).collect()}
    assert set(none.values()) == {0}


def test_manifest_paths_can_be_read(spark, tmp_path):
    nested = spark.range(3).selectExpr(
        "'PRJ-' || id AS project_id", "named_struct('project_name', 'n', 'project_stage', 'late') AS project"
    )
    folder = str(tmp_path / "packets")
    writers.write_packets(nested, folder)
    manifest = writers.packet_manifest(spark.read.parquet(folder)).collect()
    assert len(manifest) == 3
    for r in manifest:
        assert spark.read.parquet(r.packet_path).filter(F.col("project_id") == r.project_id).count() == 1


def _bundle(folder, files):
    folder.mkdir()
    for name, text in files.items():
        (folder / name).write_text(text)


def test_bundles_of_csv_and_json(spark, tmp_path):
    _bundle(tmp_path / "P one", {
        "change_orders.csv": "co_number,amount,note,status\nC1,5,\"two\nlines\",open\nC2,,x,void\n",
        "rfi_log.json": '[\n {"project_id": "PRJ-1", "rfi_number": "R1"},\n {"rfi_number": "R2"}]',
        "labor.csv": "hours_st,log_id\n8,L1\n",
    })
    _bundle(tmp_path / "PRJ-2", {
        "CO-log.CSV": "status,amount,co_number\nopen,1e3,C3\n",
        "change_orders.json": '{"version": "1", "rows": [{"co_number": "C4", "amount": 7}]}',
        "my_contract.csv": "project_name,original_contract_value\nHall,100\n",
        "labor.csv": "log_id,hours_st,project_id\nL2,9,\n",
        "read.me": "x",
    })
    tables = readers.load_bundles(spark, str(tmp_path))
    assert set(tables) == set(SCHEMAS)
    for name, df in tables.items():
        assert [(f.name, f.dataType) for f in df.schema] == [(f.name, f.dataType) for f in SCHEMAS[name]]
    rows = lambda name, *cols: sorted(map(tuple, tables[name].select(*cols).collect()), key=str)
    # The later of two files for one table counts.
    assert rows("change_orders", "project_id", "co_number", "amount", "status") == [
        ("PRJ-1", "C1", 5.0, "open"), ("PRJ-1", "C2", None, "void"), ("PRJ-2", "C4", 7.0, None)]
    assert rows("rfis", "project_id", "rfi_number") == [("PRJ-1", "R1"), ("PRJ-1", "R2")]
    assert rows("labor_logs", "project_id", "log_id", "hours_st") == [("PRJ-1", "L1", 8.0), ("PRJ-2", "L2", 9.0)]
    assert rows("contracts", "project_id", "original_contract_value") == [("PRJ-2", 100.0)]
    assert tables["field_notes"].count() == 0
    again = readers.load_bundles(spark, str(tmp_path), one_line=("labor_logs",))["labor_logs"]
    assert again.count() == 2


def test_bundle_csv_with_too_many_columns_is_an_error(spark, tmp_path):
    wide = ",".join(f"x{i}" for i in range(readers.WIDEST + 1))
    _bundle(tmp_path / "P", {"rfis.csv": f"{wide}\n{wide.replace('x', 'y')}\n"})
    with pytest.raises(Exception, match="more than 64 columns"):
        readers.bundle_records(spark, str(tmp_path), "rfis").collect()


def test_csv_folder_passes_on_one_line(spark, tmp_path):
    for name in REQUIRED_TABLES:
        (tmp_path / f"{name}_all.csv").write_text("project_id\nP1\n")
    tables = readers.load_csv_folder(spark, str(tmp_path), one_line=("labor_logs",))
    assert tables["labor_logs"].count() == tables["contracts"].count() == 1


def test_amounts_out_of_range_are_an_error(spark):
    from siteledger.functions import sql

    df = spark.sql("SELECT 1e22D AS x, 1e6D AS hours_st, 0D AS hours_ot, 1D AS hourly_rate, 1D AS burden_multiplier")
    for text in (sql.exact_sum("x"), sql.exact_mean("x"), f"SUM({sql.LABOR_COST})", f"SUM({evidence.ROW_COST})"):
        with pytest.raises(Exception, match="NUMERIC_VALUE_OUT_OF_RANGE"):
            df.selectExpr(f"{text} AS s").collect()
