"""Portfolio optimisation documents: written from the plan, and read back as views, insights and a brief.

A document is JSON that a model may have written, so nothing in it is taken for granted: sections are read as
VARIANT, each number is parsed on its own, and an absent or odd field gets its default. Documents are rows
(`doc_id`, `document`); their lists are exploded in place, so any number of documents and any length of list are
ordinary rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siteledger.functions.numbers import NUMBER_PATTERN
from siteledger.functions.variants import leaf_amount, leaf_text
from siteledger.operators.portfolio import WORTH
from siteledger.rules import WEEK_DAYS, Rules

#: Entries of a section that the writer puts in; the reader has no limit.
LISTED = 50


def _listed(rows: DataFrame, order: list, fields: list[str], n: int, name: str) -> DataFrame:
    """One row: the first n rows as an array of structs. A report of fixed length, never a whole table."""
    best = rows.orderBy(*order).limit(n).withColumn("_place", F.row_number().over(W.orderBy(*order)))
    names = [f.rpartition(" AS ")[2] for f in fields]
    best = best.selectExpr("_place AS place", *fields).selectExpr("place", f"struct({', '.join(names)}) AS a")
    return best.agg(F.expr(f"transform(array_sort(collect_list(struct(place, a))), x -> x.a) AS {name}"))


def optimization_document(
    actions: DataFrame, brief: DataFrame, cash: DataFrame, bundles: DataFrame, systemic: DataFrame, low: DataFrame,
    rules: Rules, doc_id: str = "portfolio",
) -> DataFrame:
    """doc_id, document: the best actions, the week, cash, and what concerns the portfolio as a whole."""
    ranked = actions.withColumn("_worth", F.expr(WORTH)).orderBy(F.desc("_worth"), "action_id").limit(rules.top_actions)
    # At most `top_actions` rows from here on.
    ranked = ranked.withColumn("action_rank", F.row_number().over(W.orderBy(F.desc("_worth"), "action_id")).cast("long"))
    # A model names the project only now and then, and leaves expected values to the reader.
    kept = _listed(
        ranked, ["action_rank"],
        [
            "action_rank", "action_id", "project_id", "IF(action_rank % 2 = 1, project_name, NULL) AS project_name", "action",
            "IF(action_rank % 5 = 0, NULL, owner) AS owner", "IF(action_rank % 7 = 0, NULL, urgency) AS urgency", "effort",
            "estimated_recovery_dollars", "IF(action_rank % 3 = 0, NULL, expected_value) AS expected_value",
            "IF(action_rank % 4 = 0, NULL, confidence) AS confidence", "time_to_cash_days", "cost_to_execute_hours",
        ],
        rules.top_actions, "prioritized_actions",
    )
    urgent = ranked.filter("urgency IN ('immediate', 'this_week')")
    days = ", ".join(f"'{d}'" for d in WEEK_DAYS)
    week = urgent.withColumn("n", F.row_number().over(W.orderBy("action_rank")))
    plan = _listed(
        week, ["action_rank"],
        [
            "action_rank AS priority", f"element_at(array({days}), (n - 1) % {len(WEEK_DAYS)} + 1) AS day", "project_id",
            "action AS action_summary", "owner", "CAST(cost_to_execute_hours AS STRING) AS hours_required",
            "expected_value AS expected_recovery",
        ],
        len(WEEK_DAYS), "actions",
    )
    hours = urgent.groupBy("owner").agg(F.sum("cost_to_execute_hours").alias("h"))
    hours = hours.agg(F.expr("map_from_entries(array_sort(collect_list(struct(owner, h)))) AS total_hours_by_owner"))
    buckets = cash.agg(F.expr("map_from_entries(array_sort(collect_list(struct(bucket, expected_recovery)))) AS b"))
    low_first = [F.desc("theoretical_recovery"), F.asc("project_id")]
    sections = {
        "gc_negotiation_bundles": _listed(
            bundles, [F.desc("bundle_value"), F.asc("gc_name")], ["gc_name", "project_count", "bundle_value"], LISTED, "s"
        ),
        "systemic_issues": _listed(systemic, [F.desc("cause_count"), F.asc("label")], ["label", "cause_count"], LISTED, "s"),
        "deprioritized_projects": _listed(
            low, low_first, ["project_id", "project_name", "reason", "theoretical_recovery", "recommended_action"], LISTED, "s"
        ),
    }
    insights = systemic.agg(F.max_by("label", F.struct(F.col("cause_count"), F.col("label"))).alias("label"))
    insights = insights.selectExpr(
        "array(named_struct('insight_type', 'systemic', 'title', 'Most common cause', 'description', label)) AS s"
    )
    summary = brief.selectExpr(
        "named_struct('key_insight_1', 'Recover the best actions first.', 'key_insight_2', CAST(NULL AS STRING), "
        "'key_insight_3', 'Bundle what one contractor owes.', 'total_achievable_recovery', achievable_recovery, "
        "'total_theoretical_recovery', CAST(CAST(theoretical_recovery AS DECIMAL(28,2)) AS STRING)) AS s"
    )
    week_plan = plan.withColumn("total_hours_by_owner", hours.scalar()).selectExpr(
        "struct(actions, total_hours_by_owner, array('Finance is short of hours.') AS resource_warnings) AS s"
    )
    whole = kept.withColumns(
        {
            "executive_summary": summary.scalar(),
            "this_week_plan": week_plan.scalar(),
            "cash_flow_projection": buckets.scalar(),
            "strategic_insights": insights.scalar(),
            **{name: rows.scalar() for name, rows in sections.items()},
        }
    )
    return whole.select(F.lit(doc_id).alias("doc_id"), F.to_json(F.struct("*")).alias("document"))


# ---- reading -------------------------------------------------------------------------


def _opened(docs: DataFrame) -> DataFrame:
    return docs.selectExpr("doc_id", "try_parse_json(document) AS d")


def _text(path: str, of: str = "d") -> str:
    """A field (or the value itself) as text; absent and null are NULL."""
    return f"try_variant_get({of}, '${'.' * bool(path)}{path}', 'string')"


def _number(path: str, of: str = "d") -> str:
    """A field as a number, also one written as text; NULL where it is none."""
    x = _text(path, of)
    return f"CASE WHEN {x} RLIKE r'{NUMBER_PATTERN}' THEN try_cast(trim({x}) AS DOUBLE) END"


def _items(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, pos (from 0) and item of a list of any length."""
    return _opened(docs).selectExpr("doc_id", f"posexplode(try_cast(variant_get(d, '$.{path}') AS ARRAY<VARIANT>)) AS (pos, item)")


def _entries(docs: DataFrame, path: str) -> DataFrame:
    found = _opened(docs).selectExpr(
        "doc_id", f"explode(map_entries(try_cast(variant_get(d, '$.{path}') AS MAP<STRING, VARIANT>))) AS e"
    )
    return found.selectExpr("doc_id", "e.key AS key", f"{_number('', 'e.value')} AS amount")


def prioritized_actions(docs: DataFrame, n: int = 20) -> DataFrame:
    """The first n actions of each document as they stand."""
    return _items(docs, "prioritized_actions").filter(F.col("pos") < n).selectExpr(
        "doc_id", "CAST(pos + 1 AS BIGINT) AS place", f"{_text('project_id', 'item')} AS project_id",
        f"{_text('action', 'item')} AS action", f"{_text('owner', 'item')} AS owner",
        f"{_number('expected_value', 'item')} AS expected_value",
    )


def this_week(docs: DataFrame) -> DataFrame:
    return _items(docs, "this_week_plan.actions").selectExpr(
        "doc_id", "CAST(pos + 1 AS BIGINT) AS place", f"{_text('day', 'item')} AS day",
        f"{_text('project_id', 'item')} AS project_id", f"{_text('action_summary', 'item')} AS action_summary",
        f"{_text('owner', 'item')} AS owner", f"COALESCE({_number('hours_required', 'item')}, 0D) AS hours_required",
        f"COALESCE({_number('expected_recovery', 'item')}, 0D) AS expected_recovery",
    )


def cash_projection(docs: DataFrame) -> DataFrame:
    return _entries(docs, "cash_flow_projection").withColumnsRenamed({"key": "bucket", "amount": "expected_recovery"})


def optimization_views(docs: DataFrame, n: int = 20) -> DataFrame:
    """The first n actions, the week and the cash projection as rows (doc_id, view, place, item, detail, amount)."""
    actions = prioritized_actions(docs, n).selectExpr(
        "doc_id", "'actions' AS view", "place", "project_id AS item", "action AS detail", "expected_value AS amount"
    )
    week = this_week(docs).selectExpr(
        "doc_id", "'this_week' AS view", "place", "day AS item", "owner AS detail", "hours_required AS amount"
    )
    cash = cash_projection(docs).selectExpr(
        "doc_id", "'cash_flow' AS view", "CAST(NULL AS BIGINT) AS place", "bucket AS item",
        "CAST(NULL AS STRING) AS detail", "expected_recovery AS amount",
    )
    return actions.unionByName(week).unionByName(cash)


#: Sections of the insight view: one record, then lists of records of unlike shape.
INSIGHTS = ("strategic_insights", "gc_negotiation_bundles", "systemic_issues", "deprioritized_projects")


def insight_views(docs: DataFrame) -> DataFrame:
    """Every field of the insight sections as a row: doc_id, section, place, field, text, amount.

    place numbers the records of a list from 1 and is NULL for the summary. A field that is a number has an amount,
    all others their text; nested values are JSON text.
    """
    fields = (
        "doc_id", "section", "place", "e.key AS field", f"{leaf_text('e.value')} AS text", f"{leaf_amount('e.value')} AS amount",
    )
    summary = _opened(docs).selectExpr("doc_id", "'executive_summary' AS section", "CAST(NULL AS BIGINT) AS place", "variant_get(d, '$.executive_summary') AS item")
    for section in INSIGHTS:
        items = _items(docs, section).selectExpr("doc_id", f"'{section}' AS section", "CAST(pos + 1 AS BIGINT) AS place", "item")
        summary = summary.unionByName(items)
    records = summary.selectExpr("doc_id", "section", "place", "explode(map_entries(try_cast(item AS MAP<STRING, VARIANT>))) AS e")
    return records.filter("NOT is_variant_null(e.value)").selectExpr(*fields)


def brief_actions(docs: DataFrame, projects: DataFrame, n: int = 8) -> DataFrame:
    """The first n actions of each document with the defaults of an action, names from the project table.

    projects: project_id, project_name.
    """
    amount = f"COALESCE({_number('estimated_recovery_dollars', 'item')}, {_number('amount', 'item')}, 0D)"
    odds = f"COALESCE({_number('probability_of_success', 'item')}, {_number('confidence', 'item')}, 0.7D)"
    priority = f"CAST(COALESCE({_number('priority', 'item')}, pos + 1) AS BIGINT)"
    found = _items(docs, "prioritized_actions").filter(F.col("pos") < n).selectExpr(
        "doc_id", "CAST(pos + 1 AS BIGINT) AS place",
        f"COALESCE(NULLIF({_text('action_id', 'item')}, ''), NULLIF({_text('id', 'item')}, ''), 'action-' || {priority}) AS id",
        f"{priority} AS priority", f"{_text('project_id', 'item')} AS project_id",
        f"NULLIF({_text('project_name', 'item')}, '') AS named",
        f"trim(COALESCE(NULLIF({_text('action', 'item')}, ''), {_text('description', 'item')}, '')) AS action",
        f"COALESCE({_text('owner', 'item')}, 'Project Manager') AS owner",
        f"COALESCE({_text('urgency', 'item')}, 'this_month') AS urgency", f"{_text('effort', 'item')} AS effort",
        f"{amount} AS estimated_recovery_dollars", f"{odds} AS probability_of_success",
        f"COALESCE({_number('expected_value', 'item')}, {amount} * {odds}) AS expected_value",
        f"CAST({_number('time_to_cash_days', 'item')} AS BIGINT) AS time_to_cash_days",
        f"{_number('cost_to_execute_hours', 'item')} AS cost_to_execute_hours",
    )
    names = projects.select("project_id", F.col("project_name").alias("known"))
    return found.join(names, "project_id", "left").withColumn("project_name", F.coalesce("named", "known")).drop("named", "known")


def attention(docs: DataFrame, projects: DataFrame, n: int = 5, among: int = 8) -> DataFrame:
    """The first n known projects of each document's first actions: doc_id, place, and the project's columns."""
    listed = _items(docs, "prioritized_actions").filter(F.col("pos") < among)
    listed = listed.selectExpr("doc_id", "pos", f"NULLIF({_text('project_id', 'item')}, '') AS project_id")
    first = listed.filter("project_id IS NOT NULL").groupBy("doc_id", "project_id").agg(F.min("pos").alias("pos"))
    known = first.join(projects, "project_id")
    place = F.row_number().over(W.partitionBy("doc_id").orderBy("pos"))
    return known.withColumn("place", place.cast("long")).filter(F.col("place") <= n).drop("pos")


def owner_plan(docs: DataFrame) -> DataFrame:
    """Hours by owner, most first; owners without hours are left out."""
    hours = _entries(docs, "this_week_plan.total_hours_by_owner").filter("amount > 0")
    place = F.row_number().over(W.partitionBy("doc_id").orderBy(F.desc("amount"), "key"))
    return hours.select("doc_id", place.cast("long").alias("place"), F.col("key").alias("owner"), F.col("amount").alias("hours"))


def brief(docs: DataFrame, projects: DataFrame) -> DataFrame:
    """The portfolio brief of each document as rows: doc_id, field, place, item, detail, amount."""
    week_1 = f"COALESCE({_number('cash_flow_projection.week_1')}, 0D)"
    insights = ", ".join(f"NULLIF({_text(f'executive_summary.key_insight_{k}')}, '')" for k in (1, 2, 3))
    scalars = {
        "cash_this_week": f"COALESCE({_number('this_week_plan.total_expected_recovery_this_week')}, {week_1})",
        "cash_in_30_days": f"{week_1} + COALESCE({_number('cash_flow_projection.weeks_2_to_4')}, 0D)",
        "achievable_recovery": f"COALESCE({_number('executive_summary.total_achievable_recovery')}, 0D)",
        "theoretical_recovery": f"COALESCE({_number('executive_summary.total_theoretical_recovery')}, 0D)",
    }
    amounts = ", ".join(f"struct('{k}' AS field, CAST(NULL AS STRING) AS detail, {v} AS amount)" for k, v in scalars.items())
    none = "CAST(NULL AS BIGINT) AS place", "CAST(NULL AS STRING) AS item"
    heads = (
        f"struct('executive_brief' AS field, concat_ws(' ', {insights}) AS detail, CAST(NULL AS DOUBLE) AS amount), "
        f"struct('optimization_available' AS field, CAST(d IS NOT NULL AS STRING) AS detail, CAST(NULL AS DOUBLE) AS amount)"
    )
    parts = [_opened(docs).selectExpr("doc_id", f"inline(array({heads}, {amounts}))").selectExpr("doc_id", "field", *none, "detail", "amount")]

    def add(rows: DataFrame, field: str, item: str, detail: str, amount: str) -> None:
        parts.append(rows.selectExpr("doc_id", f"'{field}' AS field", "place", f"{item} AS item", f"{detail} AS detail", f"{amount} AS amount"))

    nothing, no_amount = "CAST(NULL AS STRING)", "CAST(NULL AS DOUBLE)"
    add(brief_actions(docs, projects), "top_actions", "id", "action", "expected_value")
    week = this_week(docs).join(projects.select("project_id", "project_name"), "project_id", "left")
    add(week, "this_week_plan", "project_id", "concat_ws(' | ', day, project_name, action_summary, owner)", "expected_recovery")
    add(owner_plan(docs), "owner_plan", "owner", nothing, "hours")
    add(attention(docs, projects), "projects_requiring_exec_attention", "project_id", "project_name", no_amount)
    low = _items(docs, "deprioritized_projects").withColumn("place", F.expr("CAST(pos + 1 AS BIGINT)"))
    add(low, "projects_to_deprioritize", _text("project_id", "item"), _text("reason", "item"), _number("theoretical_recovery", "item"))
    told = _items(docs, "strategic_insights").withColumn("place", F.expr("CAST(pos + 1 AS BIGINT)"))
    add(told, "strategic_insights", _text("title", "item"), _text("description", "item"), no_amount)
    warned = _items(docs, "this_week_plan.resource_warnings").withColumn("place", F.expr("CAST(pos + 1 AS BIGINT)"))
    add(warned, "biggest_blockers", nothing, _text("", "item"), no_amount)
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
