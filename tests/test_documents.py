"""Schema rules against a plain recursive check, and optimisation documents with odd contents."""

from __future__ import annotations

import json
import random

import pytest

from siteledger.operators import optimization, schema_rules
from siteledger.operators.document_schemas import DIAGNOSIS, PORTFOLIO_INPUT


def _is(kind, value):
    number = isinstance(value, (int, float)) and not isinstance(value, bool)
    return {
        "string": isinstance(value, str), "number": number, "integer": number and float(value).is_integer(),
        "boolean": isinstance(value, bool), "null": value is None, "object": isinstance(value, dict), "array": isinstance(value, list),
    }[kind]


def check(schema, value, path="$"):
    """Broken rules as (path, rule), one place after the other."""
    kinds = schema.get("type", [])
    kinds = kinds if isinstance(kinds, list) else [kinds]
    if kinds and not any(_is(k, value) for k in kinds):
        yield path, "type"
    if "enum" in schema and value not in schema["enum"]:
        yield path, "enum"
    if _is("number", value):
        if value < schema.get("minimum", value):
            yield path, "minimum"
        if value > schema.get("maximum", value):
            yield path, "maximum"
    if isinstance(value, list):
        if len(value) < schema.get("minItems", 0):
            yield path, "minItems"
        if len(value) > schema.get("maxItems", len(value)):
            yield path, "maxItems"
        for i, x in enumerate(value):
            yield from check(schema.get("items", {}), x, f"{path}[{i}]")
    if isinstance(value, dict):
        known, more = schema.get("properties", {}), schema.get("additionalProperties", True)
        for name in schema.get("required", []):
            if name not in value:
                yield f"{path}.{name}", "required"
        for name, x in value.items():
            if name in known:
                yield from check(known[name], x, f"{path}.{name}")
            elif more is False:
                yield f"{path}.{name}", "additionalProperties"
            elif more is not True:
                yield from check(more, x, f"{path}.{name}")


def sample(schema, rng):
    """A value that mostly keeps the schema."""
    if rng.random() < 0.04:
        return rng.choice([None, 3, -1, 2.5, 7.0, "x", "", True, [], {}, [1, "a"], {"k": 1}])
    if "enum" in schema:
        return rng.choice(schema["enum"])
    kinds = schema.get("type", "string")
    kind = rng.choice(kinds) if isinstance(kinds, list) else kinds
    if kind == "object":
        known, more = schema.get("properties", {}), schema.get("additionalProperties")
        out = {k: sample(s, rng) for k, s in known.items() if rng.random() > 0.05}
        if rng.random() < 0.1:
            out["extra one"] = 1
        if isinstance(more, dict):
            out |= {name: sample(more, rng) for name in rng.sample(["A.B", "c d", "e"], rng.randint(0, 3))}
        return out
    if kind == "array":
        return [sample(schema.get("items", {}), rng) for _ in range(rng.randint(0, 4))]
    return {
        "string": "text", "number": rng.choice([0, 0.5, 1, 1.25, -3, 1e20]), "integer": rng.choice([0, 5, -2]),
        "boolean": rng.random() < 0.5, "null": None,
    }[kind]


@pytest.mark.parametrize("schema", [DIAGNOSIS, PORTFOLIO_INPUT], ids=["diagnosis", "portfolio_input"])
def test_rules_agree_with_a_plain_check(spark, schema):
    rng = random.Random(11)
    values = [sample(schema, rng) for _ in range(150)]
    rows = [(k, json.dumps(v)) for k, v in enumerate(values)]
    got = schema_rules.schema_violations(spark.createDataFrame(rows, "id long, document string"), schema, "id").collect()
    expected = [(k, *found) for k, v in enumerate(values) for found in check(schema, v)]
    assert sorted(map(tuple, got)) == sorted(expected)
    rules = {r for _, _, r in expected}
    assert rules >= {"type", "enum", "required", "additionalProperties", "minimum", "maximum"}
    if schema is DIAGNOSIS:
        assert rules >= {"minItems", "maxItems"}


def test_texts_that_are_no_document(spark):
    texts = [None, "", "{", "{} x", "{}]", "{}}", "{},{}", '{},"a":1', "{}],[{}", '{}},{"v":{}', '{"a":1,"a":2}', " {} ", "[]", "7"]
    rows = list(enumerate(texts))
    schema = {"type": "object"}
    got = schema_rules.schema_violations(spark.createDataFrame(rows, "id long, document string"), schema, "id").collect()
    found = {(texts[r.id], r.path, r.rule) for r in got}
    assert found == {(t, "$", "json") for t in texts[:11]} | {("[]", "$", "type"), ("7", "$", "type")}
    assert schema_rules.schema_violations(spark.createDataFrame(rows, "id long, document string").limit(0), schema, "id").count() == 0


def test_unknown_schema_words_are_an_error():
    with pytest.raises(ValueError, match="pattern"):
        schema_rules.broken({"type": "string", "pattern": "x"})


@pytest.fixture(scope="module")
def odd(spark):
    actions = [
        {"project_id": "b", "action": " Go ", "estimated_recovery_dollars": "200", "probability_of_success": 0.5, "priority": "9"},
        {"project_id": "a", "description": "text", "amount": 10, "owner": None, "time_to_cash_days": 3.7},
        "not an action", {"project_id": "b", "id": "i", "action_id": "", "expected_value": -4, "project_name": ""},
        {"project_id": "zz", "estimated_recovery_dollars": "n/a"}, {"project_id": ""}, {"project_id": "c"}, {"project_id": "d"}, {"project_id": "e"},
    ]
    first = {
        "prioritized_actions": actions * 4,
        "this_week_plan": {
            "actions": [{"day": "Friday", "project_id": "a", "hours_required": "4.5"}, {}], "total_expected_recovery_this_week": "oops",
            "total_hours_by_owner": {"B": 2, "A": "2", "C": 0, "D": None, "E": -1, "F": "x"}, "resource_warnings": ["w", 5, None],
        },
        "cash_flow_projection": {"week_1": "100", "weeks_2_to_4": 50.5},
        "executive_summary": {"key_insight_1": "", "key_insight_3": "three", "total_achievable_recovery": None},
        "strategic_insights": [{"title": "T"}], "deprioritized_projects": [{"project_id": "p", "reason": "r", "nested": {"x": [1]}}],
        "systemic_issues": {"not": "a list"},
    }
    rows = [("one", json.dumps(first)), ("empty", "{}"), ("broken", "{"), ("null", None), ("list", "[1]")]
    return spark.createDataFrame(rows, "doc_id string, document string")


@pytest.fixture(scope="module")
def projects(spark):
    return spark.createDataFrame([(k, f"Project {k}") for k in "abcde"], "project_id string, project_name string")


def test_views_of_odd_documents(odd):
    got = optimization.optimization_views(odd).collect()
    assert {r["doc_id"] for r in got} == {"one"}
    by = lambda v: [r for r in got if r["view"] == v]
    assert sorted(r.place for r in by("actions")) == list(range(1, 21))
    assert len([r for r in optimization.optimization_views(odd, 30).collect() if r["view"] == "actions"]) == 30
    assert sorted((r.place, r["item"], r.amount) for r in by("this_week")) == [(1, "Friday", 4.5), (2, None, 0.0)]
    assert {(r["item"], r.amount) for r in by("cash_flow")} == {("week_1", 100.0), ("weeks_2_to_4", 50.5)}


def test_insights_of_odd_documents(odd):
    got = {(r.section, r.place, r.field, r.text, r.amount) for r in optimization.insight_views(odd).collect()}
    assert got == {
        ("executive_summary", None, "key_insight_1", "", None), ("executive_summary", None, "key_insight_3", "three", None),
        ("strategic_insights", 1, "title", "T", None), ("deprioritized_projects", 1, "project_id", "p", None),
        ("deprioritized_projects", 1, "reason", "r", None), ("deprioritized_projects", 1, "nested", '{"x":[1]}', None),
    }


def test_brief_of_odd_documents(odd, projects):
    actions = {r.place: r for r in optimization.brief_actions(odd, projects).collect()}
    assert sorted(actions) == list(range(1, 9))
    a = actions[1]
    assert (a.id, a.priority, a.action, a.owner, a.urgency) == ("action-9", 9, "Go", "Project Manager", "this_month")
    assert (a.estimated_recovery_dollars, a.expected_value, a.project_name) == (200.0, 100.0, "Project b")
    a = actions[2]
    assert (a.action, a.estimated_recovery_dollars, a.probability_of_success, a.time_to_cash_days) == ("text", 10.0, 0.7, 3)
    assert (actions[3].project_id, actions[3].id, actions[4].id, actions[4].expected_value) == (None, "action-3", "i", -4.0)
    assert (actions[4].project_name, actions[5].project_name, actions[5].expected_value) == ("Project b", None, 0.0)
    places = sorted((r.place, r.project_id) for r in optimization.attention(odd, projects).collect())
    assert places == [(1, "b"), (2, "a"), (3, "c"), (4, "d")]
    assert len(optimization.attention(odd, projects, n=5, among=40).collect()) == 5
    owners = [(r.place, r.owner, r.hours) for r in optimization.owner_plan(odd).orderBy("place").collect()]
    assert owners == [(1, "A", 2.0), (2, "B", 2.0)]
    rows = optimization.brief(odd, projects).collect()
    value = {(r.doc_id, r.field): (r.detail, r.amount) for r in rows if r.place is None}
    assert value["one", "executive_brief"] == ("three", None) and value["empty", "executive_brief"] == ("", None)
    assert value["one", "cash_this_week"] == (None, 100.0) and value["one", "cash_in_30_days"] == (None, 150.5)
    assert value["broken", "optimization_available"] == ("false", None) and value["empty", "cash_in_30_days"] == (None, 0.0)
    warned = sorted((r.place, r.detail) for r in rows if r.field == "biggest_blockers" and r.detail)
    assert warned == [(1, "w"), (2, "5")]
    assert optimization.brief(odd.limit(0), projects).count() == 0
