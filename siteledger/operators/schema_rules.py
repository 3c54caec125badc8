"""Checks JSON documents against a schema, compiled into one expression per document.

The text is parsed as VARIANT, which keeps unknown fields and wrongly typed values that a typed parse would lose.
Every rule of the schema becomes a condition on a place in the document; arrays and maps of any length are
walked inside the expression. The outcome is one row per document, place and broken rule. No row leaves its task, and
a document is read once.

Understood: type, required, properties, additionalProperties (false or a schema), enum, minimum, maximum, minItems,
maxItems, items. Anything else in a schema is an error, except titles and descriptions.

Defined results: a null text, a text that is no JSON, or one that names a field twice breaks the rule `json` at `$`.
Required fields may be null where their type allows it. Whole numbers written with a fraction of zero are integers.
"""

from __future__ import annotations

import json
from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siteledger.functions.variants import is_kind, is_number

Schema = Mapping[str, object]

_BROKEN = "ARRAY<STRUCT<path: STRING, rule: STRING>>"
_NONE = f"CAST(array() AS {_BROKEN})"
_NOTES = {"$schema", "title", "description"}
_KNOWN = {
    "type", "required", "properties", "additionalProperties", "enum", "minimum", "maximum", "minItems", "maxItems", "items",
}


def _text(value: str) -> str:
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _is(name: str, value: str) -> str:
    """Whether a VARIANT is of a type of the schema language."""
    kind = f"schema_of_variant({value})"
    simple = {"string": "STRING", "boolean": "BOOLEAN", "null": "VOID"}
    if name in simple:
        return f"{kind} = '{simple[name]}'"
    if name == "number":
        return is_number(value)
    if name == "integer":
        real = f"try_cast({value} AS DOUBLE)"
        return f"({kind} = 'BIGINT' OR {is_number(value)} AND {real} = floor({real}))"
    return is_kind(value, {"object": "OBJECT", "array": "ARRAY"}[name])


def _field(value: str, name: str) -> str:
    if "'" in name or '"' in name:
        raise ValueError(f"a field name with quotes: {name}")
    return f"variant_get({value}, {_text('$[' + chr(34) + name + chr(34) + ']')})"


def _rule(condition: str, path: str, rule: str) -> str:
    return f"CASE WHEN {condition} THEN named_struct('path', {path}, 'rule', '{rule}') END"


def broken(schema: Schema, value: str = "doc", path: str = "'$'", depth: int = 0) -> str:
    """SQL text of the array of (path, rule) that the VARIANT `value` breaks; empty where it is absent."""
    if unknown := set(schema) - _KNOWN - _NOTES:
        raise ValueError(f"not understood in a schema: {sorted(unknown)}")
    rules: list[str] = []
    parts: list[str] = []
    if "type" in schema:
        kinds = schema["type"] if isinstance(schema["type"], list) else [schema["type"]]
        rules.append(_rule(f"NOT ({' OR '.join(_is(k, value) for k in kinds)})", path, "type"))
    if "enum" in schema:
        words = ", ".join(_text(json.dumps(w)) for w in schema["enum"])
        rules.append(_rule(f"to_json({value}) NOT IN ({words})", path, "enum"))
    real = f"{is_number(value)} AND try_cast({value} AS DOUBLE)"
    for name, sign in (("minimum", "<"), ("maximum", ">")):
        if name in schema:
            rules.append(_rule(f"{real} {sign} {float(schema[name])!r}D", path, name))
    items = f"try_cast({value} AS ARRAY<VARIANT>)"
    for name, sign in (("minItems", "<"), ("maxItems", ">")):
        if name in schema:
            rules.append(_rule(f"size({items}) {sign} {int(schema[name])}", path, name))
    properties: Mapping[str, Schema] = schema.get("properties", {})
    for name in schema.get("required", ()):
        absent = f"{_is('object', value)} AND {_field(value, name)} IS NULL"
        rules.append(_rule(absent, f"{path} || {_text('.' + name)}", "required"))
    for name, inner in properties.items():
        parts.append(broken(inner, _field(value, name), f"{path} || {_text('.' + name)}", depth))
    fields = f"try_cast({value} AS MAP<STRING, VARIANT>)"
    listed = f" NOT IN ({', '.join(_text(p) for p in properties)})" if properties else " IS NOT NULL"
    more = schema.get("additionalProperties", True)
    if more is False:
        parts.append(
            f"transform(filter(map_keys({fields}), k -> k{listed}), "
            f"k -> named_struct('path', {path} || '.' || k, 'rule', 'additionalProperties'))"
        )
    elif more is not True:
        e = f"e{depth}"
        inner = broken(more, f"{e}.value", f"{path} || '.' || {e}.key", depth + 1)
        parts.append(f"flatten(transform(filter(map_entries({fields}), {e} -> {e}.key{listed}), {e} -> {inner}))")
    if "items" in schema:
        x, i = f"x{depth}", f"i{depth}"
        inner = broken(schema["items"], x, f"{path} || '[' || {i} || ']'", depth + 1)
        parts.append(f"flatten(transform({items}, ({x}, {i}) -> {inner}))")
    if rules:
        parts.insert(0, f"filter(array({', '.join(rules)}), r -> r IS NOT NULL)")
    if not parts:
        return _NONE
    return f"concat({', '.join(f'COALESCE({p}, {_NONE})' for p in parts)})"


def parsed_whole(text: str) -> str:
    """A text as VARIANT; NULL unless all of it is one JSON value.

    The parser stops behind the first value. Inside brackets and inside braces nothing can follow unseen.
    """
    listed = f"try_parse_json('[' || {text} || ']')"
    field = f"""try_parse_json('{{"v":' || {text} || '}}')"""
    one = f"size(try_cast({listed} AS ARRAY<VARIANT>)) = 1"
    return f"IF({field} IS NOT NULL AND {one}, variant_get({listed}, '$[0]'), NULL)"


def schema_violations(docs: DataFrame, schema: Schema, id_col: str, text_col: str = "document") -> DataFrame:
    """One row per document and broken rule: the id, `path` and `rule`."""
    parsed = docs.select(F.col(id_col), F.expr(parsed_whole(text_col)).alias("doc"))
    unread = f"CAST(array(named_struct('path', '$', 'rule', 'json')) AS {_BROKEN})"
    found = F.expr(f"IF(doc IS NULL, {unread}, {broken(schema)})")
    return parsed.select(id_col, F.explode(found).alias("r")).select(id_col, "r.path", "r.rule")
