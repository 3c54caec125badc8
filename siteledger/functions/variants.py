"""Single values of JSON documents that were parsed as VARIANT, as SQL text."""

from __future__ import annotations


def is_kind(x: str, kind: str) -> str:
    """kind: the first word of the type, such as ARRAY or OBJECT."""
    return f"schema_of_variant({x}) LIKE '{kind}%'"


def is_number(x: str) -> str:
    kind = f"schema_of_variant({x})"
    return f"({kind} IN ('BIGINT', 'DOUBLE', 'FLOAT') OR {kind} LIKE 'DECIMAL%')"


def leaf_text(x: str) -> str:
    """Text of anything but a number; nested values as JSON text."""
    return f"IF({is_number(x)}, NULL, try_variant_get({x}, '$', 'string'))"


def leaf_amount(x: str) -> str:
    return f"IF({is_number(x)}, try_variant_get({x}, '$', 'double'), NULL)"
