"""SQL text for the expressions that stages repeat."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from siteledger.functions.numbers import DATE_PATTERN, NUMBER_PATTERN


def join_alike(left: DataFrame, right: DataFrame, keys: list[str] | str, how: str) -> DataFrame:
    """A join with a table that grows with the portfolio, which must never be broadcast.

    Spark guesses the size of such a table from the compressed files it comes from and their columns: eight
    cost lines exploded from each row of a narrow table are taken for a few bytes.
    """
    return left.join(right.hint("merge"), keys, how)


def ratio(n: str, d: str) -> str:
    return f"try_divide(CAST({n} AS DOUBLE), CAST({d} AS DOUBLE))"


def exact_sum(x: str, kind: str = "DECIMAL(28,6)") -> str:
    """Sum that does not depend on row order. Amounts from 10^22 on are an error, not NULL."""
    return f"CAST(SUM(CAST({x} AS {kind})) AS DOUBLE)"


def exact_mean(x: str, kind: str = "DECIMAL(28,10)") -> str:
    return ratio(f"SUM(CAST({x} AS {kind}))", f"COUNT({x})")


def half_even(x: str, places: int) -> str:
    """Rounded in binary, ties to even. Decimal rounding would move 1.255 up, although
    the stored number lies below it."""
    if places == 0:
        return f"rint({x})"
    scale = f"{10 ** places}D"
    return f"(rint(({x}) * {scale}) / {scale})"


def fixed(x: str, places: int) -> str:
    return f"CAST(CAST({half_even(x, places)} AS DECIMAL(28,{places})) AS STRING)"


def dollars(x: str) -> str:
    """`$1,234`; NULL stays NULL."""
    return f"('$' || format_number(CAST({half_even(x, 0)} AS DECIMAL(28,0)), 0))"


def short_dollars(x: str) -> str:
    """`$1.25M`, `$13K`, `$999`; `$0` for NULL."""
    millions, thousands = fixed(f"({x}) / 1000000", 2), fixed(f"({x}) / 1000", 0)
    return (
        f"(CASE WHEN {x} IS NULL THEN '$0' WHEN abs({x}) >= 1000000 THEN '$' || {millions} || 'M' "
        f"WHEN abs({x}) >= 1000 THEN '$' || {thousands} || 'K' ELSE {dollars(x)} END)"
    )


def percent(x: str) -> str:
    return f"({fixed(f'COALESCE({x}, 0D) * 100', 1)} || '%')"


def mentions(text: str, keywords: list[str], lowered: bool = False) -> str:
    """True when the text holds any keyword as a substring, ignoring case.

    Plain substring tests: on long texts they are far cheaper than one pattern of
    alternatives. Pass `lowered` if the column is in lower case already.
    """
    low = text if lowered else f"lower({text})"
    return "COALESCE(" + " OR ".join(f"contains({low}, '{k}')" for k in keywords) + ", false)"


def sector(name: str, sectors: list, default: str) -> str:
    whens = " ".join(f"WHEN {mentions(name, kws)} THEN '{label}'" for label, kws in sectors)
    return f"CASE {whens} ELSE '{default}' END"


def text_list(*pairs: tuple[str, str]) -> str:
    """Array of the values whose condition holds, in order."""
    items = ", ".join(f"CASE WHEN {cond} THEN {value} END" for cond, value in pairs)
    return f"filter(array({items}), x -> x IS NOT NULL)"


def number(df: DataFrame, name: str) -> str:
    """Column `name` of `df` as DOUBLE; text is parsed, NaN becomes NULL."""
    kind = df.schema[name].dataType
    if isinstance(kind, T.StringType):
        return f"CASE WHEN {name} RLIKE r'{NUMBER_PATTERN}' THEN TRY_CAST(trim({name}) AS DOUBLE) END"
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        return f"nanvl(CAST({name} AS DOUBLE), CAST(NULL AS DOUBLE))"
    return f"CAST({name} AS DOUBLE)"


def day(df: DataFrame, name: str) -> str:
    if isinstance(df.schema[name].dataType, T.DateType):
        return name
    # Spark alone would also take '2024' and '2024-01'.
    return f"CASE WHEN {name} RLIKE r'{DATE_PATTERN}' THEN TRY_CAST(trim({name}) AS DATE) END"


def mapped(name: str, mapping: dict[str, str]) -> str:
    """The canonical spelling of a value, or the value itself."""
    pairs = ", ".join(f"'{k}', '{v}'" for k, v in mapping.items())
    return f"COALESCE(try_element_at(map({pairs}), {name}), {name})"


# Up to 999,999 hours a row and rates below 10^8, an error beyond; wider kinds would lose the
# 13 exact places.
LABOR_COST = (
    "(CAST(hours_st AS DECIMAL(10,4)) + CAST(hours_ot AS DECIMAL(10,4)) * "
    "CAST(1.5 AS DECIMAL(2,1))) * CAST(hourly_rate AS DECIMAL(12,4)) * "
    "CAST(burden_multiplier AS DECIMAL(8,4))"
)
