"""Column helpers for text: status words, keywords, money and percent strings."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from siteledger.functions.numbers import half_even


def words(c: Column) -> Column:
    """Lower-cased, trimmed status text."""
    return F.lower(F.trim(c.cast("string")))


def status_or_unknown(c: Column) -> Column:
    clean = words(c)
    return F.when(F.coalesce(clean, F.lit("")) == "", "unknown").otherwise(clean)


def truthy(c: Column, true_words: list[str]) -> Column:
    return F.coalesce(words(c).isin(true_words), F.lit(False))


def mentions(c: Column, keywords: list[str]) -> Column:
    """True when the text holds any keyword as a substring, ignoring case."""
    hits = [F.contains(F.lower(c), F.lit(k)) for k in keywords]
    return F.coalesce(reduce(lambda a, b: a | b, hits), F.lit(False))


def first_sector(name: Column, sectors: list, default: str) -> Column:
    result = F.lit(default)
    for label, kws in reversed(sectors):
        result = F.when(mentions(name, kws), label).otherwise(result)
    return result


# Every Unicode blank, not only the ASCII ones.
BLANKS = r"[\s\x0B\x1c-\x1f\x85\p{Z}]+"


def squish(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), BLANKS, " "))


def truncate(c: Column, limit: int) -> Column:
    cut = F.concat(F.rtrim(F.substring(c, 1, limit - 3)), F.lit("..."))
    return F.when(F.length(c) <= limit, c).otherwise(cut)


def fixed(c: Column, places: int) -> Column:
    """Number as text with `places` digits, rounded half-even."""
    return half_even(c, places).cast(f"decimal(28,{places})").cast("string")


def dollars(c: Column) -> Column:
    """`$1,234`, or `unavailable` for NULL."""
    whole = F.format_number(half_even(c, 0).cast("decimal(28,0)"), 0)
    return F.coalesce(F.concat(F.lit("$"), whole), F.lit("unavailable"))


def short_dollars(c: Column) -> Column:
    """`$1.25M`, `$13K` or `$999`; `$0` for NULL."""
    return (
        F.when(c.isNull(), "$0")
        .when(F.abs(c) >= 1_000_000, F.concat(F.lit("$"), fixed(c / 1_000_000, 2), F.lit("M")))
        .when(F.abs(c) >= 1_000, F.concat(F.lit("$"), fixed(c / 1_000, 0), F.lit("K")))
        .otherwise(dollars(c))
    )


def percent(c: Column) -> Column:
    """Share as `12.3%`; `0.0%` for NULL."""
    return F.concat(fixed(F.coalesce(c, F.lit(0.0)) * 100, 1), F.lit("%"))


def when_list(*pairs: tuple[Column, Column]) -> Column:
    """Array of the values whose condition holds, in order."""
    items = F.array(*[F.when(cond, value) for cond, value in pairs])
    return F.filter(items, lambda x: x.isNotNull())


def first_distinct(c: Column) -> Column:
    """Drop blanks and repeats from an array, keeping first-seen order."""
    return F.array_distinct(F.filter(c, lambda x: F.coalesce(x, F.lit("")) != ""))
