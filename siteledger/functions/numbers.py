"""Column helpers for numbers: safe casts, exact sums, ratios, rounding."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# A plain decimal or exponent literal. Spark alone would also accept '12f' or 'nan'.
NUMBER_PATTERN = r"^\s*[-+]?(\d+\.?\d*|\.\d+)([eE][-+]?\d+)?\s*$"

# A year, a month and a day, with or without a time behind.
DATE_PATTERN = r"^\s*\d{4}-\d{1,2}-\d{1,2}"

MONEY = T.DecimalType(28, 6)
RATIO = T.DecimalType(28, 10)


def text_to_double(c: Column) -> Column:
    """Text to DOUBLE, NULL for anything that is not a plain number."""
    return F.when(c.rlike(NUMBER_PATTERN), F.trim(c).try_cast("double"))


def number(df: DataFrame, name: str) -> Column:
    """Column `name` of `df` as DOUBLE; text is parsed, NaN becomes NULL."""
    kind = df.schema[name].dataType
    if isinstance(kind, T.StringType):
        return text_to_double(F.col(name))
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        return F.nanvl(F.col(name).cast("double"), F.lit(None).cast("double"))
    return F.col(name).cast("double")


def date(df: DataFrame, name: str) -> Column:
    if isinstance(df.schema[name].dataType, T.DateType):
        return F.col(name)
    c = F.col(name)
    return F.when(c.rlike(DATE_PATTERN), F.trim(c).try_cast("date"))


def ratio(numerator: Column, denominator: Column) -> Column:
    """DOUBLE division; NULL when the denominator is 0 or NULL."""
    return F.try_divide(numerator.cast("double"), denominator.cast("double"))


def exact_sum(c: Column, kind: T.DecimalType = MONEY) -> Column:
    """Sum that does not depend on row order; NULL for no values, an error from 10^22 on."""
    return F.sum(c.cast(kind)).cast("double")


def exact_mean(c: Column, kind: T.DecimalType = MONEY) -> Column:
    return ratio(F.sum(c.cast(kind)), F.count(c))


def labor_cost_decimal(st: Column, ot: Column, rate: Column, burden: Column) -> Column:
    """(ST + 1.5 * OT) * rate * burden in exact decimals, 13 places."""
    hours = st.cast("decimal(10,4)") + ot.cast("decimal(10,4)") * F.lit(1.5).cast(
        "decimal(2,1)"
    )
    return hours * rate.cast("decimal(12,4)") * burden.cast("decimal(8,4)")


def labor_cost(st: Column, ot: Column, rate: Column, burden: Column) -> Column:
    return labor_cost_decimal(st, ot, rate, burden).cast("double")


def clip01(c: Column) -> Column:
    return F.when(c.isNotNull(), F.least(F.greatest(c, F.lit(0.0)), F.lit(1.0)))


def at_least_zero(c: Column) -> Column:
    return F.when(c.isNotNull(), F.greatest(c, F.lit(0.0)))


def zero(c: Column) -> Column:
    return F.coalesce(c, F.lit(0.0))


def half_even(c: Column, places: int) -> Column:
    """Rounded in binary, ties to even."""
    return F.rint(c * 10**places) / 10**places if places else F.rint(c)


def percent_points(value: Column, base: Column) -> Column:
    return half_even(ratio(value, base) * 100, 2)


def multiple(actual: Column, estimated: Column) -> Column:
    return half_even(ratio(actual, estimated), 2)


def difference(left: Column, right: Column) -> Column:
    return half_even(left - right, 2)


def sum_known(*cols: Column) -> Column:
    """Sum of the non-null columns; NULL when all are NULL."""
    total = reduce(lambda a, b: a + b, [zero(c) for c in cols])
    return F.when(F.coalesce(*cols).isNotNull(), total)


def count_when(condition: Column) -> Column:
    return F.count_if(F.coalesce(condition, F.lit(False)))


def sum_when(condition: Column, value: Column, kind: T.DecimalType = MONEY) -> Column:
    """Exact conditional sum, 0 where no row qualifies."""
    kept = F.when(condition, F.coalesce(value, F.lit(0.0))).otherwise(F.lit(0.0))
    return exact_sum(kept, kind)
