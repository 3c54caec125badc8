"""Which rows a classifier may learn from, and bounded samples of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def remainder(id_col: str, modulus: int) -> Column:
    """crc32 of the id as text, modulo `modulus`."""
    return F.pmod(F.crc32(F.col(id_col).cast("string")), F.lit(modulus))


def sample(rows: DataFrame, id_col: str, bound: int) -> DataFrame:
    """At most `bound` rows, the same ones at every run: those first by a hash of the id."""
    return rows.orderBy(F.xxhash64(F.lit("sample"), F.col(id_col)), id_col).limit(bound)
