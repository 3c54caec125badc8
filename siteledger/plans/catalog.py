"""Every query by key, with the SQL text that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siteledger.plans.oracle_views import oracle
from siteledger.plans.portfolio import Portfolio
from siteledger.sources import fixtures


@dataclass(frozen=True)
class Query:
    build: Callable[[SparkSession, str], DataFrame]
    sql: str | None


QUERIES: dict[str, Query] = {}


def flat(df: DataFrame) -> DataFrame:
    """Arrays of text joined with ' | ', so that both engines give plain columns."""
    cols = []
    for f in df.schema.fields:
        c = F.col(f.name)
        if isinstance(f.dataType, T.ArrayType) and isinstance(f.dataType.elementType, T.StringType):
            c = F.array_join(c, " | ")
        cols.append(c.alias(f.name))
    return df.select(*cols)


def query(
    key: str,
    make: Callable[[Portfolio], DataFrame],
    sql: str | None = None,
    share: bool = False,
) -> None:
    """Register `make`, a function of the stage graph, under `key`."""

    def build(spark: SparkSession, sf_dir: str) -> DataFrame:
        return flat(make(Portfolio(fixtures.load(spark, sf_dir), share=share)))

    QUERIES[key] = Query(build, oracle(sql) if sql else None)
