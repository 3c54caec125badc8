"""From raw documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and works on all that the one before kept; the results
in between are written as Parquet and read again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siteledger.llm import exact_dedup, mixing, neardup, packing, quality
from siteledger.llm.queries import PATTERN, VOCABULARY, table
from siteledger.llm.storage import staged

#: Documents scored below are rejected.
LEAST_QUALITY = 0.3
TARGETS = mixing.Targets(
    weights={"lang": {"en": 3, "de": 1, "fr": 1, "es": 1}},
    share=0.8,
    epochs=2,
    domain="CASE WHEN source = 'src0' THEN 'main' ELSE 'other' END",
)


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents the line field takes for good ones."""
    rows = quality.scored(docs, table(spark, sf_dir, "labels"), carry=docs.columns)
    return rows.filter(F.col("score") >= LEAST_QUALITY).select("row.*")


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each text."""
    return exact_dedup.deduplicate(docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies; rows without an id stay."""
    return neardup.deduplicate(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the budget takes them, the last one of a leaf cut."""
    return mixing.mix(docs, TARGETS)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences with their token ids."""
    return packing.with_checksums(packing.pack_documents(docs, VOCABULARY, PATTERN))


STAGES = [
    ("quality", quality_stage),
    ("exact_dedup", exact_stage),
    ("near_dedup", near_stage),
    ("mixing", mixing_stage),
    ("packing", packing_stage),
]
#: The quality stage is a trained model, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
