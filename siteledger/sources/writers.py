"""Writing tables, JSON records and packets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def write_table(df: DataFrame, path: str, kind: str = "parquet") -> None:
    """A table as Parquet, or as CSV with a header."""
    if kind == "csv":
        (
            df.write.option("header", True)
            .option("escape", '"')
            .option("ignoreLeadingWhiteSpace", False)
            .option("ignoreTrailingWhiteSpace", False)
            .csv(path)
        )
    else:
        df.write.parquet(path)


def without_nan(df: DataFrame) -> DataFrame:
    """NaN has no JSON form: write it as null."""
    null = F.lit(None).cast("double")
    return df.select(
        *[
            F.nanvl(F.col(f.name), null).alias(f.name)
            if isinstance(f.dataType, T.DoubleType) else F.col(f.name)
            for f in df.schema.fields
        ]
    )


def write_json(df: DataFrame, path: str) -> None:
    without_nan(df).write.option("ignoreNullFields", False).json(path)


def packet_documents(nested: DataFrame) -> DataFrame:
    """One JSON document per project."""
    body = F.to_json(
        F.struct(*[c for c in nested.columns if c != "project_id"]), {"ignoreNullFields": "false"}
    )
    return nested.select("project_id", body.alias("packet"))


def write_packets(nested: DataFrame, path: str) -> None:
    packet_documents(nested).write.parquet(path)


def packet_manifest(written: DataFrame) -> DataFrame:
    """What lies where: one row per packet, from a table that `write_packets` wrote."""
    return written.select(
        "project_id",
        F.col("_metadata.file_path").alias("packet_path"),
        F.get_json_object("packet", "$.project.project_name").alias("project_name"),
        F.get_json_object("packet", "$.project.project_stage").alias("project_stage"),
    )


def manifest_header(manifest: DataFrame) -> DataFrame:
    return manifest.agg(F.count(F.lit(1)).alias("project_count"))
