"""Reading the ten tables from CSV or JSON, and telling what is there."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siteledger.functions.numbers import date, number
from siteledger.operators.ordering import freeze
from siteledger.sources.schemas import (
    FEATURES, REQUIRED_COLUMNS, REQUIRED_TABLES, SCHEMAS,
)


def path_exists(spark: SparkSession, path: str) -> bool:
    """Asks the file system of the path, so that any Hadoop store works; globs too."""
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration())
    found = fs.globStatus(hadoop_path)
    return found is not None and len(found) > 0


def empty_table(spark: SparkSession, name: str) -> DataFrame:
    return spark.createDataFrame([], SCHEMAS[name])


# Quoted nothing is an empty text, unquoted nothing is NULL.
NO_TEXT = "\u0000"


def scan_csv(
    spark: SparkSession, path: str, columns: list[str] | None = None, one_line: bool = False
) -> DataFrame:
    """Header CSV as text columns; one pass, nothing inferred.

    With `columns` the header must be in that order; without, the names come from
    the header line and every column is text. Records may span lines, which keeps a
    file in one task; pass `one_line` for large files whose records never do, and
    Spark splits them. A file whose header names other columns, or the same ones in another
    order, is an error.
    """
    reader = (
        spark.read.option("header", True)
        .option("escape", '"')
        .option("nullValue", NO_TEXT)
        .option("multiLine", not one_line)
        .option("enforceSchema", False)
    )
    if columns is not None:
        reader = reader.schema(T.StructType([T.StructField(c, T.StringType()) for c in columns]))
    return reader.csv(path)


def conform(df: DataFrame, name: str) -> DataFrame:
    """Column list and types of table `name`; absent columns become NULL."""
    cols: list[Column] = []
    for f in SCHEMAS[name].fields:
        if f.name not in df.columns:
            c = F.lit(None)
        elif isinstance(f.dataType, T.DoubleType):
            c = number(df, f.name)
        elif isinstance(f.dataType, T.LongType):
            c = number(df, f.name).try_cast("bigint")
        elif isinstance(f.dataType, T.DateType):
            c = date(df, f.name)
        else:
            c = F.col(f.name)
        cols.append(c.cast(f.dataType).alias(f.name))
    return df.select(*cols)


def scan_table(spark: SparkSession, path: str, name: str, one_line: bool = False) -> DataFrame:
    return conform(scan_csv(spark, path, one_line=one_line), name)


def scan_optional(
    spark: SparkSession, path: str, name: str, required: bool, one_line: bool = False
) -> DataFrame:
    """The table, or an empty one of the same schema if it may be missing."""
    if path_exists(spark, path):
        return scan_table(spark, path, name, one_line)
    if required:
        raise FileNotFoundError(f"required input not found: {path}")
    return empty_table(spark, name)


def cleaned_or_raw(spark: SparkSession, cleaned: str, raw: str, name: str) -> DataFrame:
    path = cleaned if path_exists(spark, cleaned) else raw
    return scan_optional(spark, path, name, required=False)


def load_csv_folder(
    spark: SparkSession, folder: str, one_line: tuple[str, ...] = ()
) -> dict[str, DataFrame]:
    """All ten tables from `<folder>/<table>_all.csv`.

    `one_line` names the tables whose records never span lines: Spark splits their files.
    """
    return {
        name: scan_optional(
            spark, f"{folder}/{name}_all.csv", name, name in REQUIRED_TABLES, name in one_line)
        for name in SCHEMAS
    }


def _spans_lines(spark: SparkSession, path: str) -> bool:
    """Whether the first line that is not blank is no JSON value of its own."""
    first = spark.read.text(path).filter("trim(value) <> ''").limit(1)
    return first.filter("try_parse_json(value) IS NULL").count() > 0


def scan_json_docs(
    spark: SparkSession, path: str, schema: T.StructType, whole_files: bool | None = None
) -> DataFrame:
    """JSON records: one per line, or arrays of records on a line.

    With `whole_files` each file is one record or one array, over any number of lines; by default the first line
    tells. A record that can't be read is an error; `corrupt_json` lists all of them.
    """
    if whole_files is None:
        whole_files = _spans_lines(spark, path)
    return spark.read.schema(schema).option("multiLine", whole_files).option("mode", "FAILFAST").json(path)


def corrupt_json(
    spark: SparkSession, path: str, schema: T.StructType, whole_files: bool | None = None
) -> DataFrame:
    """path, record: the text of every record that is no JSON or has a value of another type than the schema's."""
    if whole_files is None:
        whole_files = _spans_lines(spark, path)
    text = T.StructField("_corrupt", T.StringType())
    scan = (
        spark.read.schema(T.StructType([*schema.fields, text]))
        .option("multiLine", whole_files)
        .option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", "_corrupt")
        .json(path)
    )
    # Spark refuses to read the corrupt text alone, so the parsed fields are looked at as well.
    rows = scan.select(F.col("_metadata.file_path").alias("path"), F.struct(*(f"`{f.name}`" for f in schema.fields)).alias("fields"), "_corrupt")
    return rows.filter("_corrupt IS NOT NULL AND length(to_json(fields)) >= 0").select("path", F.col("_corrupt").alias("record"))


def data_availability(spark: SparkSession, folder: str) -> DataFrame:
    """One row per input: is it required, is it there, what is lost without it."""
    rows = [
        (name, name in REQUIRED_TABLES, path_exists(spark, f"{folder}/{name}_all.csv"),
         FEATURES.get(name))
        for name in SCHEMAS
    ]
    listed = spark.createDataFrame(
        rows, "table_name string, required boolean, present boolean, feature string"
    )
    return listed.withColumn("degraded", ~F.col("present") & ~F.col("required"))


def required_columns(tables: Mapping[str, DataFrame]) -> DataFrame:
    """One row per table: rows checked and the required columns it lacks."""
    reports = []
    for name, df in tables.items():
        missing = [c for c in REQUIRED_COLUMNS[name] if c not in df.columns]
        listed = F.array(*[F.lit(c) for c in missing]).cast("array<string>")
        reports.append(
            df.agg(F.count(F.lit(1)).alias("rows_checked")).select(
                F.lit(name).alias("table_name"), "rows_checked", listed.alias("missing")
            )
        )
    return reduce(lambda a, b: a.unionByName(b), reports)


# ---- project bundles: one folder per project ------------------------------------


def canonical_table_name(file_name: Column) -> Column:
    """Table a bundle file belongs to; the first matching rule wins."""
    base = F.element_at(F.split(file_name, "/"), -1)
    stem = F.replace(F.lower(F.regexp_replace(base, r"\.[^.]*$", "")), F.lit("-"), F.lit("_"))
    has = lambda word: F.contains(stem, F.lit(word))
    return (
        F.when(has("billing_line"), "billing_line_items")
        .when(has("billing"), "billing_history")
        .when(has("change_order") | stem.startswith("co"), "change_orders")
        .when(has("contract"), "contracts")
        .when(has("field_note") | has("daily_log"), "field_notes")
        .when(has("labor"), "labor_logs")
        .when(has("material"), "material_deliveries")
        .when(has("rfi"), "rfis")
        .when(has("sov_budget") | (has("budget") & has("sov")), "sov_budget")
        .when((stem == "sov") | has("schedule_of_values"), "sov")
        .otherwise(stem)
    )


def scan_bundle_csv(spark: SparkSession, root: str, pattern: str) -> DataFrame:
    """Rows of one kind of bundle file with the project folder and table name."""
    path = F.col("_metadata.file_path")
    raw = spark.read.option("header", True).option("enforceSchema", False).csv(f"{root}/*/{pattern}")
    return raw.select(
        "*",
        F.element_at(F.split(path, "/"), -2).alias("bundle"),
        canonical_table_name(path).alias("table_name"),
    )


RECORDS = "array<map<string,string>>"


def normalize_json_table(text: Column) -> Column:
    """Records of a JSON table: an array, or the first array of records in an object."""
    records = lambda c: F.when(F.ltrim(c).startswith("["), F.from_json(c, RECORDS))
    is_table = lambda r: r.isNotNull() & F.forall(r, lambda row: row.isNotNull())
    members = F.transform(F.map_values(F.from_json(text, "map<string,string>")), records)
    nested = F.get(F.filter(members, is_table), F.lit(0))
    listed = F.filter(records(text), lambda row: row.isNotNull())
    return F.coalesce(listed, nested, F.array().cast(RECORDS))


def infer_project_id(project_id: Column, bundle: Column) -> Column:
    """Any stated id of the bundle, else the folder name. An aggregate."""
    return F.coalesce(F.min(project_id), F.min(bundle))


FILE = "_metadata.file_path"
BUNDLE_CSV, BUNDLE_JSON = "*.[cC][sS][vV]", "*.[jJ][sS][oO][nN]"
#: Most columns a bundle's CSV may have; a file with more is an error.
WIDEST = 64


def _of_table(df: DataFrame, name: str) -> DataFrame:
    """Files that stand for the table; Spark drops the others before it opens them."""
    return df.filter(canonical_table_name(F.col(FILE)) == name)


def _last_files(spark: SparkSession, globs: list[str], name: str) -> DataFrame:
    """path, bundle of the last file of each bundle that stands for the table; nothing is opened."""
    files = _of_table(spark.read.format("binaryFile").load(globs), name).select(F.col(FILE).alias("path"))
    bundle = F.url_decode(F.element_at(F.split("path", "/"), -2))
    return files.groupBy(bundle.alias("bundle")).agg(F.max("path").alias("path"))


def _csv_records(spark: SparkSession, glob: str, name: str, one_line: bool) -> DataFrame:
    """path, record of each row, every file by its own header.

    Rows that repeat their file's header are left out.
    """
    cells = [f"c{i}" for i in range(WIDEST + 1)]
    scan = (
        spark.read.schema(", ".join(f"{c} string" for c in cells))
        .option("escape", '"')
        .option("nullValue", NO_TEXT)
        .option("multiLine", not one_line)
        .csv(glob)
    )
    rows = _of_table(scan, name).select(
        F.col(FILE).alias("path"),
        F.col("_metadata.file_block_start").alias("start"),
        F.monotonically_increasing_id().alias("at"),
        F.array(*cells).alias("row"),
    )
    headers = rows.filter("start = 0").groupBy("path").agg(F.min_by("row", "at").alias("header"))
    named = "filter(arrays_zip(header, row), x -> x.header IS NOT NULL)"
    return rows.join(headers, "path").filter("NOT row <=> header").selectExpr(
        "path",
        f"CASE WHEN header[{WIDEST}] IS NOT NULL THEN raise_error('more than {WIDEST} columns: ' || path) "
        f"ELSE map_from_entries(transform({named}, x -> struct(trim(x.header), x.row))) END AS record",
    )


def _json_records(spark: SparkSession, glob: str, name: str) -> DataFrame:
    docs = _of_table(spark.read.text(glob, wholetext=True), name)
    return docs.select(
        F.col(FILE).alias("path"), F.explode(normalize_json_table(F.col("value"))).alias("record"))


def bundle_records(
    spark: SparkSession, root: str, name: str, one_line: bool = False
) -> DataFrame:
    """bundle, record (column name to text) of one table from `<root>/<bundle>/*.csv` and `*.json`.

    The table of a file follows from its name; of several files of a bundle that stand for one
    table the last in name order counts.
    """
    kinds = [f"{root}/*/{k}" for k in (BUNDLE_CSV, BUNDLE_JSON)]
    csv_glob, json_glob = (k if path_exists(spark, k) else None for k in kinds)
    found = []
    if csv_glob:
        found.append(_csv_records(spark, csv_glob, name, one_line))
    if json_glob:
        found.append(_json_records(spark, json_glob, name))
    if not found:
        return spark.createDataFrame([], "bundle string, record map<string,string>")
    last = _last_files(spark, [g for g in (csv_glob, json_glob) if g], name)
    return reduce(lambda a, b: a.unionByName(b), found).join(last, "path").select("bundle", "record")


def load_bundles(
    spark: SparkSession, root: str, one_line: tuple[str, ...] = ()
) -> dict[str, DataFrame]:
    """The ten tables from one folder per project; every row of a folder gets its project id.

    `one_line` names the tables whose CSV records never span lines: Spark splits their files.
    """
    records = {name: bundle_records(spark, root, name, name in one_line) for name in SCHEMAS}
    stated = F.nullif(F.try_element_at("record", F.lit("project_id")), F.lit(""))
    ids = freeze(
        reduce(lambda a, b: a.unionByName(b),
               [r.select("bundle", stated.alias("stated")) for r in records.values()])
        .groupBy("bundle")
        .agg(infer_project_id(F.col("stated"), F.col("bundle")).alias("project_id"))
    )
    tables = {}
    for name, rows in records.items():
        own = [f.name for f in SCHEMAS[name].fields if f.name != "project_id"]
        texts = rows.select(
            "bundle", *[F.try_element_at("record", F.lit(c)).alias(c) for c in own])
        tables[name] = conform(texts.join(ids, "bundle"), name)
    return tables


# ---- ids -------------------------------------------------------------------------

KEYED_ID = r'"(?i:project_id|id)"\s*:\s*"(PRJ-[^"]*)"'
PLAIN_ID = r'"(PRJ-\d{4}-\d{3})"'


def flagged_ids(docs: DataFrame, text: str = "value") -> DataFrame:
    """Project ids named anywhere in JSON documents, each once."""
    found = F.array_union(
        F.regexp_extract_all(F.col(text), F.lit(KEYED_ID), 1),
        F.regexp_extract_all(F.col(text), F.lit(PLAIN_ID), 1),
    )
    return docs.select(F.explode(found).alias("project_id")).distinct()


def parse_id_list(lists: DataFrame, column: str) -> DataFrame:
    """Ids from comma lists, trimmed, each once."""
    return (
        lists.select(F.explode(F.split(column, ",")).alias("part"))
        .select(F.trim("part").alias("project_id"))
        .filter(F.col("project_id") != "")
        .distinct()
    )


def project_subset(table: DataFrame, ids: DataFrame) -> DataFrame:
    return table.join(ids.select("project_id"), "project_id", "left_semi")
