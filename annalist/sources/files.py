"""Dataset files: format from the name, optional reads, listings and text formats."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StringType, StructField, StructType

from annalist.functions.records import coerce_columns
from annalist.specs import EntitySpec


def format_of(uri: str) -> str:
    """The text after the last dot names the format."""
    ext = uri.rstrip("/").rsplit(".", 1)[-1]
    return {"txt": "text", "log": "text", "jsonl": "json"}.get(ext, ext)


def read_dataset(spark: SparkSession, uri: str, schema: StructType | str | None = None, **options) -> DataFrame:
    """Read parquet, orc, csv, json or text by the extension of the path."""
    kind = format_of(uri)
    reader = spark.read.format(kind).options(**options)
    if kind == "csv":
        reader = reader.option("header", options.get("header", True))
    if schema is not None:
        reader = reader.schema(schema)
    return reader.load(uri)


def read_if_exists(spark: SparkSession, uri: str, **options) -> DataFrame | None:
    """Read, or None when the path is missing. Any other error is raised."""
    try:
        return read_dataset(spark, uri, **options)
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            return None
        raise


def query_from_root(spark: SparkSession, root: str) -> DataFrame:
    """All Parquet files under a root, or one file."""
    if root.endswith(".parquet"):
        return spark.read.parquet(root)
    return spark.read.option("pathGlobFilter", "*.parquet").parquet(root.rstrip("/"))


def list_files(spark: SparkSession, root: str, extension: str | None = None, search: str | None = None) -> DataFrame:
    """Paths (and sizes) under a root, at any depth; file contents are not read."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    pattern = search or (f"*.{extension}" if extension else None)
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    return reader.load(root).select("path", "length", "modificationTime")


def read_typed(spark: SparkSession, uri: str, spec: EntitySpec, **options) -> DataFrame:
    """Rows of a file validated and coerced to a type; see ``problems`` for bad ones."""
    return coerce_columns(read_dataset(spark, uri, **options), spec)


def read_csv(
    spark: SparkSession, uri: str, schema: StructType | str, encoding: str = "UTF-8", skip_bad: bool = True, multi_line: bool = False,
) -> DataFrame:
    """CSV with a header; malformed lines are skipped unless ``skip_bad`` is off.

    A line is malformed if it has another number of fields or a field that is not of its type. Which
    lines are skipped does not depend on what is done with the rows: the filter that drops a bad line reads
    every column, so each line is always parsed whole, also to count them. ``multi_line`` reads quoted line
    feeds as part of a field; a file is then read by one task.
    """
    if isinstance(schema, str):
        schema = StructType.fromDDL(schema)
    # A quote within a quoted field is doubled.
    reader = spark.read.option("header", True).option("encoding", encoding).option("multiLine", multi_line).option("escape", '"')
    if not skip_bad:
        return reader.schema(schema).option("mode", "FAILFAST").csv(uri)
    bad = "_bad"
    while bad in schema.names:
        bad += "_"
    marked = StructType([*schema.fields, StructField(bad, StringType())])
    rows = (
        reader.schema(marked).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", bad)
        .option("columnPruning", False).option("enforceSchema", True).csv(uri)
    )
    # Always true, but not to the optimizer, so no column that it names is pruned before the check.
    whole = F.xxhash64(*[F.col(f"`{c}`") for c in marked.names]) % 2 < 2
    return rows.filter(F.col(bad).isNull() & whole).drop(bad)


def write_extract(df: DataFrame, uri: str) -> None:
    """Write an extract in the format of the extension, replacing what is there."""
    kind = format_of(uri)
    writer = df.write.mode("overwrite")
    if kind == "csv":
        writer = writer.option("header", True)
    writer.format(kind).save(uri)


def append_dated(df: DataFrame, root: str, time: str) -> None:
    """Append events to a table partitioned by the date of ``time``."""
    dated = df.withColumn("event_date", F.to_date(time))
    dated.write.mode("append").partitionBy("event_date").parquet(root)
