"""Key lookups: one key, comma lists of keys, many keys, existence, typed keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from annalist.functions.text import strip


def clean_keys(text: Column) -> Column:
    """Keys of a comma list: whitespace, then ``"``, then ``'`` are cut off the ends."""
    clean = lambda k: F.btrim(F.btrim(strip(k), F.lit('"')), F.lit("'"))
    return F.transform(F.split(text, ","), clean)


def keys_of(df: DataFrame, text: str, keep: list[str] = []) -> DataFrame:
    """One row per key of the comma lists in column ``text``."""
    return df.select(*keep, F.explode(clean_keys(F.col(text))).alias("key"))


def literal_keys(spark: SparkSession, keys: str | list[str]) -> DataFrame:
    """Keys typed by the caller (a comma list or a list) as a DataFrame."""
    texts = [keys] if isinstance(keys, str) else list(keys)
    return keys_of(spark.createDataFrame([(t,) for t in texts], "t string"), "t").distinct()


def fetch(keys: DataFrame, table: DataFrame, key: str) -> DataFrame:
    """Every requested key with its record, nulls where it is unknown."""
    renamed = table.withColumnRenamed(key, "_key")
    return keys.join(renamed, F.col("key") == F.col("_key"), "left").drop("_key")


def exists(keys: DataFrame, table: DataFrame, key: str) -> DataFrame:
    """The requested keys that the table has."""
    return keys.join(table.select(F.col(key).alias("key")), "key", "left_semi")


def typed_key(namespace: Column, kind: Column, key: Column) -> Column:
    """Key of a record among records of many types."""
    return F.struct(namespace.alias("namespace"), kind.alias("type"), key.alias("key"))
