"""Which text columns are enumerations, and their values."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import StringType

#: Of so many equal parts of the hash range, the first pass looks at one.
PARTS = 4096


def enumerated_columns(
    df: DataFrame, threshold: int = 200, max_length: int = 100, omit: list[str] = []
) -> DataFrame:
    """(column, value) for each text column with few, short values.

    A column qualifies when its mean length in bytes is at most ``max_length``
    and it has fewer than ``threshold`` distinct values, null counting as one.
    All-null columns do not qualify.

    Pass 1 looks at the values whose hash falls into one of ``PARTS`` equal
    parts: a column that has ``threshold`` different ones there certainly has
    too many. Pass 2 counts the rest exactly, so both passes shuffle a bounded
    number of values per column and task.
    """
    names = [
        f.name for f in df.schema if isinstance(f.dataType, StringType) and f.name not in omit
    ]
    empty = df.sparkSession.createDataFrame([], "column string, value string")
    if not names:
        return empty
    facts = df.agg(*[F.avg(F.octet_length(c)).alias(f"len_{c}") for c in names]).first()
    short = [c for c in names if facts[f"len_{c}"] is not None and facts[f"len_{c}"] <= max_length]
    if not short:
        return empty
    part = _pairs(df, short).filter(F.pmod(F.xxhash64("value"), F.lit(PARTS)) == 0).distinct()
    many = {r["column"] for r in part.groupBy("column").agg(F.count("*").alias("n")).filter(F.col("n") >= threshold).collect()}
    likely = [c for c in short if c not in many]
    if not likely:
        return empty
    values = _pairs(df, likely).distinct()
    few = values.groupBy("column").agg(F.count("*").alias("n")).filter(F.col("n") < threshold)
    # At most one row per text column of the table.
    return values.join(F.broadcast(few), "column").select("column", "value")


def _pairs(df: DataFrame, names: list[str]) -> DataFrame:
    """(column, value) of some text columns."""
    both = [F.struct(F.lit(c).alias("column"), F.col(c).alias("value")) for c in names]
    return df.select(F.explode(F.array(*both)).alias("p")).select("p.*")


def enum_lists(df: DataFrame, **options) -> dict[str, list[str | None]]:
    """The same as a dict of lists; at most ``threshold`` values per column."""
    out: dict[str, list[str | None]] = {}
    for r in enumerated_columns(df, **options).collect():
        out.setdefault(r["column"], []).append(r["value"])
    return out


def distinct_values(df: DataFrame, column: str) -> DataFrame:
    return df.select(column).distinct()
