"""Data preparation: joins, counts, profiles of groups, samples and assignments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from annalist.functions.text import key_hash
from annalist.session import stage


def join_same(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Inner join on a column both have."""
    return a.join(b, key)


def join_dimension(
    fact: DataFrame, dimension: DataFrame, left_on: str, right_on: str, suffix: str
) -> DataFrame:
    """Inner join to a dimension whose columns get ``suffix``, so it can be joined again."""
    named = dimension.select(*[F.col(c).alias(f"{c}{suffix}") for c in dimension.columns])
    return fact.join(named, fact[left_on] == named[f"{right_on}{suffix}"]).drop(f"{right_on}{suffix}")


def only_in(df: DataFrame, key: str, other: DataFrame, other_key: str) -> DataFrame:
    """Rows whose key occurs in another table."""
    return df.join(other.select(F.col(other_key).alias(key)), key, "left_semi")


def not_in(df: DataFrame, key: str, other: DataFrame, other_key: str) -> DataFrame:
    """Rows whose key does not occur in another table."""
    return df.join(other.select(F.col(other_key).alias(key)), key, "left_anti")


def group_counts(df: DataFrame, key: str, counted: str, more_than: int | None = None, name: str = "n") -> DataFrame:
    """Non-null ``counted`` per key, keyed groups only, optionally those with more than a number."""
    counts = df.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count(counted).alias(name))
    return counts if more_than is None else counts.filter(F.col(name) > more_than)


def with_group_count(df: DataFrame, key: str, counted: str, name: str = "n") -> DataFrame:
    """Attach the group's count to each row.

    A window would sort a hot group in one task. The counts combine on the map
    side, and AQE broadcasts them or splits the hot partition of the join.
    """
    return df.join(group_counts(df, key, counted, name=name), key)


def group_summary(df: DataFrame, key: str, number: str, text: str) -> DataFrame:
    """Size, min, max and mean of a number and the smallest text per non-null key."""
    return df.filter(F.col(key).isNotNull()).groupBy(key).agg(
        F.count("*").alias("size"),
        F.min(number).alias("min"),
        F.max(number).alias("max"),
        F.avg(number).alias("mean"),
        F.min(text).alias("first_text"),
    )


def group_mode(df: DataFrame, key: str, value: str, name: str = "mode") -> DataFrame:
    """Most frequent non-null value per non-null key; a tie goes to the smallest value."""
    counts = df.filter(F.col(key).isNotNull() & F.col(value).isNotNull()).groupBy(key, value).agg(F.count("*").alias("_n"))
    return counts.groupBy(key).agg(
        F.min_by(F.col(value), F.struct(-F.col("_n"), F.col(value))).alias(name)
    )


def group_profile(df: DataFrame, key: str, number: str, text: str, modes: dict[str, str]) -> DataFrame:
    """``group_summary`` plus the mode of several columns (output name -> column).

    Groups without a mode keep their row.
    """
    out = group_summary(df, key, number, text)
    for name, value in modes.items():
        out = out.join(group_mode(df, key, value, name), key, "left")
    return out


def sorted_head(df: DataFrame, order: list[Column], n: int, m: int, required: list[str] | None = None) -> DataFrame:
    """First ``n`` rows, of these the ones without nulls, of these the first ``m``."""
    return df.orderBy(*order).limit(n).na.drop(subset=required).orderBy(*order).limit(m)


def numbered(df: DataFrame, order: list[str], name: str = "row_index") -> DataFrame:
    """Rows numbered from 0 in the order of unique columns, without a single-task sort.

    The rows are range-partitioned and sorted, and written once to the shared
    folder with their place in their partition; the row counts of the partitions
    then give each one its first number. A number is the same however often the
    result is read.
    """
    ranged = (
        df.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .withColumn("_part", F.spark_partition_id())
        .withColumn("_at", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)))
    )
    placed = stage(ranged, "numbered")
    sizes = placed.groupBy("_part").agg(F.count("*").alias("_rows"))
    # One row per partition, so this window and the broadcast are small by construction.
    before = F.sum("_rows").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1))
    first = sizes.select("_part", F.coalesce(before, F.lit(0)).alias("_first"))
    return (
        placed.join(F.broadcast(first), "_part")
        .withColumn(name, F.col("_first") + F.col("_at"))
        .drop("_part", "_at", "_first")
    )


def every_nth_row(df: DataFrame, order: list[str], step: int = 100) -> DataFrame:
    """Systematic sample: rows 0, step, 2 step, ... in the order of unique columns."""
    return numbered(df, order).filter(F.col("row_index") % step == 0).drop("row_index")


def assign_from(
    df: DataFrame, key: list[str], choices: DataFrame, order: str, choice: str, name: str, seed: int = 0
) -> DataFrame:
    """Give every row one of the choices, with replacement, fixed by the row's key and the seed.

    ``order`` is a unique column of the choices; it numbers them.
    """
    listed = numbered(choices.select(F.col(choice).alias(name), order), [order], "_i").drop(order)
    n = choices.count()
    return df.withColumn("_i", key_hash(*key, seed=seed) % max(n, 1)).join(listed, "_i").drop("_i")


def hash_share(df: DataFrame, key: list[str], share: float, seed: int = 0) -> DataFrame:
    """A fixed random share of the rows, the same on every run."""
    return df.filter(key_hash(*key, seed=seed) < int(share * (1 << 32)))
