"""The question shapes a store answers: counts, winners, latest rows, extremes.

Every group-wise answer combines on the map side first, so a key that holds a
large share of the rows sends a few rows per task. Winners are joined back as a
broadcast only where they are one row by construction (``limit(1)``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from annalist.operators.filters import Query


def count_where(df: DataFrame, **equal) -> DataFrame:
    """How many rows match all the given values."""
    return Query(df).where(**equal).select().agg(F.count("*").alias("n"))


def count_by(df: DataFrame, category: str, **equal) -> DataFrame:
    """Rows per category value within a filter."""
    return Query(df).where(**equal).select().groupBy(category).agg(F.count("*").alias("n"))


def most_frequent_with_rows(df: DataFrame, who: str, time: str, **equal) -> DataFrame:
    """Who occurs most often within a filter, with all their rows, their count and latest time."""
    rows = Query(df).where(**equal).select()
    winner = (
        rows.groupBy(who)
        .agg(F.count("*").alias("n"), F.max(time).alias("latest"))
        .orderBy(F.desc("n"), who)
        .limit(1)
    )
    return rows.join(F.broadcast(winner), who)


def least_frequent_with_who(df: DataFrame, value: str, who: str) -> DataFrame:
    """The rarest value, how often it occurs, and everyone who has it."""
    rarest = df.groupBy(value).agg(F.count("*").alias("n")).orderBy("n", value).limit(1)
    return df.join(F.broadcast(rarest), value).select(value, "n", who).distinct()


def last_n(df: DataFrame, time: str, n: int = 3, tie: str | None = None, **equal) -> DataFrame:
    """The last ``n`` rows by time within a filter (top-k, no full sort)."""
    order = [F.desc(time)] + ([F.desc(tie)] if tie else [])
    return Query(df).where(**equal).select().orderBy(*order).limit(n)


def last_n_each(df: DataFrame, key: str, time: str, n: int = 3, tie: str | None = None) -> DataFrame:
    """The last ``n`` rows by time of every key, with their rank.

    Spark limits each group before the shuffle (WindowGroupLimit), so a hot key
    costs ``n`` rows per task.
    """
    order = [F.desc(time)] + ([F.desc(tie)] if tie else [])
    rank = F.row_number().over(W.partitionBy(key).orderBy(*order))
    return df.withColumn("rank", rank).filter(F.col("rank") <= n)


def top_k(df: DataFrame, measure: str, k: int, tie: str, ascending: bool = False) -> DataFrame:
    """The ``k`` rows with the largest (or smallest) measure."""
    order = F.asc_nulls_last(measure) if ascending else F.desc_nulls_last(measure)
    return df.orderBy(order, tie).limit(k)


def lookup_columns(df: DataFrame, key: str, value, columns: list[str]) -> DataFrame:
    """Chosen columns of one key; text equality keeps trailing spaces."""
    return df.filter(F.col(key) == F.lit(value)).select(*columns)


def largest_group(df: DataFrame, group: str, member: str) -> DataFrame:
    """The group with the most rows and its members, one row per member.

    The members stay rows: a list of the largest group would not fit one task.
    """
    largest = df.groupBy(group).agg(F.count("*").alias("n")).orderBy(F.desc("n"), group).limit(1)
    return df.join(F.broadcast(largest), group).select(group, "n", member)


def best_for_item(
    scores: DataFrame, who: str, score: str, tie: str, people: DataFrame, **item
) -> DataFrame:
    """Who gave the item its highest score, with all their attributes."""
    best = (
        Query(scores).where(**item).select().orderBy(F.desc_nulls_last(score), tie).limit(1)
        .select(who, score)
    )
    return people.join(F.broadcast(best), who)


def best_for_each_item(
    scores: DataFrame, item: str, who: str, score: str, tie: Column, people: DataFrame
) -> DataFrame:
    """For every item, who gave it its highest score, with all their attributes."""
    best = scores.groupBy(item).agg(
        F.max(score).alias(score), F.min_by(F.col(who), F.struct(-F.col(score), tie)).alias(who)
    )
    return best.join(people, who)
