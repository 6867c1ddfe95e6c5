"""Keyed merge semantics on DataFrames; ``sources.tables`` applies them to stored tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F


def _column(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def keep_last(
    df: DataFrame, keys: tuple[str, ...], seq: str | Column | None = None,
    columns: tuple[str, ...] | None = None,
) -> DataFrame:
    """One row per key: the one with the greatest ``seq``, the whole row taken.

    ``max_by`` combines on the map side, so a key with a third of all rows
    sends one row per task. Equal ``seq`` values are settled by the row's hash.
    """
    columns = columns or df.columns
    order = [F.xxhash64(*columns)] if seq is None else [_column(seq), F.xxhash64(*columns)]
    row = F.struct(*[F.col(c) for c in columns])
    last = F.max_by(row, F.struct(*[o.alias(f"s{i}") for i, o in enumerate(order)]))
    return (
        df.groupBy(*[F.col(k).alias(f"_key_{k}") for k in keys])
        .agg(last.alias("_row"))
        .select("_row.*")
    )


def without_keys(rows: DataFrame, keys: DataFrame, on: tuple[str, ...]) -> DataFrame:
    """Rows whose key does not occur in ``keys``; null equals null."""
    renamed = keys.select(*[F.col(c).alias(f"_in_{c}") for c in on])
    same = [F.col(c).eqNullSafe(F.col(f"_in_{c}")) for c in on]
    return rows.join(renamed, reduce(Column.__and__, same), "left_anti")


def upsert(existing: DataFrame, incoming: DataFrame, id_column: str = "id") -> DataFrame:
    """Existing rows without the incoming ids, plus every incoming row (repeated ids survive)."""
    return without_keys(existing, incoming, (id_column,)).unionByName(incoming)


def merge(
    existing: DataFrame | None, new: DataFrame, keys: tuple[str, ...], seq: str | Column | None = None
) -> DataFrame:
    """Existing then new rows, unique on key, last wins; existing rows are unique already."""
    latest = keep_last(new, keys, seq)
    if existing is None:
        return latest
    return without_keys(existing, latest, keys).unionByName(latest)


def merge_fields(
    existing: DataFrame | None,
    updates: DataFrame,
    keys: tuple[str, ...],
    seq: str | Column | None = None,
    present: str | None = None,
) -> DataFrame:
    """Field-level merge: per field the last value given, else the old one.

    ``present`` names an array column with the fields a record carries, which
    tells an explicit null from an absent field; without it a null is absent.
    """
    fields = [c for c in updates.columns if c not in (*keys, present, seq)]
    order = _column(seq) if seq is not None else F.monotonically_increasing_id()
    ordered = updates.withColumn("_seq", F.struct(order.alias("s"), F.xxhash64(*fields).alias("h")))

    def given(f: str) -> Column:
        return F.array_contains(present, f) if present else F.col(f).isNotNull()

    latest = ordered.groupBy(*keys).agg(
        *[F.max_by(F.col(f), F.when(given(f), F.col("_seq"))).alias(f) for f in fields],
        *[F.max(given(f)).alias(f"_given_{f}") for f in fields],
    )
    if existing is None:
        return latest.select(*keys, *fields)
    same = reduce(Column.__and__, [F.col(f"o.{k}").eqNullSafe(F.col(f"n.{k}")) for k in keys])
    # A null key may be on either side, so the side that has the row is marked.
    old = existing.withColumn("_old", F.lit(True)).alias("o")
    both = old.join(latest.alias("n"), same, "full")
    out = []
    for c in existing.columns:
        if c in keys:
            out.append(F.coalesce(F.col(f"o.{c}"), F.col(f"n.{c}")).alias(c))
        elif c in fields:
            pick = F.when(F.col(f"n._given_{c}"), F.col(f"n.{c}")).otherwise(F.col(f"o.{c}"))
            out.append(pick.alias(c))
        else:
            out.append(F.col(f"o.{c}").alias(c))
    return both.select(*out)
