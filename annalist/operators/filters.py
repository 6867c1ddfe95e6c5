"""Equality and membership filters that chain, and projection."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F


class Query:
    """Chainable AND-combined predicates over a DataFrame.

    ``Query(df).where(a=1).isin(b=[2, 3]).select(["a", "b"])`` is one plan;
    filters and columns reach the Parquet scan.
    """

    def __init__(self, df: DataFrame, predicates: tuple[Column, ...] = ()):
        self._df = df
        self._predicates = predicates

    def where(self, **equal) -> "Query":
        more = tuple(F.col(c).isNull() if v is None else F.col(c) == F.lit(v) for c, v in equal.items())
        return Query(self._df, self._predicates + more)

    def isin(self, **members) -> "Query":
        """A single value counts as a list of one."""
        more = tuple(
            F.col(c).isin(list(v) if isinstance(v, (list, tuple, set)) else [v])
            for c, v in members.items()
        )
        return Query(self._df, self._predicates + more)

    def select(self, fields: list[str] | None = None) -> DataFrame:
        df = self._df
        if self._predicates:
            df = df.filter(reduce(Column.__and__, self._predicates))
        return df.select(*fields) if fields else df
