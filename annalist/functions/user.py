"""User functions applied to data in parallel."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import DataType


def map_parallel(df: DataFrame, function: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """Apply a function to Arrow batches of rows, in as many tasks as the data has partitions."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield function(pdf)

    return df.mapInPandas(run, schema)


def value_parser(function: Callable[[str], object], kind: str | DataType) -> Callable[[Column], Column]:
    """A per-value parser as a column function, run on Arrow batches."""

    @F.pandas_udf(kind)
    def _parse(values: pd.Series) -> pd.Series:
        return values.map(function, na_action="ignore")

    return _parse
