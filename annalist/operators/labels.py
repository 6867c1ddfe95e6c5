"""Labelled log streams: selection, label listings, rates over time windows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F


def select_stream(df: DataFrame, labels: str = "labels", **equal: str) -> DataFrame:
    """Lines of the streams whose labels have the given values."""
    tests = [F.col(labels)[k] == F.lit(v) for k, v in equal.items()]
    return df.filter(reduce(Column.__and__, tests)) if tests else df


def label_names(df: DataFrame, labels: str = "labels") -> DataFrame:
    """All label names in use."""
    return df.select(F.explode(F.map_keys(labels)).alias("label")).distinct()


def label_values(df: DataFrame, label: str, labels: str | None = "labels") -> DataFrame:
    """Distinct values of one label, kept in a map column or in a column of its own."""
    value = F.col(labels)[label] if labels else F.col(label)
    return df.select(value.alias("value")).filter(F.col("value").isNotNull()).distinct()


def rate(
    df: DataFrame, time: str, by: list[str], width: str = "10 minutes", slide: str | None = None,
    watermark: str | None = None,
) -> DataFrame:
    """Lines per second over a time range, per window and label values.

    Works on a batch and, with a ``watermark``, on a stream.
    """
    if watermark:
        df = df.withWatermark(time, watermark)
    window = F.window(time, width, slide) if slide else F.window(time, width)
    counts = df.groupBy(window.alias("w"), *by).agg(F.count("*").alias("n"))
    # The width itself: the ends of a window, converted in a zone that changes its clocks, can lie further apart.
    seconds = F.expr(f"unix_micros(timestamp_micros(0) + INTERVAL '{width}') / 1e6D")
    return counts.select(
        F.col("w.start").alias("window_start"), *by, "n", (F.col("n") / seconds).alias("rate")
    )
