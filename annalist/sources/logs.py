"""Log sources: text files with their block positions, and saved label-stream responses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

RESPONSE_SCHEMA = (
    "result array<struct<stream: map<string,string>, values: array<array<string>>>>"
)


def read_log_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Lines of log files with file and block; lines of a block stay in file order.

    Only a line feed ends a line, so a lone carriage return stays in the text.
    """
    return (
        spark.read.option("lineSep", "\n")
        .text(path)
        .select(
            F.col("_metadata.file_path").alias("file"),
            F.col("_metadata.file_block_start").alias("block"),
            F.col("value").alias("line"),
        )
    )


def write_log_lines(lines: DataFrame, path: str) -> None:
    """Write column ``value`` as log text."""
    lines.select("value").write.option("lineSep", "\n").text(path)


def read_stream_responses(spark: SparkSession, path: str) -> DataFrame:
    """Saved responses of a label-stream service, one JSON document per line."""
    return stream_values(spark.read.schema(RESPONSE_SCHEMA).json(path))


def stream_values(responses: DataFrame, parse: "callable[[Column], Column] | None" = None) -> DataFrame:
    """One row per stream value: labels, ns (nanoseconds), ts, position and msg.

    ``parse`` maps the message to a column of its own called ``parsed``.
    """
    streams = responses.select(F.explode("result").alias("r"))
    values = streams.select(
        F.col("r.stream").alias("labels"), F.posexplode("r.values").alias("position", "v")
    )
    ns = F.get("v", F.lit(0)).try_cast("bigint")
    out = values.select(
        "labels",
        ns.alias("ns"),
        F.timestamp_micros(F.floor(ns / 1000).cast("bigint")).alias("ts"),
        "position",
        F.get("v", F.lit(1)).alias("msg"),
    )
    return out.withColumn("parsed", parse(F.col("msg"))) if parse else out


def to_responses(df: DataFrame, labels: Column, ns: Column, msg: Column) -> DataFrame:
    """Rows as service responses, one per row, for writing fixtures and replays."""
    value = F.array(ns.cast("string"), msg)
    return df.select(
        F.to_json(
            F.struct(
                F.array(F.struct(labels.alias("stream"), F.array(value).alias("values"))).alias(
                    "result"
                )
            )
        ).alias("value")
    )
