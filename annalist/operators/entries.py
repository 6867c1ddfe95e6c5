"""Parsing assembled entries and routing them to tables; writing records as log lines."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from annalist.functions.records import json_object, record_text, type_tags, typed_records
from annalist.functions.text import (
    DEFAULT_LEVEL,
    entry_id,
    fenced_blocks,
    header,
    short_id,
    strip,
)
from annalist.operators.prep import hash_share
from annalist.specs import EntitySpec, Registry

# Columns that say where an entry came from and order it among the others.
PLACE = ["stream", "run", "entry"]


def parse_entries(entries: DataFrame, text: str = "text", content_in_id: bool = False) -> DataFrame:
    """Split entries at the first two pipes and the first dash after them.

    The preamble parts are stripped, the content is left as it is. Adds id, date, log_level, process_name, module_name, line_number, blocks
    (JSON texts), objects (parsed) and problem, which is null for a good entry.
    One bad block makes the whole entry bad.
    """
    part = lambda c, i: strip(F.get(c, F.lit(i)))
    out = (
        entries.withColumn("_bars", F.split(text, r"\|", 3))
        .withColumn("_rest", F.split(F.get("_bars", F.lit(2)), "-", 2))
        .withColumn("_process", part("_rest", 0))
        .withColumn("_where", F.split("_process", ":"))
        .withColumns(
            {
                "date": part("_bars", 0),
                "log_level": part("_bars", 1),
                "process_name": part("_where", 0),
                "module_name": part("_where", 1),
                "line_number": part("_where", 2).try_cast("bigint"),
                "content": F.coalesce(F.get("_rest", F.lit(1)), F.lit("")),
            }
        )
        .withColumn("blocks", fenced_blocks(F.col("content")))
        .withColumn("objects", F.transform("blocks", json_object))
    )
    more = [F.col("content")] if content_in_id else []
    problem = (
        F.when(F.col("date").isNull() | F.col("log_level").isNull(), "bad preamble")
        .when(F.col("module_name").isNull(), "bad process info")
        .when(F.col("line_number").isNull(), "bad line number")
        .when(F.exists("objects", lambda o: o.isNull()), "bad block")
    )
    return out.withColumns(
        {
            "id": entry_id(F.col("date"), F.col("log_level"), F.col("_process"), *more),
            "problem": problem,
        }
    ).drop("_bars", "_rest", "_process", "_where")


def with_level(parsed: DataFrame, level: str = DEFAULT_LEVEL) -> DataFrame:
    """Entries of one level."""
    return parsed.filter(F.col("log_level") == level)


def first_entries(parsed: DataFrame, limit: int) -> DataFrame:
    """The first ``limit`` entries in log order (a top-k, not a full sort)."""
    return parsed.orderBy(*PLACE).limit(limit)


def routed_rows(parsed: DataFrame, registry: Registry) -> DataFrame:
    """One row per object, per free text and per unusable entry, told apart by ``kind``.

    ``record`` rows have namespace, type and record (a map); ``text`` rows have
    module_name, name and text; ``dead`` rows have text and problem. Staged by
    (kind, namespace, type), every sink reads only its own folder.
    """
    good = F.col("problem").isNull()
    item = F.posexplode_outer(F.when(good, F.col("objects"))).alias("item", "record")
    rows = parsed.select(*PLACE, "date", "module_name", "content", "text", "problem", item)
    namespace, kind = type_tags(F.col("record"))
    known = F.coalesce(registry.is_known(F.col("namespace"), F.col("type")), F.lit(False))
    rows = rows.withColumns({"namespace": namespace, "type": kind}).withColumn(
        "kind",
        F.when(F.col("problem").isNotNull(), "dead")
        .when(F.col("record").isNull(), "text")
        .when(known, "record")
        .otherwise("dead"),
    )
    is_kind = lambda k: F.col("kind") == k
    problem = F.coalesce("problem", F.when(is_kind("dead"), F.lit("unknown type")))
    return rows.select(
        *PLACE,
        "date",
        "item",
        "kind",
        F.when(is_kind("record"), F.col("namespace")).alias("namespace"),
        F.when(is_kind("record"), F.col("type")).alias("type"),
        F.when(is_kind("record"), F.col("record")).alias("record"),
        "module_name",
        F.when(is_kind("text"), header(F.col("content"), short_id(F.col("text")))).alias("name"),
        F.when(is_kind("text"), F.col("content")).when(is_kind("dead"), F.col("text")).alias("text"),
        problem.alias("problem"),
    )


@dataclass
class Routed:
    """Where the entries go: typed objects, free text, and entries that cannot be used."""

    records: DataFrame
    texts: DataFrame
    dead: DataFrame


def by_kind(rows: DataFrame) -> Routed:
    of = lambda k: rows.filter(F.col("kind") == k)
    return Routed(
        of("record").select(*PLACE, "date", "item", "namespace", "type", "record"),
        of("text").select(*PLACE, "module_name", "name", "text"),
        of("dead").select(*PLACE, "text", "problem"),
    )


def route(parsed: DataFrame, registry: Registry) -> Routed:
    """Send objects to their tables and text to the table of the function that logged it.

    The rows are read once per destination: stage them first (as ``plans.ingest``
    does) when they are expensive.
    """
    return by_kind(routed_rows(parsed, registry))


def records_of(routed_records: DataFrame, spec: EntitySpec, keep: list[str] = []) -> DataFrame:
    """The routed records of one type, coerced; ``problems`` is empty for good ones."""
    mine = routed_records.filter(
        (F.col("namespace") == spec.namespace) & (F.col("type") == spec.name)
    )
    return typed_records(mine, "record", spec, keep)


def check_all_good(dead: DataFrame) -> None:
    """Raise on the first entry that cannot be used (the fail-fast mode of ingestion)."""
    first = dead.limit(1).collect()
    if first:
        raise ValueError(f"{first[0]['problem']}: {first[0]['text'][:500]}")


def preamble(
    date: Column, process: Column | str, module: Column | str, line: Column | int,
    level: Column | str = DEFAULT_LEVEL,
) -> Column:
    """Start of a log line: ``date | LEVEL    | process:function:line - ``."""
    as_column = lambda v: v if isinstance(v, Column) else F.lit(v)
    return F.concat(
        date,
        F.lit(" | "),
        F.rpad(as_column(level), 8, " "),
        F.lit(" | "),
        F.concat_ws(":", as_column(process), as_column(module), as_column(line).cast("string")),
        F.lit(" - "),
    )


def log_records(df: DataFrame, spec: EntitySpec, start: Column, keep: list[str] = []) -> DataFrame:
    """Rows of a typed table as log lines in column ``value``."""
    return df.select(*keep, F.concat(start, record_text(df, spec)).alias("value"))


def log_texts(df: DataFrame, name: str, text: str, start: Column, keep: list[str] = []) -> DataFrame:
    """Named texts as (multi-line) log entries in column ``value``."""
    return df.select(
        *keep,
        F.concat(start, F.lit(" ***"), F.col(name), F.lit("***\n"), F.col(text)).alias("value"),
    )


@dataclass(frozen=True)
class SideOutput:
    """Texts logged after a random share of the records: ``sections`` (name, text) that meet the records on the column ``topic``."""

    sections: DataFrame
    topic: str
    start: Column
    share: float = 0.2
    seed: int = 0


def log_stream(
    records: DataFrame, spec: EntitySpec, key: str, start: Column, *sides: SideOutput, limit: int | None = None,
) -> DataFrame:
    """A typed table as a log: one line per record, and after it the texts of each side output that drew the record.

    Each side output draws for itself, so a record may get the texts of several or of none; give them different
    seeds. Result: key, position (0 for the record, then the number of the side output) and value, in which order they
    are to be written. ``limit`` keeps the first records by key.
    """
    if limit is not None:
        records = records.orderBy(key).limit(limit)
    lines = log_records(records, spec, start, [key]).select(key, F.lit(0).alias("position"), "value")
    for number, side in enumerate(sides, 1):
        told = hash_share(records.select(key, side.topic), [key], side.share, side.seed).join(side.sections, side.topic)
        texts = log_texts(told, "name", "text", side.start, [key])
        lines = lines.unionByName(texts.select(key, F.lit(number).alias("position"), "value"))
    return lines
