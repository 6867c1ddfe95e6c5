"""Whole ingestion runs: files and continuous streams into tables, and the flagship question."""

from __future__ import annotations

from dataclasses import replace
from datetime import timedelta

from pyspark.sql import functions as F

from annalist.operators.shapes import most_frequent_with_rows
from annalist.plans.ingest import Ingest
from annalist.plans.registered import registered, table
from annalist.plans.registered.logs import (
    EVENT, as_files, event_lines, event_rows, event_start, nanoseconds, turn_lines,
)
from annalist.plans.registered.questions import MOST_SQL
from annalist.plans.registered.records import LAST_EVENT_SQL
from annalist.operators.entries import log_records
from annalist.session import scratch_path
from annalist.sources.logs import to_responses
from annalist.specs import EntitySpec, Registry
from annalist.streaming.ingest import finish_ingest, read_responses_stream, start_ingest


@registered("ask_ingested_log", MOST_SQL)
def ask_ingested_log(spark, sf_dir):
    """Log files to a keyed table, then: who purchased most, all their purchases, and when last."""
    ingest = Ingest(spark, scratch_path(spark, "ingest"), Registry([EVENT]))
    ingest.files(as_files(spark, event_lines(spark, sf_dir)))
    stored = ingest.table_of(EVENT).rows()
    found = most_frequent_with_rows(stored, "user_id", "ts_text", event_type="purchase")
    return found.select("user_id", "n", "latest", "event_id", "value")


@registered(
    "ingest_routes",
    """
    SELECT 'typed' AS destination, 'Event' AS name, count(*) AS n FROM events WHERE event_type NOT IN ('error', 'signup')
    UNION ALL SELECT 'text', role, count(*) FROM conversations GROUP BY role
    UNION ALL SELECT 'dead', 'bad line number', count(*) FROM events WHERE event_type = 'error'
    UNION ALL SELECT 'dead', 'unknown type', count(*) FROM events WHERE event_type = 'signup'
    """,
)
def ingest_routes(spark, sf_dir):
    """One log with records, texts, records of an unknown type and broken lines: where each entry went."""
    broken = event_rows(spark, sf_dir)
    start = F.when(F.col("event_type") == "error", F.replace(event_start(), F.lit("error:"), F.lit("error:x"))).otherwise(event_start())
    known = log_records(broken.filter("event_type <> 'signup'"), EVENT, start)
    unknown = EntitySpec("Signup", EVENT.fields, "web")
    other = log_records(broken.filter("event_type = 'signup'"), unknown, event_start())
    lines = known.unionByName(other).unionByName(turn_lines(spark, sf_dir))
    ingest = Ingest(spark, scratch_path(spark, "ingest"), Registry([EVENT]))
    ingest.files(as_files(spark, lines))
    n = F.count("*").alias("n")
    typed = ingest.table_of(EVENT).rows().agg(n).select(F.lit("typed").alias("destination"), F.lit("Event").alias("name"), "n")
    texts = ingest.text_table().rows().groupBy(F.col("module_name").alias("name")).agg(n)
    dead = ingest.dead_letters().groupBy(F.col("problem").alias("name")).agg(n)
    return typed.unionByName(texts.select(F.lit("text").alias("destination"), "name", "n")).unionByName(
        dead.select(F.lit("dead").alias("destination"), "name", "n")
    )


def event_stream(spark, sf_dir) -> tuple[EntitySpec, str]:
    """Events as label-stream responses in several files, and their type, keyed by user."""
    by_user = tuple(replace(f, key=f.name == "user_id") for f in EVENT.fields)
    spec = EntitySpec("LastEvent", by_user, "web")
    lines = log_records(event_rows(spark, sf_dir), spec, event_start(), ["event_id", "ts"])
    labels = F.create_map(F.lit("app"), F.lit("web"), F.lit("pod"), F.lit("collector"))
    ns = nanoseconds("ts") + F.col("event_id") % 1000
    folder = scratch_path(spark, "responses")
    to_responses(lines.withColumn("ns", ns), labels, F.col("ns"), F.col("value")).write.text(folder)
    return spec, folder


@registered("stream_ingest", LAST_EVENT_SQL)
def stream_ingest(spark, sf_dir):
    """Events ingested by a stream, its last entry by a call at the end."""
    spec, folder = event_stream(spark, sf_dir)
    ingest = Ingest(spark, scratch_path(spark, "ingest"), Registry([spec]), buckets=4)
    state = scratch_path(spark, "state")
    query = start_ingest(
        read_responses_stream(spark, folder), ingest, state, scratch_path(spark, "checkpoint")
    )
    query.awaitTermination()
    finish_ingest(ingest, state)
    return ingest.table_of(spec).rows().select("user_id", "event_id", "event_type", "value")


@registered("stream_timeout", LAST_EVENT_SQL)
def stream_timeout(spark, sf_dir):
    """Events ingested by a stream that lets out its last entry by itself, a minute after the last line by the clock of the ticks."""
    spec, folder = event_stream(spark, sf_dir)
    clock = scratch_path(spark, "ticks")
    for minute in range(3):
        spark.sql(f"SELECT timestamp '2024-01-01 00:0{minute}:00' AS tick").coalesce(1).write.json(f"{clock}/at={minute}")
    ticks = spark.readStream.schema("tick timestamp").option("maxFilesPerTrigger", 1).json(f"{clock}/at=*")
    ingest = Ingest(spark, scratch_path(spark, "ingest"), Registry([spec]), buckets=4)
    start_ingest(
        read_responses_stream(spark, folder), ingest, scratch_path(spark, "state"), scratch_path(spark, "checkpoint"),
        quiet=timedelta(minutes=1), ticks=ticks,
    ).awaitTermination()
    return ingest.table_of(spec).rows().select("user_id", "event_id", "event_type", "value")
