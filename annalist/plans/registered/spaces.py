"""Spaces: views, copies, replaced windows, the catalog, usage edges."""

from __future__ import annotations

from pyspark.sql import functions as F

from annalist.operators.spaces import (
    Space, replace_window, space_copy, space_view, store_catalog, subscription_type, usage_edges,
)
from annalist.plans.registered import registered, table
from annalist.plans.registered.vectors import EMBED_SQL
from annalist.plans.stores import ColumnarStore, VectorStore
from annalist.session import scratch_path
from annalist.sources.tables import VersionedTable
from annalist.specs import EntitySpec, FieldSpec, text_entry

SPACE = Space(
    "january_errors", date_from="2024-01-02", date_to="2024-01-20", metadata={"event_type": ["error", "click"]}
)
SPACE_SQL = """
    SELECT event_id, user_id, event_type FROM events
    WHERE ts >= '2024-01-02' AND ts < '2024-01-20' AND event_type IN ('error', 'click')
"""


@registered("space_view", SPACE_SQL)
def view(spark, sf_dir):
    space_view(table(spark, sf_dir, "events"), SPACE, "ts")
    return spark.sql("SELECT event_id, user_id, event_type FROM january_errors")


@registered("space_copy", SPACE_SQL)
def copy(spark, sf_dir):
    stored = VersionedTable(spark, scratch_path(spark, "space"), ("event_id",), buckets=4)
    return space_copy(table(spark, sf_dir, "events"), SPACE, stored, "ts").select("event_id", "user_id", "event_type")


@registered(
    "space_replace_window",
    """
    SELECT event_id, CASE WHEN ts::DATE IN (SELECT max(ts::DATE) FROM events) THEN 'new' ELSE 'old' END AS origin
    FROM events WHERE ts::DATE <> (SELECT max(ts::DATE) FROM events) OR event_type <> 'error'
    """,
)
def replaced(spark, sf_dir):
    """The last date of a dated table is replaced by its rows without errors."""
    events = table(spark, sf_dir, "events").select("event_id", "ts", "event_type")
    stored = VersionedTable(spark, scratch_path(spark, "dated"), ("event_id",), partition_by=("event_date",))
    dated = events.withColumn("origin", F.lit("old")).withColumn("event_date", F.to_date("ts"))
    stored.overwrite(dated)
    last = events.agg(F.max(F.to_date("ts")).alias("d")).first()["d"]
    window = events.filter((F.to_date("ts") == F.lit(last)) & (F.col("event_type") != "error"))
    replace_window(stored, window.withColumn("origin", F.lit("new")), "ts")
    return stored.rows().select("event_id", "origin")


@registered(
    "store_catalog",
    """
    SELECT * FROM (VALUES ('columnar', 'trade', 'customer'), ('columnar', 'trade', 'part'), ('vector', 'default', 'Document'))
      AS t(mode, namespace, name)
    """,
)
def catalog(spark, sf_dir):
    """Stores found by the path convention after some were written."""
    root = scratch_path(spark, "stores")
    for name, key in (("customer", "c_custkey"), ("part", "p_partkey")):
        rows = table(spark, sf_dir, name)
        fields = tuple(FieldSpec(f.name, f.dataType, key=f.name == key) for f in rows.schema)
        ColumnarStore(spark, root, EntitySpec(name, fields, "trade"), buckets=4).add(rows)
    documents = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("name"), "text")
    VectorStore(spark, root, text_entry("Document", width=64), buckets=4).add(documents)
    return store_catalog(spark, root)


@registered(
    "usage_edges",
    """
    SELECT role AS source_node_id, next_role AS target_node_id, count(*) AS n, round(avg(chars), 6) AS confidence
    FROM (SELECT role, lead(role) OVER (PARTITION BY conv_id ORDER BY turn) AS next_role, length(text) AS chars
          FROM conversations)
    WHERE next_role IS NOT NULL GROUP BY 1, 2
    """,
)
def edges(spark, sf_dir):
    """Who speaks after whom. Each turn meets the next by its number, so a long conversation is no hot key."""
    turns = table(spark, sf_dir, "conversations")
    following = turns.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("role").alias("target_node_id"))
    events = turns.join(following, ["conv_id", "turn"]).select(
        F.col("role").alias("source_node_id"), "target_node_id", F.length("text").alias("confidence")
    )
    return usage_edges(events).withColumn("confidence", F.round("confidence", 6))


@registered(
    "space_search",
    f"""
    WITH subs AS (SELECT source || '/' || lang AS name, min(text) AS text FROM documents GROUP BY source, lang),
         q AS (SELECT '?' AS name, text FROM benchmark ORDER BY item_id LIMIT 1),
         both_texts AS (SELECT * FROM subs UNION ALL SELECT * FROM q),
         {EMBED_SQL.format(source='both_texts')},
         unit AS (SELECT p.name, place, (x / norm)::FLOAT::DOUBLE AS u FROM places p JOIN norms n ON p.name = n.name),
         qu AS (SELECT place, u FROM unit WHERE name = '?')
    SELECT u.name AS id, round((SELECT sum(u * u) FROM qu) + sum(u.u * u.u) - 2 * sum(u.u * coalesce(qu.u, 0)), 4) AS distance
    FROM unit u LEFT JOIN qu ON u.place = qu.place WHERE u.name <> '?'
    GROUP BY u.name
    ORDER BY round((SELECT sum(u * u) FROM qu) + sum(u.u * u.u) - 2 * sum(u.u * coalesce(qu.u, 0)), 9), u.name LIMIT 3
    """,
)
def space_search(spark, sf_dir):
    """Subscriptions, one per source and language of the documents, searched by text."""
    subscriptions = (
        table(spark, sf_dir, "documents")
        .groupBy("source", "lang")
        .agg(F.min("text").alias("text"))
        .select(F.concat_ws("/", "source", "lang").alias("name"), "text", F.lit("vector").alias("store_type"))
    )
    store = VectorStore(spark, scratch_path(spark, "spaces"), subscription_type(64), buckets=4)
    store.add(subscriptions)
    question = table(spark, sf_dir, "benchmark").orderBy("item_id").first()["text"]
    return store.search(question).select("id", F.round("_distance", 4).alias("distance"))
