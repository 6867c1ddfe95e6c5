"""Stores: files ingested, rows fetched, planned and asked, records by key."""

from __future__ import annotations

import datetime

from pyspark.sql import functions as F

from annalist.functions.records import apply_cleaners
from annalist.functions.text import fenced_blocks
from annalist.plans.registered import registered, table
from annalist.plans.stores import ColumnarStore, EntityStore, VectorStore
from annalist.session import scratch_path
from annalist.sources.files import read_if_exists, write_extract
from annalist.sources.tables import union_all
from annalist.specs import EntitySpec, FieldSpec, text_entry

CUSTOMER = EntitySpec(
    "Customer", (FieldSpec("c_custkey", int, key=True), FieldSpec("c_name", str), FieldSpec("c_acctbal", float), FieldSpec("c_nationkey", int)), "trade"
)


def customers(spark, sf_dir):
    return table(spark, sf_dir, "customer").select(*CUSTOMER.columns[:3], F.col("c_nationkey").cast("bigint").alias("c_nationkey"))


def customer_store(spark, sf_dir) -> ColumnarStore:
    store = ColumnarStore(spark, scratch_path(spark, "store"), CUSTOMER)
    store.add(customers(spark, sf_dir))
    return store


@registered(
    "store_ingest_file",
    """
    SELECT 'stored' AS part, count(*) AS n, round(sum(c_acctbal), 2) AS total FROM customer WHERE c_nationkey <> 7
    UNION ALL SELECT 'rejected', count(*), round(sum(c_acctbal), 2) FROM customer WHERE c_nationkey = 7
    """,
)
def store_ingest_file(spark, sf_dir):
    """A CSV file read as a type into a store, twice; rows whose nation is no number are handed back."""
    rows = customers(spark, sf_dir).withColumn("c_nationkey", F.when(F.col("c_nationkey") == 7, "seven").otherwise(F.col("c_nationkey").cast("string")))
    path = scratch_path(spark, "file") + ".csv"
    write_extract(rows, path)
    store = ColumnarStore(spark, scratch_path(spark, "store"), CUSTOMER)
    store.ingest(path)
    bad = store.ingest(path)
    total = [F.count("*").alias("n"), F.round(F.sum("c_acctbal"), 2).alias("total")]
    return store.load().agg(*total).select(F.lit("stored").alias("part"), "n", "total").unionByName(
        bad.agg(*total).select(F.lit("rejected").alias("part"), "n", "total")
    )


@registered(
    "read_if_there",
    "SELECT 'region' AS name, count(*) AS n FROM region UNION ALL SELECT 'nation', count(*) FROM nation",
)
def read_if_there(spark, sf_dir):
    """Datasets of which some do not exist; a missing one is left out."""
    found = {n: read_if_exists(spark, f"{sf_dir}/{n}.parquet") for n in ("region", "no_such_table", "nation")}
    return union_all([df.agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n") for name, df in found.items() if df is not None])


@registered(
    "store_samples",
    "SELECT way, least(count(*), most) AS n, true AS stored FROM customer, (VALUES ('fetch', 10), ('load', 25)) AS w(way, most) GROUP BY way, most",
)
def store_samples(spark, sf_dir):
    """Some rows of a store: a typed sample of ten, and the first so many; all of them are stored rows."""
    store = customer_store(spark, sf_dir)
    parts = []
    for way, rows in (("fetch", store.fetch()), ("load", store.load(25))):
        both = rows.alias("s").join(customers(spark, sf_dir).alias("c"), "c_custkey", "left")
        same = F.bool_and(F.col("s.c_name").eqNullSafe(F.col("c.c_name")) & F.col("s.c_acctbal").eqNullSafe(F.col("c.c_acctbal")))
        parts.append(both.agg(F.count("*").alias("n"), same.alias("stored")).select(F.lit(way).alias("way"), "n", "stored"))
    return union_all(parts)


@registered(
    "store_query_views",
    """
    SELECT 'Customer' AS view, c_nationkey::VARCHAR AS name, count(*) AS n FROM customer GROUP BY c_nationkey
    UNION ALL SELECT 'dataset', 'item-' || item_id, length(text) FROM benchmark
    """,
)
def store_query_views(spark, sf_dir):
    """SQL over a columnar store by its type's name, and over the columns of a vector store as ``dataset``."""
    by_nation = customer_store(spark, sf_dir).query(
        "SELECT 'Customer' AS view, cast(c_nationkey AS string) AS name, count(*) AS n FROM Customer GROUP BY c_nationkey"
    )
    notes = VectorStore(spark, scratch_path(spark, "notes"), text_entry("Note", width=64))
    notes.add(table(spark, sf_dir, "benchmark").select(F.concat(F.lit("item-"), F.col("item_id").cast("string")).alias("name"), "text"))
    return by_nation.unionByName(notes.query("SELECT 'dataset' AS view, id AS name, cast(length(text) AS bigint) AS n FROM dataset"))


@registered(
    "store_created_and_planned",
    """
    SELECT 'created' AS step, 0 AS n, NULL::DOUBLE AS total
    UNION ALL SELECT 'planned', count(*), round(sum(CASE WHEN c_nationkey < 5 THEN 0 ELSE c_acctbal END), 2) FROM customer
    UNION ALL SELECT 'stored', count(*), round(sum(c_acctbal), 2) FROM customer
    """,
)
def store_created_and_planned(spark, sf_dir):
    """A store made empty from its type, filled, and then a merge that is only planned and changes nothing."""
    store = ColumnarStore(spark, scratch_path(spark, "store"), CUSTOMER)
    store.table.create(CUSTOMER.schema)
    total = [F.count("*").alias("n"), F.round(F.sum("c_acctbal"), 2).alias("total")]
    step = lambda name, df: df.agg(*total).select(F.lit(name).alias("step"), "n", "total")
    # The rows of a version stay what they are.
    created = store.load()
    store.add(customers(spark, sf_dir))
    planned = store.add(customers(spark, sf_dir).filter("c_nationkey < 5").withColumn("c_acctbal", F.lit(0.0)), plan=True)
    return union_all([step("created", created), step("planned", planned), step("stored", store.load())])


@registered(
    "entity_get",
    """
    SELECT 'customer' || c_custkey AS key, c_name, c_acctbal FROM customer WHERE c_custkey IN (SELECT max(c_custkey) FROM customer)
    UNION ALL SELECT 'unknown', NULL, NULL
    """,
)
def entity_get(spark, sf_dir):
    """A record by key, and nulls for a key that is not there."""
    store = EntityStore(spark, scratch_path(spark, "entities"), CUSTOMER)
    store.insert(customers(spark, sf_dir))
    known = customers(spark, sf_dir).agg(F.max("c_custkey")).first()[0]
    found = store.get(known).select(F.concat(F.lit("customer"), F.col("c_custkey").cast("string")).alias("key"), "c_name", "c_acctbal")
    absent = store.get(-5).select("c_name", "c_acctbal")
    missing = spark.sql("SELECT 'unknown' AS key").join(absent, F.lit(True), "left")
    return found.unionByName(missing)


@registered(
    "fenced_blocks_by_tag",
    """
    SELECT p_partkey, ' ' || p_name AS python, 'json {"size": ' || p_size || '}' AS other FROM part
    """,
)
def fenced_blocks_by_tag(spark, sf_dir):
    """Blocks in fences taken by another tag than JSON's: that tag is cut off, a block of another tag keeps its own."""
    text = F.concat(
        F.lit("see ```python "), F.col("p_name"), F.lit("``` and ```json {\"size\": "), F.col("p_size").cast("string"), F.lit("}``` end"),
    )
    blocks = fenced_blocks(text, tag="python")
    return table(spark, sf_dir, "part").select("p_partkey", F.get(blocks, F.lit(0)).alias("python"), F.get(blocks, F.lit(1)).alias("other"))


@registered(
    "typed_and_cleaned",
    """
    SELECT o_orderkey, upper(trim(o_orderstatus)) AS status, o_orderdate::DATE::VARCHAR AS day, o_orderpriority || '|' || o_orderstatus AS labels,
           CASE WHEN o_totalprice >= 1000 THEN o_totalprice END AS total
    FROM orders
    """,
)
def typed_and_cleaned(spark, sf_dir):
    """JSON read by the schema that a type gives (optional, list and date fields), then the type's cleaners."""
    spec = EntitySpec(
        "Order",
        (
            FieldSpec("o_orderkey", int, key=True), FieldSpec("status", str), FieldSpec("day", datetime.date, required=False),
            FieldSpec("labels", list[str], required=False), FieldSpec("total", float | None, required=False),
        ),
        cleaners={"status": lambda c: F.upper(F.trim(c)), "total": lambda c: F.when(c >= 1000, c)},
    )
    day = F.col("o_orderdate").cast("date").alias("day")
    rows = table(spark, sf_dir, "orders").select(
        F.to_json(F.struct(
            "o_orderkey", F.concat(F.lit(" "), F.lower("o_orderstatus")).alias("status"), day, F.array("o_orderpriority", "o_orderstatus").alias("labels"),
            F.col("o_totalprice").alias("total"),
        )).alias("json")
    )
    typed = rows.select(F.from_json("json", spec.schema).alias("r")).select("r.*")
    return apply_cleaners(typed, spec).withColumns({"labels": F.array_join("labels", "|"), "day": F.col("day").cast("string")})
