"""Typed records, ids, merges and stored tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from annalist.functions.records import coerce_columns, json_object, shape_id, type_tags
from annalist.functions.text import fenced_blocks, first_of_list_literal, header
from annalist.operators.merge import keep_last, merge_fields, upsert
from annalist.operators.entries import SideOutput, log_stream, parse_entries, preamble, records_of
from annalist.plans.registered import registered, table
from annalist.plans.registered.logs import EVENT, event_lines
from annalist.session import scratch_path
from annalist.sources.files import append_dated, list_files, query_from_root, read_csv, read_dataset, read_typed, write_extract
from annalist.sources.tables import VersionedTable, union_all
from annalist.specs import EntitySpec, FieldSpec, text_entry


@registered("json_prop", "SELECT event_id, json_extract(props, '$.k')::BIGINT AS k FROM events")
def json_prop(spark, sf_dir):
    record = json_object(F.col("props"))
    return table(spark, sf_dir, "events").select("event_id", record["k"].try_cast("bigint").alias("k"))


@registered(
    "record_types",
    "SELECT 'web' AS namespace, 'Event' AS type, count(*) AS n FROM events HAVING count(*) > 0",
)
def record_types(spark, sf_dir):
    """Type tags carried by the records of a log."""
    objects = event_lines(spark, sf_dir).select(
        F.explode(F.transform(fenced_blocks(F.col("value")), json_object)).alias("record")
    )
    namespace, kind = type_tags(F.col("record"))
    return objects.groupBy(namespace.alias("namespace"), kind.alias("type")).agg(F.count("*").alias("n"))


@registered(
    "record_problems",
    """
    SELECT event_id,
           CASE event_type WHEN 'error' THEN 'bad value' WHEN 'click' THEN 'missing user_id' END AS problem
    FROM events WHERE event_type IN ('error', 'click')
    """,
)
def record_problems(spark, sf_dir):
    """Records that fail validation: a number that is no number, a required field left out."""
    events = table(spark, sf_dir, "events").withColumn("ts_text", F.lit("t"))
    body = F.to_json(
        F.struct(
            "event_id",
            F.when(F.col("event_type") != "click", F.col("user_id")).alias("user_id"),
            "event_type",
            F.when(F.col("event_type") == "error", "high").otherwise(F.col("value").cast("string")).alias("value"),
            "props",
            "ts_text",
        )
    )
    tagged = events.select(
        F.lit(EVENT.namespace).alias("namespace"), F.lit(EVENT.name).alias("type"), json_object(body).alias("record")
    )
    bad = records_of(tagged, EVENT).filter(F.size("problems") > 0)
    return bad.select("event_id", F.array_join("problems", ", ").alias("problem"))


@registered(
    "anon_types",
    """
    SELECT sha256(array_to_string(list_sort(json_keys(j)), ',')) AS shape, count(*) AS n
    FROM (SELECT CASE WHEN event_type = 'error' THEN '{"z": 1, "a": ' || event_id || '}' ELSE props END AS j FROM events)
    GROUP BY 1
    """,
)
def anon_types(spark, sf_dir):
    """Untyped records grouped by the names of their fields."""
    events = table(spark, sf_dir, "events")
    text = F.when(
        F.col("event_type") == "error",
        F.concat(F.lit('{"z": 1, "a": '), F.col("event_id").cast("string"), F.lit("}")),
    ).otherwise(F.col("props"))
    return events.groupBy(shape_id(text).alias("shape")).agg(F.count("*").alias("n"))


@registered(
    "default_ids",
    """
    SELECT 'doc-' || doc_id AS name,
           coalesce(nullif(CASE lang WHEN 'fr' THEN '' WHEN 'de' THEN NULL ELSE source END, ''), 'doc-' || doc_id) AS id,
           'doc-' || doc_id AS doc_id
    FROM documents
    """,
)
def default_ids(spark, sf_dir):
    spec = text_entry("Document", width=64)
    rows = table(spark, sf_dir, "documents").select(
        F.concat(F.lit("doc-"), F.col("doc_id").cast("string")).alias("name"),
        "text",
        F.when(F.col("lang") == "fr", "").when(F.col("lang") != "de", F.col("source")).alias("id"),
    )
    return coerce_columns(rows, spec).select("name", "id", "doc_id")


LAST_EVENT_SQL = """
    SELECT user_id, event_id, event_type, value FROM (
      SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events)
    WHERE rn = 1
"""


@registered("merge_last_wins", LAST_EVENT_SQL)
def merge_last_wins(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    columns = ("user_id", "event_id", "event_type", "value")
    return keep_last(events, ("user_id",), F.struct("ts", "event_id"), columns)


@registered(
    "table_merge",
    """
    SELECT c_custkey, c_name,
           CASE WHEN c_nationkey < 5 THEN 'N' || c_nationkey WHEN c_acctbal < 1000 THEN 'LOW' ELSE c_mktsegment END AS c_mktsegment
    FROM customer
    UNION ALL SELECT -1, 'nobody', max(c_mktsegment) FROM customer
    """,
)
def table_merge(spark, sf_dir):
    """Three batches merged by key into a stored table; one key is null."""
    customer = table(spark, sf_dir, "customer")
    columns = ["c_custkey", "c_name", "c_mktsegment"]
    stored = VersionedTable(spark, scratch_path(spark, "customer"), ("c_custkey",), buckets=4)
    nobody = customer.agg(F.max("c_mktsegment").alias("c_mktsegment")).select(
        F.lit(None).cast("bigint").alias("c_custkey"), F.lit("nobody").alias("c_name"), "c_mktsegment"
    )
    stored.merge(customer.select(columns).unionByName(nobody))
    low = customer.filter("c_acctbal < 1000").withColumn("c_mktsegment", F.lit("LOW"))
    stored.merge(low.select(columns))
    nation = customer.filter("c_nationkey < 5").withColumn(
        "c_mktsegment", F.concat(F.lit("N"), F.col("c_nationkey").cast("string"))
    )
    twice = nation.withColumn("c_mktsegment", F.lit("first")).withColumn("s", F.lit(1)).unionByName(
        nation.withColumn("s", F.lit(2))
    )
    stored.merge(twice, "s", columns=tuple(columns))
    return stored.rows().withColumn("c_custkey", F.coalesce("c_custkey", F.lit(-1).cast("bigint")))


@registered(
    "vector_upsert",
    """
    SELECT vec_id AS id, label, round(embedding[1]::DOUBLE, 6) AS v0, 'old' AS origin FROM embeddings WHERE label <> 1
    UNION ALL
    SELECT vec_id, label, round(-embedding[1]::DOUBLE, 6), unnest(['new a', 'new b']) FROM embeddings WHERE label = 1
    """,
)
def vector_upsert(spark, sf_dir):
    """Incoming ids replace stored rows; ids repeated within the batch all stay."""
    rows = table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("id"), "label", "embedding", F.lit("old").alias("origin")
    )
    fresh = rows.filter("label = 1").withColumn("embedding", F.transform("embedding", lambda x: -x))
    incoming = fresh.withColumn("origin", F.explode(F.array(F.lit("new a"), F.lit("new b"))))
    return upsert(rows, incoming).select(
        "id", "label", F.round(F.get("embedding", F.lit(0)).cast("double"), 6).alias("v0"), "origin"
    )


@registered(
    "entity_field_merge",
    """
    SELECT coalesce(c.c_custkey, u.k) AS c_custkey, c_name,
           CASE WHEN u.k IS NOT NULL THEN u.n ELSE c_acctbal END AS c_acctbal, c_mktsegment
    FROM customer c FULL JOIN
      (SELECT o_custkey + 100000000 * (o_custkey % 2) AS k, count(*)::DOUBLE AS n FROM orders GROUP BY 1) u
      ON c.c_custkey = u.k
    """,
)
def entity_field_merge(spark, sf_dir):
    """Partial records change only the fields they carry; unknown keys are added."""
    customer = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_acctbal", "c_mktsegment")
    key = F.col("o_custkey") + 100000000 * (F.col("o_custkey") % 2)
    updates = (
        table(spark, sf_dir, "orders")
        .groupBy(key.alias("c_custkey"))
        .agg(F.count("*").cast("double").alias("c_acctbal"))
    )
    return merge_fields(customer, updates, ("c_custkey",))


@registered(
    "replace_on_insert",
    """
    SELECT c_custkey, CASE WHEN c_acctbal > 5000 THEN 'RICH' ELSE c_mktsegment END AS c_mktsegment FROM customer
    """,
)
def replace_on_insert(spark, sf_dir):
    """Key store: an inserted record replaces the one at its key."""
    from annalist.plans.stores import EntityStore

    spec = EntitySpec("customer", (FieldSpec("c_custkey", int, key=True), FieldSpec("c_mktsegment", str)))
    store = EntityStore(spark, scratch_path(spark, "entity"), spec, buckets=4)
    rows = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment", "c_acctbal")
    store.insert(rows.drop("c_acctbal"))
    rich = rows.filter("c_acctbal > 5000").withColumn("c_mktsegment", F.lit("RICH"))
    store.insert(rich.drop("c_acctbal"))
    return store.load()


@registered(
    "union_distinct",
    """
    SELECT 'all' AS how, count(*) AS n FROM
      (SELECT c_nationkey FROM customer UNION ALL SELECT s_nationkey FROM supplier)
    UNION ALL
    SELECT 'distinct', count(*) FROM
      (SELECT c_nationkey FROM customer UNION SELECT s_nationkey FROM supplier)
    """,
)
def union_distinct(spark, sf_dir):
    keys = union_all(
        [
            table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("k")),
            table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("k")),
        ]
    )
    n = F.count("*").alias("n")
    return (
        keys.agg(n).select(F.lit("all").alias("how"), "n")
        .unionByName(keys.distinct().agg(n).select(F.lit("distinct").alias("how"), "n"))
    )


@registered(
    "dataset_formats",
    """
    SELECT f AS format, o_orderstatus, count(*) AS n, round(sum(o_totalprice), 2) AS total
    FROM orders, unnest(['parquet', 'orc', 'json', 'csv']) AS u(f) GROUP BY 1, 2
    """,
)
def dataset_formats(spark, sf_dir):
    """The orders written and read back in each format, chosen by the extension."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    root = scratch_path(spark, "formats")
    parts = []
    for ext in ("parquet", "orc", "json", "csv"):
        write_extract(orders, f"{root}/orders.{ext}")
        rows = read_dataset(spark, f"{root}/orders.{ext}", orders.schema)
        parts.append(rows.withColumn("format", F.lit(ext)))
    return union_all(parts).groupBy("format", "o_orderstatus").agg(
        F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total")
    )


@registered(
    "csv_bad_lines",
    "SELECT p_partkey, p_name, p_retailprice FROM part WHERE p_size <= 25",
)
def csv_bad_lines(spark, sf_dir):
    """CSV in Latin-1 whose malformed lines (a text where a number belongs) are skipped."""
    part = table(spark, sf_dir, "part").select(
        F.when(F.col("p_size") > 25, F.lit("n/a")).otherwise(F.col("p_partkey").cast("string")).alias("p_partkey"),
        "p_name",
        "p_retailprice",
    )
    path = scratch_path(spark, "bad-csv")
    part.write.option("header", True).option("encoding", "ISO-8859-1").csv(path)
    return read_csv(spark, path, "p_partkey bigint, p_name string, p_retailprice double", "ISO-8859-1")


@registered(
    "csv_bad_lines_counted",
    """
    SELECT 'rows' AS way, count(*) AS n FROM part WHERE p_size <= 40 AND p_size <> 7
    UNION ALL SELECT 'count', count(*) FROM part WHERE p_size <= 40 AND p_size <> 7
    UNION ALL SELECT 'names', count(DISTINCT p_name || '\n"é"') FROM part WHERE p_size <= 40 AND p_size <> 7
    UNION ALL SELECT 'filtered', count(*) FROM part WHERE p_size <= 40 AND p_size <> 7 AND p_retailprice > 1000
    """,
)
def csv_bad_lines_counted(spark, sf_dir):
    """CSV with lines of too few fields, of too many, of a wrong type, and quoted line feeds, counted and projected in several ways."""
    part = table(spark, sf_dir, "part").filter("p_name IS NOT NULL")
    quoted = F.concat(F.lit('"'), F.replace(F.concat("p_name", F.lit('\n"é"')), F.lit('"'), F.lit('""')), F.lit('"'))
    price = F.col("p_retailprice").cast("string")
    line = F.when(F.col("p_size") == 7, F.concat_ws(",", F.lit("n/a"), quoted, price))
    line = line.when(F.col("p_size") > 45, F.concat_ws(",", F.col("p_partkey").cast("string"), quoted))
    line = line.when(F.col("p_size") > 40, F.concat_ws(",", F.col("p_partkey").cast("string"), quoted, price, F.lit("more")))
    line = line.otherwise(F.concat_ws(",", F.col("p_partkey").cast("string"), quoted, price))
    path = scratch_path(spark, "lines-csv")
    # Several files, each with its header as its first record.
    body = part.select(line.alias("value")).groupBy((F.xxhash64("value") % 4).alias("part")).agg(F.array_join(F.collect_list("value"), "\n").alias("value"))
    body.select("part", F.concat(F.lit("p_partkey,p_name,p_retailprice\n"), F.col("value"))).write.partitionBy("part").text(path)
    rows = read_csv(spark, f"{path}/part=*", "p_partkey bigint, p_name string, p_retailprice double", multi_line=True)
    ways = {
        "rows": rows.select(F.count(F.struct("*"))), "count": rows.agg(F.count("*")), "names": rows.select("p_name").agg(F.count_distinct("p_name")),
        "filtered": rows.filter("p_retailprice > 1000").agg(F.count("*")),
    }
    return union_all([df.toDF("n").select(F.lit(way).alias("way"), "n") for way, df in ways.items()])


@registered(
    "typed_file_values",
    """
    SELECT c_custkey, hex(encode(c_name)) AS raw, c_nationkey::DOUBLE AS nation, c_acctbal::BIGINT - CASE WHEN c_acctbal::BIGINT::DOUBLE > c_acctbal AND c_acctbal > 0
           THEN 1 WHEN c_acctbal::BIGINT::DOUBLE < c_acctbal AND c_acctbal < 0 THEN -1 ELSE 0 END AS balance
    FROM customer WHERE c_nationkey = 3
    """,
)
def typed_file_values(spark, sf_dir):
    """A stored file read as a type: keys and bytes pass through, numbers are converted, and a filter on the key reaches the file."""
    path = scratch_path(spark, "typed") + ".parquet"
    customer = table(spark, sf_dir, "customer").select(
        F.col("c_custkey").cast("bigint").alias("c_custkey"), F.col("c_name").cast("binary").alias("raw"), F.col("c_nationkey").cast("bigint").alias("nation"),
        F.col("c_acctbal").cast("double").alias("balance"),
    )
    customer.write.parquet(path)
    spec = EntitySpec("Customer", (FieldSpec("c_custkey", int, key=True), FieldSpec("raw", bytes), FieldSpec("nation", float), FieldSpec("balance", int)))
    rows = read_typed(spark, path, spec)
    return rows.filter((F.size("problems") == 0) & (F.col("nation") == 3)).drop("problems").withColumn("raw", F.hex("raw"))


@registered(
    "typed_file_rows",
    "SELECT p_partkey, p_name, p_size::BIGINT AS p_size FROM part",
)
def typed_file_rows(spark, sf_dir):
    """A dataset file read as a declared type; types are coerced and extra columns dropped."""
    spec = EntitySpec(
        "part", (FieldSpec("p_partkey", int, key=True), FieldSpec("p_name", str), FieldSpec("p_size", int))
    )
    rows = coerce_columns(read_dataset(spark, f"{sf_dir}/part.parquet"), spec)
    return rows.filter(F.size("problems") == 0).drop("problems")


@registered(
    "files_under_root",
    "SELECT l_returnflag AS folder, count(*) AS n FROM lineitem GROUP BY 1",
)
def files_under_root(spark, sf_dir):
    """A table kept in several files below a root: listed, then read together."""
    root = scratch_path(spark, "root")
    lineitem = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_returnflag")
    lineitem.write.partitionBy("l_returnflag").parquet(root)
    folder = F.regexp_extract("path", "l_returnflag=([^/]*)/", 1)
    listed = list_files(spark, root, "parquet").select(folder.alias("folder")).distinct()
    counts = query_from_root(spark, root).groupBy("l_returnflag").agg(F.count("*").alias("n"))
    return listed.join(counts, F.col("folder") == F.col("l_returnflag")).select("folder", "n")


@registered(
    "dialogue_by_date",
    """
    SELECT strftime(ts, '%Y-%m-%d') AS event_date, count(*) AS n, round(avg(value), 6) AS confidence
    FROM events GROUP BY 1
    """,
)
def dialogue_by_date(spark, sf_dir):
    """Events appended to a dated table, read back by date."""
    root = scratch_path(spark, "dialogue")
    append_dated(table(spark, sf_dir, "events"), root, "ts")
    return (
        spark.read.parquet(root)
        .groupBy(F.col("event_date").cast("string").alias("event_date"))
        .agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("confidence"))
    )


@registered(
    "anonymous_list_items",
    "SELECT p_partkey, p_brand AS first_item FROM part",
)
def anonymous_list_items(spark, sf_dir):
    """First item of list literals in a text column."""
    literal = F.concat(F.lit("['"), F.col("p_brand"), F.lit("', '"), F.col("p_type"), F.lit("']"))
    return table(spark, sf_dir, "part").select("p_partkey", first_of_list_literal(literal).alias("first_item"))


@registered(
    "emit_log_stream",
    """
    SELECT 'record' AS kind, c_custkey AS custkey, length(c_name) AS name_length FROM customer
    UNION ALL
    SELECT 'text', c_custkey, length(n_name) FROM customer JOIN nation ON c_nationkey = n_nationkey
    WHERE ('0x' || substr(sha256('0|' || c_custkey), 1, 8))::BIGINT < 858993459
    UNION ALL
    SELECT 'text', c_custkey, length(r_name) FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
    WHERE ('0x' || substr(sha256('1|' || c_custkey), 1, 8))::BIGINT < 1288490188
    """,
)
def emit_log_stream(spark, sf_dir):
    """Customers as log lines, a fifth of them followed by a text about their nation, three tenths by one about its region; then parsed back."""
    spec = EntitySpec("Customer", (FieldSpec("c_custkey", int, key=True), FieldSpec("c_name", str)), "trade")
    customer = table(spark, sf_dir, "customer").select("c_custkey", "c_name", F.col("c_nationkey").alias("topic"))
    sections = table(spark, sf_dir, "nation").select(
        F.col("n_nationkey").alias("topic"), F.col("n_name").alias("name"), F.lit("a nation").alias("text")
    )
    start = preamble(F.lit("2024-01-01 00:00:00.000"), "app", "customers", 1)
    told = preamble(F.lit("2024-01-01 00:00:00.000"), "app", "topics", 2)
    places = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    regions = places.select(F.col("n_nationkey").alias("topic"), F.col("r_name").alias("name"), F.lit("a region").alias("text"))
    sides = SideOutput(sections, "topic", told), SideOutput(regions, "topic", told, share=0.3, seed=1)
    lines = log_stream(customer, spec, "c_custkey", start, *sides)
    parsed = parse_entries(lines, "value")
    record = F.get("objects", F.lit(0))
    return parsed.select(
        F.when(F.size("objects") > 0, "record").otherwise("text").alias("kind"),
        F.col("c_custkey").alias("custkey"),
        F.length(F.coalesce(record["c_name"], header(F.col("content")))).cast("bigint").alias("name_length"),
    )
