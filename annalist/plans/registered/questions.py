"""Filters, ad-hoc SQL, question shapes, enumerations and key lookups."""

from __future__ import annotations

from pyspark.sql import functions as F

from annalist.functions.text import as_list
from annalist.operators import lookup, shapes
from annalist.operators.filters import Query
from annalist.operators.profile import distinct_values, enumerated_columns
from annalist.plans.registered import registered, table
from annalist.plans.stores import guarded_sql


@registered(
    "fluent_filter",
    """
    SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem
    WHERE l_returnflag = 'R' AND l_linestatus = 'O' AND l_linenumber IN (1, 3, 5)
    """,
)
def fluent_filter(spark, sf_dir):
    return (
        Query(table(spark, sf_dir, "lineitem"))
        .where(l_returnflag="R")
        .isin(l_linenumber=[1, 3, 5], l_linestatus="O")
        .select(["l_orderkey", "l_linenumber", "l_quantity"])
    )


@registered(
    "adhoc_sql_capped",
    """
    SELECT o_orderkey, o_custkey, o_totalprice FROM orders
    WHERE o_orderdate < CURRENT_DATE ORDER BY o_totalprice DESC, o_orderkey LIMIT 200
    """,
)
def adhoc_sql_capped(spark, sf_dir):
    """Ad-hoc SQL as written by a model: fenced, TABLE for the store, capped at 200 rows."""
    table(spark, sf_dir, "orders").createOrReplaceTempView("orders_store")
    text = """```sql
    SELECT o_orderkey, o_custkey, o_totalprice FROM TABLE
    WHERE o_orderdate < CURRENT_DATE ORDER BY o_totalprice DESC, o_orderkey;
    ```"""
    return guarded_sql(spark, text, "orders_store")


@registered(
    "store_sql",
    """
    SELECT o_orderstatus, o_orderpriority, count(*) AS n, round(avg(o_totalprice), 4) AS mean_price
    FROM orders GROUP BY 1, 2
    """,
)
def store_sql(spark, sf_dir):
    """Any SQL over a file path."""
    return spark.sql(
        "SELECT o_orderstatus, o_orderpriority, count(*) AS n, round(avg(o_totalprice), 4) AS mean_price "
        f"FROM parquet.`{sf_dir}/orders.parquet` GROUP BY 1, 2"
    )


@registered(
    "qs_count_two_filters",
    "SELECT count(*) AS n FROM events WHERE event_type = 'purchase' AND user_id = 7",
)
def qs_count_two_filters(spark, sf_dir):
    return shapes.count_where(table(spark, sf_dir, "events"), event_type="purchase", user_id=7)


MOST_SQL = """
    WITH w AS (SELECT user_id, count(*) AS n, max(ts) AS latest FROM events
               WHERE event_type = 'purchase' GROUP BY 1 ORDER BY n DESC, user_id LIMIT 1)
    SELECT e.user_id, w.n, strftime(w.latest, '%Y-%m-%d %H:%M:%S.%f') AS latest, e.event_id, e.value
    FROM events e JOIN w ON e.user_id = w.user_id WHERE e.event_type = 'purchase'
"""


@registered("qs_most_frequent", MOST_SQL)
def qs_most_frequent(spark, sf_dir):
    found = shapes.most_frequent_with_rows(
        table(spark, sf_dir, "events"), "user_id", "ts", event_type="purchase"
    )
    return found.select(
        "user_id", "n", F.date_format("latest", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("latest"), "event_id", "value"
    )


@registered(
    "qs_last_three",
    "SELECT event_id, event_type FROM events WHERE user_id = 7 ORDER BY ts DESC, event_id DESC LIMIT 3",
)
def qs_last_three(spark, sf_dir):
    return shapes.last_n(table(spark, sf_dir, "events"), "ts", 3, "event_id", user_id=7).select(
        "event_id", "event_type"
    )


@registered(
    "qs_last_three_each",
    """
    SELECT user_id, event_id, rn::INTEGER AS rank FROM (
      SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events)
    WHERE rn <= 3
    """,
)
def qs_last_three_each(spark, sf_dir):
    return shapes.last_n_each(table(spark, sf_dir, "events"), "user_id", "ts", 3, "event_id").select(
        "user_id", "event_id", "rank"
    )


@registered("qs_count_category", "SELECT count(*) AS n FROM orders WHERE o_orderstatus = 'F'")
def qs_count_category(spark, sf_dir):
    return shapes.count_where(table(spark, sf_dir, "orders"), o_orderstatus="F")


@registered(
    "qs_compare_categories",
    "SELECT o_orderpriority, count(*) AS n FROM orders WHERE o_orderstatus = 'O' GROUP BY 1",
)
def qs_compare_categories(spark, sf_dir):
    return shapes.count_by(table(spark, sf_dir, "orders"), "o_orderpriority", o_orderstatus="O")


@registered(
    "qs_rarest_with_who",
    """
    WITH r AS (SELECT c_nationkey, count(*) AS n FROM customer GROUP BY 1 ORDER BY n, c_nationkey LIMIT 1)
    SELECT DISTINCT c.c_nationkey, r.n, c.c_name FROM customer c JOIN r ON c.c_nationkey = r.c_nationkey
    """,
)
def qs_rarest_with_who(spark, sf_dir):
    return shapes.least_frequent_with_who(table(spark, sf_dir, "customer"), "c_nationkey", "c_name")


@registered(
    "qs_top_k",
    "SELECT c_custkey, c_name, c_acctbal FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 3",
)
def qs_top_k(spark, sf_dir):
    top = shapes.top_k(table(spark, sf_dir, "customer"), "c_acctbal", 3, "c_custkey")
    return top.select("c_custkey", "c_name", "c_acctbal")


@registered(
    "qs_lookup_array",
    "SELECT p_partkey, replace(p_name, ' ', '+') AS words FROM part WHERE p_name = 'red widget'",
)
def qs_lookup_array(spark, sf_dir):
    """Point lookup of an array column."""
    part = table(spark, sf_dir, "part").withColumn("words", F.split("p_name", " "))
    found = shapes.lookup_columns(part, "p_name", "red widget", ["p_partkey", "words"])
    return found.withColumn("words", F.array_join("words", "+"))


@registered(
    "qs_largest_group",
    """
    WITH g AS (SELECT source, count(*) AS n FROM documents GROUP BY 1 ORDER BY n DESC, source LIMIT 1)
    SELECT d.source, g.n, d.doc_id FROM documents d JOIN g ON d.source = g.source
    """,
)
def qs_largest_group(spark, sf_dir):
    return shapes.largest_group(table(spark, sf_dir, "documents"), "source", "doc_id")


@registered(
    "qs_argmax_attributes",
    """
    SELECT c_custkey, c_name, c_mktsegment, o_totalprice FROM customer JOIN
      (SELECT o_custkey, o_totalprice FROM orders WHERE o_orderpriority = '1-URGENT'
       ORDER BY o_totalprice DESC, o_orderkey LIMIT 1) ON c_custkey = o_custkey
    """,
)
def qs_argmax_attributes(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").withColumnRenamed("o_custkey", "c_custkey")
    best = shapes.best_for_item(
        orders, "c_custkey", "o_totalprice", "o_orderkey", table(spark, sf_dir, "customer"),
        o_orderpriority="1-URGENT",
    )
    return best.select("c_custkey", "c_name", "c_mktsegment", "o_totalprice")


@registered(
    "qs_argmax_each",
    """
    SELECT l_partkey, l_extendedprice, s_suppkey, s_name FROM supplier JOIN
      (SELECT l_partkey, l_suppkey, l_extendedprice, row_number() OVER
         (PARTITION BY l_partkey ORDER BY l_extendedprice DESC, l_suppkey) AS rn FROM lineitem)
      ON s_suppkey = l_suppkey WHERE rn = 1
    """,
)
def qs_argmax_each(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").withColumnRenamed("l_suppkey", "s_suppkey")
    best = shapes.best_for_each_item(
        lines, "l_partkey", "s_suppkey", "l_extendedprice", F.col("s_suppkey"), table(spark, sf_dir, "supplier")
    )
    return best.select("l_partkey", "l_extendedprice", "s_suppkey", "s_name")


@registered(
    "qs_projection_limit",
    "SELECT p_partkey, p_name FROM part ORDER BY p_partkey LIMIT 5",
)
def qs_projection_limit(spark, sf_dir):
    return table(spark, sf_dir, "part").orderBy("p_partkey").select("p_partkey", "p_name").limit(5)


ENUM_TABLES = {
    "customer": ["c_name", "c_mktsegment"],
    "orders": ["o_orderstatus", "o_orderpriority"],
    "part": ["p_name", "p_brand", "p_type"],
    "events": ["event_type", "props"],
    "documents": ["text", "lang", "source"],
}
ENUM_SQL = " UNION ALL ".join(
    f"SELECT '{t}' AS \"table\", '{c}' AS \"column\", {c} AS value FROM {t} "
    f"WHERE (SELECT count(DISTINCT {c}) + max(CASE WHEN {c} IS NULL THEN 1 ELSE 0 END) FROM {t}) < 200 "
    f"AND (SELECT avg(strlen({c})) FROM {t}) <= 100 GROUP BY {c}"
    for t, columns in ENUM_TABLES.items()
    for c in columns
)


@registered("enum_profile", ENUM_SQL)
def enum_profile(spark, sf_dir):
    """Enumerated text columns of several tables, with their values."""
    found = None
    for t in ENUM_TABLES:
        rows = enumerated_columns(table(spark, sf_dir, t)).select(F.lit(t).alias("table"), "column", "value")
        found = rows if found is None else found.unionByName(rows)
    return found


@registered("distinct_column", "SELECT DISTINCT p_brand FROM part")
def distinct_column(spark, sf_dir):
    return distinct_values(table(spark, sf_dir, "part"), "p_brand")


@registered(
    "key_lookup",
    """
    SELECT o_orderkey, key, c_acctbal, c_mktsegment FROM (
      SELECT o_orderkey, unnest(['Customer#' || lpad(o_custkey::VARCHAR, 9, '0'), 'order ' || o_orderkey]) AS key
      FROM orders) LEFT JOIN customer ON c_name = key
    """,
)
def key_lookup(spark, sf_dir):
    """Comma lists of quoted keys, one per order; unknown keys stay with nulls."""
    name = F.concat(F.lit("Customer#"), F.lpad(F.col("o_custkey").cast("string"), 9, "0"))
    text = F.concat(F.lit(' "'), name, F.lit("\" ,'order "), F.col("o_orderkey").cast("string"), F.lit("'\n"))
    lists = table(spark, sf_dir, "orders").select("o_orderkey", text.alias("keys"))
    found = lookup.fetch(
        lookup.keys_of(lists, "keys", ["o_orderkey"]), table(spark, sf_dir, "customer"), "c_name"
    )
    return found.select("o_orderkey", "key", "c_acctbal", "c_mktsegment")


@registered(
    "key_exists",
    "SELECT DISTINCT o_custkey AS key FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)",
)
def key_exists(spark, sf_dir):
    keys = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("key")).distinct()
    return lookup.exists(keys, table(spark, sf_dir, "customer").filter("c_acctbal < 0"), "c_custkey")


@registered(
    "typed_keys",
    """
    SELECT kind, key, name FROM (
      SELECT 'customer' AS kind, c_custkey AS key, c_name AS name FROM customer
      UNION ALL SELECT 'supplier', s_suppkey, s_name FROM supplier)
    """,
)
def typed_keys(spark, sf_dir):
    """Records of two types under the same key values, kept apart by their type."""
    of = lambda t, k, n: table(spark, sf_dir, t).select(
        lookup.typed_key(F.lit("default"), F.lit(t), F.col(k)).alias("id"), F.col(n).alias("name")
    )
    records = of("customer", "c_custkey", "c_name").unionByName(of("supplier", "s_suppkey", "s_name"))
    wanted = records.select("id").distinct()
    found = wanted.join(records, "id", "left")
    return found.select(F.col("id.type").alias("kind"), F.col("id.key").alias("key"), "name")


@registered(
    "list_values",
    "SELECT event_id, NULL::VARCHAR AS items FROM events WHERE event_type = 'error' "
    "UNION ALL SELECT event_id, event_type || '/' || user_id FROM events WHERE event_type <> 'error'",
)
def list_values(spark, sf_dir):
    """Text to a list, null when it is no list."""
    text = F.when(F.col("event_type") == "error", "oops").otherwise(
        F.concat(F.lit("['"), F.col("event_type"), F.lit("', '"), F.col("user_id").cast("string"), F.lit("']"))
    )
    return table(spark, sf_dir, "events").select("event_id", F.array_join(as_list(text), "/").alias("items"))
