"""Data preparation: joins, counts, group profiles, samples, clean-up."""

from __future__ import annotations

from pyspark.sql import functions as F

from annalist.functions import text as tx
from annalist.functions.user import map_parallel
from annalist.operators import prep
from annalist.plans.registered import registered, table


@registered(
    "join_same_name",
    """
    SELECT l.l_orderkey, l.l_linenumber, o.o_orderstatus FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey
    """,
)
def join_same_name(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_orderstatus")
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber")
    return prep.join_same(lines, orders, "l_orderkey")


@registered(
    "dim_join_twice",
    """
    SELECT nc.n_name AS n_name_customer, ns.n_name AS n_name_supplier, count(*) AS n,
           round(sum(l_quantity), 2) AS quantity
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
      JOIN supplier ON l_suppkey = s_suppkey
      JOIN nation nc ON c_nationkey = nc.n_nationkey JOIN nation ns ON s_nationkey = ns.n_nationkey
    GROUP BY 1, 2
    """,
)
def dim_join_twice(spark, sf_dir):
    """One dimension joined twice under different suffixes."""
    fact = (
        table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey", "l_quantity")
        .join(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
        .join(table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
        .join(table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey"), F.col("l_suppkey") == F.col("s_suppkey"))
    )
    nation = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    fact = prep.join_dimension(fact, nation, "c_nationkey", "n_nationkey", "_customer")
    fact = prep.join_dimension(fact, nation, "s_nationkey", "n_nationkey", "_supplier")
    return fact.groupBy("n_name_customer", "n_name_supplier").agg(
        F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("quantity")
    )


@registered(
    "semi_frequent",
    """
    SELECT c_custkey, c_name FROM customer WHERE c_custkey IN
      (SELECT o_custkey FROM orders GROUP BY 1 HAVING count(o_orderkey) > 5)
    """,
)
def semi_frequent(spark, sf_dir):
    """Customers with more than five orders."""
    frequent = prep.group_counts(table(spark, sf_dir, "orders"), "o_custkey", "o_orderkey", more_than=5)
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_name")
    return prep.only_in(customers, "c_custkey", frequent, "o_custkey")


@registered(
    "anti_ids",
    "SELECT p_partkey, p_name FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 49)",
)
def anti_ids(spark, sf_dir):
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_name")
    return prep.not_in(parts, "p_partkey", table(spark, sf_dir, "lineitem").filter("l_quantity > 49"), "l_partkey")


@registered(
    "left_join_keeps",
    "SELECT c_custkey, count(o_orderkey) AS orders FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY 1",
)
def left_join_keeps(spark, sf_dir):
    """Per-key results joined back to the full key list; missing ones count 0."""
    counts = prep.group_counts(table(spark, sf_dir, "orders"), "o_custkey", "o_orderkey", name="orders")
    customers = table(spark, sf_dir, "customer").select("c_custkey")
    return customers.join(counts, F.col("c_custkey") == F.col("o_custkey"), "left").select(
        "c_custkey", F.coalesce("orders", F.lit(0)).cast("bigint").alias("orders")
    )


@registered(
    "group_counts",
    "SELECT o_custkey, count(o_orderkey) AS n FROM orders GROUP BY 1",
)
def group_counts(spark, sf_dir):
    return prep.group_counts(table(spark, sf_dir, "orders"), "o_custkey", "o_orderkey")


@registered(
    "attach_group_count",
    """
    SELECT l_orderkey, l_linenumber, n FROM
      (SELECT l_orderkey, l_linenumber, count(l_quantity) OVER (PARTITION BY l_suppkey) AS n FROM lineitem)
    WHERE n > 5
    """,
)
def attach_group_count(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", "l_quantity")
    return prep.with_group_count(lines, "l_suppkey", "l_quantity").filter("n > 5").select(
        "l_orderkey", "l_linenumber", "n"
    )


@registered(
    "user_profile",
    """
    WITH m AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY 1, 2),
         f AS (SELECT user_id, event_type AS favourite_type FROM (
                 SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, event_type) AS rn FROM m) WHERE rn = 1),
         q AS (SELECT user_id, props, count(*) AS n FROM events GROUP BY 1, 2),
         g AS (SELECT user_id, props AS favourite_props FROM (
                 SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, props) AS rn FROM q) WHERE rn = 1),
         s AS (SELECT user_id, count(*) AS size, min(value) AS min, max(value) AS max,
                      round(avg(value), 6) AS mean, min(event_type) AS first_text FROM events GROUP BY 1)
    SELECT s.user_id, size, min, max, mean, first_text, favourite_type, favourite_props
    FROM s LEFT JOIN f ON s.user_id = f.user_id LEFT JOIN g ON s.user_id = g.user_id
    """,
)
def user_profile(spark, sf_dir):
    """Size, extremes, mean and most frequent values per user."""
    profile = prep.group_profile(
        table(spark, sf_dir, "events"), "user_id", "value", "event_type",
        {"favourite_type": "event_type", "favourite_props": "props"},
    )
    return profile.withColumn("mean", F.round("mean", 6))


@registered(
    "sorted_limit",
    "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice, o_orderkey LIMIT 10",
)
def sorted_limit(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice").orderBy("o_totalprice", "o_orderkey").limit(10)


@registered(
    "head_without_nulls",
    """
    SELECT c_custkey, b FROM (
      SELECT c_custkey, CASE WHEN c_acctbal >= 0 THEN c_acctbal END AS b FROM customer ORDER BY c_custkey LIMIT 250)
    WHERE b IS NOT NULL ORDER BY c_custkey LIMIT 200
    """,
)
def head_without_nulls(spark, sf_dir):
    """First 250 rows, of these the ones without nulls, of these the first 200."""
    rows = table(spark, sf_dir, "customer").select(
        "c_custkey", F.when(F.col("c_acctbal") >= 0, F.col("c_acctbal")).alias("b")
    )
    return prep.sorted_head(rows, [F.col("c_custkey")], 250, 200)


@registered(
    "systematic_sample",
    """
    SELECT o_orderkey, o_totalprice FROM (
      SELECT *, row_number() OVER (ORDER BY o_orderkey) - 1 AS i FROM orders) WHERE i % 100 = 0
    """,
)
def systematic_sample(spark, sf_dir):
    """Every 100th row in key order (the sampling operator itself)."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    return prep.every_nth_row(orders, ["o_orderkey"], 100)


HASH_SQL = "('0x' || substr(sha256('{seed}|' || {key}), 1, 8))::BIGINT"


@registered(
    "random_assignment",
    f"""
    WITH c AS (SELECT row_number() OVER (ORDER BY s_suppkey) - 1 AS i, s_name AS assigned FROM supplier)
    SELECT c_custkey, assigned FROM customer JOIN c
      ON {HASH_SQL.format(seed=0, key='c_custkey')} % (SELECT count(*) FROM supplier) = c.i
    """,
)
def random_assignment(spark, sf_dir):
    """Every customer gets one supplier, with replacement, the same on every run."""
    return prep.assign_from(
        table(spark, sf_dir, "customer").select("c_custkey"), ["c_custkey"],
        table(spark, sf_dir, "supplier"), "s_suppkey", "s_name", "assigned",
    )


@registered(
    "random_share",
    f"SELECT event_id FROM events WHERE {HASH_SQL.format(seed=1, key='event_id')} < {int(0.2 * (1 << 32))}",
)
def random_share(spark, sf_dir):
    """A fixed random fifth of the events (the sampling operator itself)."""
    return prep.hash_share(table(spark, sf_dir, "events"), ["event_id"], 0.2, seed=1).select("event_id")


@registered(
    "clean_fields",
    """
    SELECT c_custkey AS custkey, CASE WHEN c_acctbal < 0 THEN -1 ELSE round(c_acctbal, 2) END AS acct_bal,
           c_nationkey::DOUBLE AS pct, regexp_replace(c_name, '[^a-zA-Z0-9\\s]', '', 'g') AS title,
           CASE c_nationkey WHEN 1 THEN 'Credit card' WHEN 2 THEN 'Cash' WHEN 3 THEN 'No charge'
             WHEN 4 THEN 'Dispute' ELSE 'Unknown' END AS payment,
           split_part(c_name, '#', 1) AS prefix, c_custkey::VARCHAR AS custkey_text
    FROM customer
    """,
)
def clean_fields(spark, sf_dir):
    """Formatted texts back to values: sentinels, percent signs, thousands commas, codes."""
    customer = table(spark, sf_dir, "customer")
    raw = customer.select(
        F.col("c_custkey").alias("CustKey"),
        F.when(F.col("c_acctbal") < 0, "-").otherwise(F.format_number("c_acctbal", 2)).alias("Acct/Bal"),
        F.concat(F.col("c_nationkey").cast("string"), F.lit("%")).alias("pct"),
        F.concat(F.lit('"'), "c_name", F.lit('"')).alias("title"),
        "c_nationkey",
        F.concat("c_name", F.lit("_x")).alias("prefix"),
    )
    raw = raw.toDF(*tx.snake_names(raw.columns))
    return raw.select(
        F.col("cust_key").alias("custkey"),
        tx.number(tx.sentinel(F.col("acct_bal"))).alias("acct_bal"),
        tx.number(F.col("pct")).alias("pct"),
        tx.plain_title(tx.without(F.col("title"), '"')).alias("title"),
        tx.code_label(
            F.col("c_nationkey"), ["Credit card", "Cash", "No charge", "Dispute", "Unknown"]
        ).alias("payment"),
        tx.before(tx.before(F.col("prefix"), "_"), "#").alias("prefix"),
        F.col("cust_key").cast("string").alias("custkey_text"),
    )


@registered(
    "parse_times",
    """
    SELECT event_id, CASE WHEN event_type = 'error' THEN NULL ELSE strftime(ts, '%Y-%m-%d %H:%M:%S') END AS at
    FROM events
    """,
)
def parse_times(spark, sf_dir):
    """Texts to timestamps, null where they are none; then rows with both columns kept."""
    text = F.when(F.col("event_type") == "error", "not a time").otherwise(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))
    parsed = table(spark, sf_dir, "events").select("event_id", F.try_to_timestamp(text).alias("at"))
    return parsed.select("event_id", F.date_format("at", "yyyy-MM-dd HH:mm:ss").alias("at"))


@registered(
    "drop_rows_with_nulls",
    "SELECT doc_id, lang FROM documents WHERE lang <> 'fr' AND n_chars > 100",
)
def drop_rows_with_nulls(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select(
        "doc_id",
        F.when(F.col("lang") != "fr", F.col("lang")).alias("lang"),
        F.when(F.col("n_chars") > 100, F.col("n_chars")).alias("n_chars"),
    )
    return rows.na.drop(subset=["lang", "n_chars"]).drop("n_chars")


@registered(
    "user_function_map",
    "SELECT doc_id, length(text) AS chars, length(text) - length(replace(text, ' ', '')) AS spaces FROM documents",
)
def user_function_map(spark, sf_dir):
    """A user's Python function applied to all rows in parallel."""

    def measure(pdf):
        return pdf.assign(chars=pdf["text"].str.len(), spaces=pdf["text"].str.count(" "))[["doc_id", "chars", "spaces"]]

    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    return map_parallel(documents, measure, "doc_id bigint, chars bigint, spaces bigint")
