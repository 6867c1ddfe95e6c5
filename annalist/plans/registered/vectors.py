"""Embedding, nearest neighbours, retrieval."""

from __future__ import annotations

from pyspark.sql import functions as F

from annalist.functions.vectors import HashingEmbedder, squared_l2, with_vectors
from annalist.operators.nearest import ClusteredIndex, check_width, nearest, nearest_join, passages_for
from annalist.operators.shapes import top_k
from annalist.plans.registered import registered, table
from annalist.plans.stores import VectorStore
from annalist.session import scratch_path
from annalist.specs import text_entry

WIDTH = 64


def vectors(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), "label"
    )


def first_vector(spark, sf_dir) -> list[float]:
    """The question: the vector with the smallest id."""
    return vectors(spark, sf_dir).orderBy("id").select("vector").first()["vector"]


L2SQ = "round(list_distance({a}::DOUBLE[], {b}::DOUBLE[]) ^ 2, 6)"
FIRST = "(SELECT embedding FROM embeddings ORDER BY vec_id LIMIT 1)"


@registered(
    "knn_exact",
    f"""
    SELECT vec_id AS id, label, {L2SQ.format(a='embedding', b=FIRST)} AS distance
    FROM embeddings ORDER BY list_distance(embedding::DOUBLE[], {FIRST}::DOUBLE[]), vec_id LIMIT 10
    """,
)
def knn_exact(spark, sf_dir):
    found = nearest(vectors(spark, sf_dir), first_vector(spark, sf_dir), 10, columns=("label",))
    return found.select("id", "label", F.round("_distance", 6).alias("distance"))


@registered(
    "knn_cosine",
    f"""
    SELECT vec_id AS id, round(1 - list_cosine_similarity(embedding::DOUBLE[], {FIRST}::DOUBLE[]), 6) AS distance
    FROM embeddings ORDER BY list_cosine_similarity(embedding::DOUBLE[], {FIRST}::DOUBLE[]) DESC, vec_id LIMIT 10
    """,
)
def knn_cosine(spark, sf_dir):
    found = nearest(vectors(spark, sf_dir), first_vector(spark, sf_dir), 10, columns=(), metric="cosine")
    return found.select("id", F.round("_distance", 6).alias("distance"))


@registered(
    "distance_column",
    f"SELECT vec_id AS id, {L2SQ.format(a='embedding', b=FIRST)} AS distance FROM embeddings",
)
def distance_column(spark, sf_dir):
    """Distances to one vector as a JVM expression."""
    target = F.array(*[F.lit(float(x)) for x in first_vector(spark, sf_dir)])
    return vectors(spark, sf_dir).select("id", F.round(squared_l2(F.col("vector"), target), 6).alias("distance"))


KNN_JOIN_SQL = f"""
    SELECT query_id, id, distance, rank FROM (
      SELECT a.vec_id AS query_id, b.vec_id AS id, {L2SQ.format(a='a.embedding', b='b.embedding')} AS distance,
             row_number() OVER (PARTITION BY a.vec_id
               ORDER BY list_distance(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), b.vec_id)::INTEGER AS rank
      FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id)
    WHERE rank <= 3
"""


@registered("knn_join", KNN_JOIN_SQL)
def knn_join(spark, sf_dir):
    """For every vector its three nearest others."""
    rows = vectors(spark, sf_dir)
    found = nearest_join(rows, rows, 3, exclude_self=True)
    return found.select("query_id", "id", F.round("_distance", 6).alias("distance"), "rank")


@registered("knn_join_tiled", KNN_JOIN_SQL)
def knn_join_tiled(spark, sf_dir):
    """The same through cells, as for a query side too large to send to every task."""
    rows = vectors(spark, sf_dir)
    found = nearest_join(rows, rows, 3, exclude_self=True, tile_bytes=rows.count() * WIDTH * 8 // 3)
    return found.select("query_id", "id", F.round("_distance", 6).alias("distance"), "rank")


def _index(spark, sf_dir) -> ClusteredIndex:
    return ClusteredIndex(spark, scratch_path(spark, "index")).build(vectors(spark, sf_dir))


@registered(
    "clustered_all_cells",
    f"""
    SELECT vec_id AS id, {L2SQ.format(a='embedding', b=FIRST)} AS distance
    FROM embeddings ORDER BY list_distance(embedding::DOUBLE[], {FIRST}::DOUBLE[]), vec_id LIMIT 10
    """,
)
def clustered_all_cells(spark, sf_dir):
    """Search over a clustered table probing every cell, which is exact."""
    index = _index(spark, sf_dir)
    found = index.search(first_vector(spark, sf_dir), 10, probes=len(index.centroids()), columns=())
    return found.select("id", F.round("_distance", 6).alias("distance"))


@registered("clustered_search")
def clustered_search(spark, sf_dir):
    """Search over a clustered table probing the five closest cells; approximate."""
    found = _index(spark, sf_dir).search(first_vector(spark, sf_dir), 10, probes=5, columns=())
    return found.select("id", F.round("_distance", 6).alias("distance"))


@registered(
    "clustered_after_changes",
    f"""
    WITH now AS (SELECT vec_id, CASE WHEN vec_id % 10 = 3 THEN list_transform(embedding, lambda x: -x) ELSE embedding END AS embedding FROM embeddings)
    SELECT vec_id AS id, {L2SQ.format(a='embedding', b=FIRST)} AS distance
    FROM now ORDER BY list_distance(embedding::DOUBLE[], {FIRST}::DOUBLE[]), vec_id LIMIT 10
    """,
)
def clustered_after_changes(spark, sf_dir):
    """An index trained on half of the rows, to which the others and changed vectors are added, its large cells split; probing every cell is exact."""
    rows = vectors(spark, sf_dir)
    index = ClusteredIndex(spark, scratch_path(spark, "index")).build(rows.filter("id % 2 = 0"), cells=8)
    index.add(rows.filter("id % 2 = 1"))
    turned = rows.filter("id % 10 = 3").withColumn("vector", F.transform("vector", lambda x: -x))
    index.add(turned, most_rows=rows.count() // 4)
    found = index.search(first_vector(spark, sf_dir), 10, probes=len(index.centroids()), columns=())
    return found.select("id", F.round("_distance", 6).alias("distance"))


def documents(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(
        F.concat(F.lit("doc-"), F.col("doc_id").cast("string")).alias("name"), "text"
    )


# The hashing embedder in SQL: signed word counts in 64 hashed places, unit length.
EMBED_SQL = r"""
    words AS (SELECT name, sha256(w) AS h FROM (
        SELECT name, unnest(regexp_split_to_array(text, '[ \t\n\r\f\v]+')) AS w FROM {source}) WHERE w <> ''),
    places AS (SELECT name, (('0x' || substr(h, 1, 8))::BIGINT % 64)::INTEGER AS place,
                 sum(CASE WHEN ('0x' || substr(h, 9, 1))::INTEGER < 8 THEN 1 ELSE -1 END)::DOUBLE AS x
               FROM words GROUP BY 1, 2),
    norms AS (SELECT name, sqrt(sum(x * x)) AS norm FROM places GROUP BY 1)
"""
DOCS_SQL = "docs AS (SELECT 'doc-' || doc_id AS name, text FROM documents)"


@registered(
    "embed_documents",
    f"""
    WITH {DOCS_SQL}, {EMBED_SQL.format(source='docs')}
    SELECT p.name, p.place, round((x / norm)::FLOAT::DOUBLE, 5) AS weight
    FROM places p JOIN norms n ON p.name = n.name WHERE x <> 0
    """,
)
def embed_documents(spark, sf_dir):
    """Documents embedded by the hashing embedder, one row per non-zero place."""
    embedded = with_vectors(documents(spark, sf_dir), "text", HashingEmbedder, "name")
    places = embedded.select("name", F.posexplode("vector").alias("place", "weight"))
    return places.filter("weight <> 0").withColumn("weight", F.round(F.col("weight").cast("double"), 5))


@registered(
    "vector_store_search",
    f"""
    WITH {DOCS_SQL},
         q AS (SELECT '?' AS name, text FROM benchmark ORDER BY item_id LIMIT 1),
         both_texts AS (SELECT * FROM docs UNION ALL SELECT * FROM q),
         {EMBED_SQL.format(source='both_texts')},
         unit AS (SELECT p.name, place, (x / norm)::FLOAT::DOUBLE AS u FROM places p JOIN norms n ON p.name = n.name),
         qu AS (SELECT place, u FROM unit WHERE name = '?')
    SELECT u.name AS id, round((SELECT sum(u * u) FROM qu) + sum(u.u * u.u) - 2 * sum(u.u * coalesce(qu.u, 0)), 4) AS distance
    FROM unit u LEFT JOIN qu ON u.place = qu.place WHERE u.name <> '?'
    GROUP BY u.name
    ORDER BY round((SELECT sum(u * u) FROM qu) + sum(u.u * u.u) - 2 * sum(u.u * coalesce(qu.u, 0)), 9), u.name LIMIT 3
    """,
)
def vector_store_search(spark, sf_dir):
    """All documents added to a vector store, then the three nearest to a text."""
    store = VectorStore(spark, scratch_path(spark, "vectors"), text_entry("Document", width=WIDTH))
    store.add(documents(spark, sf_dir))
    question = table(spark, sf_dir, "benchmark").orderBy("item_id").first()["text"]
    return store.search(question).select("id", F.round("_distance", 4).alias("distance"))


@registered(
    "topk_then_passages",
    f"""
    WITH top AS (SELECT s_suppkey, s_name, s_acctbal FROM supplier ORDER BY s_acctbal DESC, s_suppkey LIMIT 3),
         q AS (SELECT top.*, embedding AS v FROM top JOIN embeddings ON vec_id = s_suppkey)
    SELECT s_suppkey, s_name, s_acctbal, id, distance, rank FROM (
      SELECT q.s_suppkey, q.s_name, q.s_acctbal, vec_id AS id, {L2SQ.format(a='q.v', b='embedding')} AS distance,
             row_number() OVER (PARTITION BY q.s_suppkey
               ORDER BY list_distance(q.v::DOUBLE[], embedding::DOUBLE[]), vec_id)::INTEGER AS rank
      FROM embeddings CROSS JOIN q)
    WHERE rank <= 3
    """,
)
def topk_then_passages(spark, sf_dir):
    """The top three suppliers by balance, the three nearest passages of each, and their attributes."""
    top = top_k(table(spark, sf_dir, "supplier"), "s_acctbal", 3, "s_suppkey").select("s_suppkey", "s_name", "s_acctbal")
    base = vectors(spark, sf_dir)
    asked = base.select(F.col("id").alias("s_suppkey"), F.col("vector").alias("v")).join(F.broadcast(top), "s_suppkey")
    found = passages_for(asked, "s_suppkey", "v", base, 3, text=None)
    return found.select("s_suppkey", "s_name", "s_acctbal", "id", F.round("_distance", 6).alias("distance"), "rank")


@registered(
    "vector_width",
    "SELECT vec_id AS id, label <> 2 AS fits FROM embeddings",
)
def vector_width(spark, sf_dir):
    """Rows whose vector has the declared width, and the others."""
    rows = vectors(spark, sf_dir).withColumn(
        "vector", F.when(F.col("label") == 2, F.slice("vector", 1, WIDTH - 1)).otherwise(F.col("vector"))
    )
    good, bad = check_width(rows, "vector", WIDTH)
    return good.select("id", F.lit(True).alias("fits")).unionByName(bad.select("id", F.lit(False).alias("fits")))
