"""Passages of stored pages and documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from annalist.operators import chunks
from annalist.plans.registered import registered, table


# Paragraphs by cutting at tags, which is enough for the tags and entities these pages have.
TEXT_SQL = (
    "replace(replace(replace(replace(regexp_replace({html}, '<[^>]*>', '', 'g'), "
    "'&quot;', '\"'), '&copy;', '©'), '&middot;', '·'), '&amp;', '&')"
)
PARTS_SQL = f"""
    cut AS (SELECT page_id, url, html, unnest(string_split(html, '<p>')[2:]) AS part,
              generate_subscripts(string_split(html, '<p>')[2:], 1) - 1 AS position FROM pages),
    parts AS (SELECT page_id, url, html, position::INTEGER AS position,
              {TEXT_SQL.format(html="regexp_extract(part, '^(.*?)(</p>|</article>|<h1|<footer|$)', 1, 's')")} AS text
              FROM cut)
"""


@registered("page_paragraphs", f"WITH {PARTS_SQL} SELECT page_id, position, text FROM parts")
def page_paragraphs(spark, sf_dir):
    return chunks.paragraphs(table(spark, sf_dir, "pages"), "html", ["page_id"])


@registered(
    "page_text",
    f"""
    WITH {PARTS_SQL}
    SELECT p.page_id, coalesce(string_agg(text, chr(10) ORDER BY position), '') AS text
    FROM pages p LEFT JOIN parts ON p.page_id = parts.page_id GROUP BY p.page_id
    """,
)
def page_text(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", chunks.page_text(F.col("html")).alias("text"))


@registered(
    "numbered_paragraphs",
    f"WITH {PARTS_SQL} SELECT 'people' AS entity_type, url || '_' || position AS entity_key, text FROM parts",
)
def numbered_paragraphs(spark, sf_dir):
    return chunks.numbered_paragraphs(table(spark, sf_dir, "pages"), "html", F.col("url"))


@registered(
    "header_chunks",
    f"""
    WITH {PARTS_SQL}
    SELECT page_id AS id, replace(title, ' ', '-') || '-' || n AS name, text FROM (
      SELECT page_id, text, {TEXT_SQL.format(html="regexp_extract(html, '<h1>(.*?)</h1>', 1, 's')")} AS title,
             row_number() OVER (PARTITION BY page_id ORDER BY position) AS n
      FROM parts WHERE text <> '')
    WHERE length(text) > 50
    """,
)
def header_chunks(spark, sf_dir):
    return chunks.header_chunks(table(spark, sf_dir, "pages"), "page_id", "html", header_tag="h1", marker=None)


@registered(
    "topic_sections",
    r"""
    SELECT source || ' ' || lang AS name, source AS doc_id, text,
           array_to_string(list_filter(string_split(text, ' '), lambda x, i: (i - 1) % 10 = 0)[1:10], '|') AS links
    FROM documents WHERE length(text) > 100
    """,
)
def topic_sections(spark, sf_dir):
    """Long enough sections of topics, with every tenth link of the page, ten at most."""
    documents = table(spark, sf_dir, "documents").withColumn("links", F.split("text", " "))
    found = chunks.topic_sections(documents, "source", "lang", "text", "links")
    return found.select("name", "doc_id", "text", F.array_join("sample_related_things", "|").alias("links"))


@registered(
    "topic_summaries",
    r"""
    SELECT 'doc ' || doc_id AS name, text,
           array_to_string(list_filter(string_split(text, ' '), lambda x, i: (i - 1) % 10 = 0)[1:10], '|') AS links
    FROM documents
    """,
)
def topic_summaries(spark, sf_dir):
    documents = table(spark, sf_dir, "documents").select(
        F.concat(F.lit("doc "), F.col("doc_id").cast("string")).alias("topic"), "text", F.split("text", " ").alias("links")
    )
    found = chunks.topic_summary(documents, "topic", "text", "links")
    return found.select("name", "text", F.array_join("sample_related_things", "|").alias("links"))
