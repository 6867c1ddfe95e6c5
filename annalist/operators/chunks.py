"""Passages of stored pages: paragraphs, numbered paragraphs, header-aware chunks, sections.

A page is one row, so parsing needs no shuffle: pages go through pandas
functions in Arrow batches, and the numbering inside a page is done there.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from annalist.functions.html import elements
from annalist.functions.text import every_nth

MIN_CHUNK = 50
MIN_SECTION = 100


def paragraph_texts(html: Column, close_paragraphs: bool = True) -> Column:
    """Texts of all paragraphs of a page as an array; null without a page.

    Declared non-deterministic so that exploding it does not parse pages twice.
    """

    @F.pandas_udf("array<string>")
    def _texts(pages: pd.Series) -> pd.Series:
        def one(page):
            found = elements(page, frozenset(["p"]), close_paragraphs)
            return None if found is None else [text for _, text in found]

        return pages.map(one)

    return _texts.asNondeterministic()(html)


def page_text(html: Column, close_paragraphs: bool = True) -> Column:
    """All paragraphs of a page joined by line feeds; null without a page."""
    return F.array_join(paragraph_texts(html, close_paragraphs), "\n")


def paragraphs(pages: DataFrame, html: str, keep: list[str | Column], close_paragraphs: bool = True) -> DataFrame:
    """One row per paragraph: ``keep``, position (from 0) and text."""
    return pages.select(
        *keep, F.posexplode(paragraph_texts(F.col(html), close_paragraphs)).alias("position", "text")
    )


def numbered_paragraphs(pages: DataFrame, html: str, name: Column, kind: str = "people") -> DataFrame:
    """(entity_type, entity_key, text) with key ``<name>_<position>``."""
    return paragraphs(pages, html, [name.alias("_name")]).select(
        F.lit(kind).alias("entity_type"),
        F.concat_ws("_", "_name", F.col("position").cast("string")).alias("entity_key"),
        "text",
    )


def header_chunks(
    pages: DataFrame, id_column: str, html: str, header_tag: str = "h2", marker: str | None = "]",
    min_length: int = MIN_CHUNK,
) -> DataFrame:
    """(id, name, text): paragraphs keyed by the header before them.

    A header counts when it contains ``marker`` (None: always); its name is the
    text after the last marker. Every non-empty paragraph under a header
    advances the number, also one too short to be kept; the key is the header
    with dashes for spaces, plus the number.
    """
    wanted = frozenset([header_tag, "p"])

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found = [elements(h, wanted) or [] for h in pdf["html"]]
            # ``page`` counts the pages of the batch; ids need not be unique.
            rows = pd.DataFrame(
                [(p, tag, text) for p, page in enumerate(found) for tag, text in page],
                columns=["page", "tag", "text"],
            )
            rows["id"] = pdf["id"].to_numpy()[rows["page"].astype(int)]
            is_header = rows["tag"] == header_tag
            if marker is not None:
                is_header &= rows["text"].str.contains(marker, regex=False)
            title = rows["text"].where(is_header)
            if marker is not None:
                title = title.str.rsplit(marker, n=1).str[-1]
            page = rows["page"]
            rows["header"] = title.groupby(page).ffill()
            section = is_header.groupby(page).cumsum()
            keep = (rows["tag"] == "p") & rows["header"].notna() & (rows["text"] != "")
            rows = rows[keep].copy()
            rows["n"] = rows.groupby([page[keep], section[keep]]).cumcount() + 1
            rows = rows[rows["text"].str.len() > min_length]
            rows["name"] = rows["header"].str.replace(" ", "-") + "-" + rows["n"].astype(str)
            yield rows[["id", "name", "text"]]

    kind = pages.schema[id_column].dataType.simpleString()
    return pages.select(F.col(id_column).alias("id"), F.col(html).alias("html")).mapInPandas(
        parse, f"id {kind}, name string, text string"
    )


def topic_sections(
    sections: DataFrame, topic: str, title: str, text: str, links: str | None = None,
    summary: str | None = None, min_length: int = MIN_SECTION,
) -> DataFrame:
    """Long enough sections of topic pages, named ``<topic> <title>``, with sampled links."""
    out = sections.filter(F.length(text) > min_length).select(
        F.concat_ws(" ", topic, title).alias("name"),
        F.col(topic).cast("string").alias("doc_id"),
        F.col(text).alias("text"),
        *([F.col(summary).alias("summary")] if summary else []),
        *([every_nth(F.col(links)).alias("sample_related_things")] if links else []),
    )
    return out


def topic_summary(pages: DataFrame, topic: str, summary: str, links: str) -> DataFrame:
    """One row per topic: name, summary text and sampled links."""
    return pages.select(
        F.col(topic).alias("name"),
        F.col(summary).alias("text"),
        every_nth(F.col(links)).alias("sample_related_things"),
        F.col(topic).alias("doc_id"),
    )
