"""A corpus pipeline: language, near-duplicates, repeated strings, personal data, packing.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame, which is
written as Parquet and read again as the next one's ``docs``. All but the last
return the columns of ``documents``. No stage can be expressed in SQL as a
whole, so ``ORACLE_SQL`` is None and the tests use brute force.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from annalist.llm import bpe, langid, packing, pii, simhash, suffix
from annalist.session import scratch_path, ship_package

#: Score below which a text counts as being in no learned language.
LEAST_SCORE = 0.4


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose text is in a language that the labelled rows taught; null texts, texts without a letter and doubtful ones go.

    The model learns from all rows with a language. Language labels are not changed.
    """
    return langid.known(docs, langid.fit(docs.select("text", "lang")), LEAST_SCORE)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near-duplicates, the one with the smallest ``doc_id``.

    Of rows that share that id one stays. Rows without an id are in no group and stay.
    """
    found = simhash.near_duplicates(docs, shingle=3, most=3, seed=42)
    first = found.filter("doc_id = component_id").groupBy("doc_id").agg(F.count("*").alias("copies"))
    named = first.select(F.col("doc_id").alias("kept_id"), "copies")
    kept = docs.join(named, docs["doc_id"] == named["kept_id"])
    single = kept.filter(named["copies"] == 1).select(*[docs[f"`{c}`"] for c in docs.columns])
    several = kept.filter(named["copies"] > 1).select(*[docs[f"`{c}`"] for c in docs.columns]).dropDuplicates(["doc_id"])
    return single.unionByName(several).unionByName(docs.filter("doc_id IS NULL"))


def repeated_strings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the 100-byte strings that also start earlier; ``n_chars`` follows.

    Characters whose bytes were cut apart are left out. A text that is all repeats stays as an empty one.
    """
    return suffix.without_repeats(docs, length=100)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with personal data and secrets replaced by their kind; ``n_chars`` follows."""
    clean = pii.redact(docs, pii.fit(docs))
    return clean.withColumn("n_chars", F.length("text").cast("bigint")) if "n_chars" in docs.columns else clean


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All texts as packed token sequences: one row per piece."""
    return packing.pack(bpe.encode(docs, public_tokenizers.path("byte_bpe_50k.json")), end_id=1)


STAGES = [
    ("language", language), ("near_duplicates", near_duplicates), ("repeated_strings", repeated_strings),
    ("personal_data", personal_data), ("packing", pack),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``."""
    ship_package(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = scratch_path(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
