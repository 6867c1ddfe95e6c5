"""The queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from annalist.llm import bpe, ctw, langid, outliers, packing, pii, search, secret_scan, simhash, suffix, tokens, trie, whitening
from annalist.session import scratch_path, ship_package

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")
WORD_BPE = public_tokenizers.path("word_bpe_49k.json")


def registered_on(table: str):
    def register(query):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship_package(spark)
            return query(spark, spark.read.parquet(f"{sf_dir}/{table}.parquet"))

        QUERIES[query.__name__] = run
        return query

    return register


registered = registered_on("documents")


@registered
def op1_bpe_round_trip(spark, docs):
    """Ids and decoded text of every document, as digests."""
    both = bpe.decode(bpe.encode(docs, BYTE_BPE), BYTE_BPE)
    return both.select(
        "doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.encode("text", "utf-8"), 256).alias("decoded_sha256")
    )


@registered
def op2_token_files(spark, docs):
    """All documents as token files, and what the files hold."""
    folder = scratch_path(spark, "tokens")
    tokens.write_tokens(bpe.encode(docs, WORD_BPE, inside=False), folder, end_id=2)
    return tokens.read_tokens(spark, folder).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


@registered
def op8_packing(spark, docs):
    """All documents packed into sequences of 2048 tokens."""
    return packing.pack(bpe.encode(docs, BYTE_BPE), end_id=1).drop("ids")


@registered
def op10_simhash(spark, docs):
    """The fingerprint and component of every document."""
    found = simhash.near_duplicates(docs, shingle=3, most=3, seed=42)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


@registered
def op3_repeated_strings(spark, docs):
    """What is left of every document without the 100-byte strings that also start earlier."""
    found = suffix.remove_repeats(docs, length=100)
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


@registered
def op4_context_tree(spark, docs):
    """Scores of all documents by a context-tree model and by a unigram base."""
    return ctw.score(docs)


@registered
def op5_outliers(spark, docs):
    """Statistics of all documents and whether they are kept."""
    found = outliers.judge(docs)
    counts = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    return found.select("doc_id", *counts, "base_failed", "kept", "distance2")


@registered
def op6_language(spark, docs):
    """The predicted language of all documents, by a model of those that are not held out."""
    held = langid.held_out(F.col("doc_id"))
    model = langid.fit(docs.filter(~held).select("text", "lang"))
    return langid.predict(docs.select("doc_id", held.alias("held_out"), "text"), model).drop("text")


@registered
def op7_personal_data(spark, docs):
    """All spans of personal data in all documents."""
    found = pii.find(docs, pii.fit(docs))
    listed = lambda spans: F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])))
    base = F.filter("spans", lambda s: s["base"])
    count_of = lambda k: F.size(F.filter(base, lambda s: s["kind"] == k)).cast("bigint")
    counts = [count_of(k).alias(f"n_{k}") for k in pii.KINDS[:4]]
    return found.select("doc_id", *counts, F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))


@registered
def op9_bm25_search(spark, docs):
    """The ten best documents for every document whose id is divisible by 100, as a query by its whole text."""
    queries = docs.filter(F.col("doc_id") % 100 == 0).select(F.col("doc_id").alias("query_id"), "text")
    return search.search(docs, queries, k=10)


@registered_on("conversations")
def op11_prefix_trie(spark, turns):
    """The prefix trie of conversations that share their first turns within families of five."""
    shared = F.crc32(F.encode(F.col("conv_id").cast("string"), "utf-8")) % 9
    return trie.prefix_trie(trie.branched(trie.numbered(turns), family=5, shared=shared, most=8))


SQL["op11_prefix_trie"] = """
WITH turns AS (
    SELECT conv_id AS c, coalesce(role, '') AS role, coalesce(text, '') AS text,
           row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, substr(sha256(
               strlen(coalesce(role, ''))::VARCHAR || ':' || coalesce(role, '') || coalesce(text, '')), 1, 32)) AS pos
    FROM conversations WHERE conv_id IS NOT NULL
), own AS (
    SELECT c, list({'role': role, 'text': text} ORDER BY pos) AS turns,
           xor(list_reduce(
               list_concat([4294967295::BIGINT], list_transform(string_split(c::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
               lambda a, b: list_reduce(list_concat([xor(a, b)], [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]),
                                        lambda p, q: xor(p >> 1, 3988292384 * (p & 1)))
           ), 4294967295::BIGINT) % 9 AS h
    FROM turns GROUP BY c
), rebuilt AS (
    SELECT own.c, list_concat(coalesce(base.turns, [])[1:own.h], own.turns[own.h + 1:]) AS turns
    FROM own LEFT JOIN own AS base ON base.c = own.c - own.c % 5
), nodes AS (
    SELECT d, turns[1:d] AS node, min(c) AS conv_id, count(*) AS n_convs,
           sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (len(turns) = d), '')) AS ends_sha256
    FROM (SELECT c, turns, unnest(range(0, len(turns) + 1)) AS d FROM rebuilt) GROUP BY 1, 2
), below AS (
    SELECT unnest(range(0, d + 1)) AS up, node, d, (n_convs - 1) * strlen(coalesce(node[d].text, '')) AS saved,
           NOT EXISTS (FROM nodes AS child WHERE child.d = nodes.d + 1 AND child.node[1:nodes.d] = nodes.node) AS leaf
    FROM nodes
), sums AS (
    SELECT up AS d, node[1:up] AS node, sum(saved) AS saved_tokens, count(*) FILTER (leaf) AS n_leaves,
           count(*) FILTER (d = up + 1) AS n_children
    FROM below GROUP BY 1, 2
)
SELECT nodes.conv_id, nodes.d AS depth, parent.conv_id AS parent_conv_id, nodes.n_convs, sums.n_children, sums.n_leaves,
       sums.saved_tokens::BIGINT AS saved_tokens, nodes.ends_sha256
FROM nodes JOIN sums ON sums.d = nodes.d AND sums.node = nodes.node
LEFT JOIN nodes AS parent ON parent.d = nodes.d - 1 AND parent.node = nodes.node[1:nodes.d - 1]
"""


@registered
def op12_secret_scan(spark, docs):
    """All spans of secrets in all documents."""
    found = secret_scan.find(docs, secret_scan.fit(docs))
    listed = lambda spans: F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])))
    base = F.filter("spans", lambda s: s["base"])
    count_of = lambda k: F.size(F.filter(base, lambda s: s["kind"] == k)).cast("bigint")
    counts = [count_of(k).alias(f"n_{k}") for k in secret_scan.KINDS[:3]]
    return found.select("doc_id", *counts, F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))


@registered_on("embeddings")
def op13_whitening(spark, vectors):
    """All embeddings, whitened on their 32 largest components."""
    rows = whitening.quantised(vectors, "embedding", scale=64, offset=1_000_000)
    return whitening.whiten(rows, whitening.fit(rows, most=32))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The corpus pipeline over all documents."""
    from corpus_pipeline import run

    return run(spark, sf_dir)


QUERIES["pipeline"] = pipeline
