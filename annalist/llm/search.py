"""Exact top-k search by BM25 with block-max pruning.

Documents are dealt into shards of bounded size, and each shard's inverted index
is one row of a stored table: its documents, their lengths, its terms, and the
postings of each term in document order. Queries come in blocks of bounded size.
For a block, the document frequencies of its terms are summed over all shards
first, so every shard scores with the same global statistics. In a shard, a term is rare or common. Postings of rare
terms are few and are added up for each query. Common terms have the largest score they give in each run of ``RUN``
documents, and one product of these maxima with a group of queries bounds what they add to any document. Only documents whose rare
scores and bound reach the k-th best score known so far are looked up, from the highest bound down, in the matrix of what
common terms give; only those that still reach it are scored in full precision.

Shards are searched in rounds, the first of about one shard and each next one of four times as many.
The k-th best score of the rounds before is a floor for all shards of a round: they skip
runs below it and return no document below it. So a query gets about ``3 k`` rows out of a round
instead of ``k`` out of each shard. The best k of what is left are the best of all.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import count
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast, TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from annalist.llm.common import bounded_batches, stage
from annalist.session import scratch_path

K1, B = 1.2, 0.75
#: Bytes of text in a shard (and what a row counts beside its text), documents of a run, terms (counted in each query) of a block of queries.
SHARD, ROW, RUN, BLOCK = 24 << 20, 256, 4, 1_000_000
#: A term is common in a shard where one document in so many or more has it. Queries whose bounds are found by one product.
COMMON, TOGETHER = 20, 256
#: What a shard is stored as, and in which round from the last it is searched.
STORED = "doc_ids binary, lengths binary, terms binary, sizes binary, postings binary, counts binary, level int"


def index(docs: DataFrame) -> DataFrame:
    """One row per shard. Rows without a ``doc_id`` are not searched; a null text has no words."""
    spark = docs.sparkSession
    bounded_batches(spark)

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, size, number = Shard(), 0, 0
        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                shard.add(doc_id, text or b"")
                size += len(text or b"") + ROW
                if size >= SHARD:
                    yield shard.row(number)
                    shard, size, number = Shard(), 0, number + 1
        if shard.ids:
            yield shard.row(number)

    rows = docs.filter("doc_id IS NOT NULL").select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    path = scratch_path(spark, "index")
    rows.mapInArrow(build, STORED).write.option("compression", "zstd").partitionBy("level").parquet(path)
    return spark.read.schema(STORED).parquet(path)


def level_of(partition: int, number: int) -> int:
    """Three in four shards are of level 0, three in four of the others of level 1, and so on."""
    drawn = crc32(f"{partition}:{number}".encode())
    return (32 - drawn.bit_length()) // 2


def words_of(text: bytes) -> list[bytes]:
    """Lower-cased (A-Z) runs without white space (space and 0x09 to 0x0D, at which bytes split)."""
    return text.lower().split()


class Shard:
    """An index being built."""

    def __init__(self):
        self.ids: list[int] = []
        self.lengths: list[int] = []
        self.numbers: dict[bytes, int] = defaultdict(count().__next__)
        self.found: list[tuple[np.ndarray, np.ndarray]] = []

    def add(self, doc_id: int, text: bytes) -> None:
        words = words_of(text)
        terms = np.fromiter(map(self.numbers.__getitem__, words), np.int64, len(words))
        self.ids.append(doc_id)
        self.lengths.append(len(words))
        self.found.append(np.unique(terms, return_counts=True))

    def row(self, number: int) -> pa.RecordBatch:
        terms = np.concatenate([t for t, _ in self.found])
        counts = np.concatenate([c for _, c in self.found])
        doc = np.repeat(np.arange(len(self.ids)), [len(t) for t, _ in self.found])
        order = np.argsort(terms, kind="stable")  # by term, then document
        parts = {
            "doc_ids": np.array(self.ids, "<i8"), "lengths": np.array(self.lengths, "<i4"), "terms": b" ".join(self.numbers),
            "sizes": np.bincount(terms, minlength=len(self.numbers)).astype("<i4"), "postings": doc[order].astype("<i4"), "counts": counts[order].astype("<i4"),
        }
        level = pa.array([level_of(TaskContext.get().partitionId(), number)], pa.int32())
        return pa.RecordBatch.from_pydict({k: pa.array([v if isinstance(v, bytes) else v.tobytes()], pa.binary()) for k, v in parts.items()} | {"level": level})


class Opened:
    """A stored shard, with the terms that some queries ask for."""

    def __init__(self, row: dict[str, bytes], wanted: pa.Array):
        self.ids = np.frombuffer(row["doc_ids"], "<i8")
        self.lengths = np.frombuffer(row["lengths"], "<i4")
        sizes = np.frombuffer(row["sizes"], "<i4").astype(np.int64)
        ends = np.cumsum(sizes)
        number = pc.index_in(split_terms(row["terms"], len(sizes)), wanted)
        own = np.flatnonzero(number.is_valid().to_numpy(zero_copy_only=False))
        self.asked = number.drop_null().to_numpy().astype(np.int64)  # number among the wanted
        order = np.argsort(self.asked)
        self.asked, own = self.asked[order], own[order]
        self.begin, self.end = ends[own] - sizes[own], ends[own]
        self.postings = np.frombuffer(row["postings"], "<i4")
        self.counts = np.frombuffer(row["counts"], "<i4")

    def weigh(self, idf: np.ndarray, mean_length: float) -> None:
        """Scores of all postings asked for, by term and by document, and those of common terms as a matrix with its maxima by run."""
        at = ranges(self.begin, self.end)
        self.doc = self.postings[at]
        sizes = self.end - self.begin
        self.end = np.cumsum(sizes)
        self.begin = self.end - sizes
        tf = self.counts[at].astype(np.float64)
        norm = K1 * (1 - B + B * self.lengths / max(mean_length, 1e-9))
        score = np.repeat(idf[self.asked], sizes) * tf * (K1 + 1) / (tf + norm[self.doc])
        #: The same postings by document, in the order of terms.
        order = np.argsort(self.doc.astype(np.uint16) if len(self.ids) <= 1 << 16 else self.doc, kind="stable")
        self.term_of, self.score_of = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)[order], score[order]
        self.doc_size = np.bincount(self.doc, minlength=len(self.ids))
        self.doc_begin = np.cumsum(self.doc_size) - self.doc_size
        # Bounds and choices are in single precision, only what is returned is not.
        self.score = score.astype(np.float32)
        common = np.flatnonzero(COMMON * sizes >= len(self.ids))
        self.row = np.full(len(sizes), -1)
        self.row[common] = np.arange(len(common))
        own = ranges(self.begin[common], self.end[common])
        row, doc = np.repeat(np.arange(len(common)), sizes[common]), self.doc[own]
        self.dense = np.zeros((len(self.ids), len(common)), dtype=np.float32)
        self.dense[doc, row] = self.score[own]
        self.runs = -(-len(self.ids) // RUN)
        cell = row * self.runs + doc // RUN
        first = np.flatnonzero(np.diff(cell, prepend=-1))
        self.maxima = np.zeros(len(common) * self.runs, dtype=np.float32)
        if len(first):
            self.maxima[cell[first]] = np.maximum.reduceat(self.score[own], first)
        self.maxima = self.maxima.reshape(-1, self.runs)
        #: Sums of so many single-precision scores are not farther below the exact ones.
        self.margin = 1 + (len(common) + 8) * 2.0**-23
        self.place = np.full(len(idf), -1)
        self.place[self.asked] = np.arange(len(sizes))
        self.among = np.zeros(len(sizes), dtype=bool)

    def best_of(self, queries: list[np.ndarray], k: int, floors: list[float]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """``best`` of each query; for some of them at once, one product with the maxima gives what the common terms add to a run at most."""
        for start in range(0, len(queries), TOGETHER):
            found = [self.place[terms] for terms in queries[start : start + TOGETHER]]
            asks = np.zeros((len(found), len(self.maxima)), dtype=np.float32)
            for ask, own in zip(asks, found):
                rows = self.row[own[own >= 0]]
                ask[rows[rows >= 0]] = 1
            for ask, own, most, floor in zip(asks, found, asks @ self.maxima, floors[start:]):
                yield self.best(own[own >= 0], ask, most, k, floor)

    def best(self, own: np.ndarray, ask: np.ndarray, most: np.ndarray, k: int, floor: float) -> tuple[np.ndarray, np.ndarray]:
        """Documents and scores of the best k (equal scores: smaller id first) that share a term and reach the floor."""
        ids, scores = np.zeros(0, np.int64), np.zeros(0)
        rare = own[self.row[own] < 0]
        at = ranges(self.begin[rare], self.end[rare])
        sums = np.bincount(self.doc[at], self.score[at], self.runs * RUN)
        bound = ((sums.reshape(-1, RUN) + most[:, None]) * self.margin).ravel()[: len(self.ids)]
        order = np.flatnonzero(bound >= floor if floor > 0 else bound > 0)
        order = order[np.argsort(-bound[order], kind="stable")]
        self.among[own] = True
        at, step = 0, 4 * k
        while at < len(order):
            if len(ids) == k:
                order = order[: int(np.searchsorted(-bound[order], -scores[-1], side="right"))]
                if at >= len(order):
                    break
            doc = order[at : at + step]
            at, step = at + step, step * 4
            least = max(floor, scores[-1]) if len(ids) == k else floor
            doc = doc[(sums[doc] + self.dense[doc] @ ask) * self.margin >= least]
            found = self.scores(doc)
            reach = (found > 0) & (found >= least)
            ids, scores = np.concatenate([ids, self.ids[doc[reach]]]), np.concatenate([scores, found[reach]])
            top = np.lexsort((ids, -scores))[:k]
            ids, scores = ids[top], scores[top]
        self.among[own] = False
        return ids, scores

    def scores(self, docs: np.ndarray) -> np.ndarray:
        """Scores of some documents for the terms that are marked, added up in the order of terms."""
        sizes = self.doc_size[docs]
        at = ranges(self.doc_begin[docs], self.doc_begin[docs] + sizes)
        hit = np.flatnonzero(self.among[self.term_of[at]])
        return np.bincount(np.repeat(np.arange(len(docs)), sizes)[hit], self.score_of[at[hit]], len(docs))


def split_terms(raw: bytes, n: int) -> pa.Array:
    """The ``n`` terms of a shard, which a space separates."""
    data = np.frombuffer(raw, np.uint8)
    gaps = np.flatnonzero(data == 0x20)
    ends = np.append(gaps, len(data))[:n] - np.arange(n)
    offsets = np.concatenate([[0], ends]).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(offsets), pa.py_buffer(np.delete(data, gaps))])


def ranges(begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """All numbers of some ranges, one after another."""
    sizes = end - begin
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(begin - ends + sizes, sizes)


def search(docs: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """``query_id, rank, doc_id, score`` of the best ``k`` documents for each query ``query_id``, ``text``.

    Words are lower-cased (A-Z) runs without white space; each different word of a query counts once.
    Scores add up in one fixed order, so they do not depend on the shards; equal scores are ranked by ``doc_id``. A query
    that shares no word with any document has no rows; queries without an id are left out, repeated ids are each searched.
    """
    spark = docs.sparkSession
    shards = index(docs)

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [sorted(set(words_of(t or b""))) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_pydict({"query_id": batch.column("query_id"), "terms": pa.array(found, pa.list_(pa.binary()))})

    asked = queries.filter("query_id IS NOT NULL").select(F.col("query_id").cast("bigint").alias("query_id"), F.col("text").cast("binary").alias("text"))
    asked = stage(asked.mapInArrow(words, "query_id bigint, terms array<binary>"), "queries")
    total = asked.agg(F.sum(F.size("terms"))).first()[0] or 0
    blocks = max(1, -(-total // BLOCK))

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths = [np.frombuffer(x.as_buffer(), "<i4") for x in batch.column("lengths")]
            yield pa.RecordBatch.from_pydict({"n": pa.array([len(x) for x in lengths], pa.int64()), "words": pa.array([int(x.sum()) for x in lengths], pa.int64())})

    n, all_words = shards.select("lengths").mapInArrow(measure, "n bigint, words bigint").agg(F.sum("n"), F.sum("words")).first()
    levels = sorted((r[0] for r in shards.select("level").distinct().collect()), reverse=True)  # 17 at most
    found = scratch_path(spark, "best")
    for block in range(blocks):
        own = asked.filter((F.size("terms") > 0) & (F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == block)).toArrow()  # a block of bounded size
        search_block(shards, levels, own, n or 0, (all_words or 0) / max(n or 0, 1), k, f"{found}/block={block}")
    best = spark.read.schema(BEST).parquet(found) if levels else spark.createDataFrame([], BEST)
    rank = F.row_number().over(Window.partitionBy("query_id", "copy").orderBy(F.desc("score"), "doc_id"))
    return best.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "doc_id", "score")


BEST = "query_id bigint, copy bigint, doc_id bigint, score double"


def search_block(shards: DataFrame, levels: list[int], queries: pa.Table, n: int, mean_length: float, k: int, path: str) -> None:
    """Write the best ``k`` of each shard that may be among the best of all, for some queries."""
    spark = shards.sparkSession
    ids, lists = queries.column("query_id").to_pylist(), queries.column("terms").to_pylist()
    vocabulary = sorted({t for terms in lists for t in terms})
    wanted = {t: number for number, t in enumerate(vocabulary)}
    terms = [np.array([wanted[t] for t in x], dtype=np.int64) for x in lists]
    words = spark.sparkContext.broadcast(pa.array(vocabulary, pa.binary()))  # bounded by BLOCK

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(words.value), dtype=np.int64)
        for batch in batches:
            for row in batch.to_pylist():
                opened = Opened(row | {"doc_ids": b"", "lengths": b"", "postings": b"", "counts": b""}, words.value)
                total[opened.asked] += opened.end - opened.begin
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"term": pa.array(at, pa.int64()), "n": pa.array(total[at], pa.int64())})

    counted = shards.select("terms", "sizes").mapInArrow(frequencies, "term bigint, n bigint").groupBy("term").agg(F.sum("n").alias("n")).toArrow()
    df = np.zeros(len(wanted))
    df[counted.column("term").to_numpy()] = counted.column("n").to_numpy()
    idf = np.log(1 + (n - df + 0.5) / (df + 0.5))
    seen: dict[int, int] = {}
    copies = []  # queries with one id are told apart
    for q in ids:
        copies.append(seen.get(q, 0))
        seen[q] = copies[-1] + 1
    number_of = {query: number for number, query in enumerate(zip(ids, copies))}
    plan = spark.sparkContext.broadcast((ids, copies, terms, idf))
    floors = np.zeros(len(ids))
    for level in levels:
        one = search_level(shards.filter(F.col("level") == level), words, plan, spark.sparkContext.broadcast(floors), mean_length, k)
        one.write.parquet(f"{path}/level={level}")
        if level != levels[-1]:
            so_far = spark.read.schema(BEST).parquet(path).groupBy("query_id", "copy", "score").agg(F.count("*").alias("n"))
            reach = F.sum("n").over(Window.partitionBy("query_id", "copy").orderBy(F.desc("score")))
            kth = so_far.withColumn("reach", reach).filter(F.col("reach") >= k).groupBy("query_id", "copy").agg(F.max("score").alias("score"))
            floors = floors.copy()
            for query, copy, score in zip(*(c.to_pylist() for c in kth.toArrow().columns)):  # one row per query of the block
                floors[number_of[query, copy]] = score


def search_level(shards: DataFrame, words: Broadcast, plan: Broadcast, floors: Broadcast, mean_length: float, k: int) -> DataFrame:
    """The best ``k`` of each shard that reach the floor of their query."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, copies, terms, idf = plan.value
        ids, copies = np.array(ids, dtype=np.int64), np.array(copies, dtype=np.int64)
        for batch in batches:
            for row in batch.to_pylist():
                opened = Opened(row, words.value)
                opened.weigh(idf, mean_length)
                best = list(opened.best_of(terms, k, floors.value.tolist()))
                many = [len(d) for d, _ in best]
                yield pa.RecordBatch.from_pydict(
                    {
                        "query_id": pa.array(np.repeat(ids, many)), "copy": pa.array(np.repeat(copies, many)),
                        "doc_id": pa.array(np.concatenate([d for d, _ in best]) if best else np.zeros(0, np.int64)),
                        "score": pa.array(np.concatenate([s for _, s in best]) if best else np.zeros(0)),
                    }
                )

    return shards.mapInArrow(run, BEST)
