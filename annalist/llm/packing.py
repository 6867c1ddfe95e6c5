"""Packing of token sequences, shortest pack first, over the histogram of lengths.

Texts longer than a sequence are cut into full pieces and a rest. Only the
histogram of piece lengths (one count for each possible length) reaches the
driver. Lengths are placed longest first, each into the open pattern with the
most free space; a pattern is a list of lengths with a count. Pieces find their
place by rank: all pieces of one length are numbered across the cluster, and the
patterns that use the length own ranges of these numbers.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from annalist.llm.common import bounded_batches, stage

#: Tokens of a sequence.
SEQUENCE = 2048


def patterns_of(histogram: dict[int, int], size: int = SEQUENCE) -> list[tuple[int, tuple[int, ...]]]:
    """Counts and patterns of lengths that hold exactly the pieces of the histogram."""
    open_packs: dict[int, list[tuple[int, tuple[int, ...]]]] = {}
    spaces: list[int] = []  # a heap of free spaces, the largest first
    full: list[tuple[int, tuple[int, ...]]] = []

    def put(count: int, pattern: tuple[int, ...], space: int) -> None:
        if not space:
            full.append((count, pattern))
            return
        if space not in open_packs:
            open_packs[space] = []
            heapq.heappush(spaces, -space)
        open_packs[space].append((count, pattern))

    for length in sorted((k for k, n in histogram.items() if n), reverse=True):
        left = histogram[length]
        fresh: list[tuple[int, tuple[int, ...], int]] = []
        while left:
            if spaces and -spaces[0] >= length:
                space = -spaces[0]
                count, pattern = open_packs[space].pop()
                if not open_packs[space]:
                    del open_packs[space]
                    heapq.heappop(spaces)
                used = min(count, left)
                if count > used:
                    put(count - used, pattern, space)
                put(used, (*pattern, length), space - length)
                left -= used
            else:
                fresh.append((left, (length,), size - length))
                left = 0
        for one in fresh:
            put(*one)
    return full + [one for packs in open_packs.values() for one in packs]


def slots_of(patterns: list[tuple[int, tuple[int, ...]]]) -> list[tuple[int, int, int, int, int]]:
    """(length, first rank, count, first sequence, offset) of every place in every pattern."""
    taken: dict[int, int] = {}
    slots, sequence = [], 0
    for count, pattern in patterns:
        offset = 0
        for length in pattern:
            first = taken.get(length, 0)
            slots.append((length, first, count, sequence, offset))
            taken[length] = first + count
            offset += length
        sequence += count
    return slots


def pack(encoded: DataFrame, end_id: int | None = None, size: int = SEQUENCE) -> DataFrame:
    """Pieces of ``doc_id`` and ``ids`` (little-endian unsigned 32-bit) placed in sequences of ``size`` tokens.

    Returns ``doc_id, start, length, ids, ids_crc32, doc_tokens, sequence_id,
    offset``. Each id lies in one piece; within a sequence offsets are gapless from
    0. Every document is closed by ``end_id`` if given, which makes even an empty or null one
    a piece; without it such documents have none. Rows with the same or a
    null ``doc_id`` are packed each for itself.
    """
    bounded_batches(encoded.sparkSession)
    closing = b"" if end_id is None else int(end_id).to_bytes(4, "little")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, ranks = TaskContext.get().partitionId(), np.zeros(size + 1, dtype=np.int64)
        for batch in batches:
            rows: list[tuple] = []
            doc: list[int] = []
            for n, ids in enumerate(batch.column("ids").to_pylist()):
                ids = (ids or b"") + closing
                for at in range(0, len(ids), 4 * size):
                    piece = ids[at : at + 4 * size]
                    length = len(piece) // 4
                    rows.append((at // 4, length, piece, crc32(piece), len(ids) // 4, ranks[length]))
                    ranks[length] += 1
                    doc.append(n)
            start, lengths, pieces, crcs, totals, local = zip(*rows) if rows else [()] * 6
            yield pa.RecordBatch.from_pydict(
                {
                    "doc_id": batch.column("doc_id").take(pa.array(doc, pa.int64())), "start": pa.array(start, pa.int64()),
                    "length": pa.array(lengths, pa.int64()), "ids": pa.array(pieces, pa.binary()), "ids_crc32": pa.array(crcs, pa.int64()),
                    "doc_tokens": pa.array(totals, pa.int64()), "part": pa.array([part] * len(rows), pa.int64()), "local": pa.array(local, pa.int64()),
                }
            )

    id_type = dict(encoded.dtypes)["doc_id"]
    schema = f"doc_id {id_type}, start bigint, length bigint, ids binary, ids_crc32 bigint, doc_tokens bigint, part bigint, local bigint"
    pieces = stage(encoded.select("doc_id", "ids").mapInArrow(cut, schema), "pieces")
    counts = stage(pieces.groupBy("part", "length").agg(F.count("*").alias("n")), "lengths")
    histogram = {r.length: r.n for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # one row per length
    before = F.sum("n").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    bases = counts.select("part", "length", F.coalesce(before, F.lit(0)).alias("base"))
    slots = encoded.sparkSession.createDataFrame(
        slots_of(patterns_of(histogram, size)), "length bigint, first bigint, many bigint, sequence bigint, offset bigint"
    )
    ranked = pieces.join(bases, ["part", "length"]).withColumn("rank", F.col("base") + F.col("local"))
    # The places grow with the number of lengths, which is at most ``size``, not with the documents.
    own = (ranked["length"] == slots["length"]) & (ranked["rank"] >= slots["first"]) & (ranked["rank"] < slots["first"] + slots["many"])
    placed = ranked.join(F.broadcast(slots), own).select(ranked["*"], slots["sequence"], slots["first"], slots["offset"])
    return placed.select(
        "doc_id", "start", "length", "ids", "ids_crc32", "doc_tokens",
        (F.col("sequence") + F.col("rank") - F.col("first")).alias("sequence_id"), "offset",
    )
