"""SimHash near-duplicates by pigeonhole blocks.

Each text gets a 64-bit fingerprint of its word shingles. Equal fingerprints are
one node from the start, so copies never meet in pairs. A fingerprint is split
into six blocks: of two that differ in at most three bits, three blocks are
equal, so they meet under one of the twenty choices of three blocks. A group
that is large nevertheless (many near copies) is split again: the three other
blocks are cut into eight parts, of which five must be equal. Then only twelve
bits are free, which bounds a group at 4096 different fingerprints. Inside a
group the Hamming distances are verified, and each fingerprint keeps one link to
the smallest one it reaches there, not all its pairs. The links are joined to
components by alternating large-star and small-star steps.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from annalist.llm.common import bounded_batches, stage, trimmed

WORDS = re.compile(rb"[^\x20\x09-\x0D]+")
#: First bit and width of the six blocks.
BLOCKS = [(0, 11), (11, 11), (22, 11), (33, 11), (44, 10), (54, 10)]
#: Fingerprints of a group from which it is split again.
LARGE = 512


def fingerprint(text: bytes, shingle: int = 3, seed: int = 42) -> int:
    """The fingerprint of a UTF-8 text: A-Z lowered, shingles counted as often as they occur; no word: zero."""
    from xxhash import xxh64_intdigest

    words = WORDS.findall(text.lower())
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = [0, *ends[:-1].tolist()]
    last = [*(ends - 1)[min(shingle, len(words)) - 1 :].tolist()]
    hashes = np.array([xxh64_intdigest(joined[a:b], seed) for a, b in zip(starts, last)], dtype="<u8")
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), 1 << 16):
        bits = np.unpackbits(hashes[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = 3, seed: int = 42) -> DataFrame:
    """``doc_id`` and ``fp`` (the 64 bits as a signed long) of each row; a null text has no words."""
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([fingerprint(t or b"", shingle, seed) for t in batch.column("text").to_pylist()], dtype=np.uint64)
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "fp": pa.array(fps.view(np.int64))})

    rows = docs.select("doc_id", F.col("text").cast("binary").alias("text"))
    return rows.mapInArrow(trimmed(run), f"doc_id {dict(rows.dtypes)['doc_id']}, fp bigint")


def bits(first: int, width: int) -> int:
    """A mask as a signed 64-bit number."""
    mask = ((1 << width) - 1) << first
    return mask - (1 << 64) if mask >> 63 else mask


def masks() -> list[int]:
    """The twenty choices of three blocks that two close fingerprints share."""
    return [sum(bits(*BLOCKS[n]) for n in c) for c in combinations(range(6), 3)]


def fine_masks(mask: int) -> list[int]:
    """Of one choice: the same blocks and five of the eight parts of the other bits."""
    free = [n for n in range(64) if not mask >> n & 1]
    parts = [sum(bits(n, 1) for n in free[k::8]) for k in range(8)]
    return [mask | sum(c) for c in combinations(parts, 5)]


def roots(fps: np.ndarray, group: np.ndarray, most: int) -> np.ndarray:
    """For each row the first row that it reaches inside its group (rows of a group are neighbours) over close fingerprints."""
    unsigned = fps.view(np.uint64)
    end = np.searchsorted(group, group, side="right")
    left, right = [], []
    at, step = np.arange(len(fps)), 1
    while len(at := at[at + step < end[at]]):
        near = at[np.bitwise_count(unsigned[at] ^ unsigned[at + step]) <= most]
        left.append(near)
        right.append(near + step)
        step += 1
    label = np.arange(len(fps))
    if not left:
        return label
    i, j = np.concatenate(left), np.concatenate(right)
    while (label[i] != label[j]).any():
        least = np.minimum(label[i], label[j])
        np.minimum.at(label, i, least)
        np.minimum.at(label, j, least)
        label = label[label]
    return label


def links(nodes: DataFrame, most: int = 3) -> DataFrame:
    """Links ``a`` > ``b`` between the ``id`` of different fingerprints ``fp``; their components are those of all close pairs."""
    if most > 3:
        raise ValueError("six blocks serve distances of three bits at most")
    spark = nodes.sparkSession
    choices = F.array([F.struct(F.lit(n).alias("choice"), F.lit(m).alias("mask")) for n, m in enumerate(masks())])
    keyed = nodes.select("id", "fp", F.explode(choices).alias("k"))
    keyed = keyed.select("id", "fp", F.col("k.choice").alias("choice"), F.col("fp").bitwiseAND(F.col("k.mask")).alias("key"))
    sizes = keyed.groupBy("choice", "key").agg(F.count("*").alias("n")).filter("n > 1")
    met = stage(keyed.join(sizes, ["choice", "key"]), "blocks")
    fine = spark.createDataFrame([(n, fine_masks(m)) for n, m in enumerate(masks())], "choice int, fine array<bigint>")
    large = met.filter(F.col("n") > LARGE).join(F.broadcast(fine), "choice").select("id", "fp", "choice", F.posexplode("fine").alias("part", "mask"))
    large = large.select("id", "fp", (F.col("choice") * 64 + F.col("part") + 64).alias("choice"), F.col("fp").bitwiseAND(F.col("mask")).alias("key"))
    groups = met.filter(F.col("n") <= LARGE).select("id", "fp", "choice", "key").unionByName(large)
    groups = groups.repartition("choice", "key").sortWithinPartitions("choice", "key", "id")

    def reach(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = np.zeros((4, 0), dtype=np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            now = np.stack([batch.column(c).to_numpy().astype(np.int64) for c in ("id", "fp", "choice", "key")])
            rows = np.concatenate([rest, now], axis=1)
            # The last group may go on in the next batch.
            same = (rows[2] == rows[2, -1]) & (rows[3] == rows[3, -1])
            rest = rows[:, same]
            yield linked_rows(rows[:, ~same])
        yield linked_rows(rest)

    def linked_rows(rows: np.ndarray) -> pa.RecordBatch:
        ids, fps, choice, key = rows
        new = np.ones(len(ids), dtype=bool)
        new[1:] = (choice[1:] != choice[:-1]) | (key[1:] != key[:-1])
        root = roots(np.ascontiguousarray(fps), np.cumsum(new), most)
        moved = root != np.arange(len(ids))
        return pa.RecordBatch.from_pydict({"a": pa.array(ids[moved]), "b": pa.array(ids[root[moved]])})

    return groups.mapInArrow(reach, "a bigint, b bigint").distinct()


def components(edges: DataFrame) -> DataFrame:
    """``id`` and the smallest id of its component, ``root``, of all ids in the links ``a``, ``b`` but the roots themselves.

    Alternating large-star and small-star steps until nothing changes; each step is
    a grouped minimum (combined on the map side) and a join that Spark can split.
    """

    def mark(df: DataFrame):
        return tuple(df.agg(F.count("*"), F.expr("bit_xor(xxhash64(a, b))")).first())

    edges = stage(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct(), "edges")
    before = mark(edges)
    while before[0]:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        large = stage(large, "large-star")
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        joined = large.join(least, "a")
        small = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
        edges = stage(small.filter("a <> b").distinct(), "small-star")
        after = mark(edges)
        if after == before:
            break
        before = after
    return edges.select(F.col("a").alias("id"), F.col("b").alias("root"))


def near_duplicates(docs: DataFrame, shingle: int = 3, most: int = 3, seed: int = 42) -> DataFrame:
    """``doc_id``, ``fp`` and ``component_id``, the smallest ``doc_id`` over links of at most ``most`` bits, for each row.

    ``doc_id`` is an integer. Null and empty texts have fingerprint zero and link like others. Rows with
    the same ``doc_id`` are one node for each of their fingerprints, all named by that
    id. A row without a ``doc_id`` links nothing; it gets the component of its fingerprint, or null.
    """
    rows = stage(fingerprints(docs, shingle, seed), "fingerprints")
    nodes = rows.filter("doc_id IS NOT NULL").groupBy("fp").agg(F.min(F.col("doc_id").cast("bigint")).alias("id"))
    nodes = stage(nodes, "nodes")
    roots_of = components(links(nodes, most))
    named = nodes.join(roots_of, "id", "left").select("fp", F.coalesce("root", "id").alias("component_id"))
    return rows.join(named, "fp", "left").select("doc_id", "fp", "component_id")
