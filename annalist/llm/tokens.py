"""Token ids in compact binary files.

Ids are ranked by their frequency in all documents, so that frequent ids are
small numbers. A rank takes one to four whole bytes; two bits of a separate
control stream tell how many, so four ids share a control byte. Reading looks
the lengths up in a table by control byte and gathers all ids of a document at
once. Files hold documents in ascending ``doc_id`` order and are written and
read by Spark, so they can be in any store it reaches.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType, StructField, StructType

from annalist.llm.common import bounded_batches, byte_columns, stage

#: Byte lengths of the four ids that a control byte stands for.
LENGTHS = np.array([[1 + (c >> 2 * n & 3) for n in range(4)] for c in range(256)], dtype=np.uint8)
MASKS = np.array([0, 0xFF, 0xFFFF, 0xFFFFFF, 0xFFFFFFFF], dtype=np.uint32)
#: Columns of documents and of counts of ids.
COUNTED = ["doc_id", "n_tokens", "ids", "id", "n"]


def binary_column(raw: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """A binary column whose values of these sizes in bytes stand one after another in ``raw``."""
    offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(raw).view(np.uint8))])


def control_places(n: np.ndarray) -> np.ndarray:
    """Where the two control bits of each number are, counted in numbers: each document begins a control byte."""
    quads = -(-n // 4)
    return np.arange(n.sum()) + np.repeat(4 * (np.cumsum(quads) - quads) - np.cumsum(n) + n, n)


def pack_column(ranks: np.ndarray, n: np.ndarray) -> tuple[pa.Array, pa.Array]:
    """Control bytes and data bytes of documents with ``n`` unsigned 32-bit numbers each, which stand one after another."""
    ranks = ranks.astype("<u4")
    extra = (ranks > 0xFF).astype(np.uint8) + (ranks > 0xFFFF) + (ranks > 0xFFFFFF)
    quads = -(-n // 4)
    padded = np.zeros(4 * quads.sum(), dtype=np.uint8)
    padded[control_places(n)] = extra
    control = padded[::4] | padded[1::4] << 2 | padded[2::4] << 4 | padded[3::4] << 6
    data = ranks.view(np.uint8).reshape(-1, 4)[np.arange(4) <= extra[:, None]]
    ends = np.concatenate([[0], np.cumsum(extra + 1, dtype=np.int64)])
    return binary_column(control, quads), binary_column(data, np.diff(ends[np.concatenate([[0], np.cumsum(n)])]))


def unpack_column(control: pa.Array, data: pa.Array, n: np.ndarray) -> np.ndarray:
    """The numbers of all documents back: lengths by table, then all bytes gathered at once."""
    lengths = LENGTHS[byte_columns(control)[0]].ravel()[control_places(n)]
    starts = np.cumsum(lengths, dtype=np.int64) - lengths
    raw = np.concatenate([byte_columns(data)[0], np.zeros(3, np.uint8)])
    wide = raw[starts].astype(np.uint32)
    for k in range(1, int(lengths.max(initial=1))):
        wide |= raw[starts + k].astype(np.uint32) << np.uint32(8 * k)
    return wide & MASKS[lengths]


def pack_ranks(ranks: np.ndarray) -> tuple[bytes, bytes]:
    """Control bytes and data bytes of the numbers of one document."""
    control, data = pack_column(ranks, np.array([len(ranks)]))
    return control[0].as_py(), data[0].as_py()


def unpack_ranks(control: bytes, data: bytes, n: int) -> np.ndarray:
    """The numbers of one document back."""
    return unpack_column(pa.array([control], pa.binary()), pa.array([data], pa.binary()), np.array([n]))


def narrowed(ids: np.ndarray) -> np.ndarray:
    """Ids in two bytes each where all of them fit, else in four."""
    return ids.astype("<u2" if ids.max(initial=0) < 1 << 16 else "<u4")


def widened(column: pa.Array, n: np.ndarray) -> np.ndarray:
    """The ids of all documents of a column of narrowed ones; parts may differ in width."""
    raw, offsets = byte_columns(column)
    sizes = np.diff(offsets)
    if (sizes == 2 * n).all():
        return np.frombuffer(raw.tobytes(), "<u2")
    parts = [raw[a : a + s].tobytes() for a, s in zip(offsets, sizes)]
    return np.concatenate([np.frombuffer(x, "<u2" if len(x) == 2 * m else "<u4").astype("<u4") for x, m in zip(parts, n)])


def frequency_order(counts: DataFrame) -> np.ndarray:
    """All ids that occur (``id``, ``n``, added up per id), most frequent first, ties by id. Its size is bounded by the vocabulary."""
    rows = counts.groupBy("id").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "id").select("id").toArrow()
    return rows.column("id").to_numpy().astype("<u4")


def counted(encoded: DataFrame, end_id: int | None) -> DataFrame:
    """The documents with narrowed ids, closed by ``end_id``, and after those of a task the counts of its ids, in one pass.

    The rows of counts have ``id`` and ``n``. So the ids are not kept four bytes wide, and counting them reads nothing again.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, kind = np.zeros(0, dtype=np.int64), None
        for batch in batches:
            kind = batch.schema.field("doc_id").type
            raw, offsets = byte_columns(batch.column("ids").cast(pa.binary()).fill_null(b""))
            ids, ends = np.frombuffer(raw.tobytes(), "<u4"), offsets[1:] // 4
            n = np.diff(offsets) // 4
            if end_id is not None:
                ids, n = np.insert(ids, ends, end_id), n + 1
            one = np.bincount(ids, minlength=len(total))
            one[: len(total)] += total
            total, ids = one, narrowed(ids)
            none = pa.nulls(len(n), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n), binary_column(ids, n * ids.itemsize), none, none], names=COUNTED)
        at = np.nonzero(total)[0]
        if len(at):
            nulls = [pa.nulls(len(at), t) for t in (kind, pa.int64(), pa.binary())]
            yield pa.RecordBatch.from_arrays([*nulls, pa.array(at, pa.int64()), pa.array(total[at], pa.int64())], names=COUNTED)

    types = [encoded.schema["doc_id"].dataType, LongType(), BinaryType(), LongType(), LongType()]
    return encoded.select("doc_id", "ids").mapInArrow(run, StructType([StructField(c, t) for c, t in zip(COUNTED, types)]))


def write_tokens(encoded: DataFrame, folder: str, end_id: int | None = None) -> None:
    """Write ``doc_id`` and ``ids`` (little-endian unsigned 32-bit) as token files, each document closed by ``end_id``.

    ``folder/documents`` holds a row per document with its place among the ids of
    its file, ``folder/files`` the ids before each file, ``folder/ranks`` the id of each rank.
    Null ids are no ids. Null document ids come first; rows with equal ids stand
    next to each other in any order. No rows give empty files.
    """
    bounded_batches(encoded.sparkSession)
    staged = stage(counted(encoded, end_id), "ids")
    order = frequency_order(staged.filter("id IS NOT NULL").select("id", "n"))
    rank_of = np.zeros(int(order.max()) + 1 if len(order) else 1, dtype=np.uint32)
    rank_of[order] = np.arange(len(order), dtype=np.uint32)

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before, file = 0, TaskContext.get().partitionId()
        for batch in batches:
            n = batch.column("n_tokens").to_numpy()
            control, data = pack_column(rank_of[widened(batch.column("ids"), n)], n)
            ends = before + np.cumsum(n)
            yield pa.RecordBatch.from_pydict(
                {
                    "doc_id": batch.column("doc_id"), "n_tokens": pa.array(n), "control": control, "data": data,
                    "file": pa.array(np.full(len(n), file, np.int32)), "place": pa.array(ends - n),
                }
            )
            before = int(ends[-1]) if len(n) else before

    id_type = dict(encoded.dtypes)["doc_id"]
    # Ranked after the sort, since the sort by ranges reads its input twice.
    documents = staged.filter("id IS NULL").select("doc_id", "n_tokens", "ids")
    ordered = documents.repartitionByRange("doc_id").sortWithinPartitions("doc_id")
    coded = ordered.mapInArrow(code, f"doc_id {id_type}, n_tokens bigint, control binary, data binary, file int, place bigint")
    spark = encoded.sparkSession
    coded.write.option("compression", "none").parquet(f"{folder}/documents")
    files = spark.read.schema(coded.schema).parquet(f"{folder}/documents").groupBy("file").agg(F.sum("n_tokens").alias("n_tokens"))
    # One row per file, so a single window over them stays small.
    start = F.sum("n_tokens").over(Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1))
    files.select("file", "n_tokens", F.coalesce(start, F.lit(0)).alias("start")).write.parquet(f"{folder}/files")
    ranks = pa.table({"rank": pa.array(range(len(order)), pa.int64()), "id": pa.array(order, pa.int64())})
    spark.createDataFrame(ranks).coalesce(1).write.parquet(f"{folder}/ranks")


def read_tokens(spark: SparkSession, folder: str) -> DataFrame:
    """``doc_id``, ``start`` (ids of all documents before it), ``n_tokens``, ``ids`` of each document in the files."""
    bounded_batches(spark)
    ranks = spark.read.parquet(f"{folder}/ranks").orderBy("rank").toArrow()  # bounded by the vocabulary
    id_of = ranks.column("id").to_numpy().astype("<u4")
    rows = spark.read.parquet(f"{folder}/documents")
    files = spark.read.parquet(f"{folder}/files").select("file", F.col("start").alias("base"))

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.column("n_tokens").to_numpy()
            ids = id_of[unpack_column(batch.column("control"), batch.column("data"), n)]
            yield batch.drop_columns(["control", "data"]).append_column("ids", binary_column(ids, 4 * n))

    id_type = dict(rows.dtypes)["doc_id"]
    placed = rows.select("doc_id", "n_tokens", "control", "data", "file", "place").mapInArrow(
        decode, f"doc_id {id_type}, n_tokens bigint, file int, place bigint, ids binary"
    )
    return placed.join(files, "file").select("doc_id", (F.col("base") + F.col("place")).alias("start"), "n_tokens", "ids")
