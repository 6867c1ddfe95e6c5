"""Exact nearest-neighbour join of two large sides, through cells.

Some base rows serve as pivots, and every base row lies in the cell of its
nearest pivot, in a ring by its distance from it. Rings are cut to a bounded
number of rows, and smaller ones put together. A query first visits the ring it would lie in itself; the
k-th distance found there, or the k-th pivot if that is nearer, bounds its
answer. By the triangle inequality a ring whose distances from the pivot differ by more than
that from the query's own cannot hold a nearer row, so the query then visits the
other rings only. The choice of pivots changes the work and never the result.

Each visit is one shuffle: a ring's rows meet the queries that ask for it, ring
first, so a task holds one ring and a batch of queries. A query brings its bound along, so a ring
returns nothing farther and ranks only what is left. A ring asked for by many
queries is repeated for slices of them, so no task has more of either side than the bound.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, LongType, StructField, StructType

from annalist.functions.text import key_hash
from annalist.operators.blocks import BLOCK_BYTES, Near, matrix, pair_distance
from annalist.session import stage

# Pivots at least and at most, and classes of distance from a pivot: their product bounds what the driver and every task hold.
FEWEST, PIVOTS, CLASSES = 64, 1024, 64
# Pairs of a query and a ring that a task hands on at once.
PAIRS = 10_000
# Queries that a task has at least, and tasks that smaller joins are cut into.
SLICE, TASKS = 8192, 64


def _placed(x: np.ndarray, metric: str) -> np.ndarray:
    """Points whose Euclidean distance orders and bounds the metric: unit vectors for cosine."""
    if metric != "cosine":
        return x
    norms = np.linalg.norm(x, axis=1, keepdims=True)
    return x / np.where(norms == 0, 1, norms)


def _from_pivots(x: np.ndarray, pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distances of all rows from all pivots, and how far each row's may be off by rounding; overflown ones are not finite."""
    middle = pivots.mean(axis=0)
    x, p = x - middle, pivots - middle
    with np.errstate(over="ignore", invalid="ignore"):
        own, far = (x * x).sum(1), (p * p).sum(1)
        squared = own[:, None] + far[None, :] - 2 * (x @ p.T)
        return np.sqrt(np.maximum(squared, 0)), np.sqrt(8 * np.finfo(np.float64).eps * (x.shape[1] + 4) * (own + far.max()))


def _class_of(distance: np.ndarray, top: float) -> np.ndarray:
    """Eight classes for each halving of the distance, up to the pivots' own span and a little beyond."""
    with np.errstate(divide="ignore", invalid="ignore"):
        grade = np.floor(8 * np.log2(distance / top)) + CLASSES - 16
    return np.clip(np.nan_to_num(grade, nan=CLASSES - 1, posinf=CLASSES - 1, neginf=0), 0, CLASSES - 1).astype(np.int32)


class Rings:
    """The rings of all cells: bounds, first key, and how many keys the rows of each are dealt to. Small neighbours share a key."""

    def __init__(self, stats: list, cells: int, most: int):
        """``stats``: cell, class, rows, least and largest distance; neighbouring classes share a ring while they fit in ``most`` rows."""
        self.of = np.full((cells, CLASSES), -1)
        rings: list[list] = []
        for cell, grade, n, low, high in sorted(stats):
            if rings and rings[-1][0] == cell and rings[-1][1] + n <= most:
                last = rings[-1]
                last[1:] = [last[1] + n, min(last[2], low), max(last[3], high)]
            else:
                rings.append([cell, n, low, high])
            self.of[cell, grade] = len(rings) - 1
        for row in self.of:  # a query may be of a class that no base row has
            known = np.flatnonzero(row >= 0)
            if len(known):
                row[:] = row[known[np.abs(np.arange(CLASSES)[:, None] - known).argmin(axis=1)]]
        self.cell = np.array([r[0] for r in rings])
        self.parts = np.array([-(-r[1] // most) for r in rings])
        self.low, self.high = (np.array([r[k] for r in rings], dtype=float) for k in (2, 3))
        # Rings that fit share a key, so a query that rules out nothing is sent once for as many rows as a task holds.
        self.first, key, held = np.zeros(len(rings), dtype=np.int64), 0, 0
        for at, (ring, parts) in enumerate(zip(rings, self.parts)):
            if held and held + ring[1] > most:
                key, held = key + 1, 0
            self.first[at], held = key, held + ring[1]
            if parts > 1:
                key, held = key + int(parts), 0

    def may_hold(self, distance: np.ndarray, slack: np.ndarray, reach: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(query, ring) pairs that the triangle inequality does not rule out."""
        own, slack = distance[:, self.cell], slack[:, None]
        with np.errstate(invalid="ignore"):
            gap = np.maximum(own - slack - self.high, self.low - own - slack)
        return np.nonzero(~((gap > reach[:, None]) & np.isfinite(own)))


def cell_join(
    queries: DataFrame, base: DataFrame, k: int, width: int, metric: str, exclude_self: bool, ring_bytes: int, schema: StructType,
) -> DataFrame:
    """At least the k nearest base rows of every query, in ``schema``: query_id, id, ``_distance``, other columns of the base.

    ``queries`` has an id and a vector, ``base`` an id, a vector and other columns. Rows without a vector of ``width`` finite numbers
    are left out. Each input is scanned once more than for counting; no rows pass through the driver but the pivots.
    """
    spark = base.sparkSession
    others = [f"c{i}" for i in range(len(base.columns) - 2)]
    base, queries = base.toDF("id", "v", *others), queries.toDF("q", "v")
    most = max(k + 1, ring_bytes // (8 * width))
    total = base.count()
    wanted = min(PIVOTS, max(FEWEST, 4 * total // most))
    chosen = base.filter(F.size("v") == width).select("id", "v").orderBy(key_hash("id")).limit(wanted).toArrow()
    pivots, good = matrix(chosen["v"].combine_chunks(), width)
    once = ~chosen["id"].take(pa.array(good)).to_pandas().duplicated().to_numpy()
    if metric == "cosine":
        once &= np.linalg.norm(pivots, axis=1) > 0
    pivots = _placed(pivots[once], metric)
    if not len(pivots):
        pivots = np.zeros((1, width))
    among, _ = _from_pivots(pivots, pivots)
    top = float(np.nanmax(np.where(np.isfinite(among), among, 0))) or 1.0
    shared = spark.sparkContext.broadcast(pivots)  # at most PIVOTS rows
    vector = ArrayType(DoubleType())
    plain = [f for f in base.schema.fields if f.name != "v"]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        salt = TaskContext.get().partitionId() << 32
        for batch in batches:
            x, good = matrix(batch.column("v"), width)
            distance, slack = _from_pivots(_placed(x, metric), shared.value)
            cell = np.nan_to_num(distance, nan=np.inf).argmin(axis=1) if len(x) else np.zeros(0, int)
            own = distance[np.arange(len(x)), cell]
            known = np.isfinite(own)
            kept = batch.take(pa.array(good))
            yield pa.RecordBatch.from_arrays(
                [
                    *[kept.column(f.name) for f in plain], pa.array(list(x), pa.list_(pa.float64())),
                    pa.array(cell, pa.int32()), pa.array(_class_of(own, top)), pa.array(salt + np.arange(len(x))),
                    pa.array(np.where(known, own - slack, 0.0)), pa.array(np.where(known, own + slack, np.inf)),
                ],
                names=[*[f.name for f in plain], "v", "cell", "class", "salt", "low", "high"],
            )
            salt += len(x)

    fields = [("cell", IntegerType()), ("class", IntegerType()), ("salt", LongType()), ("low", DoubleType()), ("high", DoubleType())]
    placed = StructType([*plain, StructField("v", vector), *[StructField(n, t) for n, t in fields]])
    cells = stage(base.mapInArrow(place, placed), "cells")
    stats = cells.groupBy("cell", "class").agg(F.count("*").alias("n"), F.min("low").alias("low"), F.max("high").alias("high"))
    rings = Rings([tuple(r) for r in stats.collect()], len(pivots), most)  # at most PIVOTS * CLASSES rows
    if not len(rings.cell):
        return spark.createDataFrame([], schema)
    lookup = [(int(c), int(g), int(rings.first[n]), int(rings.parts[n])) for c, row in enumerate(rings.of) for g, n in enumerate(row) if n >= 0]
    named = spark.createDataFrame(lookup, "cell int, class int, first long, parts long")
    keyed = cells.join(F.broadcast(named), ["cell", "class"])  # at most PIVOTS * CLASSES rows
    keyed = keyed.withColumn("key", F.col("first") + F.pmod("salt", "parts")).select("key", "id", "v", *others)
    sent = spark.sparkContext.broadcast(rings)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row, at = TaskContext.get().partitionId() << 32, k + exclude_self - 1
        for batch in batches:
            x, good = matrix(batch.column("v"), width)
            if not len(x):
                continue
            distance, slack = _from_pivots(_placed(x, metric), shared.value)
            cell = np.nan_to_num(distance, nan=np.inf).argmin(axis=1)
            ring = sent.value.of[cell, _class_of(distance[np.arange(len(x)), cell], top)]
            reach = np.full(len(x), np.inf)
            if at < distance.shape[1]:
                reach = np.nan_to_num(np.partition(distance, at, axis=1)[:, at] + slack, nan=np.inf)
            if metric == "cosine":  # a vector of zeros is at distance 1 from all
                reach[np.linalg.norm(x, axis=1) == 0] = np.inf
            rows = row + np.arange(len(x))
            key = np.where(ring >= 0, sent.value.first[ring] + rows % sent.value.parts[ring], -1)
            yield pa.RecordBatch.from_arrays(
                [pa.array(rows), batch.column("q").take(pa.array(good)), pa.array(list(x), pa.list_(pa.float64())), pa.array(key), pa.array(reach)],
                names=["row", "q", "v", "key", "reach"],
            )
            row += len(x)

    head = [StructField("row", LongType()), queries.schema["q"], StructField("v", vector), StructField("key", LongType())]
    asked = stage(queries.mapInArrow(deal, StructType([*head, StructField("reach", DoubleType())])), "asked")
    first = _visit(asked.filter("key >= 0").select("key", "row", "q", "v", "reach"), asked.filter("key >= 0").select("key"), keyed, k, width, metric, exclude_self, most, schema)
    near = stage(first, "near")
    far = near.groupBy("row").agg(F.max("_distance").alias("far"), F.count("*").alias("n")).filter(F.col("n") >= k).select("row", "far")
    squared = {"l2sq": F.col("far"), "l2": F.col("far") * F.col("far"), "cosine": 2 * (F.abs("far") + 1e-12)}[metric]
    bounded = asked.join(far, "row", "left").withColumn("reach", F.least("reach", F.sqrt(squared * (1 + 1e-9))))  # least leaves nulls out
    bounded = stage(bounded.select("row", "q", "v", "key", "reach"), "bounded")

    def pairs(whole: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            known = sent.value
            step = max(1, BLOCK_BYTES // (8 * len(known.cell)))
            for batch in batches:
                x, _ = matrix(batch.column("v"), width)
                visited, reach = batch.column("key").to_numpy(), batch.column("reach").to_numpy()
                for a in range(0, len(x), step):
                    distance, slack = _from_pivots(_placed(x[a : a + step], metric), shared.value)
                    query, ring = known.may_hold(distance, slack, reach[a : a + step])
                    many = known.parts[ring]
                    key = np.repeat(known.first[ring] - np.cumsum(many) + many, many) + np.arange(many.sum())
                    query = np.repeat(query, many) + a
                    new = key != visited[query]
                    new[1:] &= (key[1:] != key[:-1]) | (query[1:] != query[:-1])  # rings with one key are neighbours
                    key, query = key[new], query[new]
                    for b in range(0, len(key), PAIRS):
                        some = batch.take(pa.array(query[b : b + PAIRS])) if whole else None
                        columns = [some.column(c) for c in ("row", "q", "v", "reach")] if whole else []
                        yield pa.RecordBatch.from_arrays([pa.array(key[b : b + PAIRS]), *columns], names=["key", *["row", "q", "v", "reach"][: len(columns)]])

        return run

    again = bounded.mapInArrow(pairs(True), StructType([head[3], *head[:3], StructField("reach", DoubleType())]))
    counted = bounded.mapInArrow(pairs(False), "key long")
    rest = _visit(again, counted, keyed, k, width, metric, exclude_self, most, schema)
    return near.unionByName(rest).drop("row")


def _visit(
    asked: DataFrame, counted: DataFrame, keyed: DataFrame, k: int, width: int, metric: str, exclude_self: bool, most: int, schema: StructType,
) -> DataFrame:
    """The best k rows within ``reach`` of each ``key`` for each query that asks for it; ``counted`` has the keys asked for."""
    others = keyed.columns[3:]
    asked_for = stage(counted.groupBy("key").agg(F.count("*").alias("n")), "slices")  # a row for each key
    share = min(most, max(SLICE, (asked_for.agg(F.sum("n")).first()[0] or 0) // TASKS))
    slices = asked_for.select("key", F.ceil(F.col("n") / share).cast("int").alias("slices"))
    left = keyed.join(slices, "key").withColumn("slice", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)))
    right = asked.join(slices, "key").withColumn("slice", F.pmod("row", "slices").cast("int"))
    left = left.select("key", "slice", F.lit(0).alias("kind"), "id", "v", *others)
    right = right.select("key", "slice", F.lit(1).alias("kind"), "row", "q", "v", "reach")
    both = left.unionByName(right, allowMissingColumns=True).repartition("key", "slice").sortWithinPartitions("key", "slice", "kind")
    room = k + 1 if exclude_self else k

    def best(part: pa.RecordBatch, ring: pa.Table, x: np.ndarray, near: Near) -> Iterator[pa.RecordBatch]:
        q, _ = matrix(part.column("v"), width)
        reach = part.column("reach").to_numpy()
        ids, names = ring.column("id").to_pandas(), part.column("q").to_pandas()
        step = 8 * Near.QUERIES
        for a in range(0, len(q), step):
            some = q[a : a + step]
            rows, cols = near.within(some, room, reach[a : a + step])
            if not len(rows):
                continue
            found = pd.DataFrame({"query": cols + a, "at": rows, "id": ids.iloc[rows].to_numpy(), "d": pair_distance(x[rows], some[cols], metric)})
            if exclude_self:
                found = found[found["id"].to_numpy() != names.to_numpy()[found["query"]]]
            found = found.sort_values(["query", "d", "id"]).groupby("query").head(k)
            at, query = pa.array(found["at"].to_numpy()), pa.array(found["query"].to_numpy())
            columns = [part.column("row").take(query), part.column("q").take(query), ring.column("id").take(at), pa.array(found["d"].to_numpy())]
            columns += [ring.column(c).take(at) for c in others]
            yield from pa.table(columns, names=["row", *schema.names]).combine_chunks().to_batches()

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, parts, ring, x, near = None, [], None, None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            marks = np.stack([batch.column(c).to_numpy().astype(np.int64) for c in ("key", "slice", "kind")])
            cuts = [0, *(np.flatnonzero((np.diff(marks, axis=1) != 0).any(axis=0)) + 1).tolist(), batch.num_rows]
            for a, b in zip(cuts, cuts[1:]):
                if tuple(marks[:2, a]) != key:
                    key, parts, ring = tuple(marks[:2, a]), [], None
                if marks[2, a] == 0:
                    parts.append(batch.slice(a, b - a))
                elif parts:
                    if ring is None:
                        ring = pa.Table.from_batches(parts).combine_chunks()
                        x, _ = matrix(ring.column("v").chunk(0), width)
                        near = Near(x, metric)
                    yield from best(batch.slice(a, b - a), ring, x, near)

    return both.mapInArrow(search, StructType([StructField("row", LongType()), *schema.fields]))
