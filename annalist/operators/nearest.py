"""Nearest-neighbour search: exact, many queries at once, and over clustered tables.

Distances default to squared L2. Vectors are compared in NumPy blocks inside
``mapInArrow``: each task keeps only its best k rows, so a search shuffles k
rows per task whatever the size of the table.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from annalist.functions.text import key_hash
from annalist.operators.blocks import BLOCK_BYTES, block_distance, candidates, matrix, pair_distance
from annalist.operators.cell_join import cell_join
from annalist.session import stage

METRICS = ("l2sq", "l2", "cosine")
# Queries are sent to every task up to this many bytes; more are joined through cells, in rings of so many bytes.
TILE_BYTES = 64 << 20
# Centroids are sent to every task; an index has at most so many bytes of them.
CENTROID_BYTES = 64 << 20


def nearest(
    df: DataFrame, query: list[float], k: int = 3, id_column: str = "id", vector: str = "vector",
    columns: tuple[str, ...] = ("text",), metric: str = "l2sq",
) -> DataFrame:
    """The k rows nearest to one vector: id, ``columns`` and ``_distance``, nearest first.

    Ties go to the smaller id. Rows without a vector of the query's width, or with
    a number in it that is not finite, are left out.
    """
    target = np.asarray(query, np.float64)[None, :]
    if not np.isfinite(target).all():
        raise ValueError("the query has a number that is not finite")
    names = [id_column, *[c for c in columns if c in df.columns and c != id_column]]
    picked = df.select(*names, vector)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = None
        for batch in batches:
            x, good = matrix(batch.column(len(names)), target.shape[1])
            if not len(good):
                continue
            rows, _ = candidates(x, target, k, metric)
            found = pa.table(batch).select(names).take(pa.array(good[rows]))
            distance = pair_distance(x[rows], np.broadcast_to(target, (len(rows), target.shape[1])), metric)
            found = found.append_column("_distance", pa.array(distance))
            best = found if best is None else pa.concat_tables([best, found])
            best = best.take(
                pa.compute.sort_indices(best, [("_distance", "ascending"), (id_column, "ascending")])[:k]
            )
        if best is not None:
            yield from best.combine_chunks().to_batches()

    schema = StructType([*[df.schema[c] for c in names], StructField("_distance", DoubleType())])
    return picked.mapInArrow(scan, schema).orderBy("_distance", id_column).limit(k)


def _tile_search(
    base: DataFrame, ids: list, q: np.ndarray, k: int, id_column: str, vector: str,
    columns: tuple[str, ...], metric: str, exclude_self: bool, schema: StructType,
) -> DataFrame:
    """Best k rows per task for every query of a tile."""
    shared = base.sparkSession.sparkContext.broadcast((ids, q))
    room = k + 1 if exclude_self else k

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        query_ids, queries = shared.value
        names = pd.Series(query_ids)
        best = None
        step = max(1, (32 << 20) // (8 * max(1, len(query_ids))))  # rows per block of 32 MB
        for batch in batches:
            x, good = matrix(batch.column(1), queries.shape[1])
            row_ids = batch.column(0).take(pa.array(good)).to_pandas()
            for start in range(0, len(x), step):
                block = x[start : start + step]
                rows, cols = candidates(block, queries, room, metric)
                found = pd.DataFrame(
                    {
                        "query": cols,
                        "id": row_ids.iloc[start + rows].to_numpy(),
                        "d": pair_distance(block[rows], queries[cols], metric),
                    }
                )
                at = pa.array(good[start + rows])
                for i, c in enumerate(columns):
                    found[f"c{i}"] = batch.column(2 + i).take(at).to_pandas()
                if exclude_self:
                    found = found[found["id"].to_numpy() != names.to_numpy()[found["query"]]]
                best = found if best is None else pd.concat([best, found])
                best = best.sort_values(["query", "d", "id"]).groupby("query").head(k)
        if best is not None and len(best):
            out = pd.DataFrame(
                {
                    "query_id": names.iloc[best["query"]].to_numpy(),
                    "id": best["id"].to_numpy(),
                    "_distance": best["d"].to_numpy(),
                    **{f"c{i}": best[f"c{i}"].to_numpy() for i in range(len(columns))},
                }
            )
            out.columns = schema.names
            yield pa.RecordBatch.from_pandas(out, preserve_index=False)

    return base.select(id_column, vector, *columns).mapInArrow(scan, schema)


def nearest_join(
    queries: DataFrame, base: DataFrame, k: int = 3, query_id: str = "id", query_vector: str = "vector",
    id_column: str = "id", vector: str = "vector", metric: str = "l2sq", exclude_self: bool = False,
    columns: tuple[str, ...] = (), tile_bytes: int = TILE_BYTES,
) -> DataFrame:
    """For every query the k nearest base rows: query_id, id, ``_distance``, ``columns``, rank.

    The size of the query side is counted first. Up to ``tile_bytes`` it is sent to all tasks, and each keeps its best k rows
    per query. A larger one is joined through cells (``cell_join``), without a loop over parts of it. Both are exact.
    """
    usable = queries.filter(F.col(query_vector).isNotNull())
    facts = usable.agg(
        F.count("*").alias("n"), F.max(F.size(query_vector)).alias("width")
    ).first()
    width = facts["width"] or 1
    name = id_column if id_column != "query_id" else "base_id"
    schema = StructType(
        [
            StructField("query_id", queries.schema[query_id].dataType),
            StructField(name, base.schema[id_column].dataType),
            StructField("_distance", DoubleType()),
            *[base.schema[c] for c in columns],
        ]
    )
    wanted = usable.select(F.col(query_id).alias("q"), F.col(query_vector).alias("v"))
    if facts["n"] * width * 8 <= tile_bytes:
        table = wanted.toArrow()
        q, good = matrix(table["v"].combine_chunks(), width)
        ids = table["q"].take(pa.array(good)).to_pylist()
        found = _tile_search(base, ids, q, k, id_column, vector, columns, metric, exclude_self, schema)
    else:
        found = cell_join(wanted, base.select(id_column, vector, *columns), k, width, metric, exclude_self, tile_bytes, schema)
    rank = F.row_number().over(W.partitionBy("query_id").orderBy("_distance", name))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k)


def check_width(df: DataFrame, vector: str, width: int) -> tuple[DataFrame, DataFrame]:
    """(rows whose vector has the width, the others)."""
    fits = F.coalesce(F.size(vector) == width, F.lit(False))
    return df.filter(fits), df.filter(~fits)


def passages_for(
    rows: DataFrame, key: str, vector: str, passages: DataFrame, k: int = 3,
    passage_id: str = "id", passage_vector: str = "vector", text: str | None = "text",
) -> DataFrame:
    """For each of a few structured rows the k nearest passages, with the row's attributes."""
    columns = (text,) if text else ()
    found = nearest_join(rows, passages, k, key, vector, passage_id, passage_vector, columns=columns)
    return found.join(rows.drop(vector), found["query_id"] == rows[key]).drop("query_id")


class ClusteredIndex:
    """Vectors stored by nearest centroid; a search reads only the closest cells.

    ``path`` holds ``centroids/`` and a versioned table partitioned by ``cell``.
    A cell of any size is spread over many files, and searched by many tasks. Beside its vector each row has a ``code``, its entries
    rounded to 255 steps, an eighth of the bytes. Rows are added without training anew; a cell that has grown too large is split by itself.
    """

    def __init__(self, spark: SparkSession, path: str, id_column: str = "id", vector: str = "vector"):
        from annalist.sources.tables import VersionedTable

        self.spark, self.path = spark, path.rstrip("/")
        self.id_column, self.vector = id_column, vector
        self.table = VersionedTable(spark, f"{self.path}/cells", (id_column,), partition_by=("cell",))
        self._known: tuple[str, np.ndarray, np.ndarray] | None = None

    def exists(self) -> bool:
        return self.table.exists()

    def build(self, df: DataFrame, cells: int | None = None, train_rows: int | None = None, seed: int = 7) -> "ClusteredIndex":
        """Train centroids and store every row that has a vector in the cell of its nearest one.

        Training looks at all rows, or at about ``train_rows`` if given, which
        affects how good the cells are but never which rows are stored. There are the square root of
        the rows in cells by default, as far as ``CENTROID_BYTES`` allows; a cell may be
        of any size. Rows without a vector of the common width, or with numbers that are not finite, are not stored.
        """
        n, width = df.filter(self._finite()).agg(F.count("*"), F.mode(F.size(self.vector))).first()
        df = self._usable(df, width or 0)
        most = max(1, CENTROID_BYTES // (8 * max(1, width or 1)))
        cells = cells or max(1, min(int(math.sqrt(n)), most))
        if cells > most:
            raise ValueError(f"{cells} centroids are too large to send to every task")
        training = df.select(self.id_column, F.col(self.vector).cast("array<double>").alias("v"))
        if train_rows is not None and n > train_rows:
            training = training.filter(key_hash(self.id_column, seed=seed) < int(train_rows / n * 2**32))
        # Codes go as far as the vectors of the build; entries beyond are cut, which only the first choice of a refined search sees.
        reach = training.select(F.array_max(F.transform("v", F.abs)).alias("m")).agg(F.max("m")).first()[0] or 1.0
        self._publish(self._trained(training, cells, seed), reach, lambda: self.table.overwrite(self.assign(df)))
        return self

    def _finite(self):
        finite = F.forall(self.vector, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))
        return F.col(self.vector).isNotNull() & finite

    def _usable(self, df: DataFrame, width: int) -> DataFrame:
        return df.filter(self._finite() & (F.size(self.vector) == width))

    def _trained(self, training: DataFrame, cells: int, seed: int) -> np.ndarray:
        from pyspark.ml.clustering import KMeans
        from pyspark.ml.functions import array_to_vector

        model = KMeans(k=cells, seed=seed, maxIter=10, featuresCol="features").fit(training.select(array_to_vector("v").alias("features")))
        return np.array([list(map(float, c)) for c in model.clusterCenters()])

    def _publish(self, centroids: np.ndarray, reach: float, commit: Callable[[], None]) -> None:
        """Write centroids beside those that readers still use, then the cells; the version of the cells that names the folder switches both."""
        rows = [(i, c.tolist(), reach) for i, c in enumerate(centroids)]
        version = (self.table.versions() or [0])[-1] + 1
        self.spark.createDataFrame(rows, "cell int, centroid array<double>, reach double").coalesce(1).write.mode(
            "overwrite"
        ).parquet(f"{self.path}/centroids/version={version}")
        self._known = (version, centroids, np.float64(reach))
        commit()

    def _trained_state(self) -> tuple[np.ndarray, float]:
        """Centroids and reach of the newest version that has them; batches added since belong to them."""
        names = self.table._names(f"{self.path}/centroids")
        current = max(v for v in (int(n.split("=")[1]) for n in names) if v <= self.table.versions()[-1])
        if self._known is None or self._known[0] != current:
            rows = self.spark.read.parquet(f"{self.path}/centroids/version={current}").orderBy("cell").collect()
            self._known = (current, np.array([r["centroid"] for r in rows]), rows[0]["reach"])
        return self._known[1], float(self._known[2])

    def centroids(self) -> np.ndarray:
        return self._trained_state()[0]

    def assign(self, df: DataFrame, among: list[int] | None = None) -> DataFrame:
        """Add the cell of the nearest centroid (of ``among``, if given), and the code, to every row."""
        _, centroids, reach = self._known
        chosen = np.arange(len(centroids)) if among is None else np.array(among)
        shared = self.spark.sparkContext.broadcast(centroids[chosen])  # at most CENTROID_BYTES

        @F.pandas_udf("cell int, code binary")
        def _cell(vectors: pd.Series) -> pd.DataFrame:
            centers, cells, codes = shared.value, [], []
            step = max(1, BLOCK_BYTES // (8 * max(len(centers), 1)))
            for a in range(0, len(vectors), step):
                x = np.stack(vectors.iloc[a : a + step].to_numpy()).astype(np.float64)
                cells.append(chosen[block_distance(x, centers, "l2sq").argmin(axis=1)])
                codes += [c.tobytes() for c in np.rint(np.clip(x / reach, -1, 1) * 127).astype(np.int8)]
            return pd.DataFrame({"cell": np.concatenate(cells) if cells else [], "code": codes})

        found = "_cell"
        while found in df.columns:
            found += "_"
        named = df.drop("cell", "code").withColumn(found, _cell.asNondeterministic()(self.vector))
        return named.withColumns({"cell": F.col(f"{found}.cell"), "code": F.col(f"{found}.code")}).drop(found)

    def add(self, df: DataFrame, most_rows: int | None = None) -> None:
        """Put rows into the cells of the trained centroids; a row whose id is there already takes its place.

        Only the new rows and delete marks for ids that change their cell are written. With ``most_rows`` cells that
        have grown beyond it are split.
        """
        centroids, _ = self._trained_state()
        rows = stage(self.assign(self._usable(df, centroids.shape[1])), "added")
        old = self.table.df().select(self.id_column, "cell")
        moved = rows.select(F.col(self.id_column).alias("_id"), F.col("cell").alias("_cell"))
        gone = old.join(moved, F.col(self.id_column).eqNullSafe(F.col("_id")), "inner").filter("cell <> _cell")
        self.table.remove(stage(gone.select(self.id_column, "cell"), "moved"))
        self.table.upsert(rows.select(*[c for c in self.table.schema().names]), self.id_column)
        if most_rows:
            self.split(most_rows)

    def split(self, most_rows: int, seed: int = 7) -> None:
        """Split each cell of more than ``most_rows`` rows by centroids of its own; no other cell is read or written."""
        centroids, reach = self._trained_state()
        sizes = self.table.df().groupBy("cell").agg(F.count("*").alias("n")).filter(F.col("n") > most_rows).collect()
        for r in sorted(sizes, key=lambda r: r["cell"]):
            own = self.table.df().filter(F.col("cell") == r["cell"]).drop("cell", "code")
            training = own.select(F.col(self.vector).cast("array<double>").alias("v"))
            parts = self._trained(training, math.ceil(r["n"] / most_rows), seed)
            if len(parts) < 2:  # equal vectors stay together
                continue
            among = [r["cell"], *range(len(centroids), len(centroids) + len(parts) - 1)]
            centroids = np.concatenate([centroids, parts[1:]])
            centroids[r["cell"]] = parts[0]
            if centroids.nbytes > CENTROID_BYTES:
                raise ValueError(f"{len(centroids)} centroids are too large to send to every task")
            old = self.table.manifest()
            names = self.table.schema().names
            self._publish(centroids, reach, lambda: self.table._commit(self.assign(own, among).select(*names), old, [f"cell={r['cell']}"], None))

    def search(
        self, query: list[float], k: int = 3, probes: int = 20, columns: tuple[str, ...] = ("text",), metric: str = "l2sq", refine: int | None = None,
    ) -> DataFrame:
        """Nearest rows among the ``probes`` closest cells; partition pruning skips the others.

        Probing every cell gives the exact answer. With ``refine`` the codes choose ``k * refine`` rows first, and only of those the vectors
        are read and compared.
        """
        centroids, reach = self._trained_state()
        d = block_distance(np.asarray(query, np.float64)[None, :], centroids, "l2sq")[0]
        cells = [int(c) for c in np.argsort(d, kind="stable")[:probes]]
        rows = self.table.df().filter(F.col("cell").isin(cells))
        if refine:
            entries = F.pandas_udf(lambda codes: codes.map(lambda c: np.frombuffer(c, np.int8).astype(np.float64) * (reach / 127)), "array<double>")
            near = nearest(rows.select(self.id_column, entries("code").alias("near")), query, k * refine, self.id_column, "near", (), metric)
            ids = [r[0] for r in near.select(self.id_column).collect()]  # k * refine
            rows = rows.filter(F.col(self.id_column).isin(ids))
        return nearest(rows, query, k, self.id_column, self.vector, columns, metric)
