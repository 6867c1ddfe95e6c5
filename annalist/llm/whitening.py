"""Whitening of embeddings by an incremental eigendecomposition.

Each partition keeps the spectrum (eigenvalues and eigenvectors) of the scatter
of the rows it has seen. A row changes it by one centred rank-one term, whose
new eigenvalues are the roots of a secular equation; entries that the term does not
touch and equal eigenvalues are set aside first (deflation). The spectra of partitions are
combined pairwise, again by rank-one terms: the components of one, and the gap
of the means. A tree of such steps leaves one spectrum. Its basis is complete, so one
distributed Rayleigh-Ritz pass, which projects all centred rows on
it, gives the eigenvectors to double precision.

A task holds a batch of rows and a few matrices of the dimension squared, whatever the
number of rows; the driver holds one. A row costs the dimension cubed.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from annalist.llm.common import bounded_batches, stage

EPS = np.finfo(np.float64).eps
#: Spectra that one step combines, updates after which a basis is made orthonormal anew, and entries beyond which a vector is not used.
FAN_IN, RENEW, LARGEST = 8, 512, 2**40


def quantised(vectors: DataFrame, vector: str, scale: int, offset: int) -> DataFrame:
    """``vectors`` with ``x``, the entries times ``scale``, rounded down, plus ``offset``, as longs.

    Rows whose vector is null or holds a null or an entry that is not finite (or beyond 2^40 once scaled) are left out.
    """
    scaled: Callable[[Column], Column] = lambda c: c.cast("double") * scale
    sound = F.forall(vector, lambda c: F.coalesce(~F.isnan(c) & (F.abs(scaled(c)) <= LARGEST), F.lit(False)))
    return vectors.filter(F.col(vector).isNotNull() & sound).withColumn("x", F.transform(vector, lambda c: F.floor(scaled(c)) + offset))


def secular_roots(d: np.ndarray, z2: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Roots of 1 + sum(z2 / (d - r)) for rising ``d`` and positive ``z2``, and the differences d[j] - r[i] by row i.

    Root i lies between d[i] and d[i + 1] (the last beyond d[-1]) and is found as an offset from the nearer
    pole, so that the differences keep their relative precision. A step solves the equation with one pole on each side that has
    the same value and slopes, kept within a shrinking bracket.
    """
    k = len(d)
    right = np.append(d[1:], d[-1] + z2.sum())
    half = (right - d) / 2
    at_half = 1 + (z2 / (d[None, :] - d[:, None] - half[:, None])).sum(axis=1)
    from_left = at_half >= 0
    from_left[-1] = True
    origin = np.where(from_left, d, right)
    delta = d[None, :] - origin[:, None]
    far = right - origin
    low, high = np.where(from_left, 0.0, -half), np.where(from_left, half, 0.0)
    if at_half[-1] < 0:
        low[-1], high[-1] = half[-1], 2 * half[-1]
    r = (low + high) / 2
    rows = np.arange(k)
    up_to = np.tri(k, dtype=bool)
    for _ in range(60):
        gap = delta - r[:, None]
        terms = z2 / gap
        f = 1 + terms.sum(axis=1)
        slopes = terms / gap
        slope = slopes.sum(axis=1)
        # Roots stay once they are as near as the rounding of the terms and of the root itself allows.
        open_ = np.abs(f) > 4 * EPS * (k * (1 + np.abs(terms).sum(axis=1)) + np.abs(r) * slope)
        if not open_.any():
            break
        low, high = np.where(f < 0, r, low), np.where(f < 0, high, r)
        before = np.where(up_to, slopes, 0.0).sum(axis=1)
        after = slope - before
        g1, g2 = gap[rows, rows], far - r
        a, b = (g1 + g2) * f - g1 * g2 * slope, g1 * g2 * f
        c = f - g1 * before - g2 * after
        with np.errstate(all="ignore"):
            root = np.sqrt(np.maximum(a * a - 4 * b * c, 0))
            step = np.where(a <= 0, (a - root) / (2 * c), 2 * b / (a + root))
        new = r + step
        inside = (new > low) & (new < high)
        r = np.where(open_, np.where(inside, new, (low + high) / 2), r)
    return origin + r, delta - r[:, None]


class Spectrum:
    """Eigenvalues (rising) and eigenvectors (columns) of a scatter matrix, with the rows' number and mean."""

    def __init__(self, width: int):
        self.n, self.mean = 0, np.zeros(width)
        self.values, self.vectors = np.zeros(width), np.eye(width)
        self.updates = 0

    def add_row(self, x: np.ndarray) -> None:
        gap = x - self.mean
        self.n += 1
        self.mean += gap / self.n
        if self.n > 1:
            self.update(gap, (self.n - 1) / self.n)

    def update(self, v: np.ndarray, weight: float) -> None:
        """Add ``weight`` times the outer product of ``v``."""
        z = self.vectors.T @ v
        size = weight * float(z @ z)
        if not size:
            return
        least = 8 * EPS * max(self.values[-1], size)
        equal = np.diff(self.values) <= least
        if equal.any():
            self._turn_equal(z, equal)
        live = np.flatnonzero(np.abs(z) * weight * np.sqrt(size / weight) > least)
        if not len(live):
            return
        d, own = self.values[live], z[live]
        if len(live) == 1:
            self.values[live] = d + weight * own * own
        else:
            roots, gaps = secular_roots(d, weight * own * own)
            # The entries for which the computed roots are exact make the eigenvectors orthogonal.
            spread = d[None, :] - d[:, None]
            np.fill_diagonal(spread, 1.0)
            ratio = -gaps.T / spread
            exact = np.sqrt(np.abs(ratio.prod(axis=1)))
            turned = np.where(own < 0, -exact, exact)[:, None] / gaps.T
            turned /= np.sqrt((turned * turned).sum(axis=0))
            self.vectors[:, live] = self.vectors[:, live] @ turned
            self.values[live] = roots
        if (np.diff(self.values) < 0).any():
            order = np.argsort(self.values, kind="stable")
            self.values, self.vectors = self.values[order], self.vectors[:, order]
        self.updates += 1
        if self.updates % RENEW == 0:
            q, r = np.linalg.qr(self.vectors)
            self.vectors = q * np.sign(np.diag(r))

    def _turn_equal(self, z: np.ndarray, equal: np.ndarray) -> None:
        """Reflect each run of equal eigenvalues so that only its last vector meets the term."""
        edges = np.flatnonzero(np.diff(np.r_[False, equal, False].astype(np.int8)))
        for start, end in zip(edges[::2], edges[1::2] + 1):
            own = z[start:end].copy()
            norm = np.sqrt(own @ own)
            rest = own[:-1]
            if not (rest @ rest):
                continue
            own[-1] += norm if own[-1] >= 0 else -norm
            own /= np.sqrt(own @ own)
            block = self.vectors[:, start:end]
            self.vectors[:, start:end] = block - 2 * np.outer(block @ own, own)
            last = z[end - 1]
            z[start : end - 1] = 0
            z[end - 1] = -norm if last >= 0 else norm

    def merge(self, other: Spectrum) -> None:
        """Add another spectrum: its components, and the scatter between the two means."""
        if not other.n:
            return
        if not self.n:
            self.__dict__.update(other.__dict__)
            return
        gap, n = other.mean - self.mean, self.n + other.n
        for value, vector in zip(other.values, other.vectors.T):
            if value > 0:
                self.update(vector, value)
        self.update(gap, self.n * other.n / n)
        self.mean += gap * (other.n / n)
        self.n = n

    def row(self) -> dict:
        return {"n": self.n, "state": np.concatenate([self.mean, self.values, self.vectors.ravel()]).tobytes()}

    @classmethod
    def of(cls, row: dict, width: int) -> Spectrum:
        found, state = cls(width), np.frombuffer(row["state"], dtype=np.float64).copy()
        found.n, found.mean, found.values = row["n"], state[:width], state[width : 2 * width]
        found.vectors = state[2 * width :].reshape(width, width)
        return found


def matrix_of(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


STATE = "id bigint, n bigint, state binary"


def combined(parts: DataFrame, fold: Callable[[list[dict]], dict]) -> dict | None:
    """One state from all rows of ``parts``, by steps that fold ``FAN_IN`` rows each."""
    parts = stage(parts, "states")
    while (left := parts.count()) > 1:
        def run(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
            rows = frame.sort_values("id").to_dict("records")
            return pd.DataFrame([{"id": int(key[0])} | fold(rows)], columns=["id", "n", "state"])

        # Ids are dealt anew, so that the groups are full (one row per partition of the input).
        dense = parts.withColumn("id", F.row_number().over(Window.orderBy("id")) - 1) if left > FAN_IN else parts.withColumn("id", F.lit(0))
        parts = stage(dense.withColumn("node", F.floor(F.col("id") / FAN_IN)).groupBy("node").applyInPandas(run, STATE), "states")
    return next((r.asDict() for r in parts.toLocalIterator()), None)


def folded(rows: DataFrame, width: int, start: Callable[[], object], take: Callable[[object, np.ndarray], None], close: Callable[[object], dict]) -> DataFrame:
    """One state per partition of ``rows`` that has any."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        state, seen = start(), False
        for batch in batches:
            if batch.num_rows:
                take(state, matrix_of(batch.column("x"), width))
                seen = True
        if seen:
            yield pa.RecordBatch.from_pylist(
                [{"id": TaskContext.get().partitionId()} | close(state)], pa.schema([("id", pa.int64()), ("n", pa.int64()), ("state", pa.binary())])
            )

    return rows.select("x").mapInArrow(run, STATE)


def add_matrices(rows: list[dict]) -> dict:
    return {"n": sum(r["n"] for r in rows), "state": sum(np.frombuffer(r["state"], dtype=np.float64) for r in rows).tobytes()}


@dataclass
class Whitening:
    """What a fit found: rows, sums of each dimension, components as columns with their eigenvalues, and checks."""

    n: int
    sums: list[int]
    components: np.ndarray
    values: np.ndarray
    explained: np.ndarray
    identity_error: float

    def centred(self, x: np.ndarray) -> np.ndarray:
        return scaled_gaps(x, self.n, self.sums).astype(np.float64) / self.n

    def whitened(self, x: np.ndarray) -> np.ndarray:
        return self.centred(x) @ self.components / np.sqrt(self.values)


def scaled_gaps(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n x - S, exact: longs where they suffice, else Python integers."""
    fits = n * int(np.abs(x).max(initial=0)) + max(map(abs, sums), default=0) < 2**62
    return n * x - np.array(sums, dtype=np.int64) if fits else n * x.astype(object) - np.array(sums, dtype=object)


def deviations(x: np.ndarray, n: int, sums: list[int]) -> list[int | None]:
    """Sums of squares of n x - S; null where one does not fit a long."""
    gaps = scaled_gaps(x, n, sums)
    if gaps.dtype == object or float(np.abs(gaps).max(initial=0)) ** 2 * gaps.shape[1] >= 2**62:
        gaps = gaps.astype(object)
        return [int(t) if t < 2**63 else None for t in (gaps * gaps).sum(axis=1)]
    return (gaps * gaps).sum(axis=1).tolist()


def of_main_width(vectors: DataFrame) -> tuple[DataFrame, int]:
    """Rows whose ``x`` has the most frequent length (the largest of several; not 0), and that length."""
    lengths = vectors.groupBy(F.size("x").alias("width")).agg(F.count("*").alias("n")).filter("width > 0")
    top = lengths.orderBy(F.desc("n"), F.desc("width")).first()
    width = top.width if top else 0
    return vectors.filter(F.size("x") == width), width


def fit(vectors: DataFrame, most: int = 32) -> Whitening | None:
    """The ``most`` largest components of all rows' ``x`` (arrays of longs of one length). No rows: none.

    Components of no variance are left out, as nothing can be scaled by them: equal rows, or one row, have no component.
    """
    bounded_batches(vectors.sparkSession)
    rows, width = of_main_width(vectors)
    if not width:
        return None

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums = 0, [0] * width
        for batch in batches:
            x = matrix_of(batch.column("x"), width)
            n, sums = n + len(x), [a + b for a, b in zip(sums, x.sum(axis=0).tolist())]
        values = pa.array([Decimal(s) for s in [n, *sums]], pa.decimal128(38, 0))
        yield pa.RecordBatch.from_pydict({"dim": pa.array(range(-1, width), pa.int32()), "total": values})

    totals = rows.select("x").mapInArrow(total, "dim int, total decimal(38,0)").groupBy("dim").agg(F.sum("total").alias("total")).orderBy("dim").collect()
    n, *sums = (int(r.total) for r in totals)
    near = np.array([round(s / n) for s in sums], dtype=np.int64)

    def grow(spectrum: Spectrum, x: np.ndarray) -> None:
        for row in (x - near).astype(np.float64):
            spectrum.add_row(row)

    def merge(states: list[dict]) -> dict:
        first, *others = (Spectrum.of(s, width) for s in states)
        for other in others:
            first.merge(other)
        return first.row()

    found = Spectrum.of(combined(folded(rows, width, lambda: Spectrum(width), grow, Spectrum.row), merge), width)
    basis = np.linalg.qr(found.vectors)[0]
    none = Whitening(n, sums, np.zeros((width, 0)), np.zeros(0), np.zeros(0), 0.0)

    def project(state: np.ndarray, x: np.ndarray) -> None:
        y = none.centred(x) @ basis
        state += y.T @ y

    summed = combined(folded(rows, width, lambda: np.zeros((width, width)), project, lambda s: {"n": 0, "state": s.tobytes()}), add_matrices)
    ritz = np.frombuffer(summed["state"], dtype=np.float64).reshape(width, width) / n
    values, turned = np.linalg.eigh((ritz + ritz.T) / 2)
    trace = float(np.trace(ritz))
    keep = [k for k in np.argsort(-values, kind="stable")[:most] if values[k] > 4 * EPS * width * max(values[-1], 0.0) and trace > 0]
    model = Whitening(n, sums, np.linalg.qr(basis @ turned)[0][:, keep] if keep else none.components, values[keep], values[keep] / (trace or 1.0), 0.0)
    if keep:
        k = len(keep)

        def check(state: np.ndarray, x: np.ndarray) -> None:
            w = model.whitened(x)
            state[:k] += w.T @ w
            state[k] += w.sum(axis=0)

        summed = combined(folded(rows, width, lambda: np.zeros((k + 1, k)), check, lambda s: {"n": 0, "state": s.tobytes()}), add_matrices)
        s = np.frombuffer(summed["state"], dtype=np.float64).reshape(k + 1, k) / n
        model.identity_error = float(np.abs(s[:k] - np.outer(s[k], s[k]) - np.eye(k)).max())
    return model


ROWS = "component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"


def whiten(vectors: DataFrame, model: Whitening | None, name: str = "vec_id") -> DataFrame:
    """One row per row and component: ``name``, the component from 1, and what the model says of it.

    Other columns of ``vectors`` are not read. Rows of another length than the model's have no result; equal rows have equal ones; no model: no rows.
    ``deviation`` is null where it does not fit a long.
    """
    width = len(model.sums) if model else 0
    rows = vectors.select(F.col(name), "x").filter(F.size("x") == width if model else F.lit(False))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, k = matrix_of(batch.column("x"), width), len(model.values)
            n = len(x)
            each = pa.array(np.repeat(np.arange(n), k))
            yield pa.RecordBatch.from_pydict({
                name: batch.column(0).take(each), "component": pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), n)),
                "n": pa.array(np.full(n * k, model.n)), "deviation": pa.array(deviations(x, model.n, model.sums), pa.int64()).take(each),
                "whitened": pa.array(model.whitened(x).ravel()), "explained": pa.array(np.tile(model.explained, n)),
                "identity_error": pa.array(np.full(n * k, model.identity_error)),
            })

    return rows.mapInArrow(run, f"`{name}` {dict(rows.dtypes)[name]}, {ROWS}")
