"""Distances of blocks of vectors, in NumPy."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

# Bytes of distances that are held at once.
BLOCK_BYTES = 32 << 20


def matrix(column: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows of a list column that have the right width and only finite numbers, and which rows these are."""
    lengths = column.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False)
    good = np.flatnonzero(lengths == width)
    if len(good) < len(column):
        column = column.take(pa.array(good))
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(good), width)
    finite = np.isfinite(values).all(axis=1)
    return values[finite], good[finite]


def pair_distance(x: np.ndarray, q: np.ndarray, metric: str) -> np.ndarray:
    """Distances of row i of ``x`` to row i of ``q``."""
    if metric == "cosine":
        norms = np.linalg.norm(x, axis=1) * np.linalg.norm(q, axis=1)
        return 1 - np.einsum("ij,ij->i", x, q) / np.where(norms == 0, 1, norms)
    gap = x - q
    squared = np.einsum("ij,ij->i", gap, gap)
    return np.sqrt(squared) if metric == "l2" else squared


def block_distance(x: np.ndarray, q: np.ndarray, metric: str) -> np.ndarray:
    """All distances by one matrix product; exact only up to rounding (used to preselect)."""
    if metric == "cosine":
        x = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)
        q = q / np.maximum(np.linalg.norm(q, axis=1, keepdims=True), 1e-300)
        return 1 - x @ q.T
    return (x * x).sum(1)[:, None] + (q * q).sum(1)[None, :] - 2 * (x @ q.T)


def candidates(x: np.ndarray, q: np.ndarray, k: int, metric: str) -> tuple[np.ndarray, np.ndarray]:
    """(row, query) pairs that may be among the k nearest of the block, all ties included."""
    if metric == "cosine":
        scale = 4.0
    else:
        # Differences do not change, and the product rounds less around the middle of the block.
        middle = x.mean(axis=0)
        x, q = x - middle, q - middle
        scale = (x * x).sum(1).max() + (q * q).sum(1)
    with np.errstate(over="ignore", invalid="ignore"):
        d = block_distance(x, q, metric)
        kth = np.partition(d, min(k, len(x)) - 1, axis=0)[min(k, len(x)) - 1]
        # Beyond what the product, in sums of this length and size, can be wrong. Overflown ones stay candidates.
        slack = 8 * np.finfo(np.float64).eps * (x.shape[1] + 4) * scale
        return np.nonzero(~(d > kth + 2 * slack))


class Near:
    """Rows prepared once, in parts that a processor's cache holds, for many queries whose answers are bounded.

    Products are taken in single precision, and only choose candidates.
    """

    ROWS, QUERIES = 4096, 512
    #: Squares beyond this could overflow in single precision: such rows and queries are compared with all.
    MOST = 1e36

    def __init__(self, x: np.ndarray, metric: str):
        self.metric, self.parts = metric, []
        self.room = np.empty(self.ROWS * self.QUERIES, dtype=np.float32)
        for a in range(0, len(x), self.ROWS):
            some = x[a : a + self.ROWS]
            with np.errstate(over="ignore", invalid="ignore"):
                if metric == "cosine":
                    middle, wide, most = 0.0, some / np.maximum(np.linalg.norm(some, axis=1, keepdims=True), 1e-300), 1.0
                else:
                    middle = some.mean(axis=0)
                    some = some - middle
                    own = (some * some).sum(1)
                    own[~(own < self.MOST)] = np.nan  # compares as neither near nor far
                    wide, most = np.concatenate([some, own[:, None]], axis=1), np.nanmax(own, initial=0)
                self.parts.append((a, middle, np.ascontiguousarray(wide.T.astype(np.float32)), most))

    def within(self, q: np.ndarray, room: int, reach: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, query) pairs that may be among the ``room`` nearest and no farther than ``reach``, all ties included.

        ``reach`` is the distance of unit vectors for cosine, else the one between the points.
        """
        found = [
            self._within(q[b : b + self.QUERIES], room, reach[b : b + self.QUERIES], b, *part)
            for b in range(0, len(q), self.QUERIES)
            for part in self.parts
        ]
        return tuple(np.concatenate([f[n] for f in found]) for n in range(2)) if found else (np.zeros(0, int), np.zeros(0, int))

    def _within(self, q: np.ndarray, room: int, reach: np.ndarray, before: int, first: int, middle, wide: np.ndarray, most: float) -> tuple[np.ndarray, np.ndarray]:
        with np.errstate(over="ignore", invalid="ignore"):
            if self.metric == "cosine":
                left, own, bound = -q / np.maximum(np.linalg.norm(q, axis=1, keepdims=True), 1e-300), np.ones(len(q)), reach * reach / 2
            else:
                q = q - middle
                own, bound = (q * q).sum(1), reach * reach
                own[~(own < self.MOST)] = np.nan
                left = np.concatenate([-2 * q, np.ones((len(q), 1))], axis=1)
            # Beyond what the product, in sums of this length and size, can be wrong, as in ``candidates``.
            slack = 16 * float(np.finfo(np.float32).eps) * (len(wide) + 4) * (most + own) + 1e-36
            out = self.room[: len(q) * wide.shape[1]].reshape(len(q), -1)
            d = np.matmul(left.astype(np.float32), wide, out=out)  # without what a query adds to all its distances
            limit = (bound * (1 + 1e-9) - own + slack).astype(np.float32)
            far = d > limit[:, None]
            many = np.flatnonzero(far.shape[1] - np.count_nonzero(far, axis=1) > 4 * room)
            if len(many) and room < d.shape[1]:
                kth = np.partition(d[many], room - 1, axis=1)[:, room - 1] + 2 * slack[many]
                kth = np.where(np.isnan(limit[many]), np.nan, np.fmin(limit[many], kth)).astype(np.float32)
                far[many] = d[many] > kth[:, None]
        query, row = np.divmod(np.flatnonzero(~far), far.shape[1])
        return row + first, query + before
