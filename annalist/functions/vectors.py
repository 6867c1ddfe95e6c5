"""Vector expressions and embedding functions."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

_WORD = re.compile(r"[^ \t\n\r\f\v]+")

# An embedder takes a list of texts and returns one row of numbers per text.
Embedder = Callable[[list[str]], np.ndarray]


def dot(a: Column, b: Column) -> Column:
    terms = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(terms, F.lit(0.0), lambda s, t: s + t)


def squared_l2(a: Column, b: Column) -> Column:
    """Squared Euclidean distance in double precision, inside the JVM."""
    gap = lambda x, y: x.cast("double") - y.cast("double")
    terms = F.zip_with(a, b, lambda x, y: gap(x, y) * gap(x, y))
    return F.aggregate(terms, F.lit(0.0), lambda s, t: s + t)


def cosine_distance(a: Column, b: Column) -> Column:
    return 1 - dot(a, b) / F.sqrt(dot(a, a) * dot(b, b))


@dataclass(frozen=True)
class HashingEmbedder:
    """Deterministic bag-of-words vectors: signed counts in hashed places, unit length.

    Needs no model; used for tests and as the default of a store.
    """

    width: int = 64

    def _places(self, words: Iterable[str]) -> tuple[np.ndarray, np.ndarray]:
        """Place and sign of each word, from the first five bytes of its SHA-256."""
        digests = b"".join(hashlib.sha256(w.encode()).digest() for w in words)
        codes = np.frombuffer(digests, np.uint8).reshape(-1, 32)
        places = codes[:, :4].copy().view(">u4").ravel().astype(np.int64) % self.width
        return places, np.where(codes[:, 4] < 128, 1.0, -1.0)

    def __call__(self, texts: list[str]) -> np.ndarray:
        numbers: dict[str, int] = {}
        words = [
            [numbers.setdefault(w, len(numbers)) for w in _WORD.findall(text)] for text in texts
        ]
        places, signs = self._places(numbers)
        out = np.stack(
            [np.bincount(places[w], signs[w], self.width) if w else np.zeros(self.width) for w in words]
            or [np.zeros(self.width)]
        )
        out = out[: len(texts)]
        norm = np.linalg.norm(out, axis=1, keepdims=True)
        return (out / np.where(norm == 0, 1, norm)).astype(np.float32)


def embed(text: Column, factory: Callable[[], Embedder]) -> Column:
    """Embed a text column; ``factory`` builds the model once per Python worker and task.

    Declared non-deterministic so that the optimizer never evaluates it twice,
    as it would when a later filter or explode on the vector is pushed down.
    """

    @F.pandas_udf("array<float>")
    def _embed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = factory()
        for texts in batches:
            rows = np.asarray(model(texts.fillna("").tolist()), dtype=np.float32)
            yield pd.Series(list(rows), index=texts.index)

    return _embed.asNondeterministic()(text)


def with_vectors(
    df: DataFrame, text: str, factory: Callable[[], Embedder], by: str, name: str = "vector"
) -> DataFrame:
    """Add the vector of a text column.

    The rows are first spread by ``by`` over all tasks: embedding costs far more
    than moving the text, and the files of a batch rarely match the cores.
    """
    return df.repartition(by).withColumn(name, embed(F.col(text), factory))
