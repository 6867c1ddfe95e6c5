"""Quality by robust multivariate outliers.

Each text becomes a vector of transformed statistics. For every language and
source a minimum-covariance-determinant estimate describes its bulk. Three starts
are taken from medians and quartile ranges: no correlations, those of hyperbolic tangents, and those of
spatial signs. From each, concentration steps keep the share ``BULK`` of rows that lies nearest
and estimate mean and covariance anew from those; the one with the least determinant is kept. Rows far
from the bulk by Mahalanobis distance are rejected. Groups with fewer than
``LEAST`` rows are judged by their language as a whole, and too small languages by all rows.

A step is one aggregation by group and distance class: sums and cross products
are combined on the map side, so a group may hold any share of the rows. The
classes give the exact count of rows within any of their bounds, without a sort; the class in which the
share is reached counts with the part that is still wanted, so ties weigh alike and the share is met.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache
from statistics import NormalDist

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from annalist.llm.common import bounded_batches, stage

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
SYMBOLS = "#*$%&|<>"
#: Shares of rows that a step keeps, steps, and rows that an estimate needs.
BULK, STEPS, LEAST = 0.7, 5, 200
#: Standard normal quantile of the share of clean rows to keep (for 5: all but one in three million, were they normal).
STRICT = 5.0
#: Statistics with the least spread they are given, so that a constant one (no symbols anywhere) judges softly.
FEATURES = {"length": 0.5, "word": 0.06, "symbols": 0.04, "lines": 0.2, "repeats": 0.15, "marks": 0.05, "capitals": 0.05}
P = len(FEATURES)
#: Classes of squared distances per doubling, and of a statistic per unit.
FINE, GRID = 32, 512
PAIRS = [(i, j) for i in range(P) for j in range(i + 1)]


@lru_cache(maxsize=1)
def kinds() -> np.ndarray:
    """For each 16-bit code: 0 mark or digit, 1 letter, 2 capital, 3 white space."""
    names = [unicodedata.category(chr(c)) for c in range(1 << 16)]
    return np.array([2 if n == "Lu" else 1 if n[0] in "LMC" and n != "Cc" else 3 if n[0] == "Z" or n == "Cc" else 0 for n in names], np.uint8)


def statistics(text: str) -> tuple[int, int, int, int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, lines with a word, marks, capitals."""
    words = WORDS.findall(text)
    numbers: dict[str, int] = {}
    ids = np.array([numbers.setdefault(w, len(numbers)) for w in words], dtype=np.int64)
    repeated = 0
    if len(ids) > 2:
        _, of = np.unique(ids[:-2] * len(numbers) + ids[1:-1], return_inverse=True)
        _, of = np.unique(of * len(numbers) + ids[2:], return_inverse=True)
        twice = np.bincount(of)[of] > 1
        marked = np.zeros(len(ids), dtype=bool)
        for k in range(3):
            marked[k : len(ids) - 2 + k] |= twice
        repeated = int(marked.sum())
    lines = [x for x in text.split("\n") if WORDS.search(x)]
    kind = np.bincount(kinds()[np.frombuffer(text.encode("utf-16-le", "surrogatepass"), np.uint16)], minlength=4)
    symbols = sum(map(text.count, SYMBOLS))
    return len(words), sum(map(len, words)), symbols, len(lines) - len(set(lines)), repeated, len(lines), int(kind[0]), int(kind[2])


def measured(docs: DataFrame) -> DataFrame:
    """``doc_id, lang, source``, the statistics and the transformed ones of each row."""
    counts = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "lines_", "marks_", "capitals_")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([statistics(t or "") for t in batch.column("text").to_pylist()], dtype=np.int64).reshape(-1, len(counts))
            columns = {c: batch.column(c) for c in ("doc_id", "lang", "source")}
            yield pa.RecordBatch.from_pydict(columns | {c: pa.array(found[:, k]) for k, c in enumerate(counts)})

    rows = docs.select("doc_id", F.col("lang").cast("string").alias("lang"), F.col("source").cast("string").alias("source"), "text")
    schema = f"doc_id {dict(rows.dtypes)['doc_id']}, lang string, source string, " + ", ".join(f"{c} bigint" for c in counts)
    found = rows.mapInArrow(run, schema)
    share = lambda a, b: F.sqrt(F.col(a) / F.greatest(F.col(b), F.lit(1)))
    values = {
        "length": F.log1p("n_words"), "word": F.log(F.greatest(F.col("word_chars") / F.greatest("n_words", F.lit(1)), F.lit(0.5))),
        "symbols": share("n_symbols", "word_chars"), "lines": share("n_dup_lines", "lines_"), "repeats": share("n_repeat_words", "n_words"),
        "marks": share("marks_", "word_chars"), "capitals": share("capitals_", "word_chars"),
    }
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return found.select(*found.columns[:8], failed.alias("base_failed"), *[values[f].alias(f"x{k}") for k, f in enumerate(FEATURES)])


def distance() -> Column:
    """Squared Mahalanobis distance from the columns ``x``, ``m`` (mean) and ``w`` (inverse of the covariance's root)."""
    off = [F.col(f"x{k}") - F.col(f"m{k}") for k in range(P)]
    total = F.lit(0.0)
    for i in range(P):
        inner = sum((F.col(f"w{i}_{j}") * off[j] for j in range(1, i + 1)), F.col(f"w{i}_0") * off[0])
        total = total + inner * inner
    return total


def distance_class(d: Column) -> Column:
    return F.floor(F.log2(F.greatest(d, F.lit(1e-6))) * FINE).cast("int")


def chi_square(z: float) -> float:
    """Quantile of the chi-square distribution of P degrees at a normal quantile (Wilson and Hilferty)."""
    return P * (1 - 2 / (9 * P) + z * math.sqrt(2 / (9 * P))) ** 3


def consistency(bulk: float) -> float:
    """How much wider a normal distribution is than its central share (the same approximation, of P + 2 degrees)."""
    q, k = chi_square(NormalDist().inv_cdf(bulk)), P + 2
    return bulk / NormalDist().cdf(((q / k) ** (1 / 3) - (1 - 2 / (9 * k))) / math.sqrt(2 / (9 * k)))


def parameters(means: np.ndarray, cov: np.ndarray) -> dict[str, float]:
    root = np.linalg.inv(np.linalg.cholesky(cov))
    return {f"m{k}": means[k] for k in range(P)} | {f"w{i}_{j}": root[i, j] for i, j in PAIRS}


PARAMETERS = ", ".join([f"m{k} double" for k in range(P)] + [f"w{i}_{j} double" for i, j in PAIRS])
FLOOR = np.diag(np.square(list(FEATURES.values())))


def first_estimates(keyed: DataFrame) -> DataFrame:
    """Medians and scaled quartile ranges of each group, from its counts by class; the start without correlations."""
    classes = F.array([F.floor(F.col(f"x{k}") * GRID).cast("int") for k in range(P)])
    counts = keyed.select("key", F.posexplode(classes).alias("feature", "class")).groupBy("key", "feature", "class").agg(F.count("*").alias("n"))
    counts = stage(counts, "classes")  # dealt by group, feature and class before a window takes whole features
    up = Window.partitionBy("key", "feature").orderBy("class")
    total = F.sum("n").over(Window.partitionBy("key", "feature"))
    ranked = counts.withColumn("share", F.sum("n").over(up) / total)
    at = [F.min(F.when(F.col("share") >= q, F.col("class"))).alias(f"q{k}") for k, q in enumerate((0.25, 0.5, 0.75))]
    quartiles = ranked.groupBy("key").pivot("feature", list(range(P))).agg(*at)

    def start(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for r in frame.to_dict("records"):
                q = np.array([[r[f"{k}_q{n}"] for n in range(3)] for k in range(P)], dtype=float) / GRID
                rows.append({"key": r["key"]} | parameters(q[:, 1], np.diag(np.square((q[:, 2] - q[:, 0]) / 1.349)) + FLOOR))
            yield pd.DataFrame(rows, columns=["key", *[p.split()[0] for p in PARAMETERS.split(", ")]])

    return quartiles.mapInPandas(start, f"key string, {PARAMETERS}")


def starts(keyed: DataFrame, first: DataFrame) -> DataFrame:
    """Three starts for each group: ``key, start`` and the parameters."""
    near = keyed.join(first, "key")
    z = [(F.col(f"x{k}") - F.col(f"m{k}")) * F.col(f"w{k}_{k}") for k in range(P)]
    norm = F.sqrt(sum((v * v for v in z[1:]), z[0] * z[0]))
    near = near.select("key", *[F.tanh(v).alias(f"t{k}") for k, v in enumerate(z)], *[F.when(norm > 0, v / norm).otherwise(0.0).alias(f"u{k}") for k, v in enumerate(z)])
    sums = near.groupBy("key").agg(*[F.sum(F.col(f"{c}{i}") * F.col(f"{c}{j}")).alias(f"{c}{i}_{j}") for c in "tu" for i, j in PAIRS])

    def spread(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for r in frame.to_dict("records"):
                means, scale = np.array([r[f"m{k}"] for k in range(P)]), np.array([1 / r[f"w{k}_{k}"] for k in range(P)])
                rows.append({"key": r["key"], "start": 0} | parameters(means, np.diag(scale * scale)))
                for start, c in enumerate("tu", 1):
                    product = np.eye(P)
                    for i, j in PAIRS:
                        product[i, j] = product[j, i] = r[f"{c}{i}_{j}"]
                    size = np.sqrt(np.where(np.diag(product) > 0, np.diag(product), 1.0))
                    rows.append({"key": r["key"], "start": start} | parameters(means, product / np.outer(size, size) * np.outer(scale, scale) + FLOOR))
            yield pd.DataFrame(rows, columns=["key", "start", *[p.split()[0] for p in PARAMETERS.split(", ")]])

    return first.join(sums, "key").mapInPandas(spread, f"key string, start int, {PARAMETERS}")


def concentrated(keyed: DataFrame, estimates: DataFrame, bulk: float | None) -> DataFrame:
    """One step of each group and start: estimates from the nearest share, or, if that is None, from all rows not far off.

    ``logdet`` is the logarithm of the determinant of the new covariance.
    """
    near = keyed.join(estimates, "key").withColumn("class", distance_class(distance()))
    sums = [F.count("*").cast("double").alias("n")] + [F.sum(f"x{k}").alias(f"s{k}") for k in range(P)]
    sums += [F.sum(F.col(f"x{i}") * F.col(f"x{j}")).alias(f"s{i}_{j}") for i, j in PAIRS]
    # Staged, so that partial sums are dealt by class too, and a window takes only the few classes of a group.
    by_class = stage(near.groupBy("key", "start", "class").agg(*sums), "class-sums")
    group = Window.partitionBy("key", "start")
    whole = F.sum("n").over(group)
    before = F.sum("n").over(group.orderBy("class")) - F.col("n")
    weight = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (bulk * whole - before) / F.col("n"))) if bulk is not None else (F.col("class") <= int(math.log2(chi_square(2.0)) * FINE)).cast("double")
    kept = by_class.withColumn("weight", weight).groupBy("key", "start").agg(*[F.sum(F.col("weight") * F.col(c)).alias(c) for c in by_class.columns[3:]])

    def estimate(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for r in frame.to_dict("records"):
                n = r["n"]
                means = np.array([r[f"s{k}"] for k in range(P)]) / n
                cov = np.zeros((P, P))
                for i, j in PAIRS:
                    cov[i, j] = cov[j, i] = r[f"s{i}_{j}"] / n - means[i] * means[j]
                cov = cov * (consistency(bulk) if bulk is not None else 1.0) + FLOOR
                rows.append({"key": r["key"], "start": r["start"], "logdet": float(np.linalg.slogdet(cov)[1])} | parameters(means, cov))
            yield pd.DataFrame(rows, columns=["key", "start", "logdet", *[p.split()[0] for p in PARAMETERS.split(", ")]])

    return kept.mapInPandas(estimate, f"key string, start int, logdet double, {PARAMETERS}")


def bulks(keyed: DataFrame) -> DataFrame:
    """Mean and covariance of the bulk of each ``key``: the start of least determinant, then once more from all rows not far off."""
    estimates = stage(starts(keyed, stage(first_estimates(keyed), "medians")), "estimates")
    for _ in range(STEPS):
        estimates = stage(concentrated(keyed, estimates, BULK), "estimates")
    least = estimates.groupBy("key").agg(F.min_by("start", F.struct("logdet", "start")).alias("start"))
    return stage(concentrated(keyed, estimates.join(least, ["key", "start"]), None), "estimates")


def judge(docs: DataFrame) -> DataFrame:
    """The statistics of each row, ``base_failed``, ``distance2`` and ``kept``.

    ``doc_id``, ``lang``, ``source`` and ``text`` are read. A null text has no words; a null language or source is a group
    of its own. Rows that fail the base rule take no part in the estimates and have no distance. A text of any length is measured whole;
    repeated rows count each, and other columns are not read.
    """
    bounded_batches(docs.sparkSession)
    rows = stage(measured(docs), "statistics")
    lang, source = F.coalesce(F.concat(F.lit("l"), "lang"), F.lit("-")), F.coalesce(F.concat(F.lit("s"), "source"), F.lit("-"))
    names = F.array(F.to_json(F.array(lang, source)), F.to_json(F.array(lang)), F.lit("all"))
    good = rows.filter(~F.col("base_failed"))
    level = F.explode(names).alias("key")
    sizes = good.select(level).groupBy("key").agg(F.count("*").alias("size"))
    enough = stage(sizes.filter((F.col("size") >= LEAST) | (F.col("key") == "all")), "sizes")
    values = [f"x{k}" for k in range(P)]
    keyed = good.select(level, *values).join(enough.select("key"), "key")
    estimates = bulks(keyed)
    # The first level of a row that has an estimate.
    own, wide = (estimates.select("key").withColumnRenamed("key", k) for k in ("own", "wide"))
    leveled = rows.withColumn("own", names[0]).withColumn("wide", names[1])
    leveled = leveled.join(own.withColumn("has_own", F.lit(True)), "own", "left").join(wide.withColumn("has_wide", F.lit(True)), "wide", "left")
    chosen = F.when(F.col("has_own"), F.col("own")).when(F.col("has_wide"), F.col("wide")).otherwise("all")
    judged = leveled.withColumn("key", chosen).join(estimates, "key", "left")
    d = F.when(~F.col("base_failed"), distance())
    kept = ~F.col("base_failed") & F.coalesce(F.col("distance2") <= chi_square(STRICT), F.lit(True))
    return judged.withColumn("distance2", d).withColumn("kept", kept).select(*rows.columns[:8], "base_failed", "distance2", "kept", *values)
