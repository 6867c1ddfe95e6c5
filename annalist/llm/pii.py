"""Personal data by candidate gradient boosting.

Generators with high recall propose spans that may overlap: everything that
looks somewhat like a mail address, an IP address, a card or phone number, or a
secret. Boosted trees judge each candidate by its format and its surroundings;
they are trained here on all candidates in the given rows,
labelled by the strict rules (checksums, ranges, assignments): every split comes from
histograms that tasks sum over their rows. Scores are calibrated on all candidates of
a part held back, and each kind gets the lowest threshold at which the
held-back part shows the precision asked for. Spans that meet the strict base rules are
always kept; the trees add spans.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from annalist.llm.common import bounded_batches, stage, trimmed

KINDS = ("email", "ip", "card", "phone", "secret")
#: Trees, their depth, rate, classes of a feature, and the precision asked for.
TREES, TREE_DEPTH, RATE, CLASSES, PRECISION = 40, 3, 0.2, 32, 0.99
#: Gradients are summed in units of 1 / UNIT, so that sums do not depend on the order of rows. Margins are counted in STEPS to one, up to TOP.
UNIT, STEPS, TOP = 1 << 20, 256, 32
ANY = re.compile(r"[0-9@]|\(at\)|\[at\]")
# The base rules. A match of the address rule depends only on the run before the at sign, and of the number
# rules only on whole runs of digits, so these forms find the same spans in linear time.
AT = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
# The wide generators.
WIDE = {
    "email": re.compile(r"[A-Za-z0-9._%+-]{1,64}\s?(?:@|\(at\)|\[at\]|&#64;)\s?[A-Za-z0-9-]{1,63}(?:\s?(?:\.|\(dot\)|\[dot\])\s?[A-Za-z0-9-]{1,63}){1,8}"),
    "ip": re.compile(r"(?<![0-9.])[0-9]{1,5}+(?:\.[0-9]{1,5}+){2,7}(?![0-9])"),
    "card": re.compile(r"(?<![0-9])(?:[0-9][\x20.-]?){11,22}[0-9](?![0-9])"),
    "phone": re.compile(r"(?<![0-9])[+(]?[0-9](?:[\x20()./-]{0,2}[0-9]){6,16}(?![0-9])"),
    "secret": re.compile(r"(?<![A-Za-z0-9_+/=-])(?=[A-Za-z_+/=-]{0,199}[0-9])[A-Za-z0-9_+/=-]{20,200}(?![A-Za-z0-9_+/=-])"),
}
ASSIGNED = re.compile(r"(?:token|secret|key|password|passwd|pwd|bearer|auth)\W{1,6}$", re.IGNORECASE)
HINTS = [re.compile(h, re.IGNORECASE) for h in (r"mail|contact", r"\bip\b|host|server|addr", r"card|visa|pay|credit", r"tel|phone|call|fax|mobil")]


def luhn(digits: str) -> bool:
    total = 0
    for n, d in enumerate(map(int, reversed(digits))):
        total += d if n % 2 == 0 else 2 * d - 9 * (d > 4)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of spans that meet the base rules, leftmost and not overlapping within a kind, in order."""
    found = []
    at = 0
    if "@" in text:
        free = 0
        while m := AT.search(text, at):
            start = m.start()
            while start > free and text[start - 1] in LOCAL:
                start -= 1
            at = m.end() if start < m.start() else m.start() + 1
            if start < m.start():
                found.append((start, 0, m.end()))
                free = m.end()
    for m in IP.finditer(text):
        if all(len(q) <= 3 and int(q or 0) <= 255 for q in (p.lstrip("0") for p in m[0].split("."))):
            found.append((m.start(), 1, m.end()))
    for m in CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 14 <= len(digits) <= 19 and luhn(digits):
            found.append((m.start(), 2, m.end()))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 10 <= sum(c.isdigit() for c in m[0]) <= 15:
                found.append((m.start(), 3, m.end()))
    return sorted(found)


def describe(text: str, kind: int, start: int, end: int) -> list[float]:
    """Features of a candidate."""
    span = text[start:end]
    digits = "".join(c for c in span if c in "0123456789")
    letters = sum(c.isalpha() for c in span)
    before, after = text[max(0, start - 24) : start], text[end : end + 8]
    parts = re.split(r"[^0-9A-Za-z]+", span)
    numbers = [p for p in parts if p.isdigit()]
    counts = np.unique(list(span), return_counts=True)[1]
    tail = parts[-1] if parts else ""
    return [
        kind, len(span), len(digits), letters, len(span) - letters - len(digits), len(parts),
        float(luhn(digits)) if 12 <= len(digits) <= 19 else -1.0,
        max((min(int(p[:6]), 999_999) for p in numbers), default=-1), float(len(numbers) == 4 and len(parts) == 4),
        span.count("@"), span.count("."), span.count(" "), float(span[0] == "+"), float("(" in span),
        len(tail) if tail.isalpha() else 0.0, round(-sum(c / len(span) * math.log2(c / len(span)) for c in counts), 6),
        float(before[-1:].isalnum()), float(after[:1].isalnum()), float(after[:1] in ("%", ")", "]")), float(before[-1:] in ("$", "€", "#")),
        *[float(bool(h.search(before))) for h in HINTS],
    ]


def candidates(text: str) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """(start, kind, end) of the base spans, and of all candidates, base spans among them."""
    if not ANY.search(text):
        return [], []
    base = base_spans(text)
    asked = [k for k in range(len(KINDS)) if k or "@" in text or "at)" in text or "at]" in text]
    wide = {(m.start(), k, m.end()) for k in asked for m in WIDE[KINDS[k]].finditer(text)}
    return base, sorted(wide | set(base))


class Trees:
    """Boosted regression trees for the logistic loss, on features cut into classes."""

    def __init__(self):
        self.edges: list[np.ndarray] = []
        self.trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.bias, self.slope, self.shift = 0.0, 1.0, 0.0
        self.thresholds = [2.0] * len(KINDS)

    def classes(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, k], side="right") for k, e in enumerate(self.edges)], axis=1)

    def fit(self, cells: DataFrame) -> Trees:
        """``cells``: ``code`` (a byte for the class of each feature), ``n`` candidates and ``y`` positive ones among them."""
        n, y = cells.agg(F.sum("n"), F.sum("y")).first()
        rate = min(max(y / n, 1e-3), 1 - 1e-3)
        self.bias = math.log(rate / (1 - rate))
        for _ in range(TREES):
            feature, cut = np.full(2**TREE_DEPTH - 1, -1), np.zeros(2**TREE_DEPTH - 1, dtype=np.int64)  # heap order
            sums = np.zeros((2 ** (TREE_DEPTH + 1) - 1, 2))  # gradients of the rows in each node
            splits = True
            for depth in range(TREE_DEPTH):
                nodes = range(2**depth - 1, 2 ** (depth + 1) - 1)
                # Where no node was split, the next level has the same rows.
                found = self.histograms(cells, feature, cut, depth) if splits else None
                splits = False
                for k, node in enumerate(nodes):
                    if found is None:
                        sums[2 * node + 1] = sums[node]
                        continue
                    run = np.cumsum(found[:, k], axis=2)  # gradients, feature, class
                    sums[node] = run[:, 0, -1]
                    (total_g, total_h), best, left = sums[node], 1e-6, sums[node]
                    for f, (gs, hs) in enumerate(zip(*run)):
                        gain = gs**2 / (hs + 1.0) + (total_g - gs) ** 2 / (total_h - hs + 1.0) - total_g**2 / (total_h + 1.0)
                        if gain.max() > best:
                            best, feature[node], cut[node] = gain.max(), f, int(gain.argmax())
                            left = run[:, f, cut[node]]
                    sums[2 * node + 1], sums[2 * node + 2] = left, sums[node] - left
                    splits |= bool(feature[node] >= 0)
            g, h = sums[2**TREE_DEPTH - 1 :].T
            self.trees.append((feature, cut, -RATE * g / (h + 1.0)))
        return self

    def histograms(self, cells: DataFrame, feature: np.ndarray, cut: np.ndarray, depth: int) -> np.ndarray:
        """First and second derivatives of the loss of all cells, summed by node of a level, feature and class."""
        width = len(self.edges)
        shape = (2**depth, width, CLASSES + 1)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros((2, *shape))
            for batch in batches:
                c, n, y = codes_of(batch, width), *(batch.column(k).to_numpy() for k in ("n", "y"))
                p = 1 / (1 + np.exp(-self.coded_margin(c)))
                node = descend(c, feature, cut, depth) - (2**depth - 1)
                at = ((node[:, None] * width + np.arange(width)) * (CLASSES + 1) + c).ravel()
                for k, weight in enumerate((n * p - y, n * np.maximum(p * (1 - p), 1e-6))):
                    total[k] += np.bincount(at, np.repeat(np.rint(weight * UNIT), width), total[k].size).reshape(shape)
            yield pa.RecordBatch.from_pydict({"sums": pa.array([total.tobytes()], pa.binary())})

        parts = cells.select("code", "n", "y").mapInArrow(run, "sums binary").toArrow().column("sums")
        return sum(np.frombuffer(p.as_py()).reshape(2, *shape) for p in parts) / UNIT

    def coded_margin(self, c: np.ndarray) -> np.ndarray:
        out = np.full(len(c), self.bias)
        for feature, cut, value in self.trees:
            out += value[descend(c, feature, cut, TREE_DEPTH) - (2**TREE_DEPTH - 1)]
        return out

    def margin(self, x: np.ndarray) -> np.ndarray:
        return self.coded_margin(self.classes(x))

    def scaled(self, margin: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * margin + self.shift, -50, 50)))

    def probability(self, x: np.ndarray) -> np.ndarray:
        return self.scaled(self.margin(x))

    def calibrate(self, cells: DataFrame) -> None:
        """Logistic scaling by Newton steps, then a threshold for each kind, from the counts of all cells by ``kind`` and step of the margin."""
        width = len(self.edges)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                step = np.floor(np.clip(self.coded_margin(codes_of(batch, width)), -TOP, TOP) * STEPS).astype(np.int64)
                yield pa.RecordBatch.from_arrays([batch.column("kind"), pa.array(step), batch.column("n"), batch.column("y")], names=["kind", "step", "n", "y"])

        steps = cells.select("kind", "code", "n", "y").mapInArrow(run, "kind int, step bigint, n bigint, y bigint")
        counted = steps.groupBy("kind", "step").agg(F.sum("n").alias("n"), F.sum("y").alias("y")).orderBy("kind", "step").toArrow()  # bounded by kinds and steps
        kind, step, n, y = (counted.column(c).to_numpy() for c in counted.column_names)
        m = (step + 0.5) / STEPS
        for _ in range(25):
            p = self.scaled(m)
            w, e = n * (p * (1 - p) + 1e-9), n * p - y
            g = np.array([(e * m).sum(), e.sum()]) + 1e-2 * np.array([self.slope - 1, self.shift])
            hess = np.array([[(w * m * m).sum(), (w * m).sum()], [(w * m).sum(), w.sum()]]) + 1e-2 * np.eye(2)
            change = np.linalg.solve(hess, g)
            self.slope, self.shift = self.slope - change[0], self.shift - change[1]
        p = np.minimum(self.scaled(step / STEPS), self.scaled((step + 1) / STEPS))  # the least within a step
        for k in range(len(KINDS)):
            own = np.flatnonzero(kind == k)
            own = own[np.argsort(-p[own], kind="stable")]
            good = np.flatnonzero(np.cumsum(y[own]) >= PRECISION * np.cumsum(n[own]))
            # Never below even odds; no threshold for a kind that cannot reach the precision.
            self.thresholds[k] = max(0.5, float(p[own][good[-1]])) if len(good) else 2.0


def codes_of(batch: pa.RecordBatch, width: int) -> np.ndarray:
    """The classes of all features, a row for each cell."""
    return np.frombuffer(b"".join(batch.column("code").to_pylist()), np.uint8).reshape(-1, width).astype(np.int64)


def descend(c: np.ndarray, feature: np.ndarray, cut: np.ndarray, depth: int) -> np.ndarray:
    """The node that each row reaches at a level of a tree, in heap order."""
    node, rows = np.zeros(len(c), dtype=np.int64), np.arange(len(c))
    for _ in range(depth):
        f = feature[node]
        node = 2 * node + 1 + ((f >= 0) & (c[rows, f] > cut[node]))
    return node


def fit(docs: DataFrame) -> Trees:
    """Trees from all candidates in ``text`` of the rows; a fourth of them, chosen by hash, is held back for the thresholds.

    The labels: base spans are positive; a secret is positive if it is assigned to
    a name like key or token (which the features do not show). No candidates: no trees, and nothing is added.
    """
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            draws, labels, rows = [], [], []
            for draw, text in zip(batch.column("draw").to_pylist(), batch.column("text").to_pylist()):
                base, wide = candidates(text)
                base = set(base)
                for start, kind, end in wide:
                    labels.append(bool(ASSIGNED.search(text[max(0, start - 24) : start])) if kind == 4 else (start, kind, end) in base)
                    rows.append(describe(text, kind, start, end))
                    draws.append((draw + start * 2654435761) % (1 << 30))
            yield pa.RecordBatch.from_pydict(
                {"draw": pa.array(draws, pa.int64()), "label": pa.array(labels, pa.bool_()), "x": pa.array(rows, pa.list_(pa.float64()))}
            )

    texts = docs.filter("text IS NOT NULL").select(F.pmod(F.xxhash64("text"), F.lit(1 << 30)).alias("draw"), "text")
    # Copies of a candidate with the same surroundings teach once.
    found = stage(texts.mapInArrow(trimmed(run), "draw bigint, label boolean, x array<double>").distinct(), "candidates")
    trees = Trees()
    held = F.col("draw") % 4 == 0
    sizes = found.agg(F.count("*").alias("n"), F.count_if(~held).alias("learned"), F.max(F.size("x")).alias("width")).first()
    if not sizes.n:
        return trees
    learned = found.filter(~held) if sizes.learned else found
    points = F.array(*[F.lit(k / CLASSES) for k in range(1, CLASSES)])
    # Features are whole numbers up to a million or rounded, which bounds the distinct values that are counted.
    quantiles = learned.agg(*[F.percentile(F.col("x")[k], points).alias(f"x{k}") for k in range(sizes.width)]).first()
    trees.edges = [np.unique(q) for q in quantiles]

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = np.array(batch.column("x").to_pylist())
            codes = [c.tobytes() for c in trees.classes(x).astype(np.uint8)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(x[:, 0].astype(np.int32)), pa.array(codes, pa.binary()), batch.column("held"), batch.column("label")], names=["kind", "code", "held", "label"]
            )

    coded = found.select("x", held.alias("held"), "label").mapInArrow(code, "kind int, code binary, held boolean, label boolean")
    cells = coded.groupBy("kind", "code", "held").agg(F.count("*").alias("n"), F.count_if("label").alias("y"))
    cells = stage(cells, "cells")
    trees.fit(cells.filter("NOT held") if sizes.learned else cells)
    trees.calibrate(cells.filter("held"))
    return trees


def select(text: str, trees: Trees) -> list[tuple[int, int, int, bool]]:
    """(start, kind, end, base) of the spans to redact, by start, then kind.

    Of the candidates that the trees accept, those overlapping a base span or a
    better candidate are left out.
    """
    base, wide = candidates(text)
    chosen = [(s, k, e, True) for s, k, e in base]
    known = set(base)
    others = [c for c in wide if c not in known]
    if others and trees.trees:
        covered = bytearray(len(text))
        for s, _, e in base:
            covered[s:e] = b"\1" * (e - s)
        p = trees.probability(np.array([describe(text, k, s, e) for s, k, e in others]))
        for q, (s, k, e) in sorted(zip(p, others), key=lambda r: (-r[0], r[1])):
            if q >= trees.thresholds[k] and covered.find(1, s, e) < 0:
                chosen.append((s, k, e, False))
                covered[s:e] = b"\1" * (e - s)
    return sorted(chosen)


SPANS = "array<struct<kind:string,start:bigint,end:bigint,base:boolean>>"


def find(docs: DataFrame, trees: Trees) -> DataFrame:
    """``doc_id`` and ``spans`` (kind, start, end in code points, whether a base rule holds) of each row; null texts have none."""
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_())]))
        for batch in batches:
            spans = [
                [{"kind": KINDS[k], "start": s, "end": e, "base": b} for s, k, e, b in select(t or "", trees)]
                for t in batch.column("text").to_pylist()
            ]
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "spans": pa.array(spans, kind)})

    rows = docs.select("doc_id", "text")
    return rows.mapInArrow(trimmed(run), f"doc_id {dict(rows.dtypes)['doc_id']}, spans {SPANS}")


def redact(docs: DataFrame, trees: Trees) -> DataFrame:
    """``docs`` with each selected span of ``text`` replaced by its kind in brackets; overlapping spans become one, named by the first."""
    bounded_batches(docs.sparkSession)

    @F.pandas_udf("string")
    def run(texts):
        import pandas as pd

        return pd.Series([None if t is None else redacted(t, select(t, trees)) for t in texts], dtype=object)

    return docs.withColumn("text", run.asNondeterministic()("text"))


def redacted(text: str, spans: list[tuple[int, int, int, bool]]) -> str:
    parts, at = [], 0
    for start, kind, end, _ in spans:
        if start >= at:
            parts += [text[at:start], f"[{KINDS[kind].upper()}]"]
        at = max(at, end)
    return "".join([*parts, text[at:]])
