"""Language identification by sparse multinomial logistic regression.

Features are hashed character n-grams of the lower-cased letters (everything
else counts as a space), weighted by their relative frequency in the text and
their inverse document frequency over all training rows. Weights are learned by
follow-the-regularised-leader with elastic net, on a bounded sample of labelled
rows for each language; then a temperature is fitted on a part of the sample
that was held back, so that scores are calibrated probabilities.
"""

from __future__ import annotations

import math
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from annalist.llm.common import bounded_batches, trimmed

#: Hashed features, and the lengths of the n-grams.
FEATURES, ORDERS = 1 << 18, (1, 2, 3)
#: Characters of a text that are looked at together.
PART = 1 << 16
#: Labelled rows to learn from: about so many for each language, and in all.
PER_LANGUAGE, SAMPLE = 2000, 20_000
#: Follow-the-regularised-leader: rate, smoothing, L1, L2, and the least updates, so that a small sample is passed over often enough.
ALPHA, BETA, L1, L2, UPDATES = 2.0, 1.0, 1e-3, 1e-4, 30_000
UNKNOWN = "und"


@lru_cache(maxsize=1)
def letters() -> np.ndarray:
    """For each code point 2 for a letter, 1 for a mark, which counts with the letters of a word, and 0 for others."""
    return np.array([{"L": 2, "M": 1}.get(unicodedata.category(chr(c))[0], 0) for c in range(0x110000)], np.uint8)


def features(text: str) -> Iterator[np.ndarray]:
    """Features of every n-gram of a text, as often as it occurs, in parts of bounded size; none if the text has no letter."""
    lowered = text.lower()
    parts = [lowered[a : a + PART] for a in range(0, len(lowered), PART)]
    codes_of = lambda part: np.frombuffer(part.encode("utf-32-le", "surrogatepass"), np.uint32)
    if not any((letters()[codes_of(p)] == 2).any() for p in parts):
        return
    tail, in_word = np.full(1, 32, np.uint64), False
    for number, part in enumerate(parts):
        codes = codes_of(part)
        letter = letters()[codes] > 0
        keep = letter | np.concatenate([[in_word], letter[:-1]])  # one space for many
        kept = np.where(letter, codes, 32).astype(np.uint64)[keep]
        in_word = bool(letter[-1])
        if in_word and number == len(parts) - 1:
            kept = np.append(kept, np.uint64(32))
        ring = np.concatenate([tail, kept])
        for n in ORDERS:
            start = max(len(tail) - n + 1, 0) if number else 0  # those that end in this part
            if len(ring) - start < n:
                continue
            gram = np.zeros(len(ring) - start - n + 1, dtype=np.uint64)
            for k in range(n):
                gram = gram * np.uint64(0x110000) + ring[start + k : len(ring) - n + 1 + k]
            yield ((gram * np.uint64(0x9E3779B97F4A7C15) + np.uint64(n)) * np.uint64(0xD6E8FEB86659FD93) >> np.uint64(46)).astype(np.int64)
        tail = ring[-max(ORDERS) + 1 :]


class Model:
    """Languages, weights (feature times idf, by language), bias and temperature."""

    def __init__(self, languages: list[str], weights: np.ndarray, bias: np.ndarray, temperature: float):
        self.languages, self.weights, self.bias, self.temperature = languages, weights, bias, temperature

    def predict(self, text: str | None) -> tuple[str, float]:
        total, n = np.zeros(len(self.languages)), 0
        for found in features(text or "") if self.languages else ():
            total += self.weights[found].sum(axis=0, dtype=np.float64)
            n += len(found)
        if not n:
            return UNKNOWN, 0.0
        z = (total / n + self.bias) / self.temperature
        best = int(z.argmax())
        return self.languages[best], float(1.0 / np.exp(z - z[best]).sum())


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def train(rows: list[tuple[int, np.ndarray, np.ndarray]], classes: int, seed: int = 7) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """Features, their weights, bias and temperature from (class, features, values).

    A fifth of the rows is held back. The others are passed over until there were ``UPDATES`` updates and
    another pass lowers the loss of the rows held back by less than a hundredth. The temperature is fitted to these rows too, with
    targets slightly below one, so that rows that are all right do not make it vanish.
    """
    shuffled = np.random.default_rng(seed).permutation(len(rows))
    held, learned = shuffled[: len(rows) // 5], shuffled[len(rows) // 5 :]
    used = np.unique(np.concatenate([r[1] for r in rows])) if rows else np.zeros(0, np.int64)
    last = len(used)  # the bias
    # As narrow as the rows: the whole sample is held at once.
    place = [np.append(np.searchsorted(used, at), last).astype(np.int32) for _, at, _ in rows]
    value = [np.append(x, np.float32(1.0)) for _, _, x in rows]
    truth = np.array([rows[r][0] for r in held], dtype=int)
    z, n = np.zeros((last + 1, classes)), np.zeros((last + 1, classes))

    def weights(at) -> np.ndarray:
        far = np.abs(z[at]) > L1
        return np.where(far, -(z[at] - np.sign(z[at]) * L1) / ((BETA + np.sqrt(n[at])) / ALPHA + L2), 0.0)

    def loss(margins: np.ndarray) -> float:
        """With the targets of as many rows, one of which would be wrong."""
        doubt = 1 / (len(truth) + 2)
        logs = np.log(softmax(margins) + 1e-300)
        own = logs[np.arange(len(truth)), truth]
        rest = (logs.sum(axis=1) - own) / max(classes - 1, 1)
        return float(-((1 - doubt) * own + doubt * rest).mean())

    margins, best, updates = np.zeros((0, classes)), math.inf, 0
    while len(learned):
        for r in learned:
            y, at, x = rows[r][0], place[r], value[r]
            w = weights(at)
            error = softmax(x @ w)
            error[y] -= 1.0
            gradient = x[:, None] * error
            change = (np.sqrt(n[at] + gradient**2) - np.sqrt(n[at])) / ALPHA
            z[at] += gradient - change * w
            n[at] += gradient**2
        updates += len(learned)
        if updates < UPDATES:
            continue
        w = weights(slice(None))
        margins = np.array([value[r] @ w[place[r]] for r in held]).reshape(-1, classes)
        now = loss(margins) if len(truth) else 0.0
        if now > best * 0.99 or not len(truth):
            break
        best = now
    w = weights(slice(None))
    temperature = 1.0
    if len(truth):
        steps = np.exp(np.linspace(math.log(0.01), math.log(100), 200))
        temperature = float(min(steps, key=lambda t: loss(margins / t)))
    return used, w[:last], w[last], temperature


def fit(labelled: DataFrame) -> Model:
    """A model from ``text`` and ``lang`` of the rows given; rows without a language or a letter teach nothing.

    Document frequencies are counted over all rows. The weights are learned in one
    task from a hash sample of about ``PER_LANGUAGE`` rows of each language, ``SAMPLE`` at most in all (one of each language at least). Every
    language that occurs is learned; the model holds a number for each feature and language.
    """
    spark = labelled.sparkSession
    bounded_batches(spark)
    rows = labelled.filter("lang IS NOT NULL AND text IS NOT NULL").select(F.col("lang").cast("string").alias("lang"), "text")

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, seen, documents = np.zeros(FEATURES, np.int64), np.zeros(FEATURES, np.uint8), 0
        for batch in batches:
            for text in batch.column("text").to_pylist():
                for found in features(text):
                    seen[found] = 1
                at = np.flatnonzero(seen)
                total[at] += 1
                seen[at] = 0
                documents += 1
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"feature": pa.array([-1, *at]), "n": pa.array([documents, *total[at]])})

    counts = rows.select("text").mapInArrow(trimmed(frequencies), "feature bigint, n bigint").groupBy("feature").agg(F.sum("n").alias("n"))
    found = counts.toArrow()  # one row per hashed feature at most
    feature, n = found.column("feature").to_numpy(), found.column("n").to_numpy()
    idf = np.zeros(FEATURES)
    idf[feature[feature >= 0]] = np.log((1 + n[feature < 0].sum()) / (1 + n[feature >= 0])) + 1

    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    languages = sorted(sizes)
    if not languages:
        return Model([], np.zeros((FEATURES, 0), np.float32), np.zeros(0), 1.0)
    wanted = max(1, min(PER_LANGUAGE, SAMPLE // len(languages)))
    share = F.create_map(*[F.lit(x) for k in languages for x in (k, min(1.0, wanted / sizes[k]))])
    draw = F.pmod(F.xxhash64("text", "lang"), F.lit(1 << 30)) / (1 << 30)
    sample = rows.filter(draw < F.coalesce(share[F.col("lang")], F.lit(0.0)))
    # Copies of a text share their draw: each text teaches once, so that the sample stays bounded.
    sample = sample.groupBy("lang", F.xxhash64("text").alias("h")).agg(F.first("text").alias("text"))
    number = {k: c for c, k in enumerate(languages)}

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drawn = []
        for batch in batches:
            for lang, h, text in zip(*(batch.column(c).to_pylist() for c in ("lang", "h", "text"))):
                counts_ = [np.unique(found, return_counts=True) for found in features(text)]
                if counts_:
                    at, of = np.unique(np.concatenate([a for a, _ in counts_]), return_inverse=True)
                    count = np.bincount(of, np.concatenate([c for _, c in counts_]))
                    # Narrow numbers: the whole sample is held at once.
                    drawn.append((h, number[lang], at.astype(np.int32), (count / count.sum() * idf[at]).astype(np.float32)))
        drawn.sort(key=lambda r: (r[0], r[1]))
        used, w, bias, temperature = train([r[1:] for r in drawn], len(languages))
        drawn.clear()
        some = np.abs(w).sum(axis=1) > 0
        at, w = used[some], w[some]
        yield pa.RecordBatch.from_pydict(
            {
                "feature": pa.array([*at, -1, -2], pa.int64()),
                "w": pa.array([*w.tolist(), bias.tolist(), [temperature]], pa.list_(pa.float64())),
            }
        )

    learned = sample.repartition(1).mapInArrow(trimmed(learn), "feature bigint, w array<double>").toArrow()
    weights = np.zeros((FEATURES, len(languages)), np.float32)
    bias, temperature = np.zeros(len(languages)), 1.0
    for f, w in zip(learned.column("feature").to_pylist(), learned.column("w").to_pylist()):
        if f >= 0:
            weights[f] = np.array(w) * idf[f]
        elif f == -1:
            bias = np.array(w)
        else:
            temperature = w[0]
    return Model(languages, weights, bias, temperature)


def judged(docs: DataFrame, model: Model) -> tuple[DataFrame, str]:
    """``docs`` with a column, of a name not taken yet, that holds the language and its score."""
    bounded_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by features and languages

    @F.pandas_udf("lang string, score double")
    def run(texts):
        import pandas as pd

        return pd.DataFrame([shared.value.predict(t) for t in texts], columns=["lang", "score"])

    own = "found"
    while own in (c.lower() for c in docs.columns):
        own += "_"
    return docs.withColumn(own, run.asNondeterministic()("text")), own


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score`` appended (columns of these names are replaced).

    Only ``text`` is looked at. Null texts, texts without a letter, and every text if no language was learned are ``und``, with score 0.
    """
    kept = docs.drop("lang_pred", "score")
    found, own = judged(kept, model)
    return found.select(*[F.col(f"`{c}`") for c in kept.columns], F.col(f"{own}.lang").alias("lang_pred"), f"{own}.score")


def known(docs: DataFrame, model: Model, least: float) -> DataFrame:
    """The rows of ``docs`` whose language is known with a score of at least ``least``."""
    found, own = judged(docs, model)
    return found.filter((F.col(f"{own}.lang") != UNKNOWN) & (F.col(f"{own}.score") >= least)).drop(own)


def held_out(doc_id: Column, parts: int = 5) -> Column:
    """Whether the crc32 of an id as text is 0 modulo ``parts``; a null id is not."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % parts == 0, F.lit(False))
