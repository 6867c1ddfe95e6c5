"""Secrets by a linear-chain conditional random field.

Texts are cut into tokens, runs of letters, digits and ``+/_.~-``. The field tags each as
outside, begin or inside of a secret from its shape (length, shares of digits, capitals, vowels, changes of
kind), the words and marks around it, the shapes of its neighbours, and features of the whole
text. Only tokens of ``LEAST`` or more bytes may be tagged other than outside, so a chain falls into runs of such tokens, which are
decoded exactly by Viterbi, all runs of a batch at once.

The field is trained on windows around what the base rules find and windows drawn elsewhere, at most ``SAMPLE`` of either. Since the
rules know few formats and names, each found secret is also learned in other formats (re-coded from its own digest), after
other words or none, and ordinary words are learned in the forms that resemble secrets (paths, identifiers, numbers). A margin in
favour of outside is set on windows held back, so that what is tagged there is right at ``PRECISION``. Spans of the base rules always stay;
the field adds spans apart from them.
"""

from __future__ import annotations

import base64
import hashlib
import random
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from annalist.llm.common import bounded_batches, byte_columns, slices, stage

KINDS = ("assign", "access", "hex", "secret")
#: Windows of each sort to learn from at most, bytes around a secret in a window, and least bytes of a token that may be (part of) a secret.
SAMPLE, AROUND, LEAST = 2000, 240, 8
#: Training steps, their rate, the weight of the penalty, and the precision that the margin aims at.
STEPS, RATE, PENALTY, PRECISION = 80, 0.2, 1e-3, 0.99
#: Bytes of text that are looked at together.
CHUNK = 1 << 20
# The base rules (fixed values).
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")  # the same as runs of any length of which those below 16 characters are dropped
HEX = re.compile(r"[0-9a-f]{32,}")  # likewise
NAMES = ("password", "passwd", "secret", "token", "apikey", "api_key")

OUTSIDE, BEGIN, INSIDE = range(3)
#: Kinds of bytes: 0 none of a token, 1 digit, 2 capital, 3 small letter, 4 mark, 5 not ASCII.
KIND = np.zeros(256, np.uint8)
KIND[ord("0") : ord("9") + 1], KIND[ord("A") : ord("Z") + 1], KIND[ord("a") : ord("z") + 1], KIND[128:] = 1, 2, 3, 5
KIND[list(b"+/_.~-")] = 4
VOWEL, CODE = np.zeros(256, bool), np.zeros(256, bool)
VOWEL[list(b"aeiouyAEIOUY")] = True
CODE[list(b"{}()[];=<>$\\")] = True
LOWER = np.arange(256, dtype=np.uint64)
LOWER[65:91] += 32
#: A feature is a slot and a value below ``WIDTH``; words are hashed.
SLOTS, WIDTH = 19, 1 << 12
POWERS = np.array([pow(1_000_003, k, 1 << 61) for k in range(24)], dtype=np.uint64)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of what the base rules find, in order; the span of an assignment is all of it."""
    found = []
    low = text.lower()
    if any(n in low for n in NAMES):
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def secret_parts(text: str) -> list[tuple[int, int]]:
    """(start, end) of the secrets themselves: the values of assignments, and the other spans."""
    values = [m.span(2) for m in ASSIGN.finditer(text) if len(m[2]) >= 8] if any(n in text.lower() for n in NAMES) else []
    return sorted(values + [(s, e) for s, k, e in base_spans(text) if k])


def share(part: np.ndarray, whole: np.ndarray, classes: int) -> np.ndarray:
    """Shares in ``classes`` steps; none and all are classes of their own."""
    inner = 1 + np.minimum(part * classes // np.maximum(whole, 1), classes - 1)
    return np.where(part == 0, 0, np.where(part == whole, classes + 1, inner))


class Tokens:
    """Tokens of several texts, given as their bytes one after another, and the features of those that may be secrets."""

    def __init__(self, raw: np.ndarray, offsets: np.ndarray, file_features: np.ndarray | None = None):
        kind = KIND[raw]
        inside = np.r_[False, kind > 0, False]
        cut = offsets[:-1][np.diff(offsets) > 0]  # the first byte of each text
        first, last = inside[1:-1] & ~inside[:-2], inside[1:-1] & ~inside[2:]
        first[cut[inside[cut + 1]]] = True
        before = cut[cut > 0]
        last[before[inside[before]] - 1] = True
        self.raw, self.start, self.end = raw, np.flatnonzero(first), np.flatnonzero(last) + 1
        self.text = np.searchsorted(offsets, self.start, side="right") - 1
        self.open = np.flatnonzero(self.end - self.start >= LEAST)
        if file_features is None:
            file_features = self._of_texts(raw, kind, offsets)
        self.file_features = file_features
        self.from_, self.to = offsets[self.text], offsets[self.text + 1]
        self.features = self._features(kind)

    @staticmethod
    def _of_texts(raw: np.ndarray, kind: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Shares of code marks and of digits, and the size, as classes of each text."""
        size = np.diff(offsets)
        full = np.flatnonzero(size)
        counts = np.zeros((2, len(size)), np.int64)
        if len(full):
            for k, flags in enumerate((CODE[raw], kind == 1)):
                counts[k, full] = np.add.reduceat(flags, offsets[full], dtype=np.int64)
        return np.stack([*(np.minimum(c * 200 // np.maximum(size, 1), 15) for c in counts), np.log2(size + 1).astype(np.int64) // 3], axis=1)

    def _gather(self, tokens: np.ndarray, most: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Places of the bytes of ``tokens`` (the first ``most``), and where each token's begin."""
        length = self.end[tokens] - self.start[tokens]
        if most:
            length = np.minimum(length, most)
        at = np.cumsum(length) - length
        return np.arange(length.sum()) - np.repeat(at - self.start[tokens], length), at

    def _shape(self, kind: np.ndarray) -> list[np.ndarray]:
        o = self.open
        place, at = self._gather(o)
        own, length = kind[place], (self.end - self.start)[o]
        count = lambda flags: np.add.reduceat(flags, at, dtype=np.int64)
        digits, capitals, small, marks = (count(own == k) for k in (1, 2, 3, 4))
        change = np.r_[False, own[1:] != own[:-1]]
        change[at] = False
        letters = capitals + small
        size = np.searchsorted([10, 12, 16, 18, 20, 22, 24, 28, 32, 36, 40, 48, 64, 100], length, side="right")
        byte = self.raw[place]
        is_hex = count((own == 1) | ((LOWER[byte] >= 97) & (LOWER[byte] <= 102))) == length
        mixed = (digits > 0) + 2 * (capitals > 0) + 4 * (small > 0) + 8 * (marks > 0) + 16 * (digits + letters + marks < length)
        changes = np.minimum(count(change) * 12 // length, 11)
        return [
            size, share(digits, length, 6) * 32 + mixed, np.minimum(changes, 11) * 32 + mixed, share(count(VOWEL[byte]), letters, 8) * 16 + size,
            np.minimum(marks, 7) * 2 + is_hex, changes * 16 + size, share(capitals, letters, 4) * 32 + mixed,
        ]

    def _words(self, tokens: np.ndarray) -> np.ndarray:
        """A hash of each token in small letters, from 1 on (of its first 24 bytes)."""
        place, at = self._gather(tokens, len(POWERS))
        within = np.arange(len(place)) - np.repeat(at, np.diff(np.r_[at, len(place)]))
        summed = np.add.reduceat(LOWER[self.raw[place]] * POWERS[within], at)
        return ((summed >> np.uint64(20)) % np.uint64(WIDTH - 1)).astype(np.int64) + 1

    def _features(self, kind: np.ndarray) -> np.ndarray:
        """A row of feature numbers for each open token."""
        o = self.open
        if not len(o):
            return np.zeros((0, SLOTS), np.int64)
        near = lambda step: np.clip(o + step, 0, len(self.start) - 1)
        same = lambda step: (near(step) == o + step) & (self.text[near(step)] == self.text[o])
        needed = np.unique(np.r_[o, near(-1), near(-2), near(1)])
        words = np.zeros(len(self.start), np.int64)
        words[needed] = self._words(needed)
        word = lambda step: np.where(same(step), words[near(step)], 0)
        gap = self.start[o] - np.where(same(-1), self.end[near(-1)], self.from_[o])
        around = []
        for k in range(1, 4):  # the bytes before, as far as they are of the gap
            around.append(np.where(gap >= k, self.raw[np.maximum(self.start[o] - k, 0)], 0).astype(np.int64))
        assigned = np.zeros(len(o), np.int64)
        for b in around:
            assigned |= (b == 58) | (b == 61)
        after = np.where(self.end[o] < self.to[o], self.raw[np.minimum(self.end[o], len(self.raw) - 1)], 0).astype(np.int64)
        shape = self._shape(kind)
        length = np.minimum(self.end - self.start, 31)
        digit = np.r_[0, np.cumsum(kind == 1)]
        numeric = (digit[self.end] - digit[self.start] > 0).astype(np.int64)
        neighbour = lambda step: np.where(same(step), 1 + length[near(step)] * 2 + numeric[near(step)], 0)
        files = self.file_features[self.text[o]]
        slots = [
            *shape, around[0], np.minimum(gap, 7) * 2 + assigned, after, word(-1), word(-2), word(1), neighbour(-1), neighbour(1),
            assigned * 16 + shape[0], *files.T,
        ]
        return np.stack(slots, axis=1) + np.arange(SLOTS) * WIDTH

    def runs(self) -> tuple[np.ndarray, np.ndarray]:
        """Where runs of adjacent open tokens of one text begin in ``open``, and their lengths."""
        o = self.open
        new = np.r_[True, (np.diff(o) > 1) | (np.diff(self.text[o]) > 0)] if len(o) else np.zeros(0, bool)
        begin = np.flatnonzero(new)
        return begin, np.diff(np.r_[begin, len(o)])


def longest_first(begin: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, list[int]]:
    """Beginnings of runs, the longest first, and for each step how many runs reach it."""
    order = np.argsort(-length, kind="stable")
    reach = np.bincount(length, minlength=1)[::-1].cumsum()[::-1]  # runs of at least so many tokens
    return begin[order], reach[1:].tolist()


def viterbi(scores: np.ndarray, begin: np.ndarray, length: np.ndarray, steps: np.ndarray) -> np.ndarray:
    """The best tag of each row of ``scores`` for runs that begin and end between tokens outside."""
    tags = np.zeros(len(scores), np.int64)
    begin, alive = longest_first(begin, length)
    if not len(begin):
        return tags
    best, back = steps[OUTSIDE] + scores[begin], []
    final = best.copy()  # of the tokens reached last
    for at, n in enumerate(alive[1:], 1):
        paths = best[:n, :, None] + steps[None]
        back.append(paths.argmax(axis=1))
        best = paths.max(axis=1) + scores[begin[:n] + at]
        final[:n] = best
    tag = (final + steps[:, OUTSIDE]).argmax(axis=1)
    for at in range(len(alive) - 1, -1, -1):
        n = alive[at]
        tags[begin[:n] + at] = tag[:n]
        if at:  # runs that end here start from their own tag
            tag[:n] = back[at - 1][np.arange(n), tag[:n]]
    return tags


def log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return np.log(np.exp(x - top).sum(axis=axis)) + np.squeeze(top, axis)


def marginals(scores: np.ndarray, begin: np.ndarray, length: np.ndarray, steps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Probabilities of each row's tags, and expected counts of the steps from tag to tag (edges included)."""
    begin, alive = longest_first(begin, length)
    forward = [steps[OUTSIDE] + scores[begin]]
    for at, n in enumerate(alive[1:], 1):
        forward.append(log_sum(forward[-1][:n, :, None] + steps[None], 1) + scores[begin[:n] + at])
    total = np.empty(len(begin))
    for at, n in enumerate(alive):
        ends = slice(alive[at + 1] if at + 1 < len(alive) else 0, n)
        total[ends] = log_sum(forward[at][ends] + steps[:, OUTSIDE], 1)
    chance, counts = np.zeros_like(scores), np.zeros((3, 3))
    later, later_scores = np.zeros((0, 3)), np.zeros((0, 3))
    for at in range(len(alive) - 1, -1, -1):
        n, m = alive[at], len(later)
        backward = np.tile(steps[:, OUTSIDE], (n, 1))
        after = (later + later_scores)[:, None, :]
        backward[:m] = log_sum(steps[None] + after, 2)
        p = np.exp(forward[at] + backward - total[:n, None])
        chance[begin[:n] + at] = p
        counts[:, OUTSIDE] += p[m:].sum(axis=0)
        counts += np.exp(forward[at][:m, :, None] + steps[None] + after - total[:m, None, None]).sum(axis=0)
        if at == 0:
            counts[OUTSIDE] += p.sum(axis=0)
        later, later_scores = backward, scores[begin[:n] + at]
    return chance, counts


@dataclass
class Field:
    """Weights of the features for each tag, of the steps between tags, and the margin in favour of outside."""

    weights: np.ndarray
    steps: np.ndarray
    margin: float = 0.0

    def scores(self, features: np.ndarray) -> np.ndarray:
        return self.weights[features].sum(axis=1)

    def tags(self, tokens: Tokens) -> np.ndarray:
        scores = self.scores(tokens.features)
        scores[:, OUTSIDE] += self.margin
        return viterbi(scores, *tokens.runs(), self.steps)


def learn(tokens: Tokens, truth: np.ndarray) -> Field:
    """Maximum likelihood with a quadratic penalty, by Adam over all runs. ``truth``: the tags of the open tokens."""
    begin, length = tokens.runs()
    used, columns = np.unique(tokens.features, return_inverse=True)
    columns = columns.reshape(tokens.features.shape)
    size = len(used) * 3
    x = np.zeros(size + 9)
    closed = np.zeros((3, 3))
    closed[OUTSIDE, INSIDE] = -1e4  # nothing is inside without a beginning
    seen = np.zeros((3, 3))
    first = np.zeros(len(truth), bool)
    first[begin] = True
    np.add.at(seen, (np.where(first, OUTSIDE, np.r_[OUTSIDE, truth[:-1]]), truth), 1)
    np.add.at(seen[:, OUTSIDE], truth[begin + length - 1], 1)
    one_hot = np.eye(3)[truth]
    mean, square = np.zeros_like(x), np.zeros_like(x)
    for t in range(1, STEPS + 1):
        weights, steps = x[:size].reshape(-1, 3), x[size:].reshape(3, 3) + closed
        chance, counts = marginals(weights[columns].sum(axis=1), begin, length, steps)
        gap = chance - one_hot
        slope = [np.bincount(columns.ravel(), np.repeat(gap[:, k], SLOTS), len(used)) for k in range(3)]
        g = np.r_[np.stack(slope, axis=1).ravel(), (counts - seen).ravel()] / len(truth) + PENALTY * x / np.sqrt(len(truth))
        mean, square = 0.9 * mean + 0.1 * g, 0.99 * square + 0.01 * g * g
        x -= RATE * (mean / (1 - 0.9**t)) / (np.sqrt(square / (1 - 0.99**t)) + 1e-9)
    weights = np.zeros((SLOTS * WIDTH, 3))
    weights[used] = x[:size].reshape(-1, 3)
    return Field(weights, x[size:].reshape(3, 3) + closed)


# Words before secrets that the base rules do not ask for, and how a digest is written in formats that they do not know.
CUES = ("", "", "key is ", "bearer ", "Authorization: Bearer ", "credential ", "passphrase ", "pwd: ", "access key ", "auth=", "private key: ", "login with ", "pass ")


def recoded(secret: str, pick: random.Random) -> str:
    """The secret in another format, from its digest."""
    digest = hashlib.sha512(secret.encode()).digest()
    base62 = re.sub(r"[+/=]", "", base64.b64encode(digest + hashlib.sha512(digest).digest()).decode())
    third = pick.choice([12, 20, 30, 45])
    long = pick.choice([16, 20, 24, 32, 36, 40, 48])
    return pick.choice([
        base62[:long], base62[:long], "sk_" + base62[:24], "ghp_" + base62[:36], "key-" + digest.hex()[:long], digest.hex()[:long].upper(),
        base64.b32encode(digest).decode()[:long], base64.b64encode(digest[:long]).decode(), digest.hex()[: min(long, 24)],
        ".".join((pick.choice(["eyJ", ""]) + base62[:third], base62[third : 2 * third], base62[2 * third : 3 * third])),
    ])


def lookalike(words: list[str], pick: random.Random) -> str:
    """Ordinary words in a form that resembles a secret."""
    a, b, c = (pick.choice(words).strip(".,").lower() for _ in range(3))
    number = pick.randrange(10**12)
    return pick.choice([
        f"{a}_{b}_{c}", f"{a.title()}{b.title()}{c.title()}", f"{a}/{b}/{c}{number % 100}.html", f"www.{a}{b}.com/{c}", f"{number:016d}", f"{a}-{b}-{c}",
        f"{number % 3000}-{number % 12:02d}-{number % 28:02d}", f"{a}{b}{c}", f"{a.upper()}{b.upper()}", f"{a}.{b}@{c}.com", f"v{number % 90}.{number % 70}.{number % 1000}",
    ])


def variants(before: str, secret: str, after: str, pick: random.Random) -> list[tuple[str, str, str, bool]]:
    """Windows as (before, value, after, whether the value is a secret) made from one window."""
    bare = re.sub(r"""\S+["']?\x20*[:=]?\x20*["']?$""", "", before)
    words = [w for w in (before + " " + after).split() if w.isalpha()] or ["word"]
    found = [(bare + pick.choice(CUES), recoded(secret, pick), " " + after.lstrip("\"' "), True) for _ in range(2)]
    found += [(before, recoded(secret, pick), after, True)]
    plain = pick.choice(["", "", "the ", pick.choice(CUES).replace(":", "").replace("=", " ")])
    return found + [(bare + plain, lookalike(words, pick), " " + after.lstrip("\"' "), False) for _ in range(3)]


def examples(windows: list[dict]) -> tuple[Tokens, np.ndarray]:
    """Tokens of all windows and their variants, and the true tags of the open ones."""
    texts, spans, files = [], [], []
    for w in windows:
        text, own = w["text"], np.array(w["file"])
        parts = secret_parts(text)
        texts.append(text)
        spans.append(parts)
        files.append(own)
        for s, e in parts:
            pick = random.Random(text[s:e])
            others = [p for p in parts if p != (s, e)]
            if any(a < e and s < b for a, b in others):  # a value that two rules find is varied once
                if any(a <= s and e <= b and (b - a > e - s) for a, b in others):
                    continue
            for before, value, after, real in variants(text[:s][-AROUND // 2 :], text[s:e], text[e:][: AROUND // 3], pick):
                whole = before + value + after
                texts.append(whole)
                spans.append(sorted(set(secret_parts(whole)) | ({(len(before), len(before) + len(value))} if real else set())))
                files.append(own)
    raw, offsets = byte_columns(pa.array(texts, pa.string()))
    tokens = Tokens(raw, offsets, np.array(files).reshape(-1, 3))
    truth = np.zeros(len(tokens.open), np.int64)
    begin, end, text = tokens.start[tokens.open], tokens.end[tokens.open], tokens.text[tokens.open]
    edges = np.searchsorted(text, np.arange(len(texts) + 1))
    for k, (t, parts) in enumerate(zip(texts, spans)):
        merged = []
        for s, e in parts:
            if merged and s < merged[-1][1]:
                merged[-1][1] = max(e, merged[-1][1])
            else:
                merged.append([s, e])
        for s, e in merged:
            s, e = (offsets[k] + len(t[:x].encode()) for x in (s, e))
            inside = [i for i in range(edges[k], edges[k + 1]) if begin[i] < e and s < end[i]]
            for n, i in enumerate(inside):
                truth[i] = INSIDE if n and tokens.open[i] == tokens.open[inside[n - 1]] + 1 else BEGIN
    return tokens, truth


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Windows around the secrets of each text, and one drawn elsewhere, with the features of the text."""
    for batch in batches:
        rows = []
        for text in batch.column("text").to_pylist():
            raw = np.frombuffer(text.encode(), np.uint8)
            parts = secret_parts(text)
            pick = random.Random(hashlib.sha256(text.encode()).digest()[:8])
            at = pick.randrange(len(text))
            file = Tokens._of_texts(raw, KIND[raw], np.array([0, len(raw)]))[0].tolist()
            spans = [(True, max(0, s - AROUND), e + AROUND) for s, e in parts] + [(False, max(0, at - AROUND), at + AROUND)]
            for real, s, e in spans:
                window = text[s:e]
                window = window[re.match(r"\S*\s?", window).end() :] if s else window  # whole words only
                window = window[: re.search(r"\s?\S*\Z", window).start()] if e < len(text) else window
                if window and (real or not secret_parts(window)):
                    rows.append({"real": real, "draw": pick.random(), "text": window, "file": file})
        yield pa.RecordBatch.from_pylist(rows, pa.schema([("real", pa.bool_()), ("draw", pa.float64()), ("text", pa.string()), ("file", pa.list_(pa.int64()))]))


def fit(docs: DataFrame, sample: int = SAMPLE) -> Field | None:
    """A field from at most ``sample`` windows around secrets and as many elsewhere in ``text``, drawn by hash. No secrets: none, and nothing is added.

    Equal windows teach once. Null and empty texts teach nothing; a very long text gives one window elsewhere like any other.
    """
    bounded_batches(docs.sparkSession)
    texts = docs.filter("length(text) > 0").select("text")
    found = stage(texts.mapInArrow(_windows, "real boolean, draw double, text string, file array<bigint>").dropDuplicates(["text"]), "windows")
    drawn = [found.filter(F.col("real") == real).orderBy("draw", "text").limit(sample).toArrow().to_pylist() for real in (True, False)]
    if not drawn[0]:
        return None
    held = [rows[::4] for rows in drawn]
    taught = [[r for k, r in enumerate(rows) if k % 4] or rows for rows in drawn]
    field = learn(*examples(taught[0] + taught[1]))
    tokens, truth = examples(held[0] + held[1])
    for margin in np.arange(0.0, 8.0, 0.5):
        field.margin = float(margin)
        tagged = field.tags(tokens) != OUTSIDE
        if (truth[tagged] != OUTSIDE).sum() >= PRECISION * tagged.sum():
            break
    return field


def added_spans(tokens: Tokens, field: Field) -> list[tuple[int, int, int]]:
    """(text, first byte, end) of the spans that the field tags, with the padding of base64 codes."""
    tags = field.tags(tokens)
    begin = np.flatnonzero(tags == BEGIN)
    found = []
    for k in begin.tolist():
        last = k
        while last + 1 < len(tags) and tags[last + 1] == INSIDE and tokens.open[last + 1] == tokens.open[last] + 1:
            last += 1
        t, s, e = int(tokens.text[tokens.open[k]]), int(tokens.start[tokens.open[k]]), int(tokens.end[tokens.open[last]])
        pad = 0
        while pad < 2 and e < len(tokens.raw) and tokens.raw[e] == 61:
            e, pad = e + 1, pad + 1
        found.append((t, s, e))
    return found


def select(column: pa.Array, field: Field | None) -> Iterator[list[tuple[int, int, int]]]:
    """(start, kind, end) of all spans of each text (null: empty), by start, then kind."""
    raw, offsets = byte_columns(column)
    for lo, hi in slices(offsets, CHUNK):
        part, at = raw[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        texts = [part[s:e].tobytes().decode() for s, e in zip(at[:-1].tolist(), at[1:].tolist())]
        base = [base_spans(t) for t in texts]
        added: list[list[tuple[int, int]]] = [[] for _ in texts]
        if field and len(part):
            for t, s, e in added_spans(Tokens(part, at), field):
                begin = part[at[t] : s]
                first = int(np.count_nonzero((begin & 0xC0) != 0x80))
                added[t].append((first, first + len(part[s : min(e, at[t + 1])].tobytes().decode())))
        for own, more in zip(base, added):
            yield sorted(own + [(s, 3, e) for s, e in apart(more, own)])


def apart(spans: list[tuple[int, int]], base: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """Spans that overlap none of ``base``; both come in order."""
    kept, k, reach = [], 0, -1
    for s, e in spans:
        while k < len(base) and base[k][0] < e:
            reach = max(reach, base[k][2])
            k += 1
        if reach <= s:
            kept.append((s, e))
    return kept


SPANS = "array<struct<kind:string,start:bigint,end:bigint,base:boolean>>"


def find(docs: DataFrame, field: Field | None) -> DataFrame:
    """``doc_id`` and ``spans`` (kind, start, end in code points, whether a base rule holds) of each row, by start, then kind.

    Null and empty texts have none, repeated rows have the same ones, other columns are not read. Texts of any length are read whole.
    """
    bounded_batches(docs.sparkSession)
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = [[{"kind": KINDS[k], "start": s, "end": e, "base": k < 3} for s, k, e in own] for own in select(batch.column("text"), field)]
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "spans": pa.array(spans, kind)})

    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, f"doc_id {dict(rows.dtypes)['doc_id']}, spans {SPANS}")


def redact(docs: DataFrame, field: Field | None) -> DataFrame:
    """``docs`` with each span of ``text`` replaced by ``[SECRET]``; spans that overlap become one. A null text stays null."""
    bounded_batches(docs.sparkSession)

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        out = []
        for text, spans in zip(texts, select(pa.array(texts, pa.string(), from_pandas=True), field)):
            parts, at = [], 0
            for start, _, end in spans:
                if start >= at:
                    parts += [text[at:start], "[SECRET]"]
                at = max(at, end)
            out.append(None if text is None else "".join([*parts, text[at:]]))
        return pd.Series(out, dtype=object)

    return docs.withColumn("text", run.asNondeterministic()("text"))
