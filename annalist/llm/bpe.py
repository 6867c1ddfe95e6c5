"""Byte-pair encoding and decoding of whole texts.

Short texts are cut where the tokenizer's own pattern cannot look across (before
white space that follows something else), and the pieces are looked up in a
bounded cache. Where white space has no ids, text of letters and common marks is encoded whole, in one call for many texts. Texts longer than a leaf are encoded by tree concatenation: the
text is halved until the halves are leaves, the leaves are spread over the
cluster and encoded in parallel, then neighbours are joined up the tree. Where a
cut fell inside an unsplit run, a window around the join is encoded again and
grown until its first and last token are those that stood there before.

Why the joined tokens are exact: a token sequence is the encoding of a run if
and only if each neighbouring pair of it is. Every pair left of the window is a
pair of the left encoding, every pair right of it one of the right encoding, and
the pairs in the window were just encoded.
"""

from __future__ import annotations

import json
import os
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from annalist.llm.common import bounded_batches, kept, texts_of

#: Fixed value: how byte-level vocabularies split a text.
BYTE_LEVEL_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Stands for the end of a word where tokens tell it.
WORD_END = "\0"
#: Characters of a leaf. Longer texts are halved.
LEAF = 1 << 16
#: Pieces kept by the cache of one worker, and the longest piece kept.
CACHED, CACHED_CHARS = 250_000, 48
PLAIN = " \t\n\v\f\r"
#: Letters and marks whose kind all engines agree on. Words of these letters are pieces apart from marks after them.
LETTERS, MARKS = "A-Za-z\xc0-\xd6\xd8-\xf6\xf8-\xff", ".,!?;:*#$%&|"
WORD = f"[{LETTERS}]++(?=[{MARKS}]*+(?:[{PLAIN}]|\\Z))|[{MARKS}]++(?=[{PLAIN}]|\\Z)"
PIECE = re.compile(f"[{PLAIN}]*+{WORD}|[{PLAIN}]*+[^{PLAIN}]+|[{PLAIN}]+")
SIMPLE = re.compile(f"[{LETTERS}]+")
#: What is neither of these letters and marks nor plain white space, and runs that hold some.
OTHER = re.compile(f"[^{LETTERS}{MARKS}{PLAIN}]")
OTHER_RUN = re.compile(f"(?<![^{PLAIN}])([{LETTERS}{MARKS}]*+[^{LETTERS}{MARKS}{PLAIN}][^{PLAIN}]*+)")
#: Kinds of the bytes of texts without others: 0 white space, 1 letters, 2 marks. And a text by which a vocabulary shows that it splits so.
KINDS = np.array([0 if chr(b) in PLAIN else 2 if chr(b) in MARKS else 1 for b in range(256)], dtype=np.uint8)
PROBE = "".join(f"Ab{m}C {m}\xc9 {m}{n}\n" for m in MARKS for n in MARKS) + " \t\n\v\f\r".join("xyz")
#: White space on which pattern engines differ: texts with it are not cut into pieces.
ODD_CODES = [*range(0x1C, 0x20), 0x85, 0xA0, 0x1680, 0x180E, *range(0x2000, 0x2010), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000, 0xFEFF]
ODD = re.compile("[" + "".join(map(chr, ODD_CODES)) + "]")


class Encoder:
    """One vocabulary file with its piece cache."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as file:
            data = json.load(file)
        self.special = [t["content"] for t in data["added_tokens"]]
        self.any_special = re.compile("|".join(map(re.escape, self.special)) or "(?!)")
        self.known: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.fast = ranked(data, path)
        # Special tokens must not hide in letters and marks.
        self.plain = self.fast is not None and self.fast[1] is not None and all(map(OTHER.search, self.special))
        self.plain = self.plain and self.plain_ids([PROBE]) == self.library([PROBE])
        self.piece = PIECE if self.library([" "])[0] else re.compile(f"{WORD}|[^{PLAIN}]+")

    def library(self, texts: list[str]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(e.ids, dtype="<u4").tobytes() for e in found]

    def fresh(self, pieces: list[str]) -> dict[str, bytes]:
        """Ids of pieces that the cache does not hold."""
        if self.fast is None:
            return dict(zip(pieces, self.library(pieces)))
        ranks, ids, _ = self.fast
        encode = ranks.encode_ordinary
        if ids is None:
            return {p: array("I", encode(p)).tobytes() for p in pieces}
        simple = SIMPLE.fullmatch
        out = {p: ids[encode(p.lower() + WORD_END)].tobytes() for p in pieces if simple(p)}
        others = [p for p in pieces if p not in out]
        return out | dict(zip(others, self.library(others)))

    def ids(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        out: list[bytes] = []
        for start in range(0, len(texts), 64):
            some = texts[start : start + 64]
            out += self.by_runs(some) if self.plain else self.by_pieces(some)
        return out

    def by_runs(self, texts: list[str]) -> list[bytes]:
        """Ids of texts whose white space has none: runs of letters and marks are encoded together, the others by pieces."""
        parts: list[list[str]] = []  # by turns text of letters and marks, and a run with something else
        for text in texts:
            if not OTHER.search(text):
                parts.append([text])
            elif ODD.search(text) or self.any_special.search(text):
                parts.append(["", text])
            else:
                parts.append(OTHER_RUN.split(text))
        plain = iter(self.plain_ids([p for x in parts for p in x[::2]]))
        others = iter(self.by_pieces([p for x in parts for p in x[1::2]]))
        return [b"".join(next(others if n % 2 else plain) for n in range(len(x))) for x in parts]

    def plain_ids(self, texts: list[str]) -> list[bytes]:
        """Ids of texts that hold plain white space, letters and marks only, all in one call. Letters next to each other are a word, as are marks."""
        ranks, ids, last = self.fast
        coded = [t.lower().encode() for t in texts]
        raw = np.frombuffer(b"\n".join([*coded, b""]), np.uint8)
        kinds = KINDS[raw]
        mask = np.empty((len(raw), 2), dtype=bool)
        mask[:, 0] = kinds > 0
        mask[:, 1] = mask[:, 0] & (kinds != np.append(kinds[1:], 0))
        both = np.zeros((len(raw), 2), dtype=np.uint8)  # ``WORD_END`` is a zero byte
        both[:, 0] = raw
        found = ranks.encode_to_numpy(both[mask].tobytes().decode())
        words = np.searchsorted(np.flatnonzero(mask[:, 1]), np.cumsum([0, *(len(c) + 1 for c in coded)]))
        at = (4 * np.append(0, np.flatnonzero(last[found]) + 1)[words]).tolist()
        out = ids[found].tobytes()
        return [out[a:b] for a, b in zip(at, at[1:])]

    def by_pieces(self, texts: list[str]) -> list[bytes]:
        """Ids of texts by the cache of pieces."""
        whole = [bool(ODD.search(t) or self.any_special.search(t)) for t in texts]
        cut = [None if w else self.piece.findall(t) for w, t in zip(whole, texts)]
        if len(self.known) > CACHED:
            self.old, self.known = self.known, {}
        known, old = self.known, self.old
        missing = {p for pieces in cut if pieces for p in pieces if p not in known}
        again = missing & old.keys()
        known.update((p, old[p]) for p in again)
        now = self.fresh(list(missing - again))
        long = {p for p in now if len(p) > CACHED_CHARS}
        known.update(now)
        look = known.__getitem__
        out = [self.library([t])[0] if p is None else b"".join(map(look, p)) for t, p in zip(texts, cut)]
        for p in long:
            del known[p]
        return out

    def encode_run(self, run: bytes) -> np.ndarray:
        """Ids of a text that starts and ends at a character border."""
        return np.frombuffer(self.library([run.decode()])[0], dtype="<u4")

    def holds_special(self, text: str, at: int) -> bool:
        """Whether a special token's text stands across a position."""
        return any(s in text[max(0, at - len(s) + 1) : at + len(s) - 1] for s in self.special)


def ranked(data: dict, path: str):
    """The same encoding of single pieces by ranks, which is faster: an encoding, the id of each rank unless they are the same, and whether it ends a word.

    None for vocabularies of another make. Where tokens tell the end of a word, the pieces are
    simple words, and a character that is in none of them stands for the end; joining it to the last byte comes first. Many words,
    each with that character, can be encoded in one call.
    """
    import tiktoken

    model, special = data["model"], {t["id"] for t in data["added_tokens"]}
    pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
    order = [model["vocab"][a + b] for a, b in pairs]
    if order != sorted(set(order)) or model.get("continuing_subword_prefix") or model.get("dropout") or model.get("ignore_merges"):
        return None
    split, end = data["pre_tokenizer"] or {}, model.get("end_of_word_suffix")
    if end:
        kinds = [n["type"] for n in (data["normalizer"] or {}).get("normalizers", [])]
        levels = split.get("pretokenizers", [])
        if kinds != ["NFC", "Replace", "Lowercase"] or [x["type"] for x in levels] != ["Split", "ByteLevel"] or r"[\p{L}]+" not in levels[0]["pattern"].get("Regex", ""):
            return None
        back = byte_alphabet()
        shown = {b: c for c, b in back.items()}
        plain = lambda token: bytes(back[c] for c in token.removesuffix(end)) + WORD_END.encode() * token.endswith(end)
        tokens = [bytes([b]) for b in range(256)] + [bytes([b]) + WORD_END.encode() for b in range(256)] + [plain(a + b) for a, b in pairs]
        names = [shown[b] for b in range(256)] + [shown[b] + end for b in range(256)] + [a + b for a, b in pairs]
        if len(set(tokens)) != len(tokens):
            return None
        ranks = tiktoken.Encoding("ranked", pat_str=f"[^{WORD_END}]+{WORD_END}", mergeable_ranks={t: n for n, t in enumerate(tokens)}, special_tokens={})
        return ranks, np.array([model["vocab"][n] for n in names], dtype="<u4"), np.array([n.endswith(end) for n in names])
    if split.get("type") != "ByteLevel" or not split.get("use_regex") or split.get("add_prefix_space") or data["normalizer"]:
        return None
    table = token_bytes(path)
    if len(order) + 256 + len(special) != len(table):
        return None
    ranks = {b: n for n, b in enumerate(table) if n not in special}
    return tiktoken.Encoding("ranked", pat_str=BYTE_LEVEL_PATTERN, mergeable_ranks=ranks, special_tokens={}), None, None


def byte_alphabet() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable bytes for themselves, others from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + n): b for n, b in enumerate(hidden)}


@kept
def encoder(path: str) -> Encoder:
    return Encoder(path)


@kept
def token_bytes(path: str) -> list[bytes]:
    """The bytes of each id of a byte-level vocabulary; special tokens are their text."""
    with open(path, encoding="utf-8") as file:
        data = json.load(file)
    back = byte_alphabet()
    vocabulary = data["model"]["vocab"]
    special = {t["id"]: t["content"].encode() for t in data["added_tokens"]}
    out = [b""] * (1 + max([*vocabulary.values(), *special]))
    for token, n in vocabulary.items():
        out[n] = special[n] if n in special else bytes(map(back.__getitem__, token))
    for n, text in special.items():
        out[n] = text
    return out


def decode_ids(ids: bytes, table: list[bytes]) -> bytes:
    return b"".join(map(table.__getitem__, np.frombuffer(ids, dtype="<u4").tolist()))


def kind(c: str) -> str:
    """Letter, number, white space or other, as the tokenizer's pattern tells them apart."""
    import unicodedata

    c0 = unicodedata.category(c)[0]
    return c0 if c0 in "LN" else "S" if c.isspace() else "O"


def cut_near(text: str, middle: int, encoder: Encoder, inside: bool, reach: int = 4096) -> tuple[int, bool] | None:
    """A place to cut near the middle, and whether tokens can run across it.

    Clean cuts stand before plain white space after something else. Failing
    that, a cut inside a run of one kind is taken: four characters of the same
    kind on both sides, so that both sides belong to one unsplit run.
    """
    low, high = max(4, middle - reach), min(len(text) - 4, middle + reach)
    for at in sorted(range(low, high), key=lambda x: abs(x - middle)):
        if text[at] in PLAIN and not text[at - 1].isspace() and not ODD.match(text[at - 1]):
            return at, False
    for at in range(middle, high if inside else middle):
        if len({kind(c) for c in text[at - 4 : at + 4]}) == 1 and not encoder.holds_special(text, at):
            return at, True
    return None


def halves(text: str, encoder: Encoder, leaf: int, inside: bool) -> list[tuple[str, bool]]:
    """Leaves of a text with, for each, whether its start is inside an unsplit run."""
    done: list[tuple[str, bool]] = []
    todo = [(text, False)]
    while todo:
        part, joined = todo.pop()
        cut = cut_near(part, len(part) // 2, encoder, inside) if len(part) > leaf else None
        if cut is None:
            done.append((part, joined))
        else:
            todo += [(part[cut[0] :], cut[1]), (part[: cut[0]], joined)]
    return done


def join(left: np.ndarray, right: np.ndarray, table: list[bytes], encoder: Encoder) -> np.ndarray:
    """Tokens of two texts that were cut inside an unsplit run, joined exactly."""
    a = b = 4
    while True:
        a, b = min(a, len(left)), min(b, len(right))
        window = b"".join(table[n] for n in [*left[len(left) - a :].tolist(), *right[:b].tolist()])
        try:
            middle = encoder.encode_run(window)
        except UnicodeDecodeError:  # an end is inside a character: grow
            middle = np.zeros(0, "<u4")
        starts = a == len(left) or len(middle) and middle[0] == left[len(left) - a]
        ends = b == len(right) or len(middle) and middle[-1] == right[b - 1]
        if len(middle) and starts and ends:
            return np.concatenate([left[: len(left) - a], middle, right[b:]])
        if a == len(left) and b == len(right):
            return middle
        a, b = a * (1 if len(middle) and starts else 2), b * (1 if len(middle) and ends else 2)


def join_tree(parts: list[tuple[np.ndarray, bool]], table: list[bytes], encoder: Encoder) -> np.ndarray:
    """Neighbours joined pairwise, level by level."""
    while len(parts) > 1:
        level = []
        for n in range(0, len(parts) - 1, 2):
            (left, joined), (right, inside) = parts[n : n + 2]
            both = join(left, right, table, encoder) if inside and len(left) and len(right) else np.concatenate([left, right])
            level.append((both, joined))
        parts = level + parts[len(parts) - len(parts) % 2 :]
    return parts[0][0]


def encode(docs: DataFrame, vocabulary: str, leaf: int = LEAF, inside: bool = True) -> DataFrame:
    """``doc_id``, ``ids`` (little-endian unsigned 32-bit integers) and ``n_tokens`` of each row.

    ``vocabulary`` is a file of the tokenizers library, at a path every worker
    has. ``inside`` allows cuts inside unsplit runs; only byte-level vocabularies,
    whose tokens are the text's own bytes, can join those. The ids are those of the library without special tokens added. A
    null text is empty, an empty text has no ids; rows with the same or a null
    ``doc_id`` are encoded each for itself. A text that is longer than ``leaf``
    and has no allowed cut is encoded as one leaf.
    """
    bounded_batches(docs.sparkSession)
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    size = F.length("text")

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(vocabulary)
        for batch in batches:
            ids = e.ids(texts_of(batch.column("text")))
            yield pa.RecordBatch.from_pydict(
                {"doc_id": batch.column("doc_id"), "ids": pa.array(ids, pa.binary()), "n_tokens": pa.array([len(x) // 4 for x in ids], pa.int64())}
            )

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(vocabulary)
        for batch in batches:
            for n in range(batch.num_rows):
                parts = halves(batch.column("text")[n].as_py(), e, leaf, inside)
                yield pa.RecordBatch.from_pydict(
                    {
                        "row": pa.array([batch.column("row")[n].as_py()] * len(parts), pa.int64()),
                        "doc_id": pa.array([batch.column("doc_id")[n].as_py()] * len(parts), batch.schema.field("doc_id").type),
                        "leaf": pa.array(range(len(parts)), pa.int32()),
                        "inside": pa.array([p[1] for p in parts]),
                        "text": pa.array([p[0] for p in parts], pa.string()),
                    }
                )

    def leaves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(vocabulary)
        for batch in batches:
            ids = e.ids(texts_of(batch.column("text")))
            yield batch.drop_columns(["text"]).append_column("ids", pa.array(ids, pa.binary()))

    def joined(parts):
        e, table = encoder(vocabulary), token_bytes(vocabulary)
        parts = parts.sort_values("leaf")
        ids = join_tree([(np.frombuffer(i, "<u4"), bool(x)) for i, x in zip(parts["ids"], parts["inside"])], table, e)
        out = parts[["doc_id"]].head(1).copy()
        out["ids"], out["n_tokens"] = [ids.astype("<u4").tobytes()], [len(ids)]
        return out

    id_type = dict(rows.dtypes)["doc_id"]
    schema = f"doc_id {id_type}, ids binary, n_tokens bigint"
    short = rows.filter(size <= leaf).mapInArrow(whole, schema)
    long = rows.filter(size > leaf).withColumn("row", F.monotonically_increasing_id())
    long = long.mapInArrow(cut, f"row bigint, doc_id {id_type}, leaf int, inside boolean, text string")
    long = long.repartition(F.col("row"), F.col("leaf")).mapInArrow(leaves, f"row bigint, doc_id {id_type}, leaf int, inside boolean, ids binary")
    return short.unionByName(long.groupBy("row").applyInPandas(joined, schema))


def decode(encoded: DataFrame, vocabulary: str) -> DataFrame:
    """``encoded`` with ``text``: the text of ``ids``, special tokens written out, broken UTF-8 replaced. Null ids: null."""
    bounded_batches(encoded.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = token_bytes(vocabulary)
        for batch in batches:
            texts = [None if i is None else decode_ids(i, table).decode(errors="replace") for i in batch.column("ids").to_pylist()]
            yield batch.append_column("text", pa.array(texts, pa.string()))

    rest = encoded.drop("text")
    return rest.mapInArrow(run, StructType([*rest.schema.fields, StructField("text", StringType())]))
