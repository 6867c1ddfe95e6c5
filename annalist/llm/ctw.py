"""Language-model scores by context-tree weighting.

A text is its words with single spaces between them, A-Z lowered, and an end
symbol. Each byte is eight binary decisions. For each decision a tree over the
preceding bytes, ``DEPTH`` deep, mixes the Krichevsky-Trofimov estimates of all
its depths, weighted by how well each explains the training texts. A context
that training never saw adds nothing; the deepest one seen ends the path.

All the model needs of the corpus are the counts of ``DEPTH + 1`` byte grams. Texts
are dealt into chunks of bounded size, and a chunk asks for its own different
grams and words only, so counts travel once per chunk and never as a whole: they
are summed per gram, cut into parts that hold whole contexts of three bytes,
turned into probabilities there, and joined back to the chunks that asked. A part
sums up what it means for depth 2; depths 0 to 2, whose number of nodes the
alphabet bounds, are mixed from these sums on the driver and broadcast.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable, Iterator
from zlib import compress, decompress

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from annalist.llm.common import bounded_batches, byte_columns, slices, stage

#: Preceding bytes of the deepest context, and of those that parts of the grams hold whole.
DEPTH, SPLIT = 5, 3
#: Bits of a gram beside such a context.
OPEN = 8 * (DEPTH + 1 - SPLIT)
#: Bytes of text in a chunk, grams that a task turns into probabilities at once, and bytes of text looked up at once, which fit a processor's cache.
CHUNK, AT_ONCE, LOOKED_UP = 40 << 20, 400_000, 1 << 18
#: The end of a text, a byte that UTF-8 never uses. It also stands before every text.
END = b"\xff"
WORDS = re.compile(rb"[^\x20\x09-\x0D]+")
LOG2 = math.log(2)


def log_gamma(x: np.ndarray) -> np.ndarray:
    """Logarithm of the gamma function for positive numbers (Stirling's series beyond 8)."""
    x = np.asarray(x, dtype=np.float64)
    product = np.ones_like(x)
    for k in range(8):
        product *= x + k
    y = x + 8
    series = (1 / 12 - (1 / 360 - (1 / 1260 - 1 / (1680 * y * y)) / (y * y)) / (y * y)) / y
    return (y - 0.5) * np.log(y) - y + 0.5 * math.log(2 * math.pi) + series - np.log(product)


#: Logarithms of the gamma function at n + 1/2 and n + 1 for the counts that nearly all nodes have.
SMALL = 1 << 14
AT_HALVES, AT_ONES = log_gamma(np.arange(SMALL) + 0.5), log_gamma(np.arange(SMALL) + 1.0)


def log_gamma_of(counts: np.ndarray, table: np.ndarray, add: float) -> np.ndarray:
    out = table[np.minimum(counts, SMALL - 1)]
    large = counts >= SMALL
    if large.any():
        out[large] = log_gamma(counts[large] + add)
    return out


def kt(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """Log probability of a sequence with so many zeros and ones by the KT estimate."""
    return log_gamma_of(zeros, AT_HALVES, 0.5) + log_gamma_of(ones, AT_HALVES, 0.5) - log_gamma_of(zeros + ones, AT_ONES, 1.0) - math.log(math.pi)


def shortened(keys: np.ndarray) -> np.ndarray:
    """Keys of a depth, or of its nodes, without the farthest byte of the context."""
    return keys >> np.uint64(16) << np.uint64(8) | keys & np.uint64(0xFF)


class Nodes:
    """Nodes of one depth for one of the eight decisions of a byte, and which of them each key belongs to."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray, bit: int):
        path = keys >> np.uint64(8 - bit)
        self.first = np.flatnonzero(np.concatenate([np.ones(min(len(path), 1), dtype=bool), path[1:] != path[:-1]]))
        self.of = np.repeat(np.arange(len(self.first)), np.diff(np.append(self.first, len(path))))
        self.one = (keys >> np.uint64(7 - bit) & np.uint64(1)).astype(bool)
        self.ones = np.add.reduceat(counts * self.one, self.first)
        self.total = np.add.reduceat(counts, self.first)
        own = keys[self.first]
        self.keys = own >> np.uint64(8) << np.uint64(8) | np.uint64(1 << bit) | (own & np.uint64(0xFF)) >> np.uint64(8 - bit)
        self.estimate = kt(self.total - self.ones, self.ones)
        self.weighted, self.share = self.estimate, np.ones(len(own))

    def mix(self, product: np.ndarray) -> None:
        """Weigh half the own estimate and half the product of the children's weighted probabilities."""
        self.weighted = np.logaddexp(self.estimate, product) - LOG2
        self.share = np.exp(np.minimum(self.estimate - LOG2 - self.weighted, 0.0))

    def predict(self, rows: np.ndarray, deeper: np.ndarray, seen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Probability of the bits of some keys from here, and whether training saw their contexts."""
        node = self.of[rows]
        total, ones = self.total[node], self.ones[node]
        own = (np.where(self.one[rows], ones, total - ones) + 0.5) / (total + 1.0)
        share = self.share[node]
        return np.where(seen, share * own + (1 - share) * deeper, own), total > 0


class Depths:
    """Some neighbouring depths of the tree, the deepest first.

    A key of a depth is a context, the byte next to its end first, and then the byte that follows. Keys are different and sorted,
    so the nodes of each decision are runs of keys, and one sort of a depth serves all eight.
    """

    def __init__(self, keys: np.ndarray, counts: np.ndarray, depths: int):
        self.tables, self.up = [(keys, counts)], []
        for _ in range(depths - 1):
            self.tables.append(self.shorter())

    def shorter(self) -> tuple[np.ndarray, np.ndarray]:
        """The next depth; ``up`` leads there from the keys of the last."""
        keys, counts = self.tables[-1]
        short, up = np.unique(shortened(keys), return_inverse=True)
        self.up.append(up)
        return short, np.bincount(up, counts, len(short)).astype(np.int64)

    def nodes(self, bit: int, products: tuple[np.ndarray, np.ndarray] | None = None) -> list[Nodes]:
        """Nodes of each depth, mixed from the deepest up; ``products`` are those of its children, by sorted key of the node."""
        out: list[Nodes] = []
        for depth, (keys, counts) in enumerate(self.tables):
            nodes = Nodes(keys, counts, bit)
            if out:
                parent = nodes.of[self.up[depth - 1][out[-1].first]]
                nodes.mix(np.bincount(parent, out[-1].weighted, len(nodes.first)))
            elif products:
                nodes.mix(products[1][np.searchsorted(products[0], nodes.keys)])
            out.append(nodes)
        return out

    def predict(self, nodes: list[Nodes], rows: np.ndarray, p: np.ndarray, seen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Follow some keys of the deepest table up."""
        for depth, level in enumerate(nodes):
            if depth:
                rows = self.up[depth - 1][rows]
            p, seen = level.predict(rows, p, seen)
        return p, seen


class Part(Depths):
    """Depths from SPLIT on of grams that hold all of some contexts of SPLIT bytes."""

    def __init__(self, grams: np.ndarray, counts: np.ndarray):
        super().__init__(grams, counts, DEPTH - SPLIT + 1)

    def sums(self) -> tuple[np.ndarray, np.ndarray]:
        """What depth SPLIT - 1 needs: even numbers are keys with their counts, odd ones its nodes with their children's products."""
        keys, counts = self.shorter()
        numbers, values = [keys << np.uint64(1)], [counts.astype(np.float64)]
        for bit in range(8):
            last = self.nodes(bit)[-1]
            node, of = np.unique(shortened(last.keys), return_inverse=True)
            numbers.append(node << np.uint64(1) | np.uint64(1))
            values.append(np.bincount(of, last.weighted, len(node)))
        return np.concatenate(numbers), np.concatenate(values)

    def log10(self, top: Top) -> np.ndarray:
        """log10 probability of the last byte of each gram after the others."""
        grams = self.tables[0][0]
        shallow = np.searchsorted(top.tables[0][0], grams >> np.uint64(8 * (DEPTH + 2 - SPLIT)) << np.uint64(8) | grams & np.uint64(0xFF))
        rows, out = np.arange(len(grams)), np.zeros(len(grams))
        for bit in range(8):
            p, seen = self.predict(self.nodes(bit), rows, np.zeros(len(grams)), np.zeros(len(grams), dtype=bool))
            p, _ = top.predict(top.nodes(bit, top.products), shallow, p, seen)
            out += np.log10(p)
        return out


class Top(Depths):
    """Depths below SPLIT, from the sums of all parts. Lower-cased UTF-8 has fewer than 5 million keys of two bytes and a third."""

    def __init__(self, numbers: np.ndarray, values: np.ndarray):
        order = np.argsort(numbers)
        numbers, values = numbers[order], values[order]
        is_node = numbers & np.uint64(1) == 1
        keys = numbers >> np.uint64(1)
        super().__init__(keys[~is_node], values[~is_node].astype(np.int64), SPLIT)
        self.products = keys[is_node], values[is_node]


def grams_of(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The grams at all places of some texts that are one after another, each followed by the end symbol.

    The byte of the place is the lowest, the one before it the highest, so contexts with a common end sort together.
    """
    sizes = np.diff(offsets) + 1 + DEPTH
    at = np.cumsum(sizes) - sizes
    own = np.ones(int(sizes.sum()), dtype=bool)
    for k in range(DEPTH):
        own[at + k] = False
    last = at + sizes - 1
    own[last] = False
    padded = np.full(len(own), END[0], dtype=np.uint64)
    padded[own] = raw
    own[last] = True
    grams = padded[DEPTH:].copy()
    for k in range(1, DEPTH + 1):
        grams |= padded[DEPTH - k : len(padded) - k] << np.uint64(8 * (DEPTH + 1 - k))
    return grams[own[DEPTH:]]


class Lookup:
    """Values by gram. Grams lie in the order of a hash, so that one is found in a step or two."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.shift = np.uint64(64 - max(1, len(keys).bit_length()))
        place = self.places(keys)
        order = np.argsort(place, kind="stable")
        self.keys, self.values = keys[order], values[order]
        self.first = np.cumsum(counts := np.bincount(place, minlength=1 << int(64 - self.shift))) - counts

    def places(self, keys: np.ndarray) -> np.ndarray:
        mixed = (keys ^ keys >> np.uint64(29)) * np.uint64(0x9E3779B97F4A7C15)
        return ((mixed ^ mixed >> np.uint64(32)) * np.uint64(0xD6E8FEB86659FD93) >> self.shift).astype(np.int64)

    def of(self, keys: np.ndarray) -> np.ndarray:
        """The values of grams, all of which are known."""
        at = self.first[self.places(keys)]
        other = np.flatnonzero(self.keys[at] != keys)
        while len(other):
            at[other] += 1
            other = other[self.keys[at[other]] != keys[other]]
        return self.values[at]


def merged(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    unique, of = np.unique(np.concatenate(keys), return_inverse=True)
    return unique, np.bincount(of, np.concatenate(counts), len(unique)).astype(np.int64)


def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted grams and their counts in parts of about AT_ONCE that hold whole contexts of SPLIT bytes."""

    def part(grams: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({"grams": pa.array([grams.tobytes()], pa.binary()), "counts": pa.array([counts.tobytes()], pa.binary())})

    held_grams, held_counts, n = [], [], 0
    for batch in batches:
        held_grams.append(batch.column("gram").to_numpy())
        held_counts.append(batch.column("n").to_numpy())
        n += batch.num_rows
        if n >= AT_ONCE:
            grams, counts = np.concatenate(held_grams), np.concatenate(held_counts)
            # The context that the last gram is in may go on.
            cut = int(np.searchsorted(grams, grams[-1] >> OPEN << OPEN))
            if cut:
                yield part(grams[:cut], counts[:cut])
            held_grams, held_counts, n = [grams[cut:]], [counts[cut:]], 0
    if held_grams and len(grams := np.concatenate(held_grams)):
        yield part(grams, np.concatenate(held_counts))


def opened(batches: Iterator[pa.RecordBatch]) -> Iterator[Part]:
    for batch in batches:
        for grams, counts in zip(batch.column("grams"), batch.column("counts")):
            yield Part(np.frombuffer(grams.as_buffer(), "<u8"), np.frombuffer(counts.as_buffer(), "<i8"))


def unpacked(column: pa.Array) -> pa.Array:
    return pa.array(map(decompress, column.to_pylist()), pa.large_binary())


def packed(rows: DataFrame, pack: Callable[[pa.Table], bytes]) -> DataFrame:
    """``chunk``, ``n`` and ``blob`` for parts of the rows of each chunk, so that few rows are shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            held.append(batch)
            size += batch.num_rows
            if size >= AT_ONCE:
                yield from blobs(held)
                held, size = [], 0
        if size:
            yield from blobs(held)

    def blobs(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(held)
        table = table.take(pa.array(np.argsort(table.column("chunk").to_numpy(), kind="stable"))).combine_chunks()
        chunks = table.column("chunk").to_numpy()
        first = np.flatnonzero(np.diff(chunks, prepend=chunks[0] - 1))
        parts = [table.slice(a, b - a) for a, b in zip(first, [*first[1:], len(chunks)])]
        yield pa.RecordBatch.from_pydict(
            {"chunk": pa.array(chunks[first]), "n": pa.array(map(len, parts), pa.int64()), "blob": pa.array(map(pack, parts), pa.binary())}
        )

    return rows.mapInArrow(run, "chunk bigint, n bigint, blob binary")


def score(docs: DataFrame) -> DataFrame:
    """Scores of each row by models of the rows that are not held out.

    Held out are rows whose crc32 of ``doc_id`` as text is 1 modulo 5; those without a ``doc_id`` train.
    Returns ``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte``:
    the base is a smoothed unigram model of words and end, both scores are log10. A null text is empty, that
    is, just the end. Nothing to train on: every bit costs one bit.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 1, F.lit(False))
    rows = docs.select("doc_id", held.alias("held"), F.coalesce("text", F.lit("")).cast("binary").alias("text"))
    id_type = dict(rows.dtypes)["doc_id"]

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk, size = TaskContext.get().partitionId() << 32, 0
        for batch in batches:
            texts = [b" ".join(WORDS.findall(t.lower())) for t in batch.column("text").to_pylist()]
            labels = []
            for t in texts:
                if size > CHUNK:
                    chunk, size = chunk + 1, 0
                size += len(t) + 1
                labels.append(chunk)
            yield pa.RecordBatch.from_pydict(
                {"doc_id": batch.column("doc_id"), "held": batch.column("held"), "chunk": pa.array(labels, pa.int64()), "text": pa.array([compress(t, 1) for t in texts], pa.binary())}
            )

    dealt = stage(rows.mapInArrow(deal, f"doc_id {id_type}, held boolean, chunk bigint, text binary"), "chunks")

    def runs(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        """Rows of a batch by chunk and by whether they train, in parts of bounded size."""
        chunks, held_ = batch.column("chunk").to_numpy(), batch.column("held").to_numpy(zero_copy_only=False)
        for chunk in np.unique(chunks):
            for h in (False, True):
                part = batch.filter(pa.array((chunks == chunk) & (held_ == h)))
                if part.num_rows:
                    yield int(chunk), h, part

    def count_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            for chunk, h, part in runs(batch):
                for old in [c for c in open_ if c != chunk]:
                    yield gram_rows(old, *open_.pop(old))
                raw, offsets = byte_columns(unpacked(part.column("text")))
                for a, b in slices(offsets, 4 << 20):
                    grams, n = np.unique(grams_of(raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]), return_counts=True)
                    n = n * (not h)
                    open_[chunk] = merged([open_[chunk][0], grams], [open_[chunk][1], n]) if chunk in open_ else (grams, n)
        for chunk, x in open_.items():
            yield gram_rows(chunk, *x)

    def gram_rows(chunk: int, grams: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict(
            {"gram": pa.array(grams.view(np.int64)), "chunk": pa.array(np.full(len(grams), chunk)), "n": pa.array(n.astype(np.int64))}
        )

    def count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_: dict[int, Counter] = {}
        for batch in batches:
            for chunk, h, part in runs(batch):
                for old in [c for c in open_ if c != chunk]:
                    yield word_rows(old, open_.pop(old))
                words = open_.setdefault(chunk, Counter())
                for text in map(decompress, part.column("text").to_pylist()):
                    # The empty word stands for the end.
                    found = [*text.split(b" "), b""] if text else [b""]
                    if h:
                        words.update(dict.fromkeys(found, 0))
                    else:
                        words.update(found)
        for chunk, x in open_.items():
            yield word_rows(chunk, x)

    def word_rows(chunk: int, words: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict(
            {"word": pa.array(list(words), pa.binary()), "chunk": pa.array([chunk] * len(words), pa.int64()), "n": pa.array(list(words.values()), pa.int64())}
        )

    gram_pairs = stage(dealt.select("held", "chunk", "text").mapInArrow(count_grams, "gram bigint, chunk bigint, n bigint"), "grams")
    word_pairs = stage(dealt.select("held", "chunk", "text").mapInArrow(count_words, "word binary, chunk bigint, n bigint"), "words")
    grams = stage(gram_pairs.groupBy("gram").agg(F.sum("n").alias("n")), "gram-counts")
    by_context = grams.repartition(F.shiftright("gram", int(OPEN))).sortWithinPartitions("gram")
    whole = stage(by_context.mapInArrow(parts, "grams binary, counts binary"), "gram-parts")

    def sum_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in opened(batches):
            numbers, values = part.sums()
            yield pa.RecordBatch.from_pydict({"number": pa.array(numbers.view(np.int64)), "value": pa.array(values)})

    sums = whole.mapInArrow(sum_up, "number bigint, value double").groupBy("number").agg(F.sum("value").alias("value")).toArrow()
    top = spark.sparkContext.broadcast(Top(sums.column("number").to_numpy().astype(np.uint64), sums.column("value").to_numpy()))

    def probabilities(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in opened(batches):
            yield pa.RecordBatch.from_pydict({"gram": pa.array(part.tables[0][0].view(np.int64)), "p": pa.array(part.log10(top.value))})

    gram_p = whole.mapInArrow(probabilities, "gram bigint, p double")
    words = word_pairs.groupBy("word").agg(F.sum("n").alias("c"))
    n_all, v_all = words.agg(F.sum("c"), F.count(F.when(F.col("c") > 0, True))).first()
    n_all, v_all = n_all or 0, v_all or 0
    def pack_grams(part: pa.Table) -> bytes:
        return part.column("gram").to_numpy().tobytes() + part.column("p").to_numpy().astype("<f4").tobytes()

    def pack_words(part: pa.Table) -> bytes:
        return part.column("c").to_numpy().tobytes() + b" ".join(part.column("word").to_pylist())

    asked_grams = packed(gram_pairs.select("gram", "chunk").join(gram_p, "gram").select("chunk", "gram", "p"), pack_grams)
    asked_words = packed(word_pairs.select("word", "chunk").join(words, "word").select("chunk", "word", "c"), pack_words)
    asked = stage(asked_grams, "asked-grams").withColumn("words", F.lit(False)).unionByName(stage(asked_words, "asked-words").withColumn("words", F.lit(True)))

    def score_chunk(texts: pa.Table, model: pa.Table) -> pa.Table:
        base_of: dict[bytes, float] = {}
        known, keys, p = set(), [], []
        for n, blob, is_words in zip(*(model.column(c).to_pylist() for c in ("n", "blob", "words"))):
            if is_words:
                found, c = blob[8 * n :].split(b" "), np.frombuffer(blob[: 8 * n], "<i8")
                known.update(w for w, x in zip(found, c.tolist()) if x)
                base_of.update(zip(found, np.log10((c + 0.5) / (n_all + 0.5 * (v_all + 1))).tolist()))
            else:
                keys.append(np.frombuffer(blob[: 8 * n], "<u8"))
                p.append(np.frombuffer(blob[8 * n :], "<f4").astype(np.float64))
        lookup = Lookup(np.concatenate(keys), np.concatenate(p))
        tokens, seen, base, scores, sizes = [], [], [], [], []
        for batch in texts.combine_chunks().to_batches():
            raw, offsets = byte_columns(unpacked(batch.column("text")))
            for a, b in slices(offsets, LOOKED_UP):
                cut = offsets[a : b + 1] - offsets[a]
                found = lookup.of(grams_of(raw[offsets[a] : offsets[b]], cut))
                scores.append(np.add.reduceat(found, cut[:-1] + np.arange(b - a)))
                sizes.append(np.diff(cut) + 1)
            for text in map(decompress, batch.column("text").to_pylist()):
                found = [*text.split(b" "), b""] if text else [b""]
                tokens.append(len(found))
                seen.append(sum(map(known.__contains__, found)))
                base.append(math.fsum(map(base_of.__getitem__, found)))
        scores, sizes = np.concatenate(scores), np.concatenate(sizes)
        return pa.table(
            {
                "doc_id": texts.column("doc_id"), "held_out": texts.column("held"), "n_tokens": pa.array(tokens, pa.int64()),
                "n_known": pa.array(seen, pa.int64()), "train_tokens": pa.array([n_all] * len(tokens), pa.int64()),
                "base_score": pa.array(base, pa.float64()), "score": pa.array(scores), "bits_per_byte": pa.array(-scores / math.log10(2) / sizes),
            }
        )

    return dealt.groupBy("chunk").cogroup(asked.groupBy("chunk")).applyInArrow(
        score_chunk,
        f"doc_id {id_type}, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double, bits_per_byte double",
    )
