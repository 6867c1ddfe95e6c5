"""Removal of repeated byte strings, by merged Burrows-Wheeler transforms.

A byte is removed if a string of ``length`` bytes that covers it also starts
earlier (a smaller document, or the same one further left). Windows of that
length are brought together by content: each belongs to the smallest hash of its
``GRAM``-byte parts, so equal windows have equal keys wherever they stand.
Consecutive windows with one key are a span. Of spans whose key occurs again, those that are equal as a whole (by
a 128-bit BLAKE2 digest of their bytes) are settled by their first place. The different spans of a key go to one task, many
keys at a time. There they are cut into shards, each shard's suffixes are sorted
to the depth needed, and the transforms of the shards are merged: only the
interleave of the shards is kept and refined, by a stable pass over the symbols
that precede the suffixes, until suffixes are told apart as deep as ``length``. The
passes also show where the common prefix of neighbours ends, so suffixes that
stay together after the last one are the repeated intervals. No suffix is
compared with one of another shard.

The transforms use symbols of ``STEP`` bytes, so each pass refines by that much.
A key with more than ``HOT`` different spans (a common line with changing
surroundings) is settled by grouping its windows by digest instead.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from annalist.llm.common import bounded_batches, byte_columns, slices, stage, trimmed

GRAM = 32
STEP = 10
#: Windows of a span at most, and different spans of a key that one task settles at most.
SPAN, HOT = 400, 8000
#: Bytes hashed at once, symbols merged at once (arrays of either stay in a processor's cache), and shards of a merge.
CHUNK, MERGE, SHARDS = 1 << 17, 1 << 17, 4
BASE = 0x9E3779B97F4A7C15


def digest(part: bytes) -> bytes:
    return blake2b(part, digest_size=16).digest()


class Powers:
    """Prefix hashes of byte arrays, modulo 2^64. They only choose keys: windows with one key need not be equal."""

    def __init__(self, base: int):
        self.base, self.inverse, self.n = base, pow(base, -1, 1 << 64), 0

    def grow(self, n: int) -> None:
        if n <= self.n:
            return
        self.n = n = max(n, CHUNK + (1 << 16))
        for name, base in (("up", self.base), ("down", self.inverse)):
            factors = np.full(n, base, dtype=np.uint64)
            factors[0] = 1
            setattr(self, name, np.multiply.accumulate(factors))

    def prefix(self, raw: np.ndarray) -> np.ndarray:
        self.grow(len(raw) + 1)
        sums = np.zeros(len(raw) + 1, dtype=np.uint64)
        np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * self.up[: len(raw)], out=sums[1:])
        return sums

    def between(self, sums: np.ndarray, start, end) -> np.ndarray:
        return mixed((sums[end] - sums[start]) * self.down[start])


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(29))


def sliding(x: np.ndarray, width: int, pick) -> np.ndarray:
    """Minimum or maximum of each run of ``width`` neighbours."""
    done = 1
    while done < width:
        more = min(done, width - done)
        x = pick(x[: len(x) - more], x[more:])
        done += more
    return x


def spans(raw: np.ndarray, offsets: np.ndarray, length: int, one: Powers):
    """(document, start, windows, key, repeats inside) of all spans of some documents, one after another."""
    width = length - GRAM + 1
    if len(raw) < length:
        return [np.zeros(0, dtype=np.int64)] * 5
    sums, at = one.prefix(raw), np.arange(len(raw) - GRAM + 1)
    grams = one.between(sums, at, at + GRAM)
    key = sliding(grams, width, np.minimum)  # by window start
    # Grams that are the smallest of some window; a span in which one comes twice can repeat itself.
    padded = np.concatenate([np.zeros(width - 1, np.uint64), key, np.zeros(width - 1, np.uint64)])
    least = np.nonzero(sliding(padded, width, np.maximum) == grams)[0]
    twice, step = [], 1
    near = np.arange(len(least))
    while len(near := near[near + step < len(least)]) and len(near := near[least[near + step] - least[near] <= 2 * width]):
        twice.append(grams[least[near[grams[least[near]] == grams[least[near + step]]]]])
        step += 1
    document = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))[: len(key)]
    inside = np.arange(len(key)) + length <= offsets[document + 1]
    new = np.ones(len(key), dtype=bool)
    new[1:] = (key[1:] != key[:-1]) | (document[1:] != document[:-1])
    first = np.nonzero(new)[0]
    run = np.arange(len(key)) - np.repeat(first, np.diff([*first, len(key)]))
    start = np.nonzero((run % SPAN == 0) & inside)[0]
    # A span ends before the next one, and before windows that would leave the document.
    end = np.minimum(np.append(start[1:], len(key)), offsets[document[start] + 1] - length + 1)
    again = np.isin(key[start], np.unique(np.concatenate(twice))) if twice else np.zeros(len(start), bool)
    return document[start], start - offsets[document[start]], end - start, key[start], again


def ranks_of(keys: np.ndarray) -> np.ndarray:
    """Dense ranks."""
    order = np.argsort(keys)
    new = np.ones(len(keys), dtype=np.int64)
    new[0] = 0
    new[1:] = keys[order[1:]] != keys[order[:-1]]
    out = np.empty(len(keys), dtype=np.int64)
    out[order] = np.cumsum(new)
    return out


def block_ranks(text: np.ndarray, step: int) -> np.ndarray:
    """Ranks of the ``step`` symbols (step up to 14) that follow each place, the end joined to the start."""
    ring = np.concatenate([text, text[:step]]).astype(np.uint64)
    ranks = np.zeros(len(text), dtype=np.uint64)
    for at in range(0, step, 7):
        part = np.zeros(len(text), dtype=np.uint64)
        for k in range(at, min(at + 7, step)):
            part = part * np.uint64(257) + ring[k : k + len(text)]
        if at:
            most = 257 ** (min(at + 7, step) - at)
            if (len(text) + 1) * most >= 1 << 64:  # too wide for one number beside a rank
                part, most = ranks_of(part).astype(np.uint64), len(text) + 1
            part += ranks * np.uint64(most)
        ranks = ranks_of(part).astype(np.uint64)
    return ranks.astype(np.int64)


def sorted_suffixes(symbols: np.ndarray, steps: int) -> np.ndarray:
    """Order of a shard's rotations by their first ``steps`` blocks, from the ranks of the blocks at each place."""
    rank, n, done = symbols, int(symbols.max(initial=0)) + 1, 1
    while done < steps:
        more = min(done, steps - done)
        rank, done = rank * n + np.roll(rank, -more * STEP), done + more
        if done < steps:
            rank, n = ranks_of(rank), len(rank) + 1
    return np.argsort(rank, kind="stable")


def stable_order(values: np.ndarray) -> np.ndarray:
    """Stable order of numbers below 2^32, by two counting passes."""
    order = np.argsort((values & 0xFFFF).astype(np.uint16), kind="stable")
    return order[np.argsort((values[order] >> 16).astype(np.uint16), kind="stable")]


def merged_intervals(shards: list[np.ndarray], steps: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of all suffixes of all shards in merged order, and whether each starts a new interval.

    ``shards`` are block ranks that are comparable between shards. Suffixes of one
    interval agree in ``steps`` blocks. Places count through the shards.
    """
    orders = [sorted_suffixes(s, steps) for s in shards]
    bases = np.cumsum([0, *map(len, shards)])
    # The transform: for each suffix, in its shard's order, the block before it.
    before = np.concatenate([s[o - STEP] for s, o in zip(shards, orders)])
    shard_of = np.repeat(np.arange(len(shards), dtype=np.uint8), [len(s) for s in shards])
    interleave = shard_of.copy()
    starts = np.zeros(len(before), dtype=bool)
    starts[0] = True
    for _ in range(steps):
        symbols = np.empty_like(before)
        symbols[np.argsort(interleave, kind="stable")] = before
        order = stable_order(symbols)
        block = np.cumsum(starts)[order]
        symbols, interleave = symbols[order], interleave[order]
        starts[1:] = (symbols[1:] != symbols[:-1]) | (block[1:] != block[:-1])
    places = np.empty(len(before), dtype=np.int64)
    places[np.argsort(interleave, kind="stable")] = np.concatenate([o + b for o, b in zip(orders, bases)])
    return places, starts


def repeated_windows(texts: list[bytes], doc: np.ndarray, start: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(span, offset) of all windows of the spans that start earlier too, in another span or the same."""
    sizes = np.array([len(t) for t in texts])
    total = int(sizes.sum()) + len(texts)
    text = np.zeros(total, dtype=np.uint16)  # 0 ends a span
    begin = np.cumsum(sizes + 1) - sizes - 1
    span = np.repeat(np.arange(len(texts)), sizes + 1)
    offset = np.arange(total) - begin[span]
    text[offset < sizes[span]] = np.frombuffer(b"".join(texts), np.uint8).astype(np.uint16) + 1
    cuts = [0, *begin[np.searchsorted(begin, [total * k // SHARDS for k in range(1, SHARDS)], side="right") - 1].tolist(), total]
    cuts = sorted(set(cuts))
    parts = [text[a:b] for a, b in zip(cuts, cuts[1:])]
    if min(map(len, parts)) < length:
        parts = [text]
    # Ranks of blocks that mean the same in all shards: blocks that run over a shard's end continue at its start.
    ring = np.concatenate([np.concatenate([p, p[:STEP]]) for p in parts])
    ranks = block_ranks(ring, STEP)
    ends = np.cumsum([len(p) + STEP for p in parts])
    shards = [ranks[e - len(p) - STEP : e - STEP] for e, p in zip(ends, parts)]
    places, starts = merged_intervals(shards, length // STEP)
    valid = (offset + length <= sizes[span])[places]
    interval = np.cumsum(starts)[valid]
    places = places[valid]
    many = np.bincount(interval)[interval] > 1
    interval, places = interval[many], places[many]
    order = np.lexsort((start[span[places]] + offset[places], doc[span[places]], interval))
    interval, places = interval[order], places[order]
    later = np.zeros(len(places), dtype=bool)
    later[1:] = interval[1:] == interval[:-1]
    return span[places[later]], offset[places[later]]


def covered(span: np.ndarray, offset: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Spans and byte ranges of runs of windows."""
    order = np.lexsort((offset, span))
    span, offset = span[order], offset[order]
    new = np.ones(len(span), dtype=bool)
    new[1:] = (span[1:] != span[:-1]) | (offset[1:] != offset[:-1] + 1)
    first = np.nonzero(new)[0]
    last = np.append(first, len(span))[1:] - 1
    return span[first], offset[first], offset[last] + length


def runs_of(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """Byte ranges of runs of windows that come sorted by ``ord`` and ``start``; a run may go on in the next batch."""
    names = ("ord", "start", "end")
    last: list[np.ndarray] = [np.zeros(0, np.int64)] * 3
    for batch in batches:
        doc, start = (batch.column(c).to_numpy() for c in ("ord", "start"))
        doc, start, end = (np.concatenate([a, b]) for a, b in zip(last, (doc, start, start + length)))
        if not len(doc):
            continue
        new = np.r_[True, (doc[1:] != doc[:-1]) | (start[1:] > end[:-1])]
        first = np.flatnonzero(new)
        found = [doc[first], start[first], np.maximum.reduceat(end, first)]
        yield pa.RecordBatch.from_pydict({n: pa.array(v[:-1]) for n, v in zip(names, found)})
        last = [v[-1:] for v in found]
    if len(last[0]):
        yield pa.RecordBatch.from_pydict({n: pa.array(v) for n, v in zip(names, last)})


def keyed(docs: DataFrame) -> DataFrame:
    """``ord`` (unique, in the order of ``doc_id``), ``doc_id`` and ``text`` of each row."""
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    doubled = rows.groupBy("doc_id").agg(F.count("*").alias("n")).filter("n > 1 OR doc_id IS NULL").limit(1).count()
    if not doubled:
        return rows.select(F.col("doc_id").cast("bigint").alias("ord"), "doc_id", "text")
    ordered = rows.repartitionByRange("doc_id", "text").sortWithinPartitions("doc_id", "text")
    return stage(ordered.select(F.monotonically_increasing_id().alias("ord"), "doc_id", "text"), "ordered")


def repeats(rows: DataFrame, length: int) -> DataFrame:
    """``ord``, ``start`` and ``end`` of byte ranges to remove; they can overlap."""
    if length % STEP or length < GRAM + STEP:
        raise ValueError(f"the length must be a multiple of {STEP} and above {GRAM}")

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one = Powers(BASE)
        for batch in batches:
            raw, offsets = byte_columns(batch.column("text"))
            ids = batch.column("ord").to_numpy()
            for a, b in slices(offsets, CHUNK):
                doc, start, n, key, again = spans(raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], length, one)
                # Start, windows and whether it can repeat itself, in one number.
                places = pa.array(start * 1024 + n * 2 + again)
                yield pa.RecordBatch.from_pydict({"key": pa.array(key.view(np.int64)), "ord": pa.array(ids[a + doc]), "place": places})

    def contents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ord_, text, wanted in zip(*(batch.column(c) for c in ("ord", "text", "spans"))):
                text, wanted = text.as_py(), wanted.values
                place = wanted.field("place").to_numpy()
                start = place // 1024
                parts = zip(start.tolist(), (start + place // 2 % 512 + length - 1).tolist())
                yield pa.RecordBatch.from_pydict({
                    "key": wanted.field("key"), "content": pa.array([digest(text[a:b]) for a, b in parts], pa.binary()),
                    "ord": pa.array(np.full(len(place), ord_.as_py())), "place": pa.array(place),
                })

    # Narrow, and computed once: all spans are read twice, for the keys that occur again and for their spans.
    found = stage(rows.select("ord", "text").mapInArrow(trimmed(find), "key bigint, ord bigint, place bigint"), "all-spans")
    own = F.max(F.col("place") % 2)
    keys = found.groupBy("key").agg(F.count("*").alias("n"), own.alias("again")).filter("n > 1 OR again = 1").select("key")
    lists = found.join(keys, "key").groupBy("ord").agg(F.collect_list(F.struct("key", "place")).alias("spans"))
    bodies = rows.select("ord", F.col("text").cast("binary").alias("text"))
    shared = stage(bodies.join(lists, "ord").mapInArrow(trimmed(contents), "key bigint, content binary, ord bigint, place bigint"), "spans")
    first = shared.groupBy("key", "content").agg(F.min(F.struct("ord", "place")).alias("first"))
    first = stage(first.select("key", "content", F.col("first.ord").alias("ord"), F.col("first.place").alias("place")), "first-spans")
    start, windows = F.floor(F.col("place") / 1024), F.floor(F.col("place") / 2) % 512
    earlier = first.select("key", "content", F.col("ord").alias("first_ord"), F.col("place").alias("first_place"))
    copies = shared.join(earlier, ["key", "content"]).filter("ord <> first_ord OR place <> first_place")
    copies = copies.select("ord", start.alias("start"), (start + windows + length - 1).alias("end"))

    sizes = first.groupBy("key").agg(F.count("*").alias("n"), own.alias("again")).filter("n > 1 OR again = 1").select("key", "n")
    open_spans = first.join(sizes, "key").groupBy("ord").agg(F.collect_list(F.struct("key", "place", "n")).alias("spans"))

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: dict[str, list] = {c: [] for c in ("key", "n", "ord", "start", "text")}
            for ord_, text, wanted in zip(*(batch.column(c).to_pylist() for c in ("ord", "text", "spans"))):
                for s in wanted:
                    at, many = s["place"] // 1024, s["place"] // 2 % 512
                    for k, v in zip(out, (s["key"], s["n"], ord_, at, text[at : at + many + length - 1])):
                        out[k].append(v)
            yield pa.RecordBatch.from_pydict(
                {k: pa.array(v, pa.binary() if k == "text" else pa.int64()) for k, v in out.items()}
            )

    texts = stage(bodies.join(open_spans, "ord").mapInArrow(trimmed(extract), "key bigint, n bigint, ord bigint, start bigint, text binary"), "span-texts")

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            size += batch.get_total_buffer_size()
            if size >= MERGE:
                # The last key can go on in the next batch.
                table = pa.Table.from_batches(held).combine_chunks()
                keys = table.column("key").to_numpy()
                cut = int(np.searchsorted(keys == keys[-1], True))
                if cut:
                    yield from settle(table.slice(0, cut))
                held = table.slice(cut).to_batches()
                size = 0
        if held:
            yield from settle(pa.Table.from_batches(held))

    def settle(table: pa.Table) -> Iterator[pa.RecordBatch]:
        keys, doc, start = (table.column(c).to_numpy() for c in ("key", "ord", "start"))
        texts_ = table.column("text").to_pylist()
        ends = np.cumsum([len(t) for t in texts_])
        at = 0
        while at < len(keys):
            to = int(np.searchsorted(ends, (ends[at - 1] if at else 0) + MERGE)) + 1
            to = int(np.searchsorted(keys, keys[min(to, len(keys)) - 1], side="right"))
            span, offset = repeated_windows(texts_[at:to], doc[at:to], start[at:to], length)
            span, a, b = covered(span, offset, length)
            span += at
            yield pa.RecordBatch.from_pydict({"ord": pa.array(doc[span]), "start": pa.array(start[span] + a), "end": pa.array(start[span] + b)})
            at = to

    ranges = "ord bigint, start bigint, end bigint"
    grouped = texts.filter(F.col("n") <= HOT).select("key", "ord", "start", "text").repartition("key").sortWithinPartitions("key")
    merged = grouped.mapInArrow(trimmed(merge), ranges)

    def windows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ord_, start, text in zip(*(batch.column(c).to_pylist() for c in ("ord", "start", "text"))):
                at = np.arange(len(text) - length + 1)
                same = pa.array([digest(text[k : k + length]) for k in at.tolist()], pa.binary())
                yield pa.RecordBatch.from_pydict({"content": same, "ord": pa.array(np.full(len(at), ord_)), "start": pa.array(start + at)})

    hot = texts.filter(F.col("n") > HOT).mapInArrow(trimmed(windows_of), "content binary, ord bigint, start bigint")
    firsts = hot.groupBy("content").agg(F.min(F.struct("ord", "start")).alias("first"))
    common = hot.join(firsts, "content").filter(F.struct("ord", "start") != F.col("first")).select("ord", "start")
    common = common.repartition("ord").sortWithinPartitions("ord", "start").mapInArrow(partial(runs_of, length=length), ranges)
    return copies.unionByName(merged).unionByName(common)


def kept_bytes(text: bytes, ranges: list | None) -> tuple[bytes, int, int]:
    """What is left of a text, the bytes removed, and the number of removed runs."""
    parts, at, end, runs, removed = [], 0, -1, 0, 0
    for start, stop in sorted((r["start"], r["end"]) for r in (() if ranges is None else ranges)):
        if start > end:
            parts.append(text[at:start])
            runs += 1
            removed += stop - start
        elif stop > end:
            removed += stop - end
        at = end = max(end, stop)
    return b"".join([*parts, text[at:]]), removed, runs


def remove_repeats(docs: DataFrame, length: int = 100) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept`` (the remaining bytes) of each row.

    Texts count as UTF-8; null is empty. Matches never cross rows. Rows with the same ``doc_id`` are
    different documents in the order of their texts; those without one come first.
    """
    bounded_batches(docs.sparkSession)
    rows = keyed(docs)
    ranges = repeats(rows, length).groupBy("ord").agg(F.collect_list(F.struct("start", "end")).alias("ranges"))
    rows = rows.select("ord", "doc_id", F.col("text").cast("binary").alias("text"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").to_pylist()
            found = [kept_bytes(t, r) for t, r in zip(texts, batch.column("ranges").to_pylist())]
            yield pa.RecordBatch.from_pydict(
                {
                    "doc_id": batch.column("doc_id"), "n_bytes": pa.array(map(len, texts), pa.int64()),
                    "n_removed": pa.array([f[1] for f in found], pa.int64()), "n_spans": pa.array([f[2] for f in found], pa.int64()),
                    "kept": pa.array([f[0] for f in found], pa.binary()),
                }
            )

    id_type = dict(rows.dtypes)["doc_id"]
    return rows.join(ranges, "ord", "left").select("doc_id", "text", "ranges").mapInArrow(
        trimmed(cut), f"doc_id {id_type}, n_bytes bigint, n_removed bigint, n_spans bigint, kept binary"
    )


def without_repeats(docs: DataFrame, length: int = 100) -> DataFrame:
    """``docs`` with the repeated strings cut out of ``text``, and ``n_chars``, if there, counted anew.

    Characters of which only some bytes are left go too; null texts stay null. ``doc_id`` must be unique and not null
    for rows to keep their other columns; otherwise all columns come from a copy that is numbered in its order.
    """
    bounded_batches(docs.sparkSession)
    doubled = docs.groupBy("doc_id").agg(F.count("*").alias("n")).filter("n > 1 OR doc_id IS NULL").limit(1).count()
    own, used = "ord", {c.lower() for c in docs.columns}
    while own in used or f"{own}_ranges" in used:
        own += "_"
    if doubled:
        ordered = docs.repartitionByRange("doc_id", "text").sortWithinPartitions("doc_id", "text")
        docs_, ord_ = stage(ordered.withColumn(own, F.monotonically_increasing_id()), "numbered"), F.col(own)
    else:
        docs_, ord_ = docs.withColumn(own, F.col("doc_id").cast("bigint")), F.col(own)
    rows = docs_.select(ord_.alias("ord"), F.coalesce("text", F.lit("")).alias("text"))
    ranges = repeats(rows, length).groupBy("ord").agg(F.collect_list(F.struct("start", "end")).alias(f"{own}_ranges")).withColumnRenamed("ord", own)

    @F.pandas_udf("string")
    def cut(texts, found):
        import pandas as pd

        return pd.Series([None if t is None else kept_bytes(t.encode(), r)[0].decode(errors="ignore") for t, r in zip(texts, found)], dtype=object)

    names = docs.columns
    joined = docs_.join(ranges, own, "left").withColumn("text", cut.asNondeterministic()("text", f"{own}_ranges"))
    if "n_chars" in names:
        joined = joined.withColumn("n_chars", F.length("text").cast("bigint"))
    return joined.select(*[F.col(f"`{c}`") for c in names])
