"""Prefix trie of conversations.

Conversations that begin with the same turns share the nodes of a trie, one
node for each distinct sequence of first turns. A conversation becomes a row of
turn ids (the first 128 bits of a SHA-256 digest of role and text), so texts are
never shuffled. The rows are dealt into ranges of the trie's order; a range
is a padded matrix of ids, sorted by ``numpy.lexsort``. Where a column
differs from the row above, a node starts there and in all later columns (an
accumulated or), and ``reduceat`` sums each depth over its nodes. What hangs
below a node is counted by its conversations alone: each row adds the bytes that it
shares with the row above, and a one if nothing continues it. So all sums of a node add
up over ranges, and only nodes that reach over the edge of a range are combined afterwards.

No step holds a conversation, a node or a group of copies as a whole. A conversation is
numbered by ranges and cut into segments of ``SEGMENT`` turns, each sorted under the
digest of all turns before it; copies are dealt by conversation id. The ids that end at one node
are hashed from chunks in order, as a stream.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from annalist.llm.common import bounded_batches, byte_columns, stage

#: Turns of a segment, rows of a range (about), and segments or turns that one running sum goes over.
SEGMENT, RANGE_ROWS, SPAN = 64, 50_000, 4096
#: Bytes of a turn id.
WIDE = 16
#: What rows without a difference share.
EQUAL = 1 << 30
NO_IDS = hashlib.sha256(b"").hexdigest()


def _short(text: Column) -> Column:
    return F.unhex(F.substring(F.sha2(text, 256), 1, 2 * WIDE))


def numbered(turns: DataFrame) -> DataFrame:
    """``conv_id, pos, turn_id, bytes``: the turns of each conversation from 0, by ``turn`` (null first).

    Null roles and texts are empty. Turns of one conversation with the same ``turn`` are ordered by their ids, so
    repeated rows are turns of their own. Rows without a ``conv_id`` are in no conversation and are left out.
    """
    bounded_batches(turns.sparkSession)
    role, text = F.coalesce(F.col("role").cast("string"), F.lit("")), F.coalesce(F.col("text").cast("string"), F.lit(""))
    named = turns.filter("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("bigint").alias("conv_id"), "turn",
        _short(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)).alias("turn_id"),
        F.octet_length(text).cast("bigint").alias("bytes"),
    )
    order = ["conv_id", F.col("turn").asc_nulls_first(), "turn_id"]
    dealt = named.repartitionByRange(*order).sortWithinPartitions(*order)
    placed = stage(dealt.select("conv_id", "turn_id", "bytes", F.monotonically_increasing_id().alias("at"), F.spark_partition_id().alias("part")), "turns")
    # Where a part's rows of a conversation start, and how many of them lie in earlier parts.
    heads = placed.groupBy("conv_id", "part").agg(F.min("at").alias("first"), F.count("*").alias("n"))
    earlier = F.sum("n").over(Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    shift = heads.select("conv_id", "part", (F.coalesce(earlier, F.lit(0)) - F.col("first")).alias("shift"))
    found = placed.join(shift, ["conv_id", "part"]).select("conv_id", (F.col("at") + F.col("shift")).alias("pos"), "turn_id", "bytes")
    return stage(found, "numbered")


def branched(placed: DataFrame, family: int, shared: Column, most: int) -> DataFrame:
    """Conversations that start alike: the first turns of each are those of the first of its family.

    Each ``conv_id`` takes the first ``shared`` (a column of ``conv_id``, ``most`` at most) turns of ``conv_id - conv_id % family``
    (all if it has fewer, none if it does not exist), then its own turns after its first ``shared``. A row with ``pos`` -1
    stands for each conversation, so that one without turns stays.
    """
    block = F.floor(F.col("pos") / SPAN).alias("block")
    blocks = placed.groupBy("conv_id", block).agg(F.count("*").alias("n"))
    convs = blocks.groupBy("conv_id").agg(F.sum("n").alias("n"))
    base = convs.filter(F.col("conv_id") % family == 0).select(F.col("conv_id").alias("base"), F.col("n").alias("base_n"))
    rule = convs.select("conv_id", (F.col("conv_id") - F.col("conv_id") % family).alias("base"), shared.cast("bigint").alias("h"))
    rule = rule.join(base, "base", "left").withColumn("start", F.least("h", F.coalesce("base_n", F.lit(0))))
    rule = stage(rule.select("conv_id", "base", "h", "start"), "families")
    dealt = blocks.select("conv_id", "block").join(rule, "conv_id").select("conv_id", "block", "h", "start")
    own = placed.withColumn("block", block).join(dealt, ["conv_id", "block"]).filter("pos >= h")
    own = own.select("conv_id", (F.col("pos") - F.col("h") + F.col("start")).alias("pos"), "turn_id", "bytes")
    first = placed.filter((F.col("conv_id") % family == 0) & (F.col("pos") < most)).withColumnRenamed("conv_id", "base")
    taken = rule.join(first, "base").filter("pos < h").select("conv_id", "pos", "turn_id", "bytes")
    marks = rule.select("conv_id", F.lit(-1).cast("bigint").alias("pos"), F.lit(None).cast("binary").alias("turn_id"), F.lit(0).cast("bigint").alias("bytes"))
    return own.unionByName(taken).unionByName(marks)


def running(rows: DataFrame, values: list[str], falling: bool = False) -> DataFrame:
    """``rows`` with each of ``values`` replaced by its sum over the rows of the same ``conv_id`` with a smaller ``seg`` (or larger: ``falling``).

    The sums go over blocks first, so that a conversation of any length is dealt to many tasks.
    """
    by = (lambda c: F.col(c).desc()) if falling else F.col
    cut = rows.withColumn("block", F.floor(F.col("seg") / SPAN))
    over = lambda part, order: Window.partitionBy(*part).orderBy(by(order)).rowsBetween(Window.unboundedPreceding, -1)
    sums = cut.groupBy("conv_id", "block").agg(*[F.sum(v).alias(v) for v in values])
    zero = lambda v: F.coalesce(v, F.lit(0))
    carried = sums.select("conv_id", "block", *[zero(F.sum(v).over(over(["conv_id"], "block"))).alias(f"carried_{v}") for v in values])
    inner = cut.withColumns({v: zero(F.sum(v).over(over(["conv_id", "block"], "seg"))) for v in values})
    both = inner.join(carried, ["conv_id", "block"])
    return both.select(*[(F.col(v) + F.col(f"carried_{v}")).alias(v) if v in values else F.col(v) for v in rows.columns])


def segments(sequences: DataFrame, segment: int) -> DataFrame:
    """One row per conversation and segment: ids, sizes, whether turns follow, and digests of all turns before and up to its end."""
    held = F.when(F.col("pos") >= 0, F.struct("pos", F.hex("turn_id").alias("id"), "bytes"))
    seg = F.floor(F.greatest("pos", F.lit(0)) / segment).alias("seg")
    rows = sequences.groupBy("conv_id", seg).agg(F.sort_array(F.collect_list(held)).alias("turns"))
    rows = rows.select("conv_id", "seg", F.unhex(F.array_join(F.transform("turns", lambda t: t["id"]), "")).alias("ids"), F.transform("turns", lambda t: t["bytes"]).alias("sizes"))
    rows = stage(rows, "segments")
    full = F.size("sizes") == segment
    # The turns before a segment are named by the sums of digests of the segments before it, four numbers of 60 bits.
    digest = F.sha2(F.concat(F.encode(F.col("seg").cast("string"), "utf-8"), "ids"), 256)
    parts = [F.conv(F.substring(digest, 15 * k + 1, 15), 16, 10).cast("decimal(38,0)").alias(f"d{k}") for k in range(4)]
    long = rows.filter(full | (F.col("seg") > 0)).select("conv_id", "seg", *parts)
    before = running(long, [f"d{k}" for k in range(4)]).withColumnsRenamed({f"d{k}": f"b{k}" for k in range(4)})
    name = lambda cols: _short(F.concat_ws(":", *[c.cast("string") for c in cols]))
    named = before.join(long, ["conv_id", "seg"]).select(
        "conv_id", "seg", name([F.col(f"b{k}") for k in range(4)]).alias("prefix"), name([F.col(f"b{k}") + F.col(f"d{k}") for k in range(4)]).alias("next")
    )
    follows = rows.filter("seg > 0").select("conv_id", (F.col("seg") - 1).alias("seg"), F.lit(True).alias("more"))
    named = named.join(follows, ["conv_id", "seg"], "left")
    short = rows.filter(~full & (F.col("seg") == 0)).select("*", F.lit(None).cast("binary").alias("prefix"), F.lit(None).cast("binary").alias("next"), F.lit(False).alias("more"))
    cut = rows.filter(full | (F.col("seg") > 0)).join(named, ["conv_id", "seg"])
    cut = cut.select(*rows.columns, F.when(F.col("seg") > 0, F.col("prefix")).alias("prefix"), F.when(full, F.col("next")).alias("next"), F.coalesce("more", F.lit(False)).alias("more"))
    found = short.unionByName(cut).withColumn("prefix", F.coalesce("prefix", F.lit(b"")))
    return found.withColumn("key", F.when(F.col("more"), F.concat("ids", F.lit(b"\x01"))).otherwise(F.col("ids"))).drop("ids")


def common_turns(a: dict | None, b: dict | None) -> int:
    """Columns in which two rows agree: -1 under different nodes, ``EQUAL`` if they are equal."""
    if not a or not b or (a["seg"], a["prefix"]) != (b["seg"], b["prefix"]):
        return -1
    x, y = a["key"], b["key"]
    if x == y:
        return EQUAL
    k = 0
    while x[k : k + WIDE] == y[k : k + WIDE] and len(x) >= k + WIDE:
        k += WIDE
    return k // WIDE


class Range:
    """The sorted matrix of a range, and how many columns each row shares with the row above."""

    def __init__(self, rows: pa.Table, edge: dict):
        n = rows.num_rows
        whole = rows.combine_chunks()
        column = lambda c: whole.column(c).chunk(0) if n else pa.array([], whole.schema.field(c).type)
        conv, more = column("conv_id").to_numpy(), np.asarray(column("more").to_numpy(zero_copy_only=False), dtype=bool)
        seg = column("seg").to_numpy()
        raw, at = byte_columns(column("key"))
        length = np.diff(at) // WIDE
        keep = np.ones(len(raw), dtype=bool)
        keep[at[1:][more] - 1] = False
        halves = raw[keep].reshape(-1, WIDE).copy().view(">u8").astype(np.uint64)
        order = np.lexsort((halves[:, 1], halves[:, 0]))
        ranked = halves[order]
        new = np.r_[False, (ranked[1:] != ranked[:-1]).any(axis=1)] if len(ranked) else np.zeros(0, bool)
        ids = np.empty(len(order), dtype=np.int32)
        ids[order] = np.cumsum(new)
        under = list(zip(seg.tolist(), column("prefix").to_pylist()))
        groups = {g: k for k, g in enumerate(sorted(set(under)))}
        width = int(length.max(initial=0))
        row = np.repeat(np.arange(n), length)
        col = np.arange(len(ids)) - np.repeat(np.cumsum(length) - length, length)
        matrix = np.full((n, width + 2), -1, dtype=np.int32)  # node above, padded turn ids, whether turns follow
        matrix[:, 0] = [groups[g] for g in under]
        matrix[row, col + 1] = ids
        matrix[more, -1] = 1
        summed = np.zeros((n, width + 1), dtype=np.int64)
        summed[row, col + 1] = column("sizes").flatten().to_numpy()
        self.order = np.lexsort((conv, *matrix.T[::-1]))
        o = self.order
        matrix, self.conv, self.seg, self.more, self.length = matrix[o], conv[o], seg[o], more[o], length[o]
        self.under, self.whole, self.width = [under[k] for k in o], whole, width
        self.summed = np.cumsum(summed[o], axis=1)
        #: Whether a node of each depth starts at a row.
        self.starts = np.logical_or.accumulate(matrix[1:] != matrix[:-1], axis=1) if n else np.zeros((0, width + 2), bool)
        same = (~self.starts).sum(axis=1) - 1
        same[same == width + 1] = EQUAL
        self.starts = np.vstack([np.ones((min(n, 1), width + 2), bool), self.starts])
        #: Columns that agree with the row above (the last row of the range before, for the first).
        self.same = np.r_[common_turns(edge["before"], edge["first"]), same] if n else same
        self.after = common_turns(edge["last"], edge["behind"])
        below = np.r_[self.same[1:], self.after]
        self.leaf = ~self.more & (below < self.length)
        self.shared = self.summed[np.arange(n), np.minimum(np.maximum(self.same, 0), self.length)] if n else np.zeros(0, np.int64)

    def ids_of(self, row: int, depth: int) -> bytes:
        return self.whole.column("key")[int(self.order[row])].as_py()[: depth * WIDE]

    def next_of(self, row: int) -> bytes:
        return self.whole.column("next")[int(self.order[row])].as_py()


def _edge(rows: pa.Table) -> dict:
    edges = rows.filter(pc.is_valid(rows.column("first")))
    return {c: edges.column(c)[0].as_py() for c in ("before", "first", "last", "behind")}


def _long_rows(rows: pa.Table, edges: pa.Table) -> pa.Table:
    """Of conversations with several segments: bytes each segment shares with the row above, and whether it ends as a leaf."""
    found = Range(rows, _edge(edges))
    long = found.more | (found.seg > 0)
    shard = np.full(int(long.sum()), rows.column("shard")[0].as_py() if rows.num_rows else 0)
    return pa.table({
        "conv_id": found.conv[long], "seg": found.seg[long].astype(np.int64), "shard": pa.array(shard, pa.int32()),
        "bytes": found.shared[long], "leaves": found.leaf[long].astype(np.int64),
    })


NODE = "depth bigint, conv_id bigint, n_convs bigint, n_children bigint, n_leaves bigint, saved_tokens bigint, ends_sha256 string, parent_conv_id bigint, parent_ref bigint"
PART = f"kind int, {NODE}, ref bigint, node binary, first bigint, ids string"


def _nodes(rows: pa.Table, edges: pa.Table, segment: int) -> pa.Table:
    """The nodes of a range. Kind 0: complete; 1: the range's share of a node that reaches further; 2: a chunk of ids that end at one."""
    r = Range(rows, _edge(edges))
    n = len(r.conv)
    later, later_leaves = np.zeros(n, np.int64), r.leaf.astype(np.int64)
    below = edges.filter(pc.is_null(edges.column("first")))
    if below.num_rows:
        at = {k: i for i, k in enumerate(zip(r.conv.tolist(), r.seg.tolist()))}
        for c, s, b, leaves in zip(*(below.column(x).to_pylist() for x in ("conv_id", "seg", "bytes", "leaves"))):
            later[at[c, s]] += b
            later_leaves[at[c, s]] += leaves
    shard = rows.column("shard")[0].as_py() if n else 0
    changes = np.flatnonzero(np.r_[True, r.same[1:] < EQUAL]) if n else np.zeros(0, np.int64)
    run_end = np.zeros(n, np.int64)
    run_end[changes] = np.r_[changes[1:], n] if n else changes
    out: dict[str, list] = {f.split()[0]: [] for f in PART.split(", ")}
    refs = 0
    above_starts = above_conv = above_ref = None
    for d in range(r.width + 1):
        starts = np.flatnonzero(r.starts[:, d])
        ends = np.r_[starts[1:], n]
        least = np.minimum.reduceat(r.conv, starts)
        saved = np.maximum(r.shared - r.summed[:, max(d - 1, 0)], 0) + later
        sums = [ends - starts, *(np.add.reduceat(v, starts) for v in (((r.same <= d) & (r.length > d)).astype(np.int64), later_leaves, saved))]
        live = np.flatnonzero(r.length[starts] >= d)
        deep = r.seg[starts] > 0
        partial = np.zeros(len(starts), dtype=bool)
        partial[0] |= d <= r.same[0]
        partial[-1] |= d <= r.after
        if d == 0:
            partial |= deep
        if d == segment:
            partial |= np.logical_or.reduceat(r.more, starts)
        ref = np.where(partial, shard * 2**40 + refs + np.arange(len(starts)), -1)
        refs += len(starts)
        depth = r.seg[starts].astype(np.int64) * segment + d
        if d:
            up = np.searchsorted(above_starts, starts, side="right") - 1
            parent_ref, parent_conv = above_ref[up], above_conv[up]
        for k in live.tolist():
            s = int(starts[k])
            is_end = r.length[s] == d and not r.more[s]
            ids = ",".join(map(str, r.conv[s : run_end[s]].tolist())) if is_end else ""
            node = None
            top = d == 0 and deep[k]  # the node itself is counted in the segment before
            if partial[k]:
                prefix = r.under[s][1]
                node = prefix if d == 0 else r.next_of(s) if d == segment else hashlib.sha256(prefix + b"|" + r.ids_of(s, d)).digest()[:WIDE]
                if ids:
                    out["kind"].append(2)
                    for c, v in (("depth", int(depth[k])), ("node", node), ("first", int(r.conv[s])), ("ids", ids)):
                        out[c].append(v)
                    for c in out.keys() - {"kind", "depth", "node", "first", "ids"}:
                        out[c].append(None)
            linked = d > 0 and parent_ref[k] >= 0
            values = {
                "kind": int(partial[k]), "depth": int(depth[k]), "conv_id": None if top else int(least[k]), "n_convs": 0 if top else int(sums[0][k]),
                "n_children": int(sums[1][k]), "n_leaves": 0 if top else int(sums[2][k]), "saved_tokens": 0 if top else int(sums[3][k]),
                "ends_sha256": None if partial[k] else hashlib.sha256(ids.encode()).hexdigest() if ids else NO_IDS,
                "parent_conv_id": int(parent_conv[k]) if d and not linked else None, "parent_ref": int(parent_ref[k]) if linked else None,
                "ref": int(ref[k]) if partial[k] else None, "node": node, "first": None, "ids": None,
            }
            for c, v in values.items():
                out[c].append(v)
        above_starts, above_conv, above_ref = starts, least, ref
    long, types = pa.int64(), {"kind": pa.int32(), "ends_sha256": pa.string(), "node": pa.binary(), "ids": pa.string()}
    return pa.table({c: pa.array(v, types.get(c, long)) for c, v in out.items()})


def _hash_ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One digest per node from its chunks of ids, which come sorted."""
    key, state = None, None
    table = lambda: pa.RecordBatch.from_pydict({"depth": [key[0]], "node": pa.array([key[1]], pa.binary()), "ends_sha256": [state.hexdigest()]})
    for batch in batches:
        for depth, node, ids in zip(*(batch.column(c).to_pylist() for c in ("depth", "node", "ids"))):
            if (depth, node) != key:
                if key:
                    yield table()
                key, state = (depth, node), hashlib.sha256(ids.encode())
            else:
                state.update(b"," + ids.encode())
    if key:
        yield table()


def prefix_trie(sequences: DataFrame, segment: int = SEGMENT, range_rows: int = RANGE_ROWS) -> DataFrame:
    """The nodes of the trie of ``sequences`` (``conv_id, pos, turn_id, bytes`` as ``numbered`` gives; ``pos`` -1: no turn).

    One row per node: its smallest member ``conv_id`` and its ``depth`` (together they name a node, and the turn at ``depth`` of that
    conversation is its text), the parent's ``conv_id``, members, children, leaves of the subtree, the bytes saved if each node's text were
    stored once (over the subtree), and the digest of the ids of conversations that end there. Long texts only count by their bytes,
    long conversations are cut into segments. No conversations: no nodes.
    """
    spark = sequences.sparkSession
    bounded_batches(spark)
    rows = stage(segments(sequences, segment), "rows")
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(rows.count() / range_rows))
    order = ["seg", "prefix", "key", "conv_id"]
    sharded = stage(rows.repartitionByRange(n, *order).withColumn("shard", F.spark_partition_id()), "ranges")
    place = F.struct("seg", "prefix", "key")
    edges = sharded.groupBy("shard").agg(F.min(place).alias("first"), F.max(place).alias("last"), F.max(F.col("more") | (F.col("seg") > 0)).alias("long"))
    along = Window.orderBy("shard")  # one row per range
    edges = stage(edges.withColumns({"before": F.lag("last").over(along), "behind": F.lead("first").over(along)}), "edges")
    with_long = sharded.join(F.broadcast(edges.filter("long").select("shard")), "shard")  # one row per range
    found = with_long.groupBy("shard").cogroup(edges.filter("long").groupBy("shard")).applyInArrow(_long_rows, "conv_id bigint, seg bigint, shard int, bytes bigint, leaves bigint")
    later = running(stage(found, "long"), ["bytes", "leaves"], falling=True)
    side = edges.drop("long").unionByName(later, allowMissingColumns=True)
    parts = stage(sharded.groupBy("shard").cogroup(side.groupBy("shard")).applyInArrow(lambda left, right: _nodes(left, right, segment), PART), "nodes")
    names = [f.split()[0] for f in NODE.split(", ")]
    sums = [F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")]
    shares = parts.filter("kind = 1")
    chunks = parts.filter("kind = 2").select("depth", "node", "first", "ids").repartition("depth", "node").sortWithinPartitions("depth", "node", "first")
    hashed = chunks.mapInArrow(_hash_ids, "depth bigint, node binary, ends_sha256 string")
    whole = shares.groupBy("depth", "node").agg(F.min("conv_id").alias("conv_id"), *sums, F.max("parent_conv_id").alias("parent_conv_id"), F.max("parent_ref").alias("parent_ref"))
    whole = stage(whole.join(hashed, ["depth", "node"], "left").fillna(NO_IDS, "ends_sha256"), "whole")
    refs = shares.select("ref", "depth", "node").join(whole.select("depth", "node", F.col("conv_id").alias("up")), ["depth", "node"]).select(F.col("ref").alias("parent_ref"), "up")
    both = parts.filter("kind = 0").select(*names).unionByName(whole.select(*names))
    known = both.filter("parent_ref IS NULL")
    linked = both.filter("parent_ref IS NOT NULL").join(refs, "parent_ref").withColumn("parent_conv_id", F.col("up"))
    names.remove("parent_ref")
    return known.select(*names).unionByName(linked.select(*names))


def with_texts(nodes: DataFrame, placed: DataFrame, turns: DataFrame) -> DataFrame:
    """``nodes`` with the ``turn_id`` of each node's last turn, from the sequences that the trie was made of, and its ``role`` and ``text``."""
    at = placed.filter("pos >= 0").select("conv_id", (F.col("pos") + 1).alias("depth"), "turn_id")
    role, text = F.coalesce(F.col("role").cast("string"), F.lit("")), F.coalesce(F.col("text").cast("string"), F.lit(""))
    named = turns.select(_short(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)).alias("turn_id"), role.alias("role"), text.alias("text"))
    return nodes.join(at, ["conv_id", "depth"], "left").join(named.dropDuplicates(["turn_id"]), "turn_id", "left")
