"""Multi-line entries from log lines that are spread over many tasks.

A line that looks like an opener starts an entry; the lines after it belong to
it; lines before the first opener of a stream are dropped. Lines arrive as
ordered *runs*: the blocks of a file, or the ranges of a sorted stream. Inside
one run the lines of an entry are adjacent, so a run is assembled where it is
read, without a shuffle, by joining slices of each Arrow batch. Only pieces at
the edges of a batch or run are shuffled and stitched, about one in ten
thousand lines, so a stream or file that holds most of the lines is no problem.

The pieces are written once to the shared folder. They are read three times
(whole entries, edge pieces, run totals), and how a scan is cut into blocks may
change between two readings while the cluster grows, so all readings must come
from the same written table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from annalist.functions.text import OPENER, strip
from annalist.session import stage

_SCHEMA = "stream string, run bigint, entry bigint, part bigint, edge boolean, text string"


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Join adjacent lines (stream, run, line) into pieces of entries.

    ``entry`` counts the openers of a run and is 0 before the first one;
    ``part`` numbers the pieces of one entry. A piece is at the edge when more
    lines of its entry may follow in another batch or run, or came before.
    """
    here, entry, part = None, 0, 0
    for batch in batches:
        n = batch.num_rows
        if n == 0:
            continue
        stream = batch.column(0).cast(pa.string())
        run = batch.column(1)
        line = pc.coalesce(batch.column(2).cast(pa.large_string()), pa.scalar("", pa.large_string()))
        opens = pc.match_substring_regex(line, OPENER).to_numpy(zero_copy_only=False)
        turns = np.ones(n, bool)
        turns[1:] = pc.or_(
            pc.not_equal(stream.slice(1), stream.slice(0, n - 1)),
            pc.not_equal(run.slice(1), run.slice(0, n - 1)),
        ).to_numpy(zero_copy_only=False)
        cuts = np.flatnonzero(opens | turns)
        offsets = pa.array(np.append(cuts, n), pa.int32())
        text = pc.binary_join(
            pa.ListArray.from_arrays(offsets, line), pa.scalar("\n", pa.large_string())
        )

        opened, turned = opens[cuts], turns[cuts]
        edge = ~opened
        edge[-1] = True
        edge[:-1] |= turned[1:]
        first = (stream[0].as_py(), run[0].as_py())
        # Openers seen so far in the run of each piece, counted on from the batch before.
        carried = entry if first == here else 0
        total = np.cumsum(opened)
        run_of_piece = np.cumsum(turned) - 1
        before = total[turned] - opened[turned]
        entries = total - before[run_of_piece]
        entries[run_of_piece == 0] += carried
        parts = np.zeros(len(cuts), np.int64)
        if not opened[0] and first == here:
            parts[0] = part + 1
        here = (stream[n - 1].as_py(), run[n - 1].as_py())
        entry, part = int(entries[-1]), int(parts[-1])
        at = pa.array(cuts)
        yield pa.RecordBatch.from_arrays(
            [
                stream.take(at),
                run.take(at),
                pa.array(entries, pa.int64()),
                pa.array(parts),
                pa.array(edge),
                text.cast(pa.string()),
            ],
            names=["stream", "run", "entry", "part", "edge", "text"],
        )


def _owners(pieces: DataFrame) -> DataFrame:
    """For each run, the last entry opened in an earlier run of its stream.

    One row per run goes through the window, never the text.
    """
    earlier = W.partitionBy("stream").orderBy("run").rowsBetween(W.unboundedPreceding, -1)
    runs = pieces.groupBy("stream", "run").agg(F.max("entry").alias("entry"))
    owner = F.last(F.when(F.col("entry") > 0, F.struct("run", "entry")), ignorenulls=True)
    return runs.select("stream", "run", owner.over(earlier).alias("owner"))


def stitch(pieces: DataFrame) -> DataFrame:
    """Whole entries (stream, run, entry, text) from a staged table of pieces."""
    whole = pieces.filter(~F.col("edge")).select("stream", "run", "entry", "text")
    edges = pieces.filter("edge")
    opened = edges.filter("entry > 0").withColumn("owner", F.struct("run", "entry"))
    leading = edges.filter("entry = 0").join(
        _owners(pieces).filter("owner is not null"), ["stream", "run"]
    )
    stitched = (
        opened.unionByName(leading)
        .groupBy("stream", "owner")
        .agg(F.sort_array(F.collect_list(F.struct("run", "entry", "part", "text"))).alias("parts"))
        .select(
            "stream",
            F.col("owner.run").alias("run"),
            F.col("owner.entry").alias("entry"),
            F.array_join(F.col("parts.text"), "\n").alias("text"),
        )
    )
    return whole.unionByName(stitched)


def _assemble(lines: DataFrame, stripped: bool = True) -> DataFrame:
    pieces = lines.select("stream", "run", "line").mapInArrow(_pieces, _SCHEMA)
    entries = stitch(stage(pieces, "pieces", partition_by=("edge",)))
    return entries.withColumn("text", strip(F.col("text"))) if stripped else entries


def assemble_files(lines: DataFrame) -> DataFrame:
    """Entries of log files read with ``sources.logs.read_log_lines``.

    Result: stream (the file), run (block start), entry (number in the block),
    text. (stream, run, entry) orders the entries of a file.
    """
    return _assemble(
        lines.select(
            F.col("file").alias("stream"), F.col("block").alias("run"), F.col("line")
        )
    )


def assemble_streams(
    lines: DataFrame, stream: str | Column, order: list[str | Column], line: str | Column,
    stripped: bool = True,
) -> DataFrame:
    """Entries of many streams whose lines are ordered by ``order`` within a stream.

    One range shuffle on (stream, order) sorts the lines; a stream of any size
    is cut into ranges, so no task has to hold a whole stream. ``stripped`` is
    turned off where an entry may still grow.
    """
    keyed = lines.select(
        (F.col(stream) if isinstance(stream, str) else stream).cast("string").alias("stream"),
        *[(F.col(o) if isinstance(o, str) else o).alias(f"o{i}") for i, o in enumerate(order)],
        (F.col(line) if isinstance(line, str) else line).alias("line"),
    )
    keys = ["stream", *[f"o{i}" for i in range(len(order))]]
    ranged = keyed.repartitionByRange(*keys).sortWithinPartitions(*keys)
    return _assemble(ranged.withColumn("run", F.spark_partition_id().cast("bigint")), stripped)
