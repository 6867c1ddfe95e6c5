"""Continuous ingestion of label streams with Structured Streaming.

Each micro-batch is assembled like a table, so a stream with a third of all
lines is split over tasks instead of living in one stateful key. What a
stateful operator would hold per stream, the entry that is still open when the
batch ends, is kept as one row per stream in a versioned table and put in
front of the stream's next lines. An entry cut by a batch border therefore
comes out whole, whatever the cut.

The last entry of a stream that has gone quiet comes out by a timer: a second
source ticks, so batches run while no line comes, and the newest tick of a batch is
its clock. Ticks are part of the batch like lines, so a batch that is repeated after a failure
sees the same time and lets out the same entries.
"""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from annalist.functions.text import strip
from annalist.operators.assemble import assemble_streams
from annalist.operators.entries import PLACE
from annalist.plans.ingest import Ingest
from annalist.session import scratch_scope, stage
from annalist.sources.logs import RESPONSE_SCHEMA, stream_values
from annalist.sources.tables import VersionedTable

# Lines of one batch before any other: the carried text of a stream sorts first.
_CARRIED = -(2**62)


def read_responses_stream(spark: SparkSession, path: str, files_per_batch: int = 100) -> DataFrame:
    """Saved stream responses as they arrive in a folder."""
    responses = (
        spark.readStream.schema(RESPONSE_SCHEMA).option("maxFilesPerTrigger", files_per_batch).json(path)
    )
    return stream_values(responses)


def read_ticks(spark: SparkSession, per_second: int = 1) -> DataFrame:
    """The time, as it passes: ``tick`` timestamps that keep batches running."""
    return spark.readStream.format("rate").option("rowsPerSecond", per_second).load().select(F.col("timestamp").alias("tick"))


def stream_name(labels: Column) -> Column:
    """One text per label set, the same whatever the order of the labels."""
    return F.to_json(F.array_sort(F.map_entries(labels)))


class EntryAssembler:
    """Assembles the entries of consecutive batches of lines.

    Lines have stream, ns, position and msg. ``assemble`` returns the entries
    that are complete; the last entry of each stream stays open until the
    stream's next opener arrives, the stream was quiet for ``quiet``, or ``flush`` is called.
    """

    def __init__(self, spark: SparkSession, path: str, name: str = "assembler", quiet: timedelta | None = None):
        self.spark, self.name, self.quiet = spark, name, quiet
        # Per stream the text of its open entry (null: none) and the clock of the batch that last brought a line.
        self.open_entries = VersionedTable(spark, path, keys=("stream",), buckets=8)

    def assemble(self, lines: DataFrame, batch_id: int, clock: datetime | None = None) -> DataFrame:
        """Complete entries (stream, run, entry, text) of a batch; safe to repeat.

        ``clock`` is the time of the batch. An open entry whose stream has no line in this batch comes out if the last one came at
        least ``quiet`` before; a line that continues it later starts no entry. Without a clock nothing times out, and a quiet time starts to
        count with the next clock.
        """
        carried = self._before(batch_id)
        # The batch is read twice below, and may end in a stateful operator.
        lines = stage(
            lines.select("stream", "ns", F.col("position").cast("bigint").alias("position"), "msg"), "lines"
        )
        now, left = F.lit(clock).cast("timestamp"), None
        if carried is not None:
            active = lines.select("stream").distinct()
            left = carried.join(active, "stream", "left_anti")
            lines = lines.unionByName(
                carried.join(active, "stream", "left_semi").select(
                    "stream",
                    F.lit(_CARRIED).alias("ns"),
                    F.lit(0).cast("bigint").alias("position"),
                    F.col("text").alias("msg"),
                )
            )
        entries = assemble_streams(lines, "stream", ["ns", "position"], "msg", stripped=False)
        # One row per stream, combined on the map side. The joins are on the whole
        # place of an entry, so a stream with most of the entries is no hot key.
        last = entries.groupBy("stream").agg(F.max(F.struct("run", "entry")).alias("at")).select("stream", "at.*")
        state = entries.join(last, PLACE, "left_semi").select("stream", "text", now.alias("since"))
        out = entries.join(last, PLACE, "left_anti")
        if left is not None and clock is not None and self.quiet is not None:
            expired = F.coalesce(F.col("since") <= F.lit(clock - self.quiet).cast("timestamp"), F.lit(False))
            out = out.unionByName(_alone(left.filter(expired)))
            # Closed ones keep a row without a text; ones from before the first clock start to count.
            closed = left.filter(expired).select("stream", F.lit(None).cast("string").alias("text"), F.lit(None).cast("timestamp").alias("since"))
            started = left.filter("since IS NULL").select("stream", "text", now.alias("since"))
            state = state.unionByName(closed).unionByName(started)
        self.open_entries.merge(state, batch=(self.name, batch_id))
        # A repeated batch needs the version before its own; older ones are dropped.
        self.open_entries.expire(keep=5)
        return out.withColumn("text", strip(F.col("text")))

    def _before(self, batch_id: int) -> DataFrame | None:
        """Open entries as they were before this batch, also when it is being repeated."""
        for version in reversed(self.open_entries.versions()):
            if self.open_entries.manifest(version).batches.get(self.name, -1) < batch_id:
                return self.open_entries.df(version).drop("bucket").filter("text IS NOT NULL")
        return None

    def clear(self) -> None:
        """Forget the open entries; the batches seen stay known."""
        rows = self.open_entries.df()
        if rows is not None:
            self.open_entries.overwrite(rows.drop("bucket").limit(0))

    def flush(self) -> DataFrame | None:
        """The entries that are still open, for the end of a stream."""
        df = self.open_entries.rows()
        return None if df is None else _alone(df.filter("text IS NOT NULL")).withColumn("text", strip(F.col("text")))


def _alone(rows: DataFrame) -> DataFrame:
    """Open entries as the only ones of their streams."""
    zero = F.lit(0).cast("bigint")
    return rows.select("stream", zero.alias("run"), zero.alias("entry"), "text")


def start_ingest(
    lines: DataFrame, ingest: Ingest, state_path: str, checkpoint: str, dedup: str | None = None,
    name: str = "ingest", quiet: timedelta | None = None, ticks: DataFrame | None = None, keep_versions: int | None = None, **trigger,
) -> StreamingQuery:
    """Run the whole ingestion continuously over lines (labels, ns, ts, position, msg).

    With ``quiet`` the open entry of a stream is ingested once no line came for that time by the clock of
    ``ticks`` (a stream of ``tick`` timestamps; ``read_ticks`` by default). ``keep_versions`` keeps the newest so many
    versions of each table; older ones go after each batch, so choose it larger than the batches that a reader may lag behind.

    Every line is used, and every table ignores a batch it already has. Set
    ``dedup`` to a time span when the source polls overlapping windows: lines
    seen before within that span are dropped, but so are lines that come later
    than the span behind the newest one, so choose it longer than any delay.
    """
    keyed = lines.withColumn("stream", stream_name(F.col("labels")))
    if dedup:
        keyed = keyed.withWatermark("ts", dedup).dropDuplicatesWithinWatermark(["stream", "ns", "msg"])
    keyed = keyed.select("stream", "ns", "position", "msg")
    if quiet is not None:
        ticks = read_ticks(ingest.spark) if ticks is None else ticks
        keyed = keyed.unionByName(ticks.select("tick"), allowMissingColumns=True)
    assembler = EntryAssembler(ingest.spark, state_path, name, quiet)

    def one_batch(batch: DataFrame, batch_id: int) -> None:
        clock = None
        if quiet is not None:
            clock = batch.agg(F.max("tick")).first()[0]
            batch = batch.filter("tick IS NULL")
        with scratch_scope(ingest.spark):  # what the batch staged goes once its tables are committed
            ingest.entries(assembler.assemble(batch, batch_id, clock), batch=(name, batch_id))
        if keep_versions:
            ingest.expire(keep_versions)

    return (
        keyed.writeStream.foreachBatch(one_batch)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def finish_ingest(ingest: Ingest, state_path: str, name: str = "ingest") -> None:
    """Ingest the entries that are open, at the end of a stream.

    They are then open no more, so a second call finds nothing, and a line that
    still comes for one of them starts no entry. Safe to repeat if it was interrupted: the batch
    is numbered by the state it flushes.
    """
    assembler = EntryAssembler(ingest.spark, state_path, name)
    left = assembler.flush()
    if left is not None:
        ingest.entries(left, batch=(f"{name}-flush", assembler.open_entries.versions()[-1]))
        assembler.clear()
