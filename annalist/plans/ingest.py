"""Ingestion: log entries to typed tables, text tables and a dead-letter table."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from annalist.functions.vectors import Embedder, HashingEmbedder, with_vectors
from annalist.operators.assemble import assemble_files, assemble_streams
from annalist.operators.entries import (
    PLACE, Routed, by_kind, check_all_good, first_entries, parse_entries, records_of, routed_rows,
)
from annalist.session import stage
from annalist.sources.logs import read_log_lines
from annalist.sources.tables import VersionedTable
from annalist.specs import Registry

TEXT_TABLE = "process_text"


class Ingest:
    """Routes parsed entries into the tables under ``root``.

    One merge per type and batch, one upsert for all texts: those are stored in
    one table partitioned by the function that logged them and by key. A batch number
    makes a repeated batch a no-op, table by table.
    """

    def __init__(
        self, spark: SparkSession, root: str, registry: Registry,
        embedder: Callable[[], Embedder] = HashingEmbedder, fail_fast: bool = False, buckets: int = 16,
    ):
        self.spark, self.root, self.registry = spark, root.rstrip("/"), registry
        self.embedder, self.fail_fast, self.buckets = embedder, fail_fast, buckets

    def table_of(self, spec) -> VersionedTable:
        return VersionedTable(
            self.spark, f"{self.root}/columnar/v0/{spec.namespace}/{spec.name}", spec.keys, buckets=self.buckets
        )

    def text_table(self) -> VersionedTable:
        return VersionedTable(
            self.spark, f"{self.root}/vector/v0/default/{TEXT_TABLE}", ("id",),
            partition_by=("module_name", "bucket"), buckets=self.buckets,
        )

    def expire(self, keep: int) -> None:
        """Drop all but the newest ``keep`` versions of every table."""
        for table in (*map(self.table_of, self.registry), self.text_table()):
            if table.exists():
                table.expire(keep)

    def dead_letters(self) -> DataFrame:
        return self.spark.read.schema(
            "stream string, run bigint, entry bigint, text string, problem string, batch string"
        ).parquet(f"{self.root}/dead_letters")

    def files(self, path: str | list[str], limit: int | None = None) -> None:
        """Ingest log files."""
        self.entries(assemble_files(read_log_lines(self.spark, path)), limit=limit)

    def streams(self, lines: DataFrame, stream: str, order: list[str], line: str = "msg") -> None:
        """Ingest lines of many streams, each ordered by ``order``."""
        self.entries(assemble_streams(lines, stream, order, line))

    def entries(
        self, entries: DataFrame, limit: int | None = None, batch: tuple[str, int] | None = None
    ) -> None:
        """Parse once, keep the result in the shared folder, and feed every sink from it."""
        parsed = parse_entries(entries)
        if limit is not None:
            parsed = first_entries(parsed, limit)
        rows = stage(
            routed_rows(parsed, self.registry), "routed", ("kind", "namespace", "type")
        )
        routed = by_kind(rows)
        if self.fail_fast:
            check_all_good(routed.dead)
        self._records(routed, batch)
        self._texts(routed, batch)

    def _records(self, routed: Routed, batch: tuple[str, int] | None) -> None:
        # By the time that an entry names, then by its stream: the same however entries are cut into batches.
        place = ["date", *PLACE, "item"]
        bad = routed.dead
        present = {(r["namespace"], r["type"]) for r in routed.records.select("namespace", "type").distinct().collect()}
        for spec in self.registry:
            if (spec.namespace, spec.name) not in present:
                continue
            # Each type has its own folder among the routed rows, so its merge reads no other.
            typed = records_of(routed.records, spec, keep=place)
            good = typed.filter(F.size("problems") == 0)
            moment = F.concat_ws("\x00", "date", "stream")
            self.table_of(spec).merge(good, F.struct(*place), batch, columns=spec.columns, stored_seq=moment)
            failed = typed.filter(F.size("problems") > 0).select(
                *PLACE,
                F.to_json(F.struct(*spec.columns)).alias("text"),
                F.array_join("problems", ", ").alias("problem"),
            )
            bad = bad.unionByName(failed)
        label = f"{batch[0]}-{batch[1]}" if batch else uuid.uuid4().hex
        # A repeated batch replaces its own folder.
        (
            bad.withColumn("batch", F.lit(label))
            .write.mode("overwrite")
            .option("partitionOverwriteMode", "dynamic")
            .partitionBy("batch")
            .parquet(f"{self.root}/dead_letters")
        )

    def _texts(self, routed: Routed, batch: tuple[str, int] | None) -> None:
        texts = routed.texts.select(
            "module_name",
            "name",
            F.col("name").alias("id"),
            F.col("name").alias("doc_id"),
            "text",
        )
        self.text_table().upsert(with_vectors(texts, "text", self.embedder, "id"), "id", batch)
