"""Spaces: named restrictions or copies over stores, the store catalog, usage edges."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from annalist.sources.tables import VersionedTable
from annalist.specs import EntitySpec, FieldSpec, text_entry

STORE_MODES = ("columnar", "entity", "vector")


@dataclass(frozen=True)
class Space:
    """A subscription: who is interested in which slice of a parent table."""

    name: str
    text: str = ""
    store_type: str = "columnar"
    parent: str | None = None
    perspective: str = "entity"
    primary_entity: str | None = None
    date_from: str | None = None
    date_to: str | None = None
    metadata: dict = field(default_factory=dict)

    def predicate(self, time: str | None = None, entity: str | None = None) -> Column:
        """Dates are inclusive from, exclusive to; metadata are equality tests."""
        tests = [F.lit(True)]
        if time and self.date_from:
            tests.append(F.col(time) >= F.lit(self.date_from).cast("timestamp_ntz"))
        if time and self.date_to:
            tests.append(F.col(time) < F.lit(self.date_to).cast("timestamp_ntz"))
        if entity and self.primary_entity:
            tests.append(F.col(entity) == F.lit(self.primary_entity))
        for column, value in self.metadata.items():
            tests.append(
                F.col(column).isin(list(value)) if isinstance(value, (list, tuple, set)) else F.col(column) == F.lit(value)
            )
        return reduce(Column.__and__, tests)


def subscription_type(width: int | None = None) -> EntitySpec:
    """The vector table type that makes spaces searchable by their text."""
    optional = lambda n, kind=str, default=None: FieldSpec(n, kind, required=False, default=default)
    return text_entry("SpaceSubscription", width=width).derive(
        "SpaceSubscription",
        [
            FieldSpec("store_type"),
            optional("parent_space_id"),
            optional("perspective", default="entity"),
            optional("primary_entity"),
            optional("spaces_of_interest", list[str]),
            optional("date_from"),
            optional("date_to"),
            optional("metadata", dict),
        ],
    )


def space_view(parent: DataFrame, space: Space, time: str | None = None, entity: str | None = None) -> DataFrame:
    """The parent restricted to a space; the filters reach the scan. Registered under its name."""
    view = parent.filter(space.predicate(time, entity))
    view.createOrReplaceTempView(space.name)
    return view


def space_copy(parent: DataFrame, space: Space, table: VersionedTable, time: str | None = None, entity: str | None = None) -> DataFrame:
    """The space as a table of its own."""
    table.overwrite(parent.filter(space.predicate(time, entity)))
    return table.rows()


def replace_window(table: VersionedTable, df: DataFrame, time: str) -> None:
    """Replace whole dates of a table partitioned by ``event_date`` with the dates in ``df``."""
    table.replace_partitions(df.withColumn("event_date", F.to_date(time)))


def store_catalog(spark: SparkSession, root: str) -> DataFrame:
    """(mode, namespace, name) of the stores under ``<root>/<mode>/v0/<namespace>/<name>/``.

    Folders are listed down to the manifests; no data file is. A store counts from its first commit on, also an empty one.
    """
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    fs = path(root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def names(folder: str) -> list[str]:
        return [f.getPath().getName() for f in fs.listStatus(path(folder)) if f.isDirectory()] if fs.exists(path(folder)) else []

    top = root.rstrip("/")
    found = [
        (mode, space, name)
        for mode in STORE_MODES
        for space in names(f"{top}/{mode}/v0")
        for name in names(f"{top}/{mode}/v0/{space}")
        if "_manifests" in names(f"{top}/{mode}/v0/{space}/{name}")
    ]
    return spark.createDataFrame(found, "mode string, namespace string, name string")


def usage_edges(events: DataFrame, source: str = "source_node_id", target: str = "target_node_id", confidence: str = "confidence") -> DataFrame:
    """Who asked whom, how often, how sure the answers were."""
    return events.groupBy(source, target).agg(
        F.count("*").alias("n"), F.avg(confidence).alias("confidence")
    )
