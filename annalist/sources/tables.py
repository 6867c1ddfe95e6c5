"""Versioned Parquet tables: keyed merge, upsert, replaced partitions, atomic publish.

Layout of one table::

    <path>/data/_version=<n>-<id>/<partition>=<value>/part-*.parquet
    <path>/_manifests/<n>.json

A commit writes its rows under a new ``_version=`` folder and then
creates the manifest, which maps every live partition to the folders that hold
it: a base, in which keys are settled, and batches appended since. Readers follow the newest manifest, so they never
see half a commit. A merge or upsert writes its own rows and nothing else: a reader takes the rows of a key from the last
batch that has it, a batch of delete marks (its folder ends with ``-gone``) takes them away. ``compact`` makes a partition's folders one
base again, and a commit does so itself once a partition has ``FOLD`` of them, so what is rewritten stays in proportion to what came in.
A table has one writer at a time; a writer whose version was published by another meanwhile gets an error.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

from annalist.operators.merge import keep_last, merge_fields, without_keys
from annalist.session import scratch_path, stage

BUCKET = "bucket"
#: Stored beside the rows of tables whose merges are ordered across batches.
SEQUENCE = "_seq"
#: Folders of a partition at which a commit makes them one, and how folders of delete marks end.
FOLD, GONE = 16, "-gone"


class ConcurrentWrite(RuntimeError):
    """Another writer published this version first."""


@dataclass
class Manifest:
    version: int
    schema: StructType
    partition_by: list[str]
    buckets: int
    partitions: dict[str, list[str]] = field(default_factory=dict)
    batches: dict[str, int] = field(default_factory=dict)

    def to_json(self) -> str:
        return json.dumps({**self.__dict__, "schema": self.schema.jsonValue()})

    @classmethod
    def from_json(cls, text: str) -> "Manifest":
        values = json.loads(text)
        # A single folder is how tables without appended batches were written once.
        values["partitions"] = {p: [v] if isinstance(v, str) else v for p, v in values["partitions"].items()}
        return cls(**{**values, "schema": StructType.fromJson(values["schema"])})


class VersionedTable:
    """A Parquet table with atomic commits.

    Without ``partition_by`` rows are placed in ``buckets`` by the hash of the
    key, so a row with a known key is found in one partition. The bucket count
    is fixed when the table is created; pick it so that one bucket is a few GB.
    ``partition_by`` may name ``bucket`` after other columns.
    """

    def __init__(
        self,
        spark: SparkSession,
        path: str,
        keys: tuple[str, ...] = (),
        partition_by: tuple[str, ...] = (),
        buckets: int = 16,
    ):
        self.spark = spark
        self.path = path.rstrip("/")
        self.keys = tuple(keys)
        self.partition_by = tuple(partition_by) or (BUCKET,)
        self.buckets = buckets
        jvm = spark.sparkContext._jvm
        self._new_path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._new_path(self.path).getFileSystem(
            spark.sparkContext._jsc.hadoopConfiguration()
        )

    # -- manifests ---------------------------------------------------------

    def _names(self, path: str) -> list[str]:
        where = self._new_path(path)
        if not self._fs.exists(where):
            return []
        return [s.getPath().getName() for s in self._fs.listStatus(where)]

    def versions(self) -> list[int]:
        names = self._names(f"{self.path}/_manifests")
        return sorted(int(n[:-5]) for n in names if n.endswith(".json"))

    def manifest(self, version: int | None = None) -> Manifest | None:
        if version is None:
            versions = self.versions()
            if not versions:
                return None
            version = versions[-1]
        stream = self._fs.open(self._new_path(f"{self.path}/_manifests/{version:010d}.json"))
        try:
            text = self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(
                stream, "UTF-8"
            )
        finally:
            stream.close()
        return Manifest.from_json(text)

    def _publish(self, manifest: Manifest) -> None:
        """Create the manifest file; it appears complete or not at all."""
        final = self._new_path(f"{self.path}/_manifests/{manifest.version:010d}.json")
        if self._fs.exists(final):
            raise ConcurrentWrite(f"version {manifest.version} of {self.path} exists")
        hidden = self._new_path(scratch_path(self.spark, "manifest"))
        if hidden.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).getUri() != self._fs.getUri():
            hidden = self._new_path(f"{self.path}/_tmp/{hidden.getName()}")
        out = self._fs.create(hidden, False)
        out.write(bytearray(manifest.to_json().encode()))
        out.close()
        self._fs.mkdirs(final.getParent())
        if not self._fs.rename(hidden, final):
            raise ConcurrentWrite(f"version {manifest.version} of {self.path} exists")

    # -- reading -----------------------------------------------------------

    def exists(self) -> bool:
        return bool(self.versions())

    def schema(self) -> StructType | None:
        manifest = self.manifest()
        return manifest and manifest.schema

    def df(self, version: int | None = None) -> DataFrame | None:
        """The table's rows, or None when it was never written.

        The partition columns stay visible so that filters on them prune files.
        """
        manifest = self.manifest(version)
        return None if manifest is None else self._read(manifest, list(manifest.partitions))

    def rows(self) -> DataFrame | None:
        """The table's rows without the bucket and sequence columns."""
        df = self.df()
        return None if df is None else df.drop(BUCKET, SEQUENCE)

    def _read(self, manifest: Manifest, partitions: list[str]) -> DataFrame:
        """Rows of some partitions, each key from the last batch that has it."""
        single = [f"{v[0]}/{p}" for p in partitions if len(v := manifest.partitions[p]) == 1]
        bases = [f"{v[0]}/{p}" for p in partitions if len(v := manifest.partitions[p]) > 1]
        added = [f"{f}/{p}" for p in partitions for f in manifest.partitions[p][1:]]
        rows = self._files(manifest, single).drop("_version")
        return rows.unionByName(self._settled(manifest, bases, added)) if added else rows

    def _files(self, manifest: Manifest, paths: list[str]) -> DataFrame:
        if not paths:
            return self.spark.createDataFrame([], StructType([*manifest.schema.fields, StructField("_version", StringType())]))
        schema = StructType([*manifest.schema.fields, StructField("_version", StringType())])
        reader = self.spark.read.schema(schema).option("basePath", f"{self.path}/data")
        return reader.parquet(*[f"{self.path}/data/_version={p}" for p in paths])

    def _settled(self, manifest: Manifest, bases: list[str], added: list[str]) -> DataFrame:
        """What is left of bases and the batches appended to them."""
        on = tuple(dict.fromkeys((*self.partition_by, *self.keys)))
        names = manifest.schema.names
        number = F.substring_index("_version", "-", 1).cast("bigint")
        place = F.struct(number.alias("n"), (~F.col("_version").endswith(GONE)).alias("alive"))
        base, batches = self._files(manifest, bases).drop("_version"), self._files(manifest, added).withColumn("_at", place).drop("_version")
        if SEQUENCE in names:
            # The greater sequence wins, of equal ones the later batch.
            first = F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(True).alias("alive"))
            both = base.withColumn("_at", first).unionByName(batches)
            return keep_last(both, on, F.struct(SEQUENCE, "_at"), (*names, "_at")).filter("_at.alive").drop("_at")
        # Only what came in since is grouped; the base loses the keys that came again.
        last = batches.groupBy(*on).agg(F.max("_at").alias("_last"))
        renamed = last.select(*[F.col(c).alias(f"_in_{c}") for c in on], "_last")
        same = reduce(Column.__and__, [F.col(c).eqNullSafe(F.col(f"_in_{c}")) for c in on], F.col("_at") == F.col("_last"))
        fresh = batches.filter("_at.alive").join(renamed, same, "left_semi").select(*names)
        return without_keys(base, last.select(*on), on).select(*names).unionByName(fresh)

    def lookup(self, keys: DataFrame) -> DataFrame:
        """Rows of the keys in a small DataFrame of the key columns, reading their buckets only."""
        manifest = self.manifest()
        wanted = keys.select(*self.keys).distinct()
        live = list(manifest.partitions)
        if self.partition_by == (BUCKET,):
            touched = wanted.select(self._bucket(manifest.buckets).alias(BUCKET)).distinct().collect()
            live = [p for p in (f"{BUCKET}={r[0]}" for r in touched) if p in manifest.partitions]
        return self._read(manifest, live).join(wanted, list(self.keys), "left_semi").drop(BUCKET, SEQUENCE)

    # -- writing -----------------------------------------------------------

    def _bucket(self, buckets: int) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(buckets)).cast("int")

    def _placed(self, df: DataFrame, buckets: int) -> DataFrame:
        return df.withColumn(BUCKET, self._bucket(buckets)) if BUCKET in self.partition_by else df

    def _staged(self, df: DataFrame, name: str) -> tuple[DataFrame, list[str]]:
        """A batch written once as the table would write it, and the partition folders that Spark gave it.

        Read back, partition values are those that a reader of the table gets: an empty one is null.
        """
        path = scratch_path(self.spark, name)
        df.write.partitionBy(*self.partition_by).parquet(path)
        return self.spark.read.schema(df.schema).parquet(path), self._written(path, len(self.partition_by))

    def _commit(
        self, df: DataFrame, old: Manifest | None, replaced: list[str] | None, batch: tuple[str, int] | None,
        append: bool = False, gone: bool = False,
    ) -> None:
        """Write ``df`` as the new content of ``replaced`` (None: of the whole table), or append it as a batch, or one of delete marks.

        A table that does not exist yet is not created by an empty ``df``.
        """
        version = (self.versions() or [0])[-1] + 1
        # The folder is this commit's own, so a writer that loses the race destroys nothing.
        name = f"{version}-{uuid.uuid4().hex[:12]}{GONE if gone else ''}"
        folder = f"{self.path}/data/_version={name}"
        # Rebalancing keeps files near the advisory size even when one partition is huge.
        df.hint("rebalance", *self.partition_by).write.partitionBy(*self.partition_by).parquet(folder)
        written = self._written(folder, len(self.partition_by))
        if not written and (old is None or append):
            return
        live = dict(old.partitions) if old and (append or replaced is not None) else {}
        for p in replaced or []:
            live.pop(p, None)
        live.update({p: [*(live.get(p, []) if append else []), name] for p in written if not gone or p in live})
        batches = dict(old.batches) if old else {}
        if batch:
            batches[batch[0]] = batch[1]
        buckets = old.buckets if old else self.buckets
        schema = old.schema if old and append else df.schema
        self._publish(Manifest(version, schema, list(self.partition_by), buckets, live, batches))
        if append:
            self.compact(FOLD)

    def _written(self, folder: str, depth: int) -> list[str]:
        found = [""]
        for _ in range(depth):
            found = [
                f"{parent}/{n}" if parent else n
                for parent in found
                for n in self._names(f"{folder}/{parent}" if parent else folder)
                if "=" in n
            ]
        return found

    def _seen(self, old: Manifest | None, batch: tuple[str, int] | None) -> bool:
        """True when this batch of this stream is already in the table."""
        return bool(batch and old and old.batches.get(batch[0], -1) >= batch[1])

    def _same_schema(self, old: Manifest, df: DataFrame) -> None:
        have = {f.name: f.dataType.simpleString() for f in old.schema}
        new = {f.name: f.dataType.simpleString() for f in df.schema}
        if have != new:
            raise ValueError(f"schema of {self.path} differs: {have} and {new}")

    def create(self, schema: StructType) -> None:
        """Create the table with no rows unless it exists."""
        if not self.exists():
            bucket = [StructField(BUCKET, IntegerType())] if BUCKET in self.partition_by else []
            full = StructType([*schema.fields, *bucket])
            self._publish(Manifest(1, full, list(self.partition_by), self.buckets))

    def overwrite(self, df: DataFrame, batch: tuple[str, int] | None = None) -> None:
        """Replace every row; nothing is deduplicated."""
        old = self.manifest()
        if not self._seen(old, batch):
            self._commit(self._placed(df, old.buckets if old else self.buckets), old, None, batch)

    def replace_partitions(self, df: DataFrame, batch: tuple[str, int] | None = None) -> None:
        """Replace the partitions that occur in ``df`` and leave the others."""
        old = self.manifest()
        if self._seen(old, batch):
            return
        placed = self._placed(df, old.buckets if old else self.buckets)
        if old is None:
            self._commit(placed, None, None, batch)
            return
        staged, touched = self._staged(placed, "replace")
        self._commit(staged, old, touched, batch)

    def merge(
        self,
        df: DataFrame,
        seq: str | Column | None = None,
        batch: tuple[str, int] | None = None,
        columns: tuple[str, ...] | None = None,
        stored_seq: Column | None = None,
    ) -> None:
        """Existing rows, then new rows, unique on the key, keeping the last.

        Within the batch "last" means the greatest ``seq``; a null key counts
        as one value. ``columns`` names the ones to store when ``df`` has more.
        ``stored_seq`` (text) is kept with each row: a stored row with a greater
        one is not replaced, so the result does not depend on how rows are cut
        into batches. Only the rows of the batch are written.
        """
        if stored_seq is not None:
            columns = (*(columns or df.columns), SEQUENCE)
            df = df.withColumn(SEQUENCE, stored_seq)
        self._add(keep_last(df, self.keys, seq, columns), self.keys, batch)

    def upsert(
        self, df: DataFrame, id_column: str = "id", batch: tuple[str, int] | None = None
    ) -> None:
        """Delete the rows whose id comes in, then append every incoming row."""
        self._add(df, (id_column,), batch)

    def plan_merge(self, df: DataFrame, seq: str | Column | None = None) -> DataFrame:
        """The rows a merge would leave in the table; nothing is written."""
        new = keep_last(df, self.keys, seq)
        old = self.rows()
        return new if old is None else without_keys(old, new, self.keys).unionByName(new)

    def update_fields(
        self, df: DataFrame, seq: str | Column | None = None, present: str | None = None,
        batch: tuple[str, int] | None = None,
    ) -> None:
        """Merge field by field: a field absent from the new record keeps its old value."""
        old = self.manifest()
        if self._seen(old, batch):
            return
        if old is None:
            columns = [c for c in df.columns if c not in (present, seq)]
            return self.merge(merge_fields(None, df, self.keys, seq, present).select(columns), batch=batch)
        if self.partition_by != (BUCKET,):
            # A record with the key may sit in any partition.
            staged, touched = stage(df, "update"), list(old.partitions)
        else:
            staged, touched = self._staged(self._placed(df, old.buckets), "update")
            staged = staged.drop(BUCKET)
        current = self._read(old, [p for p in touched if p in old.partitions]).drop(BUCKET)
        merged = merge_fields(current, staged, self.keys, seq, present)
        self._commit(self._placed(merged, old.buckets), old, touched, batch)

    def remove(self, keys: DataFrame, batch: tuple[str, int] | None = None) -> None:
        """Take away the rows of some keys (a DataFrame of key and partition columns, ``bucket`` excepted), by delete marks."""
        old = self.manifest()
        if old is None or self._seen(old, batch):
            return
        if SEQUENCE in old.schema.names:
            raise ValueError("rows that are kept by a sequence are not removed by their keys alone")
        given = [c for c in dict.fromkeys((*self.partition_by, *self.keys)) if c != BUCKET]
        marks = self._placed(keys.select(*given).distinct(), old.buckets)
        nulls = {f.name: F.lit(None).cast(f.dataType) for f in old.schema if f.name not in marks.columns}
        self._commit(marks.withColumns(nulls).select(*old.schema.names), old, None, batch, append=True, gone=True)

    def compact(self, most: int = 2) -> None:
        """Make the folders of each partition that has at least ``most`` of them one base of settled rows."""
        old = self.manifest()
        many = [p for p, folders in old.partitions.items() if len(folders) >= max(most, 2)] if old else []
        if many:
            self._commit(self._read(old, many), old, many, None)

    def _add(self, new: DataFrame, on: tuple[str, ...], batch: tuple[str, int] | None) -> None:
        old = self.manifest()
        if self._seen(old, batch):
            return
        placed = self._placed(new, old.buckets if old else self.buckets)
        if old is None:
            self._commit(placed, None, None, batch)
            return
        self._same_schema(old, placed)
        placed = placed.select(*old.schema.names)
        if set(on) == set(self.keys):
            self._commit(placed, old, None, batch, append=True)
            return
        # Other columns than the table's keys name the rows to replace: they may sit in any partition.
        staged, _ = self._staged(placed, "batch")
        rows = without_keys(self._read(old, list(old.partitions)), staged, on).unionByName(staged)
        self._commit(rows, old, list(old.partitions), batch)

    def expire(self, keep: int = 1) -> list[int]:
        """Delete data that none of the newest ``keep`` versions uses; returns dropped versions."""
        versions = self.versions()
        kept = [self.manifest(v) for v in versions[-keep:]]
        used_versions = {f"_version={f}" for m in kept for folders in m.partitions.values() for f in folders}
        for name in self._names(f"{self.path}/data"):
            if name not in used_versions and int(name.split("=")[1].split("-")[0]) < versions[-1]:
                self._fs.delete(self._new_path(f"{self.path}/data/{name}"), True)
        for v in versions[:-keep]:
            self._fs.delete(self._new_path(f"{self.path}/_manifests/{v:010d}.json"), False)
        return versions[:-keep]


def union_all(frames: list[DataFrame]) -> DataFrame:
    """UNION ALL with a strict schema check by name."""
    first = set(frames[0].columns)
    for f in frames[1:]:
        if set(f.columns) != first:
            raise ValueError(f"columns differ: {sorted(first)} and {sorted(f.columns)}")
    return reduce(DataFrame.unionByName, frames)
