"""Session settings and the shared folder used to cut lineage."""

from __future__ import annotations

import hashlib
import tempfile
import threading
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.optimizeSkewsInRebalancePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def get_session(app: str = "annalist", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators are tuned for.

    ``master`` is left to spark-submit unless given. Keyword names use ``__`` for ``.``.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **{k.replace("__", "."): v for k, v in conf.items()}}.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    ship_package(spark)
    return spark


def ship_package(spark: SparkSession) -> None:
    """Make this package importable in the Python workers (as ``--py-files`` would)."""
    root = Path(__file__).parent
    files = sorted(root.rglob("*.py"))
    digest = hashlib.sha256(b"".join(f.read_bytes() for f in files)).hexdigest()[:16]
    name = f"{root.name}-{digest}.zip"
    if name in getattr(spark.sparkContext, "_python_includes", []):
        return
    archive = Path(tempfile.mkdtemp(prefix="annalist-")) / name
    with zipfile.ZipFile(archive, "w") as out:
        for f in files:
            out.write(f, f.relative_to(root.parent))
    spark.sparkContext.addPyFile(str(archive))


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor can reach, as the cluster names it.

    ``spark.checkpoint.dir`` decides. Only where it is unset and driver and
    executors are one process a fresh temporary folder is made, and the session
    is told about it; a cluster without the setting is an error.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors reach")
        folder = tempfile.mkdtemp(prefix="annalist-")
        spark.sparkContext.setCheckpointDir(folder)
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def _scratch_root(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/annalist/{spark.sparkContext.applicationId}"


_scopes = threading.local()


def scratch_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nobody else uses."""
    path = f"{_scratch_root(spark)}/{name}-{uuid.uuid4().hex}"
    for scope in getattr(_scopes, "open", []):
        scope.append(path)
    return path


@contextmanager
def scratch_scope(spark: SparkSession) -> Iterator[None]:
    """What is staged within (by this thread) is deleted at its end, so results built on it must be written by then."""
    _scopes.open = [*getattr(_scopes, "open", []), []]
    try:
        yield
    finally:
        *_scopes.open, staged = _scopes.open
        for path in staged:
            _delete(spark, path)


def release_scratch(spark: SparkSession) -> None:
    """Delete what this application staged. Call it when no result built on it is needed any more."""
    _delete(spark, _scratch_root(spark))


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def stage(df: DataFrame, name: str, partition_by: tuple[str, ...] = ()) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    Use it where several jobs consume one expensive result. The written table
    survives executor loss, cuts the lineage, and unlike a checkpoint keeps
    column pruning and filter pushdown for the readers.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    writer = df.write
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
