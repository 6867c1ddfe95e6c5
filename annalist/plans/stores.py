"""Handles on the stores of one entity type: columnar, vector and key lookup.

Paths follow ``<root>/<mode>/v0/<namespace>/<name>``.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from py4j.java_gateway import is_instance_of
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from annalist.functions.records import apply_cleaners
from annalist.functions.vectors import Embedder, HashingEmbedder, embed, with_vectors
from annalist.operators import lookup
from annalist.operators.nearest import ClusteredIndex, nearest, nearest_join
from annalist.operators.profile import enum_lists, enumerated_columns
from annalist.session import stage
from annalist.sources.files import read_typed
from annalist.sources.tables import VersionedTable
from annalist.specs import EntitySpec

ROW_CAP = 200  # Fixed value: rows an ad-hoc question returns at most.


class NotAllowed(ValueError):
    """The question reads something else than the store, or calls a function that is not for questions."""


#: What a word may not be taken from: literals, quoted names, comments; then the words that are replaced.
_WORDS = re.compile(r"""('(?:[^'\\]|\\.)*'|"(?:[^"\\]|\\.)*"|`[^`]*`|--[^\n]*|/\*.*?\*/)|\bTABLE\b|\b(CURRENT_DATE)\b(?!\s*\()""", re.S)
#: Groups of built-in functions that questions may not use: those that reach into the process or its files.
CLOSED_GROUPS = {"misc_funcs", ""}
CATALYST = "org.apache.spark.sql.catalyst"


def clean_sql(text: str, view: str) -> str:
    """SQL as people and models write it: fences, a leading tag, TABLE for the store."""
    if "```" in text:
        text = re.sub(r"^\s*sql\b", "", text.split("```")[1], flags=re.I)
    replaced = lambda m: m[0] if m[1] else "CURRENT_DATE()" if m[2] else f"`{view}`"
    return _WORDS.sub(replaced, text.strip().rstrip(";"))


def _items(seq) -> list:
    """Items of a Scala sequence."""
    return [seq.apply(i) for i in range(seq.size())]


def check_question(spark: SparkSession, sql: str, view: str) -> None:
    """Raise unless the parsed plan reads only ``view`` and calls only built-in functions of open groups.

    The plan is looked at before it is resolved, so nothing that it names is opened or called.
    """
    jvm, gateway = spark.sparkContext._jvm, spark.sparkContext._gateway
    registry = jvm.org.apache.spark.sql.catalyst.analysis.FunctionRegistry.builtin()
    todo, names, reads, calls = [spark._jsparkSession.sessionState().sqlParser().parsePlan(sql)], {view.lower()}, [], []
    while todo:
        node = todo.pop()
        kind = node.getClass().getSimpleName()
        if kind == "UnresolvedRelation":
            reads.append(_items(node.multipartIdentifier()))
        elif kind == "UnresolvedFunction":
            calls.append(_items(node.nameParts()))
        elif kind == "UnresolvedGenerator":
            calls.append([node.name().funcName()])
        elif kind in ("UnresolvedTableValuedFunction", "UnresolvedTVFAliases", "UnresolvedInsertStatement"):
            raise NotAllowed("table functions are not for questions")
        elif kind == "UnresolvedWith":
            names |= {c._1().lower() for c in _items(node.cteRelations())}
        todo += _items(node.children())
        if is_instance_of(gateway, node, f"{CATALYST}.plans.logical.LogicalPlan"):
            todo += _items(node.expressions()) + _items(node.innerChildren())
        elif is_instance_of(gateway, node, f"{CATALYST}.expressions.SubqueryExpression"):
            todo.append(node.plan())
    for read in reads:
        if len(read) != 1 or read[0].lower() not in names:
            raise NotAllowed(f"a question may only read {view}, not {'.'.join(read)}")
    for call in calls:
        found = registry.lookupFunction(jvm.org.apache.spark.sql.catalyst.FunctionIdentifier(call[-1].lower()))
        if len(call) != 1 or found.isEmpty() or found.get().getGroup() in CLOSED_GROUPS:
            raise NotAllowed(f"{'.'.join(call)} is not for questions")


def guarded_sql(spark: SparkSession, text: str, view: str, limit: int | None = ROW_CAP) -> DataFrame:
    """Run one SELECT over ``view``; anything that is not a query does not parse inside the parentheses."""
    sql = f"({clean_sql(text, view)}\n)"
    check_question(spark, sql, view)
    df = spark.sql(sql)
    return df if limit is None else df.limit(limit)


class _Store:
    mode = ""

    def __init__(self, spark: SparkSession, root: str, spec: EntitySpec, buckets: int = 16):
        self.spark, self.root, self.spec = spark, root.rstrip("/"), spec
        self.path = f"{self.root}/{self.mode}/v0/{spec.namespace}/{spec.name}"
        self.table = VersionedTable(spark, self.path, self._keys(), buckets=buckets)

    def _keys(self) -> tuple[str, ...]:
        return self.spec.keys

    def load(self, limit: int | None = None) -> DataFrame:
        df = self.table.rows()
        if df is None:
            df = self.spark.createDataFrame([], self.spec.schema)
        return df if limit is None else df.limit(limit)

    def query(self, sql: str, name: str | None = None) -> DataFrame:
        """Any SQL over the store, registered under the entity's name."""
        self.load().createOrReplaceTempView(name or self.spec.name)
        return self.spark.sql(sql)


class ColumnarStore(_Store):
    """One row per key, columns as declared."""

    mode = "columnar"

    def add(
        self, df: DataFrame, mode: str = "merge", seq: str | Column | None = None, plan: bool = False,
        batch: tuple[str, int] | None = None,
    ) -> DataFrame | None:
        """Merge (default) or overwrite; ``plan`` returns the resulting rows without writing."""
        if mode == "overwrite":
            if plan:
                return df
            self.table.overwrite(df, batch)
        elif plan:
            return self.table.plan_merge(df, seq)
        else:
            self.table.merge(df, seq, batch)
        return None

    def ingest(self, uri: str, mode: str = "merge", **options) -> DataFrame:
        """Read a file as this type and add the good rows; returns the bad ones."""
        rows = read_typed(self.spark, uri, self.spec, **options)
        self.add(rows.filter(F.size("problems") == 0).drop("problems"), mode)
        return rows.filter(F.size("problems") > 0)

    def fetch(self, limit: int = 10) -> DataFrame:
        return self.load(limit)

    def enums(self, **options) -> dict[str, list[str | None]]:
        return enum_lists(self.load(), **options)

    def enum_values(self, **options) -> DataFrame:
        return enumerated_columns(self.load(), **options)

    def ask_sql(self, sql: str, limit: int | None = ROW_CAP) -> DataFrame:
        """One ad-hoc SELECT, ``TABLE`` standing for this store, capped before it is collected."""
        self.load().createOrReplaceTempView(self.spec.name)
        return guarded_sql(self.spark, sql, self.spec.name, limit)


class VectorStore(_Store):
    """Named texts with their vectors; searched by nearest neighbour."""

    mode = "vector"

    def __init__(
        self, spark: SparkSession, root: str, spec: EntitySpec,
        embedder: Callable[[], Embedder] | None = None, buckets: int = 16,
    ):
        super().__init__(spark, root, spec, buckets)
        self.cells = ClusteredIndex(spark, f"{self.path}/_index")
        width = next((f.width for f in spec.fields if f.name == "vector"), None) or 64
        self.embedder = embedder or (lambda: HashingEmbedder(width))

    def _keys(self) -> tuple[str, ...]:
        return ("id",)

    def embedded(self, df: DataFrame) -> DataFrame:
        """Rows as they would be stored: defaults filled in, text embedded."""
        for f in self.spec.fields:
            if f.name not in df.columns and f.name != "vector":
                df = df.withColumn(f.name, F.lit(None).cast(f.data_type))
        df = apply_cleaners(df, self.spec)
        return with_vectors(df, "text", self.embedder, "id").select(*self.spec.columns)

    def add(
        self, df: DataFrame, plan: bool = False, batch: tuple[str, int] | None = None
    ) -> DataFrame | None:
        """Embed and upsert by id; ``plan`` returns the rows without writing."""
        rows = self.embedded(df)
        if plan:
            return rows
        if not self.cells.exists():
            self.table.upsert(rows, "id", batch)
            return None
        rows = stage(rows, "embedded")  # embedded once for both
        self.table.upsert(rows, "id", batch)
        self.cells.add(rows.select(*self.INDEXED))
        return None

    #: Columns that the index keeps.
    INDEXED = ("id", "text", "vector")

    def index(self, cells: int | None = None, train_rows: int | None = None) -> None:
        """Cluster the stored rows, so that searches can probe cells; rows added later go into the index too."""
        self.cells.build(self.load().select(*self.INDEXED), cells, train_rows)

    def query(self, sql: str, name: str | None = None) -> DataFrame:
        """Any SQL over the store's columns, registered as ``dataset``."""
        return super().query(sql, name or "dataset")

    def vector_of(self, question: str) -> list[float]:
        return self.embedder()([question])[0].tolist()

    def search(self, question: str, limit: int = 3, metric: str = "l2sq", probes: int | None = None, refine: int | None = None) -> DataFrame:
        """id, text and ``_distance`` of the nearest rows, nearest first.

        Without ``probes`` all rows are compared; with it those of so many cells of the index (see ``index``), of which
        ``refine`` compares only ``limit * refine`` by their full vectors.
        """
        if probes is None:
            return nearest(self.load(), self.vector_of(question), limit, metric=metric)
        return self.cells.search(self.vector_of(question), limit, probes, metric=metric, refine=refine)

    def search_many(self, questions: DataFrame, text: str, key: str, limit: int = 3) -> DataFrame:
        """The nearest rows of every question in a DataFrame."""
        asked = questions.select(F.col(key).alias("q"), embed(F.col(text), self.embedder).alias("v"))
        return nearest_join(asked, self.load(), limit, "q", "v", columns=("text",))


class EntityStore(_Store):
    """Records by key: insert replaces a record, upsert merges its fields."""

    mode = "entity"

    def insert(self, df: DataFrame, seq: str | Column | None = None) -> None:
        self.table.merge(df, seq)

    def upsert(self, df: DataFrame, seq: str | Column | None = None, present: str | None = None) -> None:
        self.table.update_fields(df, seq, present)

    def get(self, key) -> DataFrame:
        """The record of one key, reading its bucket only; no row when it is unknown."""
        name = self.spec.keys[0]
        kind = self.spec.schema[name].dataType.simpleString()
        return self.table.lookup(self.spark.createDataFrame([(key,)], f"{name} {kind}"))

    def fetch(self, keys: str | list[str]) -> DataFrame:
        """Every key of a comma list with its record, nulls where it is unknown."""
        wanted = lookup.literal_keys(self.spark, keys)
        name = self.spec.keys[0]
        found = self.table.lookup(wanted.select(F.col("key").alias(name))) if self.table.exists() else self.load()
        return lookup.fetch(wanted, found, name)

    def exists(self, keys: str | list[str]) -> DataFrame:
        return lookup.exists(lookup.literal_keys(self.spark, keys), self.load(), self.spec.keys[0])


def stores_for(spark: SparkSession, root: str, spec: EntitySpec) -> tuple[ColumnarStore, VectorStore, EntityStore]:
    """All three stores of one entity."""
    return ColumnarStore(spark, root, spec), VectorStore(spark, root, spec), EntityStore(spark, root, spec)
