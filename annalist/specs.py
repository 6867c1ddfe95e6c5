"""Entity types: the declared schema of a table, its key, cleaners and defaults."""

from __future__ import annotations

import datetime
import types
import typing
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field, replace
from typing import Any

from pyspark.sql import Column, functions as F, types as T

# Record tags written into log lines, and the usual vector widths.
TYPE_TAG = "__type__"
KEY_TAG = "__key__"
NAMESPACE_TAG = "__namespace__"
VECTOR_WIDTHS = {"instruct": 768, "openai": 1536}
DEFAULT_NAMESPACE = "default"

SPARK_TYPES: dict[Any, T.DataType] = {
    int: T.LongType(),
    float: T.DoubleType(),
    str: T.StringType(),
    bool: T.BooleanType(),
    bytes: T.BinaryType(),
    list: T.ArrayType(T.StringType()),
    dict: T.MapType(T.StringType(), T.StringType()),
    list[int]: T.ArrayType(T.LongType()),
    list[float]: T.ArrayType(T.FloatType()),
    list[str]: T.ArrayType(T.StringType()),
    None: T.NullType(),
}


def spark_type(kind: Any) -> T.DataType:
    """Python annotation, DDL text, Spark type or nested spec to a Spark type."""
    if isinstance(kind, T.DataType):
        return kind
    if isinstance(kind, EntitySpec):
        return kind.schema
    if isinstance(kind, str):
        return T.StructType.fromDDL(f"x {kind}")[0].dataType
    if kind in (datetime.datetime, datetime.date):
        return T.TimestampType() if kind is datetime.datetime else T.DateType()
    inner = [a for a in typing.get_args(kind) if a is not type(None)]
    origin = typing.get_origin(kind)
    if origin in (typing.Union, types.UnionType) and len(inner) == 1:
        return spark_type(inner[0])
    if kind not in SPARK_TYPES and origin is list and len(inner) == 1:
        # Lists of numbers written List[float] mean the same as list[float].
        return SPARK_TYPES.get(list[inner[0]]) or T.ArrayType(spark_type(inner[0]))
    if kind not in SPARK_TYPES and origin is dict and len(inner) == 2:
        return T.MapType(spark_type(inner[0]), spark_type(inner[1]))
    return SPARK_TYPES[list if kind is typing.List else dict if kind is typing.Dict else kind]


@dataclass(frozen=True)
class FieldSpec:
    """One column. ``width`` fixes the length of a vector column."""

    name: str
    kind: Any = str
    required: bool = True
    default: Any = None
    key: bool = False
    width: int | None = None
    long_text: bool = False

    @property
    def data_type(self) -> T.DataType:
        return spark_type(self.kind)

    def struct_field(self) -> T.StructField:
        flags = {"is_key": self.key, "long_text": self.long_text, "fixed_size_length": self.width}
        return T.StructField(
            self.name, self.data_type, not self.key, {k: v for k, v in flags.items() if v}
        )


@dataclass(frozen=True)
class EntitySpec:
    """A table type: ``namespace.name`` with fields, 1..n key columns and cleaners.

    ``cleaners`` maps a column name to a function ``Column -> Column``; they run
    after validation, in order, and stay inside the JVM plan.
    ``derived`` maps a column name to a function without arguments giving a
    Column over the record's own fields (used for ids that default to the name).
    """

    name: str
    fields: tuple[FieldSpec, ...]
    namespace: str = DEFAULT_NAMESPACE
    about: str = ""
    embeddings_provider: str | None = None
    cleaners: dict[str, Callable[[Column], Column]] = field(default_factory=dict)
    derived: dict[str, Callable[[], Column]] = field(default_factory=dict)

    @property
    def keys(self) -> tuple[str, ...]:
        return tuple(f.name for f in self.fields if f.key)

    @property
    def columns(self) -> tuple[str, ...]:
        return tuple(f.name for f in self.fields)

    @property
    def full_name(self) -> str:
        return f"{self.namespace}_{self.name}"

    @property
    def schema(self) -> T.StructType:
        return T.StructType([f.struct_field() for f in self.fields])

    def derive(
        self, name: str, extra: Iterable[FieldSpec] = (), namespace: str | None = None
    ) -> "EntitySpec":
        """A new type that inherits this one's fields; fields of the same name are replaced."""
        extra = tuple(extra)
        taken = {f.name for f in extra}
        kept = tuple(f for f in self.fields if f.name not in taken)
        return replace(
            self, name=name, fields=kept + extra, namespace=namespace or self.namespace
        )


def default_ids() -> dict[str, Callable[[], Column]]:
    """``id`` and ``doc_id`` fall back to ``name`` when null or empty."""
    return {
        c: (lambda c=c: F.coalesce(F.nullif(F.col(c), F.lit("")), F.col("name")))
        for c in ("id", "doc_id")
    }


def text_entry(
    name: str = "TextEntry",
    namespace: str = DEFAULT_NAMESPACE,
    provider: str = "openai",
    width: int | None = None,
) -> EntitySpec:
    """The base type of every vector table."""
    return EntitySpec(
        name=name,
        namespace=namespace,
        embeddings_provider=provider,
        fields=(
            FieldSpec("name", str, key=True),
            FieldSpec("text", str, long_text=True),
            FieldSpec("doc_id", str, required=False),
            FieldSpec("vector", list[float], required=False, width=width or VECTOR_WIDTHS.get(provider)),
            FieldSpec("id", str, required=False),
        ),
        derived=default_ids(),
    )


class Registry:
    """The known types, looked up by (namespace, type name)."""

    def __init__(self, specs: Iterable[EntitySpec] = ()):
        self._specs: dict[tuple[str, str], EntitySpec] = {}
        for spec in specs:
            self.add(spec)

    def add(self, spec: EntitySpec) -> "Registry":
        self._specs[(spec.namespace, spec.name)] = spec
        return self

    def get(self, namespace: str | None, name: str) -> EntitySpec | None:
        return self._specs.get((namespace or DEFAULT_NAMESPACE, name))

    def __iter__(self):
        return iter(self._specs.values())

    def __len__(self) -> int:
        return len(self._specs)

    def is_known(self, namespace: Column, name: Column) -> Column:
        """True where the tag pair names a registered type."""
        known = [F.struct(F.lit(n).alias("n"), F.lit(t).alias("t")) for n, t in self._specs]
        pair = F.struct(namespace.alias("n"), name.alias("t"))
        return pair.isin(*known) if known else F.lit(False)
