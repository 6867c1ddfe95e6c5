"""JSON records: strict parsing, validation and coercion to a declared type."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F, types as T

from annalist.specs import (
    DEFAULT_NAMESPACE,
    KEY_TAG,
    NAMESPACE_TAG,
    TYPE_TAG,
    EntitySpec,
    FieldSpec,
)

_JSON = {"allowSingleQuotes": "false"}
# Texts read as booleans.
TRUE_TEXTS = ["1", "true", "t", "yes", "y", "on"]
FALSE_TEXTS = ["0", "false", "f", "no", "n", "off"]


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once per row, however often the body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _last_wins(entries: Column) -> Column:
    """Entries (key, value) to a map in which a repeated key keeps its last value."""

    def unique(all_entries: Column) -> Column:
        return F.filter(
            all_entries,
            lambda e, i: ~F.exists(
                F.slice(all_entries, i + 2, F.greatest(F.size(all_entries), F.lit(1))),
                lambda later: later["key"] == e["key"],
            ),
        )

    return F.map_from_entries(let(entries, unique))


def json_object(text: Column) -> Column:
    """One JSON object as ``map<string,string>``; null for anything else.

    The text is parsed as the only item of an array, so trailing text after the
    object is an error rather than ignored. Nested values keep their JSON text.
    A repeated key keeps its last value.
    """
    items = F.from_json(
        F.concat(F.lit("["), text, F.lit("]")), "array<map<string,string>>", _JSON
    )

    def only_item(found: Column) -> Column:
        record = F.get(found, F.lit(0))
        repeated = F.size(F.array_distinct(F.map_keys(record))) < F.size(record)
        last = F.when(repeated, _last_wins(F.map_entries(record))).otherwise(record)
        return F.when(F.size(found) == 1, last)

    return let(items, only_item)


def kv_fields(text: Column) -> Column:
    """``key=value`` and ``key="quoted value"`` pairs of a line as a map, last one wins."""
    # Fixed value: the pair pattern.
    pattern = r'(\w+)="(.*?)"|(\w+)=([^\s]+)'

    def pair(match: Column) -> Column:
        value = F.substr(match, F.instr(match, "=") + 1)
        # Only a quoted value can both start and end with a quote.
        quoted = value.rlike('(?s)^".*"$')
        return F.struct(
            F.substring_index(match, "=", 1).alias("key"),
            F.when(quoted, F.substr(value, F.lit(2), F.length(value) - 2)).otherwise(value).alias("value"),
        )

    return _last_wins(F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), pair))


def type_tags(record: Column) -> tuple[Column, Column]:
    """(namespace, type) of a parsed record; a null namespace means the default one."""
    return (
        F.coalesce(record[NAMESPACE_TAG], F.lit(DEFAULT_NAMESPACE)),
        record[TYPE_TAG],
    )


def shape_id(json_text: Column) -> Column:
    """Id of an untyped record from its sorted field names."""
    return F.sha2(F.array_join(F.array_sort(F.json_object_keys(json_text)), ","), 256)


def _coerced(value: Column, field: FieldSpec) -> Column:
    kind = field.data_type
    if isinstance(kind, T.StringType):
        return value
    if isinstance(kind, T.BooleanType):
        text = F.lower(value)
        return F.when(text.isin(TRUE_TEXTS), True).when(text.isin(FALSE_TEXTS), False)
    if isinstance(kind, (T.ArrayType, T.MapType, T.StructType)):
        return F.from_json(value, kind, _JSON)
    if isinstance(kind, T.BinaryType):
        return F.encode(value, "UTF-8")
    if isinstance(kind, T.IntegralType):
        # 3.0 arrives where a float column held whole numbers; the fraction is cut.
        return F.coalesce(
            F.trim(value).try_cast(kind), F.trim(value).try_cast("decimal(38,18)").try_cast(kind)
        )
    return F.trim(value).try_cast(kind)


def _converted(value: Column, source: T.DataType, field: FieldSpec) -> Column:
    """A column of a known type as the field's type; equal types pass through, so filters on them reach the file."""
    kind = field.data_type
    nested = (T.ArrayType, T.MapType, T.StructType)
    if source.simpleString() == kind.simpleString():
        return value
    if isinstance(source, T.BinaryType) and isinstance(kind, T.StringType):
        return F.try_validate_utf8(value.cast("string"))
    if isinstance(source, T.NumericType) and isinstance(kind, T.NumericType) or (
        isinstance(source, (T.DateType, T.TimestampType)) and isinstance(kind, (T.DateType, T.TimestampType))
    ):
        return value.try_cast(kind)
    if isinstance(source, T.BinaryType):
        return _coerced(F.try_validate_utf8(value.cast("string")), field)
    return _coerced(F.to_json(value) if isinstance(source, nested) else value.cast("string"), field)


def _problem(value: Column, field: FieldSpec, typed: Column) -> Column:
    """Why this field is unusable, or null."""
    missing = F.lit(f"missing {field.name}")
    bad = F.lit(f"bad {field.name}")
    checks = F.when(value.isNotNull() & typed.isNull(), bad)
    if field.required and field.default is None:
        checks = F.when(value.isNull(), missing).when(typed.isNull(), bad)
    if field.width:
        checks = checks.when(
            typed.isNotNull() & (F.size(typed) != field.width), F.lit(f"width of {field.name}")
        )
    return checks


def typed_records(df: DataFrame, record: str, spec: EntitySpec, keep: list[str] = []) -> DataFrame:
    """Validate and coerce the map column ``record`` to ``spec``.

    Adds the columns of the type and ``problems`` (array of text, empty when
    the record is good). Extra fields are dropped, optional ones may be null,
    defaults fill absent fields only: an explicit null stays null.
    """
    rec = F.col(record)
    typed = {f.name: _coerced(rec[f.name], f) for f in spec.fields}
    values = {f.name: rec[f.name] for f in spec.fields}
    absent = {f.name: ~F.map_contains_key(rec, F.lit(f.name)) for f in spec.fields}
    return _checked(df, spec, values, typed, absent, keep)


def _checked(
    df: DataFrame, spec: EntitySpec, values: dict[str, Column], typed: dict[str, Column], absent: dict[str, Column], keep: list[str],
) -> DataFrame:
    """The typed columns, defaults for absent fields, ``problems``, derived columns and cleaners."""
    problems = F.filter(
        F.array(*[_problem(values[f.name], f, typed[f.name]) for f in spec.fields]), lambda p: p.isNotNull()
    )
    columns = []
    for f in spec.fields:
        value = typed[f.name]
        if f.default is not None and f.name in absent:
            value = F.when(absent[f.name], F.lit(f.default).cast(f.data_type)).otherwise(value)
        columns.append(value.alias(f.name))
    out = df.select(*keep, *columns, problems.alias("problems"))
    return apply_cleaners(out, spec)


def apply_cleaners(df: DataFrame, spec: EntitySpec) -> DataFrame:
    """Run the type's derived columns, then its cleaners."""
    for name, build in spec.derived.items():
        df = df.withColumn(name, build())
    if spec.cleaners:
        df = df.withColumns({c: clean(F.col(c)) for c, clean in spec.cleaners.items()})
    return df


def coerce_columns(df: DataFrame, spec: EntitySpec) -> DataFrame:
    """Read rows of an existing table as the type: convert columns by their types, report what fails.

    A column that has the field's type already is passed through as it is: bytes keep their values, and filters on it reach the file. A column that
    is missing is an absent field.
    """
    there = {f.name: F.col(f"`{f.name}`") for f in spec.fields if f.name in df.columns}
    values = {f.name: there.get(f.name, F.lit(None).cast(f.data_type)) for f in spec.fields}
    typed = {f.name: _converted(there[f.name], df.schema[f.name].dataType, f) if f.name in there else values[f.name] for f in spec.fields}
    absent = {f.name: F.lit(True) for f in spec.fields if f.name not in there}
    return _checked(df, spec, values, typed, absent, [])


def record_text(df: DataFrame, spec: EntitySpec) -> Column:
    """A typed row as one fenced JSON block without a newline, tags included."""
    fields = [F.col(c) for c in spec.columns if c in df.columns]
    tags = [
        F.lit(spec.name).alias(TYPE_TAG),
        F.lit(spec.keys[0] if spec.keys else None).alias(KEY_TAG),
        F.lit(spec.namespace).alias(NAMESPACE_TAG),
    ]
    body = F.to_json(F.struct(*fields, *tags), {"ignoreNullFields": "false"})
    return F.concat(F.lit("```json"), body, F.lit("```"))
