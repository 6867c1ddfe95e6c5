"""Log assembly, parsing, labelled streams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from annalist.functions.records import kv_fields
from annalist.functions.text import short_id
from annalist.operators import labels
from annalist.operators.assemble import assemble_files, assemble_streams
from annalist.operators.entries import (
    by_kind, first_entries, log_records, log_texts, parse_entries, preamble, records_of, route, routed_rows,
    with_level,
)
from annalist.plans.registered import registered, table
from annalist.session import scratch_path, stage
from annalist.sources.logs import (
    read_log_lines, stream_values, to_responses, write_log_lines,
)
from annalist.specs import EntitySpec, FieldSpec, Registry

EVENT = EntitySpec(
    "Event",
    (
        FieldSpec("event_id", int, key=True),
        FieldSpec("user_id", int),
        FieldSpec("event_type", str),
        FieldSpec("value", float),
        FieldSpec("props", str),
        FieldSpec("ts_text", str),
    ),
    namespace="web",
)
MILLIS = "yyyy-MM-dd HH:mm:ss.SSS"
MICROS = "yyyy-MM-dd HH:mm:ss.SSSSSS"


def event_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").withColumn("ts_text", F.date_format("ts", MICROS))


def event_start(level: Column | str = "EVENT") -> Column:
    return preamble(F.date_format("ts", MILLIS), "collector", F.col("event_type"), F.col("event_id"), level)


def event_lines(spark: SparkSession, sf_dir: str, keep: list[str] = []) -> DataFrame:
    """Every event as one log line with a fenced record."""
    return log_records(event_rows(spark, sf_dir), EVENT, event_start(), keep)


def turn_lines(spark: SparkSession, sf_dir: str, keep: list[str] = []) -> DataFrame:
    """Every conversation turn as a named, multi-line log entry."""
    turns = table(spark, sf_dir, "conversations").withColumn(
        "name", F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string"))
    )
    start = preamble(F.lit("2024-01-01 00:00:00.000"), "chat", F.col("role"), F.col("turn") + 1)
    return log_texts(turns, "name", "text", start, keep)


def as_files(spark: SparkSession, lines: DataFrame) -> str:
    path = scratch_path(spark, "log")
    write_log_lines(lines, path)
    return path


def nanoseconds(ts: str) -> Column:
    """Nanoseconds since 1970 of a timestamp without time zone, whatever the session's zone."""
    epoch = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    return F.timestamp_diff("MICROSECOND", epoch, F.col(ts).cast("timestamp_ntz")) * 1000


def parsed_file(spark: SparkSession, lines: DataFrame) -> DataFrame:
    """Lines written as log files, read back, assembled and parsed."""
    return parse_entries(assemble_files(read_log_lines(spark, as_files(spark, lines))))


@registered(
    "log_roundtrip_events",
    """
    SELECT event_id, user_id, event_type, value, props,
           strftime(ts, '%Y-%m-%d %H:%M:%S.%f') AS ts_text
    FROM events
    """,
)
def log_roundtrip_events(spark, sf_dir):
    rows = routed_rows(parsed_file(spark, event_lines(spark, sf_dir)), Registry([EVENT]))
    routed = by_kind(stage(rows, "routed", ("kind", "namespace", "type")))
    return records_of(routed.records, EVENT).drop("problems")


@registered(
    "log_multiline_text",
    r"""
    SELECT role AS module_name, conv_id || '-' || turn AS name,
           '  ***' || conv_id || '-' || turn || '***' || chr(10)
             || rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS text
    FROM conversations
    """,
)
def log_multiline_text(spark, sf_dir):
    parsed = parsed_file(spark, turn_lines(spark, sf_dir))
    return route(parsed, Registry()).texts.select("module_name", "name", "text")


@registered(
    "stream_entries",
    r"""
    SELECT conv_id::VARCHAR AS stream,
           rtrim('2024-01-01 00:00:00.000 | EVENT    | chat:' || role || ':' || (turn + 1) || ' -  ***'
             || conv_id || '-' || turn || '***' || chr(10) || text,
             ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS text
    FROM conversations
    """,
)
def stream_entries(spark, sf_dir):
    """Turns split into physical lines, assembled per conversation in time order."""
    entries = turn_lines(spark, sf_dir, ["conv_id", "turn"])
    lines = entries.select("conv_id", "turn", F.posexplode(F.split("value", "\n")).alias("position", "msg"))
    out = assemble_streams(lines, "conv_id", ["turn", "position"], "msg")
    return out.select("stream", "text")


PARSED_SQL = """
    SELECT strftime(ts, '%Y-%m-%d %H:%M:%S.%g') AS date, upper(event_type) AS log_level,
           'collector' AS process_name, event_type AS module_name, event_id AS line_number,
           sha256(strftime(ts, '%Y-%m-%d %H:%M:%S.%g') || '|' || upper(event_type) || '|collector:'
             || event_type || ':' || event_id) AS id
    FROM events
"""


def parsed_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = log_records(event_rows(spark, sf_dir), EVENT, event_start(F.upper("event_type")))
    return parse_entries(lines, "value")


@registered("log_parse_fields", PARSED_SQL)
def log_parse_fields(spark, sf_dir):
    return parsed_events(spark, sf_dir).select(
        "date", "log_level", "process_name", "module_name", "line_number", "id"
    )


@registered(
    "log_levels_by_type",
    "SELECT upper(event_type) AS log_level, count(*) AS n FROM events GROUP BY 1",
)
def log_levels_by_type(spark, sf_dir):
    return parsed_events(spark, sf_dir).groupBy("log_level").agg(F.count("*").alias("n"))


@registered(
    "log_one_level",
    f"SELECT date, line_number FROM ({PARSED_SQL}) WHERE log_level = 'ERROR'",
)
def log_one_level(spark, sf_dir):
    return with_level(parsed_events(spark, sf_dir), "ERROR").select("date", "line_number")


@registered(
    "log_first_entries",
    "SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S.%g') AS date FROM events ORDER BY event_id LIMIT 100",
)
def log_first_entries(spark, sf_dir):
    """The row limit of ingestion: the first entries in log order."""
    lines = event_lines(spark, sf_dir, ["event_id"]).select(
        F.lit("events").alias("stream"), F.lit(0).alias("run"), F.col("event_id").alias("entry"), "value"
    )
    return first_entries(parse_entries(lines, "value"), 100).select(F.col("entry").alias("event_id"), "date")


@registered(
    "short_ids",
    """
    SELECT event_id, 'mon' || upper(substr(sha256(event_type || '|' || event_id), 1, 32)) AS short_id
    FROM events
    """,
)
def short_ids(spark, sf_dir):
    return table(spark, sf_dir, "events").select(
        "event_id", short_id(F.concat_ws("|", "event_type", F.col("event_id").cast("string"))).alias("short_id")
    )


@registered(
    "logfmt_fields",
    """
    SELECT o_orderkey::VARCHAR AS orderkey, o_orderpriority AS priority, o_orderstatus AS status,
           o_custkey::VARCHAR AS cust
    FROM orders
    """,
)
def logfmt_fields(spark, sf_dir):
    """``key=value`` lines; the status is given twice and the last one counts."""
    line = F.concat(
        F.lit("orderkey="), F.col("o_orderkey").cast("string"), F.lit(' status=none priority="'),
        F.col("o_orderpriority"), F.lit('" cust='), F.col("o_custkey").cast("string"),
        F.lit(" status="), F.col("o_orderstatus"),
    )
    fields = table(spark, sf_dir, "orders").select(kv_fields(line).alias("f"))
    return fields.select(*[F.col("f")[c].alias(c) for c in ("orderkey", "priority", "status", "cust")])


# -- labelled streams --------------------------------------------------------

USER_GROUP = "CASE WHEN user_id < 50 THEN 'low' WHEN user_id < 100 THEN 'mid' ELSE 'high' END"


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a labelled stream: labels, ts, msg."""
    return table(spark, sf_dir, "events").select(
        F.create_map(
            F.lit("app"), F.lit("web"), F.lit("level"), F.col("event_type"), F.lit("pod"), F.expr(USER_GROUP)
        ).alias("labels"),
        "ts",
        "event_id",
        F.concat(F.lit("id="), F.col("event_id").cast("string"), F.lit(" value="), F.col("value").cast("string")).alias("msg"),
    )


@registered(
    "stream_responses",
    f"""
    SELECT {USER_GROUP} AS pod, event_type AS level, epoch_us(ts) * 1000 AS ns,
           'id=' || event_id AS msg, event_id::VARCHAR AS parsed_id
    FROM events
    """,
)
def stream_responses(spark, sf_dir):
    """Saved responses of a label-stream service, read back and parsed per value."""
    events = labelled(spark, sf_dir)
    ns = nanoseconds("ts")
    msg = F.concat(F.lit("id="), F.col("event_id").cast("string"))
    path = scratch_path(spark, "responses")
    to_responses(events, F.col("labels"), ns, msg).write.text(path)
    values = stream_values(
        spark.read.schema("result array<struct<stream: map<string,string>, values: array<array<string>>>>").json(path),
        kv_fields,
    )
    return values.select(
        F.col("labels.pod").alias("pod"), F.col("labels.level").alias("level"), "ns", "msg",
        F.col("parsed.id").alias("parsed_id"),
    )


@registered(
    "select_stream",
    f"SELECT event_id FROM events WHERE event_type = 'error' AND {USER_GROUP} = 'low'",
)
def select_stream(spark, sf_dir):
    return labels.select_stream(labelled(spark, sf_dir), level="error", pod="low").select("event_id")


@registered("label_names", "SELECT DISTINCT unnest(['app', 'level', 'pod']) AS label FROM events")
def label_names(spark, sf_dir):
    return labels.label_names(labelled(spark, sf_dir))


@registered(
    "label_values",
    f"SELECT DISTINCT {USER_GROUP} AS value FROM events",
)
def label_values(spark, sf_dir):
    return labels.label_values(labelled(spark, sf_dir), "pod")


@registered(
    "source_values",
    "SELECT 'lang' AS label, lang AS value FROM documents GROUP BY lang "
    "UNION ALL SELECT 'source', source FROM documents GROUP BY source",
)
def source_values(spark, sf_dir):
    """Label values kept in columns of their own."""
    documents = table(spark, sf_dir, "documents")
    of = lambda c: labels.label_values(documents, c, None).select(F.lit(c).alias("label"), "value")
    return of("lang").unionByName(of("source"))


@registered(
    "labels_rate_10m",
    """
    SELECT time_bucket(INTERVAL 10 MINUTE, ts) AS window_start, event_type AS level,
           count(*) AS n, round(count(*) / 600.0, 9) AS rate
    FROM events GROUP BY 1, 2
    """,
)
def labels_rate_10m(spark, sf_dir):
    events = labelled(spark, sf_dir).withColumn("level", F.col("labels.level"))
    return labels.rate(events, "ts", ["level"]).withColumn("rate", F.round("rate", 9))


@registered(
    "labels_rate_sliding",
    """
    SELECT window_start, event_type AS level, count(*) AS n, round(count(*) / 600.0, 9) AS rate
    FROM (SELECT event_type,
                 time_bucket(INTERVAL 5 MINUTE, ts) - unnest([0, 1]) * INTERVAL 5 MINUTE AS window_start
          FROM events)
    GROUP BY 1, 2
    """,
)
def labels_rate_sliding(spark, sf_dir):
    events = labelled(spark, sf_dir).withColumn("level", F.col("labels.level"))
    return labels.rate(events, "ts", ["level"], slide="5 minutes").withColumn("rate", F.round("rate", 9))
