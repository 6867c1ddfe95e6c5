import json
import random

import pytest
from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F

import sequential
from annalist.functions.records import json_object, kv_fields, record_text, typed_records
from annalist.functions.text import fenced_blocks, header, shake_id, strip
from annalist.operators.assemble import assemble_files, assemble_streams
from annalist.operators.entries import check_all_good, parse_entries, records_of, route
from annalist.plans.ingest import Ingest
from annalist.sources.logs import read_log_lines
from annalist.specs import EntitySpec, FieldSpec, Registry


def random_lines(seed, n, share):
    rng = random.Random(seed)
    opener = "2024-01-01 00:00:0{}.{:03d} | EVENT    | p:f:{} - text {}"
    rest = ["", "  ", "more é", "end\r", "| 2024-01-01", "2024-01-01 no opener", " wide "]
    return [
        opener.format(i % 10, i % 1000, i, i) if rng.random() < share else rng.choice(rest) for i in range(n)
    ]


@pytest.fixture
def small_splits(spark):
    """Tiny file blocks and Arrow batches, so that entries cross both."""
    names = {
        "spark.sql.files.maxPartitionBytes": "900",
        "spark.sql.files.openCostInBytes": "10",
        "spark.sql.execution.arrow.maxRecordsPerBatch": "7",
    }
    old = {k: spark.conf.get(k) for k in names}
    for k, v in names.items():
        spark.conf.set(k, v)
    yield
    for k, v in old.items():
        spark.conf.set(k, v)


def test_files_equal_sequential_rule(spark, folder, small_splits):
    expected = []
    for i, share in enumerate([0.6, 0.1, 0.02, 0.004, 0.0]):
        lines = random_lines(i, 700, share)
        with open(f"{folder}/f{i}.log", "w", newline="") as f:
            f.write("\n".join(lines))
        expected += sequential.entries(lines)
    rows = assemble_files(read_log_lines(spark, folder)).collect()
    assert len({r.run for r in rows}) > 5
    assert sorted(r.text for r in rows) == sorted(expected)


def test_order_of_entries_in_a_file(spark, folder, small_splits):
    lines = random_lines(9, 500, 0.2)
    with open(f"{folder}/a.log", "w", newline="") as f:
        f.write("\n".join(lines))
    rows = assemble_files(read_log_lines(spark, folder)).orderBy("stream", "run", "entry").collect()
    assert [r.text for r in rows] == sequential.entries(lines)


def test_hot_stream_equal_sequential_rule(spark, small_splits):
    rows, expected = [], {}
    for stream, n in (("hot", 900), ("cold", 20), ("noise", 50)):
        lines = random_lines(n, n, 0.0 if stream == "noise" else 0.1)
        rows += [(stream, i // 3, i % 3, line) for i, line in enumerate(lines)]
        expected[stream] = sequential.entries(lines)
    random.Random(1).shuffle(rows)
    df = spark.createDataFrame(rows, "s string, ts long, pos int, msg string")
    got = assemble_streams(df, "s", ["ts", "pos"], "msg").orderBy("stream", "run", "entry").collect()
    for stream, want in expected.items():
        assert [r.text for r in got if r.stream == stream] == want


TEXTS = st.text(alphabet=list("ab `~|-:*=\"\n{}[]19é ") , max_size=40)


@settings(max_examples=15, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(TEXTS, min_size=20, max_size=60))
def test_text_rules_equal_sequential(spark, texts):
    texts = texts + ["```json{}```", "``````", "~~~x~~~```y```", "****** a", "***a***b***", "````a````", "a```b"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = df.select(
        "i", fenced_blocks(F.col("t")).alias("f"), header(F.col("t")).alias("h"),
        kv_fields(F.col("t")).alias("kv"), strip(F.col("t")).alias("s"),
    ).orderBy("i").collect()
    for text, row in zip(texts, got):
        assert row.f == sequential.fenced(text), text
        assert row.h == sequential.header(text), text
        assert row.s == text.strip(), text
        if text.isascii():
            assert row.kv == sequential.key_values(text), text


@settings(max_examples=10, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.tuples(TEXTS, TEXTS, TEXTS), min_size=20, max_size=40))
def test_parse_equal_sequential(spark, parts):
    texts = [f"{a}|{b}|p:f:12 -{c}" for a, b, c in parts] + [f"{a}|{b}{c}" for a, b, c in parts] + ["x", "a|b|p:f:3"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string")
    rows = parse_entries(df).orderBy("i").collect()
    for text, r in zip(texts, rows):
        want = sequential.parsed(text)
        got = None if r.problem else (r.date, r.log_level, r.process_name, r.module_name, r.line_number, r.content)
        assert got == want, text


def test_blocks_as_documented(spark):
    text = '''
    abs
    ```json
    {"a": "b"}
    ```

    and json```{"c":"d"}```

    {"e"" : "f"}
    '''
    row = spark.createDataFrame([(text,)], "t string").select(
        F.transform(fenced_blocks(F.col("t")), json_object).alias("o")
    ).first()
    assert row.o == [{"a": "b"}, {"c": "d"}]


def test_json_objects_are_strict(spark):
    bad = ['{"a":1} x', "{'a':1}", "[1]", "", "null", "1", '{"a":1},{"b":2}', "{"]
    good = {'{"a":1,"a":2}': {"a": "2"}, '{"a":null}': {"a": None}, "{}": {}, '{"x":[1, 2]}': {"x": "[1,2]"}}
    df = spark.createDataFrame([(t,) for t in bad + list(good)], "t string")
    got = {r.t: r.o for r in df.select("t", json_object(F.col("t")).alias("o")).collect()}
    assert {t: got[t] for t in bad} == dict.fromkeys(bad)
    assert {t: got[t] for t in good} == good


SPEC = EntitySpec(
    "Thing",
    (
        FieldSpec("code", str, key=True),
        FieldSpec("n", int),
        FieldSpec("x", float, required=False),
        FieldSpec("ok", bool, required=False),
        FieldSpec("tags", list[str], required=False),
        FieldSpec("note", str, required=False, default="none"),
        FieldSpec("vector", list[float], required=False, width=2),
    ),
    cleaners={"code": F.upper},
)


def typed(spark, *texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return typed_records(df.select("i", json_object(F.col("t")).alias("r")), "r", SPEC, ["i"]).orderBy("i").collect()


def test_records_are_coerced(spark):
    a, b, c, d = typed(
        spark,
        '{"code": "a", "n": "12", "x": 1, "ok": "yes", "tags": ["p"], "extra": 1, "vector": [1, 2]}',
        '{"code": "b", "n": 3.0, "note": null}',
        '{"n": "many", "ok": "maybe"}',
        '{"code": "d", "n": 1, "vector": [1]}',
    )
    assert (a.code, a.n, a.x, a.ok, a.tags, a.note, a.problems) == ("A", 12, 1.0, True, ["p"], "none", [])
    assert (b.n, b.note, b.problems) == (3, None, [])
    assert sorted(c.problems) == ["bad n", "bad ok", "missing code"]
    assert d.problems == ["width of vector"]


def test_record_round_trip(spark):
    rows = spark.createDataFrame(
        [("A", 1, 1.5, True, ["x", "ü\n"], None, [1.0, 2.0]), ("B", 2, None, None, None, "n", None)], SPEC.schema
    )
    line = rows.select(record_text(rows, SPEC).alias("t"))
    first = line.first().t
    assert first.startswith('```json{"code"') and "\n" not in first
    assert json.loads(first[7:-3])["__type__"] == "Thing"
    objects = line.select(F.explode(F.transform(fenced_blocks(F.col("t")), json_object)).alias("r"))
    back = typed_records(objects, "r", SPEC).drop("problems")
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, rows.collect()))


LOG = "\n".join(
    [
        "noise before",
        "2024-01-01 00:00:00.001 | EVENT    | app:save:3 - x=```json{\"code\":\"a\",\"n\":1,\"__type__\":\"Thing\",\"__key__\":\"code\",\"__namespace__\":null}```",
        "2024-01-01 00:00:00.002 | EVENT    | app:save:3 - ```json{\"code\":\"a\",\"n\":2,\"__type__\":\"Thing\"}``` and ```{\"code\":\"b\",\"n\":5,\"__type__\":\"Thing\"}```",
        "2024-01-01 00:00:00.003 | EVENT    | app:topics:9 - ***Topic one***",
        "   a text",
        "",
        "2024-01-01 00:00:00.004 | EVENT    | app:topics:9 - no header",
        "2024-01-01 00:00:00.005 | EVENT    | app:save:zz - broken",
        "2024-01-01 00:00:00.006 | EVENT    | app:save:1 - ```json{oops```",
        "2024-01-01 00:00:00.007 | EVENT    | app:save:1 - ```json{\"__type__\":\"Other\"}```",
        "2024-01-01 00:00:00.008 | EVENT    | app:save:1 - ```json{\"code\":\"c\",\"__type__\":\"Thing\"}```",
    ]
)


def test_ingest_routes_and_repeats(spark, folder):
    with open(f"{folder}/in.log", "w") as f:
        f.write(LOG)
    ingest = Ingest(spark, f"{folder}/root", Registry([SPEC]), buckets=2)
    for _ in range(2):
        ingest.files(f"{folder}/in.log")
        things = ingest.table_of(SPEC).rows().select("code", "n").collect()
        assert sorted(map(tuple, things)) == [("A", 2), ("B", 5)]
        texts = ingest.text_table().rows().collect()
        assert len(texts) == 2 and {t.module_name for t in texts} == {"topics"}
        assert "Topic one" in {t.name for t in texts}
        assert all(len(t.vector) == 64 for t in texts)
    problems = {r.problem for r in ingest.dead_letters().collect()}
    assert problems == {"bad line number", "bad block", "unknown type", "missing n"}


def test_ingest_limit_and_fail_fast(spark, folder):
    with open(f"{folder}/in.log", "w") as f:
        f.write(LOG)
    ingest = Ingest(spark, f"{folder}/root", Registry([SPEC]), buckets=2)
    ingest.files(f"{folder}/in.log", limit=1)
    assert ingest.table_of(SPEC).rows().select("code", "n").collect() == [("A", 1)]
    strict = Ingest(spark, f"{folder}/strict", Registry([SPEC]), fail_fast=True)
    with pytest.raises(ValueError):
        strict.files(f"{folder}/in.log")


def test_check_all_good(spark):
    entries = spark.createDataFrame([("s", 0, 1, "a|b|p:f:1 - x")], "stream string, run long, entry long, text string")
    check_all_good(route(parse_entries(entries), Registry()).dead)


def test_shake_id(spark):
    import hashlib

    got = spark.createDataFrame([("a",), (None,)], "t string").select(shake_id()("t").alias("i")).collect()
    assert got[0].i == "mon" + hashlib.shake_256(b"a").hexdigest(5).upper() and got[1].i is None
