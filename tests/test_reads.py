"""CSV lines, typed reads of stored files, and the guard of questions."""

import pytest
from pyspark.sql import functions as F

from annalist.plans.stores import NotAllowed, check_question, clean_sql, guarded_sql
from annalist.sources.files import read_csv, read_typed
from annalist.specs import EntitySpec, FieldSpec

LINES = 'n,s\n1,a\nbad,b\n3,c,extra\n4,d\n5\n6,"f\ng"\n7,"h ""i"" é"\n'


@pytest.mark.parametrize("multi", [False, True])
def test_bad_lines_are_skipped_alike(spark, tmp_path, multi):
    text = LINES if multi else LINES.replace('6,"f\ng"\n', "")
    (tmp_path / "x.csv").write_text(text)
    rows = read_csv(spark, str(tmp_path / "x.csv"), "n bigint, s string", multi_line=multi)
    want = [(1, "a"), (4, "d"), *([(6, "f\ng")] if multi else []), (7, 'h "i" é')]
    assert sorted(map(tuple, rows.collect())) == want
    assert rows.count() == len(want)
    assert sorted(r.s for r in rows.select("s").collect()) == sorted(s for _, s in want)
    assert sorted(r.n for r in rows.select("n").collect()) == [n for n, _ in want]
    assert rows.filter("s = 'd'").select("n").collect() == [(4,)] and rows.filter("s = 'b'").count() == 0
    assert rows.selectExpr("1 AS one").count() == len(want) and rows.groupBy().agg(F.max("n")).first()[0] == 7
    with pytest.raises(Exception, match="MALFORMED|FAILFAST|malformed"):
        read_csv(spark, str(tmp_path / "x.csv"), "n bigint, s string", skip_bad=False, multi_line=multi).collect()


def test_other_encoding(spark, tmp_path):
    (tmp_path / "x.csv").write_bytes("n,s\n1,é\nx,ü\n2,ß\n".encode("latin-1"))
    rows = read_csv(spark, str(tmp_path / "x.csv"), "n bigint, s string", "ISO-8859-1")
    assert sorted(map(tuple, rows.collect())) == [(1, "é"), (2, "ß")]


def test_typed_reads_keep_values(spark, folder):
    df = spark.createDataFrame(
        [(3, bytearray(b"\xff\xfe\x00a"), 2.5, "7", bytearray(b"ok"), [1, 2], 1e30), (4, None, float("nan"), "x", bytearray(b"\xff"), None, 2.0)],
        "k bigint, raw binary, d double, t string, name binary, list array<int>, big double",
    )
    df.write.parquet(f"{folder}/x.parquet")
    spec = EntitySpec("X", (
        FieldSpec("k", int, key=True), FieldSpec("raw", bytes, required=False), FieldSpec("d", float), FieldSpec("t", int, required=False),
        FieldSpec("name", str, required=False), FieldSpec("list", list[int], required=False), FieldSpec("big", int, required=False), FieldSpec("no", str, required=False, default="-"),
    ))
    rows = read_typed(spark, f"{folder}/x.parquet", spec)
    first, second = sorted(rows.collect(), key=lambda r: r.k)
    assert (bytes(first.raw), first.d, first.t, first.name, first.list, first.big, first.no) == (b"\xff\xfe\x00a", 2.5, 7, "ok", [1, 2], None, "-")
    assert first.problems == ["bad big"]
    assert second.raw is None and second.d != second.d and second.problems == ["bad t", "bad name"]
    plan = rows.filter("k = 3")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(k,3)" in plan.split("PushedFilters")[1]


GOOD = [
    "SELECT * FROM TABLE", "WITH a AS (SELECT id FROM TABLE) SELECT count(*), max(id) FROM a GROUP BY ALL", "SELECT 'x TABLE' AS s, id FROM TABLE -- TABLE parquet.`/x`",
    "SELECT upper(name) AS n, row_number() OVER (ORDER BY id) AS r FROM store WHERE id IN (SELECT max(id) FROM TABLE) AND CURRENT_DATE > '2000-01-01'",
    "SELECT e FROM TABLE LATERAL VIEW explode(array(id, id)) t AS e", "SELECT id FROM TABLE UNION ALL SELECT id + 1 FROM TABLE ORDER BY 1 LIMIT 3",
]
BAD = [
    "SELECT reflect('java.lang.System', 'getProperty', 'user.home') AS x FROM TABLE", "SELECT java_method('java.lang.System', 'exit', 0)", "SELECT * FROM other",
    "SELECT * FROM parquet.`/tmp/x`", "SELECT * FROM TABLE WHERE id = (SELECT max(id) FROM text.`/etc/passwd`)", "WITH a AS (SELECT * FROM csv.`/x`) SELECT * FROM a",
    "SELECT * FROM TABLE WHERE EXISTS (SELECT 1 FROM spark_catalog.default.other)", "SELECT my_own(id) FROM TABLE", "SELECT input_file_name() FROM TABLE",
    "SELECT * FROM range(10)", "SELECT builtin.reflect('a', 'b') FROM TABLE", "SELECT e FROM TABLE LATERAL VIEW java_method('a', 'b') t AS e",
    "SELECT max(id) FILTER (WHERE reflect('a', 'b') = '') FROM TABLE", "SELECT id FROM TABLE JOIN other USING (id)", "SELECT transform(array(1), x -> reflect('a', 'b')) FROM TABLE",
]


@pytest.fixture(scope="module")
def store(spark):
    spark.createDataFrame([(1, "a"), (2, "b")], "id int, name string").createOrReplaceTempView("store")
    spark.range(3).createOrReplaceTempView("other")
    spark.udf.register("my_own", lambda x: x)


@pytest.mark.parametrize("sql", GOOD)
def test_questions_that_are_allowed(spark, store, sql):
    assert guarded_sql(spark, sql, "store").count() > 0


@pytest.mark.parametrize("sql", BAD)
def test_questions_that_are_not(spark, store, sql):
    with pytest.raises(NotAllowed):
        check_question(spark, clean_sql(sql, "store"), "store")


def test_words_in_literals_stay(spark, store):
    assert guarded_sql(spark, "SELECT 'TABLE' AS a, \"CURRENT_DATE\" AS b FROM TABLE LIMIT 1", "store").first() == ("TABLE", "CURRENT_DATE")
    assert clean_sql("SELECT `TABLE`, 'it\\'s TABLE' /* TABLE */ FROM TABLE", "v") == "SELECT `TABLE`, 'it\\'s TABLE' /* TABLE */ FROM `v`"
