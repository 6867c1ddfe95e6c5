import pytest
from pyspark.sql import functions as F

from annalist.operators.merge import keep_last, merge, merge_fields, upsert
from annalist.plans.stores import ColumnarStore, EntityStore, VectorStore, clean_sql, stores_for
from annalist.sources.files import list_files, read_dataset, read_if_exists, write_extract
from annalist.sources.tables import ConcurrentWrite, Manifest, VersionedTable, union_all
from annalist.specs import EntitySpec, FieldSpec, text_entry

ROW = "k string, x int, s int"


def rows(df, *columns):
    return sorted(map(tuple, df.select(*columns).collect()), key=str)


def test_keep_last_with_null_key_and_ties(spark):
    df = spark.createDataFrame([("a", 1, 1), ("a", 2, 2), (None, 3, 1), (None, 4, 2), ("b", 5, 0)], ROW)
    assert rows(keep_last(df, ("k",), "s"), "k", "x") == sorted([("a", 2), (None, 4), ("b", 5)], key=str)


def test_hot_key_combines_before_the_shuffle(spark):
    df = spark.range(10_000).select(F.lit("hot").alias("k"), F.col("id").alias("s"))
    plan = keep_last(df, ("k",), "s")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("partial_max_by") == 1
    assert keep_last(df, ("k",), "s").first()["s"] == 9_999


def test_merge_and_upsert_differ_on_repeated_keys(spark):
    old = spark.createDataFrame([("a", 1, 1), ("b", 2, 1)], ROW)
    new = spark.createDataFrame([("a", 8, 1), ("a", 9, 2), ("c", 7, 1)], ROW)
    assert rows(merge(old, new, ("k",), "s"), "k", "x") == [("a", 9), ("b", 2), ("c", 7)]
    assert rows(upsert(old, new, "k"), "k", "x") == [("a", 8), ("a", 9), ("b", 2), ("c", 7)]


def test_field_merge_tells_null_from_absent(spark):
    old = spark.createDataFrame([("a", 1, "p"), ("b", 2, "q")], "k string, x int, y string")
    new = spark.createDataFrame(
        [("a", None, None, ["x"], 1), ("c", 5, None, ["x"], 1), ("b", 7, None, ["x"], 1), ("b", None, "z", ["y"], 2)],
        "k string, x int, y string, present array<string>, s int",
    )
    got = rows(merge_fields(old, new, ("k",), "s", "present"), "k", "x", "y")
    assert got == [("a", None, "p"), ("b", 7, "z"), ("c", 5, None)]


def test_table_merge_is_idempotent_and_versioned(spark, folder):
    t = VersionedTable(spark, f"{folder}/t", ("k",), buckets=3)
    assert t.df() is None
    batch = spark.createDataFrame([("a", 1, 1), ("a", 2, 2), (None, 3, 1)], ROW)
    t.merge(batch, "s")
    first = rows(t.rows(), "k", "x")
    assert first == sorted([("a", 2), (None, 3)], key=str)
    t.merge(batch, "s")
    assert rows(t.rows(), "k", "x") == first
    t.merge(spark.createDataFrame([(None, 9, 1), ("z", 1, 1)], ROW), "s")
    assert rows(t.rows(), "k", "x") == sorted([("a", 2), (None, 9), ("z", 1)], key=str)
    assert rows(t.df(1), "k", "x") == first
    t.merge(spark.createDataFrame([], ROW), "s")
    assert t.versions() == [1, 2, 3]
    assert t.expire() == [1, 2] and t.rows().count() == 3


def written_by(table, version):
    """Rows in the files of one commit."""
    return sum(table.spark.read.parquet(f"{table.path}/data/{n}").count() for n in table._names(f"{table.path}/data") if n.startswith(f"_version={version}-"))


def test_a_merge_writes_only_its_batch(spark, folder):
    t = VersionedTable(spark, f"{folder}/t", ("id",), buckets=8)
    t.merge(spark.range(20_000).select("id", F.lit("old").alias("v")))
    t.merge(spark.range(0, 20_000, 500).select("id", F.lit("new").alias("v")))
    assert written_by(t, 2) == 40 and t.versions() == [1, 2]
    assert rows(t.rows().groupBy("v").count(), "v", "count") == [("new", 40), ("old", 19_960)]
    # A bucket that the batch does not touch is read as it is.
    t.merge(spark.range(1).select("id", F.lit("one").alias("v")))
    assert sorted(len(f) for f in t.manifest().partitions.values())[-1] == 3
    assert rows(t.lookup(spark.range(2)), "id", "v") == [(0, "one"), (1, "old")]
    before = rows(t.rows(), "id", "v")
    t.compact()
    assert {len(f) for f in t.manifest().partitions.values()} == {1} and rows(t.rows(), "id", "v") == before
    assert t.expire() == [1, 2, 3] and rows(t.rows(), "id", "v") == before


def test_upserts_and_removals_append_marks(spark, folder):
    t = VersionedTable(spark, f"{folder}/t", ("id",), buckets=2)
    kind = "id string, v int"
    t.upsert(spark.createDataFrame([("a", 1), ("", 2), (None, 3), ("b", 4), ("b", 5)], kind))
    t.upsert(spark.createDataFrame([("", 20), ("", 21), (None, 30), ("b", 6)], kind))
    assert rows(t.rows(), "id", "v") == sorted([("a", 1), ("", 20), ("", 21), (None, 30), ("b", 6)], key=str)
    t.remove(spark.createDataFrame([("",), (None,), ("unknown",)], "id string"))
    assert rows(t.rows(), "id", "v") == [("a", 1), ("b", 6)]
    assert written_by(t, 3) == 3
    t.upsert(spark.createDataFrame([("", 9)], kind))
    for _ in range(2):
        assert rows(t.rows(), "id", "v") == sorted([("a", 1), ("b", 6), ("", 9)], key=str)
        t.compact()


def test_many_batches_fold(spark, folder, monkeypatch):
    monkeypatch.setattr("annalist.sources.tables.FOLD", 3)
    t = VersionedTable(spark, f"{folder}/t", ("k",), buckets=1)
    for n in range(5):
        t.merge(spark.createDataFrame([("a", n, n), (f"b{n}", n, n)], ROW), batch=("q", n))
    assert rows(t.rows(), "k", "x") == [("a", 4), *[(f"b{n}", n) for n in range(5)]]
    assert max(len(f) for f in t.manifest().partitions.values()) < 3 and t.manifest().batches == {"q": 4}


def test_stored_sequence_over_appended_batches(spark, folder):
    t = VersionedTable(spark, f"{folder}/t", ("k",), buckets=2)
    batch = lambda *r: spark.createDataFrame(r, ROW)
    moment = F.lpad(F.col("s").cast("string"), 5, "0")
    t.merge(batch(("a", 1, 5), ("b", 1, 1)), "s", stored_seq=moment)
    t.merge(batch(("a", 2, 4), ("b", 2, 1), ("c", 3, 9)), "s", stored_seq=moment)
    t.merge(batch(("c", 4, 8)), "s", stored_seq=moment)
    for _ in range(2):
        assert rows(t.rows(), "k", "x") == [("a", 1), ("b", 2), ("c", 3)]
        t.compact()


def test_repeated_batch_is_ignored_and_conflict_raises(spark, folder):
    t = VersionedTable(spark, f"{folder}/t", ("k",), buckets=2)
    t.merge(spark.createDataFrame([("a", 1, 1)], ROW), "s", batch=("q", 0))
    t.merge(spark.createDataFrame([("a", 2, 1)], ROW), "s", batch=("q", 0))
    assert rows(t.rows(), "k", "x") == [("a", 1)]
    with pytest.raises(ConcurrentWrite):
        t._publish(Manifest(1, t.schema(), ["bucket"], 2))


def test_schema_must_match(spark, folder):
    t = VersionedTable(spark, f"{folder}/t", ("k",), buckets=2)
    t.merge(spark.createDataFrame([("a", 1, 1)], ROW))
    with pytest.raises(ValueError):
        t.merge(spark.createDataFrame([("a", 1)], "k string, x int"))
    with pytest.raises(ValueError):
        union_all([spark.range(1), spark.range(1).withColumn("x", F.lit(1))])


def test_empty_table_from_schema(spark, folder):
    spec = EntitySpec("T", (FieldSpec("k", str, key=True), FieldSpec("n", int)))
    t = VersionedTable(spark, f"{folder}/t", spec.keys, buckets=2)
    t.create(spec.schema)
    assert t.rows().count() == 0 and t.rows().columns == ["k", "n"]
    t.merge(spark.createDataFrame([("a", 1)], "k string, n long"))
    assert t.rows().count() == 1


def test_read_if_exists_hides_only_missing_paths(spark, folder):
    assert read_if_exists(spark, f"{folder}/none.parquet") is None
    with open(f"{folder}/broken.parquet", "w") as f:
        f.write("this is no parquet file")
    with pytest.raises(Exception):
        read_if_exists(spark, f"{folder}/broken.parquet").count()
    write_extract(spark.range(3), f"{folder}/x.csv")
    assert read_dataset(spark, f"{folder}/x.csv", "id long").count() == 3
    assert list_files(spark, folder, "csv").count() >= 1


SPEC = EntitySpec(
    "Hero", (FieldSpec("name", str, key=True), FieldSpec("power", int), FieldSpec("team", str)), namespace="tales"
)
HEROES = [("ann", 5, "red"), ("bob", 9, "blue"), ("cid", 7, "red")]
HERO = "name string, power long, team string"


def test_columnar_store(spark, folder):
    store = ColumnarStore(spark, folder, SPEC, buckets=2)
    assert store.load().count() == 0
    store.add(spark.createDataFrame(HEROES, HERO))
    planned = store.add(spark.createDataFrame([("ann", 1, "red")], HERO), plan=True)
    assert dict(rows(planned, "name", "power"))["ann"] == 1
    assert dict(rows(store.load(), "name", "power"))["ann"] == 5
    assert store.query("SELECT count(*) AS n FROM Hero").first().n == 3
    assert store.fetch(2).count() == 2
    assert sorted(store.enums()["team"]) == ["blue", "red"] and "power" not in store.enums()
    sql = "```sql\nSELECT name FROM TABLE WHERE power > 6 AND CURRENT_DATE > DATE'2020-01-01' ORDER BY power DESC;\n```"
    assert [r.name for r in store.ask_sql(sql).collect()] == ["bob", "cid"]
    assert store.ask_sql("SELECT * FROM TABLE", limit=1).count() == 1


@pytest.mark.parametrize("bad", ["DROP TABLE x", "SELECT 1; DROP TABLE x", "CREATE TABLE t (a INT)", "SELECT 1) UNION (SELECT"])
def test_ad_hoc_sql_runs_only_queries(spark, folder, bad):
    store = ColumnarStore(spark, folder, SPEC, buckets=2)
    with pytest.raises(Exception):
        store.ask_sql(bad).collect()


def test_clean_sql():
    assert clean_sql("```SQL\nSELECT CURRENT_DATE FROM TABLE\n```", "v") == "SELECT CURRENT_DATE() FROM `v`"


def test_ingest_file_into_store(spark, folder):
    path = f"{folder}/heroes.json"
    spark.createDataFrame([("dan", "3", "red"), ("eve", "lots", "red")], "name string, power string, team string").write.json(path)
    store = ColumnarStore(spark, folder, SPEC, buckets=2)
    bad = store.ingest(path)
    assert rows(store.load(), "name", "power") == [("dan", 3)]
    assert [r.problems for r in bad.collect()] == [["bad power"]]


def test_entity_store(spark, folder):
    store = EntityStore(spark, folder, SPEC, buckets=2)
    store.insert(spark.createDataFrame(HEROES, HERO))
    store.upsert(spark.createDataFrame([("ann", 6, None), ("new", 1, "red")], HERO))
    assert rows(store.get("ann"), "name", "power", "team") == [("ann", 6, "red")]
    assert store.get("nobody").count() == 0
    got = store.fetch(" \"ann\" ,'bob',nobody\n")
    assert sorted(rows(got, "key", "power"), key=str) == [("ann", 6), ("bob", 9), ("nobody", None)]
    assert rows(store.exists("ann,nobody"), "key") == [("ann",)]


def test_vector_store(spark, folder):
    spec = text_entry("Topics", width=32)
    columnar, vector, entity = stores_for(spark, folder, spec)
    texts = spark.createDataFrame(
        [("n1", "red apples and pears"), ("n2", "green frogs jump"), ("n1", "red apples again")], "name string, text string"
    )
    planned = vector.add(texts, plan=True)
    assert planned.count() == 3 and vector.load().count() == 0
    vector.add(texts)
    vector.add(texts.filter("name = 'n2'"))
    assert rows(vector.load(), "id") == [("n1",), ("n1",), ("n2",)]
    found = vector.search("green frogs jump", limit=2).collect()
    assert found[0].id == "n2" and abs(found[0]._distance) < 1e-6
    assert vector.query("SELECT count(DISTINCT doc_id) AS n FROM dataset").first().n == 2
    many = vector.search_many(spark.createDataFrame([(1, "frogs"), (2, "red apples again")], "q long, t string"), "t", "q", 1)
    assert sorted((r.query_id, r.text) for r in many.collect()) == [(1, "green frogs jump"), (2, "red apples again")]
