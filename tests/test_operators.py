import random

import pytest
from pyspark.sql import functions as F

from annalist.functions import text as tx
from annalist.functions.html import elements
from annalist.functions.user import map_parallel, value_parser
from annalist.operators import chunks, labels, lookup, prep, shapes
from annalist.operators.filters import Query
from annalist.operators.profile import enum_lists
from annalist.operators.spaces import Space, replace_window, space_view, store_catalog
from annalist.sources.tables import VersionedTable
from annalist.specs import EntitySpec, FieldSpec, Registry, text_entry


def rows(df, *columns):
    return sorted(map(tuple, df.select(*columns).collect()), key=str)


# -- specs ------------------------------------------------------------------


def test_specs():
    base = text_entry("Base")
    assert base.keys == ("name",) and base.schema["vector"].metadata["fixed_size_length"] == 1536
    topic = base.derive("Topic", [FieldSpec("vector", list[float], required=False, width=8), FieldSpec("uri", str)])
    assert topic.columns == ("name", "text", "doc_id", "id", "vector", "uri")
    nested = EntitySpec("N", (FieldSpec("k", int, key=True), FieldSpec("inner", topic), FieldSpec("a", list[str])))
    assert nested.schema["inner"].dataType == topic.schema
    assert nested.schema["a"].dataType.simpleString() == "array<string>"
    assert Registry([base]).get(None, "Base") is base and Registry().get("x", "y") is None
    assert base.full_name == "default_Base"


# -- filters and shapes --------------------------------------------------------


def test_filters_reach_the_scan(spark, sf):
    df = Query(spark.read.parquet(f"{sf}/lineitem.parquet")).where(l_returnflag="R").isin(l_linenumber=[1, 2]).select(["l_orderkey"])
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(l_returnflag,R)" in plan and "In(l_linenumber" in plan
    assert "l_comment" not in plan and "l_tax" not in plan


@pytest.fixture(scope="module")
def skewed(spark):
    """One key holds a third of all rows."""
    rng = random.Random(4)
    data = [(i, "hot" if i % 3 == 0 else f"k{rng.randrange(40)}", rng.choice("abc"), rng.randrange(100)) for i in range(3000)]
    return spark.createDataFrame(data, "id long, k string, v string, x int").repartition(6).cache(), data


def test_last_n_each_limits_before_the_shuffle(spark, skewed):
    df, data = skewed
    got = shapes.last_n_each(df, "k", "x", 2, "id")
    assert "WindowGroupLimit" in got._jdf.queryExecution().executedPlan().toString()
    want = []
    for key in {k for _, k, _, _ in data}:
        mine = sorted(((x, i) for i, k, _, x in data if k == key), reverse=True)[:2]
        want += [(key, i) for _, i in mine]
    assert rows(got, "k", "id") == sorted(want, key=str)


def test_mode_and_counts_with_a_hot_key(spark, skewed):
    df, data = skewed
    count = {}
    for _, k, v, _ in data:
        count.setdefault(k, {}).setdefault(v, 0)
        count[k][v] += 1
    want = {k: min(c, key=lambda v: (-c[v], v)) for k, c in count.items()}
    assert dict(rows(prep.group_mode(df, "k", "v"), "k", "mode")) == want
    attached = prep.with_group_count(df, "k", "x")
    assert attached.count() == len(data)
    assert rows(attached.filter("k = 'hot'").select("n").distinct(), "n") == [(1000,)]
    assert shapes.largest_group(df, "k", "id").count() == 1000


def test_group_counts_skip_nulls(spark):
    df = spark.createDataFrame([("a", 1), ("a", None), (None, 1), ("b", None)], "k string, x int")
    assert rows(prep.group_counts(df, "k", "x"), "k", "n") == [("a", 1), ("b", 0)]
    assert rows(prep.group_mode(df, "k", "x"), "k", "mode") == [("a", 1)]
    assert prep.group_profile(df.filter("k is not null"), "k", "x", "k", {"m": "x"}).count() == 2


def test_numbered_is_a_total_order(spark, skewed):
    df, data = skewed
    got = prep.numbered(df, ["x", "id"]).select("x", "id", "row_index").collect()
    want = {(x, i): n for n, (x, i) in enumerate(sorted((x, i) for i, _, _, x in data))}
    assert {(r.x, r.id): r.row_index for r in got} == want


def test_samples_repeat(spark, skewed):
    df, data = skewed
    a, b = (sorted(r.id for r in prep.hash_share(df, ["id"], 0.2, 5).collect()) for _ in range(2))
    assert a == b and 400 < len(a) < 800
    choices = spark.createDataFrame([(i, f"c{i}") for i in range(7)], "i long, c string")
    given = prep.assign_from(df, ["id"], choices, "i", "c", "given")
    assert given.count() == len(data) and given.select("given").distinct().count() == 7


def test_sorted_head(spark):
    df = spark.createDataFrame([(i, None if i % 2 else i) for i in range(20)], "i int, x int")
    assert [r.i for r in prep.sorted_head(df, [F.col("i")], 10, 3).collect()] == [0, 2, 4]


def test_join_dimension_twice(spark):
    zones = spark.createDataFrame([(1, "A"), (2, "B")], "id int, zone string")
    trips = spark.createDataFrame([(1, 2), (2, 2), (3, 1)], "pick int, off int")
    both = prep.join_dimension(prep.join_dimension(trips, zones, "pick", "id", "_pick"), zones, "off", "id", "_off")
    assert rows(both, "zone_pick", "zone_off") == [("A", "B"), ("B", "B")]


# -- profiling and lookup --------------------------------------------------------


def test_enums(spark):
    data = [(f"u{i}", "ab"[i % 2] if i % 5 else None, "é" * 60, None, i) for i in range(300)]
    df = spark.createDataFrame(data, "many string, few string, wide string, none string, num int")
    assert set(enum_lists(df)) == {"few"}  # 'é' takes two bytes, so wide has 120
    assert set(enum_lists(df)["few"]) == {"a", "b", None}
    assert set(enum_lists(df, threshold=301, omit=["few"])) == {"many"}
    assert enum_lists(df, threshold=3) == {}
    assert set(enum_lists(df, max_length=120, threshold=4)) == {"few", "wide"}


def test_lookup(spark):
    table = spark.createDataFrame([("a", 1), ("it's", 2)], "name string, n int")
    keys = lookup.literal_keys(spark, "  'a'\n, \"it's\" ,b,a")
    got = lookup.fetch(keys, table, "name")
    assert rows(got, "key", "n") == sorted([("a", 1), ("it's", 2), ("b", None)], key=str)
    assert {r.key for r in lookup.exists(keys, table, "name").collect()} == {"a", "it's"}


# -- text expressions ------------------------------------------------------------


def test_clean_up_expressions(spark):
    df = spark.createDataFrame([("12%", "2,243", "-", "['x', 'y']", 0, "Hank_3", 'a"b', list(range(200)))], "p string, n string, d string, l string, c int, u string, q string, a array<int>")
    r = df.select(
        tx.number(F.col("p")).alias("p"), tx.number(F.col("n")).alias("n"), tx.sentinel(F.col("d")).alias("d"),
        tx.first_of_list_literal(F.col("l")).alias("l"), tx.as_list(F.col("p")).alias("none"),
        tx.code_label(F.col("c"), ["A", "B"]).alias("c"), tx.before(F.col("u"), "_").alias("u"),
        tx.without(F.col("q"), '"').alias("q"), tx.every_nth(F.col("a")).alias("a"),
        tx.plain_title(F.lit("It's: 1é")).alias("t"),
    ).first()
    assert (r.p, r.n, r.d, r.l, r.none, r.c, r.u, r.q) == (12.0, 2243.0, "-1", "x", None, "Unknown", "Hank", "ab")
    assert r.a == list(range(200))[::10][:10] and r.t == "Its 1"
    assert tx.snake_names(["profileName", "review/score", "User_id", "Title"]) == ["profile_name", "review_score", "user_id", "title"]


def test_user_functions(spark):
    df = spark.range(100).repartition(3)
    out = map_parallel(df, lambda pdf: pdf.assign(y=pdf["id"] * 2), "id long, y long")
    assert out.agg(F.sum("y")).first()[0] == 9900
    parsed = spark.createDataFrame([("3",), (None,)], "t string").select(value_parser(int, "long")(F.col("t")).alias("n"))
    assert rows(parsed, "n") == sorted([(3,), (None,)], key=str)


# -- pages -----------------------------------------------------------------------

PAGE = """<html><script>var t="</p>";</script><h2>[Illustration] Jack and Jill</h2>
<p>short</p><p></p><p>%s<b>bold</b> &amp; more<h2>no marker</h2><p>%s</p><div><p>%s</div>
<h2>x]Other Story</h2><p>%s</p>""" % tuple(c * 60 for c in "abcd")


def test_elements():
    found = elements(PAGE, frozenset(["p"]))
    assert [t[:6] for _, t in found] == ["short", "", "aaaaaa", "bbbbbb", "cccccc", "dddddd"]
    assert found[2][1].endswith("bold & more")
    nested = elements("<div><p>a<p>b</p></div><p>c</p>", frozenset(["p"]), close_paragraphs=False)
    assert nested == [("p", "ab"), ("p", "b"), ("p", "c")]
    assert elements(None, frozenset(["p"])) is None


def test_header_chunks(spark):
    pages = spark.createDataFrame([(1, PAGE), (2, "<p>%s</p>" % ("z" * 60)), (3, None)], "id long, html string")
    got = chunks.header_chunks(pages, "id", "html").collect()
    # The short paragraph counts, the empty one does not; a header without marker changes nothing.
    assert sorted((r.name, r.text[0]) for r in got) == [
        ("-Jack-and-Jill-2", "a"), ("-Jack-and-Jill-3", "b"), ("-Jack-and-Jill-4", "c"), ("Other-Story-1", "d"),
    ]


def test_paragraphs(spark):
    pages = spark.createDataFrame([(1, "<p>a</p><p>b</p>"), (2, None)], "id long, html string")
    assert rows(chunks.paragraphs(pages, "html", ["id"]), "id", "position", "text") == [(1, 0, "a"), (1, 1, "b")]
    assert rows(pages.select("id", chunks.page_text(F.col("html")).alias("t")), "id", "t") == [(1, "a\nb"), (2, None)]
    keyed = chunks.numbered_paragraphs(pages, "html", F.lit("Hank"))
    assert rows(keyed, "entity_key") == [("Hank_0",), ("Hank_1",)]


# -- spaces and labels --------------------------------------------------------------


def test_spaces(spark, sf, folder):
    events = spark.read.parquet(f"{sf}/events.parquet")
    space = Space("recent", date_from="2024-01-05", metadata={"event_type": "click"})
    view = space_view(events, space, "ts")
    assert "PushedFilters: [IsNotNull(" in view._jdf.queryExecution().executedPlan().toString()
    assert spark.table("recent").count() == view.count() > 0
    dated = VersionedTable(spark, f"{folder}/columnar/v0/web/events", ("event_id",), partition_by=("event_date",))
    replace_window(dated, events, "ts")
    before = dated.rows().count()
    day = events.filter(F.to_date("ts") == "2024-01-03").limit(1)
    replace_window(dated, day, "ts")
    gone = events.filter(F.to_date("ts") == "2024-01-03").count() - 1
    assert dated.rows().count() == before - gone
    assert rows(store_catalog(spark, folder), "mode", "namespace", "name") == [("columnar", "web", "events")]


def test_labels(spark):
    df = spark.createDataFrame([({"pod": "a", "app": "x"}, "m1"), ({"pod": "b"}, "m2")], "labels map<string,string>, msg string")
    assert rows(labels.select_stream(df, pod="b"), "msg") == [("m2",)]
    assert rows(labels.label_names(df), "label") == [("app",), ("pod",)]
    assert rows(labels.label_values(df, "app"), "value") == [("x",)]
