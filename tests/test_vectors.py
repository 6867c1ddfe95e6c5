import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from annalist.functions.vectors import HashingEmbedder, cosine_distance, squared_l2, with_vectors
from annalist.operators.blocks import Near, pair_distance
from annalist.operators.cell_join import Rings, _class_of, _from_pivots, cell_join
from annalist.operators.nearest import ClusteredIndex, nearest, nearest_join
from annalist.plans.stores import VectorStore
from annalist.specs import text_entry


@pytest.fixture(scope="module")
def cloud():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(400, 8)).astype(np.float32)
    x[10] = x[200] = x[399]  # equal vectors
    return x


@pytest.fixture(scope="module")
def base(spark, cloud):
    rows = [(i, [float(v) for v in row], f"text {i}") for i, row in enumerate(cloud)]
    rows += [(1000, None, "no vector"), (1001, [1.0], "short vector")]
    return spark.createDataFrame(rows, "id long, vector array<float>, text string").repartition(5).cache()


def brute(x, q, k, metric="l2sq", skip=None):
    x, q = x.astype(float), q.astype(float)
    d = ((x - q) ** 2).sum(1)
    if metric == "l2":
        d = np.sqrt(d)
    if metric == "cosine":
        d = 1 - x @ q / np.linalg.norm(x, axis=1) / np.linalg.norm(q)
    order = [i for i in np.lexsort((np.arange(len(x)), np.round(d, 12))) if i != skip]
    return order[:k], d


@pytest.mark.parametrize("metric", ["l2sq", "l2", "cosine"])
def test_nearest_equals_brute_force(spark, base, cloud, metric):
    got = nearest(base, cloud[10].tolist(), 6, metric=metric).collect()
    want, d = brute(cloud, cloud[10], 6, metric)
    assert sorted(r.id for r in got) == sorted(want)
    assert [r._distance for r in got] == pytest.approx(sorted(d[want]), abs=1e-9)
    assert got[0].text.startswith("text")


def test_ties_go_to_the_smaller_id(base, cloud):
    got = nearest(base, cloud[399].tolist(), 2).collect()
    assert [r.id for r in got] == [10, 200]


@pytest.mark.parametrize("tile_bytes", [1 << 20, 8 * 8 * 100])
def test_nearest_join_equals_brute_force(spark, base, cloud, tile_bytes):
    queries = base.filter("id < 1000")
    got = nearest_join(queries, base, 3, exclude_self=True, tile_bytes=tile_bytes).collect()
    assert len(got) == 1200
    for q in (0, 10, 57, 399):
        mine = sorted((r.rank, r.id) for r in got if r.query_id == q)
        assert [i for _, i in mine] == brute(cloud, cloud[q], 3, skip=q)[0]


@pytest.mark.parametrize("metric", ["l2sq", "l2", "cosine"])
def test_cell_join_equals_brute_force(spark, clusters, metric):
    """Far more queries than may be sent; many copies of one vector, zeros, large and unusable numbers among the rows."""
    x = clusters.copy().astype(float)
    x[:400] = x[7]
    x[500:520] = 0
    x[600] *= 1e30
    rows = [(f"r{i:04d}", v.tolist(), i) for i, v in enumerate(x)]
    odd = [("none", None, 0), ("short", [1.0], 0), ("nan", [float("nan")] * 16, 0), ("null", [None] * 16, 0)]
    base = spark.createDataFrame(rows + odd, "name string, v array<double>, q int").repartition(3)
    got = nearest_join(base, base, 4, "name", "v", "name", "v", metric, True, ("q",), tile_bytes=16 * 8 * 60)
    assert got.columns == ["query_id", "name", "_distance", "q", "rank"]
    found = {}
    for r in got.collect():
        found.setdefault(r.query_id, {})[r.rank] = (r.name, r._distance, r.q)
    assert len(found) == 1200
    for i in range(0, 1200, 7):
        gap = x - x[i]
        d = (gap * gap).sum(1)
        if metric == "l2":
            d = np.sqrt(d)
        if metric == "cosine":
            norms = np.linalg.norm(x, axis=1) * np.linalg.norm(x[i])
            d = 1 - x @ x[i] / np.where(norms == 0, 1, norms)
        d[i] = np.inf
        mine = [found[f"r{i:04d}"][k] for k in (1, 2, 3, 4)]
        assert [m[1] for m in mine] == pytest.approx(np.sort(d)[:4], rel=1e-9, abs=1e-12)
        assert all(m[1] == pytest.approx(d[m[2]], rel=1e-9, abs=1e-12) and m[0] == f"r{m[2]:04d}" and m[2] != i for m in mine)
        assert len({m[2] for m in mine}) == 4
    if metric != "cosine":  # equal distances: the smaller ids
        assert [found["r0399"][k][2] for k in (1, 2, 3, 4)] == [0, 1, 2, 3]


def test_cell_join_returns_few_rows_beyond_the_answer(spark):
    x = np.random.default_rng(4).normal(size=(1500, 24))  # distances that hardly differ rule out no ring
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<double>").repartition(3)
    schema = StructType([StructField("query_id", LongType()), StructField("id", LongType()), StructField("_distance", DoubleType())])
    found = cell_join(rows, rows, 3, 24, "l2sq", True, 24 * 8 * 50, schema).toPandas()
    assert len(found) < 30 * 1500  # three rows out of each of 60 rings and more before
    best = found.drop_duplicates(["query_id", "id"]).sort_values(["query_id", "_distance", "id"]).groupby("query_id").head(3)
    for i in range(0, 1500, 100):
        assert best[best["query_id"] == i]["id"].tolist() == list(brute(x, x[i], 3, skip=i)[0])


@pytest.mark.parametrize("metric", ["l2sq", "l2", "cosine"])
def test_rows_within_a_bound(metric):
    rng = np.random.default_rng(6)
    x, q = rng.normal(size=(9000, 5)), rng.normal(size=(40, 5))
    x[8990], x[8991], q[39] = 1e200, 0, 0  # overflows, and vectors of zeros
    all_ = np.stack([pair_distance(x, np.broadcast_to(v, x.shape), metric) for v in q])
    for reach in (0.0, 0.6, 1.4, np.inf):
        rows, cols = Near(x, metric).within(q, 4, np.full(len(q), reach))
        got = set(zip(cols.tolist(), rows.tolist()))
        most = {"l2sq": reach**2, "l2": reach, "cosine": reach**2 / 2}[metric]
        for i in range(len(q)):
            wanted = [j for j in np.argsort(all_[i], kind="stable")[:4].tolist() if all_[i, j] <= most]
            assert all((i, j) in got for j in wanted)
    rows, cols = Near(x, metric).within(x[:5], 4, np.zeros(5))
    assert {(i, i) for i in range(5)} <= set(zip(cols.tolist(), rows.tolist()))


def test_cell_join_of_odd_sides(spark):
    rows = lambda *r: spark.createDataFrame(list(r), "id long, vector array<double>")
    two = rows((1, [0.0, 0.0]), (1, [1.0, 0.0]), (None, [2.0, 0.0]))
    assert nearest_join(two, rows(), 2, tile_bytes=1).count() == 0
    assert nearest_join(two, rows((5, None), (6, [1.0])), 2, tile_bytes=1).count() == 0
    assert nearest_join(rows(), two, 2, tile_bytes=1).count() == 0
    got = nearest_join(rows((9, [0.1, 0.0])), two, 5, tile_bytes=1).orderBy("rank").collect()
    assert [r.id for r in got] == [1, 1, None]
    wide = rows((3, [1e200, 0.0]), (4, [-1e200, 1.0]), (8, [0.0, 3.0]))
    got = nearest_join(wide, wide, 1, exclude_self=True, tile_bytes=1).collect()
    assert len(got) == 3


def test_rings_are_pruned():
    rng = np.random.default_rng(4)
    pivots = rng.normal(size=(8, 3)) * 100
    x = pivots[rng.integers(0, 8, 4000)] + rng.normal(size=(4000, 3))
    distance, slack = _from_pivots(x, pivots)
    cell, own = distance.argmin(axis=1), distance.min(axis=1)
    grade = _class_of(own, 100.0)
    stats = [(c, g, int(m.sum()), own[m].min(), own[m].max()) for c in range(8) for g in range(64) if (m := (cell == c) & (grade == g)).any()]
    rings = Rings(stats, 8, 100)
    assert rings.parts.sum() >= 40 and len(rings.cell) > 8
    query, ring = rings.may_hold(distance, slack, np.full(4000, 0.5))
    assert len(query) < 4000 * len(rings.cell) / 4
    where = rings.of[cell, grade]
    held = set(zip(query.tolist(), ring.tolist()))
    for i in range(0, 4000, 40):
        for j in np.flatnonzero(((x - x[i]) ** 2).sum(1) <= 0.25):
            assert (i, int(where[j])) in held


def test_distance_expressions(spark, cloud):
    df = spark.createDataFrame([(cloud[0].tolist(), cloud[1].tolist())], "a array<float>, b array<float>")
    r = df.select(squared_l2(F.col("a"), F.col("b")).alias("s"), cosine_distance(F.col("a"), F.col("b")).alias("c")).first()
    a, b = cloud[0].astype(float), cloud[1].astype(float)
    assert r.s == pytest.approx(((a - b) ** 2).sum())
    assert r.c == pytest.approx(1 - a @ b / np.linalg.norm(a) / np.linalg.norm(b))


def test_clustered_index(spark, base, cloud, folder):
    good = base.filter("id < 1000")
    index = ClusteredIndex(spark, f"{folder}/ix").build(good, cells=12)
    assert index.table.rows().count() == 400
    again = ClusteredIndex(spark, f"{folder}/ix")
    exact = again.search(cloud[5].tolist(), 10, probes=12).collect()
    assert [r.id for r in exact] == brute(cloud, cloud[5], 10)[0]
    few = again.search(cloud[5].tolist(), 10, probes=4)
    assert few.count() == 10
    plan = again.table.df().filter(F.col("cell").isin([1, 2]))._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [cell" in plan or "PartitionFilters: [isnotnull(cell" in plan


def test_embedding_runs_once_and_is_deterministic(spark):
    df = spark.createDataFrame([("a", "one two two"), ("b", None), ("c", "two one two")], "id string, text string")
    out = with_vectors(df, "text", lambda: HashingEmbedder(16), "id").orderBy("id").collect()
    assert out[0].vector == out[2].vector
    assert np.linalg.norm(out[0].vector) == pytest.approx(1, abs=1e-6)
    assert set(out[1].vector) == {0.0}
    assert HashingEmbedder(16)([]).shape == (0, 16)


@pytest.fixture(scope="module")
def clusters():
    """1200 vectors around 20 places, as embeddings lie."""
    rng = np.random.default_rng(8)
    return (rng.normal(size=(20, 16))[rng.integers(0, 20, 1200)] * 3 + rng.normal(size=(1200, 16))).astype(np.float32)


def recall(index, x, live, **options):
    found = 0
    for q in range(0, 1200, 80):
        want = {live[i] for i in brute(x[live], x[q], 10)[0]}
        found += len(want & {r.id for r in index.search(x[q].tolist(), 10, columns=(), **options).collect()})
    return found / 150


def test_index_grows_and_splits(spark, clusters, folder):
    rows = lambda ids, x=clusters: spark.createDataFrame([(int(i), x[i].tolist(), 7) for i in ids], "id long, vector array<float>, extra int")
    index = ClusteredIndex(spark, f"{folder}/ix").build(rows(range(600)), cells=16)
    index.add(rows(range(600, 1200)))
    everything = list(range(1200))
    assert index.table.rows().count() == 1200 and len(index.centroids()) == 16
    assert recall(index, clusters, everything, probes=16) == 1.0
    assert recall(index, clusters, everything, probes=4) >= 0.9
    assert recall(index, clusters, everything, probes=4, refine=4) >= 0.9
    index.split(100)
    assert index.table.df().groupBy("cell").count().agg(F.max("count")).first()[0] < 400 and len(index.centroids()) > 16
    again = ClusteredIndex(spark, f"{folder}/ix")
    assert again.table.rows().count() == 1200
    assert recall(again, clusters, everything, probes=6) >= 0.9


def test_index_moves_changed_rows(spark, clusters, folder):
    rows = lambda ids, x: spark.createDataFrame([(int(i), x[i].tolist()) for i in ids], "id long, vector array<float>")
    index = ClusteredIndex(spark, f"{folder}/ix").build(rows(range(300), clusters), cells=8)
    moved = np.concatenate([-clusters[:50], clusters[50:]])
    index.add(rows(range(50), moved))
    assert index.table.rows().count() == index.table.rows().select("id").distinct().count() == 300
    got = index.search(moved[3].tolist(), 1, probes=8, columns=()).first()
    assert (got.id, got._distance) == (3, 0.0)
    index.add(spark.createDataFrame([(900, None), (901, [1.0])], "id long, vector array<float>"))
    assert index.table.rows().count() == 300


def test_store_searches_its_index(spark, folder):
    store = VectorStore(spark, folder, text_entry("Note", width=32))
    topics = ["red apples and pears", "fast cars on long roads", "rain and wind over hills", "old songs at night"]
    note = lambda ids: spark.createDataFrame([(f"n{i}", f"{topics[i % 4]} number {i}") for i in ids], "name string, text string")
    store.add(note(range(40)))
    store.index(cells=4)
    store.add(note(range(40, 60)))
    exact = store.search("fast cars number 45", 5).collect()
    assert "n45" in [r.id for r in exact]
    assert store.search("fast cars number 45", 5, probes=4).collect() == exact
    assert store.search("fast cars number 45", 5, probes=4, refine=4).collect() == exact
    store.add(spark.createDataFrame([("n45", "something else")], "name string, text string"))
    assert "n45" not in [r.id for r in store.search("fast cars number 45", 5, probes=4).collect()]
    assert store.cells.table.rows().count() == store.load().count() == 60
