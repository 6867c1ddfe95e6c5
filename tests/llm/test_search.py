"""Ranked search and the pipeline against brute force."""

import math
import re
from collections import Counter
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from annalist.llm import search


def ranked(docs, queries, k):
    """Scores of all documents for all queries."""
    words = lambda t: re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode().lower())
    counts = [Counter(words(t)) for _, t in docs]
    lengths = np.array([sum(c.values()) for c in counts])
    df = Counter(w for c in counts for w in c)
    out = {}
    for q, text in queries:
        scores = np.zeros(len(docs))
        for w in sorted(set(words(text))):
            idf = math.log(1 + (len(docs) - df[w] + 0.5) / (df[w] + 0.5))
            tf = np.array([c[w] for c in counts])
            scores += idf * tf * (search.K1 + 1) / (tf + search.K1 * (1 - search.B + search.B * lengths / max(lengths.mean(), 1e-9)))
        order = np.lexsort(([d for d, _ in docs], -scores))[:k]
        out[q] = [(docs[n][0], scores[n]) for n in order if scores[n] > 0]
    return out


@pytest.mark.parametrize("shard", [3000, 1 << 24])
def test_search(spark, sf, monkeypatch, shard):
    monkeypatch.setattr(search, "SHARD", shard)
    monkeypatch.setattr(search, "RUN", 4)
    monkeypatch.setattr(search, "BLOCK", 500)
    rows = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").limit(120)
    docs = sorted((r.doc_id, r.text) for r in rows.collect()) + [(5000, None), (5001, "")]
    queries = [(d, t) for d, t in docs if d % 10 == 0] + [(9000, "no_such_word"), (9001, None), (9002, "the OF")]
    got: dict = {}
    for r in search.search(
        spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(queries, "query_id long, text string"), k=5
    ).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.doc_id, r.score))
    for q, want in ranked(docs, queries, 5).items():
        assert [d for d, _ in got.get(q, [])] == [d for d, _ in want]
        assert [s for _, s in got.get(q, [])] == pytest.approx([s for _, s in want])


def test_search_odd_rows(spark):
    docs = spark.createDataFrame([(1, "x y"), (1, "x y"), (None, "x"), (2, "x y")], "doc_id long, text string")
    queries = spark.createDataFrame([(1, "X"), (1, "y"), (None, "x")], "query_id long, text string")
    got = search.search(docs, queries, k=2).collect()
    assert sorted((r.query_id, r.rank, r.doc_id) for r in got) == [(1, 1, 1), (1, 1, 1), (1, 2, 1), (1, 2, 1)]
    assert search.search(docs.limit(0), queries).count() == 0
    assert search.search(docs, queries.limit(0)).count() == 0


def test_few_documents_are_scored_in_full(monkeypatch):
    """Frequent words are in most runs, so bounds by run alone would open nearly all of them."""
    rng = np.random.default_rng(3)
    docs = [(n, " ".join(f"w{x}" for x in rng.zipf(1.2, 120) if x < 1 << 30)) for n in range(3000)]
    monkeypatch.setattr(search, "TaskContext", SimpleNamespace(get=lambda: SimpleNamespace(partitionId=lambda: 0)))
    shard = search.Shard()
    for doc_id, text in docs:
        shard.add(doc_id, text.encode())
    queries = [sorted(set(search.words_of(t.encode()))) for _, t in docs[::100]]
    wanted = sorted({t for q in queries for t in q})
    opened = search.Opened(shard.row(0).to_pylist()[0], pa.array([*wanted, b"zzz"], pa.binary()))
    df = np.zeros(len(wanted) + 1)
    df[opened.asked] = opened.end - opened.begin
    opened.weigh(np.log(1 + (len(docs) - df + 0.5) / (df + 0.5)), opened.lengths.mean())
    scored, scores = [], opened.scores
    opened.scores = lambda found: scored.append(len(found)) or scores(found)
    got = list(opened.best_of([np.searchsorted(wanted, q) for q in queries], 5, [0.0] * len(queries)))
    want = ranked(docs, [(n, docs[n][1]) for n in range(0, len(docs), 100)], 5)
    for (ids, found), expected in zip(got, want.values()):
        assert ids.tolist() == [d for d, _ in expected]
        assert found.tolist() == pytest.approx([s for _, s in expected])
    assert sum(scored) < 100 * len(queries)
    floors = [found[0] for _, found in got]
    assert [(i.tolist(), s.tolist()) for i, s in opened.best_of([np.searchsorted(wanted, q) for q in queries], 5, floors)] == [
        ([int(i[0])], [float(s[0])]) for i, s in got
    ]


def test_terms_of_a_shard():
    for terms in ([], [b"a"], [b"bc", b"\xc3\xa9", b"d" * 40]):
        assert search.split_terms(b" ".join(terms), len(terms)).to_pylist() == terms


def test_pipeline(spark, sf):
    got = corpus_pipeline.run(spark, sf)
    assert {"doc_id", "sequence_id", "offset", "length"} <= set(got.columns)
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert 0 < got.select("doc_id").distinct().count() <= docs.count()


def test_stages_with_odd_rows(spark, folder):
    text = "The quick brown fox jumps over the lazy dog and runs away from all the other animals of the wood. "
    rows = [(1, text * 2, "en", "a", 1), (1, text * 2, "en", "a", 1), (2, text * 2, "en", None, None), (3, None, None, None, None),
            (None, "Der kleine Hund läuft durch den Wald", "de", "b", 3), (4, "", "de", "b", 0), (5, "mail a@b.cd please", "en", "b", 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").selectExpr("*", "1 AS found", "2 AS ord", "3 AS copies")
    for frame in (docs, docs.limit(0)):
        for n, (name, stage) in enumerate(corpus_pipeline.STAGES):
            out = stage(spark, frame, folder)
            if name != "packing":
                assert out.columns == docs.columns
            path = f"{folder}/{name}-{n}-{id(frame)}"
            out.write.parquet(path)
            frame = spark.read.parquet(path)
            if name == "near_duplicates":
                assert frame.filter("doc_id IN (1, 2)").count() <= 1
