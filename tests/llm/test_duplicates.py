"""Repeated strings and near-duplicates against brute force."""

import random
import re

import numpy as np
import pytest
import xxhash

from annalist.llm import simhash, suffix


def removed(rows, length=100):
    seen, out = set(), {}
    for key, text in rows:
        text = (text or "").encode()
        gone = np.zeros(len(text), bool)
        for p in range(len(text) - length + 1):
            window = text[p : p + length]
            if window in seen:
                gone[p : p + length] = True
            seen.add(window)
        out[key] = (len(text), int(gone.sum()), int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum()), np.frombuffer(text, np.uint8)[~gone].tobytes())
    return out


def passages():
    rng = random.Random(3)
    p = "".join(rng.choice("abcde ") for _ in range(3000))
    other = lambda: "".join(rng.choice("qrstuv ") for _ in range(rng.randrange(120)))
    rows = ["a" * 700, "ab" * 300, None, "", p, p[100:900] + "x" * 50 + p[300:420], p * 2, "xyz" * 150 + "a" * 99, "é日" * 150, p[17:116], p[17:117]]
    for _ in range(120):
        at = rng.randrange(2800)
        rows.append(other() + p[at : at + rng.randrange(60, 200)] + other())
    return list(enumerate(rows))


@pytest.mark.parametrize("hot", [8000, 3])
def test_repeats(spark, monkeypatch, hot):
    monkeypatch.setattr(suffix, "HOT", hot)
    df = spark.createDataFrame([(k, t, 1) for k, t in passages()], "doc_id long, text string, start int")
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in suffix.remove_repeats(df).collect()}
    assert got == removed(passages())


def test_repeats_odd_rows(spark):
    rng = random.Random(1)
    text = "".join(rng.choice("abcdefgh ") for _ in range(400))
    df = spark.createDataFrame([(1, text), (1, text), (None, text[:200]), (0, None)], "doc_id long, text string")
    got = suffix.remove_repeats(df).collect()
    # The row without an id comes first, then both equal rows in turn.
    assert sorted((str(r.doc_id), r.n_removed) for r in got) == [("0", 0), ("1", 200), ("1", 400), ("None", 0)]
    assert suffix.remove_repeats(df.limit(0)).count() == 0
    kept = suffix.without_repeats(df.selectExpr("*", "'k' AS ord", "1L AS n_chars")).collect()
    assert sorted((str(r.doc_id), r.ord, r.n_chars) for r in kept) == [("0", "k", None), ("1", "k", 0), ("1", "k", 200), ("None", "k", 200)]


# Texts of 102 bytes that share their last 53 only, yet hash alike under any polynomial modulo 2^64.
ALIKE = (
    r"""2i-A0`Z]e;-_$RhnQ!ZCtl'I$#Zt2"ixSWO$z=]`g>Y>y=[F$zssnbloagjwwuard jqxkyrusrjqnr qntusjojeqoseryfiuanxv""",
    r"""3i)A2`f]Q;1_:R<nv!rC(l_I$#"t~"Qx.W{$d=Y`{>M>w=_F#zssnbloagjwwuard jqxkyrusrjqnr qntusjojeqoseryfiuanxv""",
)


@pytest.mark.parametrize("hot", [8000, 0])
def test_repeats_look_at_the_bytes(spark, monkeypatch, hot):
    monkeypatch.setattr(suffix, "HOT", hot)
    rows = [(1, ALIKE[0]), (2, ALIKE[1]), (3, ALIKE[0] + ALIKE[1])]
    got = suffix.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in got} == removed(rows)
    assert {r.doc_id: r.n_removed for r in got} == {1: 0, 2: 0, 3: 204}


def test_runs_of_windows():
    import pyarrow as pa

    windows = [(1, 5), (1, 6), (1, 100), (2, 101), (2, 102), (2, 112), (2, 113), (3, 0)]
    for cut in range(len(windows) + 1):
        parts = [pa.RecordBatch.from_pydict({"ord": pa.array([o for o, _ in w], pa.int64()), "start": pa.array([s for _, s in w], pa.int64())}) for w in (windows[:cut], windows[cut:])]
        got = [tuple(r.values()) for b in suffix.runs_of(iter(parts), 10) for r in b.to_pylist()]
        assert got == [(1, 5, 16), (1, 100, 110), (2, 101, 123), (3, 0, 10)]


def fingerprint(text):
    words = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
    shingles = [b" ".join(words[k : k + 3]) for k in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hashes) > len(hashes))


def smallest(fps, ids, most=3):
    a, label = np.array(fps, dtype=np.uint64), np.array(ids)
    while True:
        new = np.array([label[np.bitwise_count(a ^ x) <= most].min() for x in a])
        if (new == label).all():
            return label.tolist()
        label = new


def test_near_duplicates(spark, sf):
    rows = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    rows = [(r.doc_id, r.text) for r in rows] + [(1000, None), (1001, ""), (1002, "  \n"), (1003, "Word"), (1004, "word ")]
    got = {r.doc_id: r for r in simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    fps = [fingerprint(t) for _, t in rows]
    assert [got[d].fp % (1 << 64) for d, _ in rows] == fps
    assert [got[d].component_id for d, _ in rows] == smallest(fps, [d for d, _ in rows])


def test_near_duplicates_odd_rows(spark):
    df = spark.createDataFrame([(3, "a b c"), (3, "x y z w"), (None, "a b c"), (2, "a b c")], "doc_id long, text string")
    got = sorted((str(r.doc_id), r.component_id) for r in simhash.near_duplicates(df).collect())
    assert got == [("2", 2), ("3", 2), ("3", 3), ("None", 2)]
    assert simhash.near_duplicates(df.limit(0)).count() == 0


def test_large_groups_are_split(spark, monkeypatch):
    monkeypatch.setattr(simhash, "LARGE", 32)
    rng = np.random.default_rng(0)
    found = set()
    for center in rng.integers(0, 2**64, 8, dtype=np.uint64):
        for _ in range(rng.integers(1, 200)):
            y = center
            for _ in range(rng.integers(0, 4)):
                y ^= np.uint64(1) << np.uint64(rng.integers(0, 64))
            found.add(int(y))
    fps = sorted(found)
    nodes = spark.createDataFrame([(n, int(np.uint64(x).view(np.int64))) for n, x in enumerate(fps)], "id long, fp long")
    root = {r.id: r.root for r in simhash.components(simhash.links(nodes)).collect()}
    assert [root.get(n, n) for n in range(len(fps))] == smallest(fps, range(len(fps)))


def test_block_ranks_and_suffixes():
    rng = np.random.default_rng(5)
    for size, step in [(1, 10), (40, 10), (300, 10), (300, 14), (3000, 8), (500, 7), (70_000, 14)]:
        text = rng.integers(0, 3 if size < 1000 else 257, size).astype(np.uint16)
        ring = np.concatenate([text, np.resize(text, step)])
        keys = [tuple(ring[k : k + step]) for k in range(size)]
        ranks = {key: n for n, key in enumerate(sorted(set(keys)))}
        got = suffix.block_ranks(text, step) if size >= step else None
        assert got is None or got.tolist() == [ranks[key] for key in keys]
    symbols = rng.integers(0, 4, 200)
    for steps in (1, 2, 3, 10):
        plain = sorted(range(200), key=lambda at: [symbols[(at + k * suffix.STEP) % 200] for k in range(steps)])
        assert suffix.sorted_suffixes(symbols, steps).tolist() == plain


def test_work_at_once_is_small():
    """Two tasks of an executor, hashing and merging, share what its heap leaves."""
    import tracemalloc

    from annalist.llm.common import slices

    raw = np.random.default_rng(6).integers(97, 123, 1 << 21).astype(np.uint8)
    offsets = np.arange(0, len(raw) + 1, 1 << 12)
    one = suffix.Powers(suffix.BASE)
    tracemalloc.start()
    for a, b in slices(offsets, suffix.CHUNK):
        suffix.spans(raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], 100, one)
    texts = [raw[a : a + 400].tobytes() for a in range(0, suffix.MERGE, 400)]
    suffix.repeated_windows(texts, np.arange(len(texts)), np.zeros(len(texts), np.int64), 100)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 32 << 20, most
