"""The prefix trie against a plain dictionary of prefixes, and against SQL."""

import hashlib
import random
import zlib
from collections import defaultdict

import duckdb
import pytest

from annalist.llm import queries, trie

SCHEMA = "conv_id long, turn long, role string, text string, n_convs int"


def plain_trie(sequences):
    """{(conv_id, depth): the other columns} from {conv_id: [(role, text), ...]}."""
    members = defaultdict(list)
    for c, turns in sequences.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    kids = defaultdict(list)
    for node in members:
        if node:
            kids[node[:-1]].append(node)
    leaves, saved, out = {}, {}, {}
    for node in sorted(members, key=len, reverse=True):
        leaves[node] = sum(leaves[k] for k in kids[node]) or int(not kids[node])
        own = (len(members[node]) - 1) * len(node[-1][1].encode()) if node else 0
        saved[node] = own + sum(saved[k] for k in kids[node])
        ends = ",".join(str(c) for c in sorted(members[node]) if len(sequences[c]) == len(node))
        out[min(members[node]), len(node)] = (
            min(members[node[:-1]]) if node else None, len(members[node]), len(kids[node]), leaves[node], saved[node],
            hashlib.sha256(ends.encode()).hexdigest(),
        )
    return out


def ordered(rows):
    """Turns of each conversation, as the operator orders them."""
    convs = defaultdict(list)
    for c, turn, role, text, *_ in rows:
        if c is not None:
            role, text = role or "", text or ""
            digest = hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).digest()
            convs[c].append((turn is not None, turn or 0, digest, (role, text)))
    return {c: [t[-1] for t in sorted(turns)] for c, turns in convs.items()}


def rebuilt(convs):
    h = {c: zlib.crc32(str(c).encode()) % 9 for c in convs}
    return {c: convs.get(c - c % 5, [])[: h[c]] + convs[c][h[c] :] for c in convs if c >= 0}


def found(df):
    rows = df.collect()
    got = {(r.conv_id, r.depth): (r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens, r.ends_sha256) for r in rows}
    assert len(got) == len(rows)
    return got


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(4)
    out = []
    for c in range(60):
        for t in range(rng.choice([1, 2, 5, 8, 9, 13])):
            out.append((c, t if t else None, rng.choice(["u", None]), rng.choice(["a", "é", None, "long " * 50, ""]), 7))
    for c in (200, 205, 210, 215, 300):  # copies with many turns, one of which goes on
        out += [(c, t, "u", "x", 7) for t in range(16 + 3 * (c == 210))]
    out += [(400, 1, "u", "b", 7)] * 3 + [(None, 1, "u", "lost", 7)]  # repeated rows and ties, and no conversation
    rng.shuffle(out)
    return out


@pytest.mark.parametrize("segment,range_rows", [(4, 7), (64, 50_000)])
def test_trie_of_small_ranges(spark, rows, segment, range_rows):
    placed = trie.numbered(spark.createDataFrame(rows, SCHEMA))
    assert found(trie.prefix_trie(placed, segment, range_rows)) == plain_trie(ordered(rows))


def test_query_on_odd_rows(spark, rows, folder):
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{folder}/conversations.parquet")
    assert found(queries.QUERIES["op11_prefix_trie"](spark, folder)) == plain_trie(rebuilt(ordered(rows)))


def test_query_equals_sql(spark, sf):
    got = found(queries.QUERIES["op11_prefix_trie"](spark, sf))
    db = duckdb.connect()
    db.execute(f"CREATE VIEW conversations AS FROM '{sf}/conversations.parquet'")
    want = db.execute(queries.SQL["op11_prefix_trie"]).fetchall()
    assert got == {(r[0], r[1]): r[2:] for r in want}


def test_empty_and_texts(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert trie.prefix_trie(trie.numbered(none)).count() == 0
    turns = spark.createDataFrame([(1, 0, "u", "hi", 0), (2, 0, "u", "hi", 0), (2, 1, None, "y" * 300_000, 0)], SCHEMA)
    placed = trie.numbered(turns)
    named = {(r.conv_id, r.depth): (r.role, r.text) for r in trie.with_texts(trie.prefix_trie(placed), placed, turns).collect()}
    assert named == {(1, 0): (None, None), (1, 1): ("u", "hi"), (2, 2): ("", "y" * 300_000)}
