"""BPE, token files and packing against the tokenizers library."""

import hashlib
import random
import zlib

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from annalist.llm import bpe, common, packing, tokens

BYTE, WORD = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
PARTS = ["a", "b", "é", "É", " ", "\n", "\t", "'s", "'", "!", ".", ",", "日", "́", "1", "²", "ª", "<|endoftext|>", " ", "ß", "  ", "_", "-", "the"]


def texts():
    rng = random.Random(5)
    mixed = ["".join(rng.choice(PARTS) for _ in range(rng.randrange(80))) for _ in range(200)]
    long = ["a" * 1000, "ab" * 700 + "'s" + "x" * 500, " \n\n  " * 200, "!" * 900 + "'s" + "é" * 400, "日本語" * 100, "'re" * 300, "<|endoftext|>" * 30]
    return [None, "", *mixed, *long]


def ids_of(tokenizer, text):
    return np.array(tokenizer.encode(text or "", add_special_tokens=False).ids, dtype="<u4")


@pytest.fixture(scope="module")
def rows(spark):
    # Repeated rows, an id twice, none at all, and a column whose name an operator uses itself.
    data = [(n, t, "x") for n, t in enumerate(texts())] + [(7, "again", "x"), (7, "again", "x"), (None, "no id", None)]
    return spark.createDataFrame(data, "doc_id long, text string, ids string")


@pytest.mark.parametrize("leaf", [16, 100, 1 << 16])
def test_round_trip(rows, leaf):
    tokenizer = Tokenizer.from_file(BYTE)
    got = bpe.decode(bpe.encode(rows, BYTE, leaf), BYTE).collect()
    want = [(r.doc_id, ids_of(tokenizer, r.text)) for r in rows.collect()]
    assert sorted((str(r.doc_id), bytes(r.ids), r.n_tokens, r.text) for r in got) == sorted(
        (str(d), i.tobytes(), len(i), tokenizer.decode(i.tolist(), skip_special_tokens=False)) for d, i in want
    )


def test_word_vocabulary(rows):
    tokenizer = Tokenizer.from_file(WORD)
    got = bpe.encode(rows, WORD, 64, inside=False).collect()
    assert sorted((str(r.doc_id), bytes(r.ids)) for r in got) == sorted((str(r.doc_id), ids_of(tokenizer, r.text).tobytes()) for r in rows.collect())


def test_plain_text_is_encoded_at_once():
    encoder, tokenizer, rng = bpe.Encoder(WORD), Tokenizer.from_file(WORD), random.Random(7)
    assert encoder.plain and not bpe.Encoder(BYTE).plain
    plain = [*bpe.MARKS, *"aAbzZéÉßÀÿÖ", "the", "ing", *bpe.PLAIN, " "]
    other = ["1", "42", "-", "'s", "<|endoftext|>", "日", "\u0301", "\xa0", "@", "×", "\0", "ª"]
    for letters, kept in ((plain, False), (plain + other, True)):
        lines = ["", " ", *("".join(rng.choice(letters) for _ in range(rng.randrange(60))) for _ in range(500))]
        assert encoder.ids(lines) == [ids_of(tokenizer, t).tobytes() for t in lines]
        assert bool(encoder.known) == kept  # letters and marks need neither the cache nor a call for each word


def test_ranks_round_trip():
    for numbers in ([], [0], [255, 256, 65535, 65536, 1 << 24, (1 << 32) - 1, 3], list(range(1000))):
        control, data = tokens.pack_ranks(np.array(numbers, dtype=np.uint32))
        assert len(control) == -(-len(numbers) // 4)
        assert tokens.unpack_ranks(control, data, len(numbers)).tolist() == numbers


def test_columns_of_ranks_and_ids():
    rng = np.random.default_rng(5)
    n = np.array([0, 3, 4, 0, 1, 250, 0])
    for top in (200, 60_000, 1 << 24, 1 << 32):
        numbers = rng.integers(0, top, n.sum(), dtype=np.uint64).astype(np.uint32)
        control, data = tokens.pack_column(numbers, n)
        assert (tokens.unpack_column(control, data, n) == numbers).all()
        assert (tokens.unpack_column(control.slice(2), data.slice(2), n[2:]) == numbers[3:]).all()
        small = tokens.narrowed(numbers)
        assert small.itemsize == (2 if top <= 1 << 16 else 4)
        assert (tokens.widened(tokens.binary_column(small, n * small.itemsize), n) == numbers).all()
    mixed = pa.array([np.array([1, 2], "<u2").tobytes(), b"", np.array([70_000], "<u4").tobytes()], pa.binary())
    assert tokens.widened(mixed, np.array([2, 0, 1])).tolist() == [1, 2, 70_000]


def test_token_files(spark, rows, folder):
    tokens.write_tokens(bpe.encode(rows.filter("doc_id IS NULL OR doc_id <> 7"), WORD, inside=False), f"{folder}/t", end_id=2)
    got = {r.doc_id: (r.start, bytes(r.ids)) for r in tokens.read_tokens(spark, f"{folder}/t").collect()}
    tokenizer, start = Tokenizer.from_file(WORD), 0
    for r in sorted(rows.filter("doc_id IS NULL OR doc_id <> 7").collect(), key=lambda r: (r.doc_id is not None, r.doc_id)):
        want = np.append(ids_of(tokenizer, r.text), np.uint32(2)).astype("<u4")
        assert got[r.doc_id] == (start, want.tobytes())
        start += len(want)


def test_no_documents(spark, rows, folder):
    none = bpe.encode(rows.limit(0), BYTE)
    tokens.write_tokens(none, f"{folder}/t", end_id=2)
    assert tokens.read_tokens(spark, f"{folder}/t").count() == 0
    assert packing.pack(none).count() == 0


def test_packing(rows):
    size = 64
    encoded = bpe.encode(rows, BYTE)
    pieces = packing.pack(encoded, end_id=1, size=size).collect()
    whole = sorted((str(r.doc_id), r.n_tokens + 1) for r in encoded.collect())
    assert sum(p.length for p in pieces) == sum(n for _, n in whole)
    by: dict = {}
    for p in pieces:
        assert zlib.crc32(bytes(p.ids)) == p.ids_crc32 and len(p.ids) == 4 * p.length
        by.setdefault(p.sequence_id, []).append((p.offset, p.length))
    for places in by.values():
        end = 0
        for offset, length in sorted(places):
            assert offset == end
            end += length
        assert end <= size
    assert sorted(by) == list(range(len(by)))
    single = [p for p in pieces if p.doc_id not in (None, 7)]
    for doc in {p.doc_id for p in single}:
        own = sorted((p for p in single if p.doc_id == doc), key=lambda p: p.start)
        assert [p.start for p in own] == np.cumsum([0, *[p.length for p in own]])[:-1].tolist()
        assert {p.doc_tokens for p in own} == {sum(p.length for p in own)}


def test_patterns_place_all_lengths():
    rng = random.Random(1)
    histogram = {n: rng.randrange(50) for n in rng.sample(range(1, 2049), 300)}
    patterns = packing.patterns_of(histogram)
    placed: dict = {}
    for count, pattern in patterns:
        assert sum(pattern) <= 2048
        for length in pattern:
            placed[length] = placed.get(length, 0) + count
    assert placed == {k: n for k, n in histogram.items() if n}
    used = sum(n * k for k, n in histogram.items())
    assert used / (2048 * sum(c for c, _ in patterns)) > 0.95


def test_digest_columns(spark, sf):
    from annalist.llm.queries import QUERIES

    tokenizer = Tokenizer.from_file(BYTE)
    got = {r.doc_id: r for r in QUERIES["op1_bpe_round_trip"](spark, sf).collect()}
    for r in spark.read.parquet(f"{sf}/documents.parquet").collect():
        ids = ids_of(tokenizer, r.text)
        assert got[r.doc_id].ids_sha256 == hashlib.sha256(ids.tobytes()).hexdigest()
        assert got[r.doc_id].decoded_sha256 == hashlib.sha256((r.text or "").encode()).hexdigest()


def test_other_steps_drop_the_encoder():
    bpe.encoder(BYTE).ids(["some words"])
    bpe.token_bytes(BYTE)
    assert list(common.trimmed(lambda batches: iter(batches))(iter([1]))) == [1]
    assert bpe.encoder.cache_info().currsize == bpe.token_bytes.cache_info().currsize == 0
