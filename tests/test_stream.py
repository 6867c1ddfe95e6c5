import json
import os
import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

import sequential
from annalist.operators import labels
from annalist.plans.ingest import Ingest
from annalist.session import scratch_path
from annalist.sources.logs import stream_values, to_responses
from annalist.specs import EntitySpec, FieldSpec, Registry
from annalist.streaming.ingest import EntryAssembler, finish_ingest, read_responses_stream, start_ingest

SPEC = EntitySpec("Thing", (FieldSpec("code", str, key=True), FieldSpec("n", int)))


def log_lines(n, rng):
    """Records and multi-line texts of two streams: (pod, ns, msg)."""
    out = []
    for i in range(n):
        start = f"2024-01-01 00:00:{i % 60:02d}.000 | EVENT    | app:save:{i} - "
        if rng.random() < 0.6:
            body = '```json{"code":"c%d","n":%d,"__type__":"Thing","__namespace__":"default"}```' % (i % 7, i)
            out.append(("big", start + body))
        else:
            lines = [start + f"***t{i}***", "  first", "", "last  "]
            out += [("small" if i % 5 == 0 else "big", line) for line in lines]
    return [(pod, 1_700_000_000_000_000_000 + j * 1000, msg) for j, (pod, msg) in enumerate(out)]


def responses(spark, rows):
    df = spark.createDataFrame(rows, "pod string, ns long, msg string")
    return to_responses(df, F.create_map(F.lit("pod"), F.col("pod")), F.col("ns"), F.col("msg"))


def run(spark, folder, rows, cuts, dedup=None):
    """Write the rows in files cut at the given places, one file per batch, and ingest them."""
    bounds = [0, *cuts, len(rows)]
    for i, (a, b) in enumerate(zip(bounds, bounds[1:])):
        responses(spark, rows[a:b]).coalesce(1).write.text(f"{folder}/part={i:03d}")
    ingest = Ingest(spark, f"{folder}/root", Registry([SPEC]), buckets=2)
    lines = read_responses_stream(spark, f"{folder}/part=*", files_per_batch=1)
    start_ingest(lines, ingest, f"{folder}/state", f"{folder}/checkpoint", dedup).awaitTermination()
    finish_ingest(ingest, f"{folder}/state")
    things = sorted(map(tuple, ingest.table_of(SPEC).rows().select("code", "n").collect()))
    texts = sorted(map(tuple, ingest.text_table().rows().select("name", "text").collect()))
    return things, texts


def test_batches_of_any_cut_give_the_same_tables(spark, tmp_path):
    rows = log_lines(24, random.Random(5))
    one = run(spark, f"{tmp_path}/one", rows, [])
    many = run(spark, f"{tmp_path}/many", rows, [7, 23])
    assert one == many
    want = {}
    for i, (_, _, msg) in enumerate(rows):
        if '"code"' in msg:
            body = msg.split("```json")[1][:-3]
            want[eval(body)["code"]] = eval(body)["n"]
    assert dict(one[0]) == want
    assert all(text.endswith("first\n\nlast") for _, text in one[1])


def test_assembler_carries_open_entries(spark, folder):
    assembler = EntryAssembler(spark, f"{folder}/open")
    lines = [
        ("s", 1, "2024-01-01 00:00:00.001 | EVENT    | p:f:1 - a"), ("s", 2, "b"), ("s", 3, ""),
        ("s", 4, "c"), ("s", 5, "2024-01-01 00:00:00.002 | EVENT    | p:f:2 - d"), ("t", 6, "noise"),
        ("s", 7, "e"),
    ]
    got = []
    for batch_id, part in enumerate([lines[:3], lines[3:5], lines[5:6], lines[6:]]):
        df = spark.createDataFrame([(s, n, 0, m) for s, n, m in part], "stream string, ns long, position int, msg string")
        out = assembler.assemble(df, batch_id)
        again = assembler.assemble(df, batch_id)
        assert sorted(r.text for r in out.collect()) == sorted(r.text for r in again.collect())
        got += [r.text for r in out.collect()]
    got += [r.text for r in assembler.flush().collect()]
    assert got == sequential.entries([m for s, _, m in lines if s == "s"])


def test_polling_the_same_lines_again_adds_nothing(spark, tmp_path):
    rows = log_lines(10, random.Random(2))
    once = run(spark, f"{tmp_path}/once", rows, [])
    twice = run(spark, f"{tmp_path}/twice", rows + rows, [len(rows)], dedup="1 hour")
    assert once == twice


def test_rate_in_a_stream(spark, folder):
    rows = log_lines(10, random.Random(2))
    responses(spark, rows).write.text(f"{folder}/in")
    lines = read_responses_stream(spark, f"{folder}/in").withColumn("pod", F.col("labels.pod"))
    query = (
        labels.rate(lines, "ts", ["pod"], watermark="1 minute")
        .writeStream.outputMode("complete").format("memory").queryName("rates").trigger(availableNow=True).start()
    )
    query.awaitTermination()
    batch = labels.rate(
        stream_values(spark.read.schema("result array<struct<stream: map<string,string>, values: array<array<string>>>>").json(f"{folder}/in")).withColumn("pod", F.col("labels.pod")),
        "ts", ["pod"],
    )
    assert sorted(map(tuple, spark.table("rates").collect())) == sorted(map(tuple, batch.collect()))
    assert batch.agg(F.sum("n")).first()[0] == len(rows)


def ticks_of(spark, folder, seconds):
    """A clock that is set by hand: one file, and so one batch, per time."""
    for i, second in enumerate(seconds):
        file = folder / f"{i:03d}.json"
        if not file.exists():
            file.write_text(json.dumps({"tick": f"2024-01-01T00:{second // 60:02d}:{second % 60:02d}Z"}))
            os.utime(file, (1_700_000_000 + i,) * 2)  # files are taken by their time
    return spark.readStream.schema("tick timestamp").option("maxFilesPerTrigger", 1).json(str(folder))


def test_quiet_streams_time_out(spark, tmp_path):
    rows = [(pod, k, f"2024-01-01 00:00:{k:02d}.000 | EVENT    | app:save:{k} - ***{pod}{k}***") for k, pod in enumerate(["a", "b", "a", "b"])]
    later = [("b", 8, "  goes on"), ("b", 9, "2024-01-01 00:00:09.000 | EVENT    | app:save:9 - ***b9***")]
    ingest = Ingest(spark, f"{tmp_path}/root", Registry([SPEC]), buckets=2)
    (tmp_path / "ticks").mkdir()

    def go(seconds):
        ticks = ticks_of(spark, tmp_path / "ticks", seconds)
        lines = read_responses_stream(spark, f"{tmp_path}/part=*", files_per_batch=1)
        start_ingest(lines, ingest, f"{tmp_path}/state", f"{tmp_path}/checkpoint", quiet=timedelta(seconds=30), ticks=ticks).awaitTermination()
        return sorted(map(tuple, ingest.text_table().rows().select("name", "text").collect()))

    responses(spark, rows).coalesce(1).write.text(f"{tmp_path}/part=000")
    # At first the last entry of both streams is open; nothing comes for 29 seconds.
    assert [n for n, _ in go([0, 29])] == ["a0", "b1"]
    responses(spark, later[:1]).coalesce(1).write.text(f"{tmp_path}/part=001")
    # At 40 a line came for b, so only a is over; at 69 b is not, at 70 it is, with that line.
    assert [n for n, _ in go([0, 29, 40])] == ["a0", "a2", "b1"]
    assert [n for n, _ in go([0, 29, 40, 69])] == ["a0", "a2", "b1"]
    out = go([0, 29, 40, 69, 70, 200, 300])
    assert [n for n, _ in out] == ["a0", "a2", "b1", "b3"] and out[-1][1].endswith("goes on")
    responses(spark, later[1:]).coalesce(1).write.text(f"{tmp_path}/part=002")
    assert [n for n, _ in go([0, 29, 40, 69, 70, 200, 300, 301, 331])] == ["a0", "a2", "b1", "b3", "b9"]
    state = EntryAssembler(spark, f"{tmp_path}/state", "ingest")
    assert state.flush().count() == 0
    assert ingest.text_table().rows().count() == 5


def test_repeated_batch_times_out_alike(spark, folder):
    assembler = EntryAssembler(spark, f"{folder}/open", quiet=timedelta(seconds=10))
    schema, at = "stream string, ns long, position int, msg string", datetime(2024, 1, 1)
    lines = spark.createDataFrame([("s", 1, 0, "2024-01-01 00:00:00.001 | EVENT    | p:f:1 - a")], schema)
    none = lines.limit(0)
    assert assembler.assemble(lines, 0).count() == 0  # no clock yet
    assert assembler.assemble(none, 1, at).count() == 0
    for _ in range(2):
        assert [r.text for r in assembler.assemble(none, 2, at + timedelta(seconds=10)).collect()] == ["2024-01-01 00:00:00.001 | EVENT    | p:f:1 - a"]
    assert assembler.assemble(none, 3, at + timedelta(seconds=99)).count() == 0


def test_folders_do_not_grow_with_batches(spark, tmp_path, monkeypatch):
    monkeypatch.setattr("annalist.sources.tables.FOLD", 2)
    rows = log_lines(15, random.Random(3))
    for i in range(5):
        responses(spark, rows[i * len(rows) // 5 : (i + 1) * len(rows) // 5]).coalesce(1).write.text(f"{tmp_path}/part={i:03d}")
    ingest, scratch = Ingest(spark, f"{tmp_path}/root", Registry([SPEC]), buckets=1), scratch_path(spark, "x").rsplit("/", 1)[0]
    folders = lambda top: sum(len(d) for _, d, _ in os.walk(top))
    seen, staged = [], len(os.listdir(scratch)) if os.path.exists(scratch) else 0
    expire = Ingest.expire

    def counted(self, keep):
        expire(self, keep)
        seen.append(folders(f"{self.root}/columnar"))

    monkeypatch.setattr(Ingest, "expire", counted)
    lines = read_responses_stream(spark, f"{tmp_path}/part=*", files_per_batch=1)
    start_ingest(lines, ingest, f"{tmp_path}/state", f"{tmp_path}/checkpoint", keep_versions=2).awaitTermination()
    assert len(seen) == 5 and max(seen[3:]) <= max(seen[:3])
    assert len(os.listdir(scratch)) == staged
    once = Ingest(spark, f"{tmp_path}/once", Registry([SPEC]), buckets=1)
    expire(once, 1)
    start_ingest(read_responses_stream(spark, f"{tmp_path}/part=*"), once, f"{tmp_path}/state1", f"{tmp_path}/checkpoint1").awaitTermination()
    assert rows_of(ingest) == rows_of(once)


def rows_of(ingest):
    return sorted(map(tuple, ingest.table_of(SPEC).rows().select("code", "n").collect()))
