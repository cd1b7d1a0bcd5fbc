"""The session-log data source: ranges of any size, pushed floors, numbers of lines, streams over files that grow."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import EqualTo, GreaterThan, GreaterThanOrEqual, In, IsNotNull

from sessionloom.sources import connector, stores

LINES = [
    b'{"timestamp": "2024-01-01T00:00:00.000Z", "n": 1}', b"", b"{broken", b'{"timestamp": "2024-01-02T00:00:00+02:00"}\r', b"   ", b"[1]",
    '{"timestamp": "2024-01-03T00:00:00.5Z", "text": "é"}'.encode(), b'{"timestamp": 5}', b'{"timestamp": null}', b"\xff\xfe odd", b'{"timestamp": "2024-01-04"}',
]
FIRST = 1_704_067_200_000


@pytest.fixture
def folder(tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "one.jsonl").write_bytes(b"\n".join(LINES) + b"\n")
    (tmp_path / "two.jsonl").write_bytes(b"\n".join(LINES[::-1]))
    (tmp_path / "empty.jsonl").write_bytes(b"")
    (tmp_path / "_hidden.jsonl").write_bytes(b"x\n")
    (tmp_path / "other.txt").write_bytes(b"x\n")
    return str(tmp_path)


def plain(lines):
    return [(n, line.removesuffix(b"\r").decode("utf-8", "replace")) for n, line in enumerate(lines, 1) if line.strip()]


@pytest.mark.parametrize("split", [1, 7, 60, 1 << 20])
def test_ranges_give_every_line_once_with_its_number(spark, folder, split):
    rows = connector.numbered(spark, folder, splitBytes=split).collect()
    got = sorted((r.source_file.rsplit("/", 1)[1], r.line, r.value) for r in rows)
    assert got == sorted([("one.jsonl", *x) for x in plain(LINES)] + [("two.jsonl", *x) for x in plain(LINES[::-1])])


def test_floors_keep_the_lines_own_numbers(spark, folder):
    rows = connector.numbered(spark, folder, FIRST, splitBytes=50).where("source_file like '%one.jsonl'").collect()
    assert sorted(r.line for r in rows) == [4, 7, 11]
    stamps = connector.log(spark, folder).where("source_file like '%one.jsonl'").select("stamp_ms").collect()
    assert sorted(r[0] for r in stamps if r[0] is not None) == [FIRST, FIRST + 79_200_000, FIRST + 172_800_500, FIRST + 259_200_000]


def test_filters_reach_the_reader(spark, folder):
    reader = connector.LogReader({"path": folder}, T.StructType.fromDDL(connector.COLUMNS))
    name = f"{folder}/two.jsonl"
    left = list(reader.pushFilters([GreaterThan(("stamp_ms",), 5), GreaterThanOrEqual(("stamp_ms",), 9), IsNotNull(("stamp_ms",)), In(("source_file",), (name, "x")), EqualTo(("k",), 1)]))
    assert (reader.floor, left) == (8, [IsNotNull(("stamp_ms",)), EqualTo(("k",), 1)])
    assert {p.value[0] for p in reader.partitions()} == {name}
    rows = connector.log(spark, folder).where((F.col("stamp_ms") >= FIRST + 1) & (F.col("source_file") == name))
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert "stamp_ms" not in "".join(line for line in plan.splitlines() if "Filter" in line and ">" in line), plan
    assert rows.count() == 3


def test_places_that_are_not_there(spark, tmp_path):
    assert connector.log(spark, f"{tmp_path}/none").count() == 0 and connector.numbered(spark, f"{tmp_path}/none").count() == 0
    assert connector.numbered(spark, f"file://{tmp_path}/none").count() == 0
    (tmp_path / "x.jsonl").write_bytes(b'{"a": 1}\n')
    assert [r.line for r in connector.numbered(spark, f"file://{tmp_path}").collect()] == [1]
    assert connector.log(spark, f"{tmp_path},{tmp_path}/none").count() == 1


def test_records(spark, tmp_path):
    made = lambda n, day: json.dumps({"type": "user", "timestamp": f"2024-01-0{day}T00:00:00Z", "uuid": f"u{n}", "cwd": "/p", "message": {"content": "hi"}})
    (tmp_path / "s.jsonl").write_text("\n".join(made(n, n) for n in range(1, 6)) + "\n")
    rows = connector.records(spark, "claude", str(tmp_path), FIRST + 2 * 86_400_000, splitBytes=64).collect()
    assert sorted((r.native_id, r.line) for r in rows) == [("u4", 4), ("u5", 5)]


def test_stream_follows_files_that_grow(spark, tmp_path):
    source, out, marks = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "marks")
    source.mkdir()

    def drained():
        stream = connector.log(spark, str(source), "value string", stream=True, splitBytes=5)
        stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", marks).trigger(availableNow=True).start().awaitTermination()
        return sorted(r[0] for r in spark.read.schema("value string").parquet(out).collect())

    file = source / "a.jsonl"
    file.write_bytes(b"one\ntwo\nhal")
    assert drained() == ["one", "two"]
    assert drained() == ["one", "two"]
    with file.open("ab") as more:
        more.write(b"f\nthree\n")
    (source / "b.jsonl").write_bytes(b"four\n")
    assert drained() == ["four", "half", "one", "three", "two"]
    file.write_bytes(b"new\n")
    assert drained() == ["four", "half", "new", "one", "three", "two"]


def test_small_files_share_tasks(spark, tmp_path):
    """A store of many small files is read by a few tasks, and its folders are listed by a few."""
    for k in range(200):
        (tmp_path / f"u{k}").mkdir()
        (tmp_path / f"u{k}" / "a.jsonl").write_text(f'{{"n": {k}}}\n' * 3)
    rows = connector.log(spark, str(tmp_path), "source_file string, value string", splitBytes=16)
    assert 8 <= rows.rdd.getNumPartitions() <= 8 * 4 + 8
    assert rows.count() == 600 and rows.distinct().count() == 200
    context = spark.sparkContext
    context.setJobGroup("listing", "listing")
    listed = stores.lines(spark, [str(tmp_path)])
    tracker = context.statusTracker()
    stages = [tracker.getStageInfo(s) for j in tracker.getJobIdsForGroup("listing") for s in tracker.getJobInfo(j).stageIds]
    context.setLocalProperty("spark.jobGroup.id", None)
    assert stages and max(s.numTasks for s in stages) <= 4 * context.defaultParallelism
    assert listed.count() == 600
