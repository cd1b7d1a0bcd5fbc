"""Tables that append, session state that folds, and cadence as a stream with state."""

from __future__ import annotations

import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sessionloom.operators import delta, rollups, session_state
from sessionloom.sources import stores
from sessionloom.streaming import cadence, ingest


def table_of(spark, path, **more):
    return delta.DeltaTable(spark, str(path), "id bigint, ms bigint", ranged="ms", **more)


def numbers(spark, low, high):
    return spark.range(low, high).select("id", (F.col("id") * 10).alias("ms"))


def test_a_batch_writes_its_own_rows_only(spark, tmp_path):
    table = table_of(spark, tmp_path / "t")
    assert table.read().count() == 0 and table.expire() == []
    table.append(numbers(spark, 0, 200_000).coalesce(1))
    for k in range(3):
        table.append(numbers(spark, 200_000 + k, 200_001 + k).coalesce(1))
    parts = table.document()["parts"]
    assert [p["rows"] for p in parts] == [200_000, 1, 1, 1] and all(50 * p["bytes"] < parts[0]["bytes"] for p in parts[1:])
    assert table.read().count() == 200_003 and table.read(1).count() == 200_000
    assert table.between(2_000_005, 2_000_015).count() == 1 and table.between(None, None).count() == 0
    assert len(table.between(0, 5).inputFiles()) == 1  # other parts are not read


def test_a_batch_of_a_stream_counts_once(spark, tmp_path):
    table = table_of(spark, tmp_path / "t")
    assert table.append(numbers(spark, 0, 3), "s", 0) == 1 and table.append(numbers(spark, 0, 3), "s", 0) == 1
    assert table.append(numbers(spark, 3, 4), "s", 1) == 2 and table.append(numbers(spark, 9, 9), "other", 0) == 3
    assert table.read().count() == 4 and len(table.document()["parts"]) == 2


def test_a_failed_writer_leaves_nothing_visible(spark, tmp_path, monkeypatch):
    table = table_of(spark, tmp_path / "t")
    table.append(numbers(spark, 0, 3))
    with pytest.raises(Exception, match="broken"):  # a task fails
        table.append(spark.range(5).select("id", F.raise_error(F.lit("broken")).cast("bigint").alias("ms")))
    with monkeypatch.context() as m:  # the driver goes between the rows and the manifest
        m.setattr(delta.CommitLog, "write", lambda *_: (_ for _ in ()).throw(KeyboardInterrupt()))
        with pytest.raises(KeyboardInterrupt):
            table.append(numbers(spark, 3, 9))
    (tmp_path / "t" / "_log" / ".staged-dead").write_text("")  # or while the manifest is staged
    assert table.read().count() == 3 and table.log.newest() == 1
    assert table.append(numbers(spark, 3, 4)) == 2 and table.read().count() == 4
    assert table.expire(grace_ms=86_400_000) == []
    gone = table.expire(grace_ms=-1)
    assert len(gone) == 2 and table.read().count() == 4


def test_of_two_writers_one_commits(spark, tmp_path):
    one, two = (table_of(spark, tmp_path / "t") for _ in range(2))
    one.append(numbers(spark, 0, 1))
    base = two.log.newest()
    one.append(numbers(spark, 1, 2))
    with pytest.raises(RuntimeError, match="version 2"):
        two.append(numbers(spark, 5, 9), based_on=base)
    assert two.read().count() == 2
    assert not {"append", "compact", "expire"} & set(dir(delta.DeltaReader(spark, str(tmp_path / "t"), "id bigint, ms bigint")))


def test_compaction_takes_small_parts_and_merges_where_it_takes_all(spark, tmp_path):
    last = lambda rows: rows.groupBy("id").agg(F.max("ms").alias("ms"))
    table = table_of(spark, tmp_path / "t", merge=last)
    table.append(numbers(spark, 0, 100_000).coalesce(1))
    for _ in range(3):
        table.append(numbers(spark, 0, 10).coalesce(1))
    table.compact()
    assert [p["rows"] for p in table.document()["parts"]] == [100_000, 30] and table.read().count() == 100_000
    table.compact(ratio=1e9)
    assert [p["rows"] for p in table.document()["parts"]] == [100_000]
    table.expire(grace_ms=-1)
    assert table.log.numbers() == [6] and table.read().count() == 100_000 and len(list((tmp_path / "t").glob("part-*"))) == 1


REC = "source_id string, native_id string, timestamp_ms long, record_type string, project_path string, git_branch string, model string, content_excerpt string, raw_meta string, source_file string, line long, source_order int"


def some_records(n=400):
    rng, out = random.Random(3), []
    for k in range(n):
        source = rng.choice(["claude", "codex", "opencode", "nine_router"])
        out.append((
            source, rng.choice(["", f"n{k}"]), rng.randrange(1000), rng.choice(["session_start", "message", "tool", "file_edit", "error"]), rng.choice(["", "/p/a", "/p/b"]), rng.choice(["", "main", None]), rng.choice(["", "m1", "m2"]),
            rng.choice(["", "  Hi  there ", "hi there", "x"]), rng.choice(["{}", '{"session_id": "s1"}', '{"a": {"sessionId": "s2", "reqId": "q"}}', '{"requestId": 7}']), rng.choice(["", "f1", "f2", "f3"]), k, ["claude", "codex", "opencode", "nine_router"].index(source),
        ))
    return out


def plain_sessions(records):
    found, marks = {}, set()
    for r in sorted(records, key=lambda r: (r[11], r[9], r[10])):
        source, native, ms, kind, project, branch, model, excerpt, meta, file, _, _ = r
        if source == "nine_router" or kind == "file_edit":
            continue
        key = file or native
        if source == "opencode":
            named = "s1" if "s1" in meta else "s2" if "s2" in meta else ""
            key = native if kind == "session_start" and native else named or f"__ungrouped__{native or ms}"
        s = found.setdefault((source, key), {"low": ms, "high": ms, "turns": 0, "project": "", "model": "", "branch": "", "path": "", "born": None})
        s["low"], s["high"], s["turns"] = min(s["low"], ms), max(s["high"], ms), s["turns"] + (kind == "message")
        for name, value in (("project", project), ("model", model), ("branch", branch), ("path", file)):
            s[name] = s[name] or value or ""
        if kind == "session_start" and native and (s["born"] is None or ms < s["born"][0]):
            s["born"] = (ms, native)
        ids = ["s1"] if "s1" in meta else ["s2", "q"] if "s2" in meta else ["7"] if "7" in meta else []
        marks |= {(source, key, "native", native)} | {(source, key, "raw", i) for i in ids} | {(source, key, "print", " ".join(excerpt.split()).lower())}
    rows = sorted((k[0], k[1], s["born"][1] if s["born"] else k[1], s["low"], s["high"], s["turns"], s["project"], s["model"], s["branch"], s["path"]) for k, s in found.items())
    return rows, sorted(m for m in marks if m[3])


def test_sessions_fold_in_any_order(spark, tmp_path):
    records = some_records()
    df = spark.createDataFrame(records, REC)
    rows, marks = plain_sessions(records)
    shown = lambda got: sorted((r.source_id, r.group_key, r.native_id, r.started_ms, r.ended_ms, r.turn_count, r.project_path, r.model, r.git_branch, r.raw_path) for r in got.collect())
    assert shown(session_state.sessions(session_state.heads(df))) == rows
    for order in ([0, 1, 2, 3], [2, 3, 0, 1]):
        store = session_state.SessionStore(spark, str(tmp_path / f"s{order[0]}"))
        for number, k in enumerate(order):
            store.fold(df.where(F.col("line") % 4 == k), "s", number)
            store.fold(df.where(F.col("line") % 4 == k), "s", number)  # a batch that comes again
        assert shown(store.read()) == rows
        store.heads.compact(ratio=1e9)
        assert shown(store.read()) == rows and sorted(tuple(r) for r in store.members.read().collect()) == marks
    assert session_state.sessions(session_state.heads(df.limit(0))).count() == 0


def test_records_without_a_key_belong_to_no_session(spark):
    """What is there of ids, stamps and files makes the key; with nothing of it a record is left out."""
    named, bare = '{"a": {"session-id": "s"}}', '{"session_id": ""}'
    odd = [("opencode", None, None, named, None), ("opencode", "", None, bare, None), ("opencode", "", 5, bare, None), ("opencode", "n", None, None, "f"), ("claude", None, 5, named, ""), ("claude", "", 5, named, None), ("claude", None, 5, "", "f"), (None, "n", 5, named, "f")]
    df = spark.createDataFrame([(s, n, ms, "message", "", "", "", "", meta, file, k, 0) for k, (s, n, ms, meta, file) in enumerate(odd)], REC)
    assert sorted((r.line, r.group_key) for r in session_state.bearing(df).collect()) == [(0, "s"), (2, "__ungrouped__5"), (3, "__ungrouped__n"), (5, ""), (6, "f")]


def batch_cadence(spark, stamps):
    got = rollups.cadence(spark.createDataFrame(stamps, "source_id string, ms long")).collect()
    return sorted((r.source_id, r.median_gap_ms, r.sample_size, r.watermark_ms) for r in got)


def test_cadence_state_equals_batch_and_outlives_a_restart(spark, tmp_path):
    own, rng = cadence.session(spark), np.random.default_rng(2)
    table, seen = cadence.cadence_table(spark, str(tmp_path / "table")), []
    for k, n in enumerate((15, 400, 60)):  # a stream that ends, and one that goes on from its state
        rows = [(s, int(ms)) for s, top in (("claude", 10_000), ("codex", 3_000_000)) for ms in rng.integers(0, top * (k + 1), n)] + seen[:5]
        rows += [("late", 1000 * k), ("late", 1000 * k), (None, 5), ("late", None)]
        seen += rows
        spark.createDataFrame(rows, "source_id string, ms long").repartition(3).write.mode("append").parquet(str(tmp_path / "stamps"))
        stream = own.readStream.schema("source_id string, ms bigint").parquet(str(tmp_path / "stamps"))
        cadence.run(stream, table, str(tmp_path / "checkpoint")).awaitTermination()
        good = [r for r in seen if None not in r]
        got = sorted((r.source_id, r.median_gap_ms, r.sample_size, r.watermark_ms) for r in table.read().collect())
        assert got == batch_cadence(spark, good)
    assert {r.cadence for r in table.read().collect()} == {"stale", "insufficient data"}
    assert "spark.sql.streaming.stateStore.providerClass" not in {k for k, v in spark.conf.getAll.items() if v == cadence.STORE}


def test_a_source_turns_stale_by_its_timer(spark, tmp_path):
    import time

    own = cadence.session(spark)
    now = int(time.time() * 1000)
    stamps = [("claude", now - 100 * k) for k in range(30)] + [("codex", now - 3_600_000 * k) for k in range(30)]
    spark.createDataFrame(stamps, "source_id string, ms long").write.parquet(str(tmp_path / "stamps"))
    stream = own.readStream.schema("source_id string, ms bigint").parquet(str(tmp_path / "stamps"))
    table = cadence.cadence_table(spark, str(tmp_path / "table"))
    waiting = cadence.run(cadence_input := stream, table, str(tmp_path / "checkpoint"), processingTime="1 second")
    try:
        for _ in range(60):
            time.sleep(1)
            told = {r.source_id: r.cadence for r in table.read().collect()}
            if told.get("claude") == "stale" and told.get("codex"):
                break
    finally:
        waiting.stop()
    assert cadence_input.isStreaming and told == {"claude": "stale", "codex": "ok"}


def test_trimmed_stamps_lose_none_of_the_newest(spark):
    rows = [("a", k % 700) for k in range(3000)]
    got = cadence.newest(spark.createDataFrame(rows, "source_id string, ms long").repartition(4))
    assert got.count() <= 800 and sorted({r.ms for r in got.collect()})[-200:] == list(range(500, 700))


def test_ingest_appends_and_repeats_nothing(spark, tmp_path):
    rec = lambda low, high: spark.range(low, high).select(F.lit("claude").alias("source_id"), F.concat(F.lit("n"), "id").alias("native_id"), (F.col("id") * 1000).alias("timestamp_ms"), F.lit("message").alias("record_type"), F.lit("user").alias("role"), F.lit("").alias("tool_name"), F.lit("x").alias("content_excerpt"), F.lit("f").alias("source_file"))
    store = ingest.Store(spark, str(tmp_path / "store"))
    ingest.take(store, rec(0, 500), "s", 0)
    ingest.take(store, rec(0, 500), "s", 0)
    ingest.take(store, rec(400, 510))  # another reader of the same files
    ingest.take(store, rec(0, 0))
    parts = store.turns.document()["parts"]
    assert [p["rows"] for p in parts] == [500, 10] and store.read("turns").count() == 510
    assert store.read("marks").first().last_ms == 509_000
    assert tuple(store.read("cadence").first()) == ("claude", 1000, 200, 509_000)
    for k in range(20):
        ingest.take(store, rec(600 + k, 601 + k))
    assert len(store.turns.document()["parts"]) <= 16 and store.read("turns").count() == 530


def test_many_small_files_are_one_batch(spark, tmp_path):
    """Batches are by bytes, so a store of small files does not match its turns once a thousand files (F5)."""
    import os

    os.makedirs(tmp_path / "log")
    for k in range(1100):
        (tmp_path / "log" / f"{k}.jsonl").write_text(f'{{"timestamp": "2024-01-01T00:00:00.{k % 1000:03d}Z", "type": "user", "uuid": "n{k}", "message": {{"content": "x"}}}}\n')
    store = ingest.Store(spark, str(tmp_path / "store"))
    ingest.ingest(spark, "claude", str(tmp_path / "log"), store, str(tmp_path / "checkpoint")).awaitTermination()
    assert [n for n in os.listdir(tmp_path / "checkpoint" / "offsets") if n.isdigit()] == ["0"]
    assert store.read("turns").count() == 1100


def test_a_batch_s_files_are_listed_in_few_tasks(spark, tmp_path):
    """Not each file by a task of its own (F2)."""
    place = tmp_path / "in"
    place.mkdir()
    most = 4 * spark.sparkContext.defaultParallelism
    for k in range(3 * most):
        line = {"type": "user", "timestamp": "2024-01-01T00:00:01Z", "uuid": f"n{k}", "message": {"content": "x"}}
        (place / f"{k}.jsonl").write_text(json.dumps(line) + "\n")
    store = ingest.Store(spark, str(tmp_path / "store"))
    stream = ingest.ingest(spark, "claude", str(place), store, str(tmp_path / "checkpoint"))
    stream.awaitTermination()
    seen = spark.sparkContext.statusTracker()
    stages = [seen.getStageInfo(s) for j in seen.getJobIdsForGroup(str(stream.runId)) for s in seen.getJobInfo(j).stageIds]
    assert stages and max(s.numTasks for s in stages if s) <= most
    assert store.read("turns").count() == 3 * most


def test_a_line_is_parsed_once(spark):
    """No filter on what a line holds moves below the step that parses it, where it would parse the line again (F2)."""
    rows = spark.range(10).select(F.lit("f").alias("source_file"), F.lit(0).alias("block"), F.concat(F.lit('{"a": '), "id", F.lit("}")).alias("value"))
    plan = stores.claude(spark, stores.numbered(rows)).select("native_id", "timestamp_ms", "role")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1, plan
