"""Readers of the foreign stores on small hand-made trees and databases."""

from __future__ import annotations

import json
import sqlite3

import pytest
from pyspark.sql import functions as F

from sessionloom.plans import source_queries
from sessionloom.sources import stores

TS = "2024-01-0{}T00:00:0{}Z"
MS = 1_704_067_200_000  # 2024-01-01
DAY = 86_400_000


def write(path, rows):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text("\n".join(r if isinstance(r, str) else json.dumps(r) for r in rows) + "\n")


def rows(df):
    return [r.asDict() for r in df.orderBy("source_file", "line").collect()]


def test_claude(spark, tmp_path):
    block = [{"type": "text", "text": "hi"}, {"type": "tool_use", "name": "X"}, 5]
    write(tmp_path / "-proj-a" / "s1.jsonl", [
        {"timestamp": TS.format(2, 1), "type": "user", "uuid": "u1", "cwd": "/proj/b", "gitBranch": "main", "message": {"role": "user", "content": "my token=abcdefgh12345"}},
        "", "{broken", "[1]",
        {"timestamp": TS.format(2, 2), "type": "assistant", "uuid": "u2", "cwd": "/x/../y", "message": {"model": "m", "content": block}},
        {"timestamp": TS.format(2, 3), "type": "system", "subtype": "error", "uuid": "u3", "hookErrors": "bad thing"},
        {"timestamp": TS.format(1, 1), "type": "user", "uuid": "old", "message": {"content": "stale"}},
        {"timestamp": "nope", "type": "user", "uuid": "x"},
        {"timestamp": TS.format(2, 4), "type": "summary"},
    ])
    write(tmp_path / "subagents" / "s2.jsonl", [{"timestamp": TS.format(2, 1), "type": "user", "uuid": "sub"}])
    got = rows(stores.claude(spark, str(tmp_path), MS + DAY - 1, known_paths=["/proj/a"]))
    assert [(r["native_id"], r["record_type"], r["role"], r["project_path"], r["content_excerpt"], r["error_text"], r["line"]) for r in got] == [
        ("u1", "message", "user", "/proj/b", "my token=REDACTED_SECRET", "", 1),
        ("u2", "message", "assistant", "/proj/a", "hi [tool:X]", "", 5),
        ("u3", "error", "", "/proj/a", "", "bad thing", 6),
    ]
    assert got[0]["git_branch"] == "main" and got[1]["model"] == "m"
    bad = {r.source_file.rsplit("/", 1)[-1]: (r.malformed, r.first_bad_line, r.not_objects) for r in stores.malformed(spark, [str(tmp_path)]).collect()}
    assert bad == {"s1.jsonl": (1, 3, 1), "s2.jsonl": (0, None, 0)}
    assert stores.claude(spark, str(tmp_path / "none")).count() == 0
    assert stores.discover(spark, "claude", str(tmp_path)) == (True, 1) and stores.discover(spark, "claude", str(tmp_path / "none")) == (False, 0)


def test_codex(spark, tmp_path):
    meta = {"timestamp": TS.format(2, 1), "type": "session_meta", "payload": {"cwd": "/p/a", "id": "s1", "model": "m"}}
    body = [
        {"timestamp": TS.format(2, 2), "type": "response_item", "payload": {"type": "message", "role": "user", "id": "i1", "content": [{"text": "a"}, "b", {"text": ""}]}},
        {"timestamp": TS.format(2, 3), "type": "response_item", "payload": {"type": "function_call", "name": "run"}},
        {"timestamp": TS.format(2, 4), "type": "event_msg", "payload": {"type": "stream_Error", "message": "boom"}},
        {"timestamp": TS.format(2, 5), "type": "event_msg", "payload": {"type": "ok"}},
    ]
    write(tmp_path / "sessions" / "2024" / "a.jsonl", [meta, *body])
    write(tmp_path / "archived_sessions" / "b.jsonl", [body[0]])
    got = rows(stores.codex(spark, str(tmp_path)))
    assert [(r["native_id"], r["record_type"], r["role"], r["project_path"], r["content_excerpt"], r["tool_name"], r["error_text"]) for r in got] == [
        ("i1", "message", "user", "", "a b", "", ""),
        ("s1", "session_start", "", "/p/a", "", "", ""),
        ("i1", "message", "user", "/p/a", "a b", "", ""),
        (str(MS + DAY + 3000), "tool_call", "tool", "/p/a", "", "run", ""),
        (str(MS + DAY + 4000), "error", "", "/p/a", "", "", "boom"),
    ]
    late = rows(stores.codex(spark, str(tmp_path / "sessions"), MS + DAY + 1000))
    assert len(late) == 3 and {r["project_path"] for r in late} == {""}  # the folder was named below the mark


def test_omp_and_pi(spark, tmp_path):
    write(tmp_path / "-p-a" / "day" / "s.jsonl", [
        {"timestamp": TS.format(2, 0), "type": "message", "id": "m0", "message": "plain"},
        {"timestamp": TS.format(2, 1), "type": "session", "id": "s", "cwd": "/p/b", "model": "m"},
        {"timestamp": TS.format(2, 2), "type": "message", "id": "m1", "message": {"role": "user", "content": [{"type": "text", "text": "x"}, "y", {"type": "image"}]}},
        {"timestamp": TS.format(2, 3), "type": "custom", "id": "c1", "customType": "tool_result", "data": {"name": None}},
        {"timestamp": TS.format(2, 4), "type": "custom", "id": "c2", "customType": "tool_error", "data": {"name": "sh", "error": "no"}},
        {"timestamp": TS.format(2, 5), "type": "custom", "id": "c3", "customType": "other", "data": {}},
    ])
    got = rows(stores.omp(spark, str(tmp_path), known_paths=["/p/a"]))
    assert [(r["native_id"], r["record_type"], r["role"], r["project_path"], r["model"], r["content_excerpt"], r["tool_name"], r["error_text"]) for r in got] == [
        ("m0", "message", "", "/p/a", "", "plain", "", ""),
        ("s", "session_start", "", "/p/b", "m", "", "", ""),
        ("m1", "message", "user", "/p/b", "m", "x y", "", ""),
        ("c1", "tool_call", "tool", "/p/b", "m", "", "tool_result", ""),
        ("c2", "error", "tool", "/p/b", "m", "", "sh", "no"),
    ]
    assert {r["source_id"] for r in rows(stores.READERS["pi"](spark, str(tmp_path)))} == {"pi"}
    both = stores.scan(spark, {"omp": str(tmp_path), "claude": str(tmp_path)}, {})
    assert {(r.source_order, r.source_id) for r in both.collect()} >= {(0, "omp")}


@pytest.fixture
def opencode_db(tmp_path):
    path = str(tmp_path / "opencode.db")
    with sqlite3.connect(path) as db:
        db.executescript("""create table session(id, project_id, directory, title, time_created, time_updated, model, agent);
            create table message(id, session_id, time_created, data); create table part(message_id, data, time_created);
            insert into session values ('s1', 'p', '/p/a', 't', 50, 500, 'm', 'a'), ('s2', 'p', '/p/b', 't', 200, 300, null, 'a'), ('s3', 'p', '/p/c', 't', 10, 90, 'm', 'a');""")
        db.executemany("insert into message values (?,?,?,?)", [("m1", "s1", 150, '{"role":"user"}'), ("m2", "s1", 99, "{}"), ("m3", "s2", 250, "{broken"), ("m4", "s2", 260, '{"role":"assistant"}')])
        db.executemany("insert into part values (?,?,?)", [("m1", '{"type":"tool","tool":"sh"}', 2), ("m1", '{"type":"text","text":"run"}', 1), ("m1", "x", 3), ("m4", '{"type":"step"}', 1)])
    return path


def test_opencode(spark, opencode_db):
    got = stores.opencode(spark, opencode_db, 100).orderBy("timestamp_ms").collect()
    assert [(r.native_id, r.record_type, r.role, r.project_path, r.model, r.content_excerpt) for r in got] == [
        ("m1", "message", "user", "/p/a", "m", "run [tool:sh]"),
        ("s2", "session_start", "", "/p/b", "", ""),
        ("m4", "message", "assistant", "/p/b", "", ""),
    ]
    assert json.loads(got[0].raw_meta)["session_id"] == "s1"
    assert stores.sqlite_health(opencode_db, stores.OPENCODE) == ("ok", "")
    with sqlite3.connect(opencode_db) as db:
        db.execute("alter table message rename column data to body")
        db.execute("drop table part")
    assert stores.sqlite_health(opencode_db, stores.OPENCODE) == ("drifted", "message missing data; table part is gone")
    assert stores.sqlite_health(opencode_db + "x", stores.OPENCODE)[0] == "absent"


def test_router(spark, tmp_path):
    path = str(tmp_path / "data.sqlite")
    with sqlite3.connect(path) as db:
        db.execute("create table usageHistory(id integer primary key, timestamp text, provider, model, connectionId, endpoint, promptTokens, completionTokens, cost, status)")
        db.executemany("insert into usageHistory values (?,?,?,?,?,?,?,?,?,?)", [
            (1, TS.format(1, 1), "p", "m", "c", "/v1", 1, 2, 0.5, "200"), (2, TS.format(2, 1), "p", None, None, None, None, None, None, 200), (3, "bad", "p", "m", "c", "e", 1, 1, 1.0, "x"), (9, TS.format(3, 1), b"blob", "m", "c", "e", 7, 8, 2, "ok"),
        ])
    rec = stores.router(spark, path, MS + 1000)
    assert sorted(r.native_id for r in rec.collect()) == ["2", "9"]
    got = {r.native_id: r for r in stores.request_columns(rec).collect()}
    assert (got["2"].model, got["2"].status, got["2"].cost_usd, got["9"].provider, got["9"].prompt_tokens, got["9"].cost_usd) == ("", "200", None, "blob", 7, 2.0)
    table = stores.sqlite_table(spark, path, "usageHistory", stores.ROUTER)
    assert table.where(F.col("cost") > 0.6).count() == 2
    assert spark.read.format("sqlite").schema("id bigint").option("path", path).option("table", "usageHistory").option("rowsPerTask", 2).load().count() == 4


def test_format_health(spark, tmp_path):
    write(tmp_path / "a.jsonl", [{"timestamp": 1, "type": 2}] * 3 + ["{x", "[1]", {"type": 1}])
    assert tuple(stores.jsonl_health(spark, str(tmp_path), stores.FORMAT_KEYS["claude"]).first()) == ("ok", 4, 3, "timestamp")
    write(tmp_path / "b" / "c.jsonl", [{"type": 1}, {"timestamp": 1, "type": 2}])
    import os
    import time

    os.utime(tmp_path / "a.jsonl", (time.time() - 100,) * 2)
    assert tuple(stores.jsonl_health(spark, str(tmp_path), stores.FORMAT_KEYS["claude"]).first()) == ("drifted", 2, 1, "timestamp")
    assert stores.jsonl_health(spark, str(tmp_path / "none"), ["x"]).first().outcome == "absent"


def test_lines_of_split_files_keep_their_numbers(spark, tmp_path):
    """A large file is read by several tasks; each line has its number in the file all the same."""
    (tmp_path / "big.jsonl").write_text("".join(f'{{"n": {k}}}\r\n' if k % 7 else "\n" for k in range(1, 200_001)))
    (tmp_path / "small.jsonl").write_text('{"n": 1}\n\n{"n": 3}')
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "200k")
    try:
        got = stores.lines(spark, [str(tmp_path)])
        assert spark.read.text(str(tmp_path / "big.jsonl")).rdd.getNumPartitions() > 5
        n = F.regexp_extract("value", "([0-9]+)", 1).cast("long")
        assert got.where(n != F.col("line")).count() == 0 and got.count() == 200_000 - 200_000 // 7 + 2
        assert got.where(F.col("value").contains("\r")).count() == 0
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_databases_of_a_folder(spark, tmp_path):
    """Ids hold within a file; a file in write-ahead mode is read; text that is no UTF-8 loses its odd bytes only."""
    for k, name in enumerate(("a.db", "b.db")):
        with sqlite3.connect(tmp_path / name) as db:
            if k:
                db.execute("pragma journal_mode=wal")
            db.executescript("create table session(id, project_id, directory, title, time_created, time_updated, model, agent); create table message(id, session_id, time_created, data); create table part(message_id, data, time_created);")
            db.execute("insert into session values ('s', 'p', ?, 't', 10, 20, 'm', 'a')", (f"/p/{k}",))
            db.execute("insert into message values ('m', 's', 15, '{}')")
            db.execute("insert into part values ('m', ?, 1)", (json.dumps({"type": "text", "text": f"t{k}"}),))
            db.execute("insert into part values ('m', cast(x'ff' as text), 2)")
        if k:
            db.execute("pragma wal_checkpoint(truncate)")
        db.close()
    got = stores.opencode(spark, str(tmp_path)).where("record_type = 'message'").collect()
    assert sorted((r.project_path, r.content_excerpt) for r in got) == [("/p/0", "t0"), ("/p/1", "t1")]


def test_the_last_of_repeated_keys_counts(spark, tmp_path):
    """In all three formats, at any depth, whatever the session allows."""
    stamp = f'"timestamp": "{TS.format(2, 1)}"'
    write(tmp_path / "c" / "a.jsonl", [f'{{{stamp}, "type": "x", "type": "user", "uuid": "u", "message": {{"content": "first", "content": "last"}}}}', '{"a": 1, "a": }', "\\u0000"])
    write(tmp_path / "x" / "a.jsonl", [f'{{{stamp}, "type": "session_meta", "payload": {{"cwd": "/p/a", "cwd": "/p/b", "id": "s"}}}}'])
    write(tmp_path / "o" / "a.jsonl", [f'{{{stamp}, "type": "message", "id": "no", "id": "m", "message": {{"role": "user", "content": "x", "content": [{{"type": "text", "text": "y"}}]}}}}'])
    for allowed in ("false", "true"):
        spark.conf.set("spark.sql.variant.allowDuplicateKeys", allowed)
        try:
            assert [(r["record_type"], r["content_excerpt"]) for r in rows(stores.claude(spark, str(tmp_path / "c")))] == [("message", "last")]
            assert [r["project_path"] for r in rows(stores.codex(spark, str(tmp_path / "x")))] == ["/p/b"]
            assert [(r["native_id"], r["content_excerpt"]) for r in rows(stores.omp(spark, str(tmp_path / "o")))] == [("m", "y")]
            assert stores.malformed(spark, [str(tmp_path / "c")]).first().malformed == 2
        finally:
            spark.conf.unset("spark.sql.variant.allowDuplicateKeys")


def test_databases_are_made_and_opened_once(spark, sf_dir):
    """Sessions, messages and parts come from one pass over the files; files are made without a call a file."""
    made = source_queries.source_opencode(spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" not in made and "FlatMapGroups" not in made
    asked = source_queries.source_router(spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert "FlatMapGroups" not in asked and asked.count("MapInArrow") == 2


def test_topic_logs_are_read_once(spark, tmp_path):
    """Both steps of topic_events read the fitting lines, not the files (F16)."""
    (tmp_path / "one.jsonl").write_text('{"ts_ms": 5, "topic": "t", "msg": "m"}\n')
    found = stores.topic_events(spark, str(tmp_path))
    assert "FileScan text" not in found._jdf.queryExecution().toString()
    assert [(r.ts_ms, r.msg, r.line) for r in found.collect()] == [(5, "m", 1)]


def test_files_are_read_once_where_no_number_is_asked_for(spark, tmp_path):
    write(tmp_path / "a.jsonl", ["", "x", "y"])
    found = stores.lines(spark, [str(tmp_path)])
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    assert [(r.line, r.value) for r in found.orderBy("line").collect()] == [(2, "x"), (3, "y")]
    assert plan(found.select("source_file", "value")).count("Relation ") == 1
    assert plan(stores.claude(spark, str(tmp_path)).drop("line")).count("Join ") == 0
