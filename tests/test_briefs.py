"""Briefs of projects on odd rows."""

from __future__ import annotations

from sessionloom.operators import views

EPISODE = "project long, session_id long, status string, drift string, pivot_ms long, started_ms long, ended_ms long, intent string"


def test_notes_on_odd_rows(spark):
    episodes = spark.createDataFrame([(1, 1, "abandoned", "pivot", None, None, None, None), (1, 2, "in_progress", None, None, None, 5, "x"), (None, 3, "abandoned", None, None, None, 1000, "see /tmp/a now")], EPISODE)
    findings = spark.createDataFrame([(1, 7, "error_burst", "high", "t", "d", "agent", [(1000, None, None)] * 5), (1, 8, "docs_drift", "low", "t", "d", None, None), (1, 9, "tech_debt", "low", "t", "d", None, [(1, "a", "b")])], "project long, finding long, category string, severity string, title string, detail string, provenance string, citations array<struct<ts_ms: long, role: string, excerpt: string>>")
    got = {(r.list, r.item, r.place): r.line for r in views.notes(episodes, findings).collect()}
    assert sorted(got) == [("decisions", "1", 0), ("gotchas", "1", 0), ("gotchas", "3", 0), *[("gotchas", "7", n) for n in range(4)], ("gotchas", "8", 0)]
    assert got["decisions", "1", 0] == "Pivot detected at unknown: intent drifted (pivot) away from “”"
    assert "<<ephemeral-runtime-path>> now" in got["gotchas", "3", 0] and got["gotchas", "7", 1] == "    1970-01-01T00:00:01Z ?: "
    assert got["gotchas", "7", 0].startswith("(A) [high/error_burst]")


def test_plans_take_the_newest_and_say_where_there_are_none(spark):
    rows = [(1, n, "abandoned", None, None, n, None if n == 9 else 5, None if n == 1 else f"task {n}") for n in (1, 2, 3, 9)]
    episodes = spark.createDataFrame([*rows, (2, 1, "unverified", None, None, 1, 1, "x")], EPISODE)
    projects = spark.createDataFrame([(1,), (1,), (2,)], "project long")
    got = sorted((r.project, r.phase, r.task, r.after) for r in views.remediation(episodes, projects).collect())
    assert got == [(1, 1, "task 9", 0), (1, 2, "Unnamed work item", 1), (1, 3, "task 2", 2), (2, 1, "No unfinished episode was observed in this window; nothing to remediate.", None)]


def test_brief_takes_projects_of_any_table(spark):
    sessions = spark.createDataFrame([(1, "a", None, 9), (1, None, 4, 7), (None, "b", 1, 1)], "project long, source_id string, started_ms long, ended_ms long")
    episodes = spark.createDataFrame([(2, None), (2, "complete"), (2, "abandoned")], "project long, status string")
    findings = spark.createDataFrame([(3,), (3,)], "project long")
    got = {r.project: r for r in views.brief(sessions, episodes, findings).collect()}
    assert {k: (r.started_ms, r.ended_ms, r.sessions, r.harnesses, r.episodes, r.in_progress, r.abandoned, r.findings) for k, r in got.items()} == {1: (0, 9, 2, 2, 0, 0, 0, 0), 2: (0, 0, 0, 0, 3, 1, 1, 0), 3: (0, 0, 0, 0, 0, 0, 0, 2)}
    assert got[3].scope == "Observed window: unknown → unknown across 0 correlated session(s) from 0 harness(es), 0 intent episode(s), 2 deterministic finding(s)."
    assert views.brief(sessions.limit(0), episodes.limit(0), findings.limit(0)).count() == 0
