"""Plans that must stay small, and state that two writers share."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from sessionloom.operators import rollups, session_state, sessions, state
from sessionloom.operators.delta import DeltaTable
from sessionloom.plans import catalog


@pytest.mark.parametrize("name", ["link_first_tier", "cost_rollup", "cost_per_project", "unlinked_requests"])
def test_links_read_the_records_few_times(spark, sf_dir, name):
    """Sessions and requests are written once; the records are read for ids and for fingerprints only."""
    plan = catalog.QUERIES[name](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation [") <= 2 and plan.count("Join ") <= 10, plan


def test_deciles_gather_no_group(spark, sf_dir):
    plan = catalog.QUERIES["cost_deciles"](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_list" not in plan
    df = spark.createDataFrame([("a", float(v)) for v in range(1, 11)] + [("b", 5.0), ("b", 1.0), ("c", None)], "k string, v double")
    got = {r.k: (r.n, r.total, r.p50, r.quantile) for r in rollups.exclusive_deciles(df, "k", "v").collect()}
    assert got == {"a": (10, 55.0, 5.5, 9.9), "b": (2, 6.0, 3.0, 5.0)}


def test_refused_spends_are_not_made(spark):
    rows = [("p", k, c) for k, c in enumerate([4.0, 3.0, 2.0, 1.0, 0.5])] + [("q", k, c) for k, c in enumerate([5.0, 5.0, 1.0])] + [("r", 0, 0.0), ("r", 1, 1.0)]
    spends = spark.createDataFrame(rows, "k string, at long, cost double")
    got = sorted((r.k, r["at"], r.remaining, r.reason) for r in rollups.spend_gate(spends, "k", "at", "cost", 10.0, cell=2).collect())
    assert got == [
        ("p", 0, 10.0, "admitted"), ("p", 1, 6.0, "admitted"), ("p", 2, 3.0, "cap_insufficient_remaining"), ("p", 3, 3.0, "cap_insufficient_remaining"), ("p", 4, 3.0, "cap_insufficient_remaining"),
        ("q", 0, 10.0, "admitted"), ("q", 1, 5.0, "admitted"), ("q", 2, 0.0, "cap_insufficient_remaining"),
        ("r", 0, 10.0, "admitted"), ("r", 1, 10.0, "admitted"),
    ]


def test_of_two_writers_the_second_fails(spark, tmp_path):
    one, two = (state.VersionedTable(spark, str(tmp_path / "t")) for _ in range(2))
    assert one.read() is None and one.commit(spark.range(3).toDF("id"), one.number()) == 1
    base = one.number()
    assert two.number() == base and one.commit(spark.range(5).toDF("id"), base) == 2
    with pytest.raises(RuntimeError, match="version 2"):
        two.commit(spark.range(9).toDF("id"), base)
    assert two.read().count() == 5 and two.read(1).count() == 3
    assert two.commit(spark.range(9).toDF("id"), two.number()) == 3 and one.read().count() == 9


def test_updates_of_one_key_have_a_fixed_winner(spark):
    stored = spark.createDataFrame([(1, "a", 5)], "id long, name string, n int")
    seen = spark.createDataFrame([(1, "z", 1, 2), (1, "b", 9, 1), (2, "q", None, 1), (2, "p", 3, 1)], "id long, name string, n int, seq int")
    got = state.upsert(stored, seen, ["id"], {"name": state.new_value, "n": state.filled}, order="seq").orderBy("id").collect()
    assert [tuple(r) for r in got] == [(1, "z", 1), (2, "q", None)]


def test_scrub_refuses_unknown_columns(spark):
    tables = {"sessions": spark.createDataFrame([("x password=abcdefgh1",), ("main",), (None,)], "git_branch string")}
    cleaned, counts = state.scrub(tables)
    assert sorted(str(r[0]) for r in cleaned["sessions"].collect()) == ["None", "main", "x password=REDACTED_SECRET"] and counts["sessions"].first()[0] == 1
    with pytest.raises(ValueError, match="sessions.git_branch"):
        state.scrub({"sessions": spark.range(1)})


def test_overlapping_sessions_meet_no_request_one_by_one(spark):
    """Spans of every length against all pairs, and no join of requests with sessions in the plan."""
    dice = random.Random(7)
    lengths = [0, 0, 1, 3, 4, 63, 64, 65, 1000, 70_000]
    spans = [("s", str(k), low, low + (5_000_000 if k == 1 else dice.choice(lengths)), f"p{dice.randrange(3)}" if k % 4 else "", dice.choice(["a", "b", "", None])) for k in range(600) for low in [dice.randrange(-6_000_000, 6_000_000)]]
    asked = [(k, None if k == 5 else spans[k][2] + dice.choice([-30_001, -30_000, -7, -1, 0, 0, 1, 4, 30_000, 60_000]), dice.choice(["a", "b", "c", None])) for k in range(400)]
    ses = spark.createDataFrame(spans, "source_id string, source_file string, started_ms long, ended_ms long, project_path string, model string")
    req = spark.createDataFrame(asked, "native_id long, ms long, model string")
    for window in (0, 7, 30_000):
        want = []
        for own, ms, model in asked:
            met = [s for s in spans if ms is not None and model and s[5] == model and s[4] and s[2] - window <= ms <= s[3] + window]
            if len({s[4] for s in met}) == 1:
                s = min(met, key=lambda s: (s[2], s[0], s[1]))
                want.append((own, s[0], s[1], s[4]))
        found = sessions.tier2(req, ses, window)
        assert want and sorted(map(tuple, found.collect())) == want
        assert "Join Inner" not in found._jdf.queryExecution().optimizedPlan().toString()


def test_compaction_merges_in_many_tasks(spark, tmp_path):
    """Few files are written, but not by having as few tasks merge all parts."""
    table = DeltaTable(spark, str(tmp_path / "t"), "id bigint, n bigint", lambda rows: rows.groupBy("id").agg(F.sum("n").alias("n")))
    for k in range(2):
        table.append(spark.range(100).select("id", F.lit(k).alias("n")), "s", k)
    write, plans = table._write, []
    table._write = lambda rows: plans.append(rows._jdf.queryExecution().optimizedPlan().toString()) or write(rows)
    table.compact()
    assert "Repartition 1, true" in plans[0] and len(table.document()["parts"]) == 1
    assert table.read().agg(F.count("*"), F.sum("n")).first() == (100, 100)


def test_sessions_parse_a_record_once_in_all_tasks(spark, tmp_path):
    """A batch's records are dealt before they are parsed, and neither a test of the key nor nested objects parse them again."""
    rec = spark.range(200).select(
        F.lit("opencode").alias("source_id"), F.concat(F.lit("n"), "id").alias("native_id"), F.col("id").alias("timestamp_ms"), F.lit("message").alias("record_type"), F.lit("/p").alias("project_path"), F.lit("b").alias("git_branch"),
        F.lit("m").alias("model"), F.lit("x").alias("content_excerpt"), F.lit('{"sessionId": "s", "z": {"user_id": "u"}}').alias("raw_meta"), F.lit("f").alias("source_file"), F.col("id").alias("line"), F.lit(0).alias("source_order"),
    ).coalesce(1)
    store, plans = session_state.SessionStore(spark, str(tmp_path / "t")), []
    for table in (store.members, store.heads):
        write = table._write
        table._write = lambda rows, write=write: plans.append(rows._jdf.queryExecution().optimizedPlan().toString()) or write(rows)
    store.fold(rec, "s", 0)
    assert [("RebalancePartitions" in p, p.count("from_json(") <= most) for p, most in zip(plans, (6, 4), strict=True)] == [(True, True)] * 2, plans
    assert store.members.read().count() == 200 + 1 + 2 and store.read().count() == 1
