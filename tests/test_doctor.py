"""Each audit turned red by one planted fault; nothing to look at is no pass."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from sessionloom.operators import doctor

GOOD = {
    "turns": [(1, 10), (2, 10)], "ids": [(1,), (2,)], "records": [("n1", "claude", "message", 5)], "prompts": [(1, "see /root/evidence/a.txt and evidence/{n}")],
    "pages": [(1, "<p>~/work</p> <a href='#x'>")], "health": [("f1", "ok")],
}
FAULTS = {
    "STORE-1": ("ids", (1,)), "STORE-2": ("turns", (3, 99)), "R1-1": ("records", ("n2", "claude", "message", None)), "R6f-1": ("prompts", (2, "run Skill(x) now")), "R6g-1": ("prompts", (2, "see evidence/a.txt")),
    "N4-1": ("prompts", (2, "password=abcdefgh1")), "R14b-1": ("pages", (2, "at %2Fhome%2Fme")), "R14b-2": ("pages", (2, "<script src='//x.org/a.js'>")), "I2-1": ("health", ("f2", "drifted")),
}
SHAPES = {"turns": "id long, session long", "ids": "id long", "records": "native_id string, source_id string, record_type string, timestamp_ms long", "prompts": "id long, content string", "pages": "id long, html string", "health": "source_file string, outcome string"}


def told(spark, tables):
    t = {name: spark.createDataFrame(rows, SHAPES[name]) for name, rows in tables.items()}
    subjects = [
        doctor.repeated(t["ids"], "id", "STORE-1", "-"), doctor.orphans(t["turns"], spark.createDataFrame([(10,)], "session long"), "session", "id", "STORE-2", "-"), doctor.records(t["records"], ["claude"], ["message"]),
        doctor.artifacts(t["prompts"], "id", "content"), doctor.bundles(t["pages"], "id", "html", ["CANARY"], ["/home/me"]), doctor.formats(t["health"]),
    ]
    rows = doctor.report(subjects).collect()
    return {r.check: (r.verdict, r.faults, r.example) for r in rows}, {r.exit_code for r in rows}


def test_a_good_store_passes(spark):
    checks, code = told(spark, GOOD)
    assert code == {0} and set(checks) == set(FAULTS) and {v for v, *_ in checks.values()} == {"PASS"}


@pytest.mark.parametrize("check", FAULTS)
def test_one_fault_turns_its_audit_red(spark, check):
    table, row = FAULTS[check]
    checks, code = told(spark, GOOD | {table: [*GOOD[table], row]})
    assert code == {1} and {c for c, (v, *_) in checks.items() if v == "FAIL"} == {check}
    assert checks[check] == ("FAIL", 1, str(row[0]))


def test_nothing_to_look_at_is_no_pass(spark):
    checks, code = told(spark, GOOD | {"health": []})
    assert code == {2} and checks["I2-1"] == ("SKIP", 0, None)


def test_texts_are_dealt_to_all_cores(spark):
    """A file of one row group is no single task."""
    texts = spark.range(3).select("id", F.lit("x").alias("content")).coalesce(1)
    for subject in (doctor.artifacts(texts, "id", "content"), doctor.bundles(texts, "id", "content", ["c"], ["/h"])):
        assert subject.rows.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
