"""Written artifacts against a plain reading of them; costs and what is known of sources on odd rows."""

from __future__ import annotations

import posixpath
import random
import re
import statistics

from pyspark.sql import functions as F

from sessionloom.functions import text as T
from sessionloom.operators import artifacts, bundle, rollups, sessions

HOME = "/var/out/p"
STAMPS = [("resumption", "ab"), ("review", "cd")]


def whole(**other) -> str:
    body = {name: "as seen" for name in artifacts.REQUIRED} | other
    return "# T\n" + "".join(f"## {name}\n\n{text}\n" for name, text in body.items() if text is not None) + "\ncompiler=ab\n"


def told(spark, rows, known=("/opt/a/b.txt",)):
    made = spark.createDataFrame([(*r, "own") for r in rows], "path string, content string, kind string")
    return artifacts.check(made, spark.createDataFrame([(k,) for k in known], "path string"), spark.createDataFrame(STAMPS, "kind string, stamp string"))


def one(spark, content, name="resumption.md", **known):
    return told(spark, [(f"{HOME}/prompts/{name}", content)], **known).collect()[0].asDict()


def test_sound_artifact(spark):
    r = one(spark, whole(Scope="see /opt/a/b.txt and /opt/a."))
    assert r["ok"] and r["sections_found"] == 12 and r["checked_citations"] == 2 and r["broken"] == []


def test_each_fault_fails(spark):
    faults = {
        "missing_sections": whole(**{"Git state": None}),
        "empty_sections": whole(**{"Git state": " (NONE) "}),
        "broken_citations": whole(Scope=f"/opt/a/c {HOME}/evidence/../other /opt/a/b.txt"),
        "unresolved_skill_refs": whole(Scope="Skill(x"),
        "missing_skill_bodies": whole(Scope='<skill name="x" missing="true"></skill>'),
        "relative_evidence_refs": whole(Scope="at evidence/x.png"),
        "stale_stamps": whole() .replace("compiler=ab", "no stamp"),
    }
    rows = told(spark, [(f"/r/{name}/prompts/resumption.md", text) for name, text in faults.items()]).collect()
    for r in rows:
        name = r["path"].split("/")[2]
        assert not r["ok"] and {f for f in faults if r[f]} == {name}, r
    broken = next(r for r in rows if "broken" in r["path"])
    assert broken["broken"] == ["/opt/a/c", f"{HOME}/evidence/../other"]


def test_evidence_folder_is_exempt_for_its_own_artifact_alone(spark):
    text = whole(Scope=f"{HOME}/evidence {HOME}/evidence/a {HOME}/prompts/../evidence/b {HOME}/evidence2/c")
    r = one(spark, text)
    assert (r["prerequisite_citations"], r["broken"]) == (3, [f"{HOME}/evidence2/c"])
    other = told(spark, [("/elsewhere/resumption.md", text)]).collect()[0]
    assert (other["prerequisite_citations"], other["broken_citations"]) == (0, 4)


def test_skill_text_is_no_claim_and_last_title_counts(spark):
    r = one(spark, whole(Scope="<skill a>\n/opt/none evidence/q\n</skill>") + "\n## Scope\n(none)\n")
    assert (r["checked_citations"], r["relative_evidence_refs"], r["hollow"], r["sections_found"]) == (0, 0, ["Scope"], 12)


def test_odd_rows(spark):
    rows = [(None, "x"), ("/r/prompts/review.md", None), ("/r/prompts/review.md", None), ("/r/prompts/odd.md", "compiler=cd"), ("/r/prompts/long.review.md", "/opt/a/b.txt " * 50_000)]
    got = {r["path"]: r for r in told(spark, rows).collect()}
    assert len(got) == 3 and got["/r/prompts/review.md"]["stale_stamps"] == 1 and not got["/r/prompts/review.md"]["ok"]
    assert got["/r/prompts/odd.md"]["stamp_errors"] == 1 and not got["/r/prompts/odd.md"]["ok"]
    assert got["/r/prompts/long.review.md"]["kind"] == "long.review" and got["/r/prompts/long.review.md"]["checked_citations"] == 1


def test_tree(spark):
    lost = whole(Scope='<skill name="z" missing="true"/> <skill name="a" missing="true"/>')
    checked = told(spark, [("/x/prompts/resumption.md", whole()), ("/y/prompts/resumption.md", lost), ("/y/q/prompts/resumption.md", lost)])
    root = F.regexp_extract("path", "^(/[^/]+)", 1)
    got = {r["root"]: r for r in artifacts.tree(checked, root).collect()}
    assert {k: (r["artifact_count"], r["failing"], r["missing_skill_bodies"], r["verdict"]) for k, r in got.items()} == {"/x": (1, 0, 0, "PASS"), "/y": (2, 2, 4, "FAIL"), None: (3, 2, 4, "FAIL")}
    assert sorted(artifacts.lost_names(checked, root).collect()) == [("/y", "a"), ("/y", "z")]
    empty = artifacts.tree(told(spark, []), root).collect()
    assert [(r["root"], r["artifact_count"], r["verdict"]) for r in empty] == [(None, 0, "FAIL")]


def test_resolved_paths(spark):
    paths = ["/", "/a/../..", "/a/./b//c/", "/a/b/../../c", "/../x", "/a/..b/c"]
    got = spark.createDataFrame([(p,) for p in paths], "p string").select(artifacts.resolved(F.col("p"))).collect()
    assert [r[0] for r in got] == [posixpath.normpath(p) for p in paths]


def test_rooted_evidence_equals_plain_replacement(spark):
    pattern = re.compile(r"(?<![\w/])(\.?/?)evidence/(?P<rest>\S*)")
    plain = lambda t: pattern.sub(lambda m: m.group(0) if set(m.group("rest")) & set("{}<>*") else f"/r/{m.group('rest')}", t)
    rng = random.Random(3)
    bits = ["evidence/", "./evidence/", "/evidence/", "a", "é", " ", "\n", "{n}", "<", "*", ".", "(", "$1", "\\"]
    texts = ["", *("".join(rng.choices(bits, k=rng.randrange(12))) for _ in range(600))]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", T.rooted_evidence(F.col("t"), F.lit("/r")).alias("r")).collect()
    assert [r["r"] for r in got] == [plain(r["t"]) for r in got]


def test_deciles_equal_plain_ones_for_any_values(spark):
    rng = random.Random(5)
    groups = {"one": [2.5], "none": [None], "ties": [1.0] * 40 + [2.0], "signs": [rng.uniform(-1, 1) * 10 ** rng.randrange(-9, 9) for _ in range(500)] + [0.0, -0.0], "close": [1 + k * 1e-12 for k in range(300)], "nine": list(map(float, range(1, 10))), "ten": list(map(float, range(1, 11)))}
    rows = spark.createDataFrame([(k, v) for k, vs in groups.items() for v in vs], "k string, v double")
    got = {r["k"]: r for r in rollups.exclusive_deciles(rows, "k", "v").collect()}
    assert set(got) == set(groups) - {"none"}
    for k, r in got.items():
        vs = groups[k]
        want = statistics.quantiles(vs, n=10)[8] if len(vs) >= 10 else max(vs)
        assert r["n"] == len(vs) and abs(r["p50"] - statistics.median(vs)) <= 1e-9 * abs(r["p50"]) and abs(r["quantile"] - want) <= 1e-9 * abs(want), k


def test_costs_on_odd_rows(spark):
    projects = spark.createDataFrame([("a",), ("a",), ("b",)], "project string")
    linked = spark.createDataFrame([("a", "s", 1.0, "exact"), ("a", "s", None, None), ("a", "t", 2.0, ""), ("gone", "s", 9.0, "high"), (None, None, 5.0, None)], "project string, session string, cost double, confidence string")
    episodes = spark.createDataFrame([("a", "complete"), ("a", "complete"), ("b", "in_progress")], "project string, status string")
    costs = rollups.project_costs(projects, linked, episodes)
    got = {r["project"]: tuple(r)[1:] for r in costs.collect()}
    assert got == {"a": (3.0, 3, 2, 1.5, {"exact": 1, "unknown": 2}), "b": (0.0, 0, 0, 0.0, {})}
    assert tuple(rollups.cost_summary(costs).collect()[0]) == (3.0, 1.5, 3.0, 2)
    assert tuple(rollups.cost_summary(costs.limit(0)).collect()[0]) == (0.0, 0.0, 0.0, 0)


def test_sources_and_skipped_rows(spark):
    rows = lambda data, schema: spark.createDataFrame(data, schema)
    got = rollups.source_overview(rows([("a", 3), ("b", 0)], "source_id string, records bigint"), rows([("a", 100), ("c", 5)], "source_id string, last_ms bigint"), rows([("a", 10, 30), ("d", None, 2)], "source_id string, median_gap_ms bigint, sample_size bigint"), 150)
    assert {tuple(r) for r in got.collect()} == {("a", True, 3, None, True, "ok"), ("b", False, 0, "no records in window", False, None), ("c", False, 0, "no records in window", True, None), ("d", False, 0, "no records in window", False, "insufficient data")}
    ses = rows([("a", "f", ""), ("a", "g", "/p"), ("b", "f", "/p"), ("c", "h", None)], "source_id string, source_file string, project_path string")
    rec = rows([("a", "f", "message"), ("a", "f", "error"), ("a", "g", "message"), ("b", "f", "message")], "source_id string, source_file string, record_type string")
    links = rows([("a", "f"), ("a", "f"), ("b", "f"), (None, None)], "source_id string, source_file string")
    assert {tuple(r) for r in sessions.skipped(ses, rec, links).collect()} == {("a", 1, 1, 2), ("b", 0, 0, 0), ("c", 1, 0, 0)}


def test_bundles_newest_first(spark):
    schema = "bundle_id string, project_name string, source_file string, exported_ms bigint, imported_ms bigint, session_count int, turn_count int, payload string"
    rows = spark.createDataFrame([("b", "p", "f", 1, 5, 1, 1, ""), ("a", "p", "f", 1, 5, 1, 1, ""), ("c", "p", "f", 1, 9, 1, 1, ""), ("d", None, None, None, None, None, None, None)], schema)
    assert [r["bundle_id"] for r in bundle.listed(rows).collect()] == ["c", "a", "b", "d"]
    assert [r["bundle_id"] for r in bundle.listed(rows, 1).collect()] == ["c"]
