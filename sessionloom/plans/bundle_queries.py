"""Queries over bundles: export, validation of planted defects, import."""

from __future__ import annotations

import functools

from pyspark.sql import functions as F

from ..operators import bundle
from ..sources import views as V
from .registry import query

_KEY = "k3y"
_PADS = ["".join(f"{b ^ pad:02x}" for b in _KEY.encode().ljust(64, b"\0")) for pad in (0x36, 0x5C)]


def _hmac(text: str) -> str:
    return f"substr(sha256(unhex('{_PADS[1]}') || unhex(sha256(unhex('{_PADS[0]}') || encode({text})))), 1, 32)"


_TURN = _hmac("conv_id || '|' || turn")


def _exported(spark, d):
    c = V.load(spark, d, "conversations")
    sessions = c.groupBy("conv_id").agg(F.count("*").alias("record_count")).select(F.col("conv_id").cast("string").alias("session_id"), (F.col("conv_id") % 5).alias("project"), (F.col("conv_id") + 1000).alias("started_ms"), (F.col("conv_id") + 2000).alias("ended_ms"), "record_count")
    turns = c.select(F.col("conv_id").cast("string").alias("session_id"), F.concat_ws("|", "conv_id", "turn").alias("turn_id"), (F.col("turn") + 1).alias("timestamp_ms"))
    return bundle.export_sessions(sessions, turns, _KEY)


@query(f"select conv_id % 5 as project, {_hmac('cast(conv_id as varchar)')} as export_id, conv_id + 1000 as started_ms, count(*) as record_count, string_agg({_TURN} || ':' || (turn + 1), ',' order by turn + 1, {_TURN}) as turns from conversations group by conv_id")
def export_payload(spark, d):
    """PRJ-09, UDF-03: opaque ids under a key, times and counts, turns nested in their session."""
    rows = _exported(spark, d)
    listed = F.array_join(F.transform("session.turns", lambda t: F.concat_ws(":", t["export_id"], t["timestamp_ms"])), ",")
    return rows.select("project", "session.export_id", "session.started_ms", "session.record_count", listed.alias("turns"))


#: One defect a page, and the rule that must refuse it; null for a sound page.
DEFECTS = [
    ("", None), ("no element", "elements"), ("two elements", "elements"), ("broken", "json"), ("repeated key", "json"), ("version 99", "schema_version"), ("version true", "schema_version"), ("short id", "bundle_id"), ("text time", "exported_ms"),
    ("time 0", "exported_ms"), ("no project", "project"), ("long name", "project.name"), ("no list", "sessions"), ("session 5", "session"), ("session key", "session keys"), ("session id", "session id"), ("session twice", "session id twice"),
    ("true count", "session numbers"), ("turns 5", "turns"), ("turn 5", "turn"), ("turn key", "turn keys"), ("turn id", "turn id"), ("turn twice", "turn id twice"), ("fraction", "turn numbers"), ("nulls", None),
]


def _page(defect):
    """A page with the payload of one project and one defect."""
    is_defect = lambda name: defect == F.lit(name)
    pick = lambda name, bad, good: F.when(is_defect(name), F.lit(bad)).otherwise(F.lit(good))
    either = lambda names, good: functools.reduce(lambda c, n: F.when(is_defect(n[0]), F.lit(n[1])).otherwise(c), names, F.lit(good))
    sid = F.sha2(F.concat(F.lit("s"), F.col("conv_id")), 256)
    hexed = F.substring(sid, 1, 32)
    tid = lambda k: F.substring(F.sha2(F.concat(F.lit(f"t{k}"), F.col("conv_id")), 256), 1, 32)
    quote = lambda c: F.concat(F.lit('"'), c, F.lit('"'))
    turn = lambda k: F.concat(F.lit('{"export_id": '), F.when(is_defect("turn id") & F.lit(k == 2), F.lit('"Z"')).when(is_defect("turn twice"), quote(tid(1))).otherwise(quote(tid(k))), F.lit(', "timestamp_ms": '), either([("fraction", "1.5"), ("nulls", "null")], "5"), pick("turn key", ', "text": "x"', ""), F.lit("}"))
    turns = F.when(is_defect("turns 5"), F.lit("5")).when(is_defect("turn 5"), F.lit("[5]")).when(is_defect("nulls"), F.lit("null")).otherwise(F.concat(F.lit("["), turn(1), F.lit(", "), turn(2), F.lit("]")))
    session = F.concat(F.lit('{"export_id": '), F.when(is_defect("session id"), F.lit('"xyz"')).otherwise(quote(hexed)), F.lit(', "started_ms": '), pick("nulls", "null", "7"), F.lit(', "record_count": '), pick("true count", "true", "2"), pick("session key", ', "model": "m"', ""), F.lit(', "turns": '), turns, F.lit("}"))
    listed = F.when(is_defect("no list"), F.lit("{}")).when(is_defect("session 5"), F.lit("[5]")).when(is_defect("session twice"), F.concat(F.lit("["), F.replace(session, F.lit('"turns": ['), F.lit('"turns": [')), F.lit(', {"export_id": '), quote(hexed), F.lit("}]"))).otherwise(F.concat(F.lit("["), session, F.lit("]")))
    name = F.when(is_defect("long name"), F.repeat(F.lit("n"), 513)).otherwise(F.lit("p"))
    project = F.when(is_defect("no project"), F.lit("7")).otherwise(F.concat(F.lit('{"name": '), F.when(is_defect("nulls"), F.lit("null")).otherwise(quote(name)), F.lit("}")))
    payload = F.concat(
        F.lit('{"schema_version": '), either([("version 99", "99"), ("version true", "true"), ("repeated key", '1, "schema_version": 1')], "1"), F.lit(', "bundle_id": '), F.when(is_defect("short id"), F.lit('"abc"')).otherwise(quote(hexed)),
        F.lit(', "exported_ms": '), either([("text time", '"5"'), ("time 0", "0")], "1700000000000"), F.lit(', "project": '), project, F.lit(', "sessions": '), listed, pick("broken", ", ", "}"),
    )
    page = F.concat(F.lit("<html>"), bundle.element(payload), F.when(is_defect("two elements"), bundle.element(payload)).otherwise(""), F.lit("</html>"))
    return F.when(is_defect("no element"), F.lit("<html></html>")).otherwise(page)


@query(f"select conv_id, {V.picked_sql([d for d, _ in DEFECTS], 'conv_id')} as defect, nullif({V.picked_sql([r or '' for _, r in DEFECTS], 'conv_id')}, '') as problem from (select distinct conv_id from conversations)")
def bundle_validate(spark, d):
    """CHK-01, SRC-15, JSN-05: every planted defect is named, sound pages pass."""
    rows = V.load(spark, d, "conversations").select("conv_id").distinct().withColumn("defect", V.picked([x for x, _ in DEFECTS], F.col("conv_id")))
    return bundle.with_problem(rows.withColumn("page", _page(F.col("defect")))).select("conv_id", "defect", "problem")


@query("select conv_id, case when conv_id % 3 = 0 and conv_id % 2 = 1 then 'refused' when conv_id % 3 = 0 then 'already imported' else 'new' end as outcome from (select distinct conv_id from conversations)")
def bundle_import(spark, d):
    """CHK-02, SNK-19: the same content in another order of keys is a no-op, other content under a stored id is refused."""
    ids = V.load(spark, d, "conversations").select("conv_id").distinct()
    made = lambda n: F.concat(F.lit('{"a": '), "conv_id", F.lit(', "b": '), n, F.lit("}"))
    other = F.concat(F.lit('{"b":'), F.when((F.col("conv_id") % 3 == 0) & (F.col("conv_id") % 2 == 1), 2).otherwise(1), F.lit(',  "a":'), "conv_id", F.lit("}"))
    stored = ids.where("conv_id % 3 = 0").select(F.col("conv_id").alias("bundle_id"), bundle.digest(made(F.lit(1))).alias("sha"))
    incoming = ids.select(F.col("conv_id").alias("bundle_id"), bundle.digest(other).alias("sha"))
    return bundle.import_outcome(stored, incoming).select(F.col("bundle_id").alias("conv_id"), "outcome")


@query("select conv_id % 5 as project, count(distinct conv_id) as session_count, count(*) as turn_count from conversations group by 1")
def bundle_totals(spark, d):
    """EXP-01, AGG-24: payloads written, read back from their page and taken apart."""
    projects = V.load(spark, d, "conversations").select((F.col("conv_id") % 5).alias("project")).distinct().select("project", F.substring(F.sha2(F.col("project").cast("string"), 256), 1, 32).alias("bundle_id"), F.lit(1_700_000_000_000).alias("exported_ms"), F.lit("r1").alias("run_id"), F.struct(F.concat(F.lit("p"), "project").alias("name")).alias("about"))
    episodes = projects.select("project", F.struct(F.lit("in_progress").alias("completion_status"), F.lit("</script><b>").alias("original_intent")).alias("item"))
    pages = bundle.payloads(projects, _exported(spark, d), {"episodes": episodes}).select("project", bundle.element(F.col("payload")).alias("page"))
    sound = bundle.with_problem(pages).where("problem is null").select(F.col("project").alias("bundle_id"), bundle.read_element(F.col("page"))[1].alias("payload"))
    bundles, _, _ = bundle.skeleton(sound)
    return bundles.select(F.col("bundle_id").alias("project"), F.col("session_count").cast("long").alias("session_count"), F.col("turn_count").cast("long").alias("turn_count"))


@query("select page_id, page_id % 4 = 1 or page_id % 7 = 3 as leaks, case when page_id % 7 = 3 then 'at ~%2Fx and ~/y' else 'clean' end as portable from pages")
def leak_guard(spark, d):
    """CHK-03, STR-18: planted texts and home folders in any spelling; the portable form has none."""
    text = F.when(F.col("page_id") % 7 == 3, "at %2Fhome%2Fme%2Fx and /home/me/y").otherwise("clean")
    page = F.concat(text, F.when(F.col("page_id") % 4 == 1, " CANARY-1").otherwise(""))
    return V.load(spark, d, "pages").select("page_id", bundle.leaks(page, ["CANARY-1"], ["/home/me"]).alias("leaks"), bundle.portable(text, "/home/me").alias("portable"))
