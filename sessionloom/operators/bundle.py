"""Bundles of one project's history: opaque payloads, validation of foreign ones, and their import."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import hmac_id, script_json

#: Versions read, bounds, and the keys that sessions and turns may have.
VERSIONS = [1]
MAX_SESSIONS, MAX_TURNS, MAX_TURNS_A_SESSION, MAX_NAME, MIN_MS, MAX_MS, MAX_RECORDS = 200_000, 5_000_000, 200_000, 512, 1, 16_725_225_600_000, 100_000_000
SESSION_KEYS = ["export_id", "started_ms", "ended_ms", "record_count", "turns"]
TURN_KEYS = ["export_id", "timestamp_ms"]
HEX_ID = r"^[0-9a-f]{32}$"
ELEMENT = r'(?s)<script type="application/json" id="bundle">(.*?)</script>'


def export_sessions(sessions: DataFrame, turns: DataFrame, key: str) -> DataFrame:
    """project, session (struct: export_id, started_ms, ended_ms, record_count, turns): ids are digests under a key that is
    to be thrown away; only times and counts are kept. Turns nest inside their session, in order of time and id."""
    nested = turns.select("session_id", F.struct(F.col("timestamp_ms"), hmac_id(key, F.col("turn_id")).alias("export_id")).alias("t")).groupBy("session_id").agg(F.array_sort(F.collect_list("t")).alias("ts"))
    listed = F.transform(F.coalesce("ts", F.array().cast("array<struct<timestamp_ms:bigint,export_id:string>>")), lambda t: F.struct(t["export_id"].alias("export_id"), t["timestamp_ms"].alias("timestamp_ms")))
    joined = sessions.join(nested, "session_id", "left")
    return joined.select("project", F.struct(hmac_id(key, F.col("session_id")).alias("export_id"), "started_ms", "ended_ms", "record_count", listed.alias("turns")).alias("session"))


def payloads(projects: DataFrame, sessions: DataFrame, narrative: dict[str, DataFrame]) -> DataFrame:
    """project, payload: one JSON text a project. projects: project, bundle_id, exported_ms, run_id and the struct about;
    narrative: name -> (project, item), each of which becomes an array."""
    out = projects.join(sessions.groupBy("project").agg(F.array_sort(F.collect_list("session"), lambda a, b: F.when(a["export_id"] < b["export_id"], -1).otherwise(1)).alias("sessions")), "project", "left")
    for name, items in narrative.items():
        out = out.join(items.groupBy("project").agg(F.array_sort(F.collect_list("item")).alias(name)), "project", "left")
    fields = [F.lit(VERSIONS[-1]).alias("schema_version"), "bundle_id", "exported_ms", "run_id", F.col("about").alias("project"), "sessions", *narrative]
    return out.select("project", F.to_json(F.struct(*fields)).alias("payload"))


def element(payload: Column) -> Column:
    """The payload as the one inert element of a page."""
    return F.concat(F.lit('<script type="application/json" id="bundle">'), script_json(payload), F.lit("</script>"))


def read_element(page: Column) -> tuple[Column, Column]:
    """(how many payload elements a page has, the first one's text)."""
    found = F.regexp_extract_all(page, F.lit(ELEMENT), F.lit(1))
    return F.size(found), F.get(found, F.lit(0))


def with_problem(pages: DataFrame, page: str = "page") -> DataFrame:
    """Adds problem: the first rule that a page's payload breaks, or null where it is sound. A page is refused whole.

    The payload is parsed once and its sessions and turns are taken out once; the rules read these columns.

    Repeated keys make the text no JSON for the parser, so they are refused with what cannot be parsed. Integers are told
    from booleans, fractions and texts by the kind the parser gives them.
    """
    count, text = read_element(F.col(page))
    v, sessions, turns = F.col("_v"), F.col("_sessions"), F.col("_turns")
    get = lambda path: F.try_variant_get(v, f"$.{path}", "variant")
    kind = lambda c: F.coalesce(F.schema_of_variant(c), F.lit("VOID"))
    integer = lambda c, low, high: (kind(c) == "BIGINT") & F.try_variant_get(c, "$", "bigint").between(low, high)
    missing = lambda c: kind(c) == "VOID"
    hexed = lambda c: (kind(c) == "STRING") & F.coalesce(F.try_variant_get(c, "$", "string").rlike(HEX_ID), F.lit(False))
    items = lambda c: F.coalesce(F.try_variant_get(c, "$", "array<variant>"), F.array().cast("array<variant>"))
    inside = lambda c, name: F.try_variant_get(c, f"$.{name}", "variant")
    keys = lambda c: F.map_keys(F.coalesce(F.try_variant_get(c, "$", "map<string,variant>"), F.create_map().cast("map<string,variant>")))
    is_object = lambda c: kind(c).startswith("OBJECT")
    turns_of = lambda s: items(inside(s, "turns"))
    ids = lambda a: F.transform(a, lambda x: F.coalesce(F.try_variant_get(inside(x, "export_id"), "$", "string"), F.lit("")))
    known = lambda allowed: F.array(*map(F.lit, allowed))
    optional_ms = lambda x, name, low=MIN_MS, high=MAX_MS: missing(inside(x, name)) | integer(inside(x, name), low, high)
    rules = [
        (F.col("_count") == 1, "elements"),
        (v.isNotNull() & is_object(v), "json"),
        (integer(get("schema_version"), min(VERSIONS), max(VERSIONS)), "schema_version"),
        (hexed(get("bundle_id")), "bundle_id"),
        (integer(get("exported_ms"), MIN_MS, MAX_MS), "exported_ms"),
        (is_object(get("project")), "project"),
        (missing(get("project.name")) | ((kind(get("project.name")) == "STRING") & (F.length(F.try_variant_get(v, "$.project.name", "string")) <= MAX_NAME)), "project.name"),
        (kind(get("sessions")).startswith("ARRAY"), "sessions"),
        (F.size(sessions) <= MAX_SESSIONS, "session count"),
        (F.forall(sessions, is_object), "session"),
        (F.forall(sessions, lambda s: F.size(F.array_except(keys(s), known(SESSION_KEYS))) == 0), "session keys"),
        (F.forall(sessions, lambda s: hexed(inside(s, "export_id"))), "session id"),
        (F.size(F.array_distinct(ids(sessions))) == F.size(sessions), "session id twice"),
        (F.forall(sessions, lambda s: optional_ms(s, "started_ms") & optional_ms(s, "ended_ms") & optional_ms(s, "record_count", 0, MAX_RECORDS)), "session numbers"),
        (F.forall(sessions, lambda s: missing(inside(s, "turns")) | kind(inside(s, "turns")).startswith("ARRAY")), "turns"),
        (F.forall(sessions, lambda s: F.size(turns_of(s)) <= MAX_TURNS_A_SESSION) & (F.size(turns) <= MAX_TURNS), "turn count"),
        (F.forall(turns, is_object), "turn"),
        (F.forall(turns, lambda t: F.size(F.array_except(keys(t), known(TURN_KEYS))) == 0), "turn keys"),
        (F.forall(turns, lambda t: hexed(inside(t, "export_id"))), "turn id"),
        (F.size(F.array_distinct(ids(turns))) == F.size(turns), "turn id twice"),
        (F.forall(turns, lambda t: optional_ms(t, "timestamp_ms")), "turn numbers"),
    ]
    first = functools.reduce(lambda chain, r: chain.when(~F.coalesce(r[0], F.lit(False)), r[1]), rules[1:], F.when(~F.coalesce(rules[0][0], F.lit(False)), rules[0][1]))
    taken = pages.withColumn("_count", count).withColumn("_v", F.try_parse_json(text)).withColumn("_sessions", items(get("sessions")))
    return taken.withColumn("_turns", F.flatten(F.transform("_sessions", turns_of))).withColumn("problem", first).drop("_count", "_v", "_sessions", "_turns")


def digest(payload: Column) -> Column:
    """Digest of the payload with sorted keys: equal for the same content in any order of keys and white space."""
    return F.sha2(F.coalesce(F.to_json(F.try_parse_json(payload)), payload), 256)


def import_outcome(stored: DataFrame, incoming: DataFrame) -> DataFrame:
    """bundle_id, sha of each incoming bundle with its outcome: new, already imported, or refused (same id, other content).
    Within the incoming ones the first of an id by digest counts as the one that is met."""
    first = incoming.groupBy("bundle_id").agg(F.min("sha").alias("first_sha"))
    known = stored.select("bundle_id", F.col("sha").alias("stored_sha"))
    met = incoming.join(first, "bundle_id").join(known, "bundle_id", "left")
    against = F.coalesce("stored_sha", "first_sha")
    outcome = F.when(F.col("sha") != against, "refused").when(F.col("stored_sha").isNotNull(), "already imported").otherwise("new")
    return met.select("bundle_id", "sha", outcome.alias("outcome"))


def skeleton(payload: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(bundles, sessions, turns) of validated payloads: bundle_id, payload."""
    shape = "struct<exported_ms:bigint,project:struct<name:string>,sessions:array<struct<export_id:string,started_ms:bigint,ended_ms:bigint,record_count:bigint,turns:array<struct<export_id:string,timestamp_ms:bigint>>>>>"
    rows = payload.withColumn("p", F.from_json("payload", shape))
    sessions = rows.select("bundle_id", F.explode("p.sessions").alias("s"))
    turns = sessions.select("bundle_id", F.col("s.export_id").alias("session_export_id"), F.explode("s.turns").alias("t"))
    total = F.aggregate("p.sessions", F.lit(0), lambda a, s: a + F.greatest(F.size(s["turns"]), F.lit(0)))
    bundles = rows.select("bundle_id", "p.exported_ms", F.col("p.project.name").alias("project_name"), F.size("p.sessions").alias("session_count"), total.alias("turn_count"), digest(F.col("payload")).alias("payload_sha256"))
    return bundles, sessions.select("bundle_id", "s.export_id", "s.started_ms", "s.ended_ms", "s.record_count"), turns.select("bundle_id", "session_export_id", "t.export_id", "t.timestamp_ms")


def leaks(page: Column, needles: list[str], homes: list[str] = ()) -> Column:
    """Whether a page holds one of the texts, or a home folder in any of five spellings."""
    spellings = [form for h in homes for form in (h, h.replace("/", "\\/"), h.replace("/", "%2F"), h.replace("/", "-"), h.replace("/", "&#x2F;"))]
    return functools.reduce(lambda c, n: c | page.contains(n), [*needles, *spellings], F.lit(False))


def portable(text: Column, home: str) -> Column:
    """The home folder as ~ in all five spellings."""
    for form in (home, home.replace("/", "\\/"), home.replace("/", "%2F"), home.replace("/", "-"), home.replace("/", "&#x2F;")):
        text = F.replace(text, F.lit(form), F.lit("~"))
    return text


def listed(stored: DataFrame, most: int | None = None) -> DataFrame:
    """Imported bundles, newest first, ties by id. They share no keys with projects, sessions or turns and are never joined."""
    rows = stored.select("bundle_id", "project_name", "source_file", "exported_ms", "imported_ms", "session_count", "turn_count").orderBy(F.desc("imported_ms"), "bundle_id")
    return rows if most is None else rows.limit(most)
