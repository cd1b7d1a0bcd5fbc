"""Sessions from records, and requests linked to sessions in three tiers of confidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.plan import written_once
from ..functions.text import fingerprint

WINDOW_MS = 30_000
CELL_MS = 64 * WINDOW_MS


def first_filled(value: str, order: str) -> Column:
    """The first value in order that is not empty, else ''."""
    return F.coalesce(F.min_by(F.when(F.col(value) != "", F.col(value)), F.when(F.col(value) != "", F.col(order))), F.lit(""))


def group_sessions(rec: DataFrame) -> DataFrame:
    """One row per (source, file): bounds, count of messages, first project and model that are not empty."""
    return rec.where("record_type <> 'router_request'").groupBy("source_id", "source_file").agg(
        F.min("ms").alias("started_ms"),
        F.max("ms").alias("ended_ms"),
        F.count_if(F.col("record_type") == "message").alias("record_count"),
        first_filled("project_path", "native_id").alias("project_path"),
        first_filled("model", "native_id").alias("model"),
    )


def project_span(sessions: DataFrame) -> DataFrame:
    return sessions.where("project_path <> ''").groupBy("project_path").agg(F.min("started_ms").alias("first_seen_ms"), F.max("ended_ms").alias("last_seen_ms"), F.count("*").alias("sessions"))


def _best(candidates: DataFrame) -> DataFrame:
    """Per request the session that starts first; ties by source and file."""
    best = F.min(F.struct("started_ms", "source_id", "source_file", "project_path")).alias("s")
    return candidates.groupBy("native_id").agg(best).select("native_id", "s.source_id", "s.source_file", "s.project_path")


def tier1(req: DataFrame, rec: DataFrame, sessions: DataFrame) -> DataFrame:
    """Any id of the request equals the id of a session's member: an equi-join of exploded ids."""
    ids = req.select("native_id", F.explode(F.array("native_id", "hint")).alias("id")).where("id is not null")
    members = rec.where("record_type <> 'router_request'").select(F.col("native_id").alias("id"), "source_id", "source_file").distinct()
    return _best(ids.join(members, "id").drop("id").join(sessions, ["source_id", "source_file"]))


def within(req: DataFrame, sessions: DataFrame, keys: list[str], window_ms: int = WINDOW_MS, cell_ms: int = CELL_MS) -> DataFrame:
    """Interval join: equal keys and the request within window_ms of [started, ended].

    Sessions are spread over the time cells that their widened span covers, so the join is an equi-join on keys and cell
    and no key alone decides a task; a request lies in one cell, hence meets a session once.
    """
    low, high = F.col("started_ms") - window_ms, F.col("ended_ms") + window_ms
    spread = sessions.withColumn("cell", F.explode(F.sequence(F.floor(low / cell_ms), F.floor(high / cell_ms))))
    return req.withColumn("cell", F.floor(F.col("ms") / cell_ms)).join(spread, [*keys, "cell"]).where((F.col("ms") >= low) & (F.col("ms") <= high)).drop("cell")


def _level(window_ms: int) -> Column:
    """Half the binary digits of a widened span's length: the largest k for which a cell of 4^k ms is no longer than it."""
    return F.expr(f"(length(bin(greatest(ended_ms - started_ms + 2 * {int(window_ms)}L, 1L))) - 1) div 2").cast("int")


def levels(sessions: DataFrame, window_ms: int = WINDOW_MS) -> DataFrame:
    """The levels that sessions' spans take; a row for each power of 4 at most, whatever the table's size."""
    return sessions.select(_level(window_ms).alias("level")).where("level is not null").distinct()


def best_within(req: DataFrame, sessions: DataFrame, keys: list[str], taken: DataFrame, window_ms: int = WINDOW_MS) -> DataFrame:
    """Per request the session of equal keys that starts first, of those whose span widened by window_ms holds it, and the
    least and greatest project of all of these (s, low, high); requests without any are left out. taken: levels of sessions.

    No pair of request and session is made, so what is shuffled does not grow with how many overlap. A span is dealt into
    cells of the largest power of 4 ms that is no longer than itself, five at most: in all but its last cell it counts from
    its start on, in the last up to its end. A request stands once in its cell of each level, and running minima from
    either side of a cell, which is one window's partition, give it what counts there.
    """
    first, last = F.col("started_ms") - window_ms, F.col("ended_ms") + window_ms
    cell = lambda at: F.call_function("shiftright", at, 2 * F.col("level"))
    key = F.struct("started_ms", "source_id", "source_file", "project_path").alias("s")
    own = ["native_id", *keys, "level"]
    spans = sessions.where(first <= last).select(*keys, key, first.alias("first"), last.alias("last"), _level(window_ms).alias("level"))
    spans = spans.withColumn("cell", F.explode(F.sequence(cell(F.col("first")), cell(F.col("last"))))).withColumn("ends", (F.col("cell") == cell(F.col("last"))) & (F.col("cell") > cell(F.col("first"))))
    spans = spans.select(F.lit(None).cast(req.schema["native_id"].dataType).alias("native_id"), *keys, "level", "cell", F.when(F.col("ends"), F.col("last")).otherwise(F.col("first")).alias("at"), F.lit(False).alias("asks"), "ends", "s")
    asked = req.select("native_id", *keys, F.col("ms").alias("at")).crossJoin(F.broadcast(taken)).withColumn("cell", cell(F.col("at")))
    asked = asked.select(*own, "cell", "at", F.lit(True).alias("asks"), F.lit(None).cast("boolean").alias("ends"), F.lit(None).cast(spans.schema["s"].dataType).alias("s"))
    met = spans.union(asked).where(" and ".join(f"{k} is not null" for k in [*keys, "at"]))
    place = Window.partitionBy(*keys, "level", "cell").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sides = [("0", ~F.col("ends"), place.orderBy("at", "asks")), ("1", F.col("ends"), place.orderBy(F.desc("at"), "asks"))]
    project = F.col("s.project_path")
    for side, counts, w in sides:
        for name, of, value in (("s", F.min, F.col("s")), ("low", F.min, project), ("high", F.max, project)):
            met = met.withColumn(f"{name}{side}", of(F.when(counts, value)).over(w))
    found = met.where("asks").where("s0 is not null or s1 is not null")
    return found.groupBy("native_id").agg(F.min(F.least("s0", "s1")).alias("s"), F.min(F.least("low0", "low1")).alias("low"), F.max(F.greatest("high0", "high1")).alias("high"))


def _clear(found: DataFrame) -> DataFrame:
    """The session of requests whose sessions name exactly one project."""
    return found.where("low = high").select("native_id", "s.source_id", "s.source_file", "s.project_path")


def tier2_candidates(req: DataFrame, sessions: DataFrame, window_ms: int = WINDOW_MS) -> DataFrame:
    return within(req.select("native_id", "ms", "model"), sessions.where("model <> ''"), ["model"], window_ms)


def tier2(req: DataFrame, sessions: DataFrame, window_ms: int = WINDOW_MS) -> DataFrame:
    named = sessions.where("project_path <> ''")
    return _clear(best_within(req, named.where("model <> ''"), ["model"], levels(named, window_ms), window_ms))


def tier3(req: DataFrame, rec: DataFrame, sessions: DataFrame, window_ms: int = WINDOW_MS) -> DataFrame:
    """Equal fingerprint of the request's text and of a record of a session that has a project."""
    prints = rec.where("record_type <> 'router_request'").select("source_id", "source_file", fingerprint(F.col("excerpt")).alias("print")).where("print <> ''").distinct()
    owned = sessions.where("project_path <> ''").drop("model").join(prints, ["source_id", "source_file"])
    asked = req.select("native_id", "ms", fingerprint(F.col("excerpt")).alias("print"))
    return _clear(best_within(asked, owned, ["print"], levels(sessions, window_ms), window_ms))


def link(req: DataFrame, rec: DataFrame, sessions: DataFrame, window_ms: int = WINDOW_MS) -> DataFrame:
    """Every request with tier, confidence and session of the first tier that has one; else tier null.

    What the tiers found stands in one table and meets once per request: each tier's best session and its range of
    projects are partial sums, so a tier that is ambiguous falls through to the next in the same pass.
    """
    req, sessions = written_once(req), written_once(sessions)
    own = rec.where("record_type <> 'router_request'").select("native_id", "source_id", "source_file", fingerprint(F.col("excerpt")).alias("print"))
    ids = req.select("native_id", F.explode(F.array("native_id", "hint")).alias("id")).where("id is not null")
    first = ids.join(own.select(F.col("native_id").alias("id"), "source_id", "source_file"), "id").join(sessions, ["source_id", "source_file"])
    named = sessions.where("project_path <> ''")
    taken = levels(named, window_ms)
    second = best_within(req, named.where("model <> ''"), ["model"], taken, window_ms)
    prints = own.where("print <> ''").select("source_id", "source_file", "print").distinct()
    third = best_within(req.select("native_id", "ms", fingerprint(F.col("excerpt")).alias("print")), named.drop("model").join(prints, ["source_id", "source_file"]), ["print"], taken, window_ms)
    key = F.struct("started_ms", "source_id", "source_file", "project_path")
    none = F.lit(None).cast("string")
    found = [first.select("native_id", F.lit(1).alias("t"), key.alias("s"), none.alias("low"), none.alias("high")), *[df.select("native_id", F.lit(k).alias("t"), "s", "low", "high") for k, df in ((2, second), (3, third))]]
    at = lambda k, value: F.when(F.col("t") == k, F.col(value))
    met = found[0].union(found[1]).union(found[2]).groupBy("native_id").agg(
        *[F.min(at(k, "s")).alias(f"s{k}") for k in (1, 2, 3)],
        *[of(at(k, name)).alias(f"{name}{k}") for k in (2, 3) for of, name in ((F.min, "low"), (F.max, "high"))],
    )
    clear = lambda k: F.col(f"low{k}") == F.col(f"high{k}")
    tier = F.when(F.col("s1").isNotNull(), 1).when(clear(2), 2).when(clear(3), 3)
    chosen = met.select("native_id", tier.alias("tier"), F.when(F.col("s1").isNotNull(), F.col("s1")).when(clear(2), F.col("s2")).when(clear(3), F.col("s3")).alias("s"))
    confidence = F.when(F.col("tier") == 1, "exact").when(F.col("tier") == 2, "high").when(F.col("tier") == 3, "medium")
    return req.join(chosen, "native_id", "left").select(*req.columns, "s.source_id", "s.source_file", "s.project_path", "tier", confidence.alias("confidence"))


def sticky(rec: DataFrame) -> DataFrame:
    """Each record with its file's last project that is not empty up to it."""
    w = Window.partitionBy("source_id", "source_file").orderBy("native_id").rowsBetween(Window.unboundedPreceding, 0)
    return rec.withColumn("sticky_project", F.last(F.when(F.col("project_path") != "", F.col("project_path")), ignorenulls=True).over(w))


def skipped(sessions: DataFrame, rec: DataFrame, links: DataFrame) -> DataFrame:
    """Per source what a store leaves out as its session has no project: sessions, turns and links.

    sessions: source_id, source_file, project_path; rec: records with source_id, source_file, record_type; links: source_id,
    source_file. A source that loses nothing has a row of zeros.
    """
    key = ["source_id", "source_file"]
    bare = sessions.select(*key, (F.coalesce("project_path", F.lit("")) == "").alias("bare"))
    turns = rec.where("record_type = 'message'").groupBy(*key).agg(F.count("*").alias("turns"))
    linked = links.where("source_file is not null").groupBy(*key).agg(F.count("*").alias("links"))
    met = bare.join(turns, key, "left").join(linked, key, "left").na.fill(0)
    lost = lambda n: F.coalesce(F.sum(F.when(F.col("bare"), n)), F.lit(0))
    return met.groupBy("source_id").agg(lost(F.lit(1)).alias("sessions"), lost(F.col("turns")).alias("turns"), lost(F.col("links")).alias("links"))
