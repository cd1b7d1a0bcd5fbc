"""Deterministic analysis of a project's turns: intent, completion, drift, findings, seeds, ranking."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import DONE, ERRORS, PENDING, PIVOT, TODO, has_word

INTENT_CHARS, ERROR_BURST, SEEDS, CITATIONS, EXCERPT, ABANDONED_DAYS = 40, 3, 10, 5, 280, 7


def original_intent(turns: DataFrame, chars: int = INTENT_CHARS) -> DataFrame:
    """First user turn of some length per session."""
    return turns.where((F.col("role") == "user") & (F.length("text") > chars)).groupBy("session_id").agg(F.min("idx").alias("intent_idx"), F.min_by("text", "idx").alias("intent"))


def pivot_point(turns: DataFrame, words: list[str] = PIVOT, chars: int = INTENT_CHARS) -> DataFrame:
    """First user turn after the intent that holds a pivot word."""
    later = turns.where("role = 'user'").join(original_intent(turns, chars).drop("intent"), "session_id").where("idx > intent_idx")
    return later.where(has_word(F.col("text"), words)).groupBy("session_id").agg(F.min("idx").alias("pivot_idx"))


def with_fallback(turns: DataFrame) -> DataFrame:
    """Adds for_user and for_assistant: whether a turn counts for a role. Where no turn of a session has a role, all count for both."""
    known = turns.groupBy("session_id").agg(F.bool_or(F.coalesce(F.col("role") != "", F.lit(False))).alias("known"))
    is_role = lambda r: ~F.col("known") | F.coalesce(F.col("role") == r, F.lit(False))
    return turns.join(known, "session_id").withColumn("for_user", is_role("user")).withColumn("for_assistant", is_role("assistant")).drop("known")


def is_error(record_type: str = "record_type", text: str = "text") -> Column:
    return (F.col(record_type) == "error") | has_word(F.col(text), ERRORS)


def signals(turns: DataFrame) -> DataFrame:
    """Counts per session of the turns in each keyword class."""
    return with_fallback(turns).groupBy("session_id").agg(
        F.count("*").alias("turns"),
        F.count_if(F.col("for_assistant") & has_word(F.col("text"), DONE)).alias("claims"),
        F.count_if(is_error()).alias("errors"),
        F.count_if(has_word(F.col("text"), PENDING)).alias("pending"),
        F.count_if(has_word(F.col("text"), TODO)).alias("todo"),
    )


def completion(counts: DataFrame, git: DataFrame, now_ms: int) -> DataFrame:
    """A claim with commits behind it is unverified, errors mean in progress, silence with neither is abandoned; with what
    speaks for it. Without known bounds nothing is abandoned."""
    met = counts.join(git, "session_id", "left").withColumn("commits", F.coalesce("commits", F.lit(0))).withColumn("ended_ms", F.coalesce("ended_ms", F.lit(0)))
    idle = F.when(F.col("ended_ms") > 0, (F.lit(now_ms) - F.col("ended_ms")) / F.lit(86_400_000.0))
    claimed = F.col("claims") > 0
    status = F.when(claimed & (F.col("commits") > 0), "unverified").when(F.col("errors") > 0, "in_progress").when(~claimed & F.coalesce(idle > ABANDONED_DAYS, F.lit(False)), "abandoned").otherwise("in_progress")
    return met.withColumn("completion_status", status).withColumn("completion_claim", claimed).withColumn("days_since_last_activity", F.round(idle, 6))


def analyse(turns: DataFrame, git: DataFrame, now_ms: int) -> DataFrame:
    """One row a session: intent, completion, drift, findings (categories in a fixed order) and the number of seeds."""
    full = with_fallback(turns)
    user = full.where("for_user")
    begun = user.where(F.length("text") > INTENT_CHARS).groupBy("session_id").agg(F.min("idx").alias("intent_idx"), F.min_by("text", "idx").alias("intent"))
    later = user.join(begun.select("session_id", "intent_idx"), "session_id", "left").where(F.col("intent_idx").isNull() | (F.col("idx") > F.col("intent_idx")))
    pivots = later.where(has_word(F.col("text"), PIVOT)).groupBy("session_id").agg(F.min("idx").alias("pivot_idx"))
    told = completion(signals(turns), git, now_ms).join(begun, "session_id", "left").join(pivots, "session_id", "left")
    found = F.array_compact(F.array(F.when(F.col("pending") > 0, "incomplete_work:medium"), F.when(F.col("todo") > 0, "tech_debt:low"), F.when(F.col("errors") >= ERROR_BURST, "error_burst:high")))
    sown = seeds(turns).groupBy("session_id").agg(F.count("*").alias("seeds"))
    return told.join(sown, "session_id", "left").select(
        "session_id", F.coalesce("intent", F.lit("(unknown intent)")).alias("original_intent"), "completion_status",
        F.when(F.col("pivot_idx").isNotNull(), "mid_session_pivot").alias("drift_type"), "pivot_idx", F.array_join(found, ",").alias("findings"), F.coalesce("seeds", F.lit(0)).alias("seeds"),
    )


def citations(turns: DataFrame, words: list[str] = ERRORS, most: int = CITATIONS, excerpt: int = EXCERPT) -> DataFrame:
    w = Window.partitionBy("session_id").orderBy("idx")
    return turns.where(has_word(F.col("text"), words)).withColumn("place", F.row_number().over(w)).where(F.col("place") <= most).select("session_id", "place", "idx", "role", F.substring("text", 1, excerpt).alias("excerpt"))


def seeds(turns: DataFrame, pending: list[str] = PENDING, todo: list[str] = TODO, most: int = SEEDS) -> DataFrame:
    """Distinct texts, pending user turns before TODO turns, in order of appearance."""
    kind = F.when((F.col("role") == "user") & has_word(F.col("text"), pending), 0).when(has_word(F.col("text"), todo), 1)
    first = turns.withColumn("kind", kind).where("kind is not null").groupBy("session_id", "text").agg(F.min(F.struct("kind", "idx")).alias("at"))
    w = Window.partitionBy("session_id").orderBy("at.kind", "at.idx")
    return first.withColumn("place", F.row_number().over(w)).where(F.col("place") <= most).select("session_id", "place", "text")


def rank_tasks(tasks: DataFrame, key: str, most: int = 10) -> DataFrame:
    """Score from severity and surface, best first, ties by title."""
    weight = F.when(F.col("severity") == "high", 3).when(F.col("severity") == "medium", 2).otherwise(1)
    scored = tasks.withColumn("score", weight * 2 + F.least("surface", F.lit(5)))
    return scored.withColumn("place", F.row_number().over(Window.partitionBy(key).orderBy(F.desc("score"), "title"))).where(F.col("place") <= most)


def docs_drift(paths: DataFrame, key: str) -> DataFrame:
    """Code touched without docs: high from 10 paths, medium from 3, else low."""
    docs = F.lower("path").startswith("readme") | F.lower("path").startswith("docs/")
    per = paths.groupBy(key).agg(F.count_if(~docs).alias("code"), F.count_if(docs).alias("docs"))
    return per.where("code > 0 and docs = 0").withColumn("severity", F.when(F.col("code") >= 10, "high").when(F.col("code") >= 3, "medium").otherwise("low"))
