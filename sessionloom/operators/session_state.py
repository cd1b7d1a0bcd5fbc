"""Session state that can be merged: batches of records become partial sessions, which fold into those stored.

The head of a session is one row of values that merge by minimum, maximum and sum: each first filled value with its place of
arrival (source order, file, line), bounds, counts, and the earliest start with its own id. What grows with a session, its
ids and fingerprints, is a table of distinct rows beside it, so no session is ever one large value. Folding is associative
and takes batches in any order; a record must come once, as counts are sums.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import fingerprint, id_values, session_id_of
from .delta import DeltaTable

#: Types that belong to a session, sources whose file is the session, what names a session of its own.
SESSION_TYPES = ["session_start", "message", "tool_call", "tool", "error"]
ROUTER, KEYED_BY_ID, UNGROUPED = "nine_router", "opencode", "__ungrouped__"
FIRST = ["project_path", "model", "git_branch", "source_file"]
KEYS = ["source_id", "group_key"]
_AT = "source_order:int,source_file:string,line:bigint"
HEAD = "source_id string, group_key string, started_ms bigint, ended_ms bigint, turns bigint, records bigint, " + ", ".join(f"{c} struct<at:struct<{_AT}>,value:string>" for c in FIRST) + f", born struct<ms:bigint,at:struct<{_AT}>,value:string>"
MEMBER = "source_id string, group_key string, kind string, value string"


def bearing(rec: DataFrame) -> DataFrame:
    """Records of sessions with their group_key. Whether there is one is asked of what it is made from, as a test of the key
    itself would find it twice."""
    own, file = (F.nullif(F.col(c), F.lit("")) for c in ("native_id", "source_file"))
    named = F.get(F.filter(F.array(session_id_of(F.col("raw_meta"))), lambda v: v != ""), F.lit(0))
    by_id = F.when((F.col("record_type") == "session_start") & own.isNotNull(), own).otherwise(F.coalesce(named, F.concat(F.lit(UNGROUPED), F.coalesce(own, F.col("timestamp_ms").cast("string")))))
    keyed = F.col("source_id") == KEYED_BY_ID
    has_key = F.when(keyed, own.isNotNull() | F.col("timestamp_ms").isNotNull() | named.isNotNull()).otherwise(file.isNotNull() | F.col("native_id").isNotNull())
    kept = rec.where((F.col("source_id") != ROUTER) & F.col("record_type").isin(SESSION_TYPES) & has_key)
    return kept.withColumn("group_key", F.when(keyed, by_id).otherwise(F.coalesce(file, F.col("native_id"))))


def _at() -> Column:
    return F.struct(F.col("source_order").cast("int").alias("source_order"), "source_file", F.col("line").cast("bigint").alias("line"))


def heads(rec: DataFrame) -> DataFrame:
    """Partial sessions of some records (source_order and line give their order of arrival)."""
    first = [F.min(F.when(F.col(c) != "", F.struct(_at().alias("at"), F.col(c).alias("value")))).alias(c) for c in FIRST]
    begun = (F.col("record_type") == "session_start") & (F.col("native_id") != "")
    born = F.min(F.when(begun, F.struct(F.col("timestamp_ms").alias("ms"), _at().alias("at"), F.col("native_id").alias("value")))).alias("born")
    counts = [F.count_if(F.col("record_type") == "message").alias("turns"), F.count("*").alias("records")]
    return bearing(rec).groupBy(*KEYS).agg(F.min("timestamp_ms").alias("started_ms"), F.max("timestamp_ms").alias("ended_ms"), *counts, *first, born)


def merged(states: DataFrame) -> DataFrame:
    """Heads of several batches as one a session."""
    rules = {"started_ms": F.min, "ended_ms": F.max, "turns": F.sum, "records": F.sum} | {c: F.min for c in [*FIRST, "born"]}
    return states.groupBy(*KEYS).agg(*[of(c).alias(c) for c, of in rules.items()])


def members(rec: DataFrame) -> DataFrame:
    """Ids (of records, and id-shaped ones they carry) and fingerprints of sessions, as rows; one comes as often as records have
    it, and the table that takes them makes them distinct where it is read or compacted."""
    one = lambda kind, value: F.struct(F.lit(kind).alias("kind"), value.alias("value"))
    own = F.array(one("native", F.col("native_id")), one("print", fingerprint(F.col("content_excerpt"))))
    found = F.concat(own, F.transform(F.coalesce(id_values(F.col("raw_meta")), F.array().cast("array<string>")), lambda v: one("raw", v)))
    rows = bearing(rec).select(*KEYS, F.explode(found).alias("m")).select(*KEYS, "m.kind", "m.value")
    return rows.where("value <> ''")


def sessions(states: DataFrame) -> DataFrame:
    """Session rows of merged heads."""
    return states.select(
        *KEYS, F.coalesce("born.value", "group_key").alias("native_id"), "started_ms", F.greatest("ended_ms", F.lit(0)).alias("ended_ms"), F.col("turns").alias("turn_count"),
        *[F.coalesce(f"{c}.value", F.lit("")).alias("raw_path" if c == "source_file" else c) for c in FIRST],
    )


class SessionStore:
    """Heads and members under one folder; a batch appends its partial sessions, reading and compaction fold them."""

    def __init__(self, spark: SparkSession, path: str):
        self.heads = DeltaTable(spark, f"{path}/heads", HEAD, merged)
        self.members = DeltaTable(spark, f"{path}/members", MEMBER, DataFrame.distinct)

    def fold(self, rec: DataFrame, stream: str | None = None, batch: int = 0) -> None:
        """Takes a batch. Of a stream a batch counts once, so one that failed between the two tables can be run again."""
        rec = rec.hint("rebalance", "source_file", "line", "native_id")  # few tasks, so few files, where a batch is small
        self.members.append(members(rec), stream, batch)
        self.heads.append(heads(rec), stream, batch)

    def read(self) -> DataFrame:
        return sessions(self.heads.read())
