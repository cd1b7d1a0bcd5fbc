"""State as Parquet versions: upserts with a rule per column and idempotent appends as joins, commits by exclusive number.

Every table is a DataFrame of the current version; an operation gives the next one. An update that repeats a key counts
once, with its last row in the order given (by all columns where none is). Nothing reads or writes row by row.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import evidence_digest, redact, stable_id
from .delta import CommitLog

Rule = Callable[[Column, Column], Column]
new_value: Rule = lambda old, new: new
filled: Rule = lambda old, new: F.coalesce(new, old)
not_blank: Rule = lambda old, new: F.coalesce(F.nullif(new, F.lit("")), old)


def last_of(rows: DataFrame, keys: list[str], order: str | None = None) -> DataFrame:
    """One row a key: the last in order; rows of equal order by all their columns, so the choice is always the same."""
    others = [c for c in rows.columns if c not in keys]
    if not others:
        return rows.distinct()
    rank = F.struct(*([F.col(order)] if order else []), F.to_json(F.struct(*others)))
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*others), rank).alias("r")).select(*keys, "r.*").select(rows.columns)


def upsert(current: DataFrame, updates: DataFrame, keys: list[str], rules: dict[str, Rule] | None = None, order: str | None = None) -> DataFrame:
    """Rows of both; where both have a key, each column by its rule(old, new). Without a rule the old value stays.

    ``order`` names a column of the updates alone that decides between rows of one key; columns that updates lack are null.
    """
    rules = rules or {}
    updates = last_of(updates, keys, order)
    missing = [F.lit(None).cast(current.schema[c].dataType).alias(c) for c in current.columns if c not in updates.columns]
    old = current.withColumn("_old", F.lit(True)).alias("o")
    new = updates.select("*", *missing).withColumn("_new", F.lit(True)).alias("n")
    both = F.col("o._old") & F.col("n._new")
    on = [F.col(f"o.{k}").eqNullSafe(F.col(f"n.{k}")) for k in keys]

    def value(c: str) -> Column:
        kept = F.when(F.col("o._old"), F.col(f"o.{c}")).otherwise(F.col(f"n.{c}"))
        return (F.when(both, rules[c](F.col(f"o.{c}"), F.col(f"n.{c}"))).otherwise(kept) if c in rules else kept).alias(c)

    return old.join(new, on, "full_outer").select(*[value(c) for c in current.columns])


def append_new(current: DataFrame, rows: DataFrame, key: str, order: str) -> DataFrame:
    """Rows whose key is not stored yet, the first by order of each key: replays add nothing."""
    first = rows.groupBy(key).agg(F.min_by(F.struct(*[c for c in rows.columns if c != key]), order).alias("r")).select(key, "r.*")
    return first.select(rows.columns).join(current.select(key), key, "left_anti").select(rows.columns)


def update(current: DataFrame, changes: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Stored rows with the columns of the changes that have their key; a key that is not stored changes nothing."""
    change = last_of(changes.select(key, *columns), [key]).select(key, F.struct(*columns).alias("_change"))
    return current.join(change, key, "left").select(*[(F.when(F.col("_change").isNotNull(), F.col(f"_change.{c}")).otherwise(F.col(c)) if c in columns else F.col(c)).alias(c) for c in current.columns])


# Tables -------------------------------------------------------------------------------------------------------------


def upsert_projects(current: DataFrame, updates: DataFrame) -> DataFrame:
    """last_seen_ms is the update's even where it is smaller; a remote stays where the new one is blank."""
    clean = updates.withColumn("name", redact(F.col("name"))).withColumn("git_remote", redact(F.col("git_remote"))).withColumn("id", stable_id(F.lit("project"), F.col("path")))
    return upsert(current, clean, ["id"], {"last_seen_ms": new_value, "git_remote": not_blank})


def upsert_sessions(current: DataFrame, updates: DataFrame) -> DataFrame:
    """Only ended_ms (where given) and record_count change."""
    clean = updates.withColumn("id", stable_id(F.lit("session"), F.col("source_id"), F.col("native_id")))
    for column in ("model", "git_branch", "raw_path"):
        clean = clean.withColumn(column, redact(F.col(column)))
    return upsert(current, clean, ["id"], {"ended_ms": filled, "record_count": new_value})


LINK_COLUMNS = ["linked_session_id", "link_tier", "link_confidence", "link_reason"]


def upsert_requests(current: DataFrame, updates: DataFrame) -> DataFrame:
    """All columns are the update's, but those of the link, which only ``link_requests`` writes."""
    clean = updates.withColumn("id", stable_id(F.lit("router"), F.col("source_id"), F.col("native_id")))
    for column in ("provider", "model", "connection_id", "status", "endpoint"):
        if column in clean.columns:
            clean = clean.withColumn(column, redact(F.col(column).cast("string")))
    fixed = {"id", "source_id", "native_id", *LINK_COLUMNS}
    return upsert(current, clean, ["id"], {c: new_value for c in current.columns if c not in fixed})


def link_requests(current: DataFrame, links: DataFrame) -> DataFrame:
    """Links written to the requests that are stored; a request without a new link keeps its old one."""
    return update(current, links.withColumn("id", stable_id(F.lit("router"), F.col("source_id"), F.col("native_id"))), "id", LINK_COLUMNS)


def start_run(runs: DataFrame, started: DataFrame) -> DataFrame:
    """Opens run rows as running; a run that is stored stays as it is."""
    return upsert(runs, started.withColumn("status", F.lit("running")), ["id"])


def finish_run(runs: DataFrame, ended: DataFrame) -> DataFrame:
    return update(runs, ended, "id", ["ended_ms", "status", "source_counts_json", "warning_count", "error_count"])


def migrate(spark: SparkSession, tables: dict[str, DataFrame], version: int, ladder: list[tuple[int, str, str | None, str]]) -> tuple[dict[str, DataFrame], int]:
    """The tables of a store at the top of a ladder, and the version reached.

    A step is (version, table, column, type), or (version, table, None, schema) for a new table; those up to the store's version
    are done. A column or table that is there stays as it is, so a ladder can be climbed again; a column for a table that is
    not there is an error, and nothing is returned. Only plans change: no row is read.
    """
    out = dict(tables)
    for step, table, column, kind in sorted(ladder, key=lambda s: s[0]):
        if step <= version:
            continue
        if column is None:
            out.setdefault(table, spark.createDataFrame([], kind))
        elif table not in out:
            raise ValueError(f"version {step} adds {table}.{column}, but there is no {table}")
        elif column not in out[table].columns:
            out[table] = out[table].withColumn(column, F.lit(None).cast(kind))
    return out, max([version, *(s[0] for s in ladder)])


def open_calls(calls: DataFrame) -> DataFrame:
    """Ledger rows of paid calls. Ids are random: two equal calls within a millisecond were both paid and both stay. Write the
    rows before anything refers to an id."""
    own = F.concat(F.lit("agent_call-"), F.replace(F.expr("uuid()"), F.lit("-"), F.lit("")))
    ends = {"ended_ms": "bigint", "status": "string", "cost_usd": "double", "prompt_tokens": "bigint", "completion_tokens": "bigint", "output_json": "string", "error_text": "string"}
    return calls.withColumn("model", redact(F.col("model"))).withColumns({c: F.lit(None).cast(t) for c, t in ends.items()}).withColumn("id", own)


def finish_calls(calls: DataFrame, ended: DataFrame) -> DataFrame:
    """Outcomes written to the calls that are stored; free text is masked here, once for all callers."""
    clean = ended.withColumns({c: redact(F.col(c)) for c in ("status", "output_json", "error_text")})
    return update(calls, clean, "id", ["ended_ms", "status", "cost_usd", "prompt_tokens", "completion_tokens", "output_json", "error_text"])


def recover_runs(runs: DataFrame, now_ms: int) -> DataFrame:
    """Runs left running without an end are interrupted as of now; a finished run is not touched."""
    orphan = (F.col("status") == "running") & F.col("ended_ms").isNull()
    return runs.withColumns({"ended_ms": F.when(orphan, F.lit(now_ms)).otherwise(F.col("ended_ms")), "status": F.when(orphan, "interrupted").otherwise(F.col("status"))})


def overwrite(current: DataFrame, updates: DataFrame, keys: list[str], keep: tuple[str, ...] = ()) -> DataFrame:
    """Upsert in which every column but the keys and those kept is the update's: snapshots, spend, pins, observations,
    analysed projects, episodes, cadence, and artifacts (which keep created_ms)."""
    return upsert(current, updates, keys, {c: new_value for c in current.columns if c not in (*keys, *keep)})


def append_events(current: DataFrame, rows: DataFrame) -> DataFrame:
    """Rows with a content id added; a repeated id, stored or within the rows, is an error at run time."""
    made = rows.withColumn("message", redact(F.col("message"))).withColumn("id", stable_id(F.lit("agent_event"), F.coalesce("run_id", F.lit("")), F.coalesce("call_id", F.lit("")), F.col("ts_ms"), F.coalesce("topic", F.lit("")), F.coalesce("message", F.lit(""))))
    both = current.unionByName(made.select(current.columns))
    counted = both.groupBy("id").agg(F.count("*").alias("n"), F.any_value(F.struct(*[c for c in current.columns if c != "id"])).alias("r"))
    checked = F.when(F.col("n") > 1, F.raise_error(F.concat(F.lit("event id is stored already: "), "id"))).otherwise(F.col("id"))
    return counted.select(checked.alias("id"), "r.*").select(current.columns)


#: The reasons for which a finding may be dismissed.
DISMISSAL_REASONS = ["wrong", "wont-fix", "already-done", "duplicate"]


def dismiss(findings: DataFrame, chosen: DataFrame, reason: str, now_ms: int) -> DataFrame:
    """Chosen findings (id) dismissed for a reason, with the digest of the evidence that was judged."""
    if reason not in DISMISSAL_REASONS:
        raise ValueError(f"reason must be one of {', '.join(DISMISSAL_REASONS)}")
    hit = findings.join(chosen.select("id").distinct().withColumn("_hit", F.lit(True)), "id", "left")
    set_to = {"dismissal_reason": F.lit(reason), "resolved_ms": F.lit(now_ms), "dismissed_ms": F.lit(now_ms), "dismissed_evidence_sha": evidence_digest(F.col("evidence_json"))}
    return hit.select(*[(F.when(F.col("_hit"), set_to[c].cast(findings.schema[c].dataType)).otherwise(F.col(c)) if c in set_to else F.col(c)).alias(c) for c in findings.columns])


def undismiss(findings: DataFrame, chosen: DataFrame) -> DataFrame:
    cleared = chosen.select("id", *[F.lit(None).cast(findings.schema[c].dataType).alias(c) for c in ("dismissal_reason", "resolved_ms", "dismissed_ms", "dismissed_evidence_sha")])
    return update(findings, cleared, "id", ["dismissal_reason", "resolved_ms", "dismissed_ms", "dismissed_evidence_sha"])


def upsert_findings(findings: DataFrame, seen: DataFrame) -> DataFrame:
    """Severity, detail, evidence, confidence and provenance are the new ones; created_ms and the dismissal stay."""
    clean = seen.withColumn("id", stable_id(F.lit("finding"), F.col("project_id"), F.col("title"), F.col("category")))
    for column in ("title", "detail", "evidence_json"):
        clean = clean.withColumn(column, redact(F.col(column)))
    return upsert(findings, clean, ["id"], {c: new_value for c in ("severity", "detail", "evidence_json", "confidence", "provenance")})


def observe(findings: DataFrame, seen: DataFrame, run_id: str, now_ms: int) -> tuple[DataFrame, DataFrame]:
    """(findings, observations) after a run saw findings with some evidence (id, evidence_json).

    A dismissed finding with the evidence it was dismissed for is observed as resolved; with other evidence its dismissal
    is lifted and it is observed as open.
    """
    met = seen.select("id", F.col("evidence_json").alias("_evidence")).join(findings.select("id", "dismissal_reason", "dismissed_evidence_sha"), "id", "left")
    dismissed = F.coalesce(F.col("dismissal_reason") != "", F.lit(False))
    changed = dismissed & F.coalesce(F.col("dismissed_evidence_sha") != "", F.lit(False)) & (evidence_digest(F.col("_evidence")) != F.col("dismissed_evidence_sha"))
    observations = met.select(F.col("id").alias("finding_id"), F.lit(run_id).alias("run_id"), F.lit(now_ms).cast("long").alias("observed_ms"), (dismissed & ~changed).alias("resolved"))
    return undismiss(findings, met.where(changed)), observations


def advance(marks: DataFrame, seen: DataFrame) -> DataFrame:
    """Watermarks per source, raised to the largest stamp seen; never lowered."""
    return upsert(marks, seen, ["source_id"], {"last_ms": F.greatest})


def floor_ms(now_ms: int, lookback_ms: int, watermark_ms: int, requested_ms: int | None = None) -> int:
    """Stamps above this are read. An explicit backfill that starts before the mark ignores the mark."""
    if requested_ms is not None and requested_ms < watermark_ms:
        return requested_ms - 1
    return max(now_ms - lookback_ms - 1, watermark_ms)


def silence(counts: DataFrame) -> DataFrame:
    """source_id, records, watermark_ms, backfill: why a source contributed nothing; null where it did."""
    reason = F.when(F.col("records") > 0, F.lit(None)).when(F.col("backfill"), "empty_backfill").when(F.col("watermark_ms") > 0, "caught_up").otherwise("empty_window")
    return counts.withColumn("reason", reason)


#: The columns that hold free text copied from a source.
SCRUBBED = {
    "turns": ["content_fingerprint", "error_text", "raw_meta_json", "file_paths_json"],
    "sessions": ["git_branch"],
    "findings": ["title", "detail", "evidence_json"],
    "intent_episodes": ["original_intent", "acceptance_criteria_json", "completion_evidence_json"],
    "agent_calls": ["output_json", "error_text"],
    "project_git_snapshots": ["status_porcelain", "recent_log_json", "diff_stat", "error"],
}


def scrub(tables: dict[str, DataFrame], columns: dict[str, list[str]] = SCRUBBED) -> tuple[dict[str, DataFrame], dict[str, DataFrame]]:
    """(tables redacted anew, one row of counts of changed values a table). A named column that a table lacks is an error;
    a table that is not there is passed by. Old versions of the files are to be deleted by the caller: that is the erasure."""
    unknown = sorted(f"{t}.{c}" for t, cs in columns.items() if t in tables for c in cs if c not in tables[t].columns)
    if unknown:
        raise ValueError(f"no such columns: {', '.join(unknown)}")
    cleaned, counts = {}, {}
    for name, wanted in ((t, cs) for t, cs in columns.items() if t in tables):
        df = tables[name]
        counts[name] = df.agg(*[F.count_if(F.coalesce(redact(F.col(c)) != F.col(c), F.lit(False))).alias(c) for c in wanted])
        cleaned[name] = df.withColumns({c: redact(F.col(c)) for c in wanted})
    return cleaned, counts


class VersionedTable:
    """Parquet versions under one folder, each whole. A version is committed by its number in a log that renames without
    overwriting: of two writers that read the same version only one can commit, and the other's rows are never seen."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.log = CommitLog(spark, f"{self.path}/_committed")

    def number(self) -> int:
        """The newest committed version; 0 before the first."""
        return self.log.newest()

    def read(self, number: int | None = None) -> DataFrame | None:
        number = self.number() if number is None else number
        return self.spark.read.parquet(f"{self.path}/{self.log.read(number)['name']}") if number else None

    def commit(self, rows: DataFrame, based_on: int) -> int:
        """Writes the version after ``based_on``, the number that the rows were made from."""
        name = f"version-{uuid.uuid4().hex}"
        rows.write.parquet(f"{self.path}/{name}")
        return self.log.write(based_on + 1, {"name": name})
