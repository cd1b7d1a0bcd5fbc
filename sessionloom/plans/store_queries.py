"""Queries over the state operators: every keyed write on one half of the rows, then the other."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import rollups, sessions, state
from ..sources import views as V
from .registry import DAY, NOW, query, redact_sql

_ID = "substr(sha256({}), 1, 16)"
_HALVES = """,
half as (select native_id % 2 as part, source_id, source_file, min(ms) as started_ms, max(ms) as ended_ms, count(*) filter (where record_type = 'message') as record_count,
  coalesce(arg_min(project_path, native_id) filter (where project_path <> ''), '') as project_path, coalesce(arg_min(model, native_id) filter (where model <> ''), '') as model
  from rec where record_type <> 'router_request' group by 1, 2, 3),
a as (select * from half where part = 0), b as (select * from half where part = 1)
"""


def _half(spark, d, part):
    return sessions.group_sessions(V.records(spark, d).where(F.col("native_id") % 2 == part))


def _spans(spark, d, part):
    path = sessions.project_span(_half(spark, d, part)).withColumnRenamed("project_path", "path")
    number = F.element_at(F.split("path", "/"), -1).cast("int")
    remote = F.concat(F.lit(f"git@host{part}:"), number) if part == 0 else F.when(number % 2 == 0, "").otherwise(F.concat(F.lit("https://h/x?password=abcdefgh"), number))
    return path.select("path", T.project_name(F.col("path")).alias("name"), "first_seen_ms", "last_seen_ms", remote.alias("git_remote"))


@query(_HALVES + f""", pa as (select project_path as path, min(started_ms) as f, max(ended_ms) as l from a where project_path <> '' group by 1), pb as (select project_path as path, min(started_ms) as f, max(ended_ms) as l from b where project_path <> '' group by 1)
select {_ID.format("'project|' || path")} as id, path, split_part(path, '/', 3) as name, coalesce(pa.f, pb.f) as first_seen_ms, coalesce(pb.l, pa.l) as last_seen_ms,
coalesce(case when pb.path is null or cast(split_part(path, '/', 3) as int) % 2 = 0 then null else 'https://h/x?password=REDACTED_SECRET' end, case when pa.path is not null then 'git@host0:' || split_part(path, '/', 3) end, '') as git_remote
from pa full join pb using (path)""")
def projects_upsert(spark, d):
    """SNK-01: the last stamp is the update's, a remote stays where the new one is blank, secrets in it are masked."""
    stored = _spans(spark, d, 0).withColumn("id", T.stable_id(F.lit("project"), F.col("path")))
    return state.upsert_projects(stored, _spans(spark, d, 1)).select("id", "path", "name", "first_seen_ms", "last_seen_ms", "git_remote")


def _session_rows(spark, d, part):
    rows = _half(spark, d, part).withColumnRenamed("source_file", "native_id").withColumn("git_branch", F.lit("main")).withColumn("raw_path", F.col("native_id"))
    return rows.withColumn("ended_ms", F.when((F.col("ended_ms") % 3 == 0) & (part == 1), F.lit(None)).otherwise(F.col("ended_ms"))).withColumn("id", T.stable_id(F.lit("session"), F.col("source_id"), F.col("native_id")))


@query(_HALVES + f"""select {_ID.format("'session|' || source_id || '|' || source_file")} as id, source_id, source_file as native_id, coalesce(a.started_ms, b.started_ms) as started_ms,
coalesce(case when b.ended_ms % 3 = 0 then null else b.ended_ms end, a.ended_ms) as ended_ms, coalesce(b.record_count, a.record_count) as record_count, coalesce(a.model, b.model) as model
from a full join b using (source_id, source_file)""")
def sessions_upsert(spark, d):
    """SNK-02: only the end (where given) and the count change."""
    return state.upsert_sessions(_session_rows(spark, d, 0), _session_rows(spark, d, 1)).select("id", "source_id", "native_id", "started_ms", "ended_ms", "record_count", "model")


def _requests(spark, d):
    text = F.col("native_id").cast("string")
    return V.requests(V.records(spark, d)).select(F.lit(V.ROUTER).alias("source_id"), text.alias("native_id"), F.col("ms").alias("timestamp_ms"), "model", F.col("cost").alias("cost_usd"), F.col("native_id").alias("n"))


def _stored_requests(spark, d):
    linked = F.col("n") % 3 == 0
    rows = _requests(spark, d).where("n % 5 <> 0").withColumn("status", F.lit("old")).withColumn("id", T.stable_id(F.lit("router"), F.col("source_id"), F.col("native_id")))
    return rows.select("id", "source_id", "native_id", "timestamp_ms", "model", "cost_usd", "status", F.when(linked, F.concat(F.lit("s"), "native_id")).alias("linked_session_id"), F.when(linked, 1).alias("link_tier"), F.when(linked, "exact").alias("link_confidence"), F.when(linked, "id").alias("link_reason"))


_REQ = f"select {_ID.format(chr(39) + 'router|nine_router|' + chr(39) + ' || native_id')} as id, cast(native_id as varchar) as native_id"


@query(f"""{_REQ}, ms as timestamp_ms, case when native_id % 2 = 0 then cost * 2 else cost end as cost_usd, case when native_id % 2 = 0 then 'new' else 'old' end as status,
case when native_id % 5 <> 0 and native_id % 3 = 0 then 's' || native_id end as linked_session_id, cast(case when native_id % 5 <> 0 and native_id % 3 = 0 then 1 end as int) as link_tier from req where native_id % 5 <> 0 or native_id % 2 = 0""")
def requests_upsert(spark, d):
    """SNK-04: all columns are new but the link's."""
    updates = _requests(spark, d).where("n % 2 = 0").withColumn("cost_usd", F.col("cost_usd") * 2).withColumn("status", F.lit("new"))
    return state.upsert_requests(_stored_requests(spark, d), updates).select("id", "native_id", "timestamp_ms", "cost_usd", "status", "linked_session_id", "link_tier")


@query(f"""{_REQ}, case when native_id % 4 = 0 then 't' || native_id when native_id % 3 = 0 then 's' || native_id end as linked_session_id,
cast(case when native_id % 4 = 0 then 2 when native_id % 3 = 0 then 1 end as int) as link_tier, case when native_id % 4 = 0 then 'high' when native_id % 3 = 0 then 'exact' end as link_confidence from req where native_id % 5 <> 0""")
def request_links(spark, d):
    """SNK-05: links reach the stored requests; older links stay; a link without a request changes nothing."""
    links = _requests(spark, d).where("n % 4 = 0").select("source_id", "native_id", F.concat(F.lit("t"), "native_id").alias("linked_session_id"), F.lit(2).alias("link_tier"), F.lit("high").alias("link_confidence"), F.lit("model").alias("link_reason"))
    return state.link_requests(_stored_requests(spark, d), links).select("id", "native_id", "linked_session_id", "link_tier", "link_confidence")


_RUN_COLUMNS = "id string, started_ms bigint, ended_ms bigint, status string, source_counts_json string, warning_count bigint, error_count bigint"


def _runs(spark, d):
    """Runs by month: odd ones ended, every fourth left running, others started anew."""
    run = V.ledger(spark, d)[0].select("run").distinct()
    none = F.lit(None)
    return run.select(F.concat(F.lit("r"), "run").alias("id"), (F.col("run") * 1000).alias("started_ms"), F.when(F.col("run") % 2 == 1, F.col("run") * 1000 + 500).alias("ended_ms"), F.when(F.col("run") % 2 == 1, "ok").otherwise("running").alias("status"), none.cast("string").alias("source_counts_json"), none.cast("long").alias("warning_count"), none.cast("long").alias("error_count"), "run")


@query(f"""select 'r' || run as id, run * 1000 as started_ms, case when run % 2 = 1 then run * 1000 + 500 when run % 4 = 2 then run * 1000 + 900 else {NOW} end as ended_ms,
case when run % 2 = 1 then 'ok' when run % 4 = 2 then 'failed' else 'interrupted' end as status, case when run % 2 = 0 and run % 4 = 0 then null when run % 2 = 1 then null else run * 1000 + 900 - run * 1000 end as failed_after_ms from (select distinct run from ap)""")
def runs_recovery(spark, d):
    """SNK-06, STM-07: a stored run is not started twice, some finish, those left running are interrupted, ended ones stay."""
    runs = _runs(spark, d).drop("run")
    again = runs.select("id", (F.col("started_ms") + 1).alias("started_ms"))
    ended = _runs(spark, d).where("run % 4 = 2").select("id", (F.col("started_ms") + 900).alias("ended_ms"), F.lit("failed").alias("status"), F.lit("{}").alias("source_counts_json"), F.lit(0).cast("long").alias("warning_count"), F.lit(1).cast("long").alias("error_count"))
    done = state.recover_runs(state.finish_run(state.start_run(runs, again), ended), NOW)
    return done.select("id", "started_ms", "ended_ms", "status", F.when(F.col("status") == "failed", F.col("ended_ms") - F.col("started_ms")).alias("failed_after_ms"))


@query("select 'r' || run as id, run * 1000 as started_ms, case when run % 2 = 1 then 'ok' else 'interrupted' end as status, case when run % 2 = 1 then 500::bigint end as duration_ms from (select distinct run from ap)")
def run_durations(spark, d):
    """PRJ-11: an interrupted run has no duration."""
    runs = state.recover_runs(_runs(spark, d).drop("run"), NOW)
    open_run = F.col("ended_ms").isNull() | (F.col("status") == "interrupted")
    return runs.select("id", "started_ms", "status", F.when(~open_run, F.col("ended_ms") - F.col("started_ms")).alias("duration_ms"))


@query(f"select run, project, case when project % 2 = 0 then run + 7 else run end as captured_ms, case when project % 2 = 0 then 'new' else 'old' end as status_porcelain, run as created_ms from ap")
def snapshots_overwrite(spark, d):
    """SNK-07, 10, 11, 12, 15, 16, 18: rows of a key are replaced, what is kept stays."""
    ap = V.ledger(spark, d)[0]
    stored = ap.select("run", "project", F.col("run").alias("captured_ms"), F.lit("old").alias("status_porcelain"), F.col("run").alias("created_ms"))
    fresh = ap.where("project % 2 = 0").select("run", "project", (F.col("run") + 7).alias("captured_ms"), F.lit("new").alias("status_porcelain"), (F.col("run") + 7).alias("created_ms"))
    return state.overwrite(stored, fresh, ["run", "project"], keep=("created_ms",))


@query(f"select {_ID.format(chr(39) + 'agent_event|' + chr(39) + ' || (user_id % 9) || ' + chr(39) + '||' + chr(39) + ' || event_id || ' + chr(39) + '|' + chr(39) + ' || event_type || ' + chr(39) + '|' + chr(39) + ' || props')} as id, cast(user_id % 9 as varchar) as run_id, event_type as topic from events")
def events_append(spark, d):
    """SNK-09: ids from content; a repeated one would raise."""
    e = V.load(spark, d, "events")
    rows = e.select(F.lit("").alias("id"), (F.col("user_id") % 9).cast("string").alias("run_id"), F.lit(None).cast("string").alias("call_id"), F.col("event_id").alias("ts_ms"), F.col("event_type").alias("topic"), F.col("props").alias("message"))
    return state.append_events(rows.limit(0), rows).select("id", "run_id", "topic")


def _finding_table(spark, d):
    f = V.findings(spark, d)
    none = lambda kind, name: F.lit(None).cast(kind).alias(name)
    evidence = F.concat(F.lit('{"n": '), F.col("finding"), F.lit("}"))
    return f.select(F.col("finding").cast("string").alias("id"), F.col("project").cast("string").alias("project_id"), "category", "severity", "title", F.lit("d").alias("detail"), evidence.alias("evidence_json"), F.lit("medium").alias("confidence"), F.col("finding").alias("created_ms"), none("long", "resolved_ms"), none("string", "dismissal_reason"), none("string", "dismissed_evidence_sha"), none("long", "dismissed_ms"))


_SHA = "substr(sha256('{\"n\":' || finding || '}'), 1, 16)"


@query(f"select cast(finding as varchar) as id, case when finding % 3 = 0 and finding % 6 <> 0 then 'wont-fix' end as dismissal_reason, case when finding % 3 = 0 and finding % 6 <> 0 then {_SHA} end as dismissed_evidence_sha, case when finding % 3 = 0 and finding % 6 <> 0 then {NOW} end as resolved_ms from fin")
def findings_dismiss(spark, d):
    """SNK-13: a closed set of reasons, the judged evidence is pinned; lifting clears four columns."""
    table = _finding_table(spark, d)
    chosen = table.where("created_ms % 3 = 0").select("id")
    done = state.undismiss(state.dismiss(table, chosen, "wont-fix", NOW), table.where("created_ms % 6 = 0").select("id"))
    return done.select("id", "dismissal_reason", "dismissed_evidence_sha", "resolved_ms")


@query(f"""select cast(finding as varchar) as finding_id, case when finding % 3 = 0 and finding % 4 <> 0 then true else false end as resolved, case when finding % 3 = 0 and finding % 4 <> 0 then 'wrong' end as dismissal_reason from fin where finding % 2 = 0""")
def findings_observe(spark, d):
    """LIF-04: the same evidence keeps a dismissal (observed as resolved), other evidence lifts it."""
    table = state.dismiss(_finding_table(spark, d), _finding_table(spark, d).where("created_ms % 3 = 0").select("id"), "wrong", NOW)
    seen = table.where("created_ms % 2 = 0").select("id", F.when(F.col("created_ms") % 4 == 0, F.lit('{"n": -1}')).otherwise(F.col("evidence_json")).alias("evidence_json"))
    kept, observed = state.observe(table, seen, "r1", NOW)
    return observed.join(kept.select(F.col("id").alias("finding_id"), "dismissal_reason"), "finding_id").select("finding_id", "resolved", "dismissal_reason")


@query(f"""select {_ID.format("'finding|' || project || '|' || title || '|' || category")} as id, case when finding % 2 = 0 then 'high' else severity end as severity, finding as created_ms, case when finding % 2 = 0 then 'saw password=REDACTED_SECRET' else 'd' end as detail from (select *, row_number() over (partition by project, title, category order by finding) as k from fin) where k = 1""")
def findings_upsert(spark, d):
    """SNK-14: severity and detail are the new ones, created_ms stays, text is redacted."""
    table = _finding_table(spark, d)
    keyed = table.withColumn("id", T.stable_id(F.lit("finding"), F.col("project_id"), F.col("title"), F.col("category")))
    fresh = table.where("created_ms % 2 = 0").withColumn("severity", F.lit("high")).withColumn("detail", F.lit("saw password=abcdefgh1")).withColumn("created_ms", F.lit(0).cast("long")).withColumn("provenance", F.lit("agent"))
    return state.upsert_findings(keyed.withColumn("provenance", F.lit("deterministic")), fresh).select("id", "severity", "created_ms", "detail")


@query(f"""select 'turns' as "table", 'content_fingerprint' as "column", count(*) filter (where {redact_sql('t')} <> t) as changed from (select text || ' ' || {V.picked_sql(V.PLANTS, 'conv_id + turn')} as t from conversations)
union all select 'sessions', 'git_branch', count(*) filter (where {redact_sql('source')} <> source) from documents""")
def scrub_counts(spark, d):
    """SNK-25: changed values of each named column."""
    texts = V.load(spark, d, "conversations").select(F.concat("text", F.lit(" "), V.picked(V.PLANTS, F.col("conv_id") + F.col("turn"))).alias("content_fingerprint"))
    wanted = {"turns": ["content_fingerprint"], "sessions": ["git_branch"]}
    _, counts = state.scrub({"turns": texts, "sessions": V.load(spark, d, "documents").select(F.col("source").alias("git_branch"))}, wanted)
    rows = [df.select(F.lit(name).alias("table"), F.lit(c).alias("column"), F.col(c).alias("changed")) for name, df in counts.items() for c in wanted[name]]
    return rows[0].union(rows[1])


@query(f"""select source_id, coalesce(n, 0) as records, wm as watermark_ms, backfill, case when n > 0 then null when backfill then 'empty_backfill' when wm > 0 then 'caught_up' else 'empty_window' end as reason from (values {", ".join(f"('{s}', {k})" for k, s in enumerate([*V.SOURCES, V.ROUTER, 'idle']))}) v(source_id, k)
left join (select source_id, count(*) as n from rec where ms > {NOW} - 12 * {DAY} and user_id % 5 < 2 group by 1) using (source_id) cross join lateral (select k % 2 * {NOW} as wm, k = 2 as backfill)""")
def source_silence(spark, d):
    """AGG-04, STM-09: a row for every source, silent ones with the reason."""
    counts = V.records(spark, d).where((F.col("ms") > NOW - 12 * DAY) & (F.col("user_id") % 5 < 2)).groupBy("source_id").agg(F.count("*").alias("n"))
    known = spark.createDataFrame([(s, k % 2 * NOW, k == 2) for k, s in enumerate([*V.SOURCES, V.ROUTER, "idle"])], "source_id string, watermark_ms bigint, backfill boolean")
    return state.silence(known.join(counts, "source_id", "left").select("source_id", F.coalesce("n", F.lit(0)).alias("records"), "watermark_ms", "backfill"))


@query(f"select source_id, native_id, ms from rec where ms > {NOW} - 40 * {DAY}::bigint - 1")
def backfill_window(spark, d):
    """FLT-03, STM-02: an explicit window that starts before the mark is read whole."""
    floor = state.floor_ms(NOW, 10 * DAY, NOW - 2 * DAY, requested_ms=NOW - 40 * DAY)
    return V.records(spark, d).where(F.col("ms") > floor).select("source_id", "native_id", "ms")


@query("""select source_id, case when count(*) >= 20 and trunc(median(gap)) > 0 then cast(trunc(median(gap)) as bigint) end as median_gap_ms, count(*) as sample_size, max(ms) as watermark_ms from (
select source_id, ms, ms - lag(ms) over (partition by source_id order by ms) as gap from (select source_id, ms, row_number() over (partition by source_id order by ms desc) as k from (select distinct source_id, ms from rec)) where k <= 200) group by 1""")
def cadence_union(spark, d):
    """STM-04: the baseline comes from stored stamps and the batch's together."""
    rec = V.records(spark, d).select("source_id", "ms")
    stored, batch = rec.where(F.col("ms") <= NOW - 5 * DAY), rec.where(F.col("ms") > NOW - 6 * DAY)
    return rollups.cadence(stored.union(batch))


@query(f"""select daily, monthly, case when daily + 500 > 700 then 'agent_skipped_cumulative_cap_daily' when monthly + 500 > 9000 then 'agent_skipped_cumulative_cap_monthly' end as reason, round(greatest(700 - daily, 0), 4) as daily_left, round(greatest(9000 - monthly, 0), 4) as monthly_left
from (select round(coalesce(sum(cost) filter (where ms >= {NOW} - 5 * {DAY}::bigint), 0), 4) as daily, round(coalesce(sum(cost) filter (where ms >= {NOW} - 30 * {DAY}::bigint), 0), 4) as monthly from req)""")
def spend_admission(spark, d):
    """CST-01, CST-03: a run is admitted only where its whole cap still fits; what is left of each cap."""
    since = lambda days: F.round(F.coalesce(F.sum(F.when(F.col("ms") >= NOW - days * DAY, F.col("cost"))), F.lit(0.0)), 4)
    spent = V.requests(V.records(spark, d)).agg(since(5).alias("daily"), since(30).alias("monthly"))
    return rollups.admission(spent, 500.0, 700.0, 9000.0)


@query("select model, round(sum(cost), 4) as paid, count(*) as calls, count(*) filter (where cost > 90) as skipped, case when sum(cost) > 0 and count(*) filter (where cost > 90) > 0 then 'capped' when sum(cost) > 0 then 'completed' else 'disabled' end as run_status from req group by 1")
def agent_run_status(spark, d):
    """CST-04: capped where a paid run skipped a project, completed where it skipped none."""
    per = V.requests(V.records(spark, d)).groupBy("model").agg(F.round(F.sum("cost"), 4).alias("paid"), F.count("*").alias("calls"), F.count_if(F.col("cost") > 90).alias("skipped"))
    return per.withColumn("run_status", F.when((F.col("paid") > 0) & (F.col("skipped") > 0), "capped").when(F.col("paid") > 0, "completed").otherwise("disabled"))
