"""Queries over the read views: finding lists and diffs, episodes, citations, ranking, counts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import analysis, lifecycle, sessions, views
from ..sources import views as V
from . import catalog
from .registry import DAY, NOW, query

_STATES, _SIGNALS = catalog._STATES, catalog._SIGNALS
_LATEST = _STATES + ", latest as (select * from state where run = (select max(run) from ap))"


def _states(spark, d):
    return lifecycle.states(*V.ledger(spark, d))


def _latest(spark, d):
    found = _states(spark, d)
    return found.join(V.ledger(spark, d)[0].agg(F.max("run").alias("run")), "run").select("finding", "project", "state")


def _findings(spark, d):
    closed = F.when(F.col("finding") % 7 == 0, F.col("finding"))
    return V.findings(spark, d).withColumn("resolved_ms", closed).withColumn("confidence", F.lit(None).cast("string")).withColumn("created_ms", F.col("finding") * 10).withColumn("provenance", F.when(F.col("finding") % 5 == 0, "agent").otherwise("deterministic")).withColumn("severity", F.when(F.col("finding") % 11 != 0, F.col("severity")))


_LIST = _LATEST + """, lst as (select f.finding, f.project, f.category, coalesce(case when f.finding % 11 <> 0 then f.severity end, 'medium') as severity, f.title, 'medium' as confidence, f.finding * 10 as created_ms,
case when f.dismissed then 'dismissed' else coalesce(l.state, case when f.finding % 7 = 0 then 'resolved' end, 'new') end as state, case when f.finding % 5 = 0 then 'A' else 'D' end as provenance, case when f.finding % 11 <> 0 then f.severity end as raw_severity
from fin f left join latest l using (finding))
"""


@query(_LIST + "select finding, project, category, severity, title, confidence, created_ms, state, provenance from lst")
def finding_list(spark, d):
    """LIF-03, PRJ-08: every finding with its state, defaults and provenance."""
    return views.listing(_findings(spark, d), _latest(spark, d))


@query(_LIST + "select finding, severity, state, created_ms from lst where raw_severity = 'high' and category = 'BUILDING' and state in ('new', 'regressed') order by created_ms desc, finding limit 20")
def finding_filter(spark, d):
    """FLT-08, FLT-09, SRT-04, SRT-13: filters that reach the scan, the default states, newest first, a clamped limit."""
    shown = views.listing(_findings(spark, d), _latest(spark, d), severity="high", category="BUILDING")
    return shown.where(F.col("state").isin(views.wanted_states(None))).select("finding", "severity", "state", "created_ms").orderBy(F.desc("created_ms"), "finding").limit(views.limit_of("20"))


@query("select finding, title from fin where contains(lower(title), lower('R#00000001')) and severity = 'low'")
def finding_search(spark, d):
    """FLT-12."""
    return V.findings(spark, d).where(F.lower("title").contains("r#00000001") & (F.col("severity") == "low")).select("finding", "title")


@query(_LATEST + " select l.finding, l.state, coalesce(f.category, 'unknown') as category, coalesce(f.severity, 'medium') as severity from latest l left join fin f on f.finding = l.finding and f.finding % 3 <> 0")
def finding_diff(spark, d):
    """LIF-06, JON-26, SRT-05: a run's states with meta data, unknown where there is none."""
    return views.diff(_latest(spark, d), V.findings(spark, d).where("finding % 3 <> 0")).orderBy("finding")


@query("select (select max(run) from ap where run < (select max(run) from ap)) as previous, (select max(run) from ap) as current, (select max(run) from ap where run < 24000) as before")
def run_pair(spark, d):
    """LIF-01: the last two runs that analysed something, and the one before a given run."""
    analysed = V.ledger(spark, d)[0]
    return views.run_pair(analysed).crossJoin(views.run_pair(analysed, 24_000).select(F.col("previous").alias("before")))


@query(_STATES + "select finding, string_agg(run || ':' || state, ',' order by run, state) as timeline from state group by 1")
def finding_timeline(spark, d):
    """WIN-14."""
    return views.timeline(_states(spark, d))


@query(_STATES + """, d as (select severity, cast(sum(case when state in ('new', 'regressed') then 1 when state in ('resolved', 'dismissed') then -1 else 0 end) as bigint) as backlog_delta from state join fin using (finding) group by 1),
o as (select finding, arg_max(state, run) as last, min(run) as first from state group by 1),
a as (select severity, round(quantile_cont((select max(run) from ap) - first, 0.5), 4) as age_p50, round(quantile_cont((select max(run) from ap) - first, 0.9), 4) as age_p90 from o join fin using (finding) where last in ('new', 'persisting', 'regressed') group by 1),
n as (select severity, count(*) as not_observed from fin where finding not in (select finding from obs) group by 1)
select severity, backlog_delta, age_p50, age_p90, coalesce(not_observed, 0) as not_observed from d left join a using (severity) left join n using (severity)""")
def finding_backlog(spark, d):
    """AGG-12, AGG-14, LIF-05: by severity, what came less what went, ages of what is open, and findings never observed."""
    found, by = _states(spark, d), V.findings(spark, d).select("finding", F.col("severity").alias("group"))
    last = V.ledger(spark, d)[0].agg(F.max("run")).first()[0] or 0
    never = by.join(V.ledger(spark, d)[1], "finding", "left_anti").groupBy("group").agg(F.count("*").alias("not_observed"))
    both = views.backlog(found, by).join(views.ages(found, by, last), "group", "left").join(never, "group", "left")
    return both.select(F.col("group").alias("severity"), "backlog_delta", "age_p50", "age_p90", F.coalesce("not_observed", F.lit(0)).alias("not_observed"))


@query(_LIST + "select count(*) as findings, count(*) filter (where state = 'new') as new_count, count(*) filter (where state = 'regressed') as regressed_count, count(*) filter (where raw_severity = 'high' and finding % 7 <> 0) as high_open, count(*) filter (where provenance = 'A') as agent_findings from lst")
def report_counts(spark, d):
    """AGG-22, AGG-23, AGG-25, FLT-13."""
    shown = views.listing(_findings(spark, d), _latest(spark, d)).join(_findings(spark, d).select("finding", F.col("severity").alias("raw"), "resolved_ms"), "finding")
    return shown.agg(F.count("*").alias("findings"), F.count_if(F.col("state") == "new").alias("new_count"), F.count_if(F.col("state") == "regressed").alias("regressed_count"), F.count_if((F.col("raw") == "high") & F.col("resolved_ms").isNull()).alias("high_open"), F.count_if(F.col("provenance") == "A").alias("agent_findings"))


def _episodes(spark, d):
    rows = analysis.analyse(V.turns(spark, d), V.git(spark, d), NOW).join(V.git(spark, d).select("session_id", "ended_ms"), "session_id", "left")
    return rows.select((F.col("session_id") % 6).alias("project"), "session_id", F.col("completion_status").alias("status"), F.col("drift_type").alias("drift"), "ended_ms", F.col("original_intent").alias("intent"))


_EPISODES = _SIGNALS + f""", ints as (select session_id, min(idx) as intent_idx, arg_min(text, idx) as intent from turn where role = 'user' and length(text) > 40 group by 1),
pivs as (select session_id, min(idx) as pivot_idx from turn left join ints using (session_id) where role = 'user' and (intent_idx is null or idx > intent_idx) and {catalog._word(T.PIVOT)} group by 1),
eps as (select session_id % 6 as project, session_id, completion_status as status, case when pivot_idx is not null then 'mid_session_pivot' end as drift, git.ended_ms, coalesce(intent, '(unknown intent)') as intent from told left join ints using (session_id) left join pivs using (session_id) left join git using (session_id))
"""


@query(_EPISODES + "select project, status, count(*) as episodes from eps group by 1, 2")
def episodes_by_status(spark, d):
    """AGG-19."""
    return _episodes(spark, d).groupBy("project", "status").agg(F.count("*").alias("episodes"))


@query(_EPISODES + "select project, session_id, place from (select *, row_number() over (partition by project order by coalesce(ended_ms, 0) desc, session_id) as place from eps) where place <= 50")
def episodes_newest(spark, d):
    """SRT-03."""
    return views.newest(_episodes(spark, d), "project", [F.desc(F.coalesce("ended_ms", F.lit(0))), F.col("session_id")], 50).select("project", "session_id", F.col("place").cast("long").alias("place"))


@query(_EPISODES + "select project, session_id, place from (select *, row_number() over (partition by project order by coalesce(ended_ms, 0) desc, session_id) as place from eps where status in ('in_progress', 'abandoned')) where place <= 3")
def remediation_tasks(spark, d):
    """SRT-08: the newest unfinished episodes."""
    unfinished = _episodes(spark, d).where(F.col("status").isin("in_progress", "abandoned"))
    return views.newest(unfinished, "project", [F.desc(F.coalesce("ended_ms", F.lit(0))), F.col("session_id")], 3).select("project", "session_id", F.col("place").cast("long").alias("place"))


_CLIP = "case when length({0}) <= 140 then {0} else rtrim(case when not regexp_matches(substr({0}, 141, 1), '\\s') and contains(list_last(string_split(left({0}, 140), ' ')), '/') then left({0}, 140 - length(list_last(string_split(left({0}, 140), ' ')))) else left({0}, 140) end, chr(9) || chr(10) || chr(13) || ' ') || '…' end"


@query(_EPISODES + f""", span as (select project, max(ended_ms) as end_ms from eps group by 1),
sd as (select session_id % 6 as project, text, row_number() over (partition by session_id % 6 order by session_id, idx) as place from (select session_id, text, min(idx) as idx from turn where {catalog._word(T.TODO)} group by 1, 2)),
items as (select project % 6 as project, title, case severity when 'high' then 6.0 when 'medium' then 4.0 else 2.0 end + least(finding % 9, 5) as score, false as unknown from fin where finding % 40 = 0
union all select project, case when intent = '(unknown intent)' then 'Reconstruct the original intent before resuming' else 'Finish: ' || {_CLIP.format('intent')} end, round(4.0 + case when drift is not null then 2.0 else 0.0 end - least(greatest(0.0, (coalesce(end_ms, 0) - coalesce(ended_ms, end_ms, 0)) / 86400000.0) * 0.1, 2.0), 2), intent = '(unknown intent)' from eps left join span using (project) where status in ('in_progress', 'abandoned')
union all select project, 'Follow up: ' || {_CLIP.format('text')}, 1.5, false from sd where place <= 3)
select project, place, score, unknown from (select *, row_number() over (partition by project order by score desc, title) as place from items) where place <= 10""")
def next_tasks(spark, d):
    """CMP-02, MTH-06: three kinds of tasks in one ranking."""
    found = V.findings(spark, d).where("finding % 40 = 0").select((F.col("project") % 6).cast("long").alias("project"), "title", "severity", (F.col("finding") % 9).alias("surface"))
    episodes = _episodes(spark, d)
    todo = V.turns(spark, d).where(T.has_word(F.col("text"), T.TODO)).groupBy("session_id", "text").agg(F.min("idx").alias("idx")).withColumn("project", F.col("session_id") % 6)
    seeds = views.newest(todo, "project", [F.col("session_id"), F.col("idx")], 3).select("project", "place", "text")
    ranked = views.rank_next(found, episodes, seeds, episodes.groupBy("project").agg(F.max("ended_ms").alias("end_ms")))
    return ranked.select("project", F.col("place").cast("long").alias("place"), "score", "unknown")


_KINDS = ["incomplete_work", "tech_debt", "docs_drift", "error_burst"]


@query(_EPISODES + f""", sd as (select session_id % 6 as project, text, row_number() over (partition by session_id % 6 order by session_id, idx) as place from (select session_id, text, min(idx) as idx from turn where {catalog._word(T.TODO)} group by 1, 2)),
told_of as (select project, status, intent, ended_ms, case when coalesce(ended_ms, 0) = 0 then 'unknown' else strftime(to_timestamp(ended_ms // 1000), '%Y-%m-%dT%H:%M:%SZ') end as last, case when coalesce(ended_ms, 0) = 0 then 'unknown' else strftime(to_timestamp((ended_ms - 5000) // 1000), '%Y-%m-%dT%H:%M:%SZ') end as first from eps)
select project, 'completed' as list, ended_ms as at, intent || ' — last activity ' || last as line from told_of where status = 'unverified'
union all select project, 'in_progress', ended_ms, intent || ' — started ' || first || ', last activity ' || last from told_of where status = 'in_progress'
union all select project % 6, 'pending', 0, '(D) [' || severity || '/' || {V.picked_sql(_KINDS, 'finding')} || '] ' || title || ' — d' from fin where finding % 4 <> 3
union all select project, 'pending', place, {_CLIP.replace('141', '201').replace('140', '200').format('text')} from sd where place <= 5""")
def project_progress(spark, d):
    """CMP-01: what is done, under way and pending in every project."""
    episodes = _episodes(spark, d).withColumn("started_ms", F.col("ended_ms") - 5000)
    found = V.findings(spark, d).withColumns({"project": (F.col("project") % 6).cast("long"), "category": V.picked(_KINDS, F.col("finding")), "provenance": F.lit("deterministic"), "detail": F.lit("d")})
    todo = V.turns(spark, d).where(T.has_word(F.col("text"), T.TODO)).groupBy("session_id", "text").agg(F.min("idx").alias("idx")).withColumn("project", F.col("session_id") % 6)
    seeds = views.newest(todo, "project", [F.col("session_id"), F.col("idx")], 5).select("project", "place", "text")
    return views.progress(episodes, found, seeds)


def _cited(spark, d):
    path = F.when(F.col("ended_ms") % 2 == 0, F.concat(F.lit("/tmp/run/"), "source_file")).otherwise(F.col("source_file"))
    return sessions.group_sessions(V.records(spark, d)).where("project_path <> ''").select("project_path", "source_id", F.col("source_file").alias("native_id"), path.alias("raw_path"), "started_ms", "ended_ms", F.col("record_count").alias("turn_count"))


_AT = "strftime(to_timestamp({0} // 1000), '%Y-%m-%dT%H:%M:%SZ')"


@query(f"select project_path, place, '`' || source_id || '` session `' || source_file || '` — ' || case when ended_ms % 2 = 0 then '{T.EPHEMERAL_TOKEN}' else source_file end || ' (' || {_AT.format('started_ms')} || ' → ' || {_AT.format('ended_ms')} || ', ' || record_count || ' turns)' as citation from (select *, row_number() over (partition by project_path order by started_ms, source_file) as place from ses where project_path <> '') where place <= 12")
def session_citations(spark, d):
    """SRT-07, CMP-06."""
    return views.citations(_cited(spark, d), "project_path").select("project_path", F.col("place").cast("long").alias("place"), "citation")


@query(f"select project_path, 'Observed window: ' || {_AT.format('min(started_ms)')} || ' → ' || {_AT.format('max(ended_ms)')} || ' across ' || count(*) || ' correlated session(s) from ' || count(distinct source_id) || ' harness(es)' as scope, count(distinct source_id) as harnesses from ses where project_path <> '' group by 1")
def project_scope(spark, d):
    """AGG-26, CMP-01."""
    return views.scope(sessions.group_sessions(V.records(spark, d)).where("project_path <> ''"), "project_path")


@query(_LIST + "select finding, case when provenance = 'A' then '(A)' else '(D)' end || ' [' || severity || '/' || category || '] ' || title || ' — d' as line from lst")
def finding_lines(spark, d):
    """CMP-06."""
    shown = views.listing(_findings(spark, d), _latest(spark, d)).withColumn("detail", F.lit("d")).withColumn("provenance", F.when(F.col("provenance") == "A", "agent").otherwise("deterministic"))
    return shown.select("finding", views.finding_line().alias("line"))


_FILES = ["go.mod", "README.md", "index.html", "openapi.json", "Podfile", "notes.txt"]


@query(f"select c_custkey, case when list_contains(n, 'Podfile') then 'ios' when list_contains(n, 'index.html') then 'web' when list_contains(n, 'openapi.json') then 'api' when list_contains(n, 'go.mod') then 'cli' else 'generic' end as platform from (select c_custkey, [{V.picked_sql(_FILES, 'c_custkey')}, {V.picked_sql(_FILES, 'c_custkey // 6')}] as n from customer)")
def platform_probe(spark, d):
    """SRC-20, ANL-12: exactly one platform, by priority."""
    k = F.col("c_custkey")
    names = F.array(V.picked(_FILES, k), V.picked(_FILES, F.floor(k / 6)))
    return V.load(spark, d, "customer").select("c_custkey", views.platform(names).alias("platform"))


@query("select finding, case when finding % 4 = 0 then 'project path no longer exists' end as title, case when finding % 4 = 0 then 'low' end as severity from fin")
def missing_projects(spark, d):
    """FLT-07, ANL-11: a project whose path is gone gives one low finding."""
    live = V.findings(spark, d).where("finding % 4 <> 0").select("finding", F.lit(True).alias("live"))
    gone = F.col("live").isNull()
    return V.findings(spark, d).select("finding").join(live, "finding", "left").select("finding", F.when(gone, "project path no longer exists").alias("title"), F.when(gone, "low").alias("severity"))


@query(f"select item_id, case when item_id % 3 = 0 then null when item_id % 2 = 0 then item_id else {NOW} end as archived_ms, item_id % 3 = 0 as served from benchmark")
def artifacts_reconcile(spark, d):
    """CMP-05, FLT-10, JON-18: artifacts with the expected stamp are served, others archived, once."""
    found = F.when(F.col("item_id") % 3 == 0, "aa").when(F.col("item_id") % 3 == 1, "bb")
    rows = V.load(spark, d, "benchmark").select("item_id", F.lit("resumption").alias("prompt_type"), found.alias("found"), F.when(F.col("item_id") % 2 == 0, F.col("item_id")).alias("archived_ms"))
    stamps = spark.createDataFrame([("resumption", "aa")], "prompt_type string, expected string")
    return views.reconcile(rows, stamps, NOW).select("item_id", "archived_ms", F.col("archived_ms").isNull().alias("served"))


@query("""select session_id, link from (select session_id, arg_min(link, k) as link, min(k) as k from (
select session_id, 'same_project' as link, 0 as k from (select distinct session_id from turn where session_id % 6 = 1 order by 1 desc limit 50)
union all select session_id, 'same_intent', 1 from (select distinct session_id from turn where session_id % 5 = 1 order by 1 desc limit 10)
union all select session_id, 'same_time', 2 from (select distinct session_id from turn where session_id < 40 order by 1 desc limit 20)) group by 1) order by k, session_id desc limit 25""")
def neighbours_ranked(spark, d):
    """SRT-12, SET-07: three lists in order, a session once, 25 in all."""
    ids = V.turns(spark, d).select("session_id").distinct()
    top = lambda where, n: ids.where(where).orderBy(F.desc("session_id")).limit(n)
    return views.neighbours([("same_project", top("session_id % 6 = 1", 50)), ("same_intent", top("session_id % 5 = 1", 10)), ("same_time", top("session_id < 40", 20))])


@query("select p.project, r.run, coalesce(case when exists (select 1 from ap s where s.project = p.project and s.run = r.run and s.run % 2 = 0) then r.run end, (select max(s.run) from ap s where s.project = p.project and s.run % 2 = 0 and s.run < r.run)) as snapshot_run from (select distinct run from ap) r cross join (select distinct project from ap where run % 2 = 0) p")
def snapshot_asof(spark, d):
    """JON-13: a run's own snapshot, else the newest before it."""
    ap = V.ledger(spark, d)[0]
    runs = ap.select("run").distinct().withColumn("started_ms", F.col("run"))
    return views.snapshot_asof(runs, ap.where("run % 2 = 0").select("run", "project", F.col("run").alias("captured_ms")))


@query("select count(distinct native_id) as request_ids, (select count(distinct native_id) from rec where record_type <> 'router_request') as session_ids, (select count(*) from (select hint from req where hint is not null intersect select native_id from rec where record_type <> 'router_request')) as shared from req")
def tier1_reach(spark, d):
    """AGG-27: how many ids of requests are ids of sessions' records."""
    rec = V.records(spark, d)
    own = rec.where("record_type <> 'router_request'").select("native_id").distinct()
    req = V.requests(rec)
    shared = req.where("hint is not null").select(F.col("hint").alias("native_id")).distinct().join(own, "native_id", "left_semi").agg(F.count("*").alias("shared"))
    return req.agg(F.count_distinct("native_id").alias("request_ids")).crossJoin(own.agg(F.count("*").alias("session_ids"))).crossJoin(shared)


@query(f"select round(coalesce(sum(cost), 0), 4) as total_agent_spend, count(*) as calls from req where ms >= {NOW} - 31 * {DAY}::bigint")
def total_spend(spark, d):
    """AGG-05."""
    return V.requests(V.records(spark, d)).where(F.col("ms") >= NOW - 31 * DAY).agg(F.round(F.coalesce(F.sum("cost"), F.lit(0.0)), 4).alias("total_agent_spend"), F.count("*").alias("calls"))
