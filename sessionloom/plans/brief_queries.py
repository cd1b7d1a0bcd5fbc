"""Queries over the brief of a project: its record in one row, notes, the plan for what is unfinished."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import sessions, views
from ..sources import views as V
from .finding_queries import _CLIP, _EPISODES, _KINDS, _episodes
from .registry import query

_ISO = "case when coalesce({0}, 0) = 0 then 'unknown' else strftime(to_timestamp(({0}) // 1000), '%Y-%m-%dT%H:%M:%SZ') end"
_AT = lambda n: _CLIP.replace("141", str(n + 1)).replace("140", str(n))
_TOLD = _EPISODES + f""", ep as (select *, case when drift is not null then ended_ms - 2000 end as pivot_ms, {_AT(120).format('intent')} as short, {_AT(160).format('intent')} as longer from eps),
warn as (select project % 6 as project, finding, '(D) [' || severity || '/' || {V.picked_sql(_KINDS, 'finding')} || '] ' || title || ' — d' as line from fin where {V.picked_sql(_KINDS, 'finding')} in ('docs_drift', 'error_burst'))
"""


def _warned(spark, d):
    k = F.col("finding")
    cite = lambda n: F.struct((k * 1000 + n).alias("ts_ms"), F.when(k % 3 > 0, "user").alias("role"), F.concat(F.lit(f"c{n} at /tmp/x/"), k.cast("string")).alias("excerpt"))
    cited = F.when(k % 5 > 0, F.slice(F.array(*[cite(n) for n in range(4)]), F.lit(1), (k % 5).cast("int")))
    return V.findings(spark, d).withColumns({"project": (F.col("project") % 6).cast("long"), "category": V.picked(_KINDS, k), "provenance": F.lit("deterministic"), "detail": F.lit("d"), "citations": cited})


@query(_TOLD + f"""select project, 'decisions' as list, session_id::varchar as item, 0 as place, 'Pivot detected at ' || {_ISO.format('pivot_ms')} || ': intent drifted (' || drift || ') away from “' || short || '”' as line from ep where drift is not null
union all select project, 'gotchas', session_id::varchar, 0, '(D) Abandoned without completion evidence: “' || short || '” (last activity ' || {_ISO.format('ended_ms')} || ')' from ep where status = 'abandoned'
union all select project, 'gotchas', finding::varchar, 0, line from warn
union all select project, 'gotchas', finding::varchar, n + 1, '    ' || strftime(to_timestamp((finding * 1000 + n) // 1000), '%Y-%m-%dT%H:%M:%SZ') || ' ' || case when finding % 3 > 0 then 'user' else '?' end || ': c' || n || ' at <<ephemeral-runtime-path>>' from warn, range(3) r(n) where n < finding % 5""")
def project_notes(spark, d):
    """CMP-01: decisions and gotchas of every project, with what they cite."""
    episodes = _episodes(spark, d).withColumn("pivot_ms", F.when(F.col("drift").isNotNull(), F.col("ended_ms") - 2000))
    return views.notes(episodes, _warned(spark, d))


@query(_TOLD + """, placed as (select project, longer, row_number() over (partition by project order by coalesce(ended_ms, 0) desc, session_id) as phase from ep where status in ('in_progress', 'abandoned')),
proj as (select distinct project from eps union select 99)
select project, coalesce(phase, 1) as phase, case when phase is null then 'No unfinished episode was observed in this window; nothing to remediate.' else longer end as task, phase - 1 as after from proj left join (select * from placed where phase <= 3) using (project)""")
def project_plan(spark, d):
    """CMP-01: phases for the newest unfinished episodes."""
    episodes = _episodes(spark, d).withColumn("started_ms", F.lit(None).cast("long"))
    projects = episodes.select("project").union(spark.range(1).select(F.lit(99)))
    return views.remediation(episodes, projects)


@query(_TOLD + f""", s as (select regexp_extract(project_path, '[0-9]+')::bigint % 6 as project, source_id, started_ms, ended_ms from ses where project_path <> ''),
sa as (select project, min(started_ms) as started_ms, max(ended_ms) as ended_ms, count(*) as sessions, count(distinct source_id) as harnesses from s group by 1),
ea as (select project, count(*) as episodes, count(*) filter (where status = 'unverified') as unverified, count(*) filter (where status = 'in_progress') as in_progress, count(*) filter (where status = 'abandoned') as abandoned from eps group by 1),
fa as (select project, count(*) as findings from fin group by 1),
j as (select project, coalesce(started_ms, 0) as started_ms, coalesce(ended_ms, 0) as ended_ms, coalesce(sessions, 0) as sessions, coalesce(harnesses, 0) as harnesses, coalesce(episodes, 0) as episodes, coalesce(unverified, 0) as unverified, coalesce(in_progress, 0) as in_progress, coalesce(abandoned, 0) as abandoned, coalesce(findings, 0) as findings from sa full join ea using (project) full join fa using (project))
select *, 'Observed window: ' || {_ISO.format('started_ms')} || ' → ' || {_ISO.format('ended_ms')} || ' across ' || sessions || ' correlated session(s) from ' || harnesses || ' harness(es), ' || episodes || ' intent episode(s), ' || findings || ' deterministic finding(s).' as scope from j""")
def project_brief(spark, d):
    """CMP-01, AGG-26: a project's record from three tables in one shuffle; projects of findings reach beyond the others."""
    ses = sessions.group_sessions(V.records(spark, d)).where("project_path <> ''").select((F.regexp_extract("project_path", "[0-9]+", 0).cast("long") % 6).alias("project"), "source_id", "started_ms", "ended_ms")
    found = V.findings(spark, d).select(F.col("project").cast("long").alias("project"))
    return views.brief(ses, _episodes(spark, d), found)
