"""Queries over costs of projects, what is known of sources, what a store leaves out, imported bundles."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import bundle, rollups, sessions
from ..sources import views as V
from . import catalog
from .registry import DAY, NOW, query

_COSTS = catalog._LINKS + """,
eps_of as (select distinct conv_id, '/p/' || conv_id % 16 as project, case when conv_id % 3 = 0 then 'complete' else 'in_progress' end as status from conversations),
done as (select project, count(*) as complete from eps_of where status = 'complete' and project <> '/p/7' group by 1),
proj as (select distinct project_path as project from ses where project_path <> '' union select '/p/none'),
spent as (select project_path as project, sum(cost) as cost, count(*) as requests, count(distinct source_id || '|' || source_file) as sessions, count(*) filter (where confidence = 'exact') as e, count(*) filter (where confidence = 'high') as h, count(*) filter (where confidence = 'medium') as m from linked where project_path is not null group by 1),
costs as (select project, coalesce(cost, 0) as total, coalesce(requests, 0) as requests, coalesce(sessions, 0) as sessions, case when complete > 0 then coalesce(cost, 0) / complete else 0 end as per, concat_ws(',', case when e > 0 then 'exact=' || e end, case when h > 0 then 'high=' || h end, case when m > 0 then 'medium=' || m end) as mix from proj left join spent using (project) left join done using (project))
"""


def _costs(spark, d):
    rec = V.records(spark, d)
    ses = sessions.group_sessions(rec)
    linked = sessions.link(V.requests(rec), rec, ses).select(F.col("project_path").alias("project"), F.concat_ws("|", "source_id", "source_file").alias("session"), "cost", "confidence")
    episodes = V.load(spark, d, "conversations").select("conv_id").distinct().select(F.concat(F.lit("/p/"), (F.col("conv_id") % 16).cast("string")).alias("project"), F.when(F.col("conv_id") % 3 == 0, "complete").otherwise("in_progress").alias("status")).where("project <> '/p/7'")
    projects = ses.where("project_path <> ''").select(F.col("project_path").alias("project")).union(spark.range(1).select(F.lit("/p/none")))
    return rollups.project_costs(projects, linked, episodes)


@query(_COSTS + "select project, round(total, 4) as total_usd, requests, sessions, round(per, 4) as per_complete_usd, mix from costs")
def project_costs(spark, d):
    """AGG-08: cost, requests, sessions, confidence and cost per complete episode of every project."""
    mix = F.array_join(F.transform(F.array_sort(F.map_entries("confidence")), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ",")
    return _costs(spark, d).select("project", F.round("total_usd", 4).alias("total_usd"), "requests", "sessions", F.round("per_complete_usd", 4).alias("per_complete_usd"), mix.alias("mix"))


@query(_COSTS + """, v as (select list_sort(list(total)) as v, count(*) as n, sum(total) as s, median(total) as m from costs), k as (select *, cast(greatest(least(floor(0.9 * (n + 1)), n - 1), 1) as bigint) as k from v)
select round(s, 4) as total_usd, round(m, 4) as p50_usd, round(case when n >= 10 then v[k] + (0.9 * (n + 1) - k) * (v[k + 1] - v[k]) else v[n] end, 4) as p90_usd, n as project_count from k""")
def cost_summary(spark, d):
    """AGG-10: total, median and ninth decile over project totals."""
    found = rollups.cost_summary(_costs(spark, d))
    return found.select(*[F.round(c, 4).alias(c) for c in ("total_usd", "p50_usd", "p90_usd")], "project_count")


@query(catalog._CADENCE + f""", cnt as (select source_id, count(*) as records from rec where ms > {NOW} - 20 * {DAY} and source_id <> 'pi' group by 1 union all select 'gone', 0),
mark as (select source_id, max(ms) as last_ms from rec where source_id not in ('omp', 'codex') group by 1), base as (select * from cad where source_id <> 'claude')
select source_id, coalesce(records, 0) > 0 as available, coalesce(records, 0) as record_count, case when coalesce(records, 0) = 0 then 'no records in window' end as error, last_ms is not null as ever_ingested,
case when sample_size is null then null when median_gap_ms is null then 'insufficient data' when {NOW} - coalesce(last_ms, 0) > 8 * median_gap_ms then 'stale' else 'ok' end as cadence
from cnt full join mark using (source_id) full join base using (source_id)""")
def source_overview(spark, d):
    """JON-22: sources from three sides, each with sources that the others lack."""
    rec = V.records(spark, d)
    counts = rec.where((F.col("ms") > NOW - 20 * DAY) & (F.col("source_id") != "pi")).groupBy("source_id").agg(F.count("*").alias("records")).union(spark.range(1).select(F.lit("gone"), F.lit(0)))
    marks = rec.where("source_id not in ('omp', 'codex')").groupBy("source_id").agg(F.max("ms").alias("last_ms"))
    return rollups.source_overview(counts, marks, rollups.cadence(rec).where("source_id <> 'claude'"), NOW)


@query(catalog._LINKS + """select s.source_id, count(*) filter (where s.project_path = '') as sessions, coalesce(sum(t.n) filter (where s.project_path = ''), 0)::bigint as turns, coalesce(sum(l.n) filter (where s.project_path = ''), 0)::bigint as links
from ses s left join (select source_id, source_file, count(*) as n from rec where record_type = 'message' group by 1, 2) t using (source_id, source_file)
left join (select source_id, source_file, count(*) as n from linked where tier is not null group by 1, 2) l using (source_id, source_file) group by 1""")
def skipped_counts(spark, d):
    """FLT-06: what goes with sessions that have no project."""
    rec = V.records(spark, d)
    ses = sessions.group_sessions(rec)
    return sessions.skipped(ses, rec, sessions.link(V.requests(rec), rec, ses))


@query("select conv_id::varchar as bundle_id, 'p' || conv_id % 5 as project_name, conv_id || '.html' as source_file, conv_id * 1000 as exported_ms, 5000 + conv_id % 7 as imported_ms, 1 as session_count, count(*) as turn_count from conversations group by conv_id")
def bundles_newest(spark, d):
    """SRT-14: imported bundles, newest first."""
    c, s = F.col("conv_id"), F.col("conv_id").cast("string")
    rows = V.load(spark, d, "conversations").groupBy("conv_id").agg(F.count("*").alias("turn_count"))
    return bundle.listed(rows.select(s.alias("bundle_id"), F.concat(F.lit("p"), (c % 5).cast("string")).alias("project_name"), F.concat(s, F.lit(".html")).alias("source_file"), (c * 1000).alias("exported_ms"), (c % 7 + 5000).alias("imported_ms"), F.lit(1).alias("session_count"), "turn_count"))
