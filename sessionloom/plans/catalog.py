"""Registered queries over the driver's tables, each with its SQL where SQL can express it."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import analysis, lifecycle, rollups, sessions, state
from ..sources import views as V
from .registry import DAY, NOW, QUERIES, SQL, query, redact_sql
from .registry import word_sql as _word

__all__ = ["QUERIES", "SQL"]


def _rec(spark, d):
    return V.records(spark, d)


def _ses(spark, d):
    return sessions.group_sessions(_rec(spark, d))


def _linked(spark, d):
    rec = _rec(spark, d)
    return sessions.link(V.requests(rec), rec, sessions.group_sessions(rec))


# Sessions -----------------------------------------------------------------------------------------------------------


@query("select * from ses")
def session_group(spark, d):
    return _ses(spark, d)


@query("select source_id, min(started_ms) as started_ms, max(ended_ms) as ended_ms, count(*) as sessions from ses group by 1")
def session_bounds(spark, d):
    return _ses(spark, d).groupBy("source_id").agg(F.min("started_ms").alias("started_ms"), F.max("ended_ms").alias("ended_ms"), F.count("*").alias("sessions"))


@query("select project_path, min(started_ms) as first_seen_ms, max(ended_ms) as last_seen_ms, count(*) as sessions from ses where project_path <> '' group by 1")
def project_span(spark, d):
    return sessions.project_span(_ses(spark, d))


@query("select source_id, count(*) as records, max(ms) as last_ms from rec group by 1")
def source_counts(spark, d):
    return _rec(spark, d).groupBy("source_id").agg(F.count("*").alias("records"), F.max("ms").alias("last_ms"))


@query(f"select source_id, native_id, ms from rec where ms >= {NOW} - 14 * {DAY} and ms > {NOW} - 10 * {DAY}")
def window_filter(spark, d):
    return _rec(spark, d).where((F.col("ms") >= NOW - 14 * DAY) & (F.col("ms") > NOW - 10 * DAY)).select("source_id", "native_id", "ms")


@query(f"select source_id, greatest(max(ms) filter (where ms <= {NOW} - 15 * {DAY}), coalesce(max(ms) filter (where ms > {NOW} - 15 * {DAY}), 0)) as last_ms from rec group by 1")
def watermark_advance(spark, d):
    marks = lambda rows: rows.groupBy("source_id").agg(F.max("ms").alias("last_ms"))
    rec = _rec(spark, d)
    return state.advance(marks(rec.where(F.col("ms") <= NOW - 15 * DAY)), marks(rec.where(F.col("ms") > NOW - 15 * DAY)))


@query("select source_id, native_id, source_file, last_value(nullif(project_path, '') ignore nulls) over (partition by source_id, source_file order by native_id rows unbounded preceding) as sticky_project from rec where record_type <> 'router_request'")
def sticky_state(spark, d):
    return sessions.sticky(_rec(spark, d).where("record_type <> 'router_request'")).select("source_id", "native_id", "source_file", "sticky_project")


# Links --------------------------------------------------------------------------------------------------------------

_BEST = "arg_min({0}, {{'a': started_ms, 'b': source_id, 'c': source_file}})"
_PICK = ", ".join(f"{_BEST.format(c)} as {c}" for c in ("source_id", "source_file", "project_path"))
_LINKS = f""",
ids as (select native_id, native_id as id from req union all select native_id, hint from req where hint is not null),
one as (select native_id, {_PICK} from (select i.native_id, s.* from ids i join rec r on r.native_id = i.id and r.record_type <> 'router_request' join ses s on s.source_id = r.source_id and s.source_file = r.source_file) group by 1),
cand2 as (select q.native_id, q.ms, s.* from req q join ses s on q.model = s.model and q.ms between s.started_ms - 30000 and s.ended_ms + 30000),
clear2 as (select * from cand2 where project_path <> '' and native_id in (select native_id from cand2 where project_path <> '' group by 1 having count(distinct project_path) = 1)),
two as (select native_id, {_PICK} from clear2 where native_id not in (select native_id from one) group by 1),
prints as (select distinct source_id, source_file, lower(trim(regexp_replace(excerpt, '[\\s\\p{{Z}}]+', ' ', 'g'))) as p from rec where record_type <> 'router_request'),
cand3 as (select q.native_id, s.* from req q join prints f on lower(trim(regexp_replace(q.excerpt, '[\\s\\p{{Z}}]+', ' ', 'g'))) = f.p join ses s using (source_id, source_file)
  where s.project_path <> '' and q.ms between s.started_ms - 30000 and s.ended_ms + 30000),
three as (select native_id, {_PICK} from cand3 where native_id in (select native_id from cand3 group by 1 having count(distinct project_path) = 1)
  and native_id not in (select native_id from one) and native_id not in (select native_id from two) group by 1),
linked as (select q.*, coalesce(o.source_id, w.source_id, h.source_id) as source_id, coalesce(o.source_file, w.source_file, h.source_file) as source_file,
  coalesce(o.project_path, w.project_path, h.project_path) as project_path,
  cast(case when o.native_id is not null then 1 when w.native_id is not null then 2 when h.native_id is not null then 3 end as int) as tier,
  case when o.native_id is not null then 'exact' when w.native_id is not null then 'high' when h.native_id is not null then 'medium' end as confidence
  from req q left join one o using (native_id) left join two w using (native_id) left join three h using (native_id))
"""


@query(_LINKS + "select * from one")
def tier1_link(spark, d):
    rec = _rec(spark, d)
    return sessions.tier1(V.requests(rec), rec, sessions.group_sessions(rec))


@query(_LINKS + "select native_id, source_id, source_file, project_path from cand2")
def tier2_candidates(spark, d):
    rec = _rec(spark, d)
    return sessions.tier2_candidates(V.requests(rec), sessions.group_sessions(rec)).select("native_id", "source_id", "source_file", "project_path")


@query(_LINKS + f"select native_id, {_PICK} from clear2 group by 1")
def tier2_unambiguous(spark, d):
    rec = _rec(spark, d)
    return sessions.tier2(V.requests(rec), sessions.group_sessions(rec))


@query(_LINKS + f"select native_id, {_PICK} from cand3 where native_id in (select native_id from cand3 group by 1 having count(distinct project_path) = 1) group by 1")
def tier3_link(spark, d):
    rec = _rec(spark, d)
    return sessions.tier3(V.requests(rec), rec, sessions.group_sessions(rec))


@query(_LINKS + "select native_id, ms, model, source_id, source_file, project_path, tier, confidence from linked")
def link_first_tier(spark, d):
    return _linked(spark, d).select("native_id", "ms", "model", "source_id", "source_file", "project_path", "tier", "confidence")


@query(_LINKS + "select native_id, ms, model from linked where tier is null")
def unlinked_requests(spark, d):
    return _linked(spark, d).where("tier is null").select("native_id", "ms", "model")


@query(_LINKS + "select case when project is null and tier is null then 3 when project is null then 2 else 1 end as level, project, tier, requests, cost_usd from (select coalesce(project_path, '(unattributed)') as project, coalesce(tier, 0) as tier, count(*) as requests, round(sum(cost), 4) as cost_usd from linked group by grouping sets ((1), (2), ()))")
def cost_rollup(spark, d):
    return rollups.cost_rollup(_linked(spark, d)).withColumn("level", F.col("level").cast("int"))


@query(_LINKS + "select project_path, count(*) as requests, count(distinct source_id || '|' || source_file) as sessions, round(sum(cost), 4) as cost_usd, count(*) filter (where tier = 1) as exact, count(*) filter (where tier = 2) as high, count(*) filter (where tier = 3) as medium from linked where tier is not null group by 1")
def cost_per_project(spark, d):
    rows = _linked(spark, d).where("tier is not null")
    tier = lambda k, name: F.count_if(F.col("tier") == k).alias(name)
    return rows.groupBy("project_path").agg(F.count("*").alias("requests"), F.count_distinct(F.concat_ws("|", "source_id", "source_file")).alias("sessions"), F.round(F.sum("cost"), 4).alias("cost_usd"), tier(1, "exact"), tier(2, "high"), tier(3, "medium"))


@query("""select model, round(sum(cost), 4) as total, round(median(cost), 4) as p50, round(case when count(*) >= 10 then
  v[k] + (0.9 * (count(*) + 1) - k) * (v[k + 1] - v[k]) else max(cost) end, 4) as p90
  from (select model, cost, list_sort(list(cost) over (partition by model)) as v, cast(greatest(least(floor(0.9 * (count(*) over (partition by model) + 1)), count(*) over (partition by model) - 1), 1) as bigint) as k from req) group by model, v, k""")
def cost_deciles(spark, d):
    found = rollups.exclusive_deciles(V.requests(_rec(spark, d)), "model", "cost")
    return found.select("model", F.round("total", 4).alias("total"), F.round("p50", 4).alias("p50"), F.round("quantile", 4).alias("p90"))


@query(f"select round(coalesce(sum(cost) filter (where ms >= {NOW} - 5 * {DAY}::bigint), 0), 4) as daily, round(coalesce(sum(cost) filter (where ms >= {NOW} - 30 * {DAY}::bigint), 0), 4) as monthly, max(case when cost > 0 then cost end) as largest from req")
def spend_trailing(spark, d):
    since = lambda days: F.round(F.coalesce(F.sum(F.when(F.col("ms") >= NOW - days * DAY, F.col("cost"))), F.lit(0.0)), 4)
    return V.requests(_rec(spark, d)).agg(since(5).alias("daily"), since(30).alias("monthly"), F.max(F.when(F.col("cost") > 0, F.col("cost"))).alias("largest"))


_GATE = """, raw as (select model, native_id, round(300 - coalesce(sum(cost) over w, 0), 4) as left_usd, max(case when cost > 0 then cost end) over w as biggest from req window w as (partition by model order by native_id rows between unbounded preceding and 1 preceding)),
judged as (select *, case when left_usd < biggest then 'cap_insufficient_remaining' when left_usd <= 0 then 'cap_reached' end as refusal from raw),
firsts as (select model, min(native_id) as stop_id, arg_min(left_usd, native_id) as first_left, arg_min(refusal, native_id) as first_refusal from judged where refusal is not null group by 1)
"""


@query(_GATE + "select model, native_id, case when native_id >= stop_id then first_left else left_usd end as remaining, case when native_id >= stop_id then first_refusal else 'admitted' end as reason from judged left join firsts using (model)")
def spend_gate(spark, d):
    return rollups.spend_gate(V.requests(_rec(spark, d)), "model", "native_id", "cost", 300.0)


@query("select model, round(sum(cost), 4) as cost_usd, max(case when cost > 0 then cost end) as largest, count(*) as calls from req group by 1")
def agent_run_cost(spark, d):
    return V.requests(_rec(spark, d)).groupBy("model").agg(F.round(F.sum("cost"), 4).alias("cost_usd"), F.max(F.when(F.col("cost") > 0, F.col("cost"))).alias("largest"), F.count("*").alias("calls"))


@query("select r.source_id, r.source_file, count(*) as turns, max(s.project_path) as project_path from rec r join ses s using (source_id, source_file) where r.record_type = 'message' group by 1, 2")
def turn_to_session(spark, d):
    rec = _rec(spark, d)
    joined = rec.where("record_type = 'message'").drop("project_path", "model").join(sessions.group_sessions(rec), ["source_id", "source_file"])
    return joined.groupBy("source_id", "source_file").agg(F.count("*").alias("turns"), F.max("project_path").alias("project_path"))


@query("select (select count(*) from lineitem where l_orderkey not in (select o_orderkey from orders)) as lines_without_order, (select count(*) from orders where o_custkey not in (select c_custkey from customer)) as orders_without_customer")
def orphan_audit(spark, d):
    lines = V.load(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey")).join(V.load(spark, d, "orders"), "o_orderkey", "left_anti")
    owners = V.load(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey")).join(V.load(spark, d, "customer"), "c_custkey", "left_anti")
    return lines.agg(F.count("*").alias("lines_without_order")).crossJoin(owners.agg(F.count("*").alias("orders_without_customer")))


# Findings and their lifecycle -----------------------------------------------------------------------------------------

_STATES = """,
pv as (select run, project, max(run) over (partition by project order by run range between unbounded preceding and 1 preceding) as prev from ap),
cur as (select o.run, o.project, o.finding, o.resolved, pv.prev, b.resolved as pr, exists (select 1 from obs e where e.finding = o.finding and e.project = o.project and e.run < o.run) as earlier
  from obs o join pv using (run, project) left join obs b on b.run = pv.prev and b.finding = o.finding),
state as (select run, project, finding, case when prev is null then (case when resolved then 'resolved' else 'new' end)
  when resolved then (case when coalesce(pr, false) or (pr is null and earlier) then 'dismissed' else 'resolved' end)
  when coalesce(pr, false) or (pr is null and earlier) then 'regressed' when pr is not null then 'persisting' else 'new' end as state from cur
  union all select pv.run, pv.project, b.finding, 'resolved' from pv join obs b on b.run = pv.prev and b.project = pv.project
  where not exists (select 1 from obs c where c.run = pv.run and c.finding = b.finding))
"""


def _states(spark, d):
    return lifecycle.states(*V.ledger(spark, d))


@query(_STATES + "select * from state")
def finding_state(spark, d):
    return _states(spark, d)


@query(_STATES + "select state, count(*) as findings from state group by 1")
def finding_diff_counts(spark, d):
    return _states(spark, d).groupBy("state").agg(F.count("*").alias("findings"))


@query(_STATES + ", latest as (select * from state where run = (select max(run) from ap)) select f.finding, f.project, f.category, f.severity, case when f.dismissed then 'dismissed' else coalesce(l.state, 'new') end as state from fin f left join latest l using (finding)")
def findings_view(spark, d):
    found = _states(spark, d)
    latest = found.join(found.agg(F.max("run").alias("run")), "run").select("finding", "state")
    shown = F.when(F.col("dismissed"), "dismissed").otherwise(F.coalesce("state", F.lit("new")))
    return V.findings(spark, d).join(latest, "finding", "left").select("finding", "project", "category", "severity", shown.alias("state"))


@query(_STATES + """, steps as (select *, lead(state) over (partition by finding order by run) as nxt from state),
per as (select finding, count(*) as events, count(*) filter (where state = 'resolved') as res, count(*) filter (where state = 'resolved' and nxt = 'regressed') as reg, arg_max(state, run) as last, min(run) filter (where state = 'resolved') - min(run) as ttr from steps group by 1)
select category, cast(sum(events) as bigint) as events, round(sum(reg) / nullif(sum(res), 0), 4) as regression_rate, count(*) filter (where last in ('new', 'persisting', 'regressed')) as open_count, median(ttr) as ttr_median from per join fin using (finding) group by 1""")
def finding_metrics(spark, d):
    return lifecycle.metrics(_states(spark, d), V.findings(spark, d), "category")


@query("select finding, min(run) as first_run from obs group by 1")
def first_observed(spark, d):
    return V.ledger(spark, d)[1].groupBy("finding").agg(F.min("run").alias("first_run"))


@query("select project, round(quantile_cont(age, 0.5), 4) as p50, round(quantile_cont(age, 0.9), 4) as p90 from (select project, finding, max(run) - min(run) as age from obs group by 1, 2) group by 1")
def percentile_age(spark, d):
    ages = V.ledger(spark, d)[1].groupBy("project", "finding").agg((F.max("run") - F.min("run")).alias("age"))
    return ages.groupBy("project").agg(F.round(F.percentile("age", F.lit(0.5)), 4).alias("p50"), F.round(F.percentile("age", F.lit(0.9)), 4).alias("p90"))


@query("select run, project, max(run) over (partition by project order by run range between unbounded preceding and 1 preceding) as prev from ap")
def predecessor_run(spark, d):
    return lifecycle.predecessors(V.ledger(spark, d)[0])


@query("select distinct o.run, o.finding from obs o where exists (select 1 from obs e where e.finding = o.finding and e.project = o.project and e.run < o.run)")
def regressed_semi(spark, d):
    observed = V.ledger(spark, d)[1]
    first = observed.groupBy("finding", "project").agg(F.min("run").alias("first_run"))
    return observed.join(first, ["finding", "project"]).where("first_run < run").select("run", "finding").distinct()


@query("select pv.run, b.finding from (select run, project, max(run) over (partition by project order by run range between unbounded preceding and 1 preceding) as prev from ap) pv join obs b on b.run = pv.prev and b.project = pv.project where not exists (select 1 from obs c where c.run = pv.run and c.finding = b.finding)")
def resolved_anti(spark, d):
    analysed, observed = V.ledger(spark, d)
    before = observed.select(F.col("run").alias("prev"), "project", "finding")
    return lifecycle.predecessors(analysed).join(before, ["prev", "project"]).join(observed, ["run", "finding"], "left_anti").select("run", "finding")


@query("select category, round(avg(case when dismissed then 1.0 else 0 end), 4) as dismissal_rate, count(*) as findings from fin group by 1")
def dismissal_rate(spark, d):
    return V.findings(spark, d).groupBy("category").agg(F.round(F.count_if("dismissed") / F.count("*"), 4).alias("dismissal_rate"), F.count("*").alias("findings"))


@query("select finding from fin where finding not in (select finding from obs)")
def not_observed(spark, d):
    return V.findings(spark, d).select("finding").join(V.ledger(spark, d)[1], "finding", "left_anti")


@query("select e.user_id, e.ms, (select arg_max(f.native_id, f.ms) from rec f where f.user_id = e.user_id and f.record_type = 'session_start' and f.ms < e.ms) as native_id from rec e where e.record_type = 'error'")
def asof_snapshot(spark, d):
    rec = _rec(spark, d)
    return lifecycle.asof(rec.where("record_type = 'error'"), rec.where("record_type = 'session_start'"), "user_id", "ms", "native_id")


# Time series ----------------------------------------------------------------------------------------------------------


@query("select source_id, ms - lag(ms) over (partition by source_id order by ms, native_id) as gap, native_id from rec")
def gap_lag(spark, d):
    return rollups.gaps(_rec(spark, d).select("source_id", "ms", "native_id"), "source_id", "ms", "native_id").select("source_id", "gap", "native_id")


@query("select source_id, ms from (select source_id, ms, row_number() over (partition by source_id order by ms desc) as k from (select distinct source_id, ms from rec)) where k <= 200")
def newest_n(spark, d):
    w = Window.partitionBy("source_id").orderBy(F.desc("ms"))
    return _rec(spark, d).select("source_id", "ms").distinct().withColumn("k", F.row_number().over(w)).where("k <= 200").select("source_id", "ms")


_CADENCE = """, top as (select source_id, ms, row_number() over (partition by source_id order by ms desc) as k from (select distinct source_id, ms from rec)),
gaps as (select source_id, ms, ms - lag(ms) over (partition by source_id order by ms) as gap from top where k <= 200),
cad as (select source_id, case when count(*) >= 20 and trunc(median(gap)) > 0 then cast(trunc(median(gap)) as bigint) end as median_gap_ms, count(*) as sample_size, max(ms) as watermark_ms from gaps group by 1)
"""


@query(_CADENCE + "select * from cad")
def cadence_median(spark, d):
    return rollups.cadence(_rec(spark, d))


@query(_CADENCE + f"select *, case when median_gap_ms is null then 'insufficient data' when {NOW} - watermark_ms > 8 * median_gap_ms then 'stale' else 'ok' end as cadence from cad")
def cadence_status(spark, d):
    return rollups.cadence_status(rollups.cadence(_rec(spark, d)), NOW)


@query(_CADENCE + ", n as (select source_id, count(*) as sessions from ses group by 1) select source_id, sessions, sample_size, watermark_ms from n full join cad using (source_id)")
def source_stats(spark, d):
    counts = _ses(spark, d).groupBy("source_id").agg(F.count("*").alias("sessions"))
    return counts.join(rollups.cadence(_rec(spark, d)), "source_id", "full_outer").select("source_id", "sessions", "sample_size", "watermark_ms")


@query("select ms from rec where record_type = 'message' union select ms from req")
def union_distinct_ts(spark, d):
    rec = _rec(spark, d)
    return rec.where("record_type = 'message'").select("ms").union(V.requests(rec).select("ms")).distinct()


# Text -----------------------------------------------------------------------------------------------------------------


@query("select doc_id, lower(trim(regexp_replace(text, '[\\s\\p{Z}]+', ' ', 'g'))) as fingerprint from documents")
def fingerprint(spark, d):
    return V.load(spark, d, "documents").select("doc_id", T.fingerprint(F.col("text")).alias("fingerprint"))


@query(f"select doc_id, {redact_sql('t')} as redacted from (select doc_id, text || ' ' || {V.picked_sql(V.PLANTS, 'doc_id')} as t from documents)")
def redact_text(spark, d):
    return V.planted(V.load(spark, d, "documents")).select("doc_id", T.redact(F.col("text")).alias("redacted"))


@query("select doc_id, substr(sha256('session|' || source || '|' || doc_id), 1, 16) as id, substr(sha256(source), 1, 12) as slug from documents")
def stable_ids(spark, d):
    return V.load(spark, d, "documents").select("doc_id", T.stable_id(F.lit("session"), F.col("source"), F.col("doc_id")).alias("id"), T.stable_id(F.col("source"), length=12).alias("slug"))


_LONG = "(select doc_id, case when doc_id % 3 = 0 then left(text, 150) || ' see /var/some/' || repeat('path', doc_id % 20) || ' and ' || substr(text, 150) else text end as t from documents)"


@query(f"""select doc_id, case when length(t) <= 200 then t else rtrim(case when not regexp_matches(substr(t, 201, 1), '[\\s\\p{{Z}}]') and contains(list_last(string_split(left(t, 200), ' ')), '/')
  then left(t, 200 - length(list_last(string_split(left(t, 200), ' ')))) else left(t, 200) end, chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ' ' || chr(160)) || '…' end as clipped from {_LONG}""")
def clip_text(spark, d):
    text = F.when(F.col("doc_id") % 3 == 0, F.concat(F.substring("text", 1, 150), F.lit(" see /var/some/"), F.expr("repeat('path', cast(doc_id % 20 as int))"), F.lit(" and "), F.expr("substr(text, 150)"))).otherwise(F.col("text"))
    return V.load(spark, d, "documents").select("doc_id", T.clip(text, 200).alias("clipped"))


@query("select event_id, ms_text, coalesce(epoch_ms(try_cast(ms_text as timestamp)), 0) as back from (select event_id, case when event_id % 7 = 0 then 'nope' else strftime(ts, '%Y-%m-%dT%H:%M:%S') || 'Z' end as ms_text from events)")
def iso_to_ms(spark, d):
    text = F.when(F.col("event_id") % 7 == 0, "nope").otherwise(F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("Z")))
    return V.load(spark, d, "events").select("event_id", text.alias("ms_text")).withColumn("back", T.iso_to_ms(F.col("ms_text")))


@query("select event_id, cast(user_id as varchar) || ',' || event_id as ids from events")
def id_shaped_values(spark, d):
    made = F.to_json(F.create_map(F.lit("event_id"), F.col("event_id"), F.lit("Author-Id"), F.col("user_id"), F.lit("kind"), F.lit(1)))
    return V.load(spark, d, "events").select("event_id", F.array_join(T.id_values(made), ",").alias("ids"))


@query("""select event_id, substr(sha256('{"a":' || event_id || ',"b":{"c":"x","d":' || user_id || '}}'), 1, 16) as digest from events""")
def evidence_digest(spark, d):
    """Digests of JSON whose keys stand in another order."""
    made = F.concat(F.lit('{"b": {"d": '), "user_id", F.lit(', "c":"x"},  "a": '), "event_id", F.lit("}"))
    return V.load(spark, d, "events").select("event_id", T.evidence_digest(made).alias("digest"))


@query("""select item_id, regexp_extract('note <!-- stamp:v1:' || substr(sha256(text), 1, 12) || ' -->', 'stamp:v([0-9]+):([0-9a-f]{6,})', 2) as marker from benchmark""")
def marker_extract(spark, d):
    note = F.concat(F.lit("note <!-- stamp:v1:"), F.substring(F.sha2("text", 256), 1, 12), F.lit(" -->"))
    return V.load(spark, d, "benchmark").select("item_id", F.get(F.regexp_extract_all(note, F.lit(r"stamp:v(\d+):([0-9a-f]{6,})"), F.lit(2)), F.lit(0)).alias("marker"))


@query("select count(*) filter (where contains(text, 'token = ')) as documents_hit, (select count(*) from conversations where contains(text, 'token = ')) as turns_hit from documents")
def secret_scan(spark, d):
    hit = lambda name, alias: V.load(spark, d, name).agg(F.count_if(F.col("text").contains("token = ")).alias(alias))
    return hit("documents", "documents_hit").crossJoin(hit("conversations", "turns_hit"))


@query("select distinct project_path from rec where (project_path = '/p/1' or starts_with(project_path, '/p/1/') or project_path = '/p/3' or starts_with(project_path, '/p/3/')) and not (project_path = '/p/3' or starts_with(project_path, '/p/3/'))")
def prefix_filter(spark, d):
    path = F.col("project_path")
    return _rec(spark, d).where(T.under_prefix(path, ["/p/1", "/p/3"]) & ~T.under_prefix(path, ["/p/3"])).select("project_path").distinct()


# Analysis -------------------------------------------------------------------------------------------------------------


@query("select session_id, row_number() over (partition by session_id order by idx) - 1 as place, lower(trim(role)) as role, text from turn where trim(text) <> ''")
def turn_normalise(spark, d):
    w = Window.partitionBy("session_id").orderBy("idx")
    return V.turns(spark, d).where(F.trim("text") != "").select("session_id", (F.row_number().over(w) - 1).cast("long").alias("place"), F.lower(F.trim("role")).alias("role"), "text")


@query("select session_id, min(idx) as intent_idx, arg_min(text, idx) as intent from turn where role = 'user' and length(text) > 40 group by 1")
def original_intent(spark, d):
    return analysis.original_intent(V.turns(spark, d))


@query(f", i as (select session_id, min(idx) as intent_idx from turn where role = 'user' and length(text) > 40 group by 1) select session_id, min(idx) as pivot_idx from turn join i using (session_id) where role = 'user' and idx > intent_idx and {_word(T.PIVOT)} group by 1")
def pivot_point(spark, d):
    return analysis.pivot_point(V.turns(spark, d))


_SIGNALS = f""", sig as (select session_id, count(*) as turns, count(*) filter (where role = 'assistant' and {_word(T.DONE)}) as claims, count(*) filter (where record_type = 'error' or {_word(T.ERRORS)}) as errors,
count(*) filter (where {_word(T.PENDING)}) as pending, count(*) filter (where {_word(T.TODO)}) as todo from turn group by 1),
done as (select sig.*, coalesce(commits, 0) as commits, case when ended_ms > 0 then ({NOW} - ended_ms) / 86400000.0 end as idle from sig left join git using (session_id)),
told as (select *, case when claims > 0 and commits > 0 then 'unverified' when errors > 0 then 'in_progress' when claims = 0 and idle > 7 then 'abandoned' else 'in_progress' end as completion_status from done)
"""


def _signals(spark, d):
    return analysis.signals(V.turns(spark, d))


@query(_SIGNALS + "select session_id, completion_status, claims > 0 as completion_claim, commits, errors, round(idle, 6) as days_since_last_activity from told")
def completion_status(spark, d):
    return analysis.completion(_signals(spark, d), V.git(spark, d), NOW).select("session_id", "completion_status", "completion_claim", "commits", "errors", "days_since_last_activity")


@query(_SIGNALS + f""", i as (select session_id, min(idx) as intent_idx, arg_min(text, idx) as intent from turn where role = 'user' and length(text) > 40 group by 1),
p as (select session_id, min(idx) as pivot_idx from turn left join i using (session_id) where role = 'user' and (intent_idx is null or idx > intent_idx) and {_word(T.PIVOT)} group by 1),
s as (select session_id, least(count(*), 10) as seeds from (select distinct session_id, text from turn where (role = 'user' and {_word(T.PENDING)}) or {_word(T.TODO)}) group by 1)
select session_id, coalesce(intent, '(unknown intent)') as original_intent, completion_status, case when pivot_idx is not null then 'mid_session_pivot' end as drift_type, pivot_idx,
concat_ws(',', case when pending > 0 then 'incomplete_work:medium' end, case when todo > 0 then 'tech_debt:low' end, case when errors >= 3 then 'error_burst:high' end) as findings, coalesce(seeds, 0) as seeds
from told left join i using (session_id) left join p using (session_id) left join s using (session_id)""")
def analyze_sessions(spark, d):
    return analysis.analyse(V.turns(spark, d), V.git(spark, d), NOW)


@query(_SIGNALS + "select session_id, errors from sig where errors >= 3")
def error_burst(spark, d):
    return _signals(spark, d).where(F.col("errors") >= analysis.ERROR_BURST).select("session_id", "errors")


@query(_SIGNALS + "select session_id, 'incomplete_work' as category, 'medium' as severity, pending as turns from sig where pending > 0 union all select session_id, 'tech_debt', 'low', todo from sig where todo > 0")
def pending_and_todo(spark, d):
    s = _signals(spark, d)
    pick = lambda c, category, severity: s.where(F.col(c) > 0).select("session_id", F.lit(category).alias("category"), F.lit(severity).alias("severity"), F.col(c).alias("turns"))
    return pick("pending", "incomplete_work", "medium").union(pick("todo", "tech_debt", "low"))


@query(f"""select session_id, place, text from (select session_id, text, row_number() over (partition by session_id order by kind, idx) as place from (
select session_id, text, kind, idx, row_number() over (partition by session_id, text order by kind, idx) as k from (select session_id, text, idx, case when role = 'user' and {_word(T.PENDING)} then 0 when {_word(T.TODO)} then 1 end as kind from turn) where kind is not null) where k = 1) where place <= 10""")
def next_task_seeds(spark, d):
    return analysis.seeds(V.turns(spark, d)).withColumn("place", F.col("place").cast("long"))


@query(f"select session_id, place, idx, role, substr(text, 1, 280) as excerpt from (select *, row_number() over (partition by session_id order by idx) as place from turn where {_word(T.ERRORS)}) where place <= 5")
def citations_top5(spark, d):
    return analysis.citations(V.turns(spark, d)).withColumn("place", F.col("place").cast("long"))


@query("""select project, place, title, score from (select project, title, score, row_number() over (partition by project order by score desc, title) as place from (
select project, title, case severity when 'high' then 3 when 'medium' then 2 else 1 end * 2 + least(finding % 9, 5) as score from fin where not dismissed)) where place <= 10""")
def next_task_rank(spark, d):
    tasks = V.findings(spark, d).where("not dismissed").withColumn("surface", F.col("finding") % 9)
    return analysis.rank_tasks(tasks, "project", 10).select("project", F.col("place").cast("long").alias("place"), "title", "score")


@query("""select source, code, docs, case when code >= 10 then 'high' when code >= 3 then 'medium' else 'low' end as severity from (select source, count(*) filter (where doc_id % 53 <> 0) as code, count(*) filter (where doc_id % 53 = 0) as docs from documents group by 1) where code > 0 and docs = 0""")
def docs_drift(spark, d):
    path = F.when(F.col("doc_id") % 53 == 0, F.concat(F.lit("docs/"), "doc_id")).otherwise(F.concat(F.lit("src/"), "doc_id"))
    return analysis.docs_drift(V.load(spark, d, "documents").select("source", path.alias("path")), "source")


_MARKED = """, art as (select item_id % 4 as kind, item_id % 9 as project, substr(sha256(text), 1, 12) as marker from benchmark),
ranked as (select marker, arg_max(kind, kind * 100 + project) as kind, arg_max(project, kind * 100 + project) as project from art group by 1),
items as (select substr(sha256(text), 1, 12) as marker, item_id from benchmark),
uses as (select distinct role as source_id, marker from conversations join items on item_id = conv_id % 60 where turn % 3 = 0),
done as (select distinct c_nationkey as project from customer where c_acctbal > 9500),
met as (select r.marker, r.kind, done.project is not null as complete, r.marker in (select marker from uses) as seen from ranked r left join done using (project)),
per as (select kind, count(*) as total, count(*) filter (where seen) as observed, count(*) filter (where not seen) as not_observed, count(*) filter (where seen and complete) as completed_after_use, count(*) filter (where seen and not complete) as unresolved_after_use from met group by 1),
h as (select kind, string_agg(source_id || ':' || n, ',' order by source_id || ':' || n) as harnesses from (select kind, source_id, count(*) as n from uses join ranked using (marker) group by 1, 2) group by 1)
"""


@query(_MARKED + "select per.*, coalesce(harnesses, '') as harnesses, round(observed / nullif(total, 0), 4) as observation_rate from per left join h using (kind)")
def efficacy(spark, d):
    items = V.load(spark, d, "benchmark").withColumn("stamp", F.concat(F.lit("<!-- made-prompt:v1:"), F.substring(F.sha2("text", 256), 1, 12), F.lit(" -->")))
    artifacts = items.select((F.col("item_id") % 4).alias("kind"), (F.col("item_id") % 9).alias("project"), F.concat_ws(" ", "text", "stamp").alias("content"))
    pasted = V.load(spark, d, "conversations").withColumn("item_id", F.when(F.col("turn") % 3 == 0, F.col("conv_id") % 60)).join(items.select("item_id", "stamp"), "item_id", "left")
    turns = pasted.select(F.col("role").alias("source_id"), F.concat_ws(" ", "text", "stamp").alias("text"))
    completed = V.load(spark, d, "customer").where("c_acctbal > 9500").select(F.col("c_nationkey").cast("long").alias("project"))
    return rollups.efficacy(artifacts, turns, completed)


# Projects, runs, neighbours --------------------------------------------------------------------------------------------


@query("select n_nationkey, n_name, (select count(*) from customer where c_nationkey = n_nationkey) as sessions from nation")
def project_list(spark, d):
    counts = V.load(spark, d, "customer").groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.count("*").alias("sessions"))
    return V.load(spark, d, "nation").join(counts, "n_nationkey", "left").select("n_nationkey", "n_name", F.coalesce("sessions", F.lit(0)).alias("sessions"))


@query("select run, count(distinct project) as projects, count(*) as observations from obs group by 1 order by run desc limit 20")
def runs_history(spark, d):
    return V.ledger(spark, d)[1].groupBy("run").agg(F.count_distinct("project").alias("projects"), F.count("*").alias("observations")).orderBy(F.desc("run")).limit(20)


_ANCHOR = "(select * from ses where project_path <> '' order by started_ms, source_id, source_file limit 1)"


@query(f"select s.source_id, s.source_file, s.started_ms from ses s, {_ANCHOR} a where s.started_ms between a.started_ms - {DAY} and a.started_ms + {DAY} and s.project_path <> a.project_path and s.project_path <> ''")
def neighbours_same_time(spark, d):
    named = _ses(spark, d).where("project_path <> ''")
    anchor = named.orderBy("started_ms", "source_id", "source_file").limit(1).select(F.col("started_ms").alias("at"), F.col("project_path").alias("own"))
    near = F.col("started_ms").between(F.col("at") - DAY, F.col("at") + DAY) & (F.col("project_path") != F.col("own"))
    return named.join(F.broadcast(anchor), near).select("source_id", "source_file", "started_ms")


@query(", i as (select session_id, arg_min(text, idx) as t from turn where role = 'user' group by 1), c as (select * from i order by session_id desc limit 200), a as (select * from i order by session_id limit 1) select c.session_id from c, a where c.session_id <> a.session_id and (contains(lower(c.t), lower(a.t)) or contains(lower(a.t), lower(c.t))) order by 1 desc limit 10")
def neighbours_same_intent(spark, d):
    intents = V.turns(spark, d).where("role = 'user'").groupBy("session_id").agg(F.lower(F.min_by("text", "idx")).alias("t"))
    anchor = intents.orderBy("session_id").limit(1).select(F.col("session_id").alias("own"), F.col("t").alias("own_t"))
    newest = intents.orderBy(F.desc("session_id")).limit(200)
    alike = (F.col("session_id") != F.col("own")) & (F.col("t").contains(F.col("own_t")) | F.col("own_t").contains(F.col("t")))
    return newest.join(F.broadcast(anchor), alike).select("session_id").orderBy(F.desc("session_id")).limit(10)


@query("select count(*) as stored, count(*) as after_replay from (select distinct native_id from rec)")
def upsert_replay(spark, d):
    rows = _rec(spark, d).select("native_id", "ms", "source_id")
    stored = state.append_new(rows.limit(0), rows, "native_id", "ms")
    again = stored.union(state.append_new(stored, rows, "native_id", "ms"))
    return stored.agg(F.count("*").alias("stored")).crossJoin(again.agg(F.count("*").alias("after_replay")))


from . import artifact_queries, audit_queries, brief_queries, bundle_queries, connector_queries, cost_queries, doctor_queries, finding_queries, source_queries, store_queries, stream_queries, text_queries  # noqa: E402, F401  registers more queries
