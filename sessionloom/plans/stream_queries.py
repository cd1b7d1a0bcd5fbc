"""Queries over state that grows batch by batch: folded sessions, appended tables, cadence as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.plan import fresh_folder
from ..operators import session_state
from ..operators.delta import DeltaTable
from ..sources import views as V
from ..streaming import cadence
from .registry import query


def arrivals(spark, d) -> DataFrame:
    """Events as records with branch, raw meta and place of arrival."""
    rec = V.records(spark, d)
    own = F.concat(F.lit("n"), "native_id")
    named = F.when((F.col("source_id") == "opencode") & (F.col("native_id") % 3 == 0), F.concat(F.lit(', "sessionId": "s'), F.col("user_id") % 20, F.lit('"'))).otherwise("")
    meta = F.concat(F.lit('{"requestId": "r'), F.col("native_id") % 97, F.lit('", "n": 5, "z": {"user_id": "u'), "user_id", F.lit('", "name": "x"}'), named, F.lit("}"))
    branch = F.when(F.col("native_id") % 7 == 0, F.concat(F.lit("b"), F.col("user_id") % 3)).otherwise("")
    order = F.array_position(F.array(*map(F.lit, V.SOURCES)), F.col("source_id")).cast("int") - 1
    return rec.select(
        "source_id", own.alias("native_id"), F.col("ms").alias("timestamp_ms"), "record_type", "role", "project_path", branch.alias("git_branch"), "model", F.col("excerpt").alias("content_excerpt"),
        meta.alias("raw_meta"), "source_file", F.col("native_id").alias("line"), order.alias("source_order"),
    )


_AT = "{'a': list_position(['omp','pi','claude','codex','opencode'], source_id), 'b': source_file, 'c': native_id}"
_ARRIVALS = f""", arr as (select *, 'n' || native_id as own, case when native_id % 7 = 0 then 'b' || (user_id % 3) else '' end as git_branch,
  case when source_id <> 'opencode' then source_file when record_type = 'session_start' then 'n' || native_id when native_id % 3 = 0 then 's' || (user_id % 20) else '__ungrouped__n' || native_id end as group_key
  from rec where record_type <> 'router_request'),
heads as (select source_id, group_key, coalesce(arg_min(own, {{'m': ms, 'at': {_AT}}}) filter (where record_type = 'session_start'), group_key) as native_id, min(ms) as started_ms, max(ms) as ended_ms,
  count(*) filter (where record_type = 'message') as turn_count, coalesce(arg_min(project_path, {_AT}) filter (where project_path <> ''), '') as project_path, coalesce(arg_min(model, {_AT}) filter (where model <> ''), '') as model,
  coalesce(arg_min(git_branch, {_AT}) filter (where git_branch <> ''), '') as git_branch, coalesce(arg_min(source_file, {_AT}) filter (where source_file <> ''), '') as raw_path from arr group by 1, 2)
"""


@query(_ARRIVALS + "select * from heads")
def session_state_whole(spark, d):
    """AGG-01, WIN-10: sessions with branch, first filled values in order of arrival and the id of the earliest start."""
    return session_state.sessions(session_state.heads(arrivals(spark, d)))


@query(_ARRIVALS + "select * from heads")
def session_state_folded(spark, d):
    """AGG-01: the same from three batches that cut sessions apart, the later records first; one batch comes twice."""
    rec, store = arrivals(spark, d), session_state.SessionStore(spark, fresh_folder(spark, "sessions"))
    for number, some in enumerate(("line % 3 = 2", "line % 3 = 0", "line % 3 = 1")):
        store.fold(rec.where(some), "halves", number)
    store.fold(rec.where("line % 3 = 1"), "halves", 2)
    store.heads.compact()
    return store.read()


@query(_ARRIVALS + """select source_id, group_key, 'native' as kind, own as value from arr union select source_id, group_key, 'raw', 'r' || (native_id % 97) from arr union select source_id, group_key, 'raw', 'u' || user_id from arr
union select source_id, group_key, 'raw', 's' || (user_id % 20) from arr where source_id = 'opencode' and native_id % 3 = 0 union select source_id, group_key, 'print', lower(trim(regexp_replace(excerpt, '[\\s\\p{Z}]+', ' ', 'g'))) from arr where excerpt <> ''""")
def session_members(spark, d):
    """AGG-01: ids and fingerprints of sessions as distinct rows, folded from two batches."""
    rec, store = arrivals(spark, d), session_state.SessionStore(spark, fresh_folder(spark, "sessions"))
    for number, some in enumerate(("line % 2 = 0", "line % 2 = 1")):
        store.fold(rec.where(some), "halves", number)
    return store.members.read()


@query("select o_custkey as id, count(*) as orders, max(o_orderkey) as last_order from orders group by 1")
def delta_merge(spark, d):
    """SNK-03, STM-01: counts of orders appended in five batches, compacted on the way, merged on read."""
    merge = lambda rows: rows.groupBy("id").agg(F.sum("orders").alias("orders"), F.max("last_order").alias("last_order"))
    table = DeltaTable(spark, fresh_folder(spark, "orders"), "id bigint, orders bigint, last_order bigint", merge, ranged="id")
    for k in range(5):
        own = V.load(spark, d, "orders").where(F.col("o_orderkey") % 5 == k)
        table.append(own.groupBy(F.col("o_custkey").alias("id")).agg(F.count("*").alias("orders"), F.max("o_orderkey").alias("last_order")), "batches", k)
        if k == 2:
            table.compact()
    return table.read()


_STREAM_SQL = """, kept as (select source_id, ms, row_number() over (partition by source_id order by ms desc) as r from (select distinct source_id, ms from rec)), gaps as (select source_id, ms, ms - lag(ms) over (partition by source_id order by ms) as gap from kept where r <= 200),
told as (select source_id, case when count(*) >= 20 and trunc(median(gap)) > 0 then trunc(median(gap))::bigint end as median_gap_ms, count(*) as sample_size, max(ms) as watermark_ms from gaps group by 1)
select *, case when median_gap_ms is null then 'insufficient data' else 'stale' end as cadence from told"""


@query(_STREAM_SQL)
def cadence_stream(spark, d):
    """STM-04, STM-05: cadence held as state by a stream over four files of events, two of them read after a restart."""
    own, place = cadence.session(spark), fresh_folder(spark, "cadence")
    rec = V.records(spark, d).select("source_id", "ms")
    table = cadence.cadence_table(own, f"{place}/table")
    for k in range(2):
        for part in (2 * k, 2 * k + 1):
            rec.where(F.pmod(F.xxhash64("ms"), F.lit(4)) == part).write.mode("append").parquet(f"{place}/stamps")
        stream = own.readStream.schema("source_id string, ms bigint").option("maxFilesPerTrigger", 8).parquet(f"{place}/stamps")
        cadence.run(stream, table, f"{place}/checkpoint").awaitTermination()
    return cadence.cadence_table(spark, table.path).read().drop("batch")
