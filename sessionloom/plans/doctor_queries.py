"""The diagnosis over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import doctor, session_state
from ..sources import views as V
from .audit_queries import _CITED
from .registry import query, redact_sql
from .stream_queries import arrivals

_REFS = f"text || ' ' || {V.picked_sql([c[0] for c in _CITED], 'doc_id')} || ' ' || {V.picked_sql(V.PLANTS, 'doc_id')}"
_SCRATCH = "/home/me/work"


def _subjects(spark, d) -> list[doctor.Subject]:
    docs = V.load(spark, d, "documents")
    made = docs.select("doc_id", F.concat_ws(" ", F.coalesce("text", F.lit("")), V.picked([c[0] for c in _CITED], F.col("doc_id")), V.picked(V.PLANTS, F.col("doc_id"))).alias("content"))
    pages = V.load(spark, d, "pages").select("page_id", F.concat("html", F.when(F.col("page_id") % 40 == 0, f" {_SCRATCH.replace('/', '%2F')} ").when(F.col("page_id") % 40 == 1, "CANARY-1").otherwise("")).alias("html"))
    orders = V.load(spark, d, "orders").select(F.col("o_orderkey").alias("key"), "o_custkey")
    return [
        doctor.repeated(V.load(spark, d, "lineitem").select("l_orderkey"), "l_orderkey", "STORE-1", "ids occur once"),
        doctor.orphans(orders.where("key % 2 = 0").select(F.col("o_custkey").alias("c_custkey"), "key"), V.load(spark, d, "customer").where("c_custkey % 3 > 0"), "c_custkey", "key", "STORE-2", "sessions have a project"),
        doctor.records(arrivals(spark, d), [*V.SOURCES, V.ROUTER], [*session_state.SESSION_TYPES, "router_request"]),
        doctor.artifacts(made, "doc_id", "content"),
        doctor.bundles(pages, "page_id", "html", ["CANARY-1"], [_SCRATCH]),
        doctor.formats(spark.createDataFrame([], "source_file string, outcome string")),
    ]


_EXTERNAL_SQL = doctor.EXTERNAL.replace("'", "''")
_RED = redact_sql("content")
#: Citations and references come with the planted sentences; no text of the tables has any by itself.
_COUNT = lambda k: f"sum(([{', '.join(str(c[k]) for c in _CITED)}])[cast(doc_id % {len(_CITED)} as bigint) + 1])"
_EXAMPLE = lambda k: f"min(case when ([{', '.join(str(c[k]) for c in _CITED)}])[cast(doc_id % {len(_CITED)} as bigint) + 1] > 0 then doc_id::varchar end)"


@query(f""", made as (select doc_id, {_REFS.replace("text ||", "coalesce(text, '') ||", 1)} as content from documents),
page as (select page_id, html || case page_id % 40 when 0 then ' {_SCRATCH.replace('/', '%2F')} ' when 1 then 'CANARY-1' else '' end as html from pages),
line as (select l_orderkey, count(*) as n from lineitem group by 1),
ord as (select o_orderkey, not exists (select 1 from customer where c_custkey = o_custkey and c_custkey % 3 > 0) as lost from orders where o_orderkey % 2 = 0),
got as (select 'STORE-1' as "check", 'ids occur once' as requirement, count(*) as scanned, coalesce(sum(n - 1), 0)::bigint as faults, min(case when n > 1 then l_orderkey::varchar end) as example from line
union all select 'STORE-2', 'sessions have a project', count(*), count(*) filter (where lost), min(case when lost then o_orderkey::varchar end) from ord
union all select 'R1-1', 'connector conformance', count(*), 0, null from rec
union all select 'R6f-1', 'no unresolved skill references', count(*), {_COUNT(2)}::bigint, {_EXAMPLE(2)} from made
union all select 'R6g-1', 'absolute evidence paths', count(*), {_COUNT(1)}::bigint, {_EXAMPLE(1)} from made
union all select 'N4-1', 'no secrets persisted', count(*), count(*) filter (where {_RED} <> content), min(case when {_RED} <> content then doc_id::varchar end) from made
union all select 'R14b-1', 'bundle hygiene: no canary or home path', count(*), count(*) filter (where page_id % 40 < 2), min(case when page_id % 40 < 2 then page_id::varchar end) from page
union all select 'R14b-2', 'bundle hygiene: no external assets', count(*), coalesce(sum(len(regexp_extract_all(html, '{_EXTERNAL_SQL}'))), 0)::bigint, min(case when regexp_matches(html, '{_EXTERNAL_SQL}') then page_id::varchar end) from page
union all select 'I2-1', 'source format health', 0, 0, null)
select *, case when faults > 0 then 'FAIL' when scanned = 0 then 'SKIP' else 'PASS' end as verdict, 1 as exit_code from got""")
def doctor_report(spark, d):
    """CHK-05: audits over whole tables, each with its count of faults, and the exit code."""
    return doctor.report(_subjects(spark, d))
