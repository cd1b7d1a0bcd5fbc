"""Queries over logs, Markdown tables, the ledger of paid calls, cached explanations, citations and JSON schemas."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.json_schema import schema_error
from ..functions.plan import fresh_folder
from ..operators import state
from ..operators import views as W
from ..sources import stores
from ..sources import views as V
from .registry import query, redact_sql
from .source_queries import _READ, _files

_SINCE, _MOST = 1_704_499_200_000, 200


@query(_READ + f""", fit as (select *, ms as stamp, user_id::varchar || '/' as file from ok where event_type in ('error', 'purchase') and event_id % 97 <> 0 and ms >= {_SINCE}),
n as (select file, count(*) as n from fit group by 1), taken as (select file from (select file, coalesce(sum(n) over (order by file desc rows between unbounded preceding and 1 preceding), 0) as before from n) where before < {_MOST})
select stamp as ts_ms, event_type as topic, case when event_id % 3 = 0 then 'WARN' else 'INFO' end as level, own as msg, case when event_id % 4 = 0 then 'p' || user_id end as project_id from fit join taken using (file) order by stamp desc, file desc, event_id limit {_MOST}""")
def topic_events(spark, d):
    """SRC-14, SRT-10: the newest events of two topics, from log files taken by name."""
    has = lambda test, value: F.when(test, value)
    n = F.col("event_id")
    line = lambda e: F.to_json(F.struct(has(n % 97 != 0, F.expr("unix_micros(cast(ts as timestamp)) div 1000")).alias("ts_ms"), F.col("event_type").alias("topic"), has(n % 3 == 0, F.lit("WARN")).alias("level"), F.col("own").alias("msg"), has(n % 4 == 0, F.concat(F.lit("p"), "user_id")).alias("project_id")))
    found = stores.topic_events(spark, _files(spark, d, "topics", line), _SINCE, ["error", "purchase"], _MOST, glob="*.txt")
    return found.select("ts_ms", "topic", "level", "msg", "project_id")


_CELLS = ["**pass**", "Fail", "blocked ", "open", "PASSED"]


def _tables(spark, d) -> str:
    """A Markdown file for each nation: a heading, then rows by customer, some of them gates, requirements or prose."""
    k = F.col("c_custkey")
    status = V.picked(_CELLS, k)
    gate = F.concat(F.lit("| G"), k % 3, F.lit(" | ABC-"), F.lpad((k % 1000).cast("string"), 3, "0"), F.lit(", no, REQUIR-001 , XY-123 | text | "), status, F.lit(" | FAIL |"))
    need = F.concat(F.lit("| REQ-"), F.lpad((k % 40).cast("string"), 3, "0"), F.lit(" | must hold |"))
    value = F.when(k % 4 == 0, gate).when(k % 4 == 1, need).when(k % 4 == 2, F.lit("| see REQ-999 | REQ-998 |")).otherwise("REQ-997 | G1 | prose")
    folder = fresh_folder(spark, "tables")
    V.load(spark, d, "customer").select(value.alias("value"), "c_custkey", "c_nationkey").repartition("c_nationkey").sortWithinPartitions("c_nationkey", "c_custkey").select("value", "c_nationkey").write.partitionBy("c_nationkey").text(folder)
    return folder


def _nation():
    return F.regexp_extract("source_file", "c_nationkey=([0-9]+)", 1).cast("int").alias("nation")


@query("""select c_nationkey as nation, 'G' || (c_custkey % 3) as gate, ['PASS', 'FAIL', 'BLOCKED', 'FAIL', 'FAIL'][cast(c_custkey % 5 as bigint) + 1] as status, 'ABC-' || lpad(cast(c_custkey % 1000 as varchar), 3, '0') || ',REQUIR-001' as ids
from customer where c_custkey % 4 = 0 qualify row_number() over (partition by c_nationkey, c_custkey % 3 order by c_custkey desc) = 1""")
def gate_rows(spark, d):
    """SRC-19: gates of a Markdown table with their status and requirements; the last row of a gate counts."""
    found = stores.gate_rows(stores.lines(spark, [_tables(spark, d)], "*.txt"))
    return found.select(_nation(), "gate", "status", F.array_join("requirement_ids", ",").alias("ids"))


@query("select distinct c_nationkey as nation, 'REQ-' || lpad(cast(c_custkey % 40 as varchar), 3, '0') as id from customer where c_custkey % 4 = 1")
def requirement_ids(spark, d):
    """SRC-19: only the first cell of a table row defines a requirement."""
    return stores.requirement_ids(stores.lines(spark, [_tables(spark, d)], "*.txt")).select(_nation(), "id")


_LADDER = [(1, "runs", "lost", "string"), (3, "runs", "lookback_days", "int"), (2, "pins", None, "name string, sha string"), (4, "pins", "seen_ms", "bigint"), (5, "runs", "status", "int")]


@query("select o_orderkey as id, o_orderstatus as status, cast(null as int) as lookback_days, 5 as version, 'name,sha,seen_ms' as pins from orders")
def store_migration(spark, d):
    """SNK-26: a store of version 1 climbs to 5; what it has stays."""
    runs = V.load(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status"))
    tables, version = state.migrate(spark, {"runs": runs}, 1, _LADDER)
    tables, version = state.migrate(spark, tables, version, _LADDER)
    return tables["runs"].select("*", F.lit(version).alias("version"), F.lit(",".join(tables["pins"].columns)).alias("pins"))


_SAID = ["ok", "failed: password=hunter2hunter2", "sk-aaaabbbbccccdddd", ""]


@query(f"""select 'r' || native_id % 5 as run_id, ms as started_ms, 'f' || native_id as input_fingerprint, {redact_sql(V.picked_sql(_SAID, 'native_id'))} as model, case when native_id % 3 <> 0 then ms + 10 end as ended_ms,
case when native_id % 3 <> 0 then 'done' end as status, case when native_id % 3 <> 0 then cost end as cost_usd, case when native_id % 3 <> 0 then {redact_sql(V.picked_sql(_SAID, 'native_id + 1'))} end as error_text from req, range(2)""")
def agent_calls(spark, d):
    """SNK-08: equal calls of one millisecond stay two rows; outcomes go by id, their texts masked."""
    n = F.col("native_id")
    calls = V.requests(V.records(spark, d)).withColumn("twice", F.explode(F.sequence(F.lit(1), F.lit(2))))
    opened = calls.select(F.concat(F.lit("r"), n % 5).alias("run_id"), F.lit("teacher").alias("agent_type"), F.col("ms").alias("started_ms"), V.picked(_SAID, n).alias("model"), F.concat(F.lit("f"), n).alias("input_fingerprint"), n.alias("n"), F.col("cost").alias("paid"))
    folder = fresh_folder(spark, "calls")
    state.open_calls(opened).write.parquet(folder)
    stored = spark.read.parquet(folder)
    none = F.lit(None)
    ended = stored.where("n % 3 <> 0").select("id", (F.col("started_ms") + 10).alias("ended_ms"), F.lit("done").alias("status"), F.col("paid").alias("cost_usd"), none.cast("bigint").alias("prompt_tokens"), none.cast("bigint").alias("completion_tokens"), none.cast("string").alias("output_json"), V.picked(_SAID, F.col("n") + 1).alias("error_text"))
    return state.finish_calls(stored, ended).select("run_id", "started_ms", "input_fingerprint", "model", "ended_ms", "status", "cost_usd", "error_text")


@query("""select item_id, s as signature, case when item_id % 3 = 0 then 'late ' || item_id when item_id % 3 = 1 and item_id % 2 = 0 then 'long ' || item_id end as explanation
from (select item_id, substr(sha256('c' || item_id % 4 || '|{"a":' || item_id || ',"b":"x"}|t' || item_id), 1, 16) as s from benchmark)""")
def cached_explanations(spark, d):
    """JON-21: the latest explanation of a finding, by a signature that stands somewhere in the event's fields."""
    k = F.col("item_id")
    evidence = F.concat(F.lit('{"b": "x", "a": '), k, F.lit("}"))
    findings = V.load(spark, d, "benchmark").select("item_id", W.signature(F.concat(F.lit("c"), k % 4), evidence, F.concat(F.lit("t"), k)).alias("signature"))
    made = lambda topic, at, fields, word: F.struct(F.lit(topic).alias("topic"), F.lit(at).cast("bigint").alias("ts_ms"), fields.alias("fields_json"), F.concat(F.lit(f"{word} "), k).alias("message"))
    whole, longer = F.concat(F.lit('{"signature": "'), "signature", F.lit('"}')), F.concat(F.lit('{"key": "ab'), "signature", F.lit('0"}'))
    kinds = F.when(k % 3 == 0, F.array(made("teacher", 5, whole, "early"), made("teacher", 9, whole, "late"), made("critic", 20, whole, "other"))).when((k % 3 == 1) & (k % 2 == 0), F.array(made("teacher", 7, longer, "long"))).otherwise(F.array(made("critic", 7, whole, "other")))
    events = findings.select(F.explode(kinds).alias("e")).select("e.*")
    return W.cached_explanations(findings, events).select("item_id", "signature", "explanation")


#: Each text with its number of relative citations and of unresolved references.
_CITED = [("see evidence/a.txt", 1, 0), ("./evidence/b and /evidence/c", 2, 0), ("/root/evidence/x", 0, 0), ("evidence/vg{N}-{d}.{e} evidence/*.png", 0, 0), ("<skill a>evidence/q Skill(x)</skill> @skill", 0, 2), ("myevidence/z /skill:run", 0, 1), ("(evidence/y) evidence/<id>", 1, 0)]


@query(f"select doc_id, ([{', '.join(str(c[1]) for c in _CITED)}])[cast(doc_id % {len(_CITED)} as bigint) + 1] as relative_refs, ([{', '.join(str(c[2]) for c in _CITED)}])[cast(doc_id % {len(_CITED)} as bigint) + 1] as skill_refs from documents")
def evidence_refs(spark, d):
    """CHK-07: citations without a root, and references to skills that nothing resolved."""
    text = F.concat("text", F.lit(" "), V.picked([c[0] for c in _CITED], F.col("doc_id")))
    return V.load(spark, d, "documents").select("doc_id", F.size(T.relative_evidence(text)).alias("relative_refs"), F.size(T.skill_references(text)).alias("skill_refs"))


_SCHEMA = {
    "type": "object",
    "required": ["id", "kind"],
    "additionalProperties": False,
    "properties": {
        "id": {"type": "integer"},
        "kind": {"enum": ["view", "click", "signup", "purchase"]},
        "score": {"type": ["number", "null"]},
        "steps": {"type": "array", "items": {"type": "object", "required": ["name"], "properties": {"name": {"type": "string"}, "took": {"type": "number"}}}},
        "odd": {"type": "unheard-of"},
    },
}
#: Each JSON text with what the walk says of it.
_WALKED = [
    ('{"id": 1, "kind": "view"}', None),
    ('{"id": true, "kind": "view"}', "$.id: expected integer, got boolean"),
    ('{"id": 1.5, "kind": "view"}', "$.id: expected integer, got number"),
    ('{"id": 1}', "$: no key kind"),
    ('{"id": 1, "kind": "view", "z": 1, "b": 2}', "$: undeclared keys b, z"),
    ('{"id": 1, "kind": "gone"}', '$.kind: not one of ["view", "click", "signup", "purchase"]'),
    ('{"id": 1, "kind": "view", "score": null, "odd": [], "steps": []}', None),
    ('{"id": 1, "kind": "view", "score": 2, "steps": [{"name": "a", "took": 1}, {"name": "b", "took": 0.5}]}', None),
    ('{"id": 1, "kind": "view", "score": "high"}', "$.score: expected number or null, got string"),
    ('{"id": 1, "kind": "view", "steps": {"name": "a"}}', "$.steps: expected array, got object"),
    ('{"id": 1, "kind": "view", "steps": [{"name": "a"}, {"took": 1}, 3]}', "$.steps[1]: no key name"),
    ('{"id": 1, "kind": "view", "steps": [{"name": "a"}, {"name": null}]}', "$.steps[1].name: expected string, got null"),
    ('{"id": 1, "kind": "view", "steps": [{"name": "a", "took": true}]}', "$.steps[0].took: expected number, got boolean"),
    ("[1]", "$: expected object, got array"),
    ("{broken", "$: no JSON"),
]


@query(f"select event_id, ([{', '.join('null' if w[1] is None else chr(39) + w[1] + chr(39) for w in _WALKED)}])[cast(event_id % {len(_WALKED)} as bigint) + 1] as problem from events")
def schema_walk(spark, d):
    """JSN-06, UDF-04: the first way in which an answer breaks its schema."""
    return V.load(spark, d, "events").select("event_id", schema_error(V.picked([w[0] for w in _WALKED], F.col("event_id")), _SCHEMA).alias("problem"))
