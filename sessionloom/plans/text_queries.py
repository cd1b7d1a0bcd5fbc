"""Queries over the scalar expressions: prose, paths, stamps, sets."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.plan import dealt
from ..operators import folders
from ..sources import views as V
from .registry import query, quoted, redact_sql

_QUOTES = ["see /tmp/a/b.txt now", "(/private/tmp/x) and /skill:plan", "Skill(run) then @skill", "/var/log/x.", "nothing here", "compiler=ab12 end", "compiler=zz", "/opt/a/b, /opt/a/b; /Users/me/x.py:"]
_PROSE = f"(select doc_id, text || ' ' || {V.picked_sql(_QUOTES, 'doc_id')} as t from documents)"


def _prose(spark, d):
    return V.load(spark, d, "documents").select("doc_id", F.concat("text", F.lit(" "), V.picked(_QUOTES, F.col("doc_id"))).alias("t"))


@query(f"select doc_id, case when length(s) > 48 then left(s, 47) || '…' else s end as line from (select doc_id, trim(replace(coalesce(t, ''), chr(10), ' '), ' ') as s from {_PROSE})")
def truncate_text(spark, d):
    """STR-05."""
    return _prose(spark, d).select("doc_id", T.truncate(F.col("t"), 48).alias("line"))


@query(f"select doc_id, regexp_replace(regexp_replace(t, {quoted(T.EPHEMERAL)}, '{T.EPHEMERAL_TOKEN}', 'g'), {quoted(T.SKILL_REFERENCE)}, '{T.SKILL_TOKEN}', 'g') as safe from {_PROSE}")
def defang_text(spark, d):
    """STR-08."""
    return _prose(spark, d).select("doc_id", T.defang(F.col("t")).alias("safe"))


_FOUND = "list_transform(regexp_extract_all(t, '/(?:Users|tmp|var|opt|private)/[^\\s`''\"<>)\\],]+'), lambda p: regexp_replace(p, '[.,;:]+$', ''))"


@query(f"select doc_id, nullif(regexp_extract(t, 'compiler=([0-9a-f]+)', 1), '') as stamp, array_to_string(list_filter(found, lambda p, k: list_position(found, p) = k), ' ') as paths from (select *, {_FOUND} as found from {_PROSE})")
def cited_paths(spark, d):
    """STR-10, STR-13: compiler stamp, and the distinct absolute paths in order."""
    rows = _prose(spark, d)
    return rows.select("doc_id", F.nullif(F.regexp_extract("t", "compiler=([0-9a-f]+)", 1), F.lit("")).alias("stamp"), F.array_join(T.absolute_paths(F.col("t")), " ").alias("paths"))


@query("select doc_id, unnest(['Scope', 'Plan ' || doc_id % 7]) as title, unnest([source || ' text', 'step one' || chr(10) || '### not a section']) as body from documents")
def markdown_sections(spark, d):
    """STR-11, STR-12: second-level headings with their bodies, after skill blocks are taken out."""
    made = F.concat(F.lit("# Title\nintro\n## Scope\n\n"), "source", F.lit(" text\n<skill name=\"x\">## Hidden\nbody</skill>\n## Plan "), F.col("doc_id") % 7, F.lit("\nstep one\n### not a section\n"))
    parts = F.explode(T.sections(T.without_skills(made))).alias("s")
    return V.load(spark, d, "documents").select("doc_id", parts).select("doc_id", "s.title", "s.body")


_CODES = ["M ", " M", "??", "A ", "R ", "MM"]


def _status(spark, d):
    """A short status line and a line of change statistics for each item."""
    i = V.load(spark, d, "benchmark")
    path = F.when(F.col("item_id") % 5 == 0, F.concat(F.lit("docs/"), "item_id")).when(F.col("item_id") % 7 == 0, F.lit("README.md")).otherwise(F.concat(F.lit("src/"), "item_id", F.lit(".py")))
    code = V.picked(_CODES, F.col("item_id"))
    line = F.concat(code, F.lit(" "), F.when(code == "R ", F.concat(F.lit("old/"), "item_id", F.lit(" -> "))).otherwise(""), path)
    return i.select((F.col("item_id") % 6).alias("project"), "item_id", line.alias("line"), F.concat(F.lit(" "), path, F.lit("2 | 4 ++--")).alias("stat"))


_PATHS = f""", g as (select item_id % 6 as project, item_id, case when item_id % 5 = 0 then 'docs/' || item_id when item_id % 7 = 0 then 'README.md' else 'src/' || item_id || '.py' end as path, {V.picked_sql(_CODES, 'item_id')} as code from benchmark)
"""


@query(_PATHS + "select item_id, path as status_path, path || '2' as stat_path, starts_with(lower(path), 'readme') or starts_with(lower(path), 'docs/') as docs from g")
def git_paths(spark, d):
    """SRC-12, STR-14, STR-15, STR-16: paths of status and statistics lines, and whether they are documents."""
    rows = _status(spark, d).withColumn("status_path", T.porcelain_path(F.col("line")))
    return rows.select("item_id", "status_path", T.diffstat_path(F.col("stat")).alias("stat_path"), T.is_docs(F.col("status_path")).alias("docs"))


@query(_PATHS + "select project, code, count(*) as entries from g group by 1, 2")
def git_status_codes(spark, d):
    """AGG-18."""
    return _status(spark, d).groupBy("project", F.substring("line", 1, 2).alias("code")).agg(F.count("*").alias("entries"))


@query(_PATHS + ", p as (select distinct project, path from g union select distinct project, path || '2' from g) select project, count(*) filter (where not (starts_with(lower(path), 'readme') or starts_with(lower(path), 'docs/'))) as code, count(*) filter (where starts_with(lower(path), 'readme') or starts_with(lower(path), 'docs/')) as docs from p group by 1")
def touched_paths(spark, d):
    """SET-08: the union of both lists' paths, by kind."""
    rows = _status(spark, d)
    both = rows.groupBy("project").agg(F.array_sort(F.array_union(F.collect_set(T.porcelain_path(F.col("line"))), F.collect_set(T.diffstat_path(F.col("stat"))))).alias("paths"))
    docs = F.size(F.filter("paths", T.is_docs))
    return both.select("project", (F.size("paths") - docs).cast("long").alias("code"), docs.cast("long").alias("docs"))


@query("select c_custkey, case when c_custkey % 4 = 0 then '/' when c_custkey % 4 = 1 then '/a/b' else '/p/' || c_custkey end as plain, case c_custkey % 3 when 0 then '/ok/x' when 1 then '/fall/back' else '' end as chosen, case when c_custkey % 4 = 0 then '/' when c_custkey % 4 = 1 then 'b' else cast(c_custkey as varchar) end as name from customer")
def path_forms(spark, d):
    """STR-22, STR-23, PRJ-06: slashes at the end, the first safe path of two, the display name."""
    k = F.col("c_custkey")
    raw = F.when(k % 4 == 0, "/").when(k % 4 == 1, "/a/b///").otherwise(F.concat(F.lit("/p/"), k, F.lit("/")))
    wanted = F.when(k % 3 == 0, "/ok/x").when(k % 3 == 1, "/up/../x").otherwise("relative")
    other = F.when(k % 3 == 1, "/fall/back").otherwise("a\\b")
    return V.load(spark, d, "customer").select("c_custkey", T.plain_path(raw).alias("plain"), T.safe_path(wanted, other).alias("chosen"), T.project_name(raw).alias("name"))


@query("select page_id, replace(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#x27;') as escaped, replace(replace(replace(html, '&', '\\u0026'), '<', '\\u003c'), '>', '\\u003e') as inert from pages")
def html_forms(spark, d):
    """STR-19."""
    return V.load(spark, d, "pages").select("page_id", T.html_escape(F.col("html")).alias("escaped"), T.script_json(F.col("html")).alias("inert"))


@query("select native_id, strftime(to_timestamp(ms // 1000), '%Y-%m-%dT%H:%M:%SZ') as at, case when d <= 0 then '—' when d < 60000 then printf('%.1fs', d / 1000.0) else (d // 1000 // 60) || 'm' || lpad(cast(d // 1000 % 60 as varchar), 2, '0') || 's' end as took, round((1706745600000 - ms) / 86400000.0, 6) as age_days from (select native_id, ms, native_id * 7919 % 8000 * 50 - 19950 as d from rec)")
def time_forms(spark, d):
    """DTE-02, DTE-03, DTE-05: ISO stamps, durations, ages in days."""
    r = V.records(spark, d).withColumn("d", F.col("native_id") * 7919 % 8000 * 50 - 19950)
    return r.select("native_id", T.ms_to_iso(F.col("ms")).alias("at"), T.duration(F.col("d")).alias("took"), F.round(T.days_between(F.col("ms"), F.lit(1_706_745_600_000)), 6).alias("age_days"))


_STAMPS = ["2024-01-05T10:00:00Z", "2024-01-05T10:00:00+02:00", "2024-02-30T10:00:00Z", "2024-01-05 10:00:00Z", "2024-01-05T10:00:00.123+00:00", "", "nope"]


@query(f"select o_orderkey, [true, false, false, false, true, false, false][cast(o_orderkey % {len(_STAMPS)} as bigint) + 1] as utc from orders")
def utc_stamps(spark, d):
    """DTE-06: ISO, UTC, and a day that exists."""
    return V.load(spark, d, "orders").select("o_orderkey", T.is_utc_stamp(V.picked(_STAMPS, F.col("o_orderkey"))).alias("utc"))


@query("select conv_id, len(missing) as missing, len(extra) as extra, missing = [] and extra = [] as same, list_has_any(found, ['system', 'tool']) as barred, not list_has_any(found, ['tool']) as disjoint from (select conv_id, found, list_filter(['assistant', 'user'], lambda x: not list_contains(found, x)) as missing, list_filter(found, lambda x: not list_contains(['assistant', 'user'], x)) as extra from (select conv_id, list(distinct role) as found from conversations group by 1))")
def set_compare(spark, d):
    """SET-05, SET-06, SET-09: missing and extra members, equality, and sets that must not meet."""
    wanted = F.array(F.lit("user"), F.lit("assistant"))
    rows = V.load(spark, d, "conversations").groupBy("conv_id").agg(F.collect_set("role").alias("found"))
    missing, extra = F.array_except(wanted, F.col("found")), F.array_except(F.col("found"), wanted)
    return rows.select("conv_id", F.size(missing).cast("long").alias("missing"), F.size(extra).cast("long").alias("extra"), ((F.size(missing) == 0) & (F.size(extra) == 0)).alias("same"), F.arrays_overlap("found", F.array(F.lit("system"), F.lit("tool"))).alias("barred"), (~F.arrays_overlap("found", F.array(F.lit("tool")))).alias("disjoint"))


_JSON_PLANTS = [p for p in V.PLANTS if '"' not in p and "\\" not in p]


@query(f"""select event_id, '{{"k": ' || user_id || ', "note": "' || r || '", "list": [1, "' || r || '"]}}' as safe from (select event_id, user_id, {redact_sql("p")} as r from (select *, {V.picked_sql(_JSON_PLANTS, "event_id")} as p from events))""")
def redact_json(spark, d):
    """STR-02, UDF-02: every string of a JSON text is masked by itself; numbers and structure stay."""
    p = V.picked(_JSON_PLANTS, F.col("event_id"))
    made = F.concat(F.lit('{"k": '), "user_id", F.lit(', "note": "'), p, F.lit('", "list": [1, "'), p, F.lit('"]}'))
    return dealt(V.load(spark, d, "events").select("event_id", "user_id"), "event_id").select("event_id", T.redact_json(made).alias("safe"))


_NEST = """case when event_id % 4 = 0 then '{"password=aaaaaaaa1": {"token=bbbbbbbb2": 1, "token=bbbbbbbb3": [{"secret=cccccccc4": 2, "secret=cccccccc5": 3}]}, "password=aaaaaaaa6": 4, "password=REDACTED_SECRET#2": ' || event_id || '}'
  when event_id % 4 = 1 then '{"a": {"password=aaaaaaaa1": "x"}, "b": {"password=aaaaaaaa2" : "' || event_type || '"}}' when event_id % 4 = 2 then '{"note": "token=bbbbbbbb2", "n": ' || event_id || '}' else 'token=bbbbbbbb2 in no JSON {' end"""


@query("""select event_id, case when event_id % 4 = 0 then '{"password=REDACTED_SECRET": {"token=REDACTED_SECRET": 1, "token=REDACTED_SECRET#2": [{"secret=REDACTED_SECRET": 2, "secret=REDACTED_SECRET#2": 3}]}, "password=REDACTED_SECRET#2": 4, "password=REDACTED_SECRET#3": ' || event_id || '}'
  when event_id % 4 = 1 then '{"a": {"password=REDACTED_SECRET": "x"}, "b": {"password=REDACTED_SECRET" : "' || event_type || '"}}' when event_id % 4 = 2 then '{"note": "token=REDACTED_SECRET", "n": ' || event_id || '}' else 'token=REDACTED_SECRET in no JSON {' end as safe, 'b token=REDACTED_SECRET ' || event_type || chr(65533) as safe_bytes from events""")
def redact_nested(spark, d):
    """STR-02, UDF-02: keys at any depth, those that collide numbered within their object; bytes that are no UTF-8."""
    data = F.concat(F.encode(F.concat(F.lit("b token=bbbbbbbb2 "), "event_type"), "UTF-8"), F.unhex(F.lit("FF")))
    rows = dealt(V.load(spark, d, "events").select("event_id", "event_type"), "event_id")
    return rows.select("event_id", T.redact_json(F.expr(_NEST)).alias("safe"), T.redact_bytes(data).alias("safe_bytes"))


@query("select event_id, 'a' || event_id || ',u' || user_id as ids, case when event_id % 2 = 0 then 's' || user_id end as session_id, event_id % 3 <> 0 as counted from events")
def nested_ids(spark, d):
    """JSN-01, JSN-02, JSN-07: id-shaped values of nested objects, the session id by name, counts from JSON or nothing."""
    e = V.load(spark, d, "events")
    inner = F.concat(F.lit('{"user-id": "u'), "user_id", F.lit('", "name": "x"'), F.when(F.col("event_id") % 2 == 0, F.concat(F.lit(', "session": "s'), "user_id", F.lit('"'))).otherwise(""), F.lit("}"))
    made = F.concat(F.lit('{"eventId": "a'), "event_id", F.lit('", "n": 3, "z": '), inner, F.lit("}"))
    counts = F.when(F.col("event_id") % 3 == 0, "{broken").otherwise('{"claude": 3}')
    return e.select("event_id", F.array_join(T.id_values(made), ",").alias("ids"), T.session_id_of(made).alias("session_id"), (F.size(T.counts_map(counts)) > 0).alias("counted"))


@query("select conv_id, turn, regexp_matches(text, 'xyz') or turn % 3 = 0 as falsifiable, turn % 4 <> 1 as observable from conversations")
def goal_checks(spark, d):
    """STR-20: a goal names what is run and what it shows; a criterion names something that can be seen."""
    goal = F.when(F.col("turn") % 3 == 0, "Running `make test` prints its result, and that output satisfies: exits 0").otherwise("Make it better")
    criterion = F.when(F.col("turn") % 4 == 1, "works well").otherwise("HTTP status is 2xx and the body contains the field")
    return V.load(spark, d, "conversations").select("conv_id", "turn", (F.col("text").contains("xyz") | T.is_falsifiable(goal)).alias("falsifiable"), T.is_observable(criterion).alias("observable"))


@query("""select c_custkey, case c_custkey % 5 when 0 then base || '/src' when 1 then base || case when c_nationkey % 2 = 0 then '/-cfg' else '/.cfg' end when 2 then base || '/gone-' || c_custkey when 3 then '' else '/x-' || c_custkey end as path, c_custkey % 5 = 3 as malformed
from (select *, '/p/' || (c_nationkey % 5) || case when c_nationkey % 2 = 0 then '-' else '/' end || c_nationkey as base from customer)""")
def folder_paths(spark, d):
    """STR-21, UDF-01: names against known folders, some with hyphens, some hidden, some gone, some that would climb."""
    n, k = F.col("c_nationkey"), F.col("c_custkey")
    c = V.load(spark, d, "customer")
    own = F.when(n % 2 == 0, F.concat(F.lit("/p/"), n % 5, F.lit("-"), n, F.lit("/src"))).otherwise(F.concat(F.lit("/p/"), n % 5, F.lit("/"), n, F.lit("/.cfg")))
    coded = F.concat(F.lit("-p-"), n % 5, F.lit("-"), n)
    end = F.when(k % 5 == 0, "-src").when(k % 5 == 1, "--cfg").when(k % 5 == 2, F.concat(F.lit("-gone-"), k)).otherwise("-..")
    names = c.select("c_custkey", F.when(k % 5 == 4, F.concat(F.lit("x-"), k)).otherwise(F.concat(coded, end)).alias("name"))
    return names.join(folders.decode(names, folders.ancestors(c.select(own.alias("path")))), "name").select("c_custkey", "path", "malformed")
