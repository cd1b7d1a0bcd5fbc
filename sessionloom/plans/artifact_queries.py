"""Queries over written artifacts: the check of each, its roll-up over trees, citations that get their root."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import artifacts
from ..sources import views as V
from .registry import query, quoted

_KINDS = ["resumption", "review", "gates", "unstamped"]
_STAMPS = {"resumption": "ab12", "review": "cd34", "gates": "ef56"}
_HOME = "/var/out/{0}/projects/p{1}"
#: Sentences put behind the texts; {h} is the artifact's own folder.
_CITES = [
    "", "see `/opt/known/3/file.txt`, then /opt/known/4.", "at /var/none/x and /var/none/x;", "shot {h}/evidence/a.png", "{h}/prompts/../evidence/b.png, {h}/evidence",
    "{h}/evidence/../other", "evidence/shot.png and docs/evidence/x", '<skill name="lint" missing="true"></skill> /opt/known/5', "use /skill:plan <skill x>/tmp/in/skill evidence/q</skill>", '<skill name="ship" missing="true"/> x/opt/known/1 (/Users/none)',
]
_FOOTS = ["compiler=ab12", "compiler=cd34", "compiler=ef56", "", "compiler=zz"]
_OF = lambda k, m: F.pmod(F.floor(F.col("doc_id") / k), F.lit(m))


def _made(spark, d):
    """Documents as artifacts: the whole text is the first section; sections go or are hollow, citations and stamps vary."""
    docs = V.load(spark, d, "documents")
    kind = V.picked(_KINDS, F.col("doc_id"))
    home = F.concat(F.lit("/var/out/"), (F.col("doc_id") % 7).cast("string"), F.lit("/projects/p"), F.col("doc_id").cast("string"))
    rest = [F.when(_OF(4, 16) == k, "").otherwise(F.concat(F.lit(f"\n## {t} \n\n"), F.when(_OF(12, 40) == k, V.picked(["(None)", "- (none)", " "], F.col("doc_id"))).otherwise("as seen"))) for k, t in enumerate(artifacts.REQUIRED) if k]
    cites = F.replace(V.picked(_CITES, _OF(3, len(_CITES))), F.lit("{h}"), home)
    content = F.concat(F.lit("# Title\n\n## Scope\n"), F.coalesce("text", F.lit("")), F.lit("\n"), cites, *rest, F.lit("\n\n"), V.picked(_FOOTS, _OF(5, 5)))
    return docs.select("doc_id", F.concat(home, F.lit("/prompts/"), kind, F.lit(".md")).alias("path"), content.alias("content"))


_REST = " || ".join(
    f"case when (doc_id // 4) % 16 = {k} then '' else chr(10) || '## {t} ' || chr(10) || chr(10) || case when (doc_id // 12) % 40 = {k} then {V.picked_sql(['(None)', '- (none)', ' '], 'doc_id')} else 'as seen' end end"
    for k, t in enumerate(artifacts.REQUIRED) if k
)
_TRIM = r"regexp_replace({0}, '^\s+|\s+$', '', 'g')"
_PATHS = r"""regexp_extract_all(b, '(^|\W)(/(?:Users|tmp|var|opt|private)/[^\s`''"<>)\],]+)', 2)"""
_CHECKED = f""", art as (select doc_id, {V.picked_sql(_KINDS, 'doc_id')} as kind, '/var/out/' || doc_id % 7 || '/projects/p' || doc_id as home from documents),
txt as (select art.*, '# Title' || chr(10) || chr(10) || '## Scope' || chr(10) || coalesce(text, '') || chr(10) || replace({V.picked_sql(_CITES, 'doc_id // 3')}, '{{h}}', home) || {_REST} || chr(10) || chr(10) || {V.picked_sql(_FOOTS, 'doc_id // 5')} as t from documents join art using (doc_id)),
bod as (select *, regexp_replace(t, '(?s)<skill\\b[^>]*>.*?</skill>', '', 'g') as b from txt),
cut as (select doc_id, unnest(string_split(chr(10) || t, chr(10) || '## ')) as part, generate_subscripts(string_split(chr(10) || t, chr(10) || '## '), 1) as k from txt),
sec as (select doc_id, {_TRIM.format("split_part(part, chr(10), 1)")} as title, arg_max(case when contains(part, chr(10)) then {_TRIM.format("substr(part, strpos(part, chr(10)) + 1)")} else '' end, k) as body from cut where k > 1 group by 1, 2),
need as (select doc_id, unnest([{', '.join(map(quoted, artifacts.REQUIRED))}]) as title from art where kind = 'resumption'),
held as (select doc_id, count(*) filter (where body is null) as missing, count(*) filter (where lower(body) in ('', '(none)', 'no scope provided', '(not recorded)') or body = '- (none)') as hollow from need left join sec using (doc_id, title) group by 1),
cite as (select doc_id, home, p, regexp_replace(p, '/[^/]+/\\.\\.', '') as spot from (select distinct doc_id, home, regexp_replace(unnest({_PATHS}), '[.,;:]+$', '') as p from bod)),
disk as (select '/opt/known/' || item_id || '/file.txt' as spot from benchmark union select '/opt/known/' || item_id from benchmark),
cited as (select doc_id, count(*) as n, count(*) filter (where mine) as mine, count(*) filter (where not mine and gone) as broken from (select doc_id, cite.spot = home || '/evidence' or starts_with(cite.spot, home || '/evidence/') as mine, disk.spot is null as gone from cite left join disk using (spot)) group by 1),
chk as (select doc_id, kind, home || '/prompts/' || kind || '.md' as path, (select count(*) from sec where sec.doc_id = bod.doc_id) as sections_found, coalesce(missing, 0) as missing_sections, coalesce(hollow, 0) as empty_sections, coalesce(cited.n, 0) as checked_citations, coalesce(mine, 0) as prerequisite_citations, coalesce(broken, 0) as broken_citations,
  len(regexp_extract_all(t, '{T.SKILL_REFERENCE}')) as unresolved_skill_refs, array_to_string(regexp_extract_all(t, '{artifacts.LOST_SKILL}', 1), ',') as lost, len(regexp_extract_all(t, '{artifacts.LOST_SKILL}', 1)) as missing_skill_bodies,
  len(regexp_extract_all(b, '(^|[^\\w/.-])evidence/[A-Za-z0-9_./-]+')) as relative_evidence_refs, nullif(regexp_extract(t, 'compiler=([0-9a-f]+)', 1), '') as found_stamp,
  case kind when 'resumption' then 'ab12' when 'review' then 'cd34' when 'gates' then 'ef56' end as expected_stamp from bod left join held using (doc_id) left join cited using (doc_id)),
fin_chk as (select *, (expected_stamp is null or found_stamp is distinct from expected_stamp)::int as stale_stamps, (expected_stamp is null)::int as stamp_errors from chk),
ok_chk as (select *, missing_sections + empty_sections + broken_citations + unresolved_skill_refs + missing_skill_bodies + relative_evidence_refs + stale_stamps = 0 as ok from fin_chk)
"""
_SHOWN = ["path", "kind", "sections_found", *artifacts._COUNTS, "found_stamp", "expected_stamp", "ok"]


def _checked(spark, d):
    known = V.load(spark, d, "benchmark").select(F.concat(F.lit("/opt/known/"), F.col("item_id").cast("string"), F.lit("/file.txt")).alias("path"))
    return artifacts.check(_made(spark, d), known, spark.createDataFrame(list(_STAMPS.items()), "kind string, stamp string"))


def _root():
    return F.regexp_extract("path", "^(/var/out/[^/]+)/", 1)


@query(_CHECKED + f"select {', '.join(_SHOWN)} from ok_chk")
def artifact_check(spark, d):
    """CHK-04, STR-10 to STR-13: sections, citations, skills and stamp of every artifact."""
    rows = _checked(spark, d)
    return rows.select(*[F.col(c).cast("long") if t == "int" and c not in ("stale_stamps", "stamp_errors") else F.col(c) for c, t in rows.select(_SHOWN).dtypes])


_SUMS = ", ".join(f"sum({c})::bigint as {c}" for c in artifacts._COUNTS)


@query(_CHECKED + f", up as (select '/var/out/' || doc_id % 7 as root, * from ok_chk) select root, count(*) as artifact_count, count(*) filter (where not ok) as failing, {_SUMS}, case when count(*) > 0 and count(*) filter (where not ok) = 0 then 'PASS' else 'FAIL' end as verdict from up group by grouping sets ((root), ())")
def artifact_tree(spark, d):
    """AGG-20: sums and verdict per tree and over all."""
    return artifacts.tree(_checked(spark, d), _root())


@query(_CHECKED + "select distinct '/var/out/' || doc_id % 7 as root, unnest(string_split(lost, ',')) as name from ok_chk where lost <> ''")
def artifact_lost_skills(spark, d):
    """AGG-20: the names of skills without a body, once a tree."""
    return artifacts.lost_names(_checked(spark, d), _root())


#: Sentences with their rooted form; {r} is the root.
_ROOTED = [
    ("see evidence/a.txt", "see {r}/a.txt"), ("./evidence/b, /evidence/c", "{r}/b, {r}/c"), ("/root/evidence/x", "/root/evidence/x"), ("evidence/vg{N}-{d}.{e} evidence/*.png evidence/z", "evidence/vg{N}-{d}.{e} evidence/*.png {r}/z"),
    ("evidence/{x}/evidence/y", "evidence/{x}/evidence/y"), ("myevidence/z", "myevidence/z"), ("(evidence/y) evidence/", "({r}/y) {r}/"), ("no citation", "no citation"),
]


@query(f"select doc_id, text || ' ' || replace({V.picked_sql([b for _, b in _ROOTED], 'doc_id')}, '{{r}}', '/out/p' || doc_id) as rooted from documents")
def evidence_rooted(spark, d):
    """STR-17: citations get their root, stand-ins stay; the texts of the tables hold none by themselves."""
    text = F.concat("text", F.lit(" "), V.picked([a for a, _ in _ROOTED], F.col("doc_id")))
    return V.load(spark, d, "documents").select("doc_id", T.rooted_evidence(text, F.concat(F.lit("/out/p"), F.col("doc_id").cast("string"))).alias("rooted"))
