"""URL verdicts by longest-match rules and, where no rule fits, by a tree of path templates; Spark columns throughout.

Host: what follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; path: from there up to ``?``,
``#`` or the end. A null url or one without ``://`` has an empty host and path. A rule (host, path, verdict) fits its host
and every subdomain where the path starts with the rule's; the longest wins (ties: the first in order of text).

Template tree, per host: all segments of the path, however deep. A run of digits becomes ``#``; where a node has more than
MOST_CHILDREN different children, its children become ``*``. A branch is left as it is once it holds so few paths that no
node below can have more children than that. Pages with a rule are the labelled ones. Sibling branches stand in order of their rejected share; a branch that a two-proportion test does not tell
apart from the one before it (|z| < Z_APART) joins its group, and a group takes its pooled counts. Branches without labels
form one group with the whole family's counts, and where the family has none, with those of the host. A template is rejected where its purity,
(blocked + SMOOTHING / 2) / (labelled + SMOOTHING), reaches LEAST_PURITY; on a host without labels all are allowed. All
tree work is on counts per template, not on pages, and a family has at most MOST_CHILDREN branches and the wildcard.

Repeated urls get equal verdicts, an empty table gives none, a url of any length is judged whole, columns named like a
result are replaced.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut_lineage, table

MOST_CHILDREN = 32
Z_APART = 1.96
SMOOTHING = 2.0
LEAST_PURITY = 0.8
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Host, path, verdict.
RULES = [
    ("com", "/en/", "block"),
    ("example.com", "/en/7", "allow"),
    ("net", "/de/", "allow"),
    ("example.net", "/de/8", "block"),
    ("org", "/es/", "block"),
]


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + F.lit(3))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), UPPER, LOWER)
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> Column:
    """Struct (rule, verdict) of the longest fitting rule, or null."""
    ordered = sorted(rules, key=lambda r: (-len(r[0] + r[1]), r[0] + r[1]))
    fits = lambda r: ((host == r[0]) | host.endswith("." + r[0])) & path.startswith(r[1])
    made = lambda r: F.struct(F.lit(r[0] + r[1]).alias("rule"), F.lit(r[2]).alias("verdict"))
    if not ordered:
        return F.lit(None).cast("struct<rule:string,verdict:string>")
    return functools.reduce(lambda chain, r: chain.when(fits(r), made(r)), ordered[1:], F.when(fits(ordered[0]), made(ordered[0])))


def template_path(path: Column) -> Column:
    """Segments of a path, digits as #."""
    return F.split(F.regexp_replace(path, "[0-9]+", "#"), "/")


def generalise(counts: DataFrame) -> DataFrame:
    """counts: host, parts, blocked, labelled. Adds node, the parts with crowded levels as *, from the root downwards, for as
    long as a branch has paths enough for a crowded level."""
    tree, done, depth = counts.withColumn("node", F.col("parts")), [], 1
    columns = tree.columns
    while True:
        keyed = tree.withColumn("prefix", F.slice("node", 1, depth)).withColumn("segment", F.get("node", F.lit(depth)))
        kids = keyed.where(F.col("segment").isNotNull()).groupBy("host", "prefix", "segment").agg(F.count("*").alias("paths"))
        crowds = kids.groupBy("host", "prefix").agg(F.count("*").alias("kids"), F.sum("paths").alias("paths")).where(F.col("paths") > MOST_CHILDREN)
        starred = F.concat(F.slice("node", 1, depth), F.array(F.lit("*")), F.slice("node", F.lit(depth + 2), F.size("node")))
        marked = keyed.join(cut_lineage(crowds), ["host", "prefix"], "left").withColumn("open", F.col("kids").isNotNull() & F.col("segment").isNotNull())
        tree = cut_lineage(marked.withColumn("node", F.when(F.col("open") & (F.col("kids") > MOST_CHILDREN), starred).otherwise(F.col("node"))).select(*columns, "open"))
        done.append(tree.where(~F.col("open")).select(columns))
        tree, depth = tree.where("open").select(columns), depth + 1
        if tree.isEmpty():
            return functools.reduce(DataFrame.union, done)


def judged_templates(counts: DataFrame) -> DataFrame:
    """Adds template, purity and reject to each (host, parts), after siblings that are alike have merged."""
    tree = generalise(counts)
    parent = F.slice("node", 1, F.greatest(F.size("node") - 1, F.lit(1)))
    nodes = cut_lineage(tree.groupBy("host", "node").agg(F.sum("blocked").alias("b"), F.sum("labelled").alias("n")).withColumn("parent", parent))
    family = Window.partitionBy("host", "parent")
    order = family.orderBy((F.col("n") == 0), F.try_divide("b", "n"), F.array_join("node", "/"))
    b0, n0 = F.lag("b").over(order), F.lag("n").over(order)
    pooled = F.try_divide(F.col("b") + b0, F.col("n") + n0)
    spread = F.sqrt(pooled * (1 - pooled) * (F.try_divide(F.lit(1), F.col("n")) + F.try_divide(F.lit(1), n0)))
    z = F.coalesce(F.try_divide(F.abs(F.try_divide("b", "n") - F.try_divide(b0, n0)), spread), F.lit(0.0))
    apart = nodes.withColumn("apart", ((F.col("n") == 0) & (F.coalesce(n0, F.lit(0)) > 0) | (z >= Z_APART)).cast("int"))
    grouped = apart.withColumn("fb", F.sum("b").over(family)).withColumn("fn", F.sum("n").over(family)).withColumn("part", F.sum("apart").over(order))
    alike = Window.partitionBy("host", "parent", "part")
    summed = grouped.withColumn("gb", F.sum("b").over(alike)).withColumn("gn", F.sum("n").over(alike))
    hosts = nodes.groupBy("host").agg(F.sum("b").alias("hb"), F.sum("n").alias("hn"))
    met = cut_lineage(summed).join(hosts, "host")
    pick = lambda g, f, h: F.when(F.col("n") > 0, F.col(g)).when(F.col("fn") > 0, F.col(f)).otherwise(F.col(h))
    b, n = pick("gb", "fb", "hb"), pick("gn", "fn", "hn")
    purity = (b + SMOOTHING / 2) / (n + SMOOTHING)
    template = F.concat("host", F.array_join("node", "/"))
    judged = met.select("host", "node", template.alias("template"), purity.alias("purity"), ((n > 0) & (purity >= LEAST_PURITY)).alias("reject"))
    return tree.select("host", "parts", "node").join(cut_lineage(judged), ["host", "node"]).select("host", "parts", "template", "purity", "reject")


def judge(pages: DataFrame, url: str = "url", rules: list[tuple[str, str, str]] | None = None) -> DataFrame:
    """Adds host, path, rule, verdict, template and purity to every page."""
    added = ("host", "path", "rule", "verdict", "template", "purity", "_parts", "_rule")
    host, path = host_and_path(F.col(url))
    keep = [F.col(c) for c in pages.columns if c not in added]
    rows = pages.select(*keep, host.alias("host"), path.alias("path"))
    rows = rows.withColumn("_rule", rule_of(F.col("host"), F.col("path"), RULES if rules is None else rules)).withColumn("_parts", template_path(F.col("path")))
    counts = rows.groupBy("host", F.col("_parts").alias("parts")).agg(F.count_if(F.col("_rule.verdict") == "block").alias("blocked"), F.count("_rule").alias("labelled"))
    verdicts = cut_lineage(judged_templates(cut_lineage(counts)))
    joined = rows.join(verdicts.withColumnRenamed("parts", "_parts"), ["host", "_parts"], "left")
    verdict = F.coalesce(F.col("_rule.verdict"), F.when(F.col("reject"), "block").otherwise("allow"))
    return joined.select(*keep, "host", "path", F.col("_rule.rule").alias("rule"), verdict.alias("verdict"), "template", "purity")


def oracle_sql() -> str:
    """The same for DuckDB, over pages."""
    fits = lambda r: f"when (host = '{r[0]}' or ends_with(host, '.{r[0]}')) and starts_with(path, '{r[1]}') then "
    ordered = sorted(RULES, key=lambda r: (-len(r[0] + r[1]), r[0] + r[1]))
    rule = " ".join(f"{fits(r)}'{r[0]}{r[1]}'" for r in ordered)
    verdict = " ".join(f"{fits(r)}'{r[2]}'" for r in ordered)
    pick = lambda k: f"case when n > 0 then g{k} when fn > 0 then f{k} else h{k} end"
    return f"""with recursive u as (select page_id, coalesce(case when instr(url, '://') > 0 then substr(url, instr(url, '://') + 3) else '' end, '') as rest from pages),
v as (select page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), '{UPPER}', '{LOWER}') as host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) as path from u),
w as (select *, case {rule} end as rule, case {verdict} end as given, string_split(regexp_replace(path, '[0-9]+', '#', 'g'), '/') as cut from v),
x as (select *, cut as parts from w),
t0 as (select 0 as d, host, parts, count(*) filter (where given = 'block') as blocked, count(rule) as labelled, parts as node from x group by host, parts),
deepest as (select max(len(parts)) as most from t0),
levels as (select * from t0 union all
  select l.d + 1, l.host, l.parts, l.blocked, l.labelled, case when c.host is not null and len(l.node) > l.d + 1 then list_concat(list_concat(l.node[1:l.d + 1], ['*']), l.node[l.d + 3:]) else l.node end
  from levels l left join (select host, prefix from (select distinct host, node[1:d + 1] as prefix, node[d + 2] as segment from levels where len(node) > d + 1) group by host, prefix having count(*) > {MOST_CHILDREN}) c
  on c.host = l.host and c.prefix = l.node[1:l.d + 1] where l.d < (select most from deepest)),
tree as (select host, parts, blocked, labelled, node from levels where d = (select most from deepest)),
nodes as (select host, node, node[1:greatest(len(node) - 1, 1)] as parent, cast(sum(blocked) as double) as b, cast(sum(labelled) as double) as n from tree group by host, node),
prior as (select *, lag(b) over o as b0, lag(n) over o as n0, array_to_string(node, '/') as name from nodes window o as (partition by host, parent order by n = 0, b / nullif(n, 0), array_to_string(node, '/'))),
apart as (select *, case when n = 0 and coalesce(n0, 0) > 0 or coalesce(abs(b / nullif(n, 0) - b0 / nullif(n0, 0)) / nullif(sqrt((b + b0) / nullif(n + n0, 0) * (1 - (b + b0) / nullif(n + n0, 0)) * (1 / nullif(n, 0) + 1 / nullif(n0, 0))), 0), 0) >= {Z_APART} then 1 else 0 end as apart from prior),
part as (select *, sum(apart) over (partition by host, parent order by n = 0, b / nullif(n, 0), name rows unbounded preceding) as part, sum(b) over (partition by host, parent) as fb, sum(n) over (partition by host, parent) as fn, sum(b) over (partition by host) as hb, sum(n) over (partition by host) as hn from apart),
met as (select *, sum(b) over (partition by host, parent, part) as gb, sum(n) over (partition by host, parent, part) as gn from part),
judged as (select host, node, name, {pick("b")} as jb, {pick("n")} as jn from met),
templates as (select t.host, t.parts, t.host || j.name as template, (jb + {SMOOTHING / 2}) / (jn + {SMOOTHING}) as purity, jn > 0 and (jb + {SMOOTHING / 2}) / (jn + {SMOOTHING}) >= {LEAST_PURITY} as reject from tree t join judged j on j.host = t.host and j.node = t.node)
select x.page_id, x.host, x.path, x.rule, coalesce(x.given, case when m.reject then 'block' else 'allow' end) as verdict, m.template, round(m.purity, 6) as purity from x left join templates m on m.host = x.host and m.parts = x.parts"""


def op7_url_filter(spark, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages").select("page_id", "url")).select("page_id", "host", "path", "rule", "verdict", "template", F.round("purity", 6).alias("purity"))
