"""Store folders' names back to paths: a name is a path with - for /, read against the folders that are known.

A walk from the root takes at each step the longest known child that the name goes on with, so hyphens inside a folder's
name are kept where such a folder is known. All names walk at once: their possible next children meet the known folders in
an equi-join on the whole path, never children by children of a folder. What no known folder goes on with is one last name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.plan import written_once

#: Steps of a walk, the form of names that hold a digest and no path, and the prefix for the scratch folder.
MOST_STEPS = 128
DIGEST_FORM = r"^home-.+-[0-9a-f]{64}$"
SCRATCH, SCRATCH_PATH = "--private-tmp", "/tmp"


def ancestors(paths: DataFrame, column: str = "path") -> DataFrame:
    """path: the folders of absolute paths and all folders above them, without the root."""
    parts = F.filter(F.split(column, "/"), lambda p: p != "")
    above = F.transform(F.sequence(F.lit(1), F.size("parts")), lambda k: F.concat(F.lit("/"), F.array_join(F.slice("parts", 1, k), "/")))
    kept = paths.where(F.col(column).startswith("/")).select(parts.alias("parts")).where(F.size("parts") > 0)
    return kept.select(F.explode(above).alias("path")).distinct()


def _body(rest: Column) -> Column:
    return F.regexp_replace(rest, "^-", "")


def _children(dots: bool) -> Column:
    """Candidates (n: length of the part taken, plain before dotted; child; rest), for a column ``body``."""
    body, n = F.col("body"), F.length("body")
    ends = F.filter(F.sequence(F.lit(1), n), lambda i: (i == n) | (body.substr(i + 1, F.lit(1)) == "-"))
    one = lambda i, child, rank: F.struct(i.alias("n"), F.lit(rank).alias("rank"), child.alias("child"), body.substr(i + 1, n).alias("rest"))
    taken = lambda i: body.substr(F.lit(1), i)
    dotted = lambda i: F.when(taken(i).startswith("-"), F.concat(F.lit("."), F.substring(taken(i), F.lit(2), i))).when(~taken(i).startswith("."), F.concat(F.lit("."), taken(i)))
    both = lambda i: F.array(one(i, taken(i), 1), one(i, dotted(i), 0)) if dots else F.array(one(i, taken(i), 1))
    return F.filter(F.flatten(F.transform(ends, both)), lambda c: c["child"].isNotNull() & ~c["child"].isin("", ".", ".."))


def decode(names: DataFrame, folders: DataFrame, layout: str = "claude", home: str = "") -> DataFrame:
    """Adds path and malformed to distinct names (column ``name``). layout: claude (from the root, dots may be dropped) or omp
    (under ``home``, or the scratch folder). A name that holds no path gives ''; one whose last part could leave the folder
    that was reached (.., or with a separator) is malformed and gives ''."""
    name = F.col("name")
    if layout == "claude":
        begin, rest = F.lit(""), F.when(name.startswith("-"), name).otherwise(F.concat(F.lit("-"), name))
    else:
        inner = F.regexp_replace(F.regexp_replace(F.substring(name, F.lit(len(SCRATCH) + 1), F.length(name)), "--$", ""), "^-+", "")
        scratch = name.startswith(SCRATCH)
        begin = F.when(scratch, SCRATCH_PATH).otherwise(home)
        rest = F.concat(F.lit("-"), F.when(scratch, inner).otherwise(_body(name)))
    live = names.select("name", begin.alias("at"), rest.alias("rest")).where("name is not null").distinct()
    if layout != "claude":
        live = live.where(~name.rlike(DIGEST_FORM))
    folders, done = folders.select(F.col("path").alias("next")).distinct(), []
    for _ in range(MOST_STEPS):
        tried = live.withColumn("body", _body(F.col("rest"))).withColumn("c", F.explode_outer(F.when(F.length("body") > 0, _children(layout == "claude"))))
        met = tried.withColumn("next", F.concat("at", F.lit("/"), "c.child")).join(folders.withColumn("known", F.lit(True)), "next", "left")
        best = F.max(F.when(F.col("known"), F.struct("c.n", "c.rank", F.col("next").alias("at"), F.col("c.rest").alias("rest")))).alias("b")
        step = written_once(met.groupBy("name", "at", "rest").agg(best))
        done.append(step.where("b is null").select("name", "at", F.col("rest")))
        live = step.where("b is not null").select("name", "b.at", "b.rest")
        if live.isEmpty():
            break
    walked = done[0]
    for part in done[1:]:
        walked = walked.union(part)
    leaf = _body(F.col("rest"))
    bad = leaf.isin(".", "..") | leaf.contains("/") | leaf.contains("\\")
    path = F.when(leaf == "", F.when(F.col("at") == "", "/").otherwise(F.col("at"))).otherwise(F.concat("at", F.lit("/"), leaf))
    found = walked.select("name", F.when(bad, "").otherwise(path).alias("path"), bad.alias("malformed"))
    opaque = names.where(name.rlike(DIGEST_FORM)).select("name", F.lit("").alias("path"), F.lit(False).alias("malformed")).distinct()
    return found if layout == "claude" else found.union(opaque)
