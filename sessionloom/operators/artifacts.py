"""Check of written artifacts: sections, citations, skills and stamps of whole texts, and their roll-up over trees.

An artifact is a row of path and content. What exists on disk is a table of paths, so that existence is an equi-join on
resolved paths; a folder of a known path exists as well. Links of a file system are not followed, ``.`` and ``..`` are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

#: Sections that a resumption needs, and bodies that hold nothing (in any case; in this case only).
REQUIRED = [
    "Scope", "Source citations", "Git state", "Completed work", "In-progress work", "Pending work", "Decisions made",
    "Gotchas encountered", "Validation commands", "Stop conditions", "Resume command", "/goal condition",
]
HOLLOW = ["", "(none)", "no scope provided", "(not recorded)"]
HOLLOW_LINES = ["- (none)"]
#: The stamp of a footer, a skill that was not found, a citation without a root.
STAMP = r"compiler=([0-9a-f]+)"
LOST_SKILL = r'<skill name="([^"]+)" missing="true"'
ROOTLESS = r"(?<![\w/.-])(evidence/[A-Za-z0-9_./-]+)"

_COUNTS = [
    "broken_citations", "prerequisite_citations", "empty_sections", "missing_sections", "unresolved_skill_refs",
    "missing_skill_bodies", "relative_evidence_refs", "checked_citations", "stale_stamps", "stamp_errors",
]


def resolved(path: Column) -> Column:
    """An absolute path without empty, ``.`` and ``..`` steps; what goes above the root stays at it."""
    def step(done: Column, part: Column) -> Column:
        up = F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0)))
        return F.when(part.isin("", "."), done).when(part == "..", up).otherwise(F.concat(done, F.array(part)))

    return F.concat(F.lit("/"), F.array_join(F.aggregate(F.split(path, "/"), F.array().cast("array<string>"), step), "/"))


def existing(paths: DataFrame) -> DataFrame:
    """Each path of ``path`` and every folder above it, once, resolved."""
    parts = F.split(resolved(F.col("path")), "/")
    upto = F.transform(F.sequence(F.lit(2), F.greatest(F.size(parts), F.lit(2))), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))
    return paths.where(F.col("path").startswith("/")).select(F.explode(upto).alias("at")).distinct()


def evidence_root(path: Column) -> Column:
    """The evidence folder beside the artifact's folder ``prompts``; null elsewhere, so that nothing is exempt there."""
    found = F.regexp_extract(path, r"^(.*)/prompts/[^/]+$", 1)
    return F.when(path.rlike(r"^.*/prompts/[^/]+$"), resolved(F.concat(found, F.lit("/evidence"))))


def check(artifacts: DataFrame, known: DataFrame, stamps: DataFrame) -> DataFrame:
    """One row per path: kind, counts and lists of what was found, and ok.

    artifacts: path, content, other columns are left out; known: path; stamps: kind, stamp. Paths are keys: rows that repeat
    one count once, null paths go, a null content is an empty text. A kind without a stamp cannot be vouched for and fails.
    Citations of what lies under the artifact's own evidence folder are exempt, as its first step makes them.
    """
    text = F.coalesce("content", F.lit(""))
    kind = F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"(?<=.)\.[^.]*$", "")
    read = artifacts.where("path is not null").select("path", kind.alias("kind"), text.alias("t"), T.without_skills(text).alias("b"), evidence_root(F.col("path")).alias("root"))
    cited = F.transform(T.absolute_paths(F.col("b")), lambda p: F.struct(p.alias("p"), resolved(p).alias("at")))
    exempt = lambda c: F.coalesce((c["at"] == F.col("root")) | c["at"].startswith(F.concat("root", F.lit("/"))), F.lit(False))
    titles = F.col("s")["title"]
    need = F.when(F.col("kind") == "resumption", F.array(*map(F.lit, REQUIRED))).otherwise(F.array().cast("array<string>"))
    body = lambda name: F.element_at(F.filter("s", lambda x: x["title"] == name), -1)["body"]  # noqa: E731  the last of a title counts
    hollow = lambda b: F.lower(b).isin(*HOLLOW) | b.isin(*HOLLOW_LINES)
    facts = read.withColumns({"s": T.sections(F.col("t")), "c": cited}).select(
        "path", "kind",
        F.size(F.array_distinct(titles)).alias("sections_found"),
        F.filter(need, lambda n: ~F.array_contains(titles, n)).alias("missing"),
        F.filter(need, lambda n: F.array_contains(titles, n) & hollow(body(n))).alias("hollow"),
        F.size("c").alias("checked_citations"),
        F.size(F.filter("c", exempt)).alias("prerequisite_citations"),
        F.filter("c", lambda c: ~exempt(c)).alias("c"),
        F.size(T.skill_references(F.col("t"))).alias("unresolved_skill_refs"),
        F.regexp_extract_all("t", F.lit(LOST_SKILL), F.lit(1)).alias("lost_skills"),
        F.size(F.regexp_extract_all("b", F.lit(ROOTLESS), F.lit(1))).alias("relative_evidence_refs"),
        F.nullif(F.regexp_extract("t", STAMP, 1), F.lit("")).alias("found_stamp"),
    )
    kept = [c for c in facts.columns if c not in ("path", "c")]
    spread = facts.select("path", F.struct(*kept).alias("facts"), F.posexplode_outer("c").alias("k", "c")).select("path", "facts", "k", "c.p", "c.at")
    met = spread.join(existing(known).withColumn("there", F.lit(True)), "at", "left")
    lost = F.collect_set(F.when(F.col("p").isNotNull() & F.col("there").isNull(), F.struct("k", "p")))
    per = met.groupBy("path").agg(F.any_value("facts").alias("f"), F.transform(F.array_sort(lost), lambda x: x["p"]).alias("broken")).select("path", "f.*", "broken")
    expected = stamps.groupBy("kind").agg(F.max("stamp").alias("expected_stamp"))
    stale = F.coalesce(F.col("found_stamp") != F.col("expected_stamp"), F.lit(True))
    told = per.join(expected, "kind", "left").withColumns({
        "broken_citations": F.size("broken"), "empty_sections": F.size("hollow"), "missing_sections": F.size("missing"), "missing_skill_bodies": F.size("lost_skills"),
        "stale_stamps": stale.cast("int"), "stamp_errors": F.col("expected_stamp").isNull().cast("int"),
    })
    faults = sum((F.col(c) for c in _COUNTS if c not in ("prerequisite_citations", "checked_citations", "stamp_errors")), F.lit(0))
    return told.withColumn("ok", faults == 0)


def tree(checked: DataFrame, root: Column) -> DataFrame:
    """Ten sums, artifacts, failing ones and the verdict, per root and over all (root null) in one pass of grouping sets.

    A tree without artifacts fails, so the row over all is there for an empty table too. Names are rows of ``lost_names``,
    failing artifacts rows of ``check``: no list grows with a tree.
    """
    rows = checked.select(root.alias("root"), F.lit(1).alias("n"), (~F.col("ok")).cast("int").alias("bad"), *_COUNTS)
    none = checked.sparkSession.range(1).select(F.lit(None).cast("string").alias("root"), *[F.lit(0).alias(c) for c in rows.columns[1:]])
    total = lambda c, name: F.sum(c).alias(name)
    found = rows.union(none).groupingSets([["root"], []], "root").agg(F.grouping_id().alias("level"), total("n", "artifact_count"), total("bad", "failing"), *[total(c, c) for c in _COUNTS])
    passed = (F.col("artifact_count") > 0) & (F.col("failing") == 0)
    return found.where("level = 1 or root is not null").drop("level").withColumn("verdict", F.when(passed, "PASS").otherwise("FAIL"))


def lost_names(checked: DataFrame, root: Column) -> DataFrame:
    """root, name: each skill without a body once a tree."""
    return checked.select(root.alias("root"), F.explode("lost_skills").alias("name")).distinct()
