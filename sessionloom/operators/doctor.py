"""Diagnosis of a store: named audits, each a count of faults over a whole table, with verdict and exit code as rows.

Audits of one table are sums of one pass over it; where texts are searched, rows are dealt to all cores first. An audit that
had nothing to look at is skipped, which is not passed: the exit code is 0 only where every audit ran and found nothing, 1
where one failed, 2 where none failed but one could not run.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.plan import dealt
from ..functions.text import leaks, relative_evidence, skill_references
from . import bundle

#: A script, style or picture that a page takes from another place.
EXTERNAL = r"""(?:src|href)\s*=\s*["'](?:https?:)?//"""


@dataclass
class Audit:
    """id, what it holds to, and the faults of a row as a number (null counts as none)."""

    id: str
    requirement: str
    faults: Column


@dataclass
class Subject:
    """A table with the audits that look at it; rows are named by ``name`` in the example that a failed audit gives."""

    rows: DataFrame
    name: str
    audits: list[Audit] = field(default_factory=list)


def orphans(rows: DataFrame, owners: DataFrame, key: str, name: str, audit: str, requirement: str) -> Subject:
    """Rows whose owner is not there."""
    known = owners.select(key).distinct().withColumn("_there", F.lit(1))
    return Subject(rows.join(known, key, "left"), name, [Audit(audit, requirement, F.when(F.col("_there").isNull(), 1))])


def repeated(rows: DataFrame, key: str, audit: str, requirement: str) -> Subject:
    """Ids that occur more than once."""
    return Subject(rows.groupBy(key).agg(F.count("*").alias("_n")), key, [Audit(audit, requirement, F.col("_n") - 1)])


def records(rec: DataFrame, sources: list[str], types: list[str]) -> Subject:
    """Records as every connector must give them."""
    bad = ~F.coalesce(F.col("source_id").isin(sources) & F.col("record_type").isin(types) & (F.col("timestamp_ms") > 0), F.lit(False))
    return Subject(rec, "native_id", [Audit("R1-1", "connector conformance", bad.cast("int"))])


def artifacts(rows: DataFrame, name: str, text: str) -> Subject:
    """Prompts that were made: citations from the root, no skill left unresolved, no secret."""
    c = F.col(text)
    return Subject(dealt(rows, name), name, [Audit("R6f-1", "no unresolved skill references", F.size(skill_references(c))), Audit("R6g-1", "absolute evidence paths", F.size(relative_evidence(c))), Audit("N4-1", "no secrets persisted", leaks(c).cast("int"))])


def bundles(rows: DataFrame, name: str, page: str, needles: list[str], homes: list[str]) -> Subject:
    """Exported pages: no canary, no home folder in any spelling, nothing taken from elsewhere."""
    c = F.col(page)
    return Subject(dealt(rows, name), name, [Audit("R14b-1", "bundle hygiene: no canary or home path", bundle.leaks(c, needles, homes).cast("int")), Audit("R14b-2", "bundle hygiene: no external assets", F.regexp_count(c, F.lit(EXTERNAL)))])


def formats(health: DataFrame) -> Subject:
    """Files by their health (see stores.file_health)."""
    return Subject(health, "source_file", [Audit("I2-1", "source format health", (F.col("outcome") == "drifted").cast("int"))])


def _found(subject: Subject) -> DataFrame:
    sums = [F.count("*").alias("scanned")]
    for k, audit in enumerate(subject.audits):
        n = F.coalesce(audit.faults.cast("bigint"), F.lit(0).cast("bigint"))
        sums += [F.coalesce(F.sum(n), F.lit(0)).alias(f"n{k}"), F.min(F.when(n > 0, F.col(subject.name).cast("string"))).alias(f"e{k}")]
    rows = F.array(*[F.struct(F.lit(a.id).alias("check"), F.lit(a.requirement).alias("requirement"), F.col(f"n{k}").alias("faults"), F.col(f"e{k}").alias("example")) for k, a in enumerate(subject.audits)])
    return subject.rows.agg(*sums).select("scanned", F.explode(rows).alias("a")).select("a.check", "a.requirement", "scanned", "a.faults", "a.example")


def report(subjects: list[Subject]) -> DataFrame:
    """check, requirement, scanned, faults, example (the least name of a row at fault), verdict, exit_code of the whole."""
    found = _found(subjects[0])
    for subject in subjects[1:]:
        found = found.unionByName(_found(subject))
    verdict = F.when(F.col("faults") > 0, "FAIL").when(F.col("scanned") == 0, "SKIP").otherwise("PASS")
    told = found.withColumn("verdict", verdict)
    code = told.agg(F.when(F.count_if(F.col("verdict") == "FAIL") > 0, 1).when(F.count_if(F.col("verdict") == "SKIP") > 0, 2).otherwise(0).alias("exit_code"))
    return told.crossJoin(code)  # one row
