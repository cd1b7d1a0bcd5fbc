"""Finding states for every run at once, derived from the ledger of runs and observations."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def predecessors(analysed: DataFrame) -> DataFrame:
    """(run, project, prev): the latest earlier run that analysed the project; equal runs are no predecessors."""
    w = Window.partitionBy("project").orderBy("run").rangeBetween(Window.unboundedPreceding, -1)
    return analysed.select("run", "project", F.max("run").over(w).alias("prev"))


def states(analysed: DataFrame, observed: DataFrame) -> DataFrame:
    """(run, project, finding, state): new, persisting, resolved, regressed or dismissed."""
    runs = predecessors(analysed)
    now = observed.join(runs, ["run", "project"])
    before = observed.select(F.col("run").alias("prev"), "finding", F.col("resolved").alias("prev_resolved"))
    first = observed.groupBy("finding", "project").agg(F.min("run").alias("first_run"))
    joined = now.join(before, ["prev", "finding"], "left").join(first, ["finding", "project"])
    seen = F.col("prev_resolved").isNotNull()
    was = F.coalesce("prev_resolved", F.lit(False)) | (~seen & (F.col("first_run") < F.col("run")))
    state = (
        F.when(F.col("prev").isNull(), F.when(F.col("resolved"), "resolved").otherwise("new"))
        .when(F.col("resolved"), F.when(was, "dismissed").otherwise("resolved"))
        .when(was, "regressed").when(seen, "persisting").otherwise("new")
    )
    current = joined.select("run", "project", "finding", state.alias("state"))
    gone = runs.join(observed.select(F.col("run").alias("prev"), "project", "finding"), ["prev", "project"]).join(observed, ["run", "finding"], "left_anti")
    return current.union(gone.select("run", "project", "finding", F.lit("resolved").alias("state")))


def metrics(found: DataFrame, findings: DataFrame, by: str) -> DataFrame:
    """Per category or severity: events, regression rate after a resolution, open findings, mean runs to the first resolution."""
    w = Window.partitionBy("finding").orderBy("run")
    steps = found.withColumn("following", F.lead("state").over(w)).withColumn("step", F.row_number().over(w))
    per = steps.groupBy("finding").agg(
        F.count("*").alias("events"),
        F.count_if(F.col("state") == "resolved").alias("resolved"),
        F.count_if((F.col("state") == "resolved") & (F.col("following") == "regressed")).alias("regressed"),
        F.max_by("state", "run").alias("last"),
        F.min("run").alias("first_run"),
        F.min(F.when(F.col("state") == "resolved", F.col("run"))).alias("resolved_run"),
    )
    return per.join(findings, "finding").groupBy(by).agg(
        F.sum("events").alias("events"),
        F.round(F.try_divide(F.sum("regressed"), F.sum("resolved")), 4).alias("regression_rate"),
        F.count_if(F.col("last").isin("new", "persisting", "regressed")).alias("open_count"),
        F.median(F.col("resolved_run") - F.col("first_run")).alias("ttr_median"),
    )


def asof(events: DataFrame, facts: DataFrame, key: str, at: str, value: str) -> DataFrame:
    """Each event with the value of the newest fact of its key strictly before it (null where there is none)."""
    e = events.select(key, F.col(at).alias("at"), F.lit(1).alias("is_event"), F.lit(None).cast(facts.schema[value].dataType).alias("value"))
    f = facts.select(key, F.col(at).alias("at"), F.lit(0).alias("is_event"), F.col(value).alias("value"))
    w = Window.partitionBy(key).orderBy("at").rangeBetween(Window.unboundedPreceding, -1)
    both = e.union(f).withColumn("latest", F.max(F.when(F.col("is_event") == 0, F.struct("at", "value"))).over(w))
    return both.where("is_event = 1").select(key, F.col("at").alias(at), F.col("latest.value").alias(value))
