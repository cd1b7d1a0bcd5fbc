"""Cost, cadence, spend, efficacy and source rollups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def cost_rollup(linked: DataFrame) -> DataFrame:
    """Requests and cost per project, per tier and in all, in one pass of grouping sets."""
    rows = linked.select(F.coalesce("project_path", F.lit("(unattributed)")).alias("project"), F.coalesce("tier", F.lit(0)).alias("tier"), "cost")
    return rows.groupingSets([["project"], ["tier"], []], "project", "tier").agg(F.grouping_id().alias("level"), F.count("*").alias("requests"), F.round(F.sum("cost"), 4).alias("cost_usd"))


def _cell(v: Column, an_octave: int = 64) -> Column:
    """A number that never falls as a value grows: parts of an octave, on both sides of 0. Values of a cell are alike."""
    away = F.floor(F.log2(F.abs(v)) * an_octave) + 1200 * an_octave
    return F.when(v == 0, F.lit(0)).otherwise(F.signum(v).cast("long") * away)


def exclusive_deciles(rows: DataFrame, key: str, value: str, p: float = 0.9) -> DataFrame:
    """key, n, total, p50 (median) and the quantile at p (n + 1), for ten values or more, else the maximum.

    Equal values are counted first and the counts summed by cells of the value; running counts over a key's cells find those
    in which the wanted places lie, and only their values are ordered, each cell by itself. So no key's values meet in one task.
    Nulls count as nothing, a key of nulls alone has no row.
    """
    counts = rows.where(F.col(value).isNotNull()).groupBy(key, F.col(value).cast("double").alias("v")).agg(F.count("*").alias("c")).withColumn("cell", _cell(F.col("v")))
    cells = counts.groupBy(key, "cell").agg(F.sum("c").alias("held"), F.sum(F.col("v") * F.col("c")).alias("part"), F.max("v").alias("top"))
    own = Window.partitionBy(key)
    placed = cells.select(
        key, "cell", "held", F.sum("held").over(own.orderBy("cell")).alias("upto"), F.sum("held").over(own).alias("n"), F.sum("part").over(own).alias("total"), F.max("top").over(own).alias("largest"),
    )
    pos = F.lit(p) * (F.col("n") + 1)
    k = F.greatest(F.least(F.floor(pos), F.col("n") - 1), F.lit(1))
    places = F.array(k, F.least(k + 1, F.col("n")), F.floor((F.col("n") + 1) / 2), F.floor((F.col("n") + 2) / 2))
    before = F.col("upto") - F.col("held")
    wanted = placed.withColumn("places", places).where(F.exists("places", lambda x: (x > before) & (x <= F.col("upto")))).select(key, "cell", before.alias("before"), "n", "total", "largest", "places", (pos - k).alias("share"))
    inside = counts.join(wanted, [key, "cell"]).withColumn("high", F.col("before") + F.sum("c").over(Window.partitionBy(key, "cell").orderBy("v")))
    at = lambda j: F.max(F.when((F.col("high") >= F.col("places")[j]) & (F.col("high") - F.col("c") < F.col("places")[j]), F.col("v")))
    found = inside.groupBy(key).agg(*[F.max(c).alias(c) for c in ("n", "total", "largest", "share")], *[at(j).alias(name) for j, name in enumerate(("low", "up", "m1", "m2"))])
    inner = F.col("low") + F.col("share") * (F.col("up") - F.col("low"))
    return found.select(key, "n", "total", ((F.col("m1") + F.col("m2")) / 2).alias("p50"), F.when(F.col("n") >= 10, inner).otherwise(F.col("largest")).alias("quantile"))


#: How sure a link is; requests without a word for it are unknown.
CONFIDENCES = ["exact", "high", "medium", "unknown"]


def project_costs(projects: DataFrame, linked: DataFrame, episodes: DataFrame) -> DataFrame:
    """Per project its cost, requests, sessions, cost per complete episode (0 without one) and requests by confidence.

    projects: project; linked: project, session, cost, confidence; episodes: project, status. Every project has a row, also
    one without requests; a null cost is 0; requests of a project that is not listed are left out.
    """
    sure = F.coalesce(F.nullif("confidence", F.lit("")), F.lit("unknown"))
    spent = linked.where("project is not null").groupBy("project").agg(F.sum("cost").alias("cost"), F.count("*").alias("requests"), F.count_distinct("session").alias("sessions"), *[F.count_if(sure == c).alias(c) for c in CONFIDENCES])
    done = episodes.where("status = 'complete'").groupBy("project").agg(F.count("*").alias("complete"))
    met = projects.select("project").distinct().join(spent, "project", "left").join(done, "project", "left").na.fill(0)
    mix = F.map_filter(F.create_map(*[x for c in CONFIDENCES for x in (F.lit(c), F.col(c))]), lambda _, n: n > 0)
    return met.select("project", F.col("cost").alias("total_usd"), "requests", "sessions", F.when(F.col("complete") > 0, F.col("cost") / F.col("complete")).otherwise(0.0).alias("per_complete_usd"), mix.alias("confidence"))


def cost_summary(costs: DataFrame) -> DataFrame:
    """Total, median, ninth exclusive decile (the largest below ten projects) and count of project totals; zeros without one."""
    one = costs.select(F.lit(1).alias("all"), "total_usd")
    found = exclusive_deciles(one, "all", "total_usd").select("n", "total", "p50", "quantile")
    none = costs.sparkSession.range(1).select(F.lit(0).cast("long").alias("n"), *[F.lit(0.0).alias(c) for c in ("total", "p50", "quantile")])
    return found.union(none).agg(F.max_by(F.struct("total", "p50", "quantile", "n"), "n").alias("s")).select(F.col("s.total").alias("total_usd"), F.col("s.p50").alias("p50_usd"), F.col("s.quantile").alias("p90_usd"), F.col("s.n").alias("project_count"))


def source_overview(counts: DataFrame, marks: DataFrame, rows: DataFrame, now_ms: int) -> DataFrame:
    """What is known of each source from three sides: records of the latest run, watermark, cadence baseline.

    counts: source_id, records; marks: source_id, last_ms; rows: source_id, median_gap_ms, sample_size (a source once in each).
    A source of any side has a row. A baseline that was never computed has no word, one without a gap too little data.
    """
    met = counts.join(marks, "source_id", "full_outer").join(rows.select("source_id", "median_gap_ms", F.lit(True).alias("computed")), "source_id", "full_outer")
    judged = cadence_status(met.withColumn("watermark_ms", F.coalesce("last_ms", F.lit(0))), now_ms)
    n = F.coalesce("records", F.lit(0))
    return judged.select("source_id", (n > 0).alias("available"), n.alias("record_count"), F.when(n <= 0, "no records in window").alias("error"), F.col("last_ms").isNotNull().alias("ever_ingested"), F.when(F.col("computed"), F.col("cadence")).alias("cadence"))


def gaps(rows: DataFrame, key: str, at: str, tie: str, cell_ms: int = 86_400_000) -> DataFrame:
    """Each row with the time since the row before it of its key. Rows are ordered within cells of time; the last stamp of
    the cell before is carried over the border, so a key of many rows is spread over its cells."""
    celled = rows.withColumn("cell", F.floor(F.col(at) / cell_ms))
    border = celled.groupBy(key, "cell").agg(F.max(at).alias("last")).withColumn("carried", F.lag("last").over(Window.partitionBy(key).orderBy("cell"))).drop("last")
    inside = celled.withColumn("before", F.lag(at).over(Window.partitionBy(key, "cell").orderBy(at, tie)))
    return inside.join(border, [key, "cell"]).withColumn("gap", F.col(at) - F.coalesce("before", "carried")).drop("cell", "before", "carried")


def cadence(stamps: DataFrame, key: str = "source_id", newest: int = 200, least: int = 20) -> DataFrame:
    """Median gap of the newest distinct time stamps; null for few stamps or a gap of 0. The rank is taken on distinct stamps."""
    top = Window.partitionBy(key).orderBy(F.desc("ms"))
    kept = stamps.select(key, "ms").distinct().withColumn("rank", F.row_number().over(top)).where(F.col("rank") <= newest)
    gaps = kept.withColumn("gap", F.col("ms") - F.lag("ms").over(Window.partitionBy(key).orderBy("ms")))
    median = F.median("gap").cast("long")
    return gaps.groupBy(key).agg(F.when((F.count("*") >= least) & (median > 0), median).alias("median_gap_ms"), F.count("*").alias("sample_size"), F.max("ms").alias("watermark_ms"))


def cadence_status(rows: DataFrame, now_ms: int, k: int = 8) -> DataFrame:
    age = F.lit(now_ms) - F.col("watermark_ms")
    status = F.when(F.col("median_gap_ms").isNull(), "insufficient data").when(age > k * F.col("median_gap_ms"), "stale").otherwise("ok")
    return rows.withColumn("cadence", status)


def spend_gate(spends: DataFrame, key: str, order: str, cost: str, cap: float, cell: int = 4096) -> DataFrame:
    """Whether each spend was admitted, with what the spends made before it left of the cap.

    What is left must cover the largest spend made, and be positive; the first rule is asked first. A refused spend is not
    made, so nothing changes after the first refusal and all that follow have its answer. Sums run within cells of the
    order and are carried from cell to cell.
    """
    celled = spends.withColumn("cell", F.floor(F.col(order) / cell))
    cells = celled.groupBy(key, "cell").agg(F.sum(cost).alias("spent"), F.max(F.when(F.col(cost) > 0, F.col(cost))).alias("top"))
    earlier = Window.partitionBy(key).orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    carried = cells.select(key, "cell", F.coalesce(F.sum("spent").over(earlier), F.lit(0.0)).alias("spent0"), F.max("top").over(earlier).alias("top0"))
    w = Window.partitionBy(key, "cell").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    inside = celled.withColumn("spent1", F.coalesce(F.sum(cost).over(w), F.lit(0.0))).withColumn("top1", F.max(F.when(F.col(cost) > 0, F.col(cost))).over(w))
    raw = inside.join(carried, [key, "cell"]).withColumn("left", F.round(F.lit(cap) - F.col("spent0") - F.col("spent1"), 4)).withColumn("largest", F.greatest("top0", "top1"))
    refusal = F.when(F.col("left") < F.col("largest"), "cap_insufficient_remaining").when(F.col("left") <= 0, "cap_reached")
    judged = raw.withColumn("refusal", refusal)
    first = judged.where("refusal is not null").groupBy(key).agg(F.min(F.struct(F.col(order).alias("at"), F.col("left").alias("left"), "refusal")).alias("first"))
    after = F.coalesce(F.col(order) >= F.col("first.at"), F.lit(False))
    met = judged.join(first, key, "left")
    return met.select(key, order, F.when(after, F.col("first.left")).otherwise(F.col("left")).alias("remaining"), F.when(after, F.col("first.refusal")).otherwise("admitted").alias("reason"))


def admission(spent: DataFrame, per_run: float, daily_cap: float | None, monthly_cap: float | None) -> DataFrame:
    """daily, monthly: what was spent. A run is admitted only where its whole cap still fits; the daily reason wins."""
    over = lambda column, cap: F.lit(cap is not None and cap > 0) & (F.col(column) + per_run > F.lit(cap or 0.0))
    reason = F.when(over("daily", daily_cap), "agent_skipped_cumulative_cap_daily").when(over("monthly", monthly_cap), "agent_skipped_cumulative_cap_monthly")
    left = lambda column, cap: F.round(F.greatest(F.lit(cap) - F.col(column), F.lit(0.0)), 4)
    return spent.withColumn("reason", reason).withColumn("daily_left", left("daily", daily_cap)).withColumn("monthly_left", left("monthly", monthly_cap))


MARKER = r"-prompt:v(\d+):([0-9a-f]{6,})"


def markers(text: Column) -> Column:
    """All marker digests in a text."""
    return F.regexp_extract_all(text, F.lit(MARKER), F.lit(2))


def efficacy(artifacts: DataFrame, turns: DataFrame, completed: DataFrame) -> DataFrame:
    """Per type: artifacts, those whose marker a turn holds, by harness, and whether their project completed after use.

    artifacts: kind, project, content; turns: source_id, text; completed: project. Markers are extracted from both sides
    and met by an equi-join. What was never seen is not observed, never failed.
    """
    emitted = artifacts.select("kind", "project", F.explode(markers(F.col("content"))).alias("marker"))
    emitted = emitted.groupBy("marker").agg(F.max(F.struct("kind", "project")).alias("a")).select("marker", "a.*")
    seen = turns.where(F.col("text").contains("-prompt:v")).select("source_id", F.explode(markers(F.col("text"))).alias("marker")).distinct()
    uses = seen.groupBy("marker").agg(F.array_sort(F.collect_set("source_id")).alias("harnesses"))
    met = emitted.join(uses, "marker", "left").join(completed.select("project").distinct().withColumn("complete", F.lit(True)), "project", "left")
    used = F.col("harnesses").isNotNull()
    done = F.coalesce("complete", F.lit(False))
    per = met.groupBy("kind").agg(F.count("*").alias("total"), F.count_if(used).alias("observed"), F.count_if(~used).alias("not_observed"), F.count_if(used & done).alias("completed_after_use"), F.count_if(used & ~done).alias("unresolved_after_use"))
    each = met.where(used).select("kind", F.explode("harnesses").alias("h")).groupBy("kind", "h").agg(F.count("*").alias("n"))
    named = each.groupBy("kind").agg(F.array_join(F.array_sort(F.collect_list(F.concat_ws(":", "h", "n"))), ",").alias("harnesses"))
    return per.join(named, "kind", "left").withColumn("observation_rate", F.round(F.try_divide("observed", "total"), 4)).withColumn("harnesses", F.coalesce("harnesses", F.lit("")))
