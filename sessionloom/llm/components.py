"""Connected components of an edge table by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut_lineage, let_go


def _large_star(live: DataFrame) -> DataFrame:
    """Every larger neighbour of a vertex is tied to the least of the vertex and its neighbours."""
    both = live.select(F.col("u").alias("x"), F.col("v").alias("y")).union(live.select("v", "u"))
    least = both.groupBy("x").agg(F.min(F.least("x", "y")).alias("u"))
    return both.where("y > x").join(least, "x").select("u", F.col("y").alias("v")).distinct()


def _small_star(live: DataFrame) -> DataFrame:
    """A vertex and its smaller neighbours are tied to the least of these."""
    tied = live.join(live.groupBy("v").agg(F.min("u").alias("least")), "v")
    return tied.select(F.col("least").alias("u"), F.explode(F.array("u", "v")).alias("v")).where("u <> v").distinct()


def _stars_only(live: DataFrame) -> bool:
    """Whether every vertex hangs on one root, and no root on another vertex."""
    roles = live.select(F.col("v").alias("id"), F.lit(1).alias("hangs"), F.lit(0).alias("holds")).union(live.select("u", F.lit(0), F.lit(1)))
    met = roles.groupBy("id").agg(F.sum("hangs").alias("hangs"), F.sum("holds").alias("holds"))
    return not met.where("hangs > 1 or (hangs > 0 and holds > 0)").take(1)


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(id, component): the least id reachable, for every id in an edge of two ids. Edges may repeat, loop or point either way.

    Large-star and small-star steps alternate until only stars are left, a number of rounds that grows with the logarithm
    of the graph; a group of copies tied to one lead takes one round. No step adds edges, a vertex of any degree is met
    by partial sums and a join that Spark can split, and the state stays in checkpointed tables, never on the driver.
    """
    live = cut_lineage(edges.where(F.col(a) != F.col(b)).select(F.least(a, b).alias("u"), F.greatest(a, b).alias("v")).distinct())
    while not _stars_only(live):
        before, live = live, cut_lineage(_small_star(_large_star(live)))
        let_go(before)
    return live.select(F.col("v").alias("id"), F.col("u").alias("component")).union(live.select("u", "u").distinct())
