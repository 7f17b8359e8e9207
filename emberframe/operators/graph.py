"""Connected components of an edge table, by rounds of large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberframe.sources.shared import looked_up, stored


def _star(neighbours: DataFrame, total: int, both: bool) -> DataFrame:
    """Links (u, v) to links of v with the smallest of u's neighbourhood. The minimum is aggregated and then looked up, for
    a hub in a broadcast table, so a hub's links never meet in one task."""
    least = stored(neighbours.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).withColumn("m", F.least("u", "m")), "components-least")
    linked = looked_up(neighbours, least, "u", "n", total)
    if both:  # small star: v <= u; u itself is linked as well
        own = least.filter("u <> m").select(F.col("u").alias("a"), F.col("m").alias("b"))
        return linked.filter("v <> m").select(F.col("v").alias("a"), F.col("m").alias("b")).unionByName(own)
    return linked.filter("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root): for each node of an edge, the smallest node that it reaches. Loops and repeated edges do no harm;
    edges with a null end are left out. Rounds go on until every component is a star around its smallest node. Every round is
    written to the shared folder, which cuts the lineage."""
    ends = edges.select(F.col(a).alias("x"), F.col(b).alias("y")).filter("x <> y")
    state = stored(ends.select(F.greatest("x", "y").alias("a"), F.least("x", "y").alias("b")).distinct(), "components")
    while not _stars(state):
        n = state.count()
        sym = state.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(state.select(F.col("b").alias("u"), F.col("a").alias("v")))
        large = stored(_star(sym, 2 * n, both=False).filter("a <> b").distinct(), "components")
        small = _star(large.select(F.col("a").alias("u"), F.col("b").alias("v")), n, both=True).filter("a <> b").distinct()
        state = stored(small, "components")
    roots = state.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return state.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots)


def _stars(state: DataFrame) -> bool:
    """Whether each larger end has one smaller end, which is no larger end itself."""
    ends = state.select(F.col("a").alias("x"), F.lit(1).alias("larger"), F.lit(0).alias("smaller")).unionByName(state.select(F.col("b").alias("x"), F.lit(0).alias("larger"), F.lit(1).alias("smaller")))
    return ends.groupBy("x").agg(F.sum("larger").alias("larger"), F.max("smaller").alias("smaller")).filter("larger > 1 OR (larger > 0 AND smaller > 0)").isEmpty()
