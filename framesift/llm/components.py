"""Connected components of an edge table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framesift.session import save_table


def is_star_forest(edges: DataFrame) -> bool:
    """Every node hangs on one other that hangs on none: then each star is a component.

    One pass with one exchange: each edge is counted at its two ends.
    """
    hangs = edges.select(F.col("a").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down"))
    holds = edges.select(F.col("b").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down"))
    ends = hangs.unionByName(holds).groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return not ends.filter("up > 1 OR (up = 1 AND down = 1)").head(1)


def merged(known: DataFrame | None, links: DataFrame) -> DataFrame:
    """(node, component) after adding ``links`` (a, b) to the components known so far, stored.

    Only components are linked anew, so groups that are joined already cost nothing.
    """
    if known is None:
        return save_table(connected_components(links), "components")
    for end in ("a", "b"):
        of = known.select(F.col("node").alias(end), F.col("component").alias(f"_{end}"))
        links = links.join(of, end, "left").withColumn(end, F.coalesce(f"_{end}", end)).drop(f"_{end}")
    new = save_table(connected_components(links.select("a", "b")), "components")
    moved = new.select(F.col("node").alias("component"), F.col("component").alias("_to"))
    old = known.join(moved, "component", "left").select("node", F.coalesce("_to", "component").alias("component"))
    return save_table(old.unionByName(new.join(known.select("node"), "node", "left_anti")), "components")


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component) of every node of ``edges`` (a, b); component is its smallest node.

    Each round hangs the neighbours of a node onto the smallest of them, first the larger ones,
    then the smaller ones, and stores the result in the shared folder. Minima are combined
    before the shuffle; rows meet the minimum of a hub in a join that adaptive execution splits.
    The number of rounds grows with the logarithm of the longest path. Loops and nulls are dropped.
    """
    now = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    now = save_table(now.filter("a > b").distinct(), "edges")
    for _ in range(max_rounds):
        if is_star_forest(now):
            break
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("low"))
        low = low.select("a", F.least("a", "low").alias("low"))
        large = both.filter("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("low").alias("b"))
        large = large.filter("a > b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("low"))
        small = large.join(low, "a").filter("b > low").select(F.col("b").alias("a"), F.col("low").alias("b"))
        now = save_table(small.unionByName(low.select("a", F.col("low").alias("b"))).distinct(), "edges")
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = now.select(F.col("b").alias("node")).distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
        roots.select("node", F.col("node").alias("component"))
    )
