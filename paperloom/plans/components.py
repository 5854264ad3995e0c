"""Connected components by alternating large-star and small-star passes (Kiveris et al., 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperloom.plans.workspace import discard, save


def _with_smallest(pairs: DataFrame) -> DataFrame:
    """(u, v) with the smallest of u and its neighbours. A minimum is pre-aggregated, so no node's list is gathered."""
    smallest = pairs.groupBy("u").agg(F.min("v").alias("m"))
    return pairs.join(smallest.select("u", F.least("u", "m").alias("m")), "u")


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    linked = _with_smallest(both).where("v > u")
    return linked.select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    linked = _with_smallest(down)
    return linked.select("v", "m").union(linked.select(F.col("u").alias("v"), "m")).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) for every node that has a link; ``root`` is the smallest node of its component.

    Edges may repeat, run either way or join a node to itself (ignored); without edges the result is empty.
    Each pass is written to the shared folder, so a lost executor costs one pass at most. Passes go on until one changes
    nothing; their number grows with the square of the logarithm of the largest component at most.
    """
    now = save(edges.select(F.col(a).cast("long").alias("u"), F.col(b).cast("long").alias("v")).where("u <> v").distinct(), "edges")
    mark = _mark(now)
    if mark[0]:
        seen = None
        while seen != mark:
            star = save(_small_star(_large_star(now).distinct()).distinct(), "edges")
            seen, mark = mark, _mark(star)
            discard(now)
            now = star
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
