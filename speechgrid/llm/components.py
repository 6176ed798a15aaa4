"""Connected components over a table of links, by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import stage


def _star(links: DataFrame, large: bool) -> DataFrame:
    """Every node sends its neighbours to the smallest of them and itself: the larger ones (``large``) or the smaller ones."""
    near = links.select(F.col("a").alias("u"), F.col("b").alias("v"))
    both = near.unionByName(links.select(F.col("b").alias("u"), F.col("a").alias("v"))) if large else near
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    if large:
        out = both.join(least, "u").filter("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    else:
        out = both.join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).unionByName(least.select(F.col("u").alias("a"), F.col("m").alias("b")))
    return out.filter("a <> b").distinct()


def components(links: DataFrame, most: int = 60) -> DataFrame:
    """``node, root`` for every node of the links ``a, b`` (null or self links are none): ``root`` is the smallest node reachable.
    Each round is a stored table of at most one row a link; the rounds grow with the logarithm of the longest path, and more than
    ``most`` of them raise."""
    now = stage(links.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    seen = None
    for _ in range(most):
        now = stage(_star(_star(now, True), False))
        state = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.countDistinct("a")).first()
        # every node has one link, to a node without one: stars
        if state[0] == 0 or (state == seen and state[0] == state[2]):
            return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root"))).distinct()
        seen = state
    raise RuntimeError("components did not settle")
