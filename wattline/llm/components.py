"""Connected components of links between numbered rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wattline.lineage import stage


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``node`` and ``root``, the smallest node it is joined to, for every node that has a link to another.

    Each round hangs every root under its smallest neighbour, shortens the chains until all point at their top, and goes
    on with the links between different tops. Every join is between stored tables on a unique key on one side, so a
    node with very many links is split by adaptive execution. Nulls and links of a node to itself are ignored.
    """
    x, y = F.col(a), F.col(b)
    left = stage(links.where((x != y)).select(F.least(x, y).alias("lo"), F.greatest(x, y).alias("hi")).distinct(), "links")
    total = None
    while not left.isEmpty():
        ends = left.selectExpr("lo AS node", "hi AS other").union(left.selectExpr("hi AS node", "lo AS other"))
        tree = stage(ends.groupBy("node").agg(F.least("node", F.min("other")).alias("root")), "tree")
        while True:
            up = tree.selectExpr("node AS _at", "root AS _up")
            tree = stage(tree.join(up, F.col("root") == F.col("_at")).selectExpr("node", "_up AS root", "root <> _up AS moved"), "tree")
            if tree.where("moved").isEmpty():
                break
        tree = tree.select("node", "root")
        tops = tree.selectExpr("node AS _at", "root AS _up")
        if total is None:
            total = tree
        else:
            total = stage(total.join(tops, F.col("root") == F.col("_at"), "left").selectExpr("node", "coalesce(_up, root) AS root"), "roots")
        left = left.join(tops, F.col("lo") == F.col("_at")).selectExpr("hi", "_up AS lo")
        left = left.join(tops, F.col("hi") == F.col("_at")).selectExpr("lo", "_up AS hi").where("lo <> hi")
        left = stage(left.selectExpr("least(lo, hi) AS lo", "greatest(lo, hi) AS hi").distinct(), "links")
    return left.selectExpr("lo AS node", "hi AS root") if total is None else total
