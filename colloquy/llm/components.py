"""Connected components of a graph given as a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize, spread_join


def _large_star(links: DataFrame) -> DataFrame:
    """Each node's larger neighbours go to the least of it and its neighbours."""
    both = links.select("u", "v").unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return spread_join(both.filter("v > u"), least, ["u"]).select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(links: DataFrame) -> DataFrame:
    """Each node and its smaller neighbours go to the least of those."""
    least = links.groupBy("u").agg(F.min("v").alias("m"))
    moved = spread_join(links, least, ["u"]).filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def connected_components(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of ``links`` (u, v long): root is the component's least node.

    Large-star and small-star rounds, each written to the shared folder; rounds
    grow with the logarithm of the longest chain. Links of a node to itself give
    a node of its own; repeated links and either direction are fine; no links,
    no rows. Minima are combined before the shuffle and joins may be split, so
    that one node may hold most links.
    """
    pairs = links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    pairs = materialize(pairs, "links")
    alone = pairs.filter("u = v").select(F.col("u").alias("node"))
    now = pairs.filter("u <> v")
    last = None
    for _ in range(most_rounds):
        rows, heads = now.agg(F.count(F.lit(1)), F.count_distinct("u")).first()
        if rows == heads and now.join(now.select(F.col("v").alias("u")), "u", "left_semi").isEmpty():
            break
        after = materialize(_small_star(_large_star(now)), "links")
        if last is not None:
            discard(last)
        now = last = after
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    roots = now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")))
    return roots.unionByName(alone.select("node", F.col("node").alias("root"))).groupBy("node").agg(F.min("root").alias("root"))
