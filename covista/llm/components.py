"""Connected components of links between long ids, in DataFrame rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut_lineage, drop_table

MAX_ROUNDS = 200   # a safety limit: reaching it raises


def components(links: DataFrame) -> DataFrame:
    """``node, root`` for every end of ``links`` (``a, b``): the smallest id reachable.

    Alternating large-star and small-star rounds (Kiveris and others 2014): every node links its larger
    neighbours, then its smaller ones, to the smallest it knows, until all links are stars.  A node's
    smallest neighbour comes from a combined minimum, so a node with a third of all links is no hot
    group; the join back to its links is on written tables, which the join can split.  Each round is a
    written table; only one number a round reaches the driver.
    """
    links = (links.filter("a != b").select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).distinct())
    links = cut_lineage(links, "links")
    for _ in range(MAX_ROUNDS):
        if links.isEmpty():
            break
        large = _round(links, _large_star)
        small = _round(large, _small_star)
        drop_table(large)
        drop_table(links)
        links = small
        # stars: no node is the high end of two links, or of one and the low end of another
        if (links.groupBy("hi").count().filter("count > 1").isEmpty()
                and links.join(links.select(F.col("hi").alias("lo")), "lo", "left_semi").isEmpty()):
            break
    else:
        raise RuntimeError("components did not converge")
    roots = links.select(F.col("lo").alias("node"), F.col("lo").alias("root")).distinct()
    return links.select(F.col("hi").alias("node"), F.col("lo").alias("root")).unionByName(roots)


def _round(links: DataFrame, star) -> DataFrame:
    """One star step over a table of every node's smallest smaller neighbour (``least``)."""
    low = cut_lineage(links.groupBy(F.col("hi").alias("node")).agg(F.min("lo").alias("least")), "least")
    out = cut_lineage(star(links, low).distinct(), "links")
    drop_table(low)
    return out


def _large_star(links: DataFrame, low: DataFrame) -> DataFrame:
    """Every node links its larger neighbours to the smallest of itself and its neighbours."""
    return (links.withColumnRenamed("lo", "node").join(low, "node", "left")
                 .select("hi", F.coalesce("least", "node").alias("lo")))


def _small_star(links: DataFrame, low: DataFrame) -> DataFrame:
    """Every node links itself and its smaller neighbours to the smallest of them."""
    near = (links.withColumnRenamed("hi", "node").join(low, "node")
                 .filter(F.col("lo") != F.col("least")).select(F.col("lo").alias("hi"), F.col("least").alias("lo")))
    return near.unionByName(low.select(F.col("node").alias("hi"), F.col("least").alias("lo")))
