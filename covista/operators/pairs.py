"""SKU pairs and their shared-visitor counts.

The original builds all SKU combinations and intersects visitor sets.  Here the count comes from
an equi self join on ``(sub_category, visitor)``: a pair costs work only if someone viewed both.

Skew: a visitor who viewed *n* SKUs produces n(n-1)/2 pair increments.  A visitor (or bot) with
a third of all rows would put all of them into one join task, so each visitor's SKUs are split
into ``ceil(n / hot_visitor_skus)`` hash blocks and the join runs on ``(visitor, block_i,
block_j)`` with ``block_i <= block_j``.  Every unordered pair still meets exactly once, each join
group holds about ``hot_visitor_skus`` rows per side, and ordinary visitors keep one block.
Partial counts are combined map-side before the shuffle on the pair key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..runtime import KEY, cut_lineage


def _with_blocks(svk: DataFrame, hot_visitor_skus: int) -> DataFrame:
    """Add ``nb`` (blocks of the visitor) and ``b`` (block of this SKU) to kept visitor rows."""
    deg = svk.groupBy(KEY, "visitor").agg(F.count(F.lit(1)).alias("n"))
    hot = (deg.filter(F.col("n") > F.lit(hot_visitor_skus))
              .select(KEY, "visitor", F.ceil(F.col("n") / F.lit(hot_visitor_skus)).cast("int").alias("nb")))
    # ``hot`` has at most rows/hot_visitor_skus entries; AQE turns this into a broadcast join at
    # run time when it is small and keeps a shuffle join (with skew splitting) when it is not.
    rows = svk.join(hot, [KEY, "visitor"], "left").withColumn("nb", F.coalesce("nb", F.lit(1)))
    return rows.withColumn("b", F.pmod(F.xxhash64("sku"), F.col("nb")).cast("int"))


def shared_visitor_counts(svk: DataFrame, hot_visitor_skus: int = 2000) -> DataFrame:
    """``sub_category, sku1, sku2, com`` with ``sku1 < sku2`` over kept visitor rows."""
    rows = _with_blocks(svk, hot_visitor_skus)
    left = rows.select(KEY, "visitor", F.col("sku").alias("s1"), F.col("b").alias("bi"),
                       F.explode(F.sequence(F.col("b"), F.col("nb") - 1)).alias("bj"))
    right = rows.select(KEY, "visitor", F.col("sku").alias("s2"), F.col("b").alias("bj"),
                        F.explode(F.sequence(F.lit(0), F.col("b"))).alias("bi"))
    j = left.join(right, [KEY, "visitor", "bi", "bj"]).filter(
        (F.col("bi") < F.col("bj")) | (F.col("s1") < F.col("s2")))
    return (j.select(KEY, F.least("s1", "s2").alias("sku1"), F.greatest("s1", "s2").alias("sku2"))
             .groupBy(KEY, "sku1", "sku2").agg(F.count(F.lit(1)).alias("com")))


def sku_pairs(sv: DataFrame, kept: DataFrame, joint_min: int, ordered: bool = False,
              hot_visitor_skus: int = 2000) -> DataFrame:
    """J2 (+F6): pairs of kept SKUs sharing more than ``joint_min`` visitors.

    ``kept`` is ``sub_category, sku, pv`` from F5.  With ``ordered=True`` (J3, F7) both
    ``(a, b)`` and ``(b, a)`` are returned, as the Spark variant of the original did.
    Output: ``sub_category, sku1, sku2, com``.
    """
    svk = sv.join(kept.select(KEY, "sku"), [KEY, "sku"], "left_semi")
    pairs = shared_visitor_counts(svk, hot_visitor_skus).filter(F.col("com") > F.lit(joint_min))
    if ordered:
        pairs = pairs.unionByName(pairs.select(KEY, F.col("sku2").alias("sku1"),
                                               F.col("sku1").alias("sku2"), "com"))
    return pairs


def split_prefixes(svk: DataFrame, joint_min: int) -> tuple[DataFrame, DataFrame]:
    """``(prefix, busy)``: the rows of ``svk`` without and of only the ``joint_min`` busiest visitors of each SKU
    (most SKUs first, then largest visitor)."""
    degree = svk.groupBy(KEY, "visitor").agg(F.count(F.lit(1)).alias("n"))
    # a limit on row numbers is taken in every partition before the shuffle, so a SKU with a third of all
    # rows sends at most ``joint_min`` rows a partition
    busiest = Window.partitionBy(KEY, "sku").orderBy(F.desc("n"), F.desc("visitor"))
    busy = (svk.join(degree, [KEY, "visitor"]).withColumn("r", F.row_number().over(busiest))
               .filter(F.col("r") <= F.lit(joint_min)).select(KEY, "sku", "visitor"))
    busy = cut_lineage(busy, "busy")
    return svk.join(busy, [KEY, "sku", "visitor"], "left_anti"), busy


def sku_pairs_by_prefix(sv: DataFrame, kept: DataFrame, joint_min: int, hot_visitor_skus: int = 2000) -> DataFrame:
    """The rows of ``sku_pairs``, found by prefix filtering.

    Order the visitors by the SKUs they saw, busiest first.  Two SKUs with more than t visitors in common have
    t common ones before their last common one, so that one is not among the t busiest of either.  Hence pairs
    come from a self join that leaves out the t busiest visitors of every SKU, and the busy visitors of a pair's
    SKUs (at most t each) are looked up afterwards, which makes its count exact; no visitor is dropped.  A bot
    that saw most SKUs costs two lookups a pair here, and n²/2 increments in ``sku_pairs``.
    """
    svk = cut_lineage(sv.join(kept.select(KEY, "sku"), [KEY, "sku"], "left_semi"), "visitors")
    prefix, busy = split_prefixes(svk, joint_min)
    prefix = cut_lineage(prefix, "prefix")
    found = cut_lineage(shared_visitor_counts(prefix, hot_visitor_skus), "pairs")
    named = lambda df, i: df.select(KEY, F.col("sku").alias(f"sku{i}"), "visitor")
    pair = [KEY, "sku1", "sku2"]
    # common visitors that are busy for sku1, then those that are busy for sku2 only
    first = found.select(*pair).join(named(busy, 1), [KEY, "sku1"]).join(named(svk, 2), [KEY, "sku2", "visitor"])
    second = found.select(*pair).join(named(busy, 2), [KEY, "sku2"]).join(named(prefix, 1), [KEY, "sku1", "visitor"])
    more = first.select(*pair).unionByName(second.select(*pair)).select(*pair, F.lit(1).cast("bigint").alias("com"))
    return (found.unionByName(more).groupBy(*pair).agg(F.sum("com").alias("com"))
                 .filter(F.col("com") > F.lit(joint_min)))
