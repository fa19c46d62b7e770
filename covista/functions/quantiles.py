"""Exact percentiles per group without sorting a whole group in one task.

The percentile is numpy's default (linear interpolation between the order statistics at
``floor(p·(n-1))`` and the next one).  ``F.percentile`` would give the same value, but it holds
every value of a group in one task's memory, and one category may hold a third of all edges.

Values are counted first (equal values are one row from there on, combined before the shuffle), the
counts are summed in value order over range partitions, and an order statistic is the value whose
run of ranks holds it.  All wanted percentiles come from the same two shuffles.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ranking import running_before


def exact_percentiles(df: DataFrame, keys: list[str], value: str, probs: dict[str, float]) -> DataFrame:
    """Return ``keys + list(probs)``: for each group, the exact ``probs[name]`` quantile (0..1)
    of the non-NULL values of ``value``.  Groups without values do not appear."""
    if not all(0.0 <= p <= 1.0 for p in probs.values()):
        raise ValueError("percentile probabilities must be within [0, 1]")
    v = df.select(*keys, F.col(value).cast("double").alias("v")).filter(F.col("v").isNotNull())
    counts = v.groupBy(*keys, "v").agg(F.count(F.lit(1)).alias("c"))
    ranked = running_before(counts, keys, "v", F.col("c"), "lo").withColumn("hi", F.col("lo") + F.col("c"))
    sizes = v.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    held = ranked.join(sizes, keys)

    def at(rank):
        return F.max(F.when((F.col("lo") <= rank) & (rank < F.col("hi")), F.col("v")))
    picks = []
    for i, p in enumerate(probs.values()):
        pos = F.lit(float(p)) * (F.col("n") - 1)
        low = F.floor(pos)
        picks += [at(low).alias(f"a{i}"), at(F.least(low + 1, F.col("n") - 1)).alias(f"b{i}"), F.max(pos - low).alias(f"f{i}")]
    return held.groupBy(*keys).agg(*picks).select(
        *keys, *[(F.col(f"a{i}") + (F.col(f"b{i}") - F.col(f"a{i}")) * F.col(f"f{i}")).alias(name)
                 for i, name in enumerate(probs)])


SKETCH_K = 400
RANK_ERROR = 0.0133 * 200 / SKETCH_K   # of one quantile's rank, at 99 % confidence


def quantile_sketches(df: DataFrame, keys: list[str], value: str, k: int = SKETCH_K) -> DataFrame:
    """``keys + [sketch]``: a KLL sketch of the non-NULL values of every group.  Its size depends on ``k`` only
    (a few kB), it is combined before the shuffle, and sketches of slices merge to that of the whole."""
    v = df.select(*keys, F.col(value).cast("double").alias("v")).filter(F.col("v").isNotNull())
    return v.groupBy(*keys).agg(F.kll_sketch_agg_double("v", F.lit(k)).alias("sketch"))


def sketched_percentiles(sketches: DataFrame, keys: list[str], probs: dict[str, float], k: int = SKETCH_K) -> DataFrame:
    """``keys + list(probs)``: percentiles of the merged sketches, each a value of the data whose rank is off by
    about 1.33 % · 200 / k of the group's size at most (99 % of the time); ``exact_percentiles`` interpolates."""
    if not all(0.0 <= p <= 1.0 for p in probs.values()):
        raise ValueError("percentile probabilities must be within [0, 1]")
    whole = sketches.groupBy(*keys).agg(F.kll_merge_agg_double("sketch", F.lit(k)).alias("sketch"))
    return whole.select(*keys, *[F.kll_sketch_get_quantile_double("sketch", F.lit(float(p))).alias(name) for name, p in probs.items()])
