"""PMI weights, percentile threshold, cut or shift, and summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.pmi import pmi_weight_expr
from ..functions.quantiles import exact_percentiles
from ..runtime import KEY


def pmi_weights(stats: DataFrame, norm: int) -> DataFrame:
    """``sub_category, src, dst, weight`` for every pair of ``pair_stats`` (weight may be NULL)."""
    return stats.select(KEY, F.col("sku1").alias("src"), F.col("sku2").alias("dst"),
                        pmi_weight_expr(norm).alias("weight"))


def pmi_threshold(weights: DataFrame, perc: float) -> DataFrame:
    """The ``perc`` percentile (0-100, linear interpolation) of the positive weights per
    category: ``sub_category, threshold``.  A category without positive weight has no row."""
    pos = weights.filter(F.col("weight") > 0)
    return exact_percentiles(pos, [KEY], "weight", {"threshold": perc / 100.0})


def cut_edges(weights: DataFrame, thresholds: DataFrame) -> DataFrame:
    """F8: keep edges with weight strictly above their category's threshold."""
    return (weights.join(thresholds, KEY, "left")
            .filter(F.col("weight") > F.col("threshold")).drop("threshold"))


def shift_edges(weights: DataFrame, thresholds: DataFrame) -> DataFrame:
    """subtract the threshold from every weight (for the signed method); nothing else is
    dropped, except NULL weights and categories without a threshold."""
    return (weights.join(thresholds, KEY, "left")
            .withColumn("weight", F.col("weight") - F.col("threshold"))
            .filter(F.col("weight").isNotNull()).drop("threshold"))


def pmi_edges(stats: DataFrame, norm: int, perc: float, method: int) -> DataFrame:
    """Pair statistics to the weighted edge list (cut for methods != 7, shift for 7)."""
    w = pmi_weights(stats, norm)   # one expression over the written statistics
    thr = pmi_threshold(w, perc)
    return shift_edges(w, thr) if method == 7 else cut_edges(w, thr)


def edge_summary(edges: DataFrame, stage: str) -> DataFrame:
    """A10: count, mean, sample std, min, quartiles (linear interpolation), max of the non-NULL
    weights per category, tagged with ``stage``."""
    w = edges.filter(F.col("weight").isNotNull())
    basic = w.groupBy(KEY).agg(F.count(F.lit(1)).alias("count"), F.avg("weight").alias("mean"),
                               F.stddev_samp("weight").alias("std"), F.min("weight").alias("min"),
                               F.max("weight").alias("max"))
    quart = exact_percentiles(w, [KEY], "weight", {"p25": 0.25, "p50": 0.5, "p75": 0.75})
    return (basic.join(quart, KEY).withColumn("stage", F.lit(stage))
            .select(KEY, "stage", "count", "mean", "std", "min", "p25", "p50", "p75", "max"))


def pair_counts(stats: DataFrame, weights: DataFrame, edges: DataFrame) -> DataFrame:
    """Pairs kept by F6, pairs whose weight is undefined (dropped), edges after the cut."""
    a = stats.groupBy(KEY).agg(F.count(F.lit(1)).alias("n_pairs"))
    b = weights.groupBy(KEY).agg(F.sum(F.when(F.col("weight").isNull(), 1).otherwise(0)).cast("bigint").alias("n_null_weight"))
    c = edges.groupBy(KEY).agg(F.count(F.lit(1)).alias("n_edges"))
    return (a.join(b, KEY, "left").join(c, KEY, "left")
            .select(KEY, "n_pairs", F.coalesce("n_null_weight", F.lit(0)).alias("n_null_weight"),
                    F.coalesce("n_edges", F.lit(0)).alias("n_edges")))
