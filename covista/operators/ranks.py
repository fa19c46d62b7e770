"""Integer percentile rank of product metrics within their sub-sub-category.

``ceil(percent_rank() · 100)`` per metric, ascending with NULLs first.  The rank of a value is one
more than the number of rows below it, which is summed over counted values in range partitions, so a
sub-sub-category of any size is spread over tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.ranking import running_before
from ..runtime import cut_lineage
from ..sources.fixtures import REGIONS, region_column

METRIC_COLUMNS = ["conv_crt_to_ord", *[region_column(r) for r in REGIONS]]


def percentile_column(metric: str) -> str:
    return "percentile" + metric[len("conv"):] if metric.startswith("conv") else f"percentile_{metric}"


def metric_percentiles(metrics: DataFrame, cols: list[str], by: str = "subSubCategory",
                       id_col: str = "productItemID") -> DataFrame:
    metrics = cut_lineage(metrics, "metrics")     # read by every rank
    sizes = metrics.groupBy(by).agg(F.count(F.lit(1)).alias("_n"))
    out = metrics.join(sizes.withColumnRenamed(by, "_by"), F.col(by).eqNullSafe(F.col("_by"))).drop("_by")
    for c in cols:
        counts = metrics.groupBy(by, c).agg(F.count(F.lit(1)).alias("_c"))
        below = (running_before(counts, [by], c, F.col("_c"), "_below")
                 .select(F.col(by).alias("_by"), F.col(c).alias("_v"), "_below"))
        rank = F.when(F.col("_n") > 1, F.col("_below").cast("double") / (F.col("_n") - 1)).otherwise(0.0)
        out = (out.join(below, F.col(by).eqNullSafe(F.col("_by")) & F.col(c).eqNullSafe(F.col("_v")))
                  .withColumn(percentile_column(c), F.ceil(rank * 100).cast("bigint")).drop("_by", "_v", "_below"))
    return out.select(id_col, "numRatedCarts", "numOrders", by, *cols, *[percentile_column(c) for c in cols])


def metric_percentiles_sql(metrics_sql: str, cols: list[str] = METRIC_COLUMNS, by: str = "subSubCategory",
                           id_col: str = "productItemID") -> str:
    ranks = ",\n       ".join(
        f"cast(ceil(percent_rank() OVER (PARTITION BY {by} ORDER BY {c} ASC NULLS FIRST) * 100) AS bigint)"
        f" AS {percentile_column(c)}" for c in cols)
    return f"""SELECT {id_col}, numRatedCarts, numOrders, {by}, {", ".join(cols)},
       {ranks}
FROM ({metrics_sql}) m"""
