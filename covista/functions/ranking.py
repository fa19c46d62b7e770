"""Running sums over ordered groups without one task per group.

Rows are range-partitioned and sorted by (group, order), so a group of any size is spread over
tasks; each task sums its own part, and the parts before it are added from a table with one row per
group and partition.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..runtime import cut_lineage


def running_before(df: DataFrame, keys: list[str], order: str | Column, weight: Column, out: str = "before") -> DataFrame:
    """``df`` with ``out``: the sum of ``weight`` (an integer) over the rows of the same group that come
    earlier in ``order``.  Rows must be distinct in (keys, order); groups may be of any size."""
    order = F.col(order).asc_nulls_first() if isinstance(order, str) else order
    dealt = cut_lineage(df.withColumn("_w", weight.cast("bigint"))
                          .repartitionByRange(*[F.col(k).asc_nulls_first() for k in keys], order)
                          .withColumn("_part", F.spark_partition_id()))
    inside = Window.partitionBy(*keys, "_part").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    # at most one row per group and one more per partition
    parts = dealt.groupBy(*keys, "_part").agg(F.sum("_w").alias("_n"))
    across = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("_part").alias("_p"),
                         F.coalesce(F.sum("_n").over(across), F.lit(0)).alias("_base"))
    same = F.col("_part") == F.col("_p")
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    summed = dealt.withColumn("_in", F.coalesce(F.sum("_w").over(inside), F.lit(0)))
    return summed.join(parts, same).select(*df.columns, (F.col("_base") + F.col("_in")).alias(out))
