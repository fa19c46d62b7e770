"""File sinks (S6, S7, S9, S10).  Every writer runs in parallel; nothing is funnelled into one task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..params import Params


def write_pair_stats(df: DataFrame, path: str) -> None:
    """Pair statistics as CSV with a header."""
    df.write.mode("overwrite").option("header", True).csv(path)


def write_edge_list(df: DataFrame, path: str) -> None:
    """``src dst weight`` separated by spaces, one edge per line (per category folder)."""
    df.select("sub_category", "src", "dst", "weight").write.mode("overwrite") \
      .partitionBy("sub_category").option("sep", " ").csv(path)


# Fixed value: how the job's interface names a cluster file.
CLUSTER_NAME = "clusPV_{category}_{method}_{sub_method}_{pmi_perc:g}"


def write_cluster_table(df: DataFrame, path: str, p: Params) -> None:
    """``SKU, ClusterID, SubSubCat, path`` without header, one folder per category that carries the
    job's file name for it (``file=clusPV_<category>_<method>_<sub method>_<percentile>``)."""
    before, after = CLUSTER_NAME.format(category="\0", method=p.method, sub_method=p.sub_method,
                                        pmi_perc=p.pmi_perc).split("\0")
    named = df.select(F.concat(F.lit(before), "sub_category", F.lit(after)).alias("file"), "SKU", "ClusterID", "SubSubCat", "path")
    named.write.mode("overwrite").partitionBy("file").option("header", False).csv(path)


def write_pairs_json(df: DataFrame, path: str) -> None:
    """S10, write side: pairs as JSON lines."""
    df.write.mode("overwrite").json(path)
