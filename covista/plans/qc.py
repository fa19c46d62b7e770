"""Clustering pipeline (P3) and the review table with product images."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.graph.split import detect, split_large, split_moves_left, split_parts  # noqa: F401
from ..params import Params
from ..runtime import KEY


def cluster(edges: DataFrame, p: Params) -> DataFrame:
    """Edges → communities (``method``) → oversized ones split (``sub_method``).

    Returns ``sub_category, sku, cluster, sub, cluster_id``.
    """
    top = detect(edges, p)
    return split_large(edges, top, p)


def cluster_sizes(membership: DataFrame, label: str = "cluster") -> DataFrame:
    """Members per cluster."""
    return membership.groupBy(KEY, label).agg(F.count(F.lit(1)).alias("size"))


def attach_images(membership: DataFrame, images: DataFrame, label: str = "cluster") -> DataFrame:
    """Every clustered SKU with its image and sub-sub-category; missing images give NULLs."""
    return (membership.join(images, "sku", "left")
            .select(KEY, "sku", label, "sub_sub_category", "image_url"))


def image_tag(url_col: str = "image_url") -> F.Column:
    """The HTML image tag the review page shows for a SKU (NULL without an image)."""
    # fixed value: the tag's text, quotes included, as the review page expects it
    return F.when(F.col(url_col).isNotNull(),
                  F.format_string("'<img width='75' src=\"%s\" ></img>'", F.col(url_col)))


def qc_table(membership: DataFrame, images: DataFrame, label: str = "cluster_id") -> DataFrame:
    """``SKU, ClusterID, SubSubCat, path, img`` per clustered SKU (plus the category key)."""
    t = attach_images(membership, images, label)
    return t.select(KEY, F.col("sku").alias("SKU"), F.col(label).cast("string").alias("ClusterID"),
                    F.col("sub_sub_category").alias("SubSubCat"), F.col("image_url").alias("path"),
                    image_tag("image_url").alias("img"))
