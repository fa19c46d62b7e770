"""Qualified views and per-SKU / per-category aggregates.

Everything is keyed by ``sub_category`` so that all categories run in one job; a single
category is just a filter on that key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..params import Params
from ..runtime import KEY


def visible_products(products: DataFrame, p: Params) -> DataFrame:
    """Products that can be shown (F3) in the chosen category (F4): ``sku, sub_category, ssc, fvd``."""
    prods = products.filter((F.col("VisibleOnWeb") == 1) & F.col(p.cat_level).isNotNull())
    if p.category is not None:
        prods = prods.filter(F.col(p.cat_level) == F.lit(p.category))
    return prods.select(
        F.col("ProductItemID").alias("sku"),
        F.col(p.cat_level).alias(KEY),
        F.col("SubSubCategory").alias("ssc"),
        F.col("FirstVisibleDate").alias("fvd"),
    )


def qualified_views(views: DataFrame, products: DataFrame, p: Params) -> DataFrame:
    """View rows with dwell > ``time_thresh`` strictly inside (start, end).

    Both window ends are exclusive and compared on the raw timestamp, so a view at
    ``start 00:00:00`` is out and a later one on the same day is in.  Output:
    ``sub_category, sku, visitor, user_id, visit_date, ssc, fvd``.
    """
    ts_type = views.schema["VisitDate"].dataType
    start = F.lit(p.start_date).cast(ts_type)
    end = F.lit(p.end_date).cast(ts_type)
    v = views.filter(
        (F.col("TimeSpentOnPage") > F.lit(float(p.time_thresh)))
        & (F.col("VisitDate") > start) & (F.col("VisitDate") < end)
    ).select(
        F.col("ProductItemID").alias("sku"),
        F.col("VisitorId").alias("visitor"),
        F.col("UserId").alias("user_id"),
        F.to_date("VisitDate").alias("visit_date"),
    )
    # No hint: the planner broadcasts the product side if its size is below the session's threshold,
    # else the join stays a shuffle join that can split hot products.
    return v.join(visible_products(products, p), "sku")


def sku_visitors(q: DataFrame) -> DataFrame:
    """A1 in long form: the distinct ``(sub_category, sku, visitor)`` rows, NULL visitors ignored.

    This is the set of visitors per SKU without collecting any set into one row: a SKU seen by a
    third of all visitors stays spread over many partitions.
    """
    return q.filter(F.col("visitor").isNotNull()).select(KEY, "sku", "visitor").distinct()


def sku_view_counts(sv: DataFrame) -> DataFrame:
    """A2: distinct visitors per SKU (partial counts are combined map-side)."""
    return sv.groupBy(KEY, "sku").agg(F.count(F.lit(1)).alias("pv"))


def sku_views(q: DataFrame, min_views: int, sv: DataFrame | None = None) -> DataFrame:
    """F5 + A2: SKUs with more than ``min_views`` distinct visitors: ``sub_category, sku, pv``."""
    sv = sku_visitors(q) if sv is None else sv
    return sku_view_counts(sv).filter(F.col("pv") > F.lit(min_views))


def total_visitors(q: DataFrame) -> DataFrame:
    """A3: distinct visitors per category, counted before the F5 filter."""
    return q.groupBy(KEY).agg(F.countDistinct("visitor").alias("total"))


def sku_profile(q: DataFrame) -> DataFrame:
    """A4: ``max(fvd)`` and ``min(ssc)`` per SKU over its qualified views."""
    return q.groupBy(KEY, "sku").agg(F.max("fvd").alias("fvd"), F.min("ssc").alias("ssc"))


def sku_profile_from_products(prods: DataFrame, skus: DataFrame) -> DataFrame:
    """A4 for SKUs known to have qualified views, read from the product dimension instead of the
    view log: every view row of a SKU carries each of its product rows, so max/min agree."""
    prof = prods.groupBy(KEY, "sku").agg(F.max("fvd").alias("fvd"), F.min("ssc").alias("ssc"))
    return prof.join(skus.select(KEY, "sku"), [KEY, "sku"], "left_semi")


def daily_category_visits(q: DataFrame) -> DataFrame:
    """A5: distinct *users* per (category, ssc, day): ``sub_category, ssc, visit_date, visits``."""
    return q.groupBy(KEY, "ssc", "visit_date").agg(F.countDistinct("user_id").alias("visits"))


def eligible_categories(products: DataFrame, min_products: int, cat_level: str = "SubCategory") -> DataFrame:
    """F10 + A8: categories with more than ``min_products`` visible products."""
    return (products.filter(F.col("VisibleOnWeb") == 1)
            .groupBy(F.col(cat_level).alias(KEY))
            .agg(F.count(F.lit(1)).alias("n_products"))
            .filter(F.col("n_products") > F.lit(min_products)))
