"""Typed table sources of the job: page views, products, SKU images."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

PAGEVIEWS_SCHEMA = T.StructType([
    T.StructField("ProductItemID", T.LongType()),
    T.StructField("VisitorId", T.LongType()),
    T.StructField("UserId", T.LongType()),
    T.StructField("VisitDate", T.TimestampNTZType()),
    T.StructField("TimeSpentOnPage", T.DoubleType()),
])

PRODUCTS_SCHEMA = T.StructType([
    T.StructField("ProductItemID", T.LongType()),
    T.StructField("SubCategory", T.StringType()),
    T.StructField("SubSubCategory", T.StringType()),
    T.StructField("FirstVisibleDate", T.DateType()),
    T.StructField("VisibleOnWeb", T.IntegerType()),
])

SKU_IMAGES_SCHEMA = T.StructType([
    T.StructField("sku", T.LongType()),
    T.StructField("image_url", T.StringType()),
    T.StructField("sub_sub_category", T.StringType()),
])


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Project and cast to ``schema``: only the needed columns reach the scan."""
    return df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema.fields])


def load_pageviews(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    return conform(spark.read.format(fmt).load(path), PAGEVIEWS_SCHEMA)


def load_products(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    return conform(spark.read.format(fmt).load(path), PRODUCTS_SCHEMA)


def dedupe_sku_images(images: DataFrame) -> DataFrame:
    """One row per SKU.  The original kept whichever row its cursor returned last; a table has no
    such order, so the largest ``(image_url, sub_sub_category)`` wins, deterministically."""
    best = F.max(F.struct("image_url", "sub_sub_category")).alias("b")
    return images.groupBy("sku").agg(best).select("sku", "b.image_url", "b.sub_sub_category")


def load_sku_images(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    return dedupe_sku_images(conform(spark.read.format(fmt).load(path), SKU_IMAGES_SCHEMA))
