"""The job's input tables expressed over the driver's TPC-H-like tables (FIXTURES.md mapping).

Each function returns a lazily planned DataFrame with exactly the schema the job reads, so the
same operators run on real page-view logs and on these fixtures.  Column pruning and filter
pushdown reach the parquet scans through the projections below.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import PAGEVIEWS_SCHEMA, PRODUCTS_SCHEMA, SKU_IMAGES_SCHEMA, conform, dedupe_sku_images

# Fixed values of the fixture mapping: regions used for the regional conversion columns.
REGIONS = ("AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST")


TASK_ROWS = 250_000     # rows that a task groups by product and order, about


def region_column(name: str) -> str:
    return "conv_crt_to_ord_" + name.lower().replace(" ", "_")


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pageviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Page views in the job's schema."""
    li = _t(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_shipdate", "l_quantity")
    o = _t(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    return conform(li.join(o, li.l_orderkey == o.o_orderkey).select(
        F.col("l_partkey").alias("ProductItemID"), F.col("o_custkey").alias("VisitorId"), F.col("o_custkey").alias("UserId"),
        F.col("l_shipdate").alias("VisitDate"), F.col("l_quantity").alias("TimeSpentOnPage")), PAGEVIEWS_SCHEMA)


def products(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Products in the job's schema."""
    return conform(_t(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("ProductItemID"),
        F.col("p_type").alias("SubCategory"),
        F.col("p_brand").alias("SubSubCategory"),
        F.date_add(F.lit("1995-01-01").cast("date"), (F.col("p_partkey") % 1000).cast("int")).alias("FirstVisibleDate"),
        F.when(F.col("p_size") <= 45, 1).otherwise(0).alias("VisibleOnWeb"),
    ), PRODUCTS_SCHEMA)


def sku_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``sku, image_url, sub_sub_category``: one row per page, brand of the part with that key."""
    pages = _t(spark, sf_dir, "pages").select("page_id", "url")
    part = _t(spark, sf_dir, "part").select("p_partkey", "p_brand")
    return dedupe_sku_images(conform(pages.join(part, pages.page_id == part.p_partkey, "left").select(
        F.col("page_id").alias("sku"), F.col("url").alias("image_url"), F.col("p_brand").alias("sub_sub_category")),
        SKU_IMAGES_SCHEMA))


def product_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per product: cart rows, distinct orders, overall and per-region conversion, brand.

    One aggregation pass: the regional columns are conditional averages, not a pivot.  The rows are dealt by
    product and order before they are grouped: nearly every row is a group of its own, so grouping the
    rows of a whole file split would hold them all in one task's memory.
    """
    li = _t(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_returnflag")
    o = _t(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    c = _t(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    n = _t(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey")
    r = _t(spark, sf_dir, "region").select("r_regionkey", "r_name")
    part = _t(spark, sf_dir, "part").select("p_partkey", "p_brand")
    rows = (li.join(o, li.l_orderkey == o.o_orderkey)
              .join(c, o.o_custkey == c.c_custkey, "left")
              .join(n, c.c_nationkey == n.n_nationkey, "left")
              .join(r, n.n_regionkey == r.r_regionkey, "left"))
    rows = rows.repartition(max(1, -(-li.count() // TASK_ROWS)), "l_partkey", "l_orderkey")
    flag = F.when(F.col("l_returnflag") == "N", F.lit(1.0)).otherwise(F.lit(0.0))
    aggs = [F.count(F.lit(1)).alias("numRatedCarts"),
            F.countDistinct("l_orderkey").alias("numOrders"),
            F.avg(flag).alias("conv_crt_to_ord")]
    aggs += [F.avg(F.when(F.col("r_name") == name, flag)).alias(region_column(name)) for name in REGIONS]
    per_part = rows.groupBy("l_partkey").agg(*aggs)
    return per_part.join(part, per_part.l_partkey == part.p_partkey, "left").select(
        F.col("l_partkey").cast("bigint").alias("productItemID"),
        "numRatedCarts", "numOrders",
        F.col("p_brand").alias("subSubCategory"),
        "conv_crt_to_ord", *[region_column(name) for name in REGIONS],
    )


# SQL text of the same mapping, for the DuckDB oracles (tables are pre-registered views there).
SQL_PRODUCTS = """
  SELECT p_partkey AS ProductItemID, p_type AS SubCategory, p_brand AS SubSubCategory,
         date '1995-01-01' + cast(p_partkey % 1000 AS int) AS FirstVisibleDate,
         CASE WHEN p_size <= 45 THEN 1 ELSE 0 END AS VisibleOnWeb
  FROM part"""

SQL_PAGEVIEWS = """
  SELECT l.l_partkey AS ProductItemID, o.o_custkey AS VisitorId, o.o_custkey AS UserId,
         l.l_shipdate AS VisitDate, l.l_quantity AS TimeSpentOnPage
  FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey"""

SQL_SKU_IMAGES = """
  SELECT pg.page_id AS sku, pg.url AS image_url, pt.p_brand AS sub_sub_category
  FROM pages pg LEFT JOIN part pt ON pg.page_id = pt.p_partkey"""


def sql_product_metrics() -> str:
    regional = ",\n         ".join(
        f"avg(CASE WHEN r.r_name = '{name}' THEN CASE WHEN l.l_returnflag = 'N' THEN 1.0 ELSE 0.0 END END)"
        f" AS {region_column(name)}" for name in REGIONS)
    return f"""
  SELECT m.productItemID, m.numRatedCarts, m.numOrders, pt.p_brand AS subSubCategory,
         m.conv_crt_to_ord, {", ".join("m." + region_column(n) for n in REGIONS)}
  FROM (
    SELECT l.l_partkey AS productItemID, count(*) AS numRatedCarts,
           count(DISTINCT l.l_orderkey) AS numOrders,
           avg(CASE WHEN l.l_returnflag = 'N' THEN 1.0 ELSE 0.0 END) AS conv_crt_to_ord,
         {regional}
    FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey
         LEFT JOIN customer c ON o.o_custkey = c.c_custkey
         LEFT JOIN nation n ON c.c_nationkey = n.n_nationkey
         LEFT JOIN region r ON n.n_regionkey = r.r_regionkey
    GROUP BY l.l_partkey) m
  LEFT JOIN part pt ON m.productItemID = pt.p_partkey"""
