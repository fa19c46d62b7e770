"""Text sources (S4, S8, S10, S11): delimited inputs, edge lists, pair statistics, JSON pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Column layouts of the three text inputs of the original Spark file (no header).
SKU_VISITS = T.StructType([T.StructField("sku", T.LongType()), T.StructField("visitor", T.LongType())])
SKU_VISIBLE = T.StructType([T.StructField("ProductItemID", T.LongType()),
                            T.StructField("FirstVisibleDate", T.DateType()),
                            T.StructField("SubSubCategory", T.StringType())])
DATE_SUBCAT = T.StructType([T.StructField("VisitCount", T.LongType()),
                            T.StructField("VisitDate", T.DateType()),
                            T.StructField("SubSubCategory", T.StringType())])
EDGES = T.StructType([T.StructField("src", T.LongType()), T.StructField("dst", T.LongType()),
                      T.StructField("weight", T.DoubleType())])
PAIR_STATS = T.StructType([T.StructField(n, T.StringType() if n == "sub_category" else T.LongType())
                           for n in ["sub_category", "sku1", "sku2", "pv1", "pv2", "com", "total",
                                     "pot1", "pot2", "pot_joint"]])


def read_delimited(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Each line trimmed, tabs read as commas, split on commas, fields cast to ``schema``.
    Fields that do not parse become NULL (``try_cast``) instead of failing the job."""
    parts = F.split(F.translate(F.trim(F.col("value")), "\t", ","), ",")
    cols = [F.expr(f"try_cast(trim(parts[{i}]) AS {f.dataType.simpleString()})").alias(f.name)
            for i, f in enumerate(schema.fields)]
    return (spark.read.text(path).filter(F.trim(F.col("value")) != "")
            .select(parts.alias("parts")).select(*cols))


def read_edge_list(spark: SparkSession, path: str) -> DataFrame:
    """Space-delimited ``src dst weight`` lines, read as an undirected weighted graph."""
    return spark.read.schema(EDGES).option("sep", " ").csv(path)


def read_pair_stats(spark: SparkSession, path: str) -> DataFrame:
    """The pair statistics CSV with its header, typed (the original multiplied strings)."""
    return spark.read.schema(PAIR_STATS).option("header", True).csv(path)


def read_pairs_json(spark: SparkSession, path: str) -> DataFrame:
    """S10, read side: pairs handed over as JSON lines."""
    schema = T.StructType([T.StructField("sub_category", T.StringType())] +
                          [T.StructField(n, T.LongType()) for n in ("sku1", "sku2", "pv1", "pv2", "com", "total")])
    return spark.read.schema(schema).json(path)
