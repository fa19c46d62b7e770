"""S3: database source.  The original read through a driver-side cursor; here the database is read
by the executors in parallel slices of a numeric column, with the filter pushed into the query."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def jdbc_options(url: str, query: str, partition_column: str | None = None, lower: int | None = None,
                 upper: int | None = None, num_partitions: int | None = None, fetch_size: int = 10_000,
                 **extra: str) -> dict[str, str]:
    """Options for ``spark.read.format('jdbc')``: the query goes in as a sub-select, and a partition
    column with bounds splits the read into ``num_partitions`` parallel range queries."""
    opts = {"url": url, "dbtable": f"({query}) q", "fetchsize": str(fetch_size)}
    bounds = (partition_column, lower, upper, num_partitions)
    if any(b is not None for b in bounds):
        if any(b is None for b in bounds):
            raise ValueError("partition_column, lower, upper and num_partitions go together")
        opts.update(partitionColumn=partition_column, lowerBound=str(lower), upperBound=str(upper),
                    numPartitions=str(num_partitions))
    opts.update({k: str(v) for k, v in extra.items()})
    return opts


def read_jdbc(spark: SparkSession, url: str, query: str, **kw) -> DataFrame:
    """Credentials come from the caller's options (``user``, ``password``), never from code."""
    return spark.read.format("jdbc").options(**jdbc_options(url, query, **kw)).load()
