"""Helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..runtime import cut_lineage, drop_table, scratch_path

__all__ = ["bounded_batches", "cut_lineage", "drop_table", "held_out", "kept", "map_batches", "scratch_path",
           "ship_package", "shuffle_partitions", "table", "texts"]

BATCH_ROWS, BATCH_BYTES = 500, 16 << 20    # of an Arrow batch


_KEPT: dict[object, object] = {}


def kept(key: object, make: Callable[[], object]) -> object:
    """What ``make`` returns, kept in this Python worker until another key is asked for: workers outlive
    their tasks, and the memories of several operators must not add up."""
    if key not in _KEPT:
        _KEPT.clear()
        _KEPT[key] = make()
    return _KEPT[key]


def ship_package(spark: SparkSession) -> None:
    """Send this package to the session's Python workers, which may not have it installed."""
    sc = spark.sparkContext
    if getattr(sc, "_covista_shipped", False):
        return
    package = Path(__file__).resolve().parents[1]
    to = Path(tempfile.mkdtemp(prefix="covista-"))      # the driver's; Spark serves it to the executors
    with zipfile.ZipFile(to / "covista_package.zip", "w", zipfile.ZIP_DEFLATED) as z:
        for f in sorted(package.rglob("*.py")):
            z.write(f, f.relative_to(package.parent))
    sc.addPyFile(str(to / "covista_package.zip"))
    sc._covista_shipped = True


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship_package(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bounded_batches(spark: SparkSession) -> None:
    """Bound the rows and bytes of this session's Arrow batches: a row may hold a long document or a
    whole block, and a batch must fit a Python worker."""
    for key, most in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        now = spark.conf.get(f"spark.sql.execution.arrow.{key}", None)
        if now is None or not 0 < int(now) <= most:
            spark.conf.set(f"spark.sql.execution.arrow.{key}", str(most))


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def map_batches(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]],
                schema: str) -> DataFrame:
    """``mapInArrow`` with bounded batches."""
    bounded_batches(df.sparkSession)
    return df.mapInArrow(fn, schema)


def texts(batch: pa.RecordBatch, name: str) -> list[str]:
    """The strings of one column, null as the empty string."""
    return [t or "" for t in batch.column(name).to_pylist()]


def held_out(doc_id: Column, folds: int = 5) -> Column:
    """True for the rows kept out of training: crc32 of the id as text is divisible by ``folds``."""
    return (F.crc32(doc_id.cast("string").cast("binary")) % F.lit(folds)) == F.lit(0)
