"""Session helpers: local session for tests and bench, checkpoint folder, scratch tables."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

KEY = "sub_category"   # column that keys every table by category (the value of ``cat_level``)


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, app: str = "covista") -> SparkSession:
    """Session for tests and the bench; on a cluster the caller brings its own session."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]").appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "16g")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession, fallback: str | None = None) -> str:
    """Return the shared checkpoint folder named by the session.

    A cluster names it with ``spark.checkpoint.dir``.  Only a local master (tests, bench) falls back
    to ``fallback`` or a temporary folder: there the driver and the tasks share one disk.  On any
    other master a missing setting raises, because a machine-local folder would lose data.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        master = sc.master
        if not (master == "local" or master.startswith("local[")):
            raise RuntimeError("set spark.checkpoint.dir to a folder shared by driver and executors")
        named = fallback or os.path.join(tempfile.gettempdir(), "covista-ckpt")
        os.makedirs(named, exist_ok=True)
    sc.setCheckpointDir(named)
    return sc.getCheckpointDir()


def scratch_path(spark: SparkSession, label: str = "table") -> str:
    """A new folder name below the shared checkpoint folder, deleted when the application ends."""
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/covista-{label}-{uuid.uuid4().hex}"
    hadoop, fs = _fs(spark, path)
    fs.deleteOnExit(hadoop)
    return path


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    hadoop = jvm.org.apache.hadoop.fs.Path(path)
    return hadoop, hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def cut_lineage(df: DataFrame, label: str = "table") -> DataFrame:
    """Materialise ``df`` as a parquet table in the session's shared checkpoint folder and read it
    back: one job, a short plan for everything built on it, and a copy that survives executor loss."""
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.mode("overwrite").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._covista_path = path
    return out


def drop_table(df: DataFrame | None) -> None:
    """Delete the files of a ``cut_lineage`` table that nothing will read again."""
    path = getattr(df, "_covista_path", None)
    if path:
        hadoop, fs = _fs(df.sparkSession, path)
        fs.delete(hadoop, True)
