"""Session helpers.

The cluster names its shared lineage-cutting folder in ``spark.checkpoint.dir``;
we read it from the session and only fall back to a scratch folder when it is
unset (local tests).
"""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile

from pyspark.sql import SparkSession


def get_spark(master: str | None = None, shuffle_partitions: int | None = None,
              app_name: str = "qualityspark") -> SparkSession:
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    builder = (
        builder.config("spark.ui.enabled", "false")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("QS_DRIVER_MEMORY", "8g"))
    )
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    checkpoint_dir(spark)
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder, setting a local one only if unset."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        if not is_local(spark):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        configured = tempfile.mkdtemp(prefix="qualityspark-ckpt-")
        atexit.register(shutil.rmtree, configured, ignore_errors=True)     # our own folder of this run
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir() or configured


def ship_package(spark: SparkSession) -> None:
    """Send this package to the Python workers unless their import path already
    has it (the folder is the working folder or on PYTHONPATH)."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    seen = [os.getcwd(), *os.environ.get("PYTHONPATH", "").split(os.pathsep)]
    sc = spark.sparkContext
    if any(p and os.path.abspath(p) == root for p in seen) or getattr(sc, "_qualityspark_sent", False):
        return
    base = os.path.join(tempfile.mkdtemp(prefix="qualityspark-zip-"), "qualityspark")
    sc.addPyFile(shutil.make_archive(base, "zip", root, "qualityspark"))
    sc._qualityspark_sent = True


def is_local(spark: SparkSession) -> bool:
    """One process on one machine (``local-cluster`` has executors of their own)."""
    return spark.sparkContext.master.split("[")[0] == "local"


def scratch_path(spark: SparkSession, name: str) -> str:
    """A folder for intermediate tables under the shared checkpoint folder."""
    base = checkpoint_dir(spark)
    return os.path.join(base, "tables", name)


def materialize(df):
    """Cut lineage: write ``df`` as a Parquet table under the shared
    checkpoint folder and continue from the written copy.  One computation,
    no shared cache entries (safe when several threads materialize identical
    plans), and a recomputed task after an executor loss reads the files."""
    import uuid
    spark = df.sparkSession
    path = scratch_path(spark, uuid.uuid4().hex)
    df.write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def cleanup_scratch(spark: SparkSession) -> bool:
    """Delete this application's intermediate tables (``materialize`` output)
    through the Hadoop FileSystem API, so it works on any cluster file system.
    Call at the end of a run: DataFrames built on them can no longer be read."""
    base = os.path.join(checkpoint_dir(spark), "tables")
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(base)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return bool(fs.exists(path) and fs.delete(path, True))
