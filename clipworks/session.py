"""Session settings used by the tests, the bench and the entry point."""

from __future__ import annotations

import os
import shutil
import tempfile

from pyspark.sql import SparkSession


def local_session(cpus: str | int = "*", shuffle_partitions: int = 8, app: str = "clipworks") -> SparkSession:
    """A local session; on a cluster the deployment supplies the session."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", os.environ.get("CLIPWORKS_DRIVER_MEMORY", "8g"))
        .config("spark.ui.enabled", "false")
        .config("spark.local.dir", tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
        .config("spark.sql.warehouse.dir", tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
        .getOrCreate()
    )


def checkpoint_dir(spark: SparkSession) -> str:
    """The cluster's shared checkpoint folder. Only a local session may do without one; it then gets a private folder."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        configured = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", configured)
    return configured


def bounded_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Hands whole texts to Python in batches of ``rows`` at most, not of 10 000 as is Spark's default."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= rows:
        spark.conf.set(key, str(rows))


def ship_package(spark: SparkSession) -> None:
    """Sends this package to the Python workers, once a session, where they would not find it on their own path."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    paths = os.environ.get("PYTHONPATH", "").split(os.pathsep)
    sc = spark.sparkContext
    if root in [os.path.abspath(p) for p in [os.getcwd(), *paths] if p] or getattr(sc, "_clipworks_shipped", False):
        return
    archive = shutil.make_archive(os.path.join(tempfile.mkdtemp(prefix="clipworks-"), "clipworks"), "zip", root, "clipworks")
    sc.addPyFile(archive)
    sc._clipworks_shipped = True
