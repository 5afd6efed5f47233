"""Session construction and cluster-safe helpers (checkpoint dir, sizing)."""

from __future__ import annotations

import os
import shutil
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def build_session(master: str | None = None, shuffle_partitions: int | None = None,
                  app_name: str = "fairband") -> SparkSession:
    """Create (or reuse) a session with settings that hold from local[8] to a cluster.

    AQE re-plans joins/partition counts at runtime, skew-join splitting is on,
    and the session time zone is pinned so timestamp maths is reproducible.
    ``spark.ui.enabled`` is off: no web server is started.
    """
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    parts = shuffle_partitions or int(os.environ.get("FAIRBAND_SHUFFLE_PARTITIONS", "200"))
    builder = (
        builder.config("spark.sql.shuffle.partitions", str(parts))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", os.environ.get("FAIRBAND_DRIVER_MEMORY", "16g"))
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by ``spark.checkpoint.dir``.

    On a cluster the folder must be set by the deployment (a shared file
    system).  Where it is unset, as in tests, a folder inside the warehouse, which
    executors share as well, takes its place.
    """
    sc = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get(
        "spark.checkpoint.dir", None)
    if configured:
        if sc.getCheckpointDir() is None:
            sc.setCheckpointDir(configured)
        return configured
    current = sc.getCheckpointDir()
    if current:
        return current
    path = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_checkpoints"
    sc.setCheckpointDir(path)
    return path


def scratch_path(spark: SparkSession, name: str) -> str:
    """A sub-folder of the shared checkpoint dir for intermediate tables/models."""
    base = ensure_checkpoint_dir(spark)
    # the checkpoint dir may be a URI (hdfs://, s3a://); keep string joins
    return base.rstrip("/") + "/" + name


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back: every use sees the same rows."""
    path = scratch_path(df.sparkSession, f"tables/{name}-{uuid.uuid4().hex}")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def send_package(spark: SparkSession) -> None:
    """Let Python workers import this package, also where their module path does not hold it."""
    root = Path(__file__).resolve().parents[1]
    known = {Path.cwd(), *map(Path, filter(None, os.environ.get("PYTHONPATH", "").split(os.pathsep)))}
    sc = spark.sparkContext
    if root in known or getattr(sc, "_package_sent", False):
        return
    # a zip of modules for the driver's file server; executors get it from there
    sc.addPyFile(shutil.make_archive(os.path.join(tempfile.mkdtemp(), "modules"), "zip", root, Path(__file__).resolve().parent.name))
    sc._package_sent = True
