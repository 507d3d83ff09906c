"""Session and shared-folder helpers.

On a cluster the session is created by the caller and ``spark.checkpoint.dir`` names a
shared folder; every materialisation (checkpoints, file round trips) goes below it, and it
is an error if the setting is missing. Only a session whose executors are threads of the
driver (``local[n]``, as in tests) gets a private folder.
"""

from __future__ import annotations

import re
import tempfile
import uuid

from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int = 8, shuffle_partitions: int = 8, app: str = "panelspark",
                  driver_memory: str = "8g") -> SparkSession:
    """A local session configured like the tests and the bench (UI off, AQE on)."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", driver_memory)
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_folder(configured: str | None, master: str) -> str:
    """The folder to use: the configured one, or a private one where driver and executors are
    one process."""
    if configured:
        return configured
    if re.match(r"local(\[|$)", master):
        return tempfile.mkdtemp(prefix="panelspark-ckpt-")
    raise RuntimeError(
        "spark.checkpoint.dir is not set: name a folder that the driver and all executors share")


def checkpoint_root(spark: SparkSession) -> str:
    """The shared checkpoint folder of the session. Callers remove it when they are done."""
    sc = spark.sparkContext
    root = sc.getCheckpointDir()
    if not root:
        sc.setCheckpointDir(checkpoint_folder(sc.getConf().get("spark.checkpoint.dir", None), sc.master))
        root = sc.getCheckpointDir()
    return root.rstrip("/")


def file_system(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path or URI and the path in it."""
    if re.match(r"file:/", path):
        path = re.sub(r"^file:/+", "/", path)
    if re.match(r"[A-Za-z][A-Za-z0-9+.\-]+://", path):
        return pafs.FileSystem.from_uri(path)
    return pafs.LocalFileSystem(), path


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh, unique folder name below the shared checkpoint folder."""
    return f"{checkpoint_root(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once as Parquet below the shared checkpoint folder and read it back.

    This cuts the lineage like ``checkpoint()`` (a lost executor re-reads the files instead
    of recomputing the plan), but in a single pass: an eager ``checkpoint()`` runs the plan
    once to count and again to write unless the data is also cached.
    """
    spark = df.sparkSession
    path = shared_path(spark, name)
    df.write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)
