"""Session helpers shared by every job."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: str = "*", shuffle_partitions: int = 8, app: str = "starloom") -> SparkSession:
    """Session for tests and benchmarks on one machine; clusters bring their own session."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.codegen.hugeMethodLimit", "8000")  # larger methods never get JIT-compiled
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Folder for reliable checkpoints: the one the cluster names, else (local runs only) a new one."""
    context = spark.sparkContext
    current = context.getCheckpointDir()
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named and not (current and named.rstrip("/") in current):
        context.setCheckpointDir(named)
    elif not current:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="starloom-"))
    return context.getCheckpointDir()


def cut_lineage(df: DataFrame) -> DataFrame:
    """Store ``df`` as a table in the shared folder and read it back.

    Later steps see one fixed result whatever happens to the executors, and Spark knows its size, so
    small stored frames are broadcast.
    """
    path = scratch_path(df.sparkSession, "stored")
    df.write.parquet(path)
    stored = df.sparkSession.read.schema(df.schema).parquet(path)
    stored._stored_at = path
    return stored


def discard(*frames: DataFrame | None) -> None:
    """Delete frames that ``cut_lineage`` stored; nothing may read them, or frames built on them, any more."""
    for frame in frames:
        if frame is not None and getattr(frame, "_stored_at", None):
            delete_folder(frame.sparkSession, frame._stored_at)
            frame._stored_at = None


def delete_folder(spark: SparkSession, path: str) -> None:
    """Delete a folder of the shared storage, through Spark's own access to it."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new, unused folder name next to the checkpoints (shared storage on a cluster)."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
