"""Session settings and lineage cuts."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Adaptive execution re-plans joins from measured sizes and splits skewed shuffle partitions.
DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def build_session(app: str = "wicara", master: str | None = None, **settings: str) -> SparkSession:
    """Session with the library defaults; ``settings`` use ``_`` for ``.`` in option names."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for name, value in DEFAULTS.items():
        builder = builder.config(name, value)
    for name, value in settings.items():
        builder = builder.config(name.replace("_", "."), value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach: the configured checkpoint folder.

    Only a local master may fall back to a temporary folder; a cluster must name a shared one.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return current.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
    folder = tempfile.mkdtemp(prefix="wicara-checkpoint-")
    spark.sparkContext.setCheckpointDir(folder)
    return folder


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet to the configured shared folder and continue from the files.

    The copy survives the loss of executors, keeps sizes known to the planner and is removed when
    the application ends. Without a configured folder the plan is simply computed again.
    """
    spark = df.sparkSession
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not configured:
        return df
    path = f"{configured.rstrip('/')}/wicara-{uuid.uuid4().hex}"
    df.write.parquet(path)
    remove_on_exit(spark, path)
    return spark.read.schema(df.schema).parquet(path)


def remove_on_exit(spark: SparkSession, path: str) -> None:
    """Have the file system drop ``path`` when the application ends."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(target)
