"""A session with the settings the engine expects (UTC, ANSI, adaptive execution), and tables kept for a while in the shared folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def session(app: str = "tallyweave", master: str | None = None, **conf: str) -> SparkSession:
    """An existing session or a new one; further settings with __ for dots (spark__sql__shuffle__partitions="8")."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    settings = {"spark.sql.session.timeZone": "UTC", "spark.sql.ansi.enabled": "true", "spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true"}
    for k, v in (settings | {k.replace("__", "."): v for k, v in conf.items()}).items():
        b = b.config(k, v)
    return b.getOrCreate()


_OWN: dict[str, str] = {}  # the folders of local sessions that have none


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Only a local session without one gets its own."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if at:
        return at.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _OWN:
        _OWN[app] = "file://" + tempfile.mkdtemp(prefix="tallyweave-")
    return _OWN[app]


def kept(df: DataFrame, name: str = "table") -> DataFrame:
    """df written once as Parquet into the shared folder and read back: a plan that several results read is run once."""
    at = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(at)
    return df.sparkSession.read.schema(df.schema).parquet(at)


def file_system(spark: SparkSession, path: str):
    """Hadoop's file system of a path, and the path."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def sized(spark: SparkSession, folder: str, part: int = 2 << 20) -> None:
    """Shuffles for an input of this size: as many partitions as the folder has pieces of `part` bytes, so that a task's share stays the same
    as tables grow. Adaptive execution joins small ones again, up to 16 MB at most. Never fewer than the session's own."""
    fs, at = file_system(spark, folder)
    own = int(spark.conf.get("spark.sql.shuffle.partitions"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.initialPartitionNum", min(10_000, max(own, -(-fs.getContentSummary(at).getLength() // part))))
    if spark.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes", "67108864b") in ("67108864b", "64MB", "64m"):  # nobody has chosen another
        spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "16m")
