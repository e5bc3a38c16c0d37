"""Where iterative operators keep their tables between rounds."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Used only on one machine, where the session names no shared folder, as in tests.
LOCAL_DEFAULT = "file:///tmp/postloom-work"
#: Shuffle files of a finished write are no longer needed.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names; without one, a local folder if all runs on this machine, else an error."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        named = LOCAL_DEFAULT
        spark.conf.set("spark.checkpoint.dir", named)
        spark.sparkContext.setCheckpointDir(named)
    return named.rstrip("/")


def overwritten(df: DataFrame, path: str, codec: str = "zstd") -> DataFrame:
    """``df`` written to ``path`` and read again: its lineage ends there, and a lost executor loses nothing."""
    spark = df.sparkSession
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.mode("overwrite").option("compression", codec).parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def kept(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a new table in the shared folder."""
    return kept_at(df, name)[0]


def kept_at(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """As ``kept``, with the table's place, for tables that a later one replaces."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    return overwritten(df, path), path


def forget(spark: SparkSession, path: str) -> None:
    """Deletes a table that nothing reads any more, through Spark's own file system layer."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def stamp(spark: SparkSession, path: str) -> tuple[str, int, int] | None:
    """Name, size and time of a file, by which a change shows; none if it is gone."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    system = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not system.exists(at):
        return None
    status = system.getFileStatus(at)
    return path, status.getLen(), status.getModificationTime()
