"""The shared folder, and what operators keep there between their jobs."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

from ..work import overwritten as written
from ..work import shared_dir

__all__ = ["listed", "map_batches", "read", "read_text", "release", "remove", "setting", "workspace", "write_text", "written"]


def workspace(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def _place(spark: SparkSession, path: str):
    """A path and its file system, through Spark's own layer."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a superseded table or file."""
    at, system = _place(spark, path)
    system.delete(at, True)


def listed(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder; none if there is no such folder."""
    at, system = _place(spark, path)
    return [x.getPath().getName() for x in system.listStatus(at)] if system.exists(at) else []


def write_text(spark: SparkSession, path: str, content: str) -> None:
    """A small file, which is there whole or not at all."""
    at, system = _place(spark, path)
    draft, _ = _place(spark, f"{path.rpartition('/')[0]}/.draft-{uuid.uuid4().hex}")
    out = system.create(draft, True)
    out.write(bytearray(content.encode()))
    out.close()
    system.delete(at, False)
    if not system.rename(draft, at):
        raise OSError(f"cannot write {path}")


def read_text(spark: SparkSession, path: str) -> str:
    return "\n".join(r[0] for r in spark.read.text(path).collect())


@contextmanager
def setting(spark: SparkSession, key: str, value: str) -> Iterator[None]:
    """A session setting for the jobs inside."""
    before = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


def release(spark: SparkSession) -> None:
    """Lets Spark's cleaner drop the shuffle files of jobs whose results are written."""
    spark.sparkContext._jvm.System.gc()


#: Rows that a reader or a Python worker holds at once: texts are long, and batches are held whole.
BATCH_ROWS = {"spark.sql.execution.arrow.maxRecordsPerBatch": 1000, "spark.sql.parquet.columnarReaderBatchSize": 512}


def bound_batches(spark: SparkSession) -> None:
    for key, most in BATCH_ROWS.items():
        if not 0 < int(spark.conf.get(key)) <= most:
            spark.conf.set(key, str(most))


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    bound_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def map_batches(df: DataFrame, function, schema) -> DataFrame:
    """``df.mapInArrow`` over batches of bounded rows."""
    bound_batches(df.sparkSession)
    return df.mapInArrow(function, schema)
