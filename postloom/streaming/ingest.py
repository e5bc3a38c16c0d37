"""Messages as they arrive: a landing folder read as a stream, deduplicated, and merged into an archive's table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def arriving(spark: SparkSession, path: str, schema: str, since: int = 0, late: str = "7 days") -> DataFrame:
    """New messages of a folder of Parquet files, from ``since`` on, each id once within the time that may be late."""
    rows = spark.readStream.schema(schema).parquet(path).where(F.col("epoch") >= since)
    return rows.withColumn("ts", F.timestamp_seconds("epoch")).withWatermark("ts", late).dropDuplicatesWithinWatermark(["msgid"])


def append_new(table: str) -> Callable[[DataFrame, int], None]:
    """A batch writer that appends the messages whose id ``table`` lacks; a batch that is run again writes its folder again."""

    def write(batch: DataFrame, epoch_id: int) -> None:
        spark = batch.sparkSession
        have = spark.read.schema(batch.schema).option("recursiveFileLookup", "true").parquet(table)
        have = have.where(~F.col("_metadata.file_path").contains(f"/batch={epoch_id}/"))
        batch.join(have.select("msgid").distinct(), "msgid", "left_anti").select(*batch.columns).write.mode("overwrite").parquet(f"{table}/batch={epoch_id}")

    return write


def ingest(rows: DataFrame, table: str, checkpoint: str) -> StreamingQuery:
    """Runs over what has arrived and stops."""
    return rows.writeStream.foreachBatch(append_new(table)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(rows: DataFrame, width: str, slide: str | None = None, late: str = "1 hour") -> DataFrame:
    """``(start, grp, n)`` over time windows of ``rows(ts, grp)``, batch or stream."""
    return rows.withWatermark("ts", late).groupBy(F.window("ts", width, slide or width), "grp").agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), "grp", "n")


def session_counts(rows: DataFrame, gap: str, late: str = "1 hour") -> DataFrame:
    """``(user_id, start, n)``: sessions that end after a pause of ``gap``."""
    return rows.withWatermark("ts", late).groupBy("user_id", F.session_window("ts", gap)).agg(F.count("*").alias("n")).select("user_id", F.col("session_window.start").alias("start"), "n")
