"""Tables of other shapes as messages, so that every operator can run on them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Turns of a conversation that its numbers leave room for, and the first conversation's date.
TURNS, START = 1000, 1704067200


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as messages: each answers the one before it; numbers follow conversation and turn."""
    c = read(spark, sf_dir, "conversations")
    key = lambda t: F.concat(F.col("conv_id").cast("string"), F.lit("."), t.cast("string"), F.lit("@conv"))
    return c.select(
        (F.col("conv_id") * TURNS + F.col("turn")).alias("idx"), key(F.col("turn")).alias("msgid"), F.when(F.col("turn") > 0, F.array(key(F.col("turn") - 1))).otherwise(F.array().cast("array<string>")).alias("refs"),
        (START + F.col("conv_id") * 3600 + F.col("turn") * 60).alias("epoch"), F.col("role").alias("author"), F.concat(F.lit("conv "), F.col("conv_id").cast("string")).alias("subject"), F.col("role").alias("newsgroups"), F.col("text").alias("body"),
    )


def event_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(idx, parent, epoch, grp)``: an event answers the user's latest view before it."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, -1)
    parent = F.last(F.when(F.col("event_type") == "view", F.col("event_id")), ignorenulls=True).over(w)
    return read(spark, sf_dir, "events").select(F.col("event_id").alias("idx"), parent.alias("parent"), F.unix_timestamp("ts").alias("epoch"), F.col("event_type").alias("grp"))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as messages of archives that are their sources; equal texts have one id."""
    return read(spark, sf_dir, "documents").select(F.col("doc_id").alias("idx"), F.concat(F.md5("text"), F.lit("@doc")).alias("msgid"), F.col("source").alias("archive"), F.lit(START).cast("long").alias("epoch"), F.lit("").alias("author"), F.left("text", F.lit(20)).alias("subject"), F.col("lang").alias("newsgroups"), F.col("text").alias("body"))


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(idx, body, spam)`` of documents with a label."""
    labels = read(spark, sf_dir, "labels").select(F.col("doc_id").alias("idx"), (F.col("toxic") == 1).alias("spam"))
    return documents(spark, sf_dir).select("idx", "body").join(labels, "idx")
