"""Checks of a built archive; each is a table of what is wrong, empty if nothing is."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..work import kept
from .graph import ascend
from .threads import thread_order


def reached(conn: DataFrame) -> DataFrame:
    """``idx`` of the messages that a root leads to; circles are told by their depth, which no tree of as many messages has."""
    return ascend(conn.select("idx", "parent"), max(1, conn.count().bit_length())).where("up is null").select("idx")


def unreachable(conn: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """V1: messages that no root leads to, or that are there more than once; ``known`` is what ``reached`` found, if it is at hand."""
    known = reached(conn) if known is None else known
    return conn.groupBy("idx").agg(F.count("*").alias("n")).join(known.distinct().withColumn("ok", F.lit(1)), "idx", "left").where("ok is null or n > 1").select("idx").distinct()


def wrong_lookups(messages: DataFrame) -> DataFrame:
    """V2: messages whose id leads to another number."""
    found = messages.groupBy("msgid").agg(F.min("idx").alias("found"))
    return messages.join(found, "msgid", "left").where("found is null or found <> idx").select("idx")


def out_of_order(conn: DataFrame) -> DataFrame:
    """V3: messages whose number isn't their place in thread order."""
    return conn.join(thread_order(conn.select("idx", "parent", "epoch")), "idx").where("idx <> new_idx").select("idx")


def bad_names(archives: DataFrame) -> DataFrame:
    """V4: archives without a name, or with one of several lines."""
    return archives.where("name is null or name = '' or name like '%\n%'").select("archive_id")


def missing_descriptions(archives: DataFrame) -> DataFrame:
    """V5: archives without a description."""
    return archives.where("coalesce(desc_short, '') = '' or coalesce(desc_long, '') = ''").select("archive_id")


def wrong_totals(conn: DataFrame) -> DataFrame:
    """V7: messages whose count of descendants is wrong."""
    return conn.join(ascend(conn.select("idx", "parent")).select("idx", "total"), "idx").where("child_total <> total").select("idx")


def duplicate_ids(messages: DataFrame) -> DataFrame:
    """V8: ids of more than one message."""
    return messages.groupBy("msgid").agg(F.count("*").alias("n")).where("n > 1")


def report(messages: DataFrame, conn: DataFrame, has_similar: bool) -> DataFrame:
    """``(check, n_wrong)`` of all checks on one archive; V6 says whether the table of similar words is there."""
    spark = messages.sparkSession
    # Order and totals are those of trees: what no root leads to is counted once, as such.
    known = kept(reached(conn).distinct(), "reached")
    sound = kept(conn.join(known, "idx", "left_semi"), "sound")
    parts = {"reachable": unreachable(conn, known), "lookup": wrong_lookups(messages), "order": out_of_order(sound), "totals": wrong_totals(sound), "unique": duplicate_ids(messages)}
    out = spark.createDataFrame([("similar_words", 0 if has_similar else 1)], "check string, n_wrong long")
    for name, wrong in parts.items():
        out = out.union(wrong.agg(F.count("*").alias("n_wrong")).select(F.lit(name).alias("check"), "n_wrong"))
    return out
