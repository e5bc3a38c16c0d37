"""Messages across archives: crossposts, indirect links, and how copies differ."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: States of a message across archives.
STATES = ("Nothing", "Crosspost", "ParentDifferent", "ChildrenDifferent", "BothDifferent")


def archive_names(archives: DataFrame) -> DataFrame:
    """Archives with a name: the given one, or the tail of the path."""
    return archives.withColumn("name", F.coalesce(F.nullif("name", F.lit("")), F.regexp_extract("path", r"([^/]+)/*$", 1)))


def unique_ids(messages: DataFrame) -> DataFrame:
    return messages.select("msgid").distinct()


def groups(messages: DataFrame) -> DataFrame:
    """``(msgid, groups)``: the archives, in order, that have a message of ``messages(msgid, archive)``."""
    return messages.groupBy("msgid").agg(F.sort_array(F.collect_set("archive")).alias("groups"))


def indirect_links(messages: DataFrame) -> DataFrame:
    """``(child, parent)`` by reference across archives, for messages without a parent in their first archive.

    ``messages(msgid, archive, parent_id, refs)``. The rightmost reference that any archive has is the parent,
    unless some archive links the two already.
    """
    first = messages.groupBy("msgid").agg(F.min_by(F.struct("parent_id", "refs"), "archive").alias("f"))
    orphans = first.where("f.parent_id is null").select("msgid", F.posexplode("f.refs").alias("pos", "ref"))
    known = unique_ids(messages).withColumnRenamed("msgid", "ref")
    found = orphans.join(known, "ref").groupBy("msgid").agg(F.max_by("ref", "pos").alias("parent")).where("msgid <> parent").withColumnRenamed("msgid", "child")
    have = messages.where("parent_id is not null").select(F.col("msgid").alias("child"), F.col("parent_id").alias("parent")).distinct()
    return found.join(have, ["child", "parent"], "left_anti")


def states(messages: DataFrame, indirect: DataFrame | None = None) -> DataFrame:
    """``(msgid, n_groups, state)`` of ``messages(msgid, archive, parent_id, child_ids)``.

    Parents differ if the archives name several, one of them none included, or there is an indirect parent;
    children differ if their sets do, or there are indirect children.
    """
    kids = F.array_join(F.array_sort(F.array_distinct("child_ids")), "\n")
    each = messages.select("msgid", "archive", F.coalesce("parent_id", F.lit("")).alias("p"), kids.alias("k"))
    got = each.groupBy("msgid").agg(F.countDistinct("archive").alias("n_groups"), F.countDistinct("p").alias("np"), F.countDistinct("k").alias("nk"))
    if indirect is not None:
        up = indirect.select(F.col("child").alias("msgid")).distinct().withColumn("up", F.lit(True))
        down = indirect.select(F.col("parent").alias("msgid")).distinct().withColumn("down", F.lit(True))
        got = got.join(up, "msgid", "left").join(down, "msgid", "left")
    else:
        got = got.withColumn("up", F.lit(None).cast("boolean")).withColumn("down", F.lit(None).cast("boolean"))
    parent = (F.col("np") > 1) | F.col("up").isNotNull()
    child = (F.col("nk") > 1) | F.col("down").isNotNull()
    alone = (F.col("n_groups") == 1) & F.col("up").isNull() & F.col("down").isNull()
    state = F.when(alone, STATES[0]).when(parent & child, STATES[4]).when(parent, STATES[2]).when(child, STATES[3]).otherwise(STATES[1])
    return got.select("msgid", F.col("n_groups").cast("long").alias("n_groups"), state.alias("state"))


def warp_list(messages: DataFrame, archives: DataFrame, msgid: str, current: int) -> DataFrame:
    """Where a message can be seen: per archive its availability, depth, children and descendants."""
    return messages.where(F.col("msgid") == msgid).join(archives, messages["archive"] == archives["archive_id"]).select("archive_id", "name", "available", (F.col("archive_id") == current).alias("current"), "depth", "n_children", (F.col("child_total") - 1).alias("descendants"))


def indirect_children(links: DataFrame) -> DataFrame:
    """``(parent, children)``: the links of ``indirect_links`` from above, children in order of their ids."""
    return links.groupBy("parent").agg(F.sort_array(F.collect_set("child")).alias("children"))


def warp_relatives(messages: DataFrame, links: DataFrame, msgid: str) -> DataFrame:
    """``(msgid, relation, archive_id)``: indirect parents and children of a message, and where each can be seen."""
    up = links.where(F.col("child") == msgid).select(F.col("parent").alias("msgid"), F.lit("parent").alias("relation"))
    down = links.where(F.col("parent") == msgid).select(F.col("child").alias("msgid"), F.lit("child").alias("relation"))
    return messages.join(up.union(down), "msgid").select("msgid", "relation", F.col("archive").alias("archive_id")).distinct()


def locate(messages: DataFrame, archives: DataFrame, current: str) -> DataFrame:
    """``(msgid, archive)``: where an id leads from the archive ``current``: there if it has it, else to the first one that is available; null if none is."""
    rows = messages.select("msgid", F.col("archive").alias("archive_id")).join(archives.select("archive_id", "available"), "archive_id", "left")
    here = F.max(F.when(F.col("archive_id") == current, F.col("archive_id")))
    return rows.groupBy("msgid").agg(F.coalesce(here, F.min(F.when(F.col("available"), F.col("archive_id")))).alias("archive"))


def resolve(messages: DataFrame, archives: DataFrame) -> DataFrame:
    """``(msgid, archive)``: the first available archive of each message."""
    ready = archives.where("available").select(F.col("archive_id").alias("archive"))
    return messages.join(ready, "archive").groupBy("msgid").agg(F.min("archive").alias("archive"))
