"""Set operations between archives, and message filters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import is_msgid


def kill_duplicates(messages: DataFrame) -> DataFrame:
    """The first message of each valid id; messages without a valid id all stay.

    The first ones are found by a minimum per id, which is combined before the shuffle, so an id that
    many messages share costs no more than its partial results.
    """
    valid = is_msgid(F.col("msgid"))
    first = messages.where(valid).groupBy("msgid").agg(F.min("idx").alias("idx"))
    return messages.where(valid).join(first.select("idx"), "idx", "left_semi").unionByName(messages.where(~valid))


def merge(*sources: DataFrame, compat: bool = False) -> DataFrame:
    """All messages of the first source, then those of the others whose id it lacks.

    By default the others are also held against each other; ``compat`` compares with the first only.
    """
    first, *others = sources
    out = first
    for more in others:
        ids = (first if compat else out).select("msgid").distinct()
        out = out.unionByName(more.join(ids, "msgid", "left_anti").select(*first.columns))
    return out


def complement(a: DataFrame, b: DataFrame) -> DataFrame:
    """Messages of ``a`` whose id ``b`` lacks."""
    return a.join(b.select("msgid").distinct(), "msgid", "left_anti").select(*a.columns)


def update(source: DataFrame, new: DataFrame, overwrite: bool = False) -> DataFrame:
    """``source`` with the messages of ``new``; ``part`` gives the order of the two.

    By default what ``source`` already has stays and new messages stand first; with ``overwrite`` the
    messages of ``new`` win and stand last.
    """
    if overwrite:
        return complement(source, new).withColumn("part", F.lit(0)).unionByName(new.select(*source.columns).withColumn("part", F.lit(1)))
    return complement(new.select(*source.columns), source).withColumn("part", F.lit(0)).unionByName(source.withColumn("part", F.lit(1)))


def in_newsgroup(newsgroups: Column, group: str) -> Column:
    """Whether a comma-separated header names the group exactly; blanks before a name don't count."""
    return F.coalesce(F.exists(F.transform(F.split(newsgroups, ","), lambda g: F.regexp_replace(g, r"^[ ,]+", "")), lambda g: g == group), F.lit(False))


def filter_newsgroups(messages: DataFrame, group: str) -> DataFrame:
    return messages.where((F.col("epoch") != 0) & in_newsgroup(F.col("newsgroups"), group))


def filter_size(messages: DataFrame, most: int) -> DataFrame:
    return messages.where(F.octet_length("body") <= most)


def filter_ids(messages: DataFrame, ids: DataFrame) -> DataFrame:
    return messages.join(ids.select("msgid").distinct(), "msgid", "left_anti").select(*messages.columns)


def since(messages: DataFrame, epoch: int) -> DataFrame:
    return messages.where(F.col("epoch") >= epoch)


def unread(messages: DataFrame, visited: DataFrame) -> DataFrame:
    return filter_ids(messages, visited)


def next_unread(messages: DataFrame, visited: DataFrame, after: int) -> DataFrame:
    return unread(messages, visited).where(F.col("idx") > after).agg(F.min("idx").alias("idx"))


def history(views: DataFrame, most: int = 256) -> DataFrame:
    """The last views, newest first."""
    return views.orderBy(F.desc("seq")).limit(most)


def named_like(archives: DataFrame, part: str) -> DataFrame:
    return archives.where(F.col("name").contains(part))


def by_hash(seed: int) -> list[Column]:
    """An order that a seed decides: by a hash of seed and number."""
    return [F.md5(F.concat(F.lit(f"{seed}:"), F.col("idx").cast("string"))), F.col("idx")]


def shuffled(messages: DataFrame, seed: int) -> DataFrame:
    """Training order."""
    return messages.orderBy(*by_hash(seed))


def counters(before: DataFrame, after: DataFrame) -> DataFrame:
    """What an operation kept and dropped, and the bytes saved."""
    size = lambda df, name: df.agg(F.count("*").alias(f"n_{name}"), F.coalesce(F.sum(F.octet_length("body")), F.lit(0)).alias(f"bytes_{name}"))
    both = size(before, "before").crossJoin(size(after, "after"))
    return both.select("n_before", "n_after", (F.col("n_before") - F.col("n_after")).alias("n_dropped"), (F.col("bytes_before") - F.col("bytes_after")).alias("bytes_saved"))
