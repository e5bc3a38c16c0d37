"""Threading: from reference lists to parents, subtree sizes, order and tree queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import subject_kill
from .graph import ascend, break_loops, running_sum

#: Fixed values of the folded tree view: depth that is still shown, and the widest fold.
DEPTH_SHOWN, FOLD_MOST = 20, 15


def parents(messages: DataFrame) -> DataFrame:
    """``(idx, parent, ref_status)``: the rightmost reference that names a known message, or none.

    ``refs`` are in header order. Status: ``none`` without references, ``broken`` if none resolves.
    """
    refs = messages.select("idx", F.posexplode("refs").alias("pos", "msgid"))
    first = messages.groupBy("msgid").agg(F.min("idx").alias("parent"))
    found = refs.join(first, "msgid").groupBy("idx").agg(F.max_by("parent", "pos").alias("parent"))
    status = F.when(F.coalesce(F.size("refs"), F.lit(0)) <= 0, "none").when(F.col("parent").isNull(), "broken").otherwise("ok")
    return messages.select("idx", "refs").join(found, "idx", "left").select("idx", "parent", status.alias("ref_status"))


def connect(messages: DataFrame) -> DataFrame:
    """The connectivity table: parents by reference, loops broken, children by date, subtree sizes."""
    return connectivity(break_loops(parents(messages).select("idx", "parent")).join(messages.select("idx", "epoch"), "idx"))


def connectivity(links: DataFrame) -> DataFrame:
    """``(idx, epoch, parent, child_total, children)`` of a forest ``links(idx, parent, epoch)``."""
    totals = ascend(links.select("idx", "parent")).select("idx", F.col("total").alias("child_total"))
    return links.join(totals, "idx").join(children(links), "idx", "left").select("idx", "epoch", "parent", "child_total", F.coalesce("children", F.array().cast("array<long>")).alias("children"))


def children(links: DataFrame) -> DataFrame:
    """``(idx, children)`` of every message that has some, in order of date and number."""
    kids = links.where("parent is not null").groupBy(F.col("parent").alias("idx")).agg(F.array_sort(F.collect_list(F.struct("epoch", F.col("idx").alias("child")))).alias("kids"))
    return kids.select("idx", F.transform("kids", lambda k: k["child"]).alias("children"))


def thread_order(links: DataFrame) -> DataFrame:
    """``(idx, new_idx)``: preorder over threads, roots and siblings by date and number.

    A child stands after its parent and its earlier siblings' subtrees; these offsets are added up along
    the way to the root, so no path is ever built.
    """
    rows = links.join(ascend(links.select("idx", "parent")).select("idx", "total"), "idx")
    # One ordered sum over all siblings, less where each family begins: a parent of very many children is no task's own.
    sibling = running_sum(rows.where("parent is not null").select("idx", "parent", "epoch", "total"), ["parent", "epoch", "idx"], "total", "before")
    family = sibling.groupBy("parent").agg(F.min("before").alias("begin"))
    inner = sibling.join(family, "parent").select("idx", "parent", (1 + F.col("before") - F.col("begin")).alias("step"))
    roots = running_sum(rows.where("parent is null").select("idx", "epoch", "total"), ["epoch", "idx"], "total", "step").select("idx", F.lit(None).cast("long").alias("parent"), "step")
    return ascend(roots.union(inner)).select("idx", F.col("path").alias("new_idx"))


def toplevel(links: DataFrame) -> DataFrame:
    return links.where("parent is null").select("idx", "epoch")


def roots(links: DataFrame) -> DataFrame:
    """``(idx, root, depth, total)`` of every message."""
    return ascend(links.select("idx", "parent")).select("idx", "root", "depth", "total")


def all_visited(links: DataFrame, visited: DataFrame) -> DataFrame:
    """``(idx, all_visited)``: whether a message and everything below it were seen; unseen ones are summed up each subtree."""
    seen = links.join(visited.select("idx").distinct().withColumn("seen", F.lit(True)), "idx", "left")
    unseen = ascend(seen.select("idx", "parent", F.when(F.col("seen").isNull(), 1).otherwise(0).alias("weight")))
    return unseen.select("idx", (F.col("weight") == 0).alias("all_visited"))


def folded_depth(links: DataFrame) -> DataFrame:
    """``(root, max_depth, fold)``: how far a deep thread's view is folded."""
    deep = roots(links).groupBy("root").agg(F.max("depth").alias("max_depth"))
    fold = F.least(F.lit(FOLD_MOST), F.ceil((F.col("max_depth") - DEPTH_SHOWN) / 4))
    return deep.select("root", "max_depth", F.when(F.col("max_depth") > DEPTH_SHOWN, fold).otherwise(0).cast("long").alias("fold"))


def subject_rows(ordered: DataFrame) -> DataFrame:
    """``(idx, shown)`` in list order within each thread: ``>`` where the subject repeats the one before."""
    w = Window.partitionBy("root").orderBy("idx")
    plain = subject_kill(F.col("subject"))
    return ordered.select("idx", F.when(F.coalesce(F.lag(plain).over(w) == plain, F.lit(False)), F.lit(">")).otherwise(F.col("subject")).alias("shown"))


def next_in_tree(idx: Column, child_total: Column, expanded: Column) -> Column:
    """The next visible message of a sorted archive."""
    return idx + F.when(expanded, 1).otherwise(child_total)


def go_to(n: Column, count: Column) -> Column:
    """A typed index: negative ones count from the end, all are kept inside the archive."""
    return F.when(n < 0, F.greatest(count + n, F.lit(0))).otherwise(F.least(n, count - 1))
