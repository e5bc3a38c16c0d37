"""Graph steps on link tables: pointer doubling, components, cycle breaking, ordered sums.

Every loop works on whole tables with joins on node ids, in a number of rounds that
grows with the logarithm of the depth, and keeps each round in the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..work import forget, kept, kept_at, partitions


def ascend(links: DataFrame, rounds: int | None = None) -> DataFrame:
    """``(idx, root, depth, total, path[, weight])`` of a forest ``links(idx, parent[, step][, weight])``.

    ``root`` is the farthest ancestor, ``depth`` the links to it, ``total`` the nodes of the subtree, ``path``
    the sum of ``step`` from the root's to the node's own (1 where there is no such column), and ``weight``
    the sum of the column of that name over the subtree. ``rounds`` stops early, for tables that may have
    cycles; then ``up`` tells who has ancestors left.

    A round writes only the nodes that have ancestors left; what later rounds add to the subtrees of the
    others is kept aside and added at the end.
    """
    step = F.col("step").cast("long") if "step" in links.columns else F.lit(1).cast("long")
    sums = ["total", "weight"] if "weight" in links.columns else ["total"]
    own = [F.lit(1).cast("long").alias("total"), *(F.col(c).cast("long").alias(c) for c in sums[1:])]
    now = links.select("idx", F.col("parent").alias("up"), F.coalesce("parent", "idx").alias("root"), F.when(F.col("parent").isNull(), 0).otherwise(1).cast("long").alias("depth"), step.alias("path"), *own)
    now, turn = kept(now, "ascend"), 0
    settled, active, late = now.where("up is null"), now.where("up is not null"), None
    while (rounds is None or turn < rounds) and not active.isEmpty():
        turn += 1
        gain = active.groupBy(F.col("up").alias("idx")).agg(*(F.sum(c).alias(f"{c}2") for c in sums))
        above = settled.union(active).select(F.col("idx").alias("up"), F.col("up").alias("up2"), F.col("root").alias("root2"), F.col("depth").alias("depth2"), F.col("path").alias("path2"))
        more = gain.join(active.select("idx"), "idx", "left_anti")
        late = more if late is None else late.union(more)
        plus = lambda c: (F.col(c) + F.coalesce(f"{c}2", F.lit(0))).alias(c)
        now = active.join(above, "up", "left").join(gain, "idx", "left").select("idx", F.col("up2").alias("up"), F.coalesce("root2", "root").alias("root"), plus("depth"), plus("path"), *map(plus, sums))
        now = kept(now, "ascend")
        settled, active = settled.union(now.where("up is null")), now.where("up is not null")
    out = settled.union(active)
    if late is not None:
        late = late.groupBy("idx").agg(*(F.sum(f"{c}2").alias(f"{c}2") for c in sums))
        out = kept(out.join(late, "idx", "left").select("idx", "up", "root", "depth", "path", *((F.col(c) + F.coalesce(f"{c}2", F.lit(0))).alias(c) for c in sums)), "ascended")
    return out if rounds is not None else out.drop("up")


def break_loops(links: DataFrame) -> DataFrame:
    """``(idx, parent)`` without cycles.

    Nodes are visited in ascending order. The first one that leads into a cycle decides where it is
    cut: at itself if it is on the cycle, else at the cycle's node whose parent is the place of entry.
    """
    n = links.count()
    doubled = ascend(links.select("idx", "parent"), max(1, n.bit_length()))
    stuck = kept(doubled.where("up is not null").select("idx", "up"), "stuck")
    if stuck.isEmpty():
        return links.select("idx", "parent")
    ring = kept(stuck.select(F.col("up").alias("idx")).distinct().join(links.select("idx", "parent"), "idx"), "ring")
    # The least node of each ring, by doubling along the ring.
    low, path = kept_at(ring.select("idx", F.col("parent").alias("jump"), F.least("idx", "parent").alias("low")), "ring-low")
    for _ in range(max(1, ring.count().bit_length())):
        ahead = low.select(F.col("idx").alias("jump"), F.col("jump").alias("jump2"), F.col("low").alias("low2"))
        old = path
        low, path = kept_at(low.join(ahead, "jump").select("idx", F.col("jump2").alias("jump"), F.least("low", "low2").alias("low")), "ring-low")
        forget(links.sparkSession, old)
    # Where each stuck node enters its ring: its root once ring nodes count as roots.
    inner = stuck.select("idx").join(links.select("idx", "parent"), "idx").join(ring.select("idx", F.lit(True).alias("on")), "idx", "left")
    entry = ascend(inner.select("idx", F.when(F.col("on").isNull(), F.col("parent")).alias("parent"))).select("idx", F.col("root").alias("entry"))
    first = entry.join(low.select(F.col("idx").alias("entry"), "low"), "entry").groupBy("low").agg(F.min(F.struct("idx", "entry")).alias("first")).select("first.*")
    own = first.where("idx = entry").select(F.col("idx").alias("cut"))
    before = first.where("idx <> entry").join(ring.select(F.col("idx").alias("cut"), F.col("parent").alias("entry")), "entry").select("cut")
    cuts = own.union(before)
    return links.join(cuts.withColumn("is_cut", F.lit(True)), links["idx"] == F.col("cut"), "left").select("idx", F.when(F.col("is_cut").isNull(), F.col("parent")).alias("parent"))


def _least(links: DataFrame) -> DataFrame:
    low = links.groupBy("u").agg(F.min("v").alias("low")).select("u", F.least("u", "low").alias("m"))
    return links.join(low, "u")


def components(links: DataFrame) -> DataFrame:
    """``(node, root)`` for every node of ``links(u, v)``, ``root`` being the least node of its component."""
    now = links.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    (now, path), last = kept_at(now, "components"), None
    while True:
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == last or not mark[0]:
            break
        last = mark
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _least(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        near = _least(large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")))
        small = near.select(F.col("v").alias("u"), F.col("m").alias("v")).union(near.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        old = path
        now, path = kept_at(small, "components")
        forget(links.sparkSession, old)
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def running_sum(rows: DataFrame, order: list[str], value: str, name: str) -> DataFrame:
    """``rows`` with ``name``: the sum of ``value`` over all rows before in ``order``, without one task seeing all rows.

    Ranges of ``order`` go to partitions; each sums its own rows, and the partitions' totals, one number
    each, are added up separately.
    """
    n = partitions(rows.sparkSession)
    dealt = rows.repartitionByRange(n, *order).withColumn("_part", F.spark_partition_id())
    dealt = kept(dealt, "running-sum")
    totals = dealt.groupBy("_part").agg(F.sum(value).alias("_total"))
    before = totals.withColumn("_before", F.coalesce(F.sum("_total").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("_part", "_before")
    own = F.coalesce(F.sum(value).over(Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return dealt.withColumn("_own", own).join(F.broadcast(before), "_part").withColumn(name, F.col("_own") + F.col("_before")).drop("_part", "_own", "_before")
