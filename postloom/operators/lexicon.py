"""The positional index: typed hits of words in messages, and statistics over it."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import quote_level, tokens, unquoted
from ..schema import HIT_MASKS, HIT_TYPES, HIT_WEIGHTS, HITS_MOST, MESSAGES_LEAST
from ..work import kept

_HIT = "array<struct<type:int,pos:int>>"


def by_type(type_: Column, values: tuple) -> Column:
    return reduce(lambda c, i: c.when(type_ == i, F.lit(values[i])), range(1, len(values)), F.when(type_ == 0, F.lit(values[0])))


def hit_rank(type_: Column, pos: Column) -> Column:
    """Weight of the field, falling to a tenth of it at the last position that is told apart."""
    return by_type(type_, HIT_WEIGHTS) * (0.1 + 0.9 * (1 - pos / by_type(type_, HIT_MASKS)))


def child_bucket(child_total: Column) -> Column:
    return F.floor(F.least(F.lit(248), child_total - 1) / 8).cast("int")


def line_types(body: Column, wrote_lines: Column | None = None) -> Column:
    """``[(line, type)]`` of a body without leading newlines.

    Lines after ``-- `` are signature, the first ``wrote_lines`` are attribution, the rest by quotation level.
    """
    text = F.regexp_replace(F.coalesce(body, F.lit("")), r"^\n+", "")
    lines = F.split(text, "\n")
    at = F.array_position(lines, "-- ")
    wrote = wrote_lines if wrote_lines is not None else wrote_count(lines)

    def kind(line: Column, i: Column) -> Column:
        level = F.least(quote_level(line), F.lit(3))
        return F.struct(F.when(level > 0, unquoted(line)).otherwise(line).alias("line"), F.when((at > 0) & (i + 1 >= at), 4).when(i < wrote, 7).otherwise(level).cast("int").alias("type"))

    return F.transform(lines, kind)


def wrote_count(lines: Column) -> Column:
    """How many lines at the top of a body say who wrote what is quoted below them (0 to 2)."""
    line = lambda i: F.coalesce(F.get(lines, F.lit(i)), F.lit(""))
    opening = (quote_level(line(0)) == 0) & (line(0) != "-- ") & (line(0) != "")
    ends = line(1).rlike(r"(:|\.\.\.)$") | line(1).rlike(r"^(\[.*\]|<.*>)$")
    return F.when(opening & (quote_level(line(1)) > 0), 1).when(opening & ends & (quote_level(line(2)) > 0), 2).otherwise(0)


def past_attribution(lines: Column) -> Column:
    """The lines from the first one that is quoted once, without those at its top that say who wrote what is quoted twice below them.

    Empty lines are left out. One line is dropped if the next one is quoted twice; two are if the second ends like an
    attribution or a cut and the third is quoted twice. Without a quoted line nothing is left.
    """
    full = F.filter(lines, lambda x: F.trim(F.translate(x, "\t", " ")) != "")

    def cut(x: Column) -> Column:
        levels = F.transform(x, quote_level)
        at = F.array_position(levels, F.lit(1)).cast("int")
        second = F.trim(F.coalesce(F.get(x, at), F.lit("")))
        ends = second.rlike(r"(:|\.\.\.)$") | second.rlike(r"^(\[.*\]|<.*>)$")
        level = lambda i: F.coalesce(F.get(levels, i), F.lit(0))
        drop = F.when(level(at) == 2, 1).when(ends & (level(at + 1) == 2), 2).otherwise(0)
        return F.when(at > 0, F.slice(x, F.greatest(at, F.lit(1)) + drop, F.greatest(F.size(x), F.lit(1)))).otherwise(F.slice(x, 1, 0))

    return F.element_at(F.transform(F.array(full), cut), 1)


def hits(messages: DataFrame, unicode: bool = False) -> DataFrame:
    """``(idx, type, word, pos)``: every index word, its position counted within its type over the message."""
    lines = F.concat(
        line_types(F.col("body")),
        F.array(F.struct(F.coalesce("subject", F.lit("")).alias("line"), F.lit(5).alias("type")), F.struct(F.coalesce("author", F.lit("")).alias("line"), F.lit(6).alias("type"))),
    )
    # One token array per type and message: positions come from the array, without a shuffle.
    typed = messages.select("idx", lines.alias("lines"))
    arrays = [F.struct(F.lit(t).alias("type"), F.flatten(F.transform(_of_type("lines", t), lambda x: tokens(x["line"], unicode))).alias("words")) for t in range(len(HIT_TYPES))]
    rows = typed.select("idx", F.explode(F.array(*arrays)).alias("a")).where(F.size("a.words") > 0)
    rows = rows.select("idx", F.col("a.type").alias("type"), F.posexplode("a.words").alias("place", "word"))
    return rows.select("idx", "type", "word", F.least("place", by_type(F.col("type"), HIT_MASKS)).cast("int").alias("pos"))


def _of_type(lines: str, t: int) -> Column:
    return F.filter(lines, lambda x: x["type"] == t)


def postings(messages: DataFrame, conn: DataFrame | None = None, unicode: bool = False) -> DataFrame:
    """``(word, idx, child_bucket, hitnum, hits)`` of words that at least two messages have.

    Hits are ordered by rank; a saturated position is kept once per type, and 255 hits at most.
    """
    total = conn.select("idx", "child_total") if conn is not None else messages.select("idx", F.lit(1).cast("long").alias("child_total"))
    grouped = hits(messages, unicode).groupBy("word", "idx").agg(F.collect_list(F.struct("type", "pos")).alias("all"))

    def saturated(h: Column) -> Column:
        return h["pos"] == by_type(h["type"], HIT_MASKS)

    ranked = F.concat(F.filter("all", lambda h: ~saturated(h)), F.array_distinct(F.filter("all", saturated)))
    order = F.transform(F.array_sort(F.transform(ranked, lambda h: F.struct((-hit_rank(h["type"], h["pos"])).alias("r"), h["type"].alias("type"), h["pos"].alias("pos")))), lambda h: F.struct(h["type"].alias("type"), h["pos"].alias("pos")))
    grouped = grouped.select("word", "idx", F.slice(order, 1, HITS_MOST).cast(_HIT).alias("hits"))
    # Both uses read the table: texts are cut into words once.
    grouped = kept(grouped, "words")
    spread = grouped.groupBy("word").agg(F.count("*").alias("df")).where(F.col("df") >= MESSAGES_LEAST).select("word")
    rows = grouped.join(spread, "word").join(total, "idx")
    return rows.select("word", "idx", child_bucket(F.col("child_total")).alias("child_bucket"), F.size("hits").alias("hitnum"), "hits")


def field_stats(index: DataFrame) -> DataFrame:
    """``(type, n_hits, share)`` of all eight fields, in percent of all hits."""
    each = index.select(F.explode("hits.type").alias("type")).groupBy("type").agg(F.count("*").alias("n"))
    kinds = index.sparkSession.createDataFrame(list(enumerate(HIT_TYPES)), "type int, name string")
    total = each.agg(F.sum("n").alias("total"))
    return F.broadcast(kinds).join(each, "type", "left").crossJoin(F.broadcast(total)).select(F.col("name").alias("field"), F.coalesce("n", F.lit(0)).alias("n_hits"), F.round(100 * F.coalesce("n", F.lit(0)) / F.col("total"), 6).alias("share"))


def word_stats(index: DataFrame) -> DataFrame:
    """``(word, n_hits, posting_bytes, overflow_bytes)``: what each word takes in the compact layout."""
    out = F.when(F.col("hitnum") > 3, F.col("hitnum") + 1).otherwise(0)
    return index.groupBy("word").agg(F.sum("hitnum").alias("n_hits"), (F.count("*") * 8).alias("posting_bytes"), F.sum(out).alias("overflow_bytes"))


def length_histogram(words: DataFrame) -> DataFrame:
    return words.groupBy(F.length("word").cast("long").alias("length")).agg(F.count("*").alias("n_words"))


def vocabulary(index: DataFrame) -> DataFrame:
    """``(word, df)``."""
    return index.groupBy("word").agg(F.count("*").alias("df"))


def resorted(index: DataFrame, conn: DataFrame, order: DataFrame | None = None) -> DataFrame:
    """The index after threads changed: new numbers and child buckets, hits as before."""
    rows = index.drop("child_bucket")
    if order is not None:
        rows = rows.join(order, "idx").drop("idx").withColumnRenamed("new_idx", "idx")
    return rows.join(conn.select("idx", "child_total"), "idx").select("word", "idx", child_bucket(F.col("child_total")).alias("child_bucket"), "hitnum", "hits")


def first_hits(index: DataFrame) -> DataFrame:
    """``(word, idx, hit)``: the first message of every word and its best hit there."""
    first = index.groupBy("word").agg(F.min(F.struct("idx", F.get("hits", F.lit(0)).alias("hit"))).alias("f"))
    return first.select("word", "f.idx", "f.hit")
