"""Thread repair: lost links found from quotations, and threads joined by shared references."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import quote_level, same_subject, tokens, unquoted
from ..work import kept
from .graph import break_loops, components
from .lexicon import hit_rank, past_attribution
from .threads import connectivity, roots

#: Quoted lines of a root that are looked up, share of the best rank that counts, days around a parent.
LINES_MOST, SHARE, LATER, EARLIER = 16, 0.02, 365 * 86400, 30 * 86400


def quoted_lines(messages: DataFrame, conn: DataFrame) -> DataFrame:
    """``(idx, line, words)``: the first lines of each root that are quoted once, attributions of deeper quotations left out."""
    top = messages.join(conn.where("parent is null").select("idx"), "idx")
    lines = F.split(F.regexp_replace(F.coalesce("body", F.lit("")), r"^\n+", ""), "\n")
    once = F.slice(F.filter(past_attribution(lines), lambda x: quote_level(x) == 1), 1, LINES_MOST)
    return top.select("idx", F.posexplode(F.transform(once, lambda x: F.array_distinct(tokens(unquoted(x))))).alias("line", "words")).where(F.size("words") > 0)


def matches(lines: DataFrame, index: DataFrame) -> DataFrame:
    """``(line, post, rank, need)`` of distinct ``lines(line)``, words joined by spaces: the messages that have all their words as content.

    A line's rarest word finds the candidates, so common words never bring all their messages together; its other words
    are then looked up in those alone.
    """
    content = index.where(F.exists("hits", lambda h: h["type"] == 0)).select("word", F.col("idx").alias("post"), F.aggregate("hits", F.lit(0.0), lambda s, h: F.greatest(s, hit_rank(h["type"], h["pos"]))).alias("score"))
    content = kept(content, "content")
    spread = content.groupBy("word").agg(F.count("*").alias("df"))
    each = lines.select("line", F.explode(F.split("line", " ")).alias("word")).join(spread, "word")
    rare = each.groupBy("line").agg(F.count("*").alias("n"), F.min(F.struct("df", "word"))["word"].alias("rare")).where(F.col("n") == F.size(F.split("line", " ")))
    found = kept(rare.join(content.select(F.col("word").alias("rare"), "post", "score"), "rare").select("line", "post", "rare", "score"), "candidates")
    rest = found.select("line", "post", "rare", F.explode(F.split("line", " ")).alias("word")).where("word <> rare").join(content, ["word", "post"]).select("line", "post", "word", "score")
    met = rest.union(found.select("line", "post", F.col("rare").alias("word"), "score")).groupBy("line", "post").agg(F.array_sort(F.collect_list(F.struct("word", "score"))).alias("w"))
    full = met.where(F.size("w") == F.size(F.split("line", " ")))
    # In the order of the words, so that equal messages have equal ranks.
    return full.select("line", "post", F.aggregate("w", F.lit(0.0), lambda s, x: s + x["score"]).alias("rank"), F.size("w").alias("need"))


def best_posts(messages: DataFrame, conn: DataFrame, index: DataFrame) -> DataFrame:
    """``(idx, post)``: the message that the quoted lines of a root point to most strongly, the least number on ties.

    A line finds the other messages that have all its words; those within a fiftieth of its best one count with
    their rank times the square of the words. Lines are looked up once, and roots with the same lines are judged together,
    by their two best messages as a root isn't its own. Only where a root is a line's single best message does that
    line's limit change without it; such a root is judged by itself.
    """
    known = index.select("word").distinct()
    each = quoted_lines(messages, conn).select("idx", "line", F.explode("words").alias("word")).join(known, "word")
    lines = kept(each.groupBy("idx", "line").agg(F.array_join(F.array_sort(F.collect_list("word")), " ").alias("words")).select("idx", F.col("words").alias("line")), "quoted-lines")
    met = kept(matches(lines.distinct().select("line").distinct(), index), "matches")
    first = met.groupBy("line").agg(F.max(F.struct("rank", F.col("post"))).alias("top"))
    second = met.join(first, "line").where("post <> top.post").groupBy("line").agg(F.max("rank").alias("second"))
    limits = kept(first.join(second, "line", "left").select("line", F.col("top.post").alias("top"), F.col("top.rank").alias("best"), F.coalesce("second", F.lit(0.0)).alias("second")), "limits")
    alone = lines.join(limits, "line").where("idx = top and best > second").select("idx").distinct().withColumn("alone", F.col("idx"))
    asked = lines.join(alone, "idx", "left").groupBy("idx", "alone").agg(F.array_sort(F.collect_list("line")).alias("lines"))
    asked = kept(asked.select("idx", "alone", "lines", F.sha2(F.concat_ws("\n", F.col("alone").cast("string"), F.lit(""), F.array_join("lines", "\n")), 256).alias("group")), "asked")
    groups = asked.groupBy("group").agg(F.first("alone").alias("alone"), F.first("lines").alias("lines")).select("group", "alone", F.explode("lines").alias("line"))
    limit = SHARE * F.when(F.col("top") == F.col("alone"), F.col("second")).otherwise(F.col("best"))
    counted = groups.join(limits, "line").select("group", "alone", "line", limit.alias("limit")).join(met, "line").where("rank >= limit and (alone is null or post <> alone)")
    voted = counted.groupBy("group", "post").agg(F.array_sort(F.collect_list(F.col("rank") * F.col("need") * F.col("need"))).alias("v"))
    voted = kept(voted.select("group", "post", F.aggregate("v", F.lit(0.0), lambda s, x: s + x).alias("votes")), "votes")
    most = lambda rows, name: rows.groupBy("group").agg(F.max_by("post", F.struct("votes", -F.col("post"))).alias(name))
    one = most(voted, "one")
    two = most(voted.join(one, "group").where("post <> one"), "two")
    top = asked.join(one.join(two, "group", "left"), "group")
    return top.select("idx", F.when(F.col("one") == F.col("idx"), F.col("two")).otherwise(F.col("one")).alias("post")).where("post is not null")


def candidates(messages: DataFrame, conn: DataFrame, index: DataFrame) -> DataFrame:
    """``(idx, post)``: the best messages of ``best_posts`` that fit in time and keep the subject.

    They depend on texts and dates alone, so what links add later doesn't change them.
    """
    info = messages.select("idx", "epoch", "subject")
    got = best_posts(messages, conn, index).join(info, "idx").join(info.select(F.col("idx").alias("post"), F.col("epoch").alias("epoch2"), F.col("subject").alias("subject2")), "post")
    return got.where((F.col("epoch") <= F.col("epoch2") + LATER) & (F.col("epoch") >= F.col("epoch2") - EARLIER) & same_subject(F.col("subject"), F.col("subject2"))).select("idx", "post")


def quote_links(conn: DataFrame, found: DataFrame) -> DataFrame:
    """``(idx, parent)``: links of roots to the message that they quote, of ``candidates``, where it is in another thread.

    Of links that close a circle of threads one can't be a parent, as ``break_loops`` cuts; all others are. ``repair`` returns that one, too.
    """
    root_of = roots(conn).select("idx", "root")
    got = found.join(conn.where("parent is null").select("idx"), "idx").join(root_of.select(F.col("idx").alias("post"), F.col("root").alias("target")), "post").where("target <> idx")
    got = kept(got.select("idx", "post", "target"), "quote-links")
    if got.isEmpty():
        return got.select("idx", F.col("post").alias("parent"))
    ends = got.select(F.col("target").alias("idx")).join(got.select("idx"), "idx", "left_anti").distinct().select("idx", F.lit(None).cast("long").alias("parent"))
    sound = break_loops(kept(got.select("idx", F.col("target").alias("parent")).union(ends), "thread-links")).where("parent is not null").select("idx")
    return got.join(sound, "idx").select("idx", F.col("post").alias("parent"))


def group_links(messages: DataFrame, conn: DataFrame) -> DataFrame:
    """``(idx, parent)``: roots that share any reference, all but the earliest linked to it."""
    top = messages.join(conn.where("parent is null").select("idx"), "idx").select("idx", "epoch", F.explode("refs").alias("ref")).distinct()
    low = top.groupBy("ref").agg(F.min("idx").alias("u"))
    pairs = top.join(low, "ref").where("idx <> u").select("u", F.col("idx").alias("v"))
    member = components(pairs)
    dated = member.join(messages.select(F.col("idx").alias("node"), "epoch"), "node")
    first = dated.groupBy("root").agg(F.min(F.struct("epoch", "node")).alias("first"))
    return dated.join(first, "root").where("node <> first.node").select(F.col("node").alias("idx"), F.col("first.node").alias("parent"))


def apply_links(conn: DataFrame, links: DataFrame) -> DataFrame:
    """The connectivity table with ``links`` set as parents: children, sizes and order follow from it."""
    new = links.select("idx", F.col("parent").alias("new_parent"))
    rows = conn.select("idx", "epoch", "parent").join(new, "idx", "left").select("idx", "epoch", F.coalesce("parent", "new_parent").alias("parent"))
    return kept(connectivity(rows), "connectivity")


def repair(messages: DataFrame, conn: DataFrame, index: DataFrame) -> tuple[DataFrame, bool]:
    """The connectivity after links by quotation and by shared references until there is none left, and whether any was found.

    Each link makes a root a child and none is ever cut, so the rounds end. Then a message that quotes another one and is
    still a root has that one in its own thread: as a parent it would close a circle. ``quotes`` has all links by quotation, these too.
    """
    changed = False
    quotes = kept(candidates(messages, conn, index), "quotes")
    while True:
        found = False
        for links in (lambda: quote_links(conn, quotes), lambda: group_links(messages, conn)):
            got = kept(links(), "links")
            if not got.isEmpty():
                conn, found, changed = apply_links(conn, got), True, True
        if not found:
            return conn.join(quotes.select("idx", F.col("post").alias("quotes")), "idx", "left"), changed
