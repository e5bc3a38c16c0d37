"""Queries over the driver's tables and the SQL that DuckDB runs for each.

Shared pieces of SQL are common table expressions by name; ``_sql`` puts those in
front that a statement names.
"""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import work
from ..functions import dates, text
from ..operators import charts, fuzzy, galaxy, headers, lexicon, mime, render, repair, scores, setops, spam, threads, verify
from ..operators.graph import components
from ..sources import tables
from ..streaming import ingest
from . import archive
from . import search as search_plan
from .search import Flags

S = SparkSession
RULES = "10 subject ~CONV 3\n-3 from !USER\n5 subject =conv 7\n2 from ?ssist\nnot a rule"

_WORD = text.ASCII_WORD.replace("'", "''")
_KILL = text.kill_pattern().replace("'", "''")
_ESCAPE = "replace(replace(replace(replace({0}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;')"
_TURN = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz', 'NOPQRSTUVWXYZABCDEFGHIJKLMnopqrstuvwxyzabcdefghijklm')"
_TOKENS = f"list_filter(list_transform(regexp_extract_all(lower({{0}}), '{_WORD}'), lambda w: rtrim(w, '_')), lambda w: length(w) BETWEEN 3 AND 13)"
_GRAMS = "list_transform(range(1, length({0}) - {1} + 2), lambda i: substring({0}, i, {1}))"

CTES = {
    "conv": f"SELECT c.conv_id * {tables.TURNS} + c.turn AS idx, c.conv_id || '.' || c.turn || '@conv' AS msgid, p.conv_id * {tables.TURNS} + p.turn AS parent, {tables.START} + c.conv_id * 3600 + c.turn * 60 AS epoch, c.role AS author, 'conv ' || c.conv_id AS subject, c.text AS body FROM conversations c LEFT JOIN conversations p ON c.conv_id = p.conv_id AND p.turn = c.turn - 1",
    "ev": "SELECT event_id AS idx, last_value(CASE WHEN event_type = 'view' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS parent, CAST(floor(epoch(ts)) AS BIGINT) AS epoch, event_type AS grp FROM events",
    "up": "SELECT idx, idx AS anc, 0 AS d FROM ev UNION ALL SELECT up.idx, ev.parent, d + 1 FROM up JOIN ev ON up.anc = ev.idx WHERE ev.parent IS NOT NULL",
    "sized": "SELECT anc AS idx, CAST(count(*) AS BIGINT) AS total FROM up GROUP BY anc",
    "rooted": "SELECT idx, max_by(anc, d) AS root, CAST(max(d) AS BIGINT) AS depth FROM up GROUP BY idx",
    "path": "SELECT idx, lpad(CAST(epoch AS VARCHAR), 12, '0') || lpad(CAST(idx AS VARCHAR), 12, '0') AS p FROM ev WHERE parent IS NULL UNION ALL SELECT ev.idx, p || lpad(CAST(ev.epoch AS VARCHAR), 12, '0') || lpad(CAST(ev.idx AS VARCHAR), 12, '0') FROM path JOIN ev ON ev.parent = path.idx",
    "doc": "SELECT doc_id AS idx, md5(text) || '@doc' AS msgid, source AS archive, lang, text AS body FROM documents",
    "side_a": "SELECT * FROM doc WHERE coalesce(right(archive, 1) IN ('0', '2', '4', '6', '8'), FALSE)",
    "side_b": "SELECT * FROM doc WHERE NOT coalesce(right(archive, 1) IN ('0', '2', '4', '6', '8'), FALSE)",
    "said": f"SELECT idx, 0 AS type, {_TOKENS.format('body')} AS words FROM conv UNION ALL SELECT idx, 5, {_TOKENS.format('subject')} FROM conv UNION ALL SELECT idx, 6, {_TOKENS.format('author')} FROM conv",
    "spots": "SELECT idx, type, w.x AS word, least(w.i - 1, CASE type WHEN 0 THEN 127 ELSE 7 END) AS pos FROM (SELECT idx, type, unnest(list_transform(range(1, len(words) + 1), lambda i: {'i': i, 'x': words[i]})) AS w FROM said)",
    "hit": "SELECT DISTINCT ON (word, idx, type, pos, CASE WHEN pos = CASE type WHEN 0 THEN 127 ELSE 7 END THEN 0 ELSE n END) word, idx, type, pos, CASE type WHEN 0 THEN 1000.0 WHEN 5 THEN 1.0 ELSE 0.1 END * (0.1 + 0.9 * (1 - pos / CASE type WHEN 0 THEN 127.0 ELSE 7.0 END)) AS rank FROM (SELECT *, row_number() OVER () AS n FROM spots)",
    "top": "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY word, idx ORDER BY rank DESC, type, pos) AS r FROM hit) WHERE r <= 255",
    "df": "SELECT word, count(DISTINCT idx) AS df FROM hit GROUP BY word HAVING count(DISTINCT idx) > 1",
    "kids": f"SELECT idx, least(248, (SELECT count(*) FROM conversations d WHERE d.conv_id = idx // {tables.TURNS} AND d.turn >= idx % {tables.TURNS}) - 1) // 8 AS bucket FROM conv",
    "post": "SELECT word, idx, CAST(any_value(bucket) AS BIGINT) AS child_bucket, CAST(count(*) AS BIGINT) AS hitnum, string_agg(type || ':' || pos, ',' ORDER BY r) AS hits, max(rank) AS best FROM top JOIN df USING (word) JOIN kids USING (idx) GROUP BY word, idx",
}
_RECURSIVE = {"up", "path"}


def _sql(body: str) -> str:
    """``body`` behind the named expressions it needs, in order."""
    need: list[str] = []

    def add(name: str) -> None:
        for other in CTES:
            if other != name and other not in need and re.search(rf"\b(?:FROM|JOIN|,) {other}\b", CTES[name]):
                add(other)
        if name not in need:
            need.append(name)

    for name in CTES:
        if re.search(rf"\b(?:FROM|JOIN|,) {name}\b", body):
            add(name)
    return ("WITH RECURSIVE " + ", ".join(f"{n} AS ({CTES[n]})" for n in need) + " " if need else "") + body


QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def _query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = _sql(sql)
        return f

    return add


def _conn(spark: S, d: str) -> DataFrame:
    return threads.connect(tables.conversations(spark, d))


_INDEXES: dict[tuple, DataFrame] = {}


def _index(spark: S, d: str) -> DataFrame:
    """The index as the stored table that it is in an archive, sorted by word: a session builds that of unchanged messages once."""
    key = (spark.sparkContext.applicationId, d, tuple(work.stamp(spark, x) for x in tables.read(spark, d, "conversations").inputFiles()))
    if key in _INDEXES and all(work.stamp(spark, x) for x in _INDEXES[key].inputFiles()[:1]):
        return _INDEXES[key]
    rows = lexicon.postings(tables.conversations(spark, d), _conn(spark, d))
    _INDEXES[key] = work.kept(rows.repartitionByRange(work.partitions(spark), "word", "idx").sortWithinPartitions("word", "idx"), "index")
    return _INDEXES[key]


# Set operations and filters.


@_query("SELECT min(idx) AS idx, msgid FROM doc GROUP BY msgid")
def dup_kill(spark: S, d: str) -> DataFrame:
    return setops.kill_duplicates(tables.documents(spark, d)).select("idx", "msgid")


def _sides(spark: S, d: str) -> tuple[DataFrame, DataFrame]:
    """All documents in two archives: those of sources with an even number, and those of all others."""
    m = tables.documents(spark, d).drop("newsgroups")
    even = F.coalesce(F.right("archive", F.lit(1)).isin(list("02468")), F.lit(False))
    return m.where(even), m.where(~even)


@_query("SELECT idx, msgid FROM side_a UNION ALL SELECT idx, msgid FROM side_b y WHERE NOT EXISTS (SELECT 1 FROM side_a x WHERE x.msgid = y.msgid)")
def merge_raw(spark: S, d: str) -> DataFrame:
    return setops.merge(*_sides(spark, d)).select("idx", "msgid")


@_query("SELECT idx, msgid FROM side_b y WHERE NOT EXISTS (SELECT 1 FROM side_a x WHERE x.msgid = y.msgid)")
def rel_complement(spark: S, d: str) -> DataFrame:
    a, b = _sides(spark, d)
    return setops.complement(b, a).select("idx", "msgid")


@_query("SELECT idx, msgid, CAST(0 AS BIGINT) AS part FROM side_b y WHERE NOT EXISTS (SELECT 1 FROM side_a x WHERE x.msgid = y.msgid) UNION ALL SELECT idx, msgid, 1 FROM side_a")
def update_append(spark: S, d: str) -> DataFrame:
    return setops.update(*_sides(spark, d)).select("idx", "msgid", F.col("part").cast("long").alias("part"))


@_query("SELECT idx, msgid, CAST(0 AS BIGINT) AS part FROM side_a x WHERE NOT EXISTS (SELECT 1 FROM side_b y WHERE y.msgid = x.msgid) UNION ALL SELECT idx, msgid, 1 FROM side_b")
def update_overwrite(spark: S, d: str) -> DataFrame:
    return setops.update(*_sides(spark, d), overwrite=True).select("idx", "msgid", F.col("part").cast("long").alias("part"))


@_query("SELECT idx, msgid FROM doc WHERE lang = 'fr'")
def filter_newsgroups(spark: S, d: str) -> DataFrame:
    return setops.filter_newsgroups(tables.documents(spark, d), "fr").select("idx", "msgid")


@_query("SELECT idx FROM doc WHERE strlen(body) <= 2000")
def filter_size(spark: S, d: str) -> DataFrame:
    return setops.filter_size(tables.documents(spark, d), 2000).select("idx")


@_query("SELECT count(*) AS n_before, (SELECT count(DISTINCT msgid) FROM doc) AS n_after, count(*) - (SELECT count(DISTINCT msgid) FROM doc) AS n_dropped, CAST(sum(strlen(body)) - (SELECT sum(strlen(body)) FROM doc WHERE idx IN (SELECT min(idx) FROM doc GROUP BY msgid)) AS BIGINT) AS bytes_saved FROM doc")
def dedup_counters(spark: S, d: str) -> DataFrame:
    docs = tables.documents(spark, d)
    return setops.counters(docs, setops.kill_duplicates(docs))


@_query(f"SELECT idx FROM conv WHERE epoch >= {tables.START + 86400}")
def date_limit(spark: S, d: str) -> DataFrame:
    return setops.since(tables.conversations(spark, d), tables.START + 86400).select("idx")


@_query("SELECT idx FROM conv WHERE author <> 'user'")
def unread(spark: S, d: str) -> DataFrame:
    m = tables.conversations(spark, d)
    return setops.unread(m, m.where("author = 'user'")).select("idx")


@_query("SELECT idx FROM doc ORDER BY idx DESC LIMIT 256")
def view_history(spark: S, d: str) -> DataFrame:
    return setops.history(tables.documents(spark, d).select("idx", F.col("idx").alias("seq"))).select("idx")


# Charts and counters.


@_query("SELECT strftime(make_timestamp(epoch * 1000000), '%Y%m') AS month, count(*) AS n FROM conv WHERE epoch <> 0 GROUP BY 1")
def timechart(spark: S, d: str) -> DataFrame:
    return charts.time_chart(tables.conversations(spark, d))


@_query(
    "SELECT segment, n, n_hits, CAST(floor(n * 64 / (max(n) OVER () + 1)) AS BIGINT) AS bar, strftime(make_timestamp(CAST(lo + floor(segment * (hi - lo + 1) / 59) AS BIGINT) * 1000000), '%Y-%m') AS label"
    " FROM (SELECT CAST(floor((epoch - lo) * 59 / (hi - lo + 1)) AS BIGINT) AS segment, count(*) AS n, count(*) FILTER (grp = 'purchase') AS n_hits, min(lo) AS lo, max(hi) AS hi FROM ev, (SELECT min(epoch) AS lo, max(epoch) AS hi FROM ev) GROUP BY 1)"
)
def activity_hist(spark: S, d: str) -> DataFrame:
    e = tables.event_links(spark, d)
    return charts.activity(e, 60, only=e.where("grp = 'purchase'"))


@_query("SELECT CAST(floor((max(epoch) - min(epoch)) / 59 / 86400) AS BIGINT) AS days FROM ev WHERE epoch <> 0")
def column_days(spark: S, d: str) -> DataFrame:
    return charts.days_per_column(tables.event_links(spark, d), 60)


@_query("SELECT 'srv' || idx % 7 AS server, max(idx * 3) AS last FROM ev WHERE idx % 2 = 0 GROUP BY 1")
def xref_max(spark: S, d: str) -> DataFrame:
    server = F.concat(F.lit("srv"), (F.col("idx") % 7).cast("string"))
    entry = F.concat(F.lit(" other:9 "), F.when(F.col("idx") % 2 == 0, "grp").otherwise("grp2"), F.lit(":"), (F.col("idx") * 3).cast("string"))
    return charts.xref(tables.event_links(spark, d).select(F.concat(server, entry).alias("xref")), "grp")


@_query("SELECT regexp_extract(msgid, '@(.*)$', 1) AS host, count(*) AS n, count(*) * (length(regexp_extract(msgid, '@(.*)$', 1)) - 1) AS gain FROM conv GROUP BY 1")
def host_model(spark: S, d: str) -> DataFrame:
    return charts.host_model(tables.conversations(spark, d))


@_query(f"SELECT gram, count(*) AS n FROM (SELECT unnest({_GRAMS.format("split_part(msgid, '@', 1)", 3)}) AS gram FROM conv) GROUP BY gram")
def ngram_model(spark: S, d: str) -> DataFrame:
    return charts.ngram_model(tables.conversations(spark, d), 3)


@_query("SELECT time_bucket(INTERVAL '1 hour', ts) AS start, event_type AS grp, count(*) AS n FROM events GROUP BY 1, 2")
def windowed_counts(spark: S, d: str) -> DataFrame:
    return ingest.windowed_counts(tables.read(spark, d, "events").select("ts", F.col("event_type").alias("grp")), "1 hour")


@_query("SELECT user_id, min(ts) AS start, count(*) AS n FROM (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM (SELECT *, CASE WHEN ts >= lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) + INTERVAL '6 hours' THEN 1 ELSE 0 END AS new FROM events)) GROUP BY user_id, s")
def session_counts(spark: S, d: str) -> DataFrame:
    return ingest.session_counts(tables.read(spark, d, "events"), "6 hours")


# Threads.


@_query("SELECT idx, epoch FROM ev WHERE parent IS NULL")
def toplevel(spark: S, d: str) -> DataFrame:
    return threads.toplevel(tables.event_links(spark, d))


@_query("SELECT parent AS idx, string_agg(CAST(idx AS VARCHAR), ',' ORDER BY epoch, idx) AS children FROM ev WHERE parent IS NOT NULL GROUP BY parent")
def children(spark: S, d: str) -> DataFrame:
    return threads.children(tables.event_links(spark, d)).select("idx", F.array_join(F.transform("children", lambda c: c.cast("string")), ",").alias("children"))


@_query("SELECT idx, depth FROM rooted")
def parent_depth(spark: S, d: str) -> DataFrame:
    return threads.roots(tables.event_links(spark, d)).select("idx", "depth")


@_query("SELECT idx, root FROM rooted")
def thread_roots(spark: S, d: str) -> DataFrame:
    return threads.roots(tables.event_links(spark, d)).select("idx", "root")


@_query("SELECT idx, total FROM sized")
def subtree_total(spark: S, d: str) -> DataFrame:
    return threads.roots(tables.event_links(spark, d)).select("idx", "total")


@_query("SELECT idx, row_number() OVER (ORDER BY p) - 1 AS new_idx FROM path")
def thread_sort(spark: S, d: str) -> DataFrame:
    return threads.thread_order(tables.event_links(spark, d))


@_query("SELECT c.idx, c.parent, CAST((SELECT count(*) FROM conv k WHERE k.idx >= c.idx AND k.idx // 1000 = c.idx // 1000) AS BIGINT) AS child_total FROM conv c")
def connectivity(spark: S, d: str) -> DataFrame:
    return _conn(spark, d).select("idx", "parent", "child_total")


@_query("SELECT root, max(depth) AS max_depth, CASE WHEN max(depth) > 20 THEN least(15, CAST(ceil((max(depth) - 20) / 4.0) AS BIGINT)) ELSE 0 END AS fold FROM rooted GROUP BY root")
def folded_depth(spark: S, d: str) -> DataFrame:
    return threads.folded_depth(tables.event_links(spark, d))


@_query("SELECT anc AS idx, bool_and(grp <> 'error') AS all_visited FROM up JOIN ev ON up.idx = ev.idx GROUP BY anc")
def subtree_visited(spark: S, d: str) -> DataFrame:
    e = tables.event_links(spark, d)
    return threads.all_visited(e, e.where("grp <> 'error'"))


@_query("SELECT idx, CASE WHEN idx % 1000 > 0 THEN '>' ELSE subject END AS shown FROM conv")
def subject_rows(spark: S, d: str) -> DataFrame:
    m = tables.conversations(spark, d)
    return threads.subject_rows(m.withColumn("subject", F.concat(F.when(F.col("idx") % 2 == 1, "Re: ").otherwise(""), "subject")).withColumn("root", F.floor(F.col("idx") / tables.TURNS)))


@_query("SELECT 'lookup' AS \"check\", CAST(0 AS BIGINT) AS n_wrong UNION ALL SELECT 'order', count(*) FROM (SELECT row_number() OVER (ORDER BY idx) - 1 AS n, idx FROM conv) WHERE n <> idx UNION ALL SELECT 'reachable', 0 UNION ALL SELECT 'similar_words', 0 UNION ALL SELECT 'totals', 0 UNION ALL SELECT 'unique', 0")
def verify_counts(spark: S, d: str) -> DataFrame:
    return verify.report(tables.conversations(spark, d), _conn(spark, d), True)


_TANGLED = f"idx // {tables.TURNS} % 5 = 0 AND EXISTS (SELECT 1 FROM conv k WHERE k.idx = conv.idx // {tables.TURNS} * {tables.TURNS} + 1)"


@_query(
    f"SELECT 'lookup' AS \"check\", count(*) AS n_wrong FROM conv WHERE idx % {tables.TURNS} = 1 UNION ALL SELECT 'unique', count(*) FROM conv WHERE idx % {tables.TURNS} = 1"
    f" UNION ALL SELECT 'reachable', count(*) FROM conv WHERE {_TANGLED} UNION ALL SELECT 'totals', count(*) FROM conv WHERE NOT ({_TANGLED}) AND idx % 7 = 0 UNION ALL SELECT 'similar_words', 1"
    f" UNION ALL SELECT 'order', count(*) FROM (SELECT row_number() OVER (ORDER BY idx) - 1 AS n, idx FROM conv WHERE NOT ({_TANGLED})) WHERE n <> idx"
)
def verify_broken(spark: S, d: str) -> DataFrame:
    """An archive with repeated ids, circles, wrong totals and without a table of similar words."""
    turn = F.col("idx") % tables.TURNS
    first = F.col("idx") - turn
    m = tables.conversations(spark, d)
    twice = F.when(turn == 1, F.concat((first / tables.TURNS).cast("long").cast("string"), F.lit(".0@conv"))).otherwise(F.col("msgid"))
    conn = _conn(spark, d).withColumn("child_total", F.col("child_total") + F.when(F.col("idx") % 7 == 0, 1).otherwise(0))
    looped = (turn == 0) & (first / tables.TURNS % 5 == 0) & (F.size("children") > 0)
    conn = conn.withColumn("parent", F.when(looped, F.col("idx") + 1).otherwise(F.col("parent")))
    return verify.report(m.withColumn("msgid", twice), conn, False)


@_query("SELECT s_suppkey AS archive_id, s_suppkey % 5 IN (0, 1, 2) AS bad_name, s_suppkey % 3 = 0 OR s_suppkey % 4 = 0 AS no_description FROM supplier")
def archive_checks(spark: S, d: str) -> DataFrame:
    """Names that are missing, empty or of several lines, and missing descriptions."""
    k, name = F.col("s_suppkey"), F.col("s_name")
    named = F.when(k % 5 == 0, F.lit(None).cast("string")).when(k % 5 == 1, "").when(k % 5 == 2, F.concat(name, F.lit("\nmore"))).otherwise(name)
    archives = tables.read(spark, d, "supplier").select(k.alias("archive_id"), named.alias("name"), F.when(k % 3 == 0, "").otherwise(name).alias("desc_short"), F.when(k % 4 == 0, F.lit(None).cast("string")).otherwise(name).alias("desc_long"))
    bad = verify.bad_names(archives).withColumn("bad_name", F.lit(True))
    bare = verify.missing_descriptions(archives).withColumn("no_description", F.lit(True))
    rows = archives.select("archive_id").join(bad, "archive_id", "left").join(bare, "archive_id", "left")
    return rows.select("archive_id", *(F.coalesce(c, F.lit(False)).alias(c) for c in ("bad_name", "no_description")))


@_query(
    f"SELECT idx, CASE WHEN idx // {tables.TURNS} % 2 = 0 THEN parent WHEN turn = 0 AND k > 1 THEN idx + 1 WHEN turn = 1 AND k > 2 THEN idx - turn + k - 1 WHEN turn > 2 THEN idx - 1 END AS parent"
    f" FROM (SELECT *, idx % {tables.TURNS} AS turn, count(*) OVER (PARTITION BY idx // {tables.TURNS}) AS k FROM conv)"
)
def loops_broken(spark: S, d: str) -> DataFrame:
    """Even conversations are circles from their first turn; in odd ones the first turn leads into a circle of the others."""
    from ..operators.graph import break_loops

    turn, conv = F.col("idx") % tables.TURNS, F.floor(F.col("idx") / tables.TURNS)
    m = tables.conversations(spark, d).select("idx", conv.alias("conv"), turn.alias("turn"))
    m = m.join(m.groupBy("conv").agg(F.count("*").alias("k")), "conv")
    last = F.col("idx") - F.col("turn") + F.col("k") - 1
    even = F.when(F.col("turn") > 0, F.col("idx") - 1).otherwise(last)
    odd = F.when(F.col("turn") > 1, F.col("idx") - 1).when(F.col("turn") == 1, last).when(F.col("k") > 1, F.col("idx") + 1)
    return break_loops(m.select("idx", F.when(F.col("conv") % 2 == 0, even).otherwise(odd).alias("parent")))


@_query("SELECT u.event_id AS node, min(v.event_id) AS root FROM events u JOIN events v ON u.user_id = v.user_id WHERE u.user_id IN (SELECT user_id FROM events GROUP BY user_id HAVING count(*) > 1) GROUP BY u.event_id")
def shared_reference_groups(spark: S, d: str) -> DataFrame:
    e = tables.read(spark, d, "events").select("user_id", "event_id")
    low = e.groupBy("user_id").agg(F.min("event_id").alias("u"))
    return components(e.join(low, "user_id").select("u", F.col("event_id").alias("v")))


# Index and search.


@_query(f"SELECT doc_id AS idx, array_to_string({_TOKENS.format('text')}, ' ') AS words FROM documents")
def tokens(spark: S, d: str) -> DataFrame:
    return tables.documents(spark, d).select("idx", F.array_join(text.tokens(F.col("body")), " ").alias("words"))


@_query("SELECT word, idx, child_bucket, hitnum, hits FROM post")
def postings(spark: S, d: str) -> DataFrame:
    hits = F.array_join(F.transform("hits", lambda h: F.concat_ws(":", h["type"].cast("string"), h["pos"].cast("string"))), ",")
    return _index(spark, d).select("word", "idx", F.col("child_bucket").cast("long").alias("child_bucket"), F.col("hitnum").cast("long").alias("hitnum"), hits.alias("hits"))


@_query("SELECT f.name AS field, coalesce(n, 0) AS n_hits, round(100.0 * coalesce(n, 0) / (SELECT count(*) FROM top JOIN df USING (word)), 6) AS share FROM (VALUES (0, 'content'), (1, 'quote1'), (2, 'quote2'), (3, 'quote3'), (4, 'signature'), (5, 'subject'), (6, 'from'), (7, 'wrote')) f(type, name) LEFT JOIN (SELECT type, count(*) AS n FROM top JOIN df USING (word) GROUP BY type) USING (type)")
def lexstats_field(spark: S, d: str) -> DataFrame:
    return lexicon.field_stats(_index(spark, d))


@_query("SELECT word, CAST(sum(hitnum) AS BIGINT) AS n_hits, count(*) * 8 AS posting_bytes, CAST(sum(CASE WHEN hitnum > 3 THEN hitnum + 1 ELSE 0 END) AS BIGINT) AS overflow_bytes FROM post GROUP BY word")
def lexstats_word(spark: S, d: str) -> DataFrame:
    return lexicon.word_stats(_index(spark, d))


@_query("SELECT length(word) AS length, count(*) AS n_words FROM df GROUP BY 1")
def word_lengths(spark: S, d: str) -> DataFrame:
    return lexicon.length_histogram(lexicon.vocabulary(_index(spark, d)))


_NEAR = "SELECT x.word, y.word AS \"similar\", y.df AS df2, levenshtein(x.word, y.word) AS dist FROM df x JOIN df y ON x.word <> y.word AND y.df >= floor(x.df / 10) AND abs(length(x.word) - length(y.word)) <= 3 WHERE levenshtein(x.word, y.word) <= CASE WHEN length(x.word) <= 5 THEN 1 WHEN length(x.word) <= 10 THEN 2 ELSE 3 END"


@_query(f"SELECT word, \"similar\", CAST(dist AS BIGINT) AS dist FROM (SELECT *, max(df2) OVER (PARTITION BY word) AS best FROM ({_NEAR})) WHERE df2 >= floor(best / 5)")
def lexdist(spark: S, d: str) -> DataFrame:
    return fuzzy.similar_words(lexicon.vocabulary(_index(spark, d))).select("word", "similar", F.col("dist").cast("long").alias("dist"))


@_query(f"SELECT count(*) AS n_words, round(avg(n), 6) AS avg_similar FROM (SELECT word, count(*) AS n FROM (SELECT *, max(df2) OVER (PARTITION BY word) AS best FROM ({_NEAR})) WHERE df2 >= floor(best / 5) GROUP BY word)")
def lexdist_average(spark: S, d: str) -> DataFrame:
    return fuzzy.average_similar(fuzzy.similar_words(lexicon.vocabulary(_index(spark, d))))


@_query(
    f"SELECT idx, t.type, CAST(CASE t.type WHEN 0 THEN 1 + len({_TOKENS.format('body')}) WHEN 1 THEN 2 WHEN 2 THEN 1 WHEN 3 THEN 1 WHEN 4 THEN 2 WHEN 5 THEN len({_TOKENS.format('subject')}) WHEN 6 THEN 1 ELSE 2 END AS BIGINT) AS n FROM conv, (SELECT unnest(range(8)) AS type) t"
)
def field_types(spark: S, d: str) -> DataFrame:
    """Index words of each field of messages with an attribution, quotations of three levels and a signature."""
    body = F.concat(F.lit("John wrote:\n> quoted one\n>> deeper\n>>> deepest\nplain "), F.translate("body", "\n", " "), F.lit("\n-- \nsig name"))
    hits = lexicon.hits(tables.conversations(spark, d).withColumn("body", body))
    return hits.groupBy("idx", F.col("type").cast("long").alias("type")).agg(F.count("*").alias("n"))


_SCORE = "best * (1 + 2 * hitnum / 255.0)"
_THREAD = "(0.25 + 0.75 * child_bucket / 31.0)"


def _found(spark: S, d: str, query: str, flags: Flags, **more) -> DataFrame:
    return search_plan.search(_index(spark, d), query, flags, **more).select("idx", F.round("rank", 6).alias("rank"))


@_query(f"SELECT idx, round({_SCORE} * {_THREAD}, 6) AS rank FROM post WHERE word = 'that'")
def search_single(spark: S, d: str) -> DataFrame:
    return _found(spark, d, "That", Flags())


@_query(f"SELECT idx, round(sum({_SCORE}) * any_value({_THREAD}), 6) AS rank FROM post WHERE word IN ('that', 'with') GROUP BY idx HAVING count(*) = 2")
def search_all(spark: S, d: str) -> DataFrame:
    return _found(spark, d, "that with", Flags(require_all=True))


@_query(f"SELECT idx, round(sum({_SCORE}) * any_value({_THREAD}), 6) AS rank FROM post WHERE word IN ('that', 'with') GROUP BY idx")
def search_any(spark: S, d: str) -> DataFrame:
    return _found(spark, d, "that with", Flags())


@_query(
    f"SELECT p.idx, round(sum({_SCORE}) / max(CASE WHEN n = 2 THEN coalesce(dist, 127) ELSE 127 END) * any_value({_THREAD}), 6) AS rank FROM post p JOIN (SELECT idx, count(*) AS n FROM post WHERE word IN ('that', 'with') GROUP BY idx) USING (idx)"
    " LEFT JOIN (SELECT x.idx, min(greatest(abs(x.pos - y.pos), 1)) AS dist FROM top x JOIN top y ON x.idx = y.idx AND x.type = y.type WHERE x.word = 'that' AND y.word = 'with' AND x.pos < CASE x.type WHEN 0 THEN 127 ELSE 7 END AND y.pos < CASE y.type WHEN 0 THEN 127 ELSE 7 END GROUP BY x.idx) q ON q.idx = p.idx WHERE p.word IN ('that', 'with') GROUP BY p.idx"
)
def search_adjacent(spark: S, d: str) -> DataFrame:
    return _found(spark, d, "that with", Flags(adjacent=True))


@_query(f"SELECT idx, round(sum({_SCORE}) * any_value({_THREAD}), 6) AS rank FROM post WHERE word IN ('that', 'with', 'from') AND idx IN (SELECT idx FROM post WHERE word = 'that') AND idx NOT IN (SELECT idx FROM post WHERE word = 'from') GROUP BY idx")
def search_setlogic(spark: S, d: str) -> DataFrame:
    return _found(spark, d, "+that with -from", Flags(set_logic=True))


@_query(f"SELECT idx, round(sum({_SCORE}) * any_value({_THREAD}), 6) AS rank FROM post WHERE word LIKE 'tha%' GROUP BY idx")
def search_prefix(spark: S, d: str) -> DataFrame:
    return _found(spark, d, "tha*", Flags(set_logic=True))


def _term_sql(word: str, type_: int) -> str:
    return f"SELECT idx, round(sum({_SCORE}) * any_value({_THREAD}), 6) AS rank FROM post WHERE word = 'that' OR (word = '{word}' AND idx IN (SELECT idx FROM top WHERE word = '{word}' AND type = {type_})) GROUP BY idx"


@_query(_term_sql("user", 6))
def search_from_term(spark: S, d: str) -> DataFrame:
    return _found(spark, d, "from:user that", Flags(set_logic=True))


@_query(_term_sql("conv", 5))
def search_subject_term(spark: S, d: str) -> DataFrame:
    return _found(spark, d, "that subject:conv", Flags(set_logic=True))


@_query(f"SELECT idx, round(sum({_SCORE}) * any_value({_THREAD}), 6) AS rank FROM post WHERE word IN ('that', 'with') GROUP BY idx HAVING count(*) = 2")
def search_flags(spark: S, d: str) -> DataFrame:
    """Fuzzy without a table of similar words falls away; then all words are required and set logic is off."""
    return _found(spark, d, "that with", Flags(require_all=True, set_logic=True, fuzzy=True))


@_query("SELECT idx, round(best, 6) AS rank FROM post WHERE word = 'that'")
def search_simple(spark: S, d: str) -> DataFrame:
    return _found(spark, d, "that", Flags(simple=True))


@_query("SELECT idx, epoch FROM conv WHERE idx IN (SELECT idx FROM post WHERE word = 'that') ORDER BY epoch DESC, idx LIMIT 20")
def result_order(spark: S, d: str) -> DataFrame:
    """The twenty newest messages that were found."""
    found = search_plan.search(_index(spark, d), "that", Flags())
    return search_plan.ordered(found, tables.conversations(spark, d), "newest").limit(20).select("idx", "epoch")


@_query(f"SELECT p.idx, round({_SCORE} * {_THREAD}, 6) AS rank FROM post p WHERE word = 'user' AND idx IN (SELECT idx FROM top WHERE word = 'user' AND type = 6)")
def search_field(spark: S, d: str) -> DataFrame:
    return _found(spark, d, "user", Flags(), only="from")


@_query(
    f"SELECT idx, round(sum({_SCORE} * m) * any_value({_THREAD}), 6) AS rank FROM post JOIN (SELECT 'that' AS word, 1.0 AS m UNION ALL SELECT \"similar\", CASE dist WHEN 1 THEN 0.01 WHEN 2 THEN 0.001 ELSE 0.0001 END FROM (SELECT *, max(df2) OVER (PARTITION BY word) AS best FROM ({_NEAR})) WHERE df2 >= floor(best / 5) AND word = 'that') USING (word) GROUP BY idx"
)
def search_fuzzy(spark: S, d: str) -> DataFrame:
    index = _index(spark, d)
    near = fuzzy.similar_words(lexicon.vocabulary(index), ["that"])
    return search_plan.search(index, "that", Flags(fuzzy=True), near).select("idx", F.round("rank", 6).alias("rank"))


@_query(f"SELECT idx, round(rank / max(rank) OVER (), 6) AS share FROM (SELECT idx, {_SCORE} * {_THREAD} AS rank FROM post WHERE word = 'with')")
def relative_rank(spark: S, d: str) -> DataFrame:
    return search_plan.relative(search_plan.search(_index(spark, d), "with", Flags())).select("idx", F.round("share", 6).alias("share"))


@_query("SELECT idx, string_agg(type || ':' || pos, ',' ORDER BY r) AS hits FROM top JOIN df USING (word) WHERE word = 'that' AND r <= 4 GROUP BY idx")
def top_hits(spark: S, d: str) -> DataFrame:
    hits = F.array_join(F.transform("hits", lambda h: F.concat_ws(":", h["type"].cast("string"), h["pos"].cast("string"))), ",")
    return search_plan.search(_index(spark, d), "that", Flags()).select("idx", hits.alias("hits"))


# Archives beside each other.


@_query("SELECT msgid, array_to_string(list_sort(list(DISTINCT archive)), ',') AS groups FROM doc GROUP BY msgid")
def galaxy_groups(spark: S, d: str) -> DataFrame:
    return galaxy.groups(tables.documents(spark, d)).select("msgid", F.array_join("groups", ",").alias("groups"))


@_query("SELECT msgid, count(DISTINCT archive) AS n_groups, CASE WHEN count(DISTINCT archive) = 1 THEN 'Nothing' WHEN count(DISTINCT lang) > 1 AND count(DISTINCT n % 2) > 1 THEN 'BothDifferent' WHEN count(DISTINCT lang) > 1 THEN 'ParentDifferent' WHEN count(DISTINCT n % 2) > 1 THEN 'ChildrenDifferent' ELSE 'Crosspost' END AS state FROM (SELECT msgid, archive, lang, idx AS n FROM doc) GROUP BY msgid")
def galaxy_state(spark: S, d: str) -> DataFrame:
    m = tables.documents(spark, d).select("msgid", "archive", F.col("newsgroups").alias("parent_id"), F.array((F.col("idx") % 2).cast("string")).alias("child_ids"))
    return galaxy.states(m)


@_query("SELECT msgid, min(archive) AS archive FROM doc WHERE archive <> 'src0' GROUP BY msgid")
def galaxy_resolve(spark: S, d: str) -> DataFrame:
    m = tables.documents(spark, d)
    return galaxy.resolve(m, m.select(F.col("archive").alias("archive_id")).distinct().withColumn("available", F.col("archive_id") != "src0"))


@_query("SELECT msgid, CASE WHEN bool_or(archive = 'src3') THEN 'src3' ELSE min(archive) FILTER (archive <> 'src0') END AS archive FROM doc GROUP BY msgid")
def galaxy_locate(spark: S, d: str) -> DataFrame:
    """Where an id leads from one archive: to itself, or to the first other one that can be opened."""
    m = tables.documents(spark, d)
    ready = m.select(F.col("archive").alias("archive_id")).distinct().withColumn("available", F.col("archive_id") != "src0")
    return galaxy.locate(m, ready, "src3")


def _scattered(spark: S, d: str) -> DataFrame:
    """Turns by turns in two archives, each without the messages that its own refer to."""
    return tables.conversations(spark, d).select("msgid", (F.col("idx") % 2).alias("archive"), F.lit(None).cast("string").alias("parent_id"), F.array().cast("array<string>").alias("child_ids"), "refs")


@_query("SELECT p.msgid AS parent, string_agg(c.msgid, ',' ORDER BY c.msgid) AS children FROM conv c JOIN conv p ON c.parent = p.idx GROUP BY p.msgid")
def indirect_children(spark: S, d: str) -> DataFrame:
    return galaxy.indirect_children(galaxy.indirect_links(_scattered(spark, d))).select("parent", F.array_join("children", ",").alias("children"))


@_query("SELECT msgid, CAST(1 AS BIGINT) AS n_groups, CASE WHEN parent IS NOT NULL AND down THEN 'BothDifferent' WHEN parent IS NOT NULL THEN 'ParentDifferent' WHEN down THEN 'ChildrenDifferent' ELSE 'Nothing' END AS state FROM (SELECT *, EXISTS (SELECT 1 FROM conv k WHERE k.parent = conv.idx) AS down FROM conv)")
def galaxy_indirect_state(spark: S, d: str) -> DataFrame:
    m = _scattered(spark, d)
    return galaxy.states(m, galaxy.indirect_links(m))


@_query("SELECT msgid, relation, archive_id FROM (SELECT p.msgid, 'parent' AS relation, p.idx % 2 AS archive_id FROM conv c JOIN conv p ON c.parent = p.idx WHERE c.msgid = '3.1@conv' UNION ALL SELECT k.msgid, 'child', k.idx % 2 FROM conv c JOIN conv k ON k.parent = c.idx WHERE c.msgid = '3.1@conv')")
def warp_relatives(spark: S, d: str) -> DataFrame:
    m = _scattered(spark, d)
    return galaxy.warp_relatives(m, galaxy.indirect_links(m), "3.1@conv")


# Scores and spam.


@_query("SELECT idx, CAST(s AS BIGINT) AS score, CASE WHEN s > 0 THEN 'Positive' WHEN s < 0 THEN 'Negative' ELSE 'Neutral' END AS verdict FROM (SELECT idx, CASE WHEN subject = 'conv 3' THEN 10 ELSE 0 END - CASE WHEN regexp_matches(author, '(?i)USER') THEN 3 ELSE 0 END + CASE WHEN subject = 'conv 7' THEN 5 ELSE 0 END + CASE WHEN regexp_matches(author, 'ssist') THEN 2 ELSE 0 END AS s FROM conv)")
def score_rules(spark: S, d: str) -> DataFrame:
    return scores.score(tables.conversations(spark, d), scores.parse_rules(RULES))


@_query(f"SELECT idx, len(list_distinct(CASE WHEN length(t) >= 4 THEN {_GRAMS.format('t', 4)} ELSE [] END)) AS n FROM (SELECT idx, left(body, 3000) AS t FROM doc)")
def spam_features(spark: S, d: str) -> DataFrame:
    return tables.documents(spark, d).select("idx", F.size(spam.features(F.col("body"))).cast("long").alias("n"))


_LABEL = "SELECT doc_id AS idx, toxic = 1 AS spam, left(text, 3000) AS t FROM documents JOIN labels USING (doc_id)"


@_query(
    f"WITH l AS ({_LABEL}), f AS (SELECT idx, spam, unnest(list_distinct({_GRAMS.format('t', 4)})) AS g FROM l WHERE length(t) >= 4), m AS (SELECT g, count(*) FILTER (spam) AS s, count(*) FILTER (NOT spam) AS h FROM f GROUP BY g), n AS (SELECT count(*) FILTER (spam) AS s, count(*) FILTER (NOT spam) AS h FROM l)"
    " SELECT l.idx, round(1 / (1 + exp(-((coalesce(x, 0) + ln((n.s + 0.1) / (n.h + 0.1))) / 3200))), 6) AS score FROM l LEFT JOIN (SELECT idx, sum(ln((m.s + 0.1) / (m.h + 0.1) * (n.h + 0.2) / (n.s + 0.2))) AS x FROM f JOIN m USING (g), n GROUP BY idx) USING (idx), n"
)
def nb_score(spark: S, d: str) -> DataFrame:
    rows = tables.labelled(spark, d)
    n = rows.agg(F.count_if("spam").alias("s"), F.count_if(~F.col("spam")).alias("h")).first()
    return spam.naive_bayes(rows, spam.naive_bayes_model(rows), n["s"], n["h"]).select("idx", F.round("score", 6).alias("score"))


@_query("SELECT idx, md5('7:' || idx) AS key FROM ev JOIN sized USING (idx) WHERE parent IS NULL AND total = 1 AND grp <> 'error'")
def spam_candidates(spark: S, d: str) -> DataFrame:
    """Roots without answers that nobody has seen, and what their order in training is."""
    e = tables.event_links(spark, d).withColumn("msgid", F.col("idx").cast("string"))
    conn = e.join(threads.roots(e).select("idx", F.col("total").alias("child_total")), "idx")
    return spam.training_candidates(conn.select("idx", "parent", "child_total"), e.select("idx", "msgid"), e.where("grp = 'error'"), 7).select("idx", setops.by_hash(7)[0].alias("key"))


@_query(None)
def spam_predict(spark: S, d: str) -> DataFrame:
    rows = tables.labelled(spark, d)
    n = rows.agg(F.count_if("spam").alias("s"), F.count_if(~F.col("spam")).alias("h")).first()
    model, weights = spam.train(rows)
    return spam.predict(rows, model, n["s"], n["h"], weights).withColumn("band", spam.band(F.col("score")))


# Scalar functions.


@_query(f"SELECT doc_id AS idx, md5(regexp_replace('Re: RE[2]:  Odp: ' || text, '{_KILL}', '')) AS subject FROM documents")
def subject_kill(spark: S, d: str) -> DataFrame:
    """Of whole texts, as digests."""
    return tables.read(spark, d, "documents").select(F.col("doc_id").alias("idx"), F.md5(text.subject_kill(F.concat(F.lit("Re: RE[2]:  Odp: "), F.col("text")))).alias("subject"))


@_query(f"SELECT doc_id AS idx, md5({_TURN.format('text')}) AS turned FROM documents")
def rot13(spark: S, d: str) -> DataFrame:
    """Of whole texts, as digests."""
    return tables.read(spark, d, "documents").select(F.col("doc_id").alias("idx"), F.md5(text.rot13(F.col("text"))).alias("turned"))


@_query(f"SELECT page_id AS idx, md5({_ESCAPE.format('html')}) AS escaped FROM pages")
def html_escape(spark: S, d: str) -> DataFrame:
    return tables.read(spark, d, "pages").select(F.col("page_id").alias("idx"), F.md5(text.html_escape(F.col("html"))).alias("escaped"))


@_query("SELECT page_id AS idx, array_to_string(list_filter(list_transform(regexp_extract_all('see ' || url || ', or (' || url || '). x://y', '(?:[A-Za-z]{3,}://|news:)[^\\s<>\"]+'), lambda u: regexp_replace(u, '[.,;:()]+$', '')), lambda u: length(u) >= 6), ' ') AS urls FROM pages")
def url_find(spark: S, d: str) -> DataFrame:
    line = F.concat(F.lit("see "), F.col("url"), F.lit(", or ("), F.col("url"), F.lit("). x://y"))
    return tables.read(spark, d, "pages").select(F.col("page_id").alias("idx"), F.array_join(text.find_urls(line), " ").alias("urls"))


@_query("SELECT page_id AS idx, replace(url || '%', '%', '%25') AS encoded, url || '%' AS decoded FROM pages")
def uri_code(spark: S, d: str) -> DataFrame:
    coded = text.uri_encode(F.concat("url", F.lit("%")))
    return tables.read(spark, d, "pages").select(F.col("page_id").alias("idx"), coded.alias("encoded"), text.uri_decode(coded).alias("decoded"))


@_query("SELECT idx, strftime(make_timestamp(epoch * 1000000), '%Y-%m-%d %H:%M') AS minute, strftime(make_timestamp(epoch * 1000000), '%Y-%m') AS month, strftime(make_timestamp(epoch * 1000000), '%a %b ') || lpad(strftime(make_timestamp(epoch * 1000000), '%-d'), 2, ' ') || strftime(make_timestamp(epoch * 1000000), ' %H:%M:%S %Y') AS asctime FROM conv")
def date_formats(spark: S, d: str) -> DataFrame:
    e = F.col("epoch")
    return tables.conversations(spark, d).select("idx", dates.minute(e).alias("minute"), dates.month(e).alias("month"), dates.asctime(e).alias("asctime"))


@_query("SELECT doc_id AS idx, length(text) AS n_chars, strlen(text) AS n_bytes, left(text, 17) AS head, lower(left(text, 17)) AS low FROM documents")
def text_lengths(spark: S, d: str) -> DataFrame:
    t = F.col("text")
    return tables.read(spark, d, "documents").select(F.col("doc_id").alias("idx"), F.char_length(t).cast("long").alias("n_chars"), F.octet_length(t).cast("long").alias("n_bytes"), text.char_prefix(t, 17).alias("head"), F.lower(text.char_prefix(t, 17)).alias("low"))


_MIX = "".join(x for x, _ in text.MOJIBAKE)


@_query(
    f"SELECT doc_id AS idx, regexp_full_match(left(text, 1), '\\p{{L}}') AS alpha, regexp_full_match(left(text, 2), '[\\p{{L}}\\p{{N}}]+') AS alnum, regexp_full_match(right(text, 1), '\\p{{P}}') AS punct, md5(replace(replace(text, ' ', ''), chr(9), '')) AS tight,"
    f" md5(translate(text || '{_MIX}', '{_MIX}', '{''.join(x for _, x in text.MOJIBAKE)}')) AS mended, 1 / (1 + exp(-(length(text) % 9 - 4.0))) AS logistic, greatest(10, least(length(text), 1000)) AS clamped FROM documents WHERE text IS NOT NULL AND length(text) > 1"
)
def text_classes(spark: S, d: str) -> DataFrame:
    t, n = F.col("text"), F.char_length("text")
    rows = tables.read(spark, d, "documents").where(n > 1)
    return rows.select(
        F.col("doc_id").alias("idx"), text.is_alpha(F.left(t, F.lit(1))).alias("alpha"), text.is_alnum(F.left(t, F.lit(2))).alias("alnum"), text.is_punct(F.right(t, F.lit(1))).alias("punct"), F.md5(text.without_blanks(t)).alias("tight"),
        F.md5(text.fix_mojibake(F.concat(t, F.lit(_MIX)))).alias("mended"), text.logistic(n % 9 - 4.0).alias("logistic"), text.clamp(n, F.lit(10), F.lit(1000)).cast("long").alias("clamped"),
    )


@_query("SELECT word, list_aggregate(list_transform(string_split(word, ''), lambda c: 1::BIGINT << (unicode(c) % 63)), 'bit_or') AS bits FROM df")
def word_signatures(spark: S, d: str) -> DataFrame:
    return lexicon.vocabulary(_index(spark, d)).select("word", text.code_point_signature(F.col("word")).alias("bits"))


@_query("SELECT page_id AS idx, regexp_full_match(CASE page_id % 4 WHEN 0 THEN url || '@x' WHEN 1 THEN url WHEN 2 THEN 'a@b@' || url ELSE '<' || url || '@y' END, '[ -;=?A-~]+@[ -;=?A-~]+') AS valid FROM pages")
def msgid_valid(spark: S, d: str) -> DataFrame:
    u = F.col("url")
    k = F.col("page_id") % 4
    made = F.when(k == 0, F.concat(u, F.lit("@x"))).when(k == 1, u).when(k == 2, F.concat(F.lit("a@b@"), u)).otherwise(F.concat(F.lit("<"), u, F.lit("@y")))
    return tables.read(spark, d, "pages").select(F.col("page_id").alias("idx"), text.is_msgid(made).alias("valid"))


# Raw messages, reading, navigation, repair and whole archives.


def _raw(spark: S, d: str) -> DataFrame:
    m = tables.conversations(spark, d)
    refs = F.when(F.size("refs") > 0, F.concat(F.lit("References: <"), F.array_join("refs", "> <"), F.lit(">\n"))).otherwise("")
    date = F.date_format(F.timestamp_seconds("epoch"), "d MMM yyyy HH:mm:ss")
    text_ = F.concat(F.lit('From: "'), "author", F.lit('" <a@b.c>\nMessage-ID: <'), "msgid", F.lit(">\n"), refs, F.lit("Subject: Re: "), "subject", F.lit("\nDate: "), date, F.lit(" +0100\nNewsgroups: x, talk\n\n"), "body")
    return m.select("idx", text_.alias("raw"))


@_query("SELECT idx, msgid, epoch - 3600 AS epoch, author AS realname, 'Re: ' || subject AS subject, CASE WHEN parent IS NULL THEN '' ELSE parent // 1000 || '.' || parent % 1000 || '@conv' END AS refs, md5(regexp_replace(body, '^\\n+', '')) AS body FROM conv")
def header_fields(spark: S, d: str) -> DataFrame:
    m = headers.messages(_raw(spark, d))
    return m.select("idx", "msgid", "epoch", "realname", "subject", F.array_join("refs", " ").alias("refs"), F.md5("body").alias("body"))


@_query("SELECT idx, epoch + CASE idx % 5 WHEN 0 THEN -3600 WHEN 1 THEN 18000 WHEN 2 THEN 0 WHEN 3 THEN -7200 ELSE -epoch % 60 END AS epoch FROM conv")
def date_shapes(spark: S, d: str) -> DataFrame:
    """Dates with weekdays, zone names, comments, dashes, and without seconds."""
    e, k = F.timestamp_seconds("epoch"), F.col("idx") % 5
    shown = lambda form, zone: F.concat(F.date_format(e, form), F.lit(zone))
    date = (
        F.when(k == 0, shown("EEE, dd MMM yyyy HH:mm:ss", " +0100 (CET)")).when(k == 1, shown("d MMM yyyy HH:mm:ss", " EST"))
        .when(k == 2, shown("dd-MMM-yy HH:mm:ss", " GMT")).when(k == 3, shown("EEE, d MMM yyyy HH:mm:ss", " +0200")).otherwise(shown("EEE, d MMM yyyy HH:mm", " UT"))
    )
    raw = tables.conversations(spark, d).select("idx", F.concat(F.lit("From: a@b.c\nDate: "), date, F.lit("\n\nx")).alias("raw"))
    return headers.messages(raw).select("idx", "epoch")


@_query("SELECT msgid, author AS realname, 'Re: ' || subject AS subject, md5(regexp_replace(regexp_replace(body || chr(10), '(^|\\n)From ', '\\1>From ', 'g'), '^\\n+', '')) AS body FROM conv")
def mailbox_messages(spark: S, d: str) -> DataFrame:
    """Mailboxes of many messages each, lines that would open one marked, read back and cut into fields."""
    from ..sources import mail

    path = f"{work.shared_dir(spark)}/mailboxes-{uuid.uuid4().hex}"
    safe = F.regexp_replace("raw", r"(\n)From ", "$1>From ")
    raw = _raw(spark, d).select(F.concat(F.lit("From somebody\n"), safe).alias("value"), F.pmod("idx", F.lit(8)).alias("box"))
    raw.repartition("box").select("value").write.text(path)
    found = mail.mbox(spark, f"{path}/*.txt").select("idx", F.decode("content", "UTF-8").alias("raw"))
    return headers.messages(found).select("msgid", "realname", "subject", F.md5("body").alias("body"))


@_query("SELECT idx, strlen('From: a@b.c' || chr(10) || 'Subject: ' || subject || chr(10, 10) || body) AS n_bytes FROM conv".replace("chr(10, 10)", "chr(10) || chr(10)"))
def raw_size(spark: S, d: str) -> DataFrame:
    raw = tables.conversations(spark, d).select("idx", F.concat(F.lit("From: a@b.c\nSubject: "), "subject", F.lit("\n\n"), "body").alias("raw"))
    return headers.messages(raw).select("idx", F.col("size").cast("long").alias("n_bytes"))


@_query("SELECT idx, md5('From: a@b.c' || chr(10) || 'Subject: zażółć ' || idx || chr(10) || chr(10) || regexp_replace(body, '[^\\x20-\\x7E]', '', 'g') || CASE idx % 3 WHEN 0 THEN ' ąćę' WHEN 1 THEN ' ąłż' ELSE ' łą' END) AS raw FROM conv")
def utf8_messages(spark: S, d: str) -> DataFrame:
    """Encoded header words, and bodies in three code pages that no header names."""
    word = F.base64(F.encode(F.concat(F.lit("zażółć "), F.col("idx").cast("string")), "UTF-8"))
    plain = F.regexp_replace("body", r"[^\x20-\x7E]", "")
    k = F.col("idx") % 3
    tail = F.when(k == 0, F.unhex(F.lit("20B9E6EA"))).when(k == 1, F.unhex(F.lit("20B1B3BF"))).otherwise(F.unhex(F.lit("2088A5")))
    head = F.concat(F.lit("From: a@b.c\nSubject: =?UTF-8?B?"), word, F.lit("?=\n\n"), plain)
    rows = tables.conversations(spark, d).select("idx", F.concat(F.encode(head, "UTF-8"), tail).alias("content"))
    return mime.to_utf8(rows).select("idx", F.md5("raw").alias("raw"))


@_query("SELECT idx, CAST(CASE idx % 4 WHEN 0 THEN 0 WHEN 1 THEN 1 ELSE 2 END AS BIGINT) AS level FROM ev")
def quote_levels(spark: S, d: str) -> DataFrame:
    mark = F.element_at(F.array(F.lit("text"), F.lit("> a"), F.lit("AB>> b"), F.lit(": > c :)")), (F.col("idx") % 4 + 1).cast("int"))
    return tables.event_links(spark, d).select("idx", text.quote_level(mark).cast("long").alias("level"))


@_query("SELECT idx, CASE WHEN idx * 2 - 500 < 0 THEN greatest(1000 + idx * 2 - 500, 0) ELSE least(idx * 2 - 500, 999) END AS place FROM ev")
def go_to_place(spark: S, d: str) -> DataFrame:
    return tables.event_links(spark, d).select("idx", threads.go_to(F.col("idx") * 2 - 500, F.lit(1000)).alias("place"))


@_query("SELECT idx, idx + CASE WHEN grp = 'view' THEN 1 ELSE total END AS next FROM ev JOIN sized USING (idx)")
def next_visible(spark: S, d: str) -> DataFrame:
    e = tables.event_links(spark, d)
    return e.join(threads.roots(e).select("idx", "total"), "idx").select("idx", threads.next_in_tree(F.col("idx"), F.col("total"), F.col("grp") == "view").alias("next"))


@_query("SELECT c.msgid AS child, p.msgid AS parent FROM conv c JOIN conv p ON c.parent = p.idx")
def indirect_links(spark: S, d: str) -> DataFrame:
    m = tables.conversations(spark, d)
    return galaxy.indirect_links(m.select("msgid", (F.col("idx") % 2).alias("archive"), F.lit(None).cast("string").alias("parent_id"), "refs")).select("child", "parent")


@_query("SELECT idx, first AS parent FROM (SELECT idx, first_value(idx) OVER (PARTITION BY idx // 10000 ORDER BY epoch, idx) AS first FROM conv) WHERE idx <> first")
def shared_reference_repair(spark: S, d: str) -> DataFrame:
    m = tables.conversations(spark, d).withColumn("refs", F.array(F.concat(F.lit("gone."), F.floor(F.col("idx") / 10000).cast("string"), F.lit("@x"))))
    conn = m.select("idx", "epoch", F.lit(None).cast("long").alias("parent"))
    return repair.group_links(m, conn).select("idx", "parent")


@_query("SELECT idx FROM ev JOIN sized USING (idx) WHERE parent IS NULL AND total = 1 AND idx % 10 > 5 UNION ALL SELECT idx FROM rooted WHERE root IN (SELECT root FROM rooted GROUP BY root HAVING count(*) > 1 AND min(idx % 10) >= 2)")
def spam_filter(spark: S, d: str) -> DataFrame:
    e = tables.event_links(spark, d)
    conn = e.join(threads.roots(e).select("idx", F.col("total").alias("child_total")), "idx")
    return spam.spam_messages(e, conn, e.select("idx", (F.col("idx") % 10 / 10).alias("score")), thread=0.2)


@_query("SELECT idx, CASE WHEN idx % 100 < 35 THEN 'valid' WHEN idx % 100 <= 50 THEN 'unsure/valid' WHEN idx % 100 <= 65 THEN 'unsure/spam' ELSE 'spam' END AS band FROM ev")
def spam_bands(spark: S, d: str) -> DataFrame:
    return tables.event_links(spark, d).select("idx", spam.band((F.col("idx") % 100) / 100.0).alias("band"))


@_query(None)
def rendered_lines(spark: S, d: str) -> DataFrame:
    return render.lines(_raw(spark, d), 76)


@_query("SELECT idx, md5('<table><tr><th>From</th><td>' || author || '</td></tr><tr><th>Subject</th><td>' || subject || '</td></tr><tr><th>Date</th><td>' || strftime(make_timestamp(epoch * 1000000), '%Y-%m-%d %H:%M:%S +0000') || '</td></tr></table><pre>' || " + _ESCAPE.format("body") + " || '</pre>') AS page FROM conv")
def html_message(spark: S, d: str) -> DataFrame:
    return render.html(tables.conversations(spark, d)).select("idx", F.md5("html").alias("page"))


@_query(None)
def previews(spark: S, d: str) -> DataFrame:
    return render.previews(tables.conversations(spark, d), ["that", "with"])


@_query(None)
def quote_repair(spark: S, d: str) -> DataFrame:
    """Turns as messages that quote the one before and have lost their references."""
    m = tables.conversations(spark, d)
    before = m.select((F.col("idx") + 1).alias("idx"), F.regexp_extract("body", r"^([^\n]*)", 1).alias("said"))
    m = m.join(before, "idx", "left").withColumn("body", F.concat(F.coalesce(F.concat(F.lit("> "), "said", F.lit("\n")), F.lit("")), "body")).withColumn("refs", F.array().cast("array<string>"))
    conn = threads.connect(m)
    return repair.repair(m, conn, lexicon.postings(m, conn))[0].select("idx", "parent", "quotes")


@_query("SELECT count(*) AS n_messages, count(*) FILTER (parent IS NULL) AS n_toplevel FROM conv")
def archive_info(spark: S, d: str) -> DataFrame:
    """An archive built from raw messages, opened again, and asked for its size."""
    path = f"{work.shared_dir(spark)}/archive-{uuid.uuid4().hex}"
    archive.build(_raw(spark, d).select("idx", F.encode("raw", "UTF-8").alias("content")), path, group="talk")
    return archive.Archive.open(spark, path).info()


@_query(f"SELECT doc_id AS idx, array_to_string(list_filter(list_transform(regexp_extract_all(lower(text), '{text.UNICODE_WORD.replace("'", "''")}'), lambda w: rtrim(w, '_')), lambda w: length(w) BETWEEN 3 AND 13), ' ') AS words FROM documents")
def tokens_unicode(spark: S, d: str) -> DataFrame:
    return tables.documents(spark, d).select("idx", F.array_join(text.tokens(F.col("body"), unicode=True), " ").alias("words"))


@_query("SELECT count(*) FILTER (idx % 3 = 1) AS n_bad, count(*) FILTER (idx % 3 = 2) AS n_recovered, CAST(0 AS BIGINT) AS n_time_travel, count(*) FILTER (parent IS NULL AND idx % 1000 > 0) AS n_broken_refs FROM conv")
def date_stats(spark: S, d: str) -> DataFrame:
    raw = _raw(spark, d).withColumn("raw", F.when(F.col("idx") % 3 == 0, F.col("raw")).when(F.col("idx") % 3 == 1, F.regexp_replace("raw", "(?m)^Date: .*$", "Date: junk")).otherwise(F.regexp_replace("raw", "(?m)^Date: .*$", "Date: junk\nNNTP-Posting-Date: 3 Jan 1999 00:00 GMT")))
    m = headers.messages(raw)
    return charts.date_stats(m.join(threads.parents(m), "idx"))


@_query("SELECT source AS name, count(*) AS n FROM documents WHERE contains(source, 'c1') GROUP BY source")
def archive_names(spark: S, d: str) -> DataFrame:
    """Archives that have no name of their own take the tail of their path; those with a part of it are counted."""
    paths = tables.documents(spark, d).select(F.concat(F.lit("/data/"), "archive").alias("path"), F.lit(None).cast("string").alias("name"))
    return setops.named_like(galaxy.archive_names(paths), "c1").groupBy("name").agg(F.count("*").alias("n"))


@_query("SELECT idx % 2 AS archive_id, 'a' || idx % 2 AS name, TRUE AS available, idx % 2 = 0 AS \"current\", depth, (SELECT count(*) FROM ev k WHERE k.parent = r.idx) AS n_children, total - 1 AS descendants FROM rooted r JOIN sized USING (idx) WHERE idx = 1")
def warp_list(spark: S, d: str) -> DataFrame:
    e = tables.event_links(spark, d)
    kids = threads.children(e).select("idx", F.size("children").cast("long").alias("n_children"))
    m = threads.roots(e).join(kids, "idx", "left").select(F.col("idx").cast("string").alias("msgid"), (F.col("idx") % 2).alias("archive"), "depth", F.coalesce("n_children", F.lit(0).cast("long")).alias("n_children"), F.col("total").alias("child_total"))
    archives = m.select(F.col("archive").alias("archive_id")).distinct().select("archive_id", F.concat(F.lit("a"), F.col("archive_id").cast("string")).alias("name"), F.lit(True).alias("available"))
    return galaxy.warp_list(m, archives, "1", 0)


@_query("SELECT min(idx) AS idx FROM conv WHERE author <> 'user' AND idx > 5000")
def next_unread(spark: S, d: str) -> DataFrame:
    m = tables.conversations(spark, d)
    return setops.next_unread(m, m.where("author = 'user'"), 5000)


@_query("SELECT idx, md5('7:' || idx) AS key FROM conv")
def training_order(spark: S, d: str) -> DataFrame:
    m = tables.conversations(spark, d)
    return setops.shuffled(m.select("idx"), 7).select("idx", setops.by_hash(7)[0].alias("key"))


@_query("SELECT word, r[1] AS type, r[2] AS pos, idx FROM (SELECT word, idx, [type, pos] AS r FROM (SELECT top.*, row_number() OVER (PARTITION BY word ORDER BY idx) AS n FROM top JOIN df USING (word) WHERE top.r = 1) WHERE n = 1)")
def first_hits(spark: S, d: str) -> DataFrame:
    return lexicon.first_hits(_index(spark, d)).select("word", "idx", F.col("hit.type").cast("long").alias("type"), F.col("hit.pos").cast("long").alias("pos"))


@_query("SELECT word, idx + 7 AS idx, CAST(0 AS BIGINT) AS child_bucket, hitnum FROM post")
def resorted_index(spark: S, d: str) -> DataFrame:
    """The index after renumbering, of an archive whose threads fell apart."""
    index = _index(spark, d)
    order = index.select("idx").distinct().select("idx", (F.col("idx") + 7).alias("new_idx"))
    conn = order.select(F.col("new_idx").alias("idx"), F.lit(1).cast("long").alias("child_total"))
    return lexicon.resorted(index, conn, order).select("word", "idx", F.col("child_bucket").cast("long").alias("child_bucket"), F.col("hitnum").cast("long").alias("hitnum"))
