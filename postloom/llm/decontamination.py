"""Benchmark decontamination as a prefix-filtered set join, in DataFrame operations only.

Item windows (``WINDOW`` words, or a shorter item as a whole) are sets that a
document must contain completely, so one token of each is a necessary prefix. All
words of the benchmark are counted in all documents; a window's tokens are ordered
by rarity and the rarest one is its prefix. A window with a word that no document
has is left out. Document places whose word is a prefix are candidates; they are
joined to the windows on that word, bounded by position (the window must begin and
end inside the document) and verified word by word.

Words that are no prefix are kept from being exploded by a Bloom filter, a constant of
the plan whose size follows the benchmark's words; what it lets through by mistake
falls away in the join.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import read, workspace, written

WINDOW = 13
#: Bits a word, and longs at most (8 MB), of the filter that keeps other words from being exploded.
BITS, MOST = 16, 1 << 20
#: A document is contaminated if at least one word in ``SHARE`` is hit.
SHARE = 20
#: What separates words before case is folded: all ASCII but letters and digits.
_BREAK = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def _words(text: Column) -> Column:
    return F.array_remove(F.split(F.coalesce(text.cast("string"), F.lit("")), _BREAK), "")


def _fold(word: Column) -> Column:
    """Lower-cases A-Z only."""
    return F.translate(word, string.ascii_uppercase, string.ascii_lowercase)


def item_windows(benchmark: DataFrame) -> DataFrame:
    """``(window, m, items)``: the distinct windows of all items, with the items that have them."""
    items = benchmark.select("item_id", F.transform(_words(F.col("text")), _fold).alias("w")).where("size(w) > 0")
    at = F.sequence(F.lit(1), F.greatest(F.size("w") - WINDOW + 1, F.lit(1)))
    rows = items.select("item_id", F.explode(F.transform(at, lambda i: F.slice("w", i, WINDOW))).alias("window"))
    return rows.groupBy("window").agg(F.collect_set("item_id").alias("items")).withColumn("m", F.size("window"))


def _hash(word: Column) -> Column:
    return F.xxhash64(F.lower(word))


def _two_bits(h: Column) -> Column:
    """Two bits of a long, from the high part of a hash."""
    bit = lambda at: F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned(h, at).bitwiseAND(F.lit(63)).cast("int"))
    return bit(52).bitwiseOR(bit(58))


class Filter:
    """A Bloom filter of words, lower-cased, as a constant of the plan; it never misses a word of the table ``words(word)``.

    It has about ``BITS`` bits a word and at most ``MOST`` longs: beyond that it lets more other words through.
    """

    def __init__(self, words: DataFrame):
        size = 1
        count = words.count()
        while size * 64 < count * BITS and size < MOST:
            size *= 2
        self.size = size
        h = _hash(F.col("word"))
        rows = words.groupBy(self._slot(h).alias("slot")).agg(F.bit_or(_two_bits(h)).alias("bits")).collect()
        longs = [0] * size
        for r in rows:
            longs[r["slot"]] = r["bits"]
        # A cast of one constant: the optimizer turns it into an array once.
        self.longs = F.split(F.lit(",".join(map(str, longs))), ",").cast("array<bigint>")

    def _slot(self, h: Column) -> Column:
        return h.bitwiseAND(F.lit(self.size - 1)).cast("int")

    def may_hold(self, h: Column) -> Column:
        """Whether the word of the hash ``h`` may be in the table."""
        return F.bitwise_not(F.element_at(self.longs, self._slot(h) + 1)).bitwiseAND(_two_bits(h)) == 0

    def places(self, words: Column) -> Column:
        """Where in an array words stand that may be in the table, from zero; each word is hashed once."""
        return F.array_compact(F.transform(F.transform(words, _hash), lambda h, i: F.when(self.may_hold(h), i)))


def rarity(docs: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """``(word, n)``: how often each word of ``vocabulary`` occurs in all documents, if at all.

    Words are compared fully lower-cased, which may count one too often but never misses it.
    """
    known = Filter(vocabulary)
    rows = docs.select(_words(F.col("text")).alias("w"))
    words = F.transform(known.places(F.col("w")), lambda i: F.element_at("w", i + 1))
    counts = rows.select(F.explode(words).alias("word")).groupBy(F.lower("word").alias("word")).agg(F.count("*").alias("n"))
    return counts.join(vocabulary, "word", "left_semi")


def prefixes(windows: DataFrame, counts: DataFrame) -> DataFrame:
    """``windows`` that can occur, each with its rarest word ``word``, fully lower-cased, and that word's place ``at``."""
    tokens = windows.select("window", F.posexplode("window").alias("at", "token")).withColumn("word", F.lower("token"))
    ranked = tokens.join(counts, "word", "left").groupBy("window").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "word", "at")).alias("p"))
    return ranked.where("p.n > 0").select("window", "p.word", "p.at").join(windows, "window")


def overlaps(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``(doc_id, n_words, n_hit, n_items, items)``, a row for each row of ``docs``.

    A null text has no words. Rows are told apart by ``doc_id`` and a hash of the text; equal
    rows are joined once and repeated at the end. Items without an id count as hits but aren't
    listed; an empty benchmark hits nothing.
    """
    spark = docs.sparkSession
    base = workspace(spark, "decontamination")
    windows = written(item_windows(benchmark), f"{base}/windows")
    vocabulary = windows.select(F.explode("window").alias("w")).select(F.lower("w").alias("word")).distinct()
    joined = written(prefixes(windows, rarity(docs, vocabulary)), f"{base}/prefixes")
    prefix = Filter(joined.select("word").distinct())
    rows = docs.select("doc_id", F.xxhash64("text").alias("tk"), _words(F.col("text")).alias("w"))
    rows = rows.select("doc_id", "tk", "w", F.size("w").alias("n_words"), prefix.places(F.col("w")).alias("places"))

    def candidate(p: Column) -> Column:
        left = F.least(p, F.lit(WINDOW - 1))
        near = F.transform(F.slice("w", p - left + 1, left + WINDOW), _fold)
        return F.struct(F.lower(F.element_at("w", p + 1)).alias("word"), p.alias("p"), left.alias("left"), near.alias("near"))

    # The first entry stands for the row itself.
    itself = F.array(F.struct(F.lit(None).cast("string").alias("word"), F.lit(None).cast("int").alias("p"), F.lit(None).cast("int").alias("left"), F.lit(None).cast("array<string>").alias("near")))
    rows = rows.select("doc_id", "tk", "n_words", F.explode(F.concat(itself, F.transform("places", candidate))).alias("c"))
    rows = rows.select("doc_id", "tk", "n_words", "c.*")
    fits = (F.col("at") <= F.col("left")) & (F.col("p") - F.col("at") + F.col("m") <= F.col("n_words"))
    same = F.slice("near", F.greatest(F.col("left") - F.col("at") + 1, F.lit(1)), F.col("m")) == F.col("window")
    keys = joined.withColumnRenamed("word", "prefix")
    hit = rows.join(keys, (F.col("word") == F.col("prefix")) & fits & same, "left")
    hit = hit.select("doc_id", "tk", "n_words", F.col("p").isNull().cast("int").alias("itself"), F.when(F.col("m").isNotNull(), F.struct((F.col("p") - F.col("at")).alias("a"), (F.col("p") - F.col("at") + F.col("m")).alias("b"))).alias("place"), "items")
    got = hit.groupBy("doc_id", "tk", "n_words").agg(F.sum("itself").alias("copies"), F.collect_set("place").alias("found"), F.array_distinct(F.flatten(F.collect_set("items"))).alias("items"))
    none = F.struct(F.lit(0).alias("end"), F.lit(0).alias("total"))

    def add(s: Column, x: Column) -> Column:
        return F.struct(F.greatest(s["end"], x["b"]).alias("end"), (s["total"] + F.greatest(x["b"] - F.greatest(s["end"], x["a"]), F.lit(0))).alias("total"))

    n_hit = F.aggregate(F.array_sort("found"), none, add, lambda s: s["total"])
    got = got.withColumn("n_hit", n_hit).withColumn("items", F.array_compact("items"))
    got = got.select("doc_id", F.col("n_words").cast("long").alias("n_words"), F.col("n_hit").cast("long").alias("n_hit"), F.size("items").cast("long").alias("n_items"), "items", "tk", F.explode(F.sequence(F.lit(1).cast("long"), "copies")).alias("copy"))
    return got.drop("copy")


def contaminated() -> Column:
    return (F.col("n_hit") > 0) & (SHARE * F.col("n_hit") >= F.col("n_words"))


def keep_clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` without the rows that a whole window hits, columns unchanged.

    One window is enough, however long the text: the share of ``contaminated`` describes a document,
    but a model would learn the passage all the same. A null or empty text stays.
    """
    bad = overlaps(docs, benchmark).where("n_hit > 0").select(F.col("doc_id").alias("_bad_id"), F.col("tk").alias("_bad_text")).distinct()
    # As a table its size is known before the join is planned: while it is small, no text is shuffled.
    bad = written(bad, workspace(docs.sparkSession, "contaminated"))
    return docs.join(bad, docs["doc_id"].eqNullSafe(bad["_bad_id"]) & (F.xxhash64(docs["text"]) == bad["_bad_text"]), "left_anti")


def op8_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = overlaps(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    digest = F.sha2(F.concat_ws(",", F.array_sort(F.transform("items", lambda i: i.cast("string")))), 256)
    return got.select("doc_id", "n_words", "n_hit", "n_items", digest.alias("items_sha256"), contaminated().alias("contaminated"))


OP8_SQL = """
WITH d AS (SELECT doc_id, row_number() OVER () AS rid, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '') AS w FROM documents),
b AS (SELECT item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '') AS w FROM benchmark),
bw AS (SELECT item_id, len(w) AS m, unnest(list_transform(range(1, greatest(len(w) - 12, 1) + 1), lambda i: array_to_string(w[i:i+12], ' '))) AS k FROM b WHERE len(w) > 0),
ws AS (SELECT DISTINCT item_id, least(m, 13) AS m, k FROM bw),
sizes AS (SELECT DISTINCT m FROM ws),
placed AS (SELECT rid, m, unnest(range(1, len(w) - m + 2)) AS i FROM d, sizes WHERE len(w) >= m),
keyed AS (SELECT placed.rid, placed.m, placed.i, array_to_string(d.w[placed.i:placed.i + placed.m - 1], ' ') AS k FROM placed JOIN d USING (rid)),
hits AS (SELECT rid, keyed.m, i, item_id FROM keyed JOIN ws ON keyed.k = ws.k AND keyed.m = ws.m),
places AS (SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT rid, unnest(range(i, i + m)) AS p FROM hits) GROUP BY rid),
items AS (SELECT rid, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS s FROM hits GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN places USING (rid) LEFT JOIN items USING (rid)
"""
