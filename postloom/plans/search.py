"""Ranked search: terms are parsed on the driver, everything else is one plan over the index.

The plan: the query's words, a local table of known size, join the index by word; one
shuffle on the message number brings a message's words together; rank arithmetic is
expressions.
"""

from __future__ import annotations

from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.lexicon import hit_rank
from ..schema import FAR, FUZZY_WEIGHTS, HIT_MASKS, HIT_TYPES, RESULT_HITS
from ..work import kept


@dataclass(frozen=True)
class Flags:
    require_all: bool = False
    adjacent: bool = False
    simple: bool = False
    set_logic: bool = False
    fuzzy: bool = False

    def settled(self, has_similar: bool) -> Flags:
        """Flags as they take effect: fuzzy needs similar words and excludes require-all, which excludes set logic."""
        fuzzy = self.fuzzy and has_similar
        all_ = self.require_all and not fuzzy
        return replace(self, fuzzy=fuzzy, require_all=all_, set_logic=self.set_logic and not all_)


@dataclass(frozen=True)
class Term:
    word: str
    must: bool = False
    cant: bool = False
    field: str | None = None
    strict: bool = False
    prefix: bool = False


def split_query(query: str) -> list[str]:
    return [t for t in query.split(" ") if t]


def parse(query: str, flags: Flags, lowercase: bool = True) -> list[Term]:
    """Terms of a query: ``+must -cannot from:field subject:field "strict" prefix*``, where set logic is on."""
    out = []
    for text in split_query(query.lower() if lowercase else query):
        term = Term(text)
        if flags.set_logic:
            if len(text) > 1 and text[0] in "+-":
                term = Term(text[1:], must=text[0] == "+", cant=text[0] == "-", strict=True)
            elif len(text) > 5 and text.startswith("from:"):
                term = Term(text[5:], field="from")
            elif len(text) > 8 and text.startswith("subject:"):
                term = Term(text[8:], field="subject")
            w = term.word
            if len(w) > 2 and w[0] == w[-1] == '"':
                term = replace(term, word=w[1:-1], strict=True)
            elif w.endswith("*") and len(w) > 1 and not (term.must or term.cant):
                term = replace(term, word=w[:-1], prefix=True)
        out.append(term)
    return out


@dataclass(frozen=True)
class QueryWords:
    """``rows(word, grp, must, cant, field, mod)`` of the index words that a query's terms stand for, their groups, and the terms without one.

    ``scan`` tells them in the index where it can, and ``counts`` has how many there are, must and cannot be there.
    """

    rows: DataFrame
    groups: int
    missing: int
    scan: Column | None
    counts: tuple[int, int, int]


def query_words(index: DataFrame, terms: list[Term], flags: Flags, similar: DataFrame | None) -> QueryWords:
    """The words that ``terms`` stand for in ``index``.

    A term makes a group if it brings a word that no earlier term has. The literal words come to the driver, and of all
    terms how many words they bring; the words of a prefix, however many, stay in the plan.
    """
    spark = index.sparkSession
    schema = "word string, grp int, must boolean, cant boolean, field string, mod double, strict boolean"
    wanted = reduce(lambda c, t: c | (F.col("word").startswith(t.word) if t.prefix else F.col("word") == t.word), terms, F.lit(False))
    known = index.where(wanted).select("word").distinct()
    open_ = any(t.prefix for t in terms)
    if open_:
        # Each word goes to the first term that names it.
        named = lambda t: F.col("word").startswith(t.word) if t.prefix else F.col("word") == t.word
        of = F.coalesce(*(F.when(named(t), F.lit(i)) for i, t in enumerate(terms)))
        known = kept(known.select("word", of.alias("term")), "query-words")
        brought = {r["term"]: r["n"] for r in known.groupBy("term").agg(F.count("*").alias("n")).collect()}
    else:
        there = {r["word"] for r in known.collect()} if terms else set()
        brought = {i: 1 for i, t in enumerate(terms) if t.word in there and t.word not in {x.word for x in terms[:i]}}
    rows = [(i, t.word, g, t.must, t.cant, t.field, 1.0, t.strict) for g, (i, t) in enumerate((i, terms[i]) for i in sorted(brought))]
    groups, counts = len(rows), (sum(brought.values()), sum(brought[r[0]] for r in rows if r[3]), sum(brought[r[0]] for r in rows if r[4]))
    if open_:
        asked = spark.createDataFrame([(r[0], *r[2:]) for r in rows], schema.replace("word string", "term int"))
        words = known.join(F.broadcast(asked), "term").drop("term")
    else:
        words = spark.createDataFrame([r[1:] for r in rows], schema)
    if not (flags.fuzzy and similar is not None and rows):
        return QueryWords(words.drop("strict"), groups, len(terms) - groups, wanted if open_ else F.col("word").isin([r[1] for r in rows]), counts)
    weight = F.element_at(F.array(*(F.lit(w) for w in FUZZY_WEIGHTS)), F.col("dist"))
    near = similar.join(words.where("not strict"), "word").select(F.col("similar").alias("word"), "grp", "must", "cant", "field", weight.alias("mod"), "strict")
    near = near.join(words.select("word"), "word", "left_anti").groupBy("word").agg(F.min(F.struct("grp", "must", "cant", "field", "mod", "strict")).alias("x")).select("word", "x.*")
    words = kept(words.unionByName(near), "query-words")
    n = words.agg(F.count("*").alias("n"), F.count_if("must").alias("must"), F.count_if("cant").alias("cant")).first()
    return QueryWords(words.drop("strict"), groups, len(terms) - groups, None, (n["n"], n["must"], n["cant"]))


def _word_score(simple: bool) -> Column:
    best = F.aggregate("hits", F.lit(0.0), lambda s, h: F.greatest(s, hit_rank(h["type"], h["pos"])))
    return best if simple else best * (1 + 2 * F.col("hitnum") / 255)


def _thread_rank() -> Column:
    return 0.25 + 0.75 * F.col("child_bucket") / 31


def _distance(a: Column, b: Column) -> Column:
    """Least distance of two groups' places in one field; saturated places don't count."""

    def open_(h: Column) -> Column:
        mask = F.element_at(F.array(*(F.lit(m) for m in HIT_MASKS)), h["type"] + 1)
        return h["pos"] < mask

    def nearest(best: Column, x: Column) -> Column:
        return F.aggregate(F.filter(b, lambda y: (y["type"] == x["type"]) & open_(y)), best, lambda s, y: F.least(s, F.greatest(F.abs(x["pos"] - y["pos"]), F.lit(1))))

    return F.aggregate(F.filter(a, open_), F.lit(FAR), nearest)


def search(index: DataFrame, query: str, flags: Flags | None = None, similar: DataFrame | None = None, only: str | None = None, lowercase: bool = True) -> DataFrame:
    """``(idx, rank, hits)``: messages in no order, best hits of each (four at most).

    ``only`` restricts all terms to hits of one field. Ties in rank are for the caller to break by ``idx``.
    """
    flags = (flags or Flags()).settled(similar is not None)
    terms = parse(query, flags, lowercase)
    asked = query_words(index, terms, flags, similar)
    words, groups, missing = asked.rows, asked.groups, asked.missing
    field = F.lit(only) if only else F.col("field")
    kind = F.element_at(F.create_map(*(F.lit(x) for i, t in enumerate(HIT_TYPES) for x in (t, i))), field)
    # Words and prefixes reach the scan: of a stored index, which is sorted by word, only their row groups are read.
    rows = (index if asked.scan is None else index.where(asked.scan)).join(words, "word")
    rows = rows.where(field.isNull() | F.exists("hits", lambda h: h["type"] == kind))
    rows = rows.withColumn("score", _word_score(flags.simple))
    whole, n_must, n_cant = asked.counts
    if not whole:
        return rows.select("idx", F.col("score").alias("rank"), F.array().cast("array<struct<type:int,pos:int,word:string>>").alias("hits")).where(F.lit(False))
    # A term that has no word leaves nothing where all are required.
    if flags.require_all and missing:
        rows = rows.where(F.lit(False))

    if whole == 1 and not flags.set_logic:
        rank = F.col("score") if flags.simple else F.col("score") * _thread_rank()
        return rows.select("idx", rank.alias("rank"), _top(F.transform("hits", lambda h: F.struct(h["type"].alias("type"), h["pos"].alias("pos"), F.col("word").alias("word")))).alias("hits"))

    entry = F.struct("grp", "word", "score", "mod", "must", "cant", "hits")
    found = rows.groupBy("idx").agg(F.array_sort(F.collect_list(entry)).alias("w"), F.min("child_bucket").alias("child_bucket"))
    if flags.require_all:
        found = found.where(F.size("w") == whole)
    elif flags.set_logic:
        found = found.where(~F.exists("w", lambda x: x["cant"]))
        if n_must:
            found = found.where(F.size(F.filter("w", lambda x: x["must"])) == n_must)
        elif n_cant == whole:
            found = found.where(F.lit(False))
    mod = (lambda x: F.lit(1.0)) if flags.require_all else (lambda x: x["mod"])
    rank = F.aggregate("w", F.lit(0.0), lambda s, x: s + x["score"] * mod(x))
    if flags.adjacent and groups > 1:
        by_group = [F.flatten(F.transform(F.filter("w", _in_group(g)), lambda x: x["hits"])) for g in range(groups)]
        found = found.select("*", *(h.alias(f"_g{g}") for g, h in enumerate(by_group)))
        # Groups in order: an absent one counts as far, a present one by its distance from the present one before.
        far = F.lit(FAR * missing)
        last_hits = F.col("_g0").cast("array<struct<type:int,pos:int>>")
        far = far + F.when(F.size("_g0") == 0, FAR).otherwise(0)
        for g in range(1, groups):
            now = F.col(f"_g{g}")
            far = far + F.when(F.size(now) == 0, FAR).when(F.size(last_hits) == 0, 0).otherwise(_distance(last_hits, now))
            last_hits = F.when(F.size(now) == 0, last_hits).otherwise(now)
        rank = rank / far
    if not flags.simple:
        rank = rank * _thread_rank()
    hits = F.flatten(F.transform("w", lambda x: F.transform(x["hits"], lambda h: F.struct(h["type"].alias("type"), h["pos"].alias("pos"), x["word"].alias("word")))))
    if flags.require_all:
        hits = F.array().cast("array<struct<type:int,pos:int,word:string>>")
        return found.select("idx", rank.alias("rank"), hits.alias("hits"))
    return found.select("idx", rank.alias("rank"), _top(hits).alias("hits"))


def _in_group(g: int):
    return lambda x: x["grp"] == g


def _top(hits: Column) -> Column:
    """The best hits by rank; equal places count once, unless they are saturated."""
    ranked = F.transform(hits, lambda h: F.struct((-hit_rank(h["type"], h["pos"])).alias("r"), h["type"].alias("type"), h["pos"].alias("pos"), h["word"].alias("word")))
    best = F.slice(F.array_sort(F.array_distinct(ranked)), 1, RESULT_HITS)
    return F.transform(best, lambda h: F.struct(h["type"].alias("type"), h["pos"].alias("pos"), h["word"].alias("word")))


def ordered(results: DataFrame, messages: DataFrame | None = None, by: str = "rank") -> DataFrame:
    """Results by rank, or by date (``oldest``, ``newest``)."""
    if by == "rank":
        return results.orderBy(F.desc("rank"), "idx")
    dated = results.join(messages.select("idx", "epoch"), "idx")
    return dated.orderBy(F.asc("epoch") if by == "oldest" else F.desc("epoch"), "idx")


def relative(results: DataFrame) -> DataFrame:
    """Ranks as shares of the best one."""
    best = results.agg(F.max("rank").alias("best"))
    return results.crossJoin(F.broadcast(best)).withColumn("share", F.col("rank") / F.col("best")).drop("best")
