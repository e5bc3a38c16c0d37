"""Quality rules: base counts and divergence from language references.

A document's histogram of character classes and its histogram of a language's
common words are compared with that language's references by Jensen-Shannon
distance (base 2, square root of the divergence). References are trained from a
bounded sample of each language's rows labelled good; a document passes if some
language is near enough in both, or if its own language has no reference. Short texts are far from any reference by chance alone, so each
limit is a constant plus a slack over the square root of the length, and a text
with fewer than ``MIN_CHARS`` word characters isn't judged by characters, one with
fewer than ``MIN_WORDS`` words not by words.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import blocks
from .shared import map_batches, read

#: Rows of a language's training sample at most, its common words, and parts in which the sample is drawn.
SAMPLE_ROWS, COMMON, PARTS = 4000, 48, 64
MIN_CHARS, MIN_WORDS = 100, 50
#: Limits of the distances: at any length, and what is added over the root of the length.
CHAR_LIMIT, CHAR_SLACK = 0.15, 1.25
WORD_LIMIT, WORD_SLACK = 0.33, 0.35
WINDOW, LEAST_WORDS = 8, 20

_SYMBOL = np.zeros(256, np.int64)
_SYMBOL[list(b"#*$%&|<>")] = 1
_NEWLINE = np.zeros(256, bool)
_NEWLINE[0x0A] = True
#: Character classes by a character's first byte; continuation bytes have none.
CLASSES = ("lower", "upper", "digit", "stop", "mark", "latin", "other")
_CLASS = np.full(256, 7, np.uint8)
for _i in range(128):
    _c = chr(_i)
    _CLASS[_i] = 0 if _c.islower() else 1 if _c.isupper() else 2 if _c.isdigit() else 3 if _c in ".,;:!?'\"()-" else 4
_CLASS[0x80:0xC0] = 7
_CLASS[0xC2:0xCA] = 5
_CLASS[0xCA:] = 6


@dataclass
class Counts:
    n_words: np.ndarray
    word_chars: np.ndarray
    n_symbols: np.ndarray
    n_dup_lines: np.ndarray
    n_repeat_words: np.ndarray
    classes: np.ndarray
    word_hash: np.ndarray
    row: np.ndarray


def _sums(values: np.ndarray, offs: np.ndarray) -> np.ndarray:
    total = np.r_[0, np.cumsum(values, dtype=np.int64)]
    return total[offs[1:]] - total[offs[:-1]]


def _repeated(kind: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order that brings equal kinds of one row together, and which of them, in that order, equal the one before."""
    order = np.lexsort((kind, row))
    kind, row = kind[order], row[order]
    return order, np.r_[False, (kind[1:] == kind[:-1]) & (row[1:] == row[:-1])]


def _windows(kind: np.ndarray) -> np.ndarray:
    """A number for each run of ``WINDOW`` entries, equal exactly for equal runs.

    Runs are numbered by a hash, and each is held against one of its number. Should two differ,
    pairs of entries are numbered instead, then pairs of pairs.
    """
    n = len(kind) - WINDOW + 1
    if n <= 0:
        return kind[:0]
    _, example, number = np.unique(blocks.grams(kind.astype(np.uint64), WINDOW), return_index=True, return_inverse=True)
    of = example[number]
    again = np.flatnonzero(of != np.arange(n))
    if all((kind[again + i] == kind[of[again] + i]).all() for i in range(WINDOW)):
        return number
    have, size = kind, 1
    while size < WINDOW:
        _, have = np.unique(have[:-size] * (len(kind) + 1) + have[size:], return_inverse=True)
        size *= 2
    return have


def measure(data: np.ndarray, offs: np.ndarray) -> Counts:
    rows = len(offs) - 1
    starts, ends, before = blocks.spans(data, offs)
    n_words = np.diff(before)
    row = np.repeat(np.arange(rows), n_words)
    ink = ~blocks.SPACE[data]
    first = (data & 0xC0) != 0x80
    word_chars = _sums(ink & first, offs)
    kind = _CLASS[data]
    classes = np.stack([_sums((kind == k) & ink, offs) for k in range(len(CLASSES))], axis=1)

    lo, hi, line_before = blocks.spans(data, offs, _NEWLINE)
    inked = np.r_[0, np.cumsum(ink)]
    full = inked[hi] > inked[lo]
    line_row = np.repeat(np.arange(rows), np.diff(line_before))[full]
    order, same = _repeated(blocks.numbered(data, lo[full], hi[full])[0], line_row)
    n_dup_lines = np.bincount(line_row[order[same]], minlength=rows)

    h = blocks.span_hash(data, starts, ends)
    g = _windows(blocks.numbered(data, starts, ends)[0])
    inside = np.flatnonzero(row[: len(g)] == row[WINDOW - 1 :]) if len(g) else np.zeros(0, np.int64)
    order, same = _repeated(g[inside], row[inside])
    twice = order[same | np.r_[same[1:], False]] if len(order) else order
    again = blocks.covered(len(h), inside[twice], inside[twice] + WINDOW)
    n_repeat_words = np.bincount(row[again], minlength=rows)
    return Counts(n_words, word_chars, _sums(_SYMBOL[data], offs), n_dup_lines, n_repeat_words, classes, h, row)


def word_hash(word: str) -> int:
    raw = np.frombuffer(word.encode(), np.uint8)
    return int(blocks.span_hash(raw, np.array([0]), np.array([len(raw)]))[0])


@dataclass
class Reference:
    """What a language's texts look like: shares of the classes, and of its common words with the rest last."""

    lang: str
    classes: np.ndarray
    words: np.ndarray
    shares: np.ndarray


def _entropy(p: np.ndarray) -> np.ndarray:
    return -np.sum(np.where(p > 0, p * np.log2(np.where(p > 0, p, 1)), 0), axis=-1)


def distance(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Jensen-Shannon distance of each row of ``p`` from ``q``."""
    m = (p + q) / 2
    return np.sqrt(np.maximum(_entropy(m) - (_entropy(p) + _entropy(q)) / 2, 0))


def distances(c: Counts, refs: list[Reference]) -> tuple[np.ndarray, np.ndarray]:
    """Per row and reference, the distance in character classes and in common words."""
    rows = len(c.n_words)
    p = c.classes / np.maximum(c.classes.sum(1, keepdims=True), 1)
    by_class, by_word = [], []
    for r in refs:
        by_class.append(distance(p, r.classes))
        at = np.searchsorted(r.words, c.word_hash)
        at[at == len(r.words)] = 0
        hit = np.where(r.words[at] == c.word_hash, at, len(r.words)) if len(r.words) else np.zeros(len(c.word_hash), np.int64)
        wide = len(r.words) + 1
        words = np.bincount(c.row * wide + hit, minlength=rows * wide).reshape(rows, wide)
        by_word.append(distance(words / np.maximum(words.sum(1, keepdims=True), 1), r.shares))
    return np.stack(by_class, 1), np.stack(by_word, 1)


def verdict(c: Counts, refs: list[Reference], lang: list[str | None]) -> np.ndarray:
    """Whether each row is near enough to some reference; a row whose language has none isn't judged."""
    if not refs:
        return np.ones(len(c.n_words), bool)
    chars, words = distances(c, refs)
    chars_near = chars <= (CHAR_LIMIT + CHAR_SLACK / np.sqrt(np.maximum(c.word_chars, 1)))[:, None]
    words_near = words <= (WORD_LIMIT + WORD_SLACK / np.sqrt(np.maximum(c.n_words, 1)))[:, None]
    chars_near[c.word_chars < MIN_CHARS] = True
    words_near[c.n_words < MIN_WORDS] = True
    known = {r.lang for r in refs}
    return (chars_near & words_near).any(1) | np.array([x not in known for x in lang], bool)


def references(docs: DataFrame, labels: DataFrame) -> list[Reference]:
    """Trains the references from documents labelled of good quality and not toxic, at most ``SAMPLE_ROWS`` of each language.

    The sample is of the least hashes of ``doc_id``, so it doesn't depend on the order of rows.
    Without labels, or without a language, there is no reference and nothing is rejected by distance.
    """
    good = labels.where("quality = 1 and coalesce(toxic, 0) = 0 and doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id")).distinct()
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), F.col("lang").cast("string")).where("lang is not null and text is not null")
    named = rows.join(good, "doc_id").groupBy("doc_id").agg(F.min("lang").alias("lang")).withColumn("h", F.xxhash64("doc_id"))
    # The least hashes of each part hold those of the language, and no task sees all its rows.
    for by in (f"lang, pmod(h, {PARTS})", "lang"):
        named = named.withColumn("rank", F.expr(f"row_number() over (partition by {by} order by h, doc_id)")).where(F.col("rank") <= SAMPLE_ROWS).drop("rank")
    # One row of each chosen id, the least of those that repeat it.
    sample = rows.join(F.broadcast(named.select("doc_id", "lang")), ["doc_id", "lang"]).groupBy("doc_id", "lang").agg(F.min("text").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offs = blocks.texts(batch.column(0))
            for lo, hi in blocks.slices(offs):
                c = measure(raw[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo])
                lang = batch.column(1).slice(lo, hi - lo).to_pylist()
                for name in sorted(set(lang)):
                    mine = np.array([x == name for x in lang])
                    h, n = np.unique(c.word_hash[mine[c.row]], return_counts=True)
                    key = np.r_[h.view(np.int64), np.arange(len(CLASSES))]
                    yield pa.RecordBatch.from_arrays([pa.array([name] * len(key)), pa.array(np.r_[np.zeros(len(h), bool), np.ones(len(CLASSES), bool)]), pa.array(key), pa.array(np.r_[n, c.classes[mine].sum(0)])], ["lang", "class", "key", "n"])

    counts = map_batches(sample.select("text", "lang"), run, "lang string, class boolean, key long, n long").groupBy("lang", "class", "key").agg(F.sum("n").alias("n"))
    total = counts.groupBy("lang", "class").agg(F.sum("n").alias("total"))
    top = counts
    # The commonest words of each part of the vocabulary hold those of the language, and no task sees all its words.
    for by in (f"lang, class, pmod(xxhash64(key), {PARTS})", "lang, class"):
        top = top.withColumn("rank", F.expr(f"row_number() over (partition by {by} order by n desc, key)")).where(F.col("class") | (F.col("rank") <= COMMON)).drop("rank")
    rows = top.join(total, ["lang", "class"]).collect()
    refs = []
    for lang in sorted({r["lang"] for r in rows}):
        classes = np.zeros(len(CLASSES))
        words = sorted((r["key"] & ((1 << 64) - 1), r["n"] / r["total"]) for r in rows if r["lang"] == lang and not r["class"])
        for r in rows:
            if r["lang"] == lang and r["class"]:
                classes[r["key"]] = r["n"] / max(r["total"], 1)
        shares = np.array([s for _, s in words])
        refs.append(Reference(lang, classes, np.array([w for w, _ in words], np.uint64), np.r_[shares, 1 - shares.sum()]))
    return [r for r in refs if r.classes.sum() and len(r.words)]


_SCHEMA = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean"


def assess(docs: DataFrame, refs: list[Reference]) -> DataFrame:
    """Counts and verdict of every row of ``docs``.

    A null or empty text has no words and fails the base rule, as does any of under 20 words.
    Repeated rows repeat; columns other than ``doc_id``, ``text`` and ``lang`` are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offs = blocks.texts(batch.column(1))
            for lo, hi in blocks.slices(offs):
                c = measure(raw[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo])
                failed = (c.n_words < LEAST_WORDS) | (100 * c.n_repeat_words > 30 * c.n_words)
                cols = [batch.column(0).slice(lo, hi - lo), *(pa.array(x.astype(np.int64)) for x in (c.n_words, c.word_chars, c.n_symbols, c.n_dup_lines, c.n_repeat_words)), pa.array(failed), pa.array(~failed & verdict(c, refs, batch.column(2).slice(lo, hi - lo).to_pylist()))]
                yield pa.RecordBatch.from_arrays(cols, [x.split()[0] for x in _SCHEMA.split(", ")])

    return map_batches(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), F.col("lang").cast("string")), run, _SCHEMA)


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return assess(docs, references(docs, read(spark, sf_dir, "labels")))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` without the rows that the base rules or the distances reject, columns unchanged.

    Rows are judged by their texts, so rows that repeat a ``doc_id`` are judged apart.
    """
    refs, names = references(docs, labels), docs.columns
    text, lang = names.index("text"), names.index("lang")
    kinds = docs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offs = blocks.texts(batch.column(text))
            for lo, hi in blocks.slices(offs):
                c = measure(raw[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo])
                failed = (c.n_words < LEAST_WORDS) | (100 * c.n_repeat_words > 30 * c.n_words)
                yield batch.slice(lo, hi - lo).filter(pa.array(~failed & verdict(c, refs, batch.column(lang).slice(lo, hi - lo).to_pylist())))

    return map_batches(docs, run, kinds)
