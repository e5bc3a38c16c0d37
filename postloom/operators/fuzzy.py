"""Similar words by bounded edit distance, with the most frequent partners first.

Only partners at least a fifth as frequent as a word's most frequent one count. So
each word walks down the vocabulary by frequency and stops where that share of the
first partner found ends; most of the vocabulary is never looked at. On the way,
signatures of letter counts tell what can be near at all, and a banded distance
over arrays decides. No pair, variant or segment is ever shuffled: each task takes
words of its own and reads the vocabulary past them as packed blocks, in Arrow
batches, and the driver never has it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..work import kept, partitions

#: Shares of a word's own frequency and of its most frequent partner's, below which a partner is left out.
OWN_SHARE, BEST_SHARE = 10, 5
#: Words that walk together, words of a packed block, blocks of the longest step, and pairs measured at once.
_TOGETHER, _BLOCK, _STEP_MOST, _PAIRS = 128, 512, 4, 1 << 16
_PAIRS_SCHEMA = "word string, similar string, dist int"
#: What a task gets: its own words, ``own`` and of frequency ``df``, and the blocks in falling order of frequency.
_DEALT_SCHEMA = "part int, own boolean, df long, word string, words array<string>, dfs array<long>"


def most_edits(length: int) -> int:
    return 1 if length <= 5 else 2 if length <= 10 else 3


def _letters(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of words, a column each and zero beyond their ends, and their lengths."""
    n = np.fromiter(map(len, words), np.int64, len(words))
    points = np.zeros((len(words), max(int(n.max(initial=0)), 1)), np.uint32)
    points[np.arange(points.shape[1]) < n[:, None]] = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)
    return np.ascontiguousarray(points.T), n


def _signatures(points: np.ndarray) -> np.ndarray:
    """Two bits for each of 32 classes of letters: whether a word has one of it, and whether it has two.

    An added or lost letter turns one bit at most and another letter in its place two, so ``k`` edits between words
    whose lengths differ by ``d`` turn ``2 k - d`` at most.
    """
    one, two = np.zeros((2, points.shape[1]), np.uint32)
    for row in points:
        bit = np.where(row > 0, np.left_shift(np.uint32(1), row & np.uint32(31)), 0).astype(np.uint32)
        two |= one & bit
        one |= bit
    return one.astype(np.uint64) << np.uint64(32) | two


def _distances(a: np.ndarray, b: np.ndarray, length: int, lengths: np.ndarray, most: int) -> np.ndarray:
    """Edit distances of pairs of columns, those of ``a`` of one ``length``; what is beyond ``most`` is ``most + 1``."""
    far = np.full(len(lengths), most + 1, np.int8)
    out = far.copy()
    row = {j: np.full(len(lengths), j, np.int8) for j in range(most + 1)}
    for i in range(1, length + 1):
        now: dict[int, np.ndarray] = {}
        for j in range(max(0, i - most), min(len(b), i + most) + 1):
            if not j:
                now[0] = np.full(len(lengths), i, np.int8)
                continue
            best = row.get(j - 1, far) + (a[i - 1] != b[j - 1])
            if j in row:
                np.minimum(best, row[j] + np.int8(1), out=best)
            if j - 1 in now:
                np.minimum(best, now[j - 1] + np.int8(1), out=best)
            now[j] = np.minimum(best, far)
        row = now
    for j, d in row.items():
        np.copyto(out, d, where=lengths == j)
    return out


class _Walkers:
    """Words that walk down a vocabulary, those of one length together."""

    def __init__(self, words: np.ndarray, df: np.ndarray):
        self.words = words
        self.limit, self.best = df // OWN_SHARE, np.full(len(words), -1)
        n = np.fromiter(map(len, words), np.int64, len(words))
        self.groups: list[list] = []
        for length in np.unique(n):
            at = np.flatnonzero(n == length)
            at = at[np.argsort(-df[at], kind="stable")]
            points, _ = _letters(list(words[at]))
            self.groups.append([int(length), at, points, _signatures(points)])

    def past(self, words: np.ndarray, df: np.ndarray) -> Iterator[pd.DataFrame]:
        """The pairs that count with the next ``words``, which are in falling order of frequency and no more frequent than any before."""
        points2, n2 = _letters(list(words))
        signatures = _signatures(points2)
        for group in self.groups:
            length, at, points, own = group
            # Words whose limit is passed stop for good.
            going = df[0] >= self.limit[at]
            if not going.all():
                group[1:] = at, points, own = at[going], np.ascontiguousarray(points[:, going]), own[going]
            most = most_edits(length)
            near = np.flatnonzero(np.abs(n2 - length) <= most)
            room, signature, around = (2 * most - np.abs(n2[near] - length)).astype(np.uint8), signatures[near], points2[:, near]
            pairs = []
            for k in range(0, len(at) if len(near) else 0, _TOGETHER):
                turned = np.bitwise_count(own[k : k + _TOGETHER, None] ^ signature[None, :])
                pairs.append(np.flatnonzero(turned <= room[None, :]) + k * len(near))
            pairs = np.concatenate(pairs) if pairs else np.empty(0, np.int64)
            for k in range(0, len(pairs), _PAIRS):
                x, y = np.divmod(pairs[k : k + _PAIRS], len(near))
                d = _distances(points[:, x], around[:, y], length, n2[near[y]], most)
                x, y = at[x], near[y]
                ok = (d > 0) & (d <= most) & (df[y] >= self.limit[x])
                x, y, d = x[ok], y[ok], d[ok]
                # A word's pairs come in falling order of frequency, so its limit is settled by the first of them.
                np.maximum.at(self.best, x, df[y])
                self.limit[x] = np.maximum(self.limit[x], self.best[x] // BEST_SHARE)
                ok = df[y] >= self.limit[x]
                if ok.any():
                    yield pd.DataFrame({"word": self.words[x[ok]], "similar": words[y[ok]], "dist": d[ok].astype(np.int32)})

    @property
    def done(self) -> bool:
        return not any(len(at) for _, at, _, _ in self.groups)


def _walked(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The pairs of each part: its own words come first, then all blocks."""
    part, own, walkers, ahead, step = None, [], None, [], 1
    for b in batches:
        for row in b.itertuples(index=False):
            if row.part != part:
                if ahead and walkers:
                    yield from _step(walkers, ahead)
                part, own, walkers, ahead, step = row.part, [], None, [], 1
            if row.own:
                own.append((row.word, row.df))
                continue
            if own:
                walkers, own = _Walkers(np.array([w for w, _ in own], object), np.array([n for _, n in own], np.int64)), []
            if walkers is None or walkers.done:
                continue
            ahead.append((row.words, row.dfs))
            if len(ahead) >= step:
                yield from _step(walkers, ahead)
                ahead, step = [], min(2 * step, _STEP_MOST)
    if ahead and walkers:
        yield from _step(walkers, ahead)


def _step(walkers: _Walkers, blocks: list[tuple]) -> Iterator[pd.DataFrame]:
    words, df = map(np.concatenate, zip(*blocks, strict=True))
    return walkers.past(words.astype(object), df.astype(np.int64))


def similar_words(vocabulary: DataFrame, only: list[str] | None = None) -> DataFrame:
    """``(word, similar, dist)`` of ``vocabulary(word, df)``, for all words or those in ``only``.

    Within the bound of the word's length, for partners that are not much rarer (a tenth of the word's
    own frequency, a fifth of its most frequent partner's).
    """
    spark = vocabulary.sparkSession
    parts = partitions(spark) if only is None else max(1, min(partitions(spark), len(only)))
    # One pass over the index serves the blocks and the words that are asked for.
    rows = kept(vocabulary.select("word", F.col("df").cast("long").alias("df")), "vocabulary")
    asked = rows if only is None else rows.where(F.col("word").isin(only))
    own = asked.select(F.pmod(F.xxhash64("word"), F.lit(parts)).cast("int").alias("part"), F.lit(True).alias("own"), "df", "word", F.lit(None).cast("array<string>").alias("words"), F.lit(None).cast("array<long>").alias("dfs"))

    def packed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Blocks of words in their order, one for each part, told apart by their first word."""
        for b in batches:
            words, df = b["word"].to_numpy(object), b["df"].to_numpy()
            for k in range(0, len(b), _BLOCK):
                block = {"own": False, "df": df[k], "word": words[k], "words": [words[k : k + _BLOCK]] * parts, "dfs": [df[k : k + _BLOCK]] * parts}
                yield pd.DataFrame({"part": np.arange(parts, dtype=np.int32), **block})

    blocks = rows.repartitionByRange(partitions(spark), F.desc("df"), "word").sortWithinPartitions(F.desc("df"), "word").mapInPandas(packed, _DEALT_SCHEMA)
    dealt = own.union(blocks).repartitionById(parts, F.col("part")).sortWithinPartitions("part", F.desc("own"), F.desc("df"), "word")
    return dealt.mapInPandas(_walked, _PAIRS_SCHEMA)


def average_similar(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("word").agg(F.count("*").alias("n")).agg(F.count("*").alias("n_words"), F.round(F.avg("n"), 6).alias("avg_similar"))
