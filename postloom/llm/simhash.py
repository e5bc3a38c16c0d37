"""SimHash near-duplicate groups by deletion-variant signatures.

Two fingerprints at most four bits apart, cut into three segments, agree in at
least one segment but for one bit. So each fingerprint is indexed under every
variant of a segment with one bit wiped (22 + 21 + 21 keys); fingerprints that
share a key are compared in full. Inside a key only a spanning forest of the
verified links is returned, so a dense group gives as many rows as it has
members. The members of a key larger than ``BUCKET`` are linked through common midpoints
instead, which needs no comparison of pairs at all.

Equal fingerprints are one node throughout. A null text has no words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.graph import components
from ..work import partitions
from . import blocks
from .shared import map_batches, read, workspace, written

SHINGLE, SEED, DISTANCE = 4, 42, 4
#: (shift, width) of the three segments, from the low bits up.
SEGMENTS = ((0, 22), (22, 21), (43, 21))
#: Members of one key that a task compares; larger keys go by midpoints.
BUCKET = 1 << 16
_SMALL = 24


def _counts(h: np.ndarray, heads: np.ndarray, n: int) -> np.ndarray:
    """Per row, in how many of its hashes each bit is set; rows start at ``heads`` in ``h``."""
    out = np.zeros((n, 64), np.int64)
    row = np.searchsorted(heads, np.arange(len(h)), side="right") - 1
    for lo in range(0, len(h), 1 << 16):
        part, of = h[lo : lo + (1 << 16)], row[lo : lo + (1 << 16)]
        bits = np.unpackbits(part.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        at = np.flatnonzero(np.r_[True, of[1:] != of[:-1]])
        out[of[at]] += np.add.reduceat(bits, at, axis=0, dtype=np.int64)
    return out


def fingerprints(raw: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Unsigned fingerprints of the rows at ``offs``."""
    digest, n = xxhash.xxh64_intdigest, len(offs) - 1
    hashes: list[int] = []
    heads = np.zeros(n, np.int64)
    sizes = np.zeros(n, np.int64)
    for i in range(n):
        words = raw[offs[i] : offs[i + 1]].tobytes().lower().split()
        heads[i] = len(hashes)
        if not words:
            continue
        text = b" ".join(words)
        ends = np.cumsum([len(w) + 1 for w in words]) - 1
        starts = np.r_[0, ends[:-1] + 1]
        k = min(SHINGLE, len(words))
        hashes += [digest(text[a:b], SEED) for a, b in zip(starts[: len(words) - k + 1].tolist(), ends[k - 1 :].tolist(), strict=True)]
        sizes[i] = len(words) - k + 1
    full = np.flatnonzero(sizes)
    counts = _counts(np.array(hashes, np.uint64), heads[full], len(full)) if len(full) else np.zeros((0, 64), np.int64)
    set_bits = np.packbits(2 * counts > sizes[full][:, None], axis=1, bitorder="little").view("<u8").reshape(-1)
    out = np.zeros(n, np.uint64)
    out[full] = set_bits
    return out


def _fingerprint_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        raw, offs = blocks.texts(batch.column(1))
        got = [fingerprints(raw, offs[lo : hi + 1]) for lo, hi in blocks.slices(offs)]
        fp = np.concatenate(got) if got else np.zeros(0, np.uint64)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp.view(np.int64))], ["doc_id", "fp"])


def fingerprint_table(docs: DataFrame) -> DataFrame:
    """``(doc_id, fp)``: the fingerprint as a signed long, for every row of ``docs``."""
    return map_batches(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), _fingerprint_batches, "doc_id long, fp long")


def _variants(segments: tuple[tuple[int, int], ...]) -> list:
    keys, j = [], 0
    for shift, width in segments:
        part = F.shiftrightunsigned("fp", shift).bitwiseAND(F.lit((1 << width) - 1))
        for bit in range(width):
            keys.append(part.bitwiseAND(F.lit(~(1 << bit))).bitwiseOR(F.lit(j << 32)))
            j += 1
    return keys


def _forest(fp: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Spanning forest of the links inside one key: each visited member claims the unvisited ones near it."""
    left, a, b = fp, [], []
    while len(left):
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            x = queue.pop()
            near = np.bitwise_count(left ^ x) <= DISTANCE
            if near.any():
                found = left[near]
                a.append(np.full(len(found), x))
                b.append(found)
                queue += list(found)
                left = left[~near]
    return a, b


def _links(key: np.ndarray, fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Verified links of whole keys; rows are ordered by key."""
    head = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    size = np.diff(np.r_[head, len(key)])
    a, b = [], []
    some = np.repeat((size > 1) & (size <= _SMALL), size)
    k, f = key[some], fp[some]
    for step in range(1, int(size[(size <= _SMALL)].max(initial=1))):
        hit = np.flatnonzero((k[step:] == k[:-step]) & (np.bitwise_count(f[step:] ^ f[:-step]) <= DISTANCE))
        a.append(f[hit])
        b.append(f[hit + step])
    for i in np.flatnonzero(size > _SMALL):
        x, y = _forest(fp[head[i] : head[i] + size[i]])
        a += x
        b += y
    none = np.zeros(0, np.uint64)
    return np.concatenate([none, *a]), np.concatenate([none, *b])


def _link_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows ``(key, fp)`` in key order; gives links ``(a, b, null)``, or ``(fp, null, key)`` for the members of too large a key."""

    def links(key, fp):
        a, b = _links(key, fp)
        u, v = np.minimum(a.view(np.int64), b.view(np.int64)), np.maximum(a.view(np.int64), b.view(np.int64))
        if len(u):
            u, v = np.unique(np.stack([u, v]), axis=1)
        return pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64()), pa.nulls(len(u), pa.int64())], ["a", "b", "key"])

    def large(key, fp):
        return pa.RecordBatch.from_arrays([pa.array(fp.view(np.int64)), pa.nulls(len(fp), pa.int64()), pa.array(key)], ["a", "b", "key"])

    key, fp, hot = np.zeros(0, np.int64), np.zeros(0, np.uint64), None
    for batch in batches:
        key = np.r_[key, batch.column(0).to_numpy(zero_copy_only=False)]
        fp = np.r_[fp, batch.column(1).to_numpy(zero_copy_only=False).view(np.uint64)]
        if hot is not None and len(key):
            n = int(np.searchsorted(key, hot, side="right"))
            if n:
                yield large(key[:n], fp[:n])
            hot, key, fp = (hot if n == len(key) else None), key[n:], fp[n:]
        cut = int(np.searchsorted(key, key[-1], side="left")) if len(key) else 0
        if cut:
            yield from _whole(key[:cut], fp[:cut], links, large)
            key, fp = key[cut:], fp[cut:]
        if len(key) > BUCKET:
            yield large(key, fp)
            hot, key, fp = key[-1], key[:0], fp[:0]
    if len(key):
        yield from _whole(key, fp, links, large)


def _whole(key, fp, links, large) -> Iterator[pa.RecordBatch]:
    head = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    size = np.diff(np.r_[head, len(key)])
    big = np.repeat(size > BUCKET, size)
    if big.any():
        yield large(key[big], fp[big])
        key, fp = key[~big], fp[~big]
    if len(key):
        yield links(key, fp)


def near_links(prints: DataFrame) -> DataFrame:
    """Links ``(u, v)`` that join all distinct fingerprints ``fp`` of ``prints`` at most four bits apart, as a written table.

    Two fingerprints are linked, directly or through others within the distance, exactly if a chain of such steps joins them.
    """
    spark, n = prints.sparkSession, partitions(prints.sparkSession)
    rows = prints.select(F.explode(F.array(*_variants(SEGMENTS))).alias("key"), "fp")
    out = rows.repartition(n, "key").sortWithinPartitions("key", "fp").mapInArrow(_link_batches, "a long, b long, key long")
    out = written(out, workspace(spark, "simhash-links"))
    links = out.where("b is not null").select(F.col("a").alias("u"), F.col("b").alias("v"))
    rest = out.where("b is null")
    return links.distinct() if rest.isEmpty() else links.union(_midpoint_links(rest.select(F.col("a").alias("fp")).distinct())).distinct()


def _midpoint_links(prints: DataFrame) -> DataFrame:
    """Links for the members of too large keys, in time and rows proportional to their number.

    Fingerprints at most four bits apart have a common point at most two bits from both: each is
    listed under all 2,081 points around it and linked to the least one listed there.
    """
    one = F.when(F.col("i") < 64, F.expr("shiftleft(1L, i)")).otherwise(F.lit(0).cast("long"))
    two = F.when(F.col("j") < 64, F.expr("shiftleft(1L, j)")).otherwise(F.lit(0).cast("long"))
    at = prints.select("fp", F.explode(F.sequence(F.lit(0), F.lit(64))).alias("i"))
    at = at.select("fp", "i", F.explode(F.sequence(F.least(F.col("i") + 1, F.lit(64)), F.lit(64))).alias("j"))
    at = at.select("fp", F.col("fp").bitwiseXOR(one).bitwiseXOR(two).alias("point"))
    least = at.groupBy("point").agg(F.min("fp").alias("low"))
    return at.join(least, "point").where("low <> fp").select(F.col("low").alias("u"), F.col("fp").alias("v")).distinct()


def groups(docs: DataFrame) -> DataFrame:
    """``(doc_id, fp, component_id)``: the near-duplicate group of every row, named by its least ``doc_id``.

    Null texts and texts without words have fingerprint zero and are linked like any other. A null ``doc_id``
    stays in its group but does not name it, unless the group has no other. Repeated rows give repeated rows.
    """
    spark = docs.sparkSession
    base = workspace(spark, "simhash")
    prints = written(fingerprint_table(docs), f"{base}/prints")
    nodes = written(prints.groupBy("fp").agg(F.min("doc_id").alias("rep")), f"{base}/nodes")
    roots = components(near_links(nodes.select("fp"))).select(F.col("node").alias("fp"), "root")
    named = nodes.join(roots, "fp", "left").select("fp", "rep", F.coalesce("root", "fp").alias("root"))
    least = named.groupBy("root").agg(F.min("rep").alias("component_id"))
    labels = written(named.join(least, "root").select("fp", "component_id"), f"{base}/labels")
    return prints.join(labels, "fp").select("doc_id", "fp", "component_id")


def op10_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = groups(read(spark, sf_dir, "documents"))
    return got.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame) -> DataFrame:
    """``docs`` without the rows whose near-duplicate group has a lesser ``doc_id``, columns unchanged.

    Of rows that repeat a ``doc_id`` all stay or all go; a row with a null ``doc_id`` stays.
    """
    got = groups(docs).where("doc_id <> component_id").select(F.col("doc_id").alias("_dropped")).distinct()
    # As a table its size is known before the join is planned: while it is small, no text is shuffled.
    got = written(got, workspace(docs.sparkSession, "simhash-dropped"))
    return docs.join(got, docs["doc_id"] == got["_dropped"], "left_anti")
