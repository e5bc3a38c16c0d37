"""Substring dedup with a log-structured index of window fingerprints.

A *window* is ``WINDOW`` consecutive words of one row. Of its ``WINDOW - GRAM + 1``
word grams the one with the least hash (the first of equals) is its *anchor*:
equal windows have equal anchors at the same place, so an index of anchors finds
every repeated window with one entry in about 14 words. Consecutive windows with
one anchor form a *stretch*.

Index: each batch of rows gives an immutable run ``(fp, n)``, bucketed and sorted by
anchor fingerprint. Runs stand in levels, one a level at most; a new run that meets
one of its own level is merge-joined with it into a run of the next, so history is
rewritten as often as the logarithm of the number of batches. Runs have equal
buckets of one sorted file each: merging them neither shuffles nor sorts. What is
live stands in a manifest, by which a later session opens the index again and goes on.

Verification, on the hits of anchors that occur twice or more: stretches with equal
digests of their words (128 bits, cryptographic) settle their windows at once; where
an anchor has different stretches, one text of each is read again and its windows are
compared one by one, by digests of their words again.

Rows are told apart by ``doc_id`` and a hash of the text, so rows that repeat a
``doc_id`` are separate rows, and a fully repeated row repeats all its windows.
A null or empty text has no words; a row of fewer than ``WINDOW`` words loses none.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..work import partitions
from . import blocks
from .shared import listed, map_batches, read, read_text, release, remove, setting, workspace, write_text, written

WINDOW, GRAM = 35, 8
_SPAN = WINDOW - GRAM + 1
_POSTED = "fp long, sd binary, id long, tk long, first int, many int"
_PLACE = np.uint64((1 << 28) - 1)
#: Batches that the query feeds to the index one after the other.
BATCHES = 2


def _least(key: np.ndarray, span: int) -> np.ndarray:
    """Minimum of each run of ``span`` entries."""
    have, size = key, 1
    while 2 * size <= span:
        have = np.minimum(have[:-size], have[size:])
        size *= 2
    return np.minimum(have[: len(key) - span + 1], have[span - size :][: len(key) - span + 1])


def stretches(h: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, ...]:
    """``(fp, first window, windows)`` of the stretches of the words ``h`` of rows ``row``."""
    n = len(h) - WINDOW + 1
    if n <= 0:
        none = np.zeros(0, np.int64)
        return none.astype(np.uint64), none, none
    g = blocks.grams(h, GRAM)
    if len(g) > int(_PLACE):
        raise ValueError("a single text of over 2**28 words")
    anchor = (_least((g & ~_PLACE) | np.arange(len(g), dtype=np.uint64), _SPAN) & _PLACE).astype(np.int64)
    at = np.flatnonzero(row[:n] == row[WINDOW - 1 :])
    if not len(at):
        return stretches(h[:0], row[:0])
    head = np.flatnonzero(np.r_[True, (anchor[at[1:]] != anchor[at[:-1]]) | (at[1:] != at[:-1] + 1)])
    first, many = at[head], np.diff(np.r_[head, len(at)])
    place = anchor[first]
    return blocks.mix(g[place] + np.uint64(GRAM)), first, many


class Words:
    """The words of rows that lie at ``offs`` in ``data``: hashes, rows, words before each row, and digests of runs."""

    def __init__(self, data: np.ndarray, offs: np.ndarray):
        starts, ends, self.before = blocks.spans(data, offs)
        self.hash = blocks.span_hash(data, starts, ends)
        self.row = np.repeat(np.arange(len(offs) - 1), np.diff(self.before))
        # The words behind one another with one space between two.
        self.end = np.cumsum(ends - starts + 1) - 1
        self.start = self.end - (ends - starts)
        text = np.full(int(self.end[-1]) + 1 if len(starts) else 0, 0x20, np.uint8)
        inked = np.ones(len(text), bool)
        inked[self.end] = False
        text[inked] = data[~blocks.SPACE[data]]
        self._text = memoryview(text.tobytes())

    def digests(self, lo: np.ndarray, hi: np.ndarray) -> pa.Array:
        """128-bit digests of the words of the runs ``[lo, hi)``."""
        text = self._text
        raw = b"".join([blake2b(text[a:b], digest_size=16).digest() for a, b in zip(self.start[lo].tolist(), self.end[hi - 1].tolist(), strict=True)])
        return pa.Array.from_buffers(pa.binary(), len(lo), [None, pa.py_buffer(np.arange(0, 16 * len(lo) + 1, 16, dtype=np.int32)), pa.py_buffer(raw)])


def _postings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        raw, offs = blocks.texts(batch.column(2))
        for lo, hi in blocks.slices(offs):
            w = Words(raw[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo])
            fp, first, many = stretches(w.hash, w.row)
            of = w.row[first] if len(first) else first
            cols = [pa.array(fp.view(np.int64)), w.digests(first, first + many - 1 + WINDOW), *(batch.column(i).slice(lo, hi - lo).take(pa.array(of)) for i in (0, 1)), pa.array((first - w.before[of]).astype(np.int32)), pa.array(many.astype(np.int32))]
            yield pa.RecordBatch.from_arrays(cols, ["fp", "sd", "id", "tk", "first", "many"])


def keyed(docs: DataFrame) -> DataFrame:
    """``docs`` as ``(doc_id, text)`` with the row key ``(id, tk)``."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return docs.withColumn("id", F.coalesce("doc_id", F.xxhash64("text"))).withColumn("tk", F.xxhash64("text"))


class FingerprintLog:
    """The index in the folder ``path``: levels of sorted runs, the stretches of all batches, and a manifest.

    A folder that has a manifest is opened where it stands; any other begins empty. ``buckets``
    is fixed when the index begins; without a path it gets a folder of its own.
    """

    def __init__(self, spark: SparkSession, path: str | None = None, buckets: int | None = None):
        self.spark, self.base = spark, path or workspace(spark, "fingerprints")
        turns = [int(x.split("-")[1]) for x in listed(spark, self.base) if x.startswith("manifest-")]
        if turns:
            self._state = json.loads(read_text(spark, f"{self.base}/manifest-{max(turns)}"))
        else:
            self._state = {"name": f"fingerprints_{uuid.uuid4().hex}", "turn": 0, "buckets": buckets or max(8, partitions(spark)), "levels": {}}

    @property
    def turn(self) -> int:
        """Batches so far."""
        return self._state["turn"]

    def _table(self, run: str) -> str:
        return f"{self._state['name']}_{run}"

    def _run(self, run: str) -> DataFrame:
        """A run as a bucketed table, which another session doesn't know yet."""
        self.spark.sql(f"create table if not exists {self._table(run)} (fp bigint, n bigint) using parquet clustered by (fp) sorted by (fp) into {self._state['buckets']} buckets location '{self.base}/run-{run}'")
        return self.spark.table(self._table(run))

    def _write(self, run: DataFrame, name: str) -> DataFrame:
        target = run.write.mode("overwrite").format("parquet").option("compression", "zstd").option("path", f"{self.base}/run-{name}")
        with setting(self.spark, "spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true"):
            target.bucketBy(self._state["buckets"], "fp").sortBy("fp").saveAsTable(self._table(name))
        return self._run(name)

    def append(self, rows: DataFrame) -> None:
        """Adds a batch of keyed rows: writes its stretches and its run, and merges runs of equal level."""
        turn, levels, old = self.turn + 1, dict(self._state["levels"]), []
        posted = map_batches(rows.select("id", "tk", "text"), _postings, _POSTED)
        posted = written(posted, f"{self.base}/postings-{turn}")
        name = f"{turn}_0"
        run = self._write(posted.groupBy("fp").agg(F.count("*").alias("n")).repartition(self._state["buckets"], "fp"), name)
        level = 0
        # One file a bucket and no shuffle between: tasks of the merge join read and write sorted.
        with setting(self.spark, "spark.sql.legacy.bucketedTableScan.outputOrdering", "true"), setting(self.spark, "spark.sql.autoBroadcastJoinThreshold", "-1"):
            while str(level) in levels:
                other = levels.pop(str(level))
                merged = run.withColumnRenamed("n", "n_new").join(self._run(other).withColumnRenamed("n", "n_old"), "fp", "full_outer")
                old += [name, other]
                level += 1
                name = f"{turn}_{level}"
                run = self._write(merged.select("fp", (F.coalesce("n_old", F.lit(0)) + F.coalesce("n_new", F.lit(0))).alias("n")), name)
        levels[str(level)] = name
        self._state = {**self._state, "turn": turn, "levels": levels}
        write_text(self.spark, f"{self.base}/manifest-{turn}", json.dumps(self._state))
        for x in old:
            self._forget(x)
        remove(self.spark, f"{self.base}/manifest-{turn - 1}")
        release(self.spark)

    def _forget(self, run: str) -> None:
        self.spark.sql(f"drop table if exists {self._table(run)}")
        remove(self.spark, f"{self.base}/run-{run}")

    def repeated(self) -> DataFrame:
        """``fp`` of the anchors that occur more than once in all batches; runs are summed bucket by bucket."""
        total = None
        for name in self._state["levels"].values():
            total = self._run(name) if total is None else total.union(self._run(name))
        if total is None:
            return self.spark.createDataFrame([], "fp long")
        return total.groupBy("fp").agg(F.sum("n").alias("n")).where("n > 1").select("fp")

    def hits(self) -> DataFrame:
        """Stretches of all batches whose anchor occurs more than once."""
        paths = [f"{self.base}/postings-{k}" for k in range(1, self.turn + 1)]
        if not paths:
            return self.spark.createDataFrame([], _POSTED)
        return self.spark.read.schema(_POSTED).parquet(*paths).join(self.repeated(), "fp")

    def drop(self) -> None:
        """Deletes the index, when nothing more will be added."""
        for name in self._state["levels"].values():
            self._forget(name)
        for k in range(1, self.turn + 1):
            remove(self.spark, f"{self.base}/postings-{k}")
        remove(self.spark, f"{self.base}/manifest-{self.turn}")
        self._state = {**self._state, "turn": 0, "levels": {}}


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts with lists of stretches; gives every window of these."""
    names = ["fp", "sd", "n", "place", "wd"]
    for batch in batches:
        raw, offs = blocks.texts(batch.column(0))
        lists = batch.column(1)
        for lo, hi in blocks.slices(offs):
            w = Words(raw[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo])
            part = lists.slice(lo, hi - lo)
            flat, sizes = part.flatten(), part.value_lengths().to_numpy()
            n, first, many = (flat.field(i).to_numpy() for i in (2, 3, 4))
            begin = first + np.repeat(w.before[:-1], sizes)
            at = np.repeat(np.arange(len(n)), many)
            place = np.arange(len(at)) - np.repeat(np.cumsum(many) - many, many)
            lead = begin[at] + place
            yield pa.RecordBatch.from_arrays([flat.field(0).take(pa.array(at)), flat.field(1).take(pa.array(at)), pa.array(n[at]), pa.array(place.astype(np.int32)), w.digests(lead, lead + WINDOW)], names)


def repeats(docs: DataFrame, log: FingerprintLog, base: str | None = None) -> DataFrame:
    """``(id, tk, marks)`` of the rows with repeated windows: ``marks`` lists the first window of a stretch and a bit for each repeated one.

    ``log`` holds all rows of ``docs``; tables between the steps stand in the folder ``base``, which the result still reads.
    """
    spark = docs.sparkSession
    base = base or workspace(spark, "repeats")
    rows = keyed(docs)
    hits = written(log.hits(), f"{base}/hits")
    release(spark)
    kinds = hits.groupBy("fp", "sd").agg(F.count("*").alias("n"), F.min(F.struct("id", "tk", "first", "many")).alias("at"))
    kinds = written(kinds, f"{base}/kinds")
    release(spark)
    several = kinds.groupBy("fp").agg(F.count("*").alias("kinds"), F.sum(F.when(F.col("n") == 1, 1).otherwise(0)).alias("single")).where("kinds > 1 and single > 0").select("fp")
    unsettled = kinds.join(several, "fp").select("at.id", "at.tk", F.struct("fp", "sd", "n", "at.first", "at.many").alias("s"))
    lists = unsettled.groupBy("id", "tk").agg(F.collect_list("s").alias("list"))
    # A fully repeated row has no stretch that occurs once, so counting it again changes nothing.
    again = map_batches(rows.select("id", "tk", "text").join(lists, ["id", "tk"]).select("text", "list"), _windows, "fp long, sd binary, n long, place int, wd binary")
    again = written(again, f"{base}/windows")
    release(spark)
    found = again.groupBy("fp", "wd").agg(F.sum("n").alias("total")).where("total > 1").select("fp", "wd")
    masks = again.where("n = 1").join(found, ["fp", "wd"]).groupBy("fp", "sd").agg(F.expr("bit_or(shiftleft(1L, place))").alias("mask"))
    settled = kinds.where("n > 1").select("fp", "sd", F.expr("shiftleft(1L, at.many) - 1").alias("mask"))
    marks = hits.join(settled.union(masks), ["fp", "sd"])
    return marks.groupBy("id", "tk").agg(F.collect_set(F.struct("first", "mask")).alias("marks"))


def _kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["doc_id", "n_words", "n_removed", "kept"]
    for batch in batches:
        doc, lists = batch.column(0), batch.column(2)
        raw, offs = blocks.texts(batch.column(1))
        for lo, hi in blocks.slices(offs):
            n_words, n_removed, kept = [], [], []
            for i in range(lo, hi):
                words = raw[offs[i] : offs[i + 1]].tobytes().split()
                n_words.append(len(words))
                marks = lists[i].as_py() if lists[i].is_valid else []
                if marks:
                    first = np.array([m["first"] for m in marks])
                    mask = np.array([m["mask"] for m in marks])
                    of, bit = np.nonzero((mask[:, None] >> np.arange(_SPAN)) & 1)
                    at = first[of] + bit
                    gone = blocks.covered(len(words), at, at + WINDOW)
                    words = [words[k] for k in np.flatnonzero(~gone).tolist()]
                n_removed.append(n_words[-1] - len(words))
                kept.append(b" ".join(words))
            yield pa.RecordBatch.from_arrays([doc.slice(lo, hi - lo), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.binary())], names)


def remove_repeats(docs: DataFrame, batches: list[Column] | None = None) -> DataFrame:
    """``(doc_id, n_words, n_removed, kept)``, a row for each row of ``docs``; ``kept`` is the UTF-8 text of the words left, joined by spaces.

    ``batches`` are conditions that cut the rows into the index's batches, in order.
    """
    rows, log = keyed(docs), FingerprintLog(docs.sparkSession)
    for condition in batches or [F.lit(True)]:
        log.append(rows.where(condition))
    steps = workspace(docs.sparkSession, "repeats")
    found = written(repeats(docs, log, steps), workspace(docs.sparkSession, "marks"))
    remove(docs.sparkSession, steps)
    log.drop()
    release(docs.sparkSession)
    return without(docs, found)


def without(docs: DataFrame, found: DataFrame) -> DataFrame:
    """As ``remove_repeats``, from the marks that ``repeats`` found."""
    rows = keyed(docs).join(found, ["id", "tk"], "left").select("doc_id", "text", "marks")
    return map_batches(rows, _kept, "doc_id long, n_words long, n_removed long, kept binary")


def batches_by_id(docs: DataFrame, count: int = BATCHES) -> list[Column]:
    """Conditions that cut all rows of ``docs`` into about equal ranges of ``doc_id``; rows without one are in the first."""
    edges = sorted(set(docs.select(F.col("doc_id").cast("long").alias("d")).approxQuantile("d", [i / count for i in range(1, count)], 0.01))) if count > 1 else []
    edges = [int(e) for e in edges]
    if not edges:
        return [F.lit(True)]
    d = F.col("doc_id")
    first = d.isNull() | (d < edges[0])
    return [first, *((d >= a) & (d < b) for a, b in zip(edges[:-1], edges[1:], strict=True)), d >= edges[-1]]


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    got = remove_repeats(docs, batches_by_id(docs))
    return got.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


OP1_SQL = """
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
win AS (SELECT rid, i, md5(array_to_string(w[i:i + 34], ' ')) AS k FROM (SELECT rid, w, unnest(range(1, len(w) - 33)) AS i FROM d WHERE len(w) >= 35)),
twice AS (SELECT k FROM win GROUP BY k HAVING count(*) > 1),
gone AS (SELECT rid, list(DISTINCT p) AS ps FROM (SELECT rid, unnest(range(i, i + 35)) AS p FROM win JOIN twice USING (k)) GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(len(ps), 0) AS BIGINT) AS n_removed, sha256(array_to_string(list_filter(w, lambda x, i: ps IS NULL OR NOT list_contains(ps, i)), ' ')) AS kept_sha256
FROM d LEFT JOIN gone USING (rid)
"""
