"""Token-id files under a static range asymmetric numeral system.

A file set has a table of frequencies that all blocks share, and shards in
ascending ``doc_id`` order; a shard's rows are documents in that order. Both are
Parquet: the writer's commit makes a lost executor's files harmless, and readers
fetch the index columns without the payload.

Payload of a document, all little-endian:

    n_ids u64, n_blocks u32
    per block, the checkpoints:  n_words u32, crc32 u32, LANES states u64
    per block:                   n_words words u32

A block holds ``BLOCK`` ids (the last one fewer) in ``LANES`` interleaved states;
id ``i`` is in lane ``i % LANES``. A checkpoint has all a decoder needs to start at
its block, so blocks decode in parallel and a range of ids costs only its blocks.
The checksum is of the block's ids as unsigned 32-bit integers; a mismatch raises.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import blocks
from .pretokens import pretokens
from .shared import map_batches, read, release, remove, workspace, written

BLOCK, LANES = 1024, 4
#: Frequencies sum to 2**SCALE; states stay in [2**LOW, 2**(LOW + 32)).
SCALE, LOW = 20, 31
END_ID = 0
#: Ids of a shard, in bytes as the writer holds them; a shard is sorted by one task.
SHARD_BYTES = 32 << 20
U = np.uint64
_INDEX = "doc_id long, n_ids long, ids_crc32 long"
_HEAD, _MARK = struct.Struct("<QI"), struct.Struct(f"<II{LANES}Q")


def frequencies(counts: np.ndarray) -> np.ndarray:
    """Counts scaled to sum to ``2**SCALE``: at least 1 where an id occurs, 0 elsewhere."""
    seen = np.flatnonzero(counts)
    if len(seen) > 1 << SCALE:
        raise ValueError("more distinct ids than the table has slots")
    out = np.zeros(len(counts), np.int64)
    if not len(seen):
        return out
    share = counts[seen] * ((1 << SCALE) - len(seen)) / counts.sum()
    out[seen] = 1 + np.floor(share).astype(np.int64)
    short = (1 << SCALE) - int(out.sum())
    order = np.lexsort((seen, -(share - np.floor(share))))
    while short:
        take = order[:short]
        out[seen[take]] += 1
        short -= len(take)
    return out


class Coder:
    def __init__(self, freq: np.ndarray):
        self.freq = freq.astype(U)
        self.cum = (np.cumsum(freq) - freq).astype(U)
        self.symbol = np.repeat(np.arange(len(freq), dtype=np.int32), freq)

    def encode(self, ids: np.ndarray, sizes: np.ndarray) -> list[bytes]:
        """Payloads of the documents whose ids follow one another in ``ids``."""
        doc, start, n = _block_table(sizes)
        order = np.argsort(-n, kind="stable")
        first, many = start[order], n[order]
        state = np.full((len(n), LANES), 1 << LOW, U)
        words = np.zeros((len(n), BLOCK + LANES), np.uint32)
        used = np.zeros(len(n), np.int64)
        lane = np.arange(LANES)
        steps = (many + LANES - 1) // LANES
        for t in range(int(steps.max(initial=0)) - 1, -1, -1):
            k = int(np.searchsorted(-steps, -t, side="left"))
            at = t * LANES + lane
            valid = at < many[:k, None]
            s = ids[np.where(valid, first[:k, None] + at, 0)]
            x, f = state[:k], self.freq[s]
            f[~valid] = 1
            out = valid & (x >= (f << U(63 - SCALE)))
            # Later lanes first, as the whole stream is turned round at the end.
            place = used[:k, None] + out[:, ::-1].cumsum(1)[:, ::-1] - 1
            b, c = np.nonzero(out)
            words[b, place[b, c]] = x[b, c].astype(np.uint32)
            used[:k] += out.sum(1)
            x = np.where(out, x >> U(32), x)
            q = x // f
            state[:k] = np.where(valid, (q << U(SCALE)) + (x - q * f) + self.cum[s], x)
        back = np.empty(len(n), np.int64)
        back[order] = np.arange(len(n))
        raw = ids.astype("<u4")
        payloads, b = [], 0
        for i, size in enumerate(sizes.tolist()):
            marks, streams = [], []
            blocks_of = -(-size // BLOCK)
            for j in range(b, b + blocks_of):
                r = back[j]
                stream = words[r, : used[r]][::-1]
                marks.append(_MARK.pack(used[r], zlib.crc32(raw[start[j] : start[j] + n[j]].tobytes()), *state[r].tolist()))
                streams.append(stream.astype("<u4").tobytes())
            b += blocks_of
            payloads.append(b"".join([_HEAD.pack(size, blocks_of), *marks, *streams]))
        return payloads

    def decode(self, payloads: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """All ids one after the other, and how many each payload has."""
        heads = [_HEAD.unpack_from(p) for p in payloads]
        sizes = np.array([h[0] for h in heads], np.int64)
        _, start, n = _block_table(sizes)
        state, crc, base, parts, total = np.empty((len(n), LANES), U), [], np.zeros(len(n), np.int64), [], 0
        b = 0
        for p, (_, count) in zip(payloads, heads, strict=True):
            at = _HEAD.size + count * _MARK.size
            parts.append(p[at:])
            for j in range(count):
                n_words, c, *x = _MARK.unpack_from(p, _HEAD.size + j * _MARK.size)
                state[b], base[b] = x, total
                crc.append(c)
                total += n_words
                b += 1
        words = np.frombuffer(b"".join(parts) + bytes(4), "<u4")
        order = np.argsort(-n, kind="stable")
        state, base, first, many = state[order], base[order], start[order], n[order]
        ids = np.zeros(int(sizes.sum()) + 1, np.int32)
        lane, mask = np.arange(LANES), U((1 << SCALE) - 1)
        steps = (many + LANES - 1) // LANES
        for t in range(int(steps.max(initial=0))):
            k = int(np.searchsorted(-steps, -t, side="left"))
            at = t * LANES + lane
            valid = at < many[:k, None]
            x = state[:k]
            slot = x & mask
            s = self.symbol[slot]
            ids[np.where(valid, first[:k, None] + at, len(ids) - 1)] = s
            x = np.where(valid, self.freq[s] * (x >> U(SCALE)) + slot - self.cum[s], x)
            short = valid & (x < U(1 << LOW))
            place = base[:k, None] + short.cumsum(1) - 1
            got = words[np.where(short, place, 0)].astype(U)
            state[:k] = np.where(short, (x << U(32)) | got, x)
            base[:k] += short.sum(1)
        ids = ids[:-1]
        raw = ids.astype("<u4")
        for j in range(len(n)):
            if zlib.crc32(raw[start[j] : start[j] + n[j]].tobytes()) != crc[j]:
                raise ValueError("checksum of a block does not match its ids")
        return ids, sizes


def _block_table(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Document, first id and number of ids of each block."""
    per = -(-sizes // BLOCK)
    doc = np.repeat(np.arange(len(sizes)), per)
    inner = np.arange(len(doc)) - np.repeat(np.cumsum(per) - per, per)
    start = (np.cumsum(sizes) - sizes)[doc] + inner * BLOCK
    return doc, start, np.minimum(sizes[doc] - inner * BLOCK, BLOCK)


def _packed(ids: np.ndarray, sizes: np.ndarray, kind: str) -> list[bytes]:
    raw, width = ids.astype(kind).tobytes(), np.dtype(kind).itemsize
    edge = (np.r_[0, np.cumsum(sizes)] * width).tolist()
    return [raw[a:b] for a, b in zip(edge[:-1], edge[1:], strict=True)]


def _crc32(ids: np.ndarray, sizes: np.ndarray) -> pa.Array:
    return pa.array([zlib.crc32(x) for x in _packed(ids, sizes, "<u4")], pa.int64())


def _tokenise(docs: DataFrame, path: str, end_id: int, kind: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = pretokens(path)
        for batch in batches:
            raw, offs = blocks.texts(batch.column(1))
            for lo, hi in blocks.slices(offs, 1 << 20):
                ids, sizes = coder.encode(raw[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo])
                ids = np.insert(ids, np.cumsum(sizes), end_id)
                sizes = sizes + 1
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(sizes), pa.array(_packed(ids, sizes, kind), pa.binary())], ["doc_id", "n_ids", "ids"])

    return map_batches(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), run, "doc_id long, n_ids long, ids binary")


def _tally(ids: DataFrame, size: int, kind: str) -> np.ndarray:
    """How often each id occurs in all of ``ids``: at most ``size`` rows come to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for batch in batches:
            raw, _ = blocks.texts(batch.column(0))
            offs = np.frombuffer(batch.column(0).buffers()[1], np.int32)[batch.column(0).offset :][: len(batch.column(0)) + 1]
            for at in range(int(offs[0]), int(offs[-1]), 1 << 22):
                total += np.bincount(raw[at : min(at + (1 << 22), int(offs[-1]))].view(kind), minlength=size)
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen.astype(np.int32)), pa.array(total[seen])], ["id", "n"])

    out = np.zeros(size, np.int64)
    for row in ids.select("ids").mapInArrow(run, "id int, n long").groupBy("id").agg(F.sum("n").alias("n")).collect():
        out[row["id"]] = row["n"]
    return out


def _sized(ids: DataFrame, width: int) -> int:
    """Shards of about ``SHARD_BYTES`` of ids each."""
    return max(1, -(-(ids.agg(F.sum("n_ids")).first()[0] or 0) * width // SHARD_BYTES))


def write_ids(docs: DataFrame, path: str, out: str, end_id: int = END_ID, shards: int | None = None) -> None:
    """Encodes every text of ``docs`` and writes the file set ``out``, in as many shards as its bytes need.

    Rows stand in ascending ``doc_id`` order, null first, rows of one ``doc_id`` in an order of their own that
    files keep, so that they too may be dealt to several shards.
    A null or empty text is its end id alone; other columns are ignored.
    """
    spark = docs.sparkSession
    size = pretokens(path).vocabulary
    kind = "<u2" if size <= 1 << 16 else "<u4"
    base = workspace(spark, "token-ids")
    # The tie is a number of the written row, so it stays what it is when a task runs again.
    ids = written(_tokenise(docs, path, end_id, kind).withColumn("tie", F.monotonically_increasing_id()), base)
    freq = frequencies(_tally(ids, size, kind))
    shards = shards or _sized(ids, np.dtype(kind).itemsize)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Coder(freq)
        for batch in batches:
            raw, _ = blocks.texts(batch.column(2))
            n = batch.column(1).to_numpy()
            offs = np.r_[0, np.cumsum(n)] * np.dtype(kind).itemsize
            origin = np.frombuffer(batch.column(2).buffers()[1], np.int32)[batch.column(2).offset]
            for lo, hi in blocks.slices(offs, 1 << 20):
                part = raw[origin + offs[lo] : origin + offs[hi]].view(kind).astype(np.int32)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(n[lo:hi]), _crc32(part, n[lo:hi]), pa.array(coder.encode(part, n[lo:hi]), pa.binary()), *(batch.column(i).slice(lo, hi - lo) for i in (3, 4))], ["doc_id", "n_ids", "ids_crc32", "payload", "tie", "shard"])

    order = [F.col("doc_id").asc_nulls_first(), F.col("tie").asc()]
    # Partitions are ranges of the order, so a partition's number is its shard's. Ranges are found before
    # anything is coded, as that takes a pass over the rows.
    ordered = ids.repartitionByRange(shards, *order).sortWithinPartitions(*order)
    coded = ordered.withColumn("shard", F.spark_partition_id()).mapInArrow(run, f"{_INDEX}, payload binary, tie long, shard int")
    coded.write.mode("overwrite").option("compression", "none").parquet(f"{out}/documents")
    table = spark.createDataFrame([(int(i), int(f)) for i, f in enumerate(freq) if f] or [(end_id, 1 << SCALE)], "id int, freq int")
    table.coalesce(1).write.mode("overwrite").parquet(f"{out}/table")
    remove(spark, base)
    release(spark)


def read_ids(spark: SparkSession, out: str) -> DataFrame:
    """``(doc_id, start, n_ids, ids_crc32, ids)`` of the file set ``out``, ``start`` being the ids of all documents before.

    Null and repeated ``doc_id`` come back as they were written; an empty file set gives no rows, and a
    payload that doesn't match its checksums raises.
    """
    return _decoded(spark, out, True)


def read_digests(spark: SparkSession, out: str) -> DataFrame:
    """As ``read_ids``, from decoded and verified ids, but without them."""
    return _decoded(spark, out, False)


def _decoded(spark: SparkSession, out: str, with_ids: bool) -> DataFrame:
    table = spark.read.schema("id int, freq int").parquet(f"{out}/table").collect()
    freq = np.zeros(max(r["id"] for r in table) + 1, np.int64)
    for r in table:
        freq[r["id"]] = r["freq"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Coder(freq)
        for batch in batches:
            n, crc = batch.column(2).to_numpy(), batch.column(3)
            for lo, hi in blocks.slices(np.r_[0, np.cumsum(n)], 1 << 19):
                ids, sizes = coder.decode(batch.column(4).slice(lo, hi - lo).to_pylist())
                found = _crc32(ids, sizes)
                if not np.array_equal(sizes, n[lo:hi]) or not found.equals(crc.slice(lo, hi - lo)):
                    raise ValueError("a payload and its index disagree")
                cols = [*(batch.column(i).slice(lo, hi - lo) for i in (0, 1, 5)), pa.array(sizes), found]
                if with_ids:
                    cols.append(pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(sizes)].astype(np.int32)), pa.array(ids)))
                yield pa.RecordBatch.from_arrays(cols, ["shard", "doc_id", "tie", "n_ids", "ids_crc32", "ids"][: len(cols)])

    files = spark.read.schema(f"{_INDEX}, payload binary, tie long, shard int").parquet(f"{out}/documents")
    # One number for each shard comes to the driver; rows of a shard are then summed within it.
    before, offsets = 0, []
    for r in sorted(files.groupBy("shard").agg(F.sum("n_ids").alias("n")).collect(), key=lambda r: r["shard"]):
        offsets.append((r["shard"], before))
        before += r["n"]
    offset = spark.createDataFrame(offsets or [(0, 0)], "shard int, before long")
    rows = files.select("shard", "doc_id", "n_ids", "ids_crc32", "payload", "tie").mapInArrow(run, "shard int, doc_id long, tie long, n_ids long, ids_crc32 long" + ", ids array<int>" * with_ids)
    order = Window.partitionBy("shard").orderBy("doc_id", "tie").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("within", F.coalesce(F.sum("n_ids").over(order), F.lit(0)))
    return rows.join(F.broadcast(offset), "shard").withColumn("start", F.col("within") + F.col("before")).drop("shard", "within", "before", "tie")


def op4_token_id_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    out = workspace(spark, "token-id-files")
    write_ids(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), out)
    got = read_digests(spark, out)
    return got.select("doc_id", "start", F.col("n_ids").alias("n_tokens"), "ids_crc32")
