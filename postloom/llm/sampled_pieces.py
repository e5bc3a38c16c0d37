"""SentencePiece encoding by forward filtering and backward sampling, and decoding.

The lattice of a text has an edge for every vocabulary piece that matches at a
place, a space standing for the word mark. A character that is no piece by itself,
a word mark that stands in the text included, is spelled in byte pieces, so every
text has a segmentation and decoding gives back exactly its bytes. No normalising
and no added word mark: those would lose something.

A piece's weight is ``(rank + 1) ** -SHARPNESS``, as the vocabulary has merge ranks
and no probabilities. The forward filter sums the weights of all ways to each
place; the backward sampler then draws a segmentation with probability in
proportion to its product of weights. Draws are a hash of seed, row key, chunk and
step, so a row's segmentation depends on nothing but its key and text.

No piece has a word mark after another character, so a text falls into chunks that
are sampled independently: the filter runs once for each distinct chunk. So does a long
chunk at places that no edge passes over, where the lattice is two lattices.
"""

from __future__ import annotations

import functools
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import blocks
from .shared import map_batches, read

SHARPNESS, SEED = 1.0, 20240
_SLICE = 1 << 19
_LONG = 64
_MARK = "▁"
U = np.uint64
_BITS = 18


class Lattice:
    def __init__(self, path: str, sharpness: float = SHARPNESS):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        size = model.get_piece_size()
        self.piece_bytes: list[bytes] = [b""] * size
        self.byte_id = np.full(256, -1, np.int32)
        own: list[tuple[bytes, int]] = []
        for i in range(size):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                self.byte_id[int(piece[3:5], 16)] = i
                self.piece_bytes[i] = bytes([int(piece[3:5], 16)])
            elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
                if _MARK in piece.lstrip(_MARK):
                    raise ValueError("a piece has a word mark after another character")
                self.piece_bytes[i] = piece.replace(_MARK, " ").encode()
                own.append((self.piece_bytes[i], i))
        if (self.byte_id < 0).any():
            raise ValueError("the vocabulary has no byte pieces")
        rank = np.zeros(size)
        for r, i in enumerate(sorted(range(size), key=lambda i: (-model.get_score(i), i))):
            rank[i] = r
        self.weight = -sharpness * np.log(rank + 1)
        self.weight[self.byte_id] = -sharpness * np.log(size)
        edge = np.r_[0, np.cumsum([len(b) for b, _ in own])]
        h = blocks.span_hash(np.frombuffer(b"".join(b for b, _ in own), np.uint8), edge[:-1], edge[1:])
        self.longest = max(len(b) for b, _ in own)
        self.key, self.id = np.zeros(1 << _BITS, U), np.full(1 << _BITS, -1, np.int32)
        for x, (_, i) in zip(h.tolist(), own, strict=True):
            slot = x >> (64 - _BITS)
            while self.key[slot]:
                slot = (slot + 1) & ((1 << _BITS) - 1)
            self.key[slot], self.id[slot] = x, i
        starts = np.cumsum([0, *(len(b) for b in self.piece_bytes)])
        self.out, self.out_at, self.out_n = np.frombuffer(b"".join(self.piece_bytes), np.uint8), starts[:-1], np.diff(starts)
        self.out_loads = blocks.loads(self.out)

    def find(self, h: np.ndarray) -> np.ndarray:
        """The piece of each hash, or -1."""
        slot = (h >> U(64 - _BITS)).astype(np.int64)
        got = self.key[slot]
        left = np.flatnonzero((got != h) & (got != 0))
        while len(left):
            slot[left] = (slot[left] + 1) & ((1 << _BITS) - 1)
            got = self.key[slot[left]]
            left = left[(got != h[left]) & (got != 0)]
        return np.where(self.key[slot] == h, self.id[slot], -1)

    def _edges(self, data: np.ndarray, edge: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start, end and piece of all edges of the chunks at ``edge`` in ``data``."""
        n = len(data)
        left = np.repeat(edge[1:], np.diff(edge)) - np.arange(n)
        lead = np.flatnonzero((data & 0xC0) != 0x80)
        char_end = np.r_[lead[1:], n]
        spelled = np.ones(len(lead), bool)
        src, dst, piece = [], [], []
        at, of = lead, np.arange(len(lead))
        for size in range(1, self.longest + 1):
            fits = left[at] >= size
            at, of = at[fits], of[fits]
            if not len(at):
                break
            got = self.find(blocks.span_hash(data, at, at + size))
            hit = np.flatnonzero(got >= 0)
            own = got[hit]
            fits = self.out_n[own] == size
            hit, own = hit[fits], own[fits]
            hit = hit[blocks.same_spans(data, at[hit], self.out, self.out_at[own], np.full(len(hit), size), self.out_loads)]
            src.append(at[hit])
            dst.append(at[hit] + size)
            piece.append(got[hit])
            alone = of[hit]
            spelled[alone[char_end[alone] == at[hit] + size]] = False
        rest = np.flatnonzero(np.repeat(spelled, char_end - lead))
        src.append(rest)
        dst.append(rest + 1)
        piece.append(self.byte_id[data[rest]])
        return np.concatenate(src), np.concatenate(dst), np.concatenate(piece)

    def _apart(self, data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Places in the chunks ``[begin, end)`` of ``data`` that no edge of the lattice passes over, at the start of a character."""
        sizes = end - begin
        edge = np.r_[0, np.cumsum(sizes)]
        at = np.repeat(begin - edge[:-1], sizes) + np.arange(edge[-1])
        flat = data[at]
        src, dst, _ = self._edges(flat, edge)
        step = np.zeros(len(flat) + 2, np.int64)
        np.add.at(step, src + 1, 1)
        np.subtract.at(step, dst, 1)
        return at[(np.cumsum(step)[: len(flat)] == 0) & ((flat & 0xC0) != 0x80)]

    def filter(self, data: np.ndarray, edge: np.ndarray) -> tuple[np.ndarray, ...]:
        """Forward filter of the chunks: per node its rank and first edge, and per edge the rising choice key, start and piece.

        A node is a place in ``data`` shifted by the chunk's number, as each chunk also has a place before its first byte.
        """
        src, dst, piece = self._edges(data, edge)
        chunk = np.searchsorted(edge, src, side="right") - 1
        src, dst = src + chunk, dst + chunk
        within = dst - (edge[chunk] + chunk)
        nodes = len(data) + len(edge) - 1
        # By place in the chunk, then by node, then longest piece first: the likely choice is the first one tried.
        order = np.argsort((within * nodes + dst) * (self.longest + 1) + (self.longest - (dst - src)))
        src, dst, piece, within = src[order], dst[order], piece[order], within[order]
        w = self.weight[piece]
        alpha = np.full(nodes, -np.inf)
        alpha[edge[:-1] + np.arange(len(edge) - 1)] = 0
        value = np.empty(len(src))
        head = np.flatnonzero(np.r_[True, dst[1:] != dst[:-1]])
        steps = np.r_[np.flatnonzero(np.r_[True, within[head][1:] != within[head][:-1]]), len(head)]
        bound = np.r_[head, len(dst)]
        for a, b in zip(steps[:-1], steps[1:], strict=True):
            lo, hi = bound[a], bound[b]
            v = alpha[src[lo:hi]] + w[lo:hi]
            at = head[a:b] - lo
            most = np.maximum.reduceat(v, at)
            sizes = np.diff(bound[a : b + 1])
            v = np.exp(v - np.repeat(most, sizes))
            total = np.add.reduceat(v, at)
            alpha[dst[head[a:b]]] = most + np.log(total)
            value[lo:hi] = v / np.repeat(total, sizes)
        rank = np.repeat(np.arange(len(head)), np.diff(bound))
        run = np.cumsum(value)
        choice = rank + np.minimum(run - np.repeat(run[head] - value[head], np.diff(bound)), 1.0)
        choice[bound[1:] - 1] = np.arange(len(head)) + 1.0
        node, first = np.full(nodes, -1, np.int64), np.zeros(nodes, np.int64)
        node[dst[head]], first[dst[head]] = np.arange(len(head)), head
        return node, first, choice, src, piece

    def encode(self, data: np.ndarray, offs: np.ndarray, keys: np.ndarray, seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
        """Sampled ids of all rows one after the other, and how many each row has; ``keys`` seed the rows."""
        rows = len(offs) - 1
        if not len(data):
            return np.zeros(0, np.int32), np.zeros(rows, np.int64)
        start = np.zeros(len(data) + 1, bool)
        start[offs] = True
        control = data < 0x20
        start[1:-1] |= (data[1:] == 0x20) & (data[:-1] != 0x20)
        start[1:-1] |= control[1:] | control[:-1]
        begin = np.flatnonzero(start[:-1])
        end = np.r_[begin[1:], len(data)]
        # Long chunks, as of languages without spaces, fall apart where no piece reaches across.
        far = np.flatnonzero(end - begin > _LONG)
        if len(far):
            start[self._apart(data, begin[far], end[far])] = True
            begin = np.flatnonzero(start[:-1])
            end = np.r_[begin[1:], len(data)]
        row = np.searchsorted(offs, begin, side="right") - 1
        kind, example = blocks.numbered(data, begin, end)
        sizes = (end - begin)[example]
        edge = np.r_[0, np.cumsum(sizes)]
        flat = data[np.repeat(begin[example] - edge[:-1], sizes) + np.arange(edge[-1])]
        node, first, choice, src, piece = self.filter(flat, edge)
        inner = np.arange(len(begin)) - np.searchsorted(row, np.arange(rows))[row]
        stream = blocks.mix(blocks.mix(keys.view(U)[row] + U(seed)) + inner.astype(U))
        root = edge[:-1] + np.arange(len(example))
        place, live = (edge[1:] + np.arange(len(example)))[kind], np.arange(len(begin))
        who, what, turn = [], [], 0
        while len(live):
            turn += 1
            draw = (blocks.mix(stream[live] + U(turn * 0x9E3779B97F4A7C15 & (1 << 64) - 1)) >> U(11)).astype(np.float64) * 2.0**-53
            goal, at = node[place[live]] + draw, first[place[live]]
            left = np.flatnonzero(choice[at] <= goal)
            while len(left):
                at[left] += 1
                left = left[choice[at[left]] <= goal[left]]
            who.append(live)
            what.append(piece[at])
            place[live] = src[at]
            live = live[src[at] != root[kind[live]]]
        count = np.zeros(len(begin), np.int64)
        for w in who:
            count[w] += 1
        last = np.cumsum(count) - 1
        ids = np.empty(int(count.sum()), np.int32)
        for k, (w, p) in enumerate(zip(who, what, strict=True)):
            ids[last[w] - k] = p
        return ids, np.bincount(row, count, rows).astype(np.int64)

    def decode(self, ids: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of all rows one after the other, and their offsets."""
        n = self.out_n[ids]
        total = np.r_[0, np.cumsum(n)]
        data = self.out[np.repeat(self.out_at[ids] - total[:-1], n) + np.arange(total[-1])]
        return data, total[np.r_[0, np.cumsum(sizes)]]


@functools.cache
def lattice(path: str, sharpness: float = SHARPNESS) -> Lattice:
    return Lattice(path, sharpness)


def encode(docs: DataFrame, path: str, with_pieces: bool = True, seed: int = SEED, sharpness: float = SHARPNESS) -> DataFrame:
    """``(doc_id, n_pieces, pieces_crc32, lossless[, pieces])`` for every row of ``docs``.

    ``lossless`` says that decoding the pieces gave back the text's bytes. A null or empty text has no
    pieces; the row key is ``doc_id``, null counting as a key of its own; repeated rows get equal pieces.
    """
    names = ["doc_id", "n_pieces", "pieces_crc32", "lossless", "pieces"][: 4 + with_pieces]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = lattice(path, sharpness)
        for batch in batches:
            raw, offs = blocks.texts(batch.column(1))
            keys = batch.column(0).fill_null(np.iinfo(np.int64).min).to_numpy()
            for lo, hi in blocks.slices(offs, _SLICE):
                data, at = raw[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo]
                ids, sizes = model.encode(data, at, np.ascontiguousarray(keys[lo:hi]), seed)
                back, back_at = model.decode(ids, sizes)
                same = [bool(b - a == d - c and (back[a:b] == data[c:d]).all()) for a, b, c, d in zip(back_at[:-1], back_at[1:], at[:-1], at[1:], strict=True)]
                edge = np.r_[0, np.cumsum(sizes)]
                crc = [zlib.crc32(ids[a:b].astype("<u4").tobytes()) for a, b in zip(edge[:-1], edge[1:], strict=True)]
                cols = [batch.column(0).slice(lo, hi - lo), pa.array(sizes), pa.array(crc, pa.int64()), pa.array(same, pa.bool_())]
                if with_pieces:
                    cols.append(pa.ListArray.from_arrays(pa.array(edge.astype(np.int32)), pa.array(ids)))
                yield pa.RecordBatch.from_arrays(cols, names)

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return map_batches(rows, run, "doc_id long, n_pieces long, pieces_crc32 long, lossless boolean" + ", pieces array<int>" * with_pieces)


def decode(pieces: DataFrame, path: str) -> DataFrame:
    """``(doc_id, text)`` of a table with ``(doc_id, pieces)``; null pieces give an empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = lattice(path)
        for batch in batches:
            lists = batch.column(1).to_pylist()
            texts = [b"".join(model.piece_bytes[i] for i in x or ()).decode(errors="replace") for x in lists]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return map_batches(pieces.select(F.col("doc_id").cast("long"), F.col("pieces").cast("array<int>")), run, "doc_id long, text string")


def op3_sampled_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return encode(read(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"), with_pieces=False)
