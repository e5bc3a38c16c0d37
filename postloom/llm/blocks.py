"""Vectorised word work over Arrow string buffers.

Every operator that runs Python on executors goes through ``slices``: an Arrow
batch is cut into runs of rows of bounded byte size, so memory depends on the
longest single text and not on how many rows Spark puts in a batch.

A word is a run of bytes outside ``\\x20 \\x09-\\x0D``; words never span rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

SLICE_BYTES = 1 << 18
U = np.uint64
_MULT = U(0x9E3779B97F4A7C15 | 1)
_STEP = U(0xD1342543DE82EF95)

SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash (xor-shift and multiply)."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U(27))
    x = x * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def texts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets of a string column; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw, offs


def slices(offs: np.ndarray, most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``most`` bytes, or of one row if it is longer."""
    lo, n = 0, len(offs) - 1
    while lo < n:
        hi = int(np.searchsorted(offs, offs[lo] + most, side="right")) - 1
        hi = min(max(hi, lo + 1), n)
        yield lo, hi
        lo = hi


def spans(data: np.ndarray, offs: np.ndarray, space: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words of rows that lie at ``offs`` in ``data``, and the words before each row."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offs), np.int64)
    word = np.zeros(n + 2, bool)
    np.logical_not(space[data], out=word[1:-1])
    first = np.zeros(n + 1, bool)
    first[offs] = True
    starts = np.flatnonzero(word[1:-1] & (~word[:-2] | first[:-1]))
    ends = np.flatnonzero(word[1:-1] & (~word[2:] | first[1:])) + 1
    return starts, ends, np.searchsorted(starts, offs)


def loads(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each place of ``data`` on as one integer, zeros beyond its end."""
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[: len(data)] = data
    return np.ndarray((len(data) + 1,), "<u8", padded, strides=(1,))


#: Spans over this many bytes are hashed and compared one by one.
_LONG = 64
_MASK = np.array([(1 << (8 * n)) - 1 for n in range(9)], U)


def span_hash(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte span, the same wherever it stands.

    Eight bytes are mixed in at a time, so spans of up to eight bytes never share a hash with one of their
    own length. Longer ones may: whoever must not take two for one compares them by ``same_spans``.
    """
    size = ends - starts
    at = loads(data)
    h = mix((at[starts] & _MASK[np.minimum(size, 8)]) + size.astype(U) * _STEP)
    live = np.flatnonzero((size > 8) & (size <= _LONG))
    done = 8
    while len(live):
        left = size[live] - done
        h[live] = mix((h[live] ^ (at[starts[live] + done] & _MASK[np.minimum(left, 8)])) * _MULT + U(done))
        done += 8
        live = live[left > 8]
    far = np.flatnonzero(size > _LONG)
    if len(far):
        h[far] = [xxhash.xxh3_64_intdigest(data[a:b]) for a, b in zip(starts[far].tolist(), ends[far].tolist(), strict=True)]
    return h


def same_spans(data: np.ndarray, starts: np.ndarray, other: np.ndarray, other_starts: np.ndarray, size: np.ndarray, other_loads: np.ndarray | None = None) -> np.ndarray:
    """Whether the ``size`` bytes at ``starts`` of ``data`` equal those at ``other_starts`` of ``other``."""
    a = loads(data)
    b = loads(other) if other_loads is None else other_loads
    mask = _MASK[np.minimum(size, 8)]
    same = (a[starts] & mask) == (b[other_starts] & mask)
    live = np.flatnonzero(same & (size > 8) & (size <= _LONG))
    done = 8
    while len(live):
        left = size[live] - done
        mask = _MASK[np.minimum(left, 8)]
        fits = (a[starts[live] + done] & mask) == (b[other_starts[live] + done] & mask)
        same[live[~fits]] = False
        done += 8
        live = live[fits & (left > 8)]
    for i in np.flatnonzero(same & (size > _LONG)).tolist():
        same[i] = np.array_equal(data[starts[i] : starts[i] + size[i]], other[other_starts[i] : other_starts[i] + size[i]])
    return same


def numbered(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A number for each span, equal exactly for spans of equal bytes, and the place of one span of each number."""
    h = span_hash(data, starts, ends)
    _, example, kind = np.unique(h, return_index=True, return_inverse=True)
    size = ends - starts
    of = example[kind]
    apart = np.flatnonzero((size != size[of]) | ~same_spans(data, starts, data, starts[of], np.minimum(size, size[of])))
    if len(apart):
        own: dict[bytes, int] = {}
        more = []
        for i in apart.tolist():
            raw = data[starts[i] : ends[i]].tobytes()
            if raw not in own:
                own[raw] = len(example) + len(more)
                more.append(i)
            kind[i] = own[raw]
        example = np.r_[example, more]
    return kind, example


def grams(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of ``k`` consecutive entries of ``h`` (``len(h) - k + 1`` of them), mixed at each doubling."""
    if len(h) < k:
        return np.zeros(0, U)
    have, size, out, done = h, 1, None, 0
    left = k
    while left:
        if left & 1:
            if out is None:
                out, done = have, size
            else:
                m = min(len(out), len(have) - done)
                out = mix(out[:m] * _STEP + have[done : done + m])
                done += size
        left >>= 1
        if left:
            have = mix(have[:-size] * _MULT + have[size:])
            size *= 2
    return out[: len(h) - k + 1]


def covered(n: int, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Which of ``n`` places lie in any of the half-open ranges."""
    step = np.zeros(n + 1, np.int64)
    np.add.at(step, starts, 1)
    np.subtract.at(step, ends, 1)
    return np.cumsum(step[:-1]) > 0
