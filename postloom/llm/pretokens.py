"""Byte-level BPE by pre-tokens, with the whole-token shortcut.

A vocabulary string is *proven* if it is one pre-token and the library encodes it
alone as one token. Texts are cut into pre-tokens on their bytes; a proven one
costs a look-up, and only the rest is merged, each distinct string once, by the
library itself. Texts that this cut doesn't cover (special strings, characters
outside plain Latin text) go to the library as a whole, so the results are the
library's for every text.

Pre-tokens are looked up by a 64-bit hash and compared with the bytes found there;
a text with one that shares another's hash goes to the library as a whole.
"""

from __future__ import annotations

import functools
import json
import os

import numpy as np

from . import blocks

#: Entries that a worker keeps beside the vocabulary, and bytes of all; beyond them it starts afresh.
KEPT = 2_000_000
KEPT_BYTES = 1 << 28
_BITS = 22

_LETTER, _DIGIT, _BLANK, _OTHER = 1, 2, 3, 4
_INHERIT = 0


def _byte_classes() -> tuple[np.ndarray, np.ndarray]:
    kind, bad = np.full(256, _OTHER, np.uint8), np.zeros(256, bool)
    for b in range(128):
        c = chr(b)
        kind[b] = _LETTER if c.isalpha() else _DIGIT if c.isdigit() else _BLANK if c in " \t\n\r" else _OTHER
        bad[b] = not (c.isprintable() or c in "\t\n\r")
    kind[0x80:0xC0] = _INHERIT
    kind[0xC3:0xCA] = _LETTER
    bad[0xC0:] = True
    bad[[*range(0xC2, 0xCA), 0xE2]] = False
    return kind, bad


_KIND, _BAD = _byte_classes()
#: Second bytes after 0xC2 (U+00A1 to U+00BF) that are letters or digits.
_C2 = np.full(256, _OTHER, np.uint8)
_C2[[0xAA, 0xB5, 0xBA]] = _LETTER
_C2[[0xB2, 0xB3, 0xB9, 0xBC, 0xBD, 0xBE]] = _DIGIT


def cut(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts of the pre-tokens of the rows at ``offs``, which cover all bytes, and whether this cut holds for each row."""
    n = len(data)
    head = np.zeros(n + 1, bool)
    head[offs] = True
    head = head[:n]
    after = np.r_[data[1:], np.uint8(0)]
    kind = _KIND[data]
    bad = _BAD[data]
    at = np.flatnonzero(data == 0xC2)
    kind[at] = _C2[after[at]]
    bad[at] |= after[at] < 0xA1
    at = np.flatnonzero(data == 0xC3)
    kind[at[(after[at] == 0x97) | (after[at] == 0xB7)]] = _OTHER
    at = np.flatnonzero(data == 0xC9)
    bad[at] |= after[at] > 0x8F
    at = np.flatnonzero(data == 0xE2)
    if len(at):
        third = np.r_[data[2:], np.zeros(2, np.uint8)][at]
        quotes = (after[at] == 0x80) & (((third >= 0x98) & (third <= 0x9D)) | (third == 0xA6))
        bad[at] |= ~(quotes | ((after[at] == 0x82) & (third == 0xAC)))
    for _ in range(2):
        at = np.flatnonzero(kind == _INHERIT)
        kind[at] = kind[at - 1]
    fits = np.diff(np.searchsorted(np.flatnonzero(bad), offs)) == 0

    start = head.copy()
    start[1:] |= kind[1:] != kind[:-1]
    # A blank before other text leaves its run; if it is a space it joins what follows.
    at = np.flatnonzero(start[1:] & (kind[1:] != _BLANK) & (kind[:-1] == _BLANK) & ~head[1:]) + 1
    start[at - 1] = True
    start[at] = data[at - 1] != 0x20
    # Contractions: an apostrophe that begins a pre-token, with certain letters after it.
    at = np.flatnonzero((data == 0x27) & start)
    at = at[(at + 1 < n)]
    at = at[(kind[at + 1] == _LETTER) & ~head[at + 1]]
    if len(at):
        third = np.where((at + 2 < n) & ~head[np.minimum(at + 2, n - 1)], data[np.minimum(at + 2, n - 1)], 0)
        one = np.isin(after[at], list(b"stmd"))
        two = ((after[at] == ord("r")) & (third == ord("e"))) | ((after[at] == ord("v")) & (third == ord("e"))) | ((after[at] == ord("l")) & (third == ord("l")))
        for q, size in ((at[one], 2), (at[two & ~one], 3)):
            start[q + 1] = False
            start[q[q + size < n] + size] = True
    return np.flatnonzero(start), fits


class Table:
    """Open-addressed table from the hash of a byte string to the string and a run of token ids."""

    def __init__(self):
        self.key = np.zeros(1 << _BITS, np.uint64)
        self.at = np.zeros(1 << _BITS, np.int32)
        self.n = np.zeros(1 << _BITS, np.int32)
        self.ids, self.used, self.entries = np.zeros(1 << 20, np.int32), 0, 0
        self.start = np.zeros(1 << _BITS, np.int32)
        self.size = np.zeros(1 << _BITS, np.int32)
        self.filled = 0
        self._room(1 << 22)

    def find(self, h: np.ndarray) -> np.ndarray:
        """The slot of each hash, or -1."""
        slot = (h >> np.uint64(64 - _BITS)).astype(np.int64)
        got = self.key[slot]
        left = np.flatnonzero((got != h) & (got != 0))
        slot[got == 0] = -1
        while len(left):
            slot[left] = (slot[left] + 1) & ((1 << _BITS) - 1)
            got = self.key[slot[left]]
            slot[left[got == 0]] = -1
            left = left[(got != h[left]) & (got != 0)]
        return slot

    def _room(self, size: int) -> None:
        """Makes room for ``size`` bytes of strings, which are read eight at a time."""
        padded = np.zeros(size + 8, np.uint8)
        if self.filled:
            padded[: self.filled] = self.bytes[: self.filled]
        self.bytes, self.loads = padded[:size], np.ndarray((size + 1,), "<u8", padded, strides=(1,))

    def holds(self, slot: np.ndarray, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Whether each found slot has the bytes that were looked up; true where nothing was found."""
        out = slot < 0
        at = np.flatnonzero(~out)
        size = ends[at] - starts[at]
        fits = self.size[slot[at]] == size
        at, size = at[fits], size[fits]
        out[at] = blocks.same_spans(data, starts[at], self.bytes, self.start[slot[at]], size, self.loads)
        return out

    def add(self, h: np.ndarray, strings: list[bytes], lists: list[list[int]]) -> None:
        """Distinct hashes that aren't in the table."""
        n = np.fromiter(map(len, lists), np.int64, len(lists))
        total = int(n.sum())
        if self.used + total > len(self.ids):
            self.ids = np.r_[self.ids, np.zeros(max(total, len(self.ids)), np.int32)]
        self.ids[self.used : self.used + total] = np.fromiter((i for x in lists for i in x), np.int32, total)
        at = self.used + np.cumsum(n) - n
        self.used += total
        self.entries += len(h)
        size = np.fromiter(map(len, strings), np.int64, len(strings))
        more = int(size.sum())
        if self.filled + more > len(self.bytes):
            self._room(max(self.filled + more, 2 * len(self.bytes)))
        self.bytes[self.filled : self.filled + more] = np.frombuffer(b"".join(strings), np.uint8)
        start = self.filled + np.cumsum(size) - size
        self.filled += more
        slot = (h >> np.uint64(64 - _BITS)).astype(np.int64)
        left = np.arange(len(h))
        while len(left):
            free = left[self.key[slot[left]] == 0]
            self.key[slot[free]] = h[free]
            won = free[self.key[slot[free]] == h[free]]
            self.at[slot[won]], self.n[slot[won]] = at[won], n[won]
            self.start[slot[won]], self.size[slot[won]] = start[won], size[won]
            left = left[self.key[slot[left]] != h[left]]
            slot[left] = (slot[left] + 1) & ((1 << _BITS) - 1)


class PreTokens:
    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        before = spec.get("pre_tokenizer") or {}
        self.library = Tokenizer.from_file(path)
        self.library.no_padding()
        self.library.no_truncation()
        self.vocabulary = self.library.get_vocab_size()
        self.special = [x["content"].encode() for x in spec.get("added_tokens", [])]
        self.by_bytes = spec["model"]["type"] == "BPE" and spec.get("normalizer") is None and before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space")
        self.proven = self._prove() if self.by_bytes else []
        self._fresh()

    def _prove(self) -> list[tuple[str, int]]:
        strings = self.library.decode_batch([[i] for i in range(self.vocabulary)], skip_special_tokens=False)
        raw = [s.encode() for s in strings]
        starts, fits = cut(np.frombuffer(b"".join(raw), np.uint8), np.r_[0, np.cumsum([len(r) for r in raw])])
        one = np.diff(np.searchsorted(starts, np.r_[0, np.cumsum([len(r) for r in raw])])) == 1
        able = [strings[i] for i in np.flatnonzero(fits & one) if raw[i] not in self.special]
        found = self.library.encode_batch_fast(able, add_special_tokens=False)
        return list({s: e.ids[0] for s, e in zip(able, found, strict=True) if len(e.ids) == 1}.items())

    def _fresh(self) -> None:
        self.table = Table()
        if self.proven:
            raw = [s.encode() for s, _ in self.proven]
            edge = np.r_[0, np.cumsum([len(r) for r in raw])]
            h, first = np.unique(_hash(np.frombuffer(b"".join(raw), np.uint8), edge[:-1], edge[1:]), return_index=True)
            self.table.add(h, [raw[i] for i in first], [[self.proven[i][1]] for i in first])

    def _slots(self, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Table slots of all pre-tokens, how many come before each row, and whether they hold for the row."""
        if self.table.entries > KEPT + len(self.proven) or self.table.filled > KEPT_BYTES:
            self._fresh()
        starts, fits = cut(data, offs)
        text = data.tobytes()
        for s in self.special:
            at = text.find(s)
            while at >= 0:
                fits[np.searchsorted(offs, at, side="right") - 1] = False
                at = text.find(s, at + 1)
        ends = np.r_[starts[1:], len(data)]
        before = np.searchsorted(starts, offs)
        h = _hash(data, starts, ends)
        slot = self.table.find(h)
        rest = np.flatnonzero((slot < 0) & np.repeat(fits, np.diff(before)))
        if len(rest):
            new, first = np.unique(h[rest], return_index=True)
            first = rest[first]
            strings = [text[a:b] for a, b in zip(starts[first].tolist(), ends[first].tolist(), strict=True)]
            self.table.add(new, strings, [e.ids for e in self.library.encode_batch_fast([s.decode() for s in strings], add_special_tokens=False)])
            slot[rest] = self.table.find(h[rest])
        wrong = np.flatnonzero(~self.table.holds(slot, data, starts, ends))
        if len(wrong):
            fits[np.searchsorted(offs, starts[wrong], side="right") - 1] = False
        return slot, before, fits

    def _whole(self, data: np.ndarray, offs: np.ndarray, rows: np.ndarray) -> list[list[int]]:
        strings = [data[offs[i] : offs[i + 1]].tobytes().decode() for i in rows]
        return [e.ids for e in self.library.encode_batch_fast(strings, add_special_tokens=False)]

    def count(self, data: np.ndarray, offs: np.ndarray) -> np.ndarray:
        """Tokens of each row of UTF-8 text."""
        if not len(data) or not self.by_bytes:
            return np.array([len(x) for x in self._whole(data, offs, np.arange(len(offs) - 1))], np.int64)
        slot, before, fits = self._slots(data, offs)
        total = np.r_[0, np.cumsum(np.where(slot < 0, 0, self.table.n[slot]))]
        out = total[before[1:]] - total[before[:-1]]
        odd = np.flatnonzero(~fits)
        out[odd] = [len(x) for x in self._whole(data, offs, odd)]
        return out

    def encode(self, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all rows one after the other, and how many each row has."""
        if not len(data) or not self.by_bytes:
            lists = self._whole(data, offs, np.arange(len(offs) - 1))
            return np.array([i for x in lists for i in x], np.int32), np.array([len(x) for x in lists], np.int64)
        slot, before, fits = self._slots(data, offs)
        n = np.where(slot < 0, 0, self.table.n[slot]).astype(np.int64)
        total = np.r_[0, np.cumsum(n)]
        ids = self.table.ids[np.repeat(self.table.at[slot] - total[:-1], n) + np.arange(total[-1])]
        edge = total[before]
        sizes = np.diff(edge)
        odd = np.flatnonzero(~fits)
        if len(odd):
            parts = [ids[a:b] for a, b in zip(edge[:-1], edge[1:], strict=True)]
            for i, x in zip(odd, self._whole(data, offs, odd), strict=True):
                parts[i], sizes[i] = np.array(x, np.int32), len(x)
            ids = np.concatenate(parts)
        return ids, sizes


def _hash(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return np.maximum(blocks.span_hash(data, starts, ends), np.uint64(1))


@functools.cache
def pretokens(path: str) -> PreTokens:
    return PreTokens(path)
