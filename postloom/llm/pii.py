"""Personal data: base patterns, and a skip-chain conditional random field for the rest.

Base spans come from fixed patterns and always stay. The field labels every word
with a digit or an at sign as other, email, ip, card or phone. Neighbouring such
words share chain potentials; words of one document that repeat or resemble each
other (equal digits, equal last seven digits, equal mailbox names) share skip
potentials, each occurrence being tied to the next one and to the first that a base
span holds, so edges stay linear in the words and certainty is at most one step away; mailboxes are nodes in spelled forms too, which need neither a digit nor an
at sign. Loopy sum-product message passing spreads what is certain at one
mention, such as a base span, to its abbreviated or reformatted repetitions.

Weights are trained on the driver by pseudo-likelihood on documents generated
from a fixed seed: repeated mentions in other forms are entities, the same forms
alone are not. Messages go round until they settle. Spans that the field adds never overlap base spans.
"""

from __future__ import annotations

import functools
import random
import re
from collections.abc import Iterator
from dataclasses import dataclass


import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import blocks
from .shared import map_batches, read

KINDS = ("email", "ip", "card", "phone")
LABELS = ("other", *KINDS)
#: Least marginal probability of an added span's words; how much a message may still change when it counts as settled;
#: damping; and a guard of rounds for messages that never settle, far beyond what evidence travels before it fades.
CERTAIN, SETTLED, DAMPING, ROUNDS = 0.8, 1e-4, 0.3, 2000

_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_CUE = re.compile(r"[0-9@]")
_NOT_DIGIT = re.compile(r"[^0-9]+")
_MAIL_LIKE = re.compile(r"([A-Za-z0-9._%+-]+)(?:@|\(at\)|\[at\])")
_HINTS = {
    "email": ("email", "e-mail", "mail", "correo", "courriel"),
    "ip": ("ip", "host", "server", "address"),
    "card": ("card", "visa", "karte", "carte", "tarjeta"),
    "phone": ("phone", "tel", "call", "telefon", "mobile", "fax"),
}
_HINT_OF = {w: k for k, ws in _HINTS.items() for w in ws}


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = 2 * d - 9 * (d > 4)
        total += d
    return total % 10 == 0


def _emails(text: str) -> list[tuple[int, int]]:
    out, end, at = [], 0, text.find("@")
    while at >= 0:
        a = at
        while a > end and text[a - 1] in _LOCAL:
            a -= 1
        m = _DOMAIN.match(text, at + 1) if a < at else None
        if m:
            out.append((a, m.end()))
            end = m.end()
        at = text.find("@", max(at + 1, end))
    return out


def _ips(text: str) -> list[tuple[int, int]]:
    out = []
    for m in _DOTTED.finditer(text):
        parts, at = m.group().split("."), m.start()
        for i in range(0, len(parts) - 3, 4):
            four = parts[i : i + 4]
            size = sum(map(len, four)) + 3
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in four):
                out.append((at, at + size))
            at += size + 1
    return out


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """``(start, kind number, end)`` of the base patterns, in order."""
    out = []
    if "@" in text:
        out += [(a, 0, b) for a, b in _emails(text)]
    out += [(a, 1, b) for a, b in _ips(text)]
    for m in _CARD.finditer(text):
        digits = _NOT_DIGIT.sub("", m.group())
        if 12 <= len(digits) <= 19 and luhn(digits):
            out.append((m.start(), 2, m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= len(_NOT_DIGIT.sub("", m.group())) <= 15:
                out.append((m.start(), 3, m.end()))
    return sorted(out)


@dataclass
class Nodes:
    """Cue words of one document: places, feature numbers, and the two kinds of edges as pairs of node numbers."""

    spans: list[tuple[int, int]]
    features: list[list[int]]
    chain: list[tuple[int, int]]
    skip: list[tuple[int, int]]


FEATURES = [
    "bias", "at", "at_dot", "spelled", "letters", "plus", "paren", "dash", "quad", "luhn", "digits_0", "digits_1", "digits_3", "digits_5", "digits_9", "digits_12", "digits_20",
    "long_tail", *(f"hint_{k}" for k in KINDS), *(f"base_{k}" for k in KINDS), "alone",
]
_F = {name: i for i, name in enumerate(FEATURES)}


def nodes(text: str, base: list[tuple[int, int, int]]) -> Nodes:
    out = Nodes([], [], [], [])
    seen: dict[str, list[int]] = {}
    certain: set[int] = set()
    before, last_word, k, word_no = "", -2, 0, 0
    for m in _WORD.finditer(text):
        word = m.group()
        spelled = _MAIL_LIKE.search(word)
        if not spelled and not _CUE.search(word):
            before, word_no = word, word_no + 1
            continue
        digits = _NOT_DIGIT.sub("", word)
        n = len(digits)
        has = ["bias", f"digits_{max(b for b in (0, 1, 3, 5, 9, 12, 20) if n >= b)}"]
        at = "@" in word
        if at:
            has.append("at_dot" if "." in word.rpartition("@")[2].rstrip(".,;") else "at")
        has += [name for name, yes in (("spelled", bool(spelled) and not at), ("letters", not at and any(c.isalpha() for c in word)), ("plus", word.startswith("+")), ("paren", word.startswith("(")), ("dash", "-" in word), ("luhn", 12 <= n <= 19 and luhn(digits)), ("long_tail", len(word) - n > 6 and not at)) if yes]
        parts = word.strip(".,;:").split(".")
        if len(parts) == 4 and all(p.isascii() and p.isdigit() and len(p) <= 3 and int(p) <= 255 for p in parts):
            has.append("quad")
        hint = _HINT_OF.get(before.lower().strip(".,;:()"))
        if hint:
            has.append(f"hint_{hint}")
        while k < len(base) and base[k][2] <= m.start():
            k += 1
        inside = {base[j][1] for j in range(k, min(k + 4, len(base))) if base[j][0] < m.end() and m.start() < base[j][2]}
        has += [f"base_{KINDS[i]}" for i in inside]
        if not inside and not hint:
            has.append("alone")
        i = len(out.spans)
        if word_no == last_word + 1:
            out.chain.append((i - 1, i))
        keys = []
        if n >= 5 and not at:
            keys.append("d" + digits)
        if n >= 7 and not at:
            keys.append("t" + digits[-7:])
        if spelled and len(spelled.group(1)) >= 3:
            keys.append("m" + spelled.group(1).lower())
        for x in keys:
            seen.setdefault(x, []).append(i)
        if inside:
            certain.add(i)
        out.spans.append((m.start(), m.end()))
        out.features.append([_F[x] for x in has])
        before, last_word, word_no = word, word_no, word_no + 1
    ties: set[tuple[int, int]] = set()
    for same in seen.values():
        ties.update(zip(same[:-1], same[1:], strict=True))
        hub = next((i for i in same if i in certain), same[0])
        ties.update((min(i, hub), max(i, hub)) for i in same if i != hub)
    out.skip = sorted(ties)
    return out


@dataclass
class Model:
    unary: np.ndarray
    chain: np.ndarray
    skip: np.ndarray


def marginals(score: np.ndarray, edges: np.ndarray, potential: np.ndarray) -> np.ndarray:
    """Label probabilities of nodes by loopy sum-product; ``potential[e]`` is the log-potential of edge ``e``."""
    n, size = score.shape
    if not len(edges):
        p = np.exp(score - score.max(1, keepdims=True))
        return p / p.sum(1, keepdims=True)
    src = np.r_[edges[:, 0], edges[:, 1]]
    dst = np.r_[edges[:, 1], edges[:, 0]]
    pot = np.exp(np.concatenate([potential, potential.transpose(0, 2, 1)]))
    back = np.r_[np.arange(len(edges)) + len(edges), np.arange(len(edges))]
    message = np.zeros((len(src), size))
    for _ in range(ROUNDS):
        total = score.copy()
        np.add.at(total, dst, message)
        out = total[src] - message[back]
        out = np.einsum("ei,eij->ej", np.exp(out - out.max(1, keepdims=True)), pot)
        out = DAMPING * message + (1 - DAMPING) * np.log(out / out.sum(1, keepdims=True))
        change, message = np.abs(out - message).max(), out
        if change < SETTLED:
            break
    total = score.copy()
    np.add.at(total, dst, message)
    p = np.exp(total - total.max(1, keepdims=True))
    return p / p.sum(1, keepdims=True)


def _matrix(features: list[list[int]]) -> np.ndarray:
    x = np.zeros((len(features), len(FEATURES)))
    for i, f in enumerate(features):
        x[i, f] = 1
    return x


def _generated(rng: random.Random) -> tuple[str, list[tuple[int, int, int]]]:
    """A text with mentions, their repetitions in other forms, and the same forms of nothing."""
    filler = ["the", "of", "la", "und", "que", "ertion", "word", "text,", "more.", "de"]
    digit = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    parts: list[tuple[str, int]] = []
    name = "".join(rng.choice("abcdefghijk") for _ in range(6)) + "." + (digit(2) if rng.random() < 0.5 else rng.choice(["doe", "roe", "smith", "weber"]))
    phone = (digit(3), "555", digit(4))
    body = "4" + digit(14)
    card = next(body + c for c in "0123456789" if luhn(body + c))
    quad = ".".join(str(rng.randint(1, 255)) for _ in range(4))
    real = {
        1: [f"{name}@mail{rng.randint(0, 9)}.example.com", f"{name}@mail", f"{name}(at)mail.example.com", f"{name}(at)mail"],
        2: [quad, f"[{quad}]"],
        3: [card, card[:4] + "." + card[4:8] + "." + card[8:12] + "." + card[12:], f"{card[:8]}/{card[8:]}"],
        4: [f"+1 ({phone[0]}) {phone[1]}-{phone[2]}", f"{phone[1]}-{phone[2]}", f"({phone[0]}){phone[1]}{phone[2]}", "".join(phone), "".join(phone[1:])],
    }
    for label, forms in real.items():
        if rng.random() < 0.6:
            parts.append((forms[0], label))
            parts += [(rng.choice(forms), label) for _ in range(rng.randint(0, 3))]
    alone = [digit(1), digit(4), digit(7), digit(10), digit(12), f"{digit(3)}-{digit(4)}", f"{digit(4)}.{digit(4)}.{digit(4)}.{digit(4)}", f"v{digit(2)}", f"{digit(2)}.{digit(2)}.{digit(2)}", f"user{digit(2)}@host", "someone(at)host", f"{digit(2)}%", digit(24), f"id{digit(8)}", f"({digit(4)})"]
    parts += [(rng.choice(alone), 0) for _ in range(rng.randint(1, 8))]
    rng.shuffle(parts)
    text, spans = "", []
    for word, label in parts:
        text += "".join(rng.choice(filler) + " " for _ in range(rng.randint(1, 6)))
        spans.append((len(text), label, len(text) + len(word)))
        text += word + rng.choice([" ", " ", ". ", ", "])
    return text, spans


@functools.cache
def train(documents: int = 500, seed: int = 11, steps: int = 400) -> Model:
    """Pseudo-likelihood weights: every node's label given its features and the true labels of its neighbours."""
    rng = random.Random(seed)
    features, gold, chain, skip = [], [], [], []
    for _ in range(documents):
        text, spans = _generated(rng)
        got = nodes(text, base_spans(text))
        shift = len(gold)
        features += got.features
        gold += [next((label for a, label, b in spans if a < e and s < b), 0) for s, e in got.spans]
        chain += [(i + shift, j + shift) for i, j in got.chain]
        skip += [(i + shift, j + shift) for i, j in got.skip]
    size = len(LABELS)
    x, y = _matrix(features), np.eye(size)[gold]
    c, s = np.array(chain).reshape(-1, 2), np.array(skip).reshape(-1, 2)
    w, a, b = np.zeros((len(FEATURES), size)), np.zeros((size, size)), np.zeros((size, size))
    rate = 4.0 / len(y)
    for _ in range(steps):
        score = x @ w
        for pairs, m in ((c, a), (s, b)):
            np.add.at(score, pairs[:, 1], m[np.array(gold)[pairs[:, 0]]])
            np.add.at(score, pairs[:, 0], m.T[np.array(gold)[pairs[:, 1]]])
        p = np.exp(score - score.max(1, keepdims=True))
        miss = y - p / p.sum(1, keepdims=True)
        grads = []
        for pairs in (c, s):
            grads.append(y[pairs[:, 0]].T @ miss[pairs[:, 1]] + miss[pairs[:, 0]].T @ y[pairs[:, 1]])
        w += rate * (x.T @ miss - 0.02 * w)
        a += rate * (grads[0] - 0.02 * a)
        b += rate * ((grads[1] + grads[1].T) / 2 - 0.02 * b)
    return Model(w, a, b)


def added_spans(texts: list[str], bases: list[list[tuple[int, int, int]]], model: Model) -> list[list[tuple[int, int, int]]]:
    """What the field adds to each text's base spans, as ``(start, kind number, end)``."""
    all_nodes = [nodes(t, b) for t, b in zip(texts, bases, strict=True)]
    features = [f for x in all_nodes for f in x.features]
    if not features:
        return [[] for _ in texts]
    shift = np.cumsum([0, *(len(x.spans) for x in all_nodes)])
    edges = [(i + k, j + k) for x, k in zip(all_nodes, shift, strict=False) for i, j in [*x.chain, *x.skip]]
    kinds = [m for x in all_nodes for m in [0] * len(x.chain) + [1] * len(x.skip)]
    potential = np.stack([model.chain, model.skip])[kinds] if edges else np.zeros((0, len(LABELS), len(LABELS)))
    p = marginals(_matrix(features) @ model.unary, np.array(edges, np.int64).reshape(-1, 2), potential)
    best, sure = p.argmax(1), p.max(1) >= CERTAIN
    out = []
    for text, base, x, k in zip(texts, bases, all_nodes, shift, strict=False):
        found: list[list[int]] = []
        for i, (a, b) in enumerate(x.spans):
            if best[k + i] and sure[k + i]:
                while b > a + 1 and text[b - 1] in ".,;:!?)]\"'":
                    b -= 1
                while a < b - 1 and text[a] in "([\"'":
                    a += 1
                kind = int(best[k + i]) - 1
                if found and found[-1][1] == kind and not text[found[-1][2] : a].strip(" ()-") and a - found[-1][2] <= 3:
                    found[-1][2] = b
                else:
                    found.append([a, kind, b])
        out.append([tuple(f) for f in found if not any(s < f[2] and f[0] < e for s, _, e in base)])
    return out


def _joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in sorted(spans))


def find(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """``(doc_id, n_email, n_ip, n_card, n_phone, base, spans)`` for every row of ``docs``; spans as ``kind:start:end`` in code points.

    A null or empty text has none, repeated rows repeat, and other columns are ignored.
    """
    model = model or train()
    names = ["doc_id", *(f"n_{k}" for k in KINDS), "base", "spans"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cue = np.zeros(256, bool)
        cue[[*b"0123456789@"]] = True
        for batch in batches:
            raw, offs = blocks.texts(batch.column(1))
            for lo, hi in blocks.slices(offs):
                part = raw[offs[lo] : offs[hi]]
                rows = hi - lo
                some = np.flatnonzero(np.diff(np.searchsorted(np.flatnonzero(cue[part]), offs[lo : hi + 1] - offs[lo])))
                texts = [part[offs[lo + i] - offs[lo] : offs[lo + i + 1] - offs[lo]].tobytes().decode() for i in some]
                bases = [base_spans(t) for t in texts]
                counts = np.zeros((rows, len(KINDS)), np.int64)
                base, spans = [""] * rows, [""] * rows
                for i, b, more in zip(some, bases, added_spans(texts, bases, model), strict=True):
                    for _, k, _ in b:
                        counts[i, k] += 1
                    base[i], spans[i] = _joined(b), _joined([*b, *more])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, rows), *(pa.array(counts[:, k]) for k in range(len(KINDS))), pa.array(base, pa.string()), pa.array(spans, pa.string())], names)

    return map_batches(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), run, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base string, spans string")


def op2_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = find(read(spark, sf_dir, "documents"))
    return got.select("doc_id", *(f"n_{k}" for k in KINDS), F.sha2("base", 256).alias("base_sha256"), "spans")
