"""Messages in one encoding: header words decoded, the readable part chosen, charsets guessed."""

from __future__ import annotations

import email
import email.header
import email.policy
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

from ..functions.text import MOJIBAKE

#: What is counted to tell three code pages apart, how much each letter counts, and the order in a tie.
CHARSETS = ("iso8859-2", "cp1250", "cp852")
LETTERS = "ĄĆĘŁŃÓŚŹŻąćęłńóśźż"
WEIGHTS = (1, 1, 1, 1, 1, 1, 1, 1, 1, 15, 10, 16, 19, 1, 13, 13, 1, 18)
_FIX = str.maketrans({a: b for a, b in MOJIBAKE})
_TAG = re.compile(r"<[^>]*>")


def guess(raw: bytes) -> str:
    """The text of bytes that declare no charset: UTF-8 if valid, else the code page whose letters of the language weigh most."""
    try:
        return raw.decode("utf-8")
    except UnicodeDecodeError:
        texts = [raw.decode(c, errors="replace") for c in CHARSETS]
        return max(texts, key=lambda t: sum(w * t.count(x) for x, w in zip(LETTERS, WEIGHTS, strict=True)))


def _decoded(part: email.message.Message) -> str:
    raw = part.get_payload(decode=True) or b""
    charset = part.get_content_charset()
    if charset and charset not in ("utf-8", "utf8"):
        try:
            return raw.decode(charset)
        except (LookupError, UnicodeDecodeError):
            pass
    return guess(raw)


def readable(raw: bytes) -> str:
    """A message with decoded headers and the body of its first plain part, else of its last HTML part, else as it is."""
    head, _, rest = raw.partition(b"\n\n")
    lines = []
    for line in guess(head).split("\n"):
        try:
            got = str(email.header.make_header(email.header.decode_header(line))) if "=?" in line else line
        except (LookupError, UnicodeDecodeError, ValueError, email.errors.HeaderParseError):
            got = line
        lines.append(got.translate(_FIX) if got == line and not line.isascii() else got)
    message = email.message_from_bytes(raw, policy=email.policy.compat32)
    parts = [p for p in message.walk() if not p.is_multipart()]
    plain = next((p for p in parts if p.get_content_type() == "text/plain"), None)
    pages = [p for p in parts if p.get_content_type() == "text/html"]
    text = _decoded(plain) if plain is not None else _TAG.sub("", _decoded(pages[-1])) if pages else guess(rest)
    return "\n".join(lines) + "\n\n" + text


def to_utf8(raw: DataFrame) -> DataFrame:
    """``raw(idx, content)`` with binary content as ``(idx, raw)``; null content gives an empty message."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"idx": b["idx"], "raw": [readable(bytes(c)) if c is not None else "" for c in b["content"]]})

    return raw.select("idx", "content").mapInPandas(run, "idx long, raw string")
