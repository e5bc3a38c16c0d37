"""Messages as lines for reading, as HTML, and as previews of search results."""

from __future__ import annotations

import re
import textwrap
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import html_escape

ESSENTIAL = ("from", "newsgroups", "subject", "date", "to")
LEVEL_MOST, CONTEXT = 5, 2
_QUOTE = re.compile(r"^(?:[A-Za-z]{1,4}(?=>))?(?:(?::(?!\)|-\)))|[>|]|[ \t])*")
_URL = re.compile(r"(?:[A-Za-z]{3,}://|news:)[^\s<>\"]+")
_DECO = (("bold", re.compile(r"(?<!\w)\*\w[^*\n]*\*(?!\w)")), ("underline", re.compile(r"(?<!\w)_\w[^_\n]*_(?!\w)")), ("italic", re.compile(r"(?<![\w/])/\w[^/\n]*/(?![\w/])")))

LINES = "idx long, line int, kind string, level int, text string, urls array<string>, decorations array<string>"


def rendered_lines(raw: str, width: int, all_headers: bool) -> list[tuple]:
    """``(kind, level, text, urls, decorations)``: headers, then body lines by quotation level, wrapped; then the signature."""
    head, _, body = raw.partition("\n\n")
    out = []
    for line in head.split("\n"):
        name = line.partition(":")[0].lower()
        if all_headers or name in ESSENTIAL:
            out.append(("header", 0, line, [], []))
    signature = False
    for line in body.lstrip("\n").split("\n"):
        signature |= line == "-- "
        mark = _QUOTE.match(line).group()
        level = 0 if signature else min(LEVEL_MOST, sum(c in ":>|" for c in mark))
        for part in textwrap.wrap(line, width, drop_whitespace=False, replace_whitespace=False) or [""]:
            urls = [u.rstrip(".,;:()") for u in _URL.findall(part)]
            out.append(("signature" if signature else "body", level, part, [u for u in urls if len(u) >= 6], [n for n, p in _DECO if p.search(part)]))
    return out


def lines(raw: DataFrame, width: int = 80, all_headers: bool = False) -> DataFrame:
    """Rendered lines of ``raw(idx, raw)``."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [x.split()[0] for x in LINES.split(", ")]
        for b in batches:
            rows = [(i, n, *x) for i, r in zip(b["idx"], b["raw"], strict=True) for n, x in enumerate(rendered_lines(r or "", width, all_headers))]
            yield pd.DataFrame(rows, columns=names)

    return raw.select("idx", "raw").mapInPandas(run, LINES)


def html(messages: DataFrame) -> DataFrame:
    """``(idx, html)``: a message as a page of its own."""
    row = lambda name, c: F.concat(F.lit(f"<tr><th>{name}</th><td>"), html_escape(F.coalesce(c, F.lit(""))), F.lit("</td></tr>"))
    page = F.concat(F.lit("<table>"), row("From", F.col("author")), row("Subject", F.col("subject")), row("Date", F.date_format(F.timestamp_seconds("epoch"), "yyyy-MM-dd HH:mm:ss xx")), F.lit("</table><pre>"), html_escape(F.coalesce("body", F.lit(""))), F.lit("</pre>"))
    return messages.select("idx", page.alias("html"))


def previews(messages: DataFrame, words: list[str]) -> DataFrame:
    """``(idx, preview)``: lines with any of the words and two around each, gaps marked; the first lines if there is none.

    The signature is left out.
    """
    body = F.split(F.regexp_replace(F.coalesce("body", F.lit("")), r"(?s)(^|\n)-- \n.*$", ""), "\n")
    pattern = "|".join(re.escape(w) for w in words) or "(?!)"
    rows = messages.select("idx", body.alias("l"))

    def near(i: Column) -> Column:
        around = F.slice("l", F.greatest(i - CONTEXT, F.lit(0)) + 1, F.least(i, F.lit(CONTEXT)) + CONTEXT + 1)
        return F.exists(around, lambda x: F.lower(x).rlike(pattern))

    index = F.sequence(F.lit(0), F.size("l") - 1)
    shown = F.filter(index, near)
    text = F.aggregate(shown, F.struct(F.lit(-1).alias("last"), F.lit("").alias("out")), lambda s, i: F.struct(i.alias("last"), F.concat(s["out"], F.when((s["last"] >= 0) & (i > s["last"] + 1), " -*- \n").otherwise(""), F.get("l", i), F.lit("\n")).alias("out")), lambda s: s["out"])
    first = F.array_join(F.slice("l", 1, CONTEXT + 1), "\n")
    return rows.select("idx", F.when(F.size(shown) > 0, F.rtrim(text, F.lit("\n"))).otherwise(first).alias("preview"))
