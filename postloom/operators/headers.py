"""From raw message texts to message columns; native but for dates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.dates import parse_date_column
from ..functions.text import is_msgid


def head(raw: Column) -> Column:
    return F.substring_index(raw, "\n\n", 1)


def body(raw: Column) -> Column:
    """What follows the first empty line, without the newlines it starts with."""
    at = F.instr(raw, "\n\n")
    return F.when(at > 0, F.regexp_replace(F.substring(raw, at + 2, F.length(raw)), r"^\n+", "")).otherwise("")


def header(raw: Column, name: str) -> Column:
    """The value of the first line of the header block that starts with ``name: ``, or null."""
    pattern = f"(?im)^{name}: (.*)$"
    return F.when(head(raw).rlike(pattern), F.regexp_extract(head(raw), pattern, 1))


def message_id(raw: Column) -> Column:
    """The id between angle brackets of its header, or one made from the text where that isn't valid."""
    pattern = r"(?im)^message-id:[ \t](.*)$"
    value = F.regexp_extract(head(raw), pattern, 1)
    inner = F.when(F.instr(value, "<") > 0, F.regexp_extract(value, r"<([^>]*)", 1)).otherwise(value)
    made = F.concat(F.lit("made."), F.hex(F.xxhash64(raw)), F.lit("@archive.invalid"))
    return F.when(is_msgid(inner), inner).otherwise(made)


def references(raw: Column) -> Column:
    """Reference ids in header order. The list is read from its end and stops at what is no id in brackets."""
    value = F.coalesce(header(raw, "references"), header(raw, "in-reply-to"), F.lit(""))
    tail = F.regexp_extract(value, r"((?:<[^<>]*>[^<>]*)*)$", 1)
    return F.transform(F.regexp_extract_all(tail, F.lit("<([^<>]*)>"), F.lit(1)), lambda x: F.translate(x, " \t", ""))


def subject(raw: Column) -> Column:
    value = header(raw, "subject")
    return F.when(value.isNull() | (value == ""), F.lit("(no subject)")).otherwise(value)


def real_name(author: Column) -> Column:
    """The name in ``Name <address>`` or ``address (Name)``, quotes and escapes removed; else the address."""
    route = F.trim(F.regexp_extract(author, r"^(.*?)\s*<[^>]*>\s*$", 1))
    old = F.regexp_extract(author, r"^\s*\S+\s+\((.*)\)\s*$", 1)
    name = F.when(route != "", route).when(old != "", old)
    name = F.regexp_replace(F.regexp_replace(name, r'^"(.*)"$', "$1"), r'\\(["()\\])', "$1")
    address = F.regexp_extract(author, r"<([^>]*)>", 1)
    return F.coalesce(name, F.when(address != "", address).otherwise(F.trim(author)))


def messages(raw: DataFrame) -> DataFrame:
    """``raw(idx, raw)`` as messages, with ``realname``, ``xref``, ``size`` and ``date_status``."""
    r = F.col("raw")
    out = raw.select("idx", message_id(r).alias("msgid"), references(r).alias("refs"), parse_date_column(head(r)).alias("d"), F.coalesce(header(r, "from"), F.lit("")).alias("author"), subject(r).alias("subject"), header(r, "newsgroups").alias("newsgroups"), body(r).alias("body"), header(r, "xref").alias("xref"), F.octet_length(r).alias("size"))
    return out.select("idx", "msgid", "refs", F.col("d.epoch").alias("epoch"), "author", real_name(F.col("author")).alias("realname"), "subject", "newsgroups", "body", "xref", "size", F.col("d.status").alias("date_status"))
