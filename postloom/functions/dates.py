"""Dates of messages: a lax reading of the date header, held against what servers noted.

The grammar is too loose for the JVM's parsers, so it runs on Arrow batches of the
header block alone.
"""

from __future__ import annotations

import calendar
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

WEEK = 7 * 86400
_MONTHS = ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december")
#: Hours east of Greenwich of zone names.
ZONES = {
    "UT": 0, "GMT": 0, "EDT": -4, "EST": -5, "CDT": -5, "CST": -6, "MDT": -6, "MST": -7, "PDT": -7, "PST": -8, "UTC": 0, "CUT": 0, "WET": 0, "BST": 1, "ADT": -3, "AST": -4, "YDT": -8, "YST": -9,
    "AKDT": -8, "AKST": -9, "HADT": -9, "HAST": -10, "HST": -10, "CES": 2, "CEST": 2, "MEZ": 1, "MEZT": 2, "CET": 1, "MET": 1, "EET": 2, "MSK": 3, "MSD": 4, "WAST": 8, "WADT": 9, "HKT": 8, "CCT": 8,
    "JST": 9, "KST": 9, "KDT": 9, "EAST": 10, "EADT": 11, "NZST": 12,
}
_DATE = re.compile(r"[^0-9,]*,?\s*(\d{1,2})\s+([A-Za-z]+)\.?\s+(\d{2,4})\s+(\d{1,2}):(\d{1,2})(?::(\d{1,2}))?(.*)", re.DOTALL)
_DASHED = re.compile(r"(\d{1,2})-([A-Za-z]+\.?)-(\d{2,4})")
_NUMERIC = re.compile(r"(\d{4})/(\d{1,2})/(\d{1,2})")
_COMMENT = re.compile(r"\([^()]*\)")
_ZONE = re.compile(r"([+-])(\d{1,5})|([A-Za-z]+)")
_SERVER = re.compile(r"^(received|nntp-posting-date|injection-date):[ \t](.*)$", re.IGNORECASE | re.MULTILINE)
_HEADER = re.compile(r"^date:[ \t](.*)$", re.IGNORECASE | re.MULTILINE)


def _epoch(year: int, month: int, day: int, hour: int = 0, minute: int = 0, second: int = 0) -> int | None:
    if not (1 <= month <= 12 and 1 <= day <= calendar.monthrange(max(year, 1), month)[1] and hour < 24 and minute < 60 and second <= 60 and year >= 1970):
        return None
    return calendar.timegm((year, month, day, hour, minute, second))


def parse_lax(value: str) -> int | None:
    """Epoch seconds of one date; without a zone it counts as UTC, the last of several zones wins."""
    m = _DATE.match(_COMMENT.sub(" ", value))
    if not m:
        return None
    name = m[2].lower()
    month = next((i + 1 for i, full in enumerate(_MONTHS) if name in (full, full[:3])), 0)
    year = int(m[3])
    if len(m[3]) < 4:
        year += 2000 if year < 50 else 1900
    at = _epoch(year, month, int(m[1]), int(m[4]), int(m[5]), int(m[6] or 0))
    if at is None:
        return None
    offset = 0
    for sign, digits, zone in _ZONE.findall(m[7]):
        if digits:
            n = int(digits)
            seconds = n * 3600 if len(digits) < 3 else (n // 100 * 60 + n % 100) * 60
            offset = seconds if sign == "+" else -seconds
        else:
            offset = ZONES.get(zone.upper(), 0) * 3600
    return at - offset


def consensus(epochs: list[int]) -> int | None:
    """The first value of the largest group; a group holds what lies within a week of its first value, the earliest wins a tie."""
    groups: list[list[int]] = []
    for e in sorted(epochs):
        if groups and e - groups[-1][0] <= WEEK:
            groups[-1].append(e)
        else:
            groups.append([e])
    return max(groups, key=len)[0] if groups else None


def parse_date(head: str, compat: bool = False) -> tuple[int, str]:
    """``(epoch, status)`` of a header block: ``ok``, ``recovered`` from servers or a loose form, ``time_travel``, or ``bad`` with 0.

    ``compat`` blanks every dash of the date, negative zones included.
    """
    found = []
    for name, value in _SERVER.findall(head):
        got = parse_lax(value.rpartition(";")[2] if name.lower() == "received" else value)
        if got is not None:
            found.append(got)
    server = consensus(found)
    m = _HEADER.search(head)
    value = m[1] if m else ""
    own = parse_lax(value.replace("-", " ") if compat else _DASHED.sub(r"\1 \2 \3", value))
    if own is None:
        if server is not None:
            return server, "recovered"
        loose = _NUMERIC.search(value)
        at = _epoch(int(loose[1]), int(loose[2]), int(loose[3])) if loose else None
        return (at, "recovered") if at is not None else (0, "bad")
    if server is not None and abs(own - server) > WEEK:
        return server, "time_travel"
    return own, "ok"


def _parse(heads: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([parse_date(h or "") for h in heads], columns=["epoch", "status"])


def parse_date_column(head: Column) -> Column:
    """``struct(epoch, status)`` of a header block."""
    return F.pandas_udf(_parse, "epoch long, status string")(head)


def month(epoch: Column) -> Column:
    return F.date_format(F.timestamp_seconds(epoch), "yyyy-MM")


def minute(epoch: Column) -> Column:
    return F.date_format(F.timestamp_seconds(epoch), "yyyy-MM-dd HH:mm")


def full(epoch: Column) -> Column:
    return F.date_format(F.timestamp_seconds(epoch), "yyyy-MM-dd HH:mm:ss xx")


def asctime(epoch: Column) -> Column:
    t = F.timestamp_seconds(epoch)
    return F.concat_ws(" ", F.date_format(t, "E MMM"), F.lpad(F.dayofmonth(t).cast("string"), 2, " "), F.date_format(t, "HH:mm:ss yyyy"))
