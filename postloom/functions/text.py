"""Scalar text functions as column expressions; all run inside the JVM."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Reply prefixes that a subject loses.
REPLY_PREFIXES = ("re:", "odp:", "re[2]:", "re[3]:", "re[4]:", "re[5]:", "re[6]:", "re[7]:", "re[8]:", "re[9]:", "sv:", "aw:", "vs:")
#: Fixed value: a word of the index in ASCII text.
ASCII_WORD = r"(?:[A-Za-z]+(?:[:.'][A-Za-z]+)*|[0-9]+(?:[,.';][0-9]+)*)(?:[A-Za-z]+(?:[:.'][A-Za-z]+)*|[0-9]+(?:[,.';][0-9]+)*|_)*"
#: The same with all letters and numbers.
UNICODE_WORD = r"(?:\p{L}+(?:[:.']\p{L}+)*|\p{N}+(?:[,.';]\p{N}+)*)(?:\p{L}+(?:[:.']\p{L}+)*|\p{N}+(?:[,.';]\p{N}+)*|_)*"
WORD_LEAST, WORD_MOST = 3, 13
#: Two-byte characters read in the wrong code page, and what they stand for.
MOJIBAKE = (
    ("\u00a1", "Ą"), ("\u00a5", "Ą"), ("\u00c6", "Ć"), ("\u00ca", "Ę"), ("\u00a3", "Ł"), ("\u00d1", "Ń"), ("\u00a6", "Ś"), ("\u008c", "Ś"),
    ("\u00ac", "Ź"), ("\u008f", "Ź"), ("\u00af", "Ż"), ("\u00b1", "ą"), ("\u00b9", "ą"), ("\u00e6", "ć"), ("\u00ea", "ę"), ("\u00b3", "ł"),
    ("\u00f1", "ń"), ("\u00b6", "ś"), ("\u009c", "ś"), ("\u00bc", "ź"), ("\u009f", "ź"), ("\u00bf", "ż"),
)

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def kill_pattern(prefixes: Sequence[str] = REPLY_PREFIXES) -> str:
    return r"(?i)^(?: *(?:" + "|".join(re.sub(r"([][.*+?(){}|^$\\])", r"\\\1", p) for p in prefixes) + "))* *"


def subject_kill(subject: Column, prefixes: Sequence[str] = REPLY_PREFIXES) -> Column:
    """The subject without leading reply prefixes and spaces."""
    return F.regexp_replace(subject, kill_pattern(prefixes), "")


def without_blanks(s: Column) -> Column:
    return F.translate(s, " \t", "")


def same_subject(a: Column, b: Column) -> Column:
    """Equal once prefixes are gone, or else once blanks are gone too."""
    a, b = subject_kill(a), subject_kill(b)
    return (a == b) | (without_blanks(a) == without_blanks(b))


def rot13(s: Column) -> Column:
    turned = _UPPER[13:] + _UPPER[:13] + _LOWER[13:] + _LOWER[:13]
    return F.translate(s, _UPPER + _LOWER, turned)


def html_escape(s: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        s = F.replace(s, F.lit(a), F.lit(b))
    return s


def uri_encode(s: Column) -> Column:
    """Protects the percent sign, the one character that the archive's addresses escape."""
    return F.replace(s, F.lit("%"), F.lit("%25"))


def uri_decode(s: Column, compat: bool = False) -> Column:
    """Undoes ``uri_encode`` and other percent codes; ``compat`` turns every code into a percent sign."""
    return F.regexp_replace(s, "%..", "%") if compat else F.try_url_decode(F.replace(s, F.lit("+"), F.lit("%2B")))


def find_urls(s: Column) -> Column:
    """Addresses with a scheme of three letters or more, or ``news:``; trailing punctuation is not part of them."""
    found = F.regexp_extract_all(s, F.lit(r"((?:[A-Za-z]{3,}://|news:)[^\s<>\"]+)"), F.lit(1))
    return F.filter(F.transform(found, lambda u: F.regexp_replace(u, r"[.,;:()]+$", "")), lambda u: F.length(u) >= 6)


def char_prefix(s: Column, n: int) -> Column:
    return F.left(s, F.lit(n))


def is_alpha(c: Column) -> Column:
    return c.rlike(r"^\p{L}+$")


def is_alnum(c: Column) -> Column:
    return c.rlike(r"^[\p{L}\p{N}]+$")


def is_punct(c: Column) -> Column:
    return c.rlike(r"^\p{P}+$")


def fix_mojibake(s: Column) -> Column:
    return F.translate(s, "".join(a for a, _ in MOJIBAKE), "".join(b for _, b in MOJIBAKE))


def tokens(s: Column, unicode: bool = False) -> Column:
    """Index words in order: lower case, trailing underscores trimmed, of 3 to 13 characters."""
    found = F.regexp_extract_all(F.lower(s), F.lit(UNICODE_WORD if unicode else ASCII_WORD), F.lit(0))
    trimmed = F.transform(found, lambda w: F.rtrim(w, F.lit("_")))
    return F.filter(trimmed, lambda w: F.length(w).between(WORD_LEAST, WORD_MOST))


#: The run of quote marks and blanks that opens a quoted line; smileys are not quotes.
QUOTE_PREFIX = r"^((?:[A-Za-z]{1,4}(?=>))?(?:(?::(?!\)|-\)))|[>|]|[ \t])*)"


def quote_level(line: Column) -> Column:
    """How many quote marks a line starts with."""
    return F.length(F.regexp_replace(F.regexp_extract(line, QUOTE_PREFIX, 1), r"[^:>|]", ""))


def unquoted(line: Column) -> Column:
    return F.regexp_replace(line, QUOTE_PREFIX, "")


def code_point_signature(word: Column) -> Column:
    """A bit for each code point modulo 63, to compare words before measuring their distance."""
    bits = F.transform(F.filter(F.split(word, ""), lambda c: c != ""), lambda c: F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(F.ascii(c), F.lit(63))))
    return F.aggregate(bits, F.lit(0).cast("long"), lambda s, b: s.bitwiseOR(b))


def char_grams(s: Column, n: int) -> Column:
    """All runs of ``n`` characters, one for each place, in one pass over the text."""
    return F.regexp_extract_all(s, F.lit(rf"(?s)(?=([^\p{{Cs}}]{{{n}}}))"), F.lit(1))


def logistic(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def clamp(x: Column, low: Column, high: Column) -> Column:
    return F.greatest(low, F.least(x, high))


def is_msgid(s: Column) -> Column:
    """Printable ASCII without angle brackets, one at sign, something on both sides."""
    return F.coalesce(s.rlike(r"^[ -;=?A-~]+@[ -;=?A-~]+$"), F.lit(False))
