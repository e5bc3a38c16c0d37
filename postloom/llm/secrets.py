"""Secret scan: base patterns and a randomness test battery, in DataFrame operations only.

Every run of ``LEAST`` or more token characters gets the smallest alphabet that
holds it (its inferred encoding) and three tests of the hypothesis that its
characters are drawn at random from it: chi-squared uniformity, runs above and
below the middle of the alphabet, and serial correlation at lag one. Statistics
are standardised by their exact mean and variance at the token's length; the least
p-value of the three, times three, is the token's.

A random token passes such tests and an ordinary one fails them, so the hypothesis to
reject is that a token is ordinary: ``ORDINARY`` has, by length and encoding, the share
of ordinary tokens whose p-value is at least a given one, and that share is the token's
own p-value against being ordinary. Benjamini-Hochberg holds the share of false reports
below ``RATE`` within each band of lengths of each document. The table is constant and a
document is judged by itself, so a token is judged alike in any corpus. Runs of letters
alone are never reported and count in no band.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import read

#: The base patterns.
ASSIGN = r"((?i:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"
KINDS = ("assign", "access", "hex", "random")
#: Least length of a token, and the share of false reports.
LEAST, RATE = 20, 0.03
TOKEN = rf"[A-Za-z0-9+/_=-]{{{LEAST},}}"
#: Least lengths of the bands, and steps of the battery's p-value.
BANDS = (20, 24, 32, 40, 48, 64)
STEPS = (0.001, 0.003, 0.01, 0.03, 0.1, 0.3, 1.0)
#: For each band, the share of ordinary tokens of its least length that reach each step, for alphabets of one
#: case with digits and for all others. Ordinary tokens are common words of four languages, joined in the forms that programs
#: and addresses give them (with digits or a year, capitals, separators), 4,000 of each form; the worst form counts, and no
#: share is less than one in 4,000.
ONE_CASE = (
    (0.8642, 0.8615, 0.7903, 0.7093, 0.5720, 0.3805, 0.0710),
    (0.7760, 0.7465, 0.6737, 0.5753, 0.3563, 0.2127, 0.0200),
    (0.5098, 0.4047, 0.3043, 0.2357, 0.1230, 0.0457, 0.0032),
    (0.2137, 0.1610, 0.1085, 0.0585, 0.0238, 0.0035, 0.00025),
    (0.0500, 0.0400, 0.0190, 0.0077, 0.0018, 0.00025, 0.00025),
    (0.0008, 0.00025, 0.00025, 0.00025, 0.00025, 0.00025, 0.00025),
)
MIXED = (
    (0.6542, 0.6312, 0.4858, 0.4333, 0.2347, 0.0915, 0.0015),
    (0.5248, 0.3982, 0.3498, 0.2185, 0.0707, 0.0227, 0.00025),
    (0.1930, 0.1270, 0.0715, 0.0262, 0.0095, 0.0005, 0.00025),
    (0.0267, 0.0143, 0.0053, 0.0010, 0.00025, 0.00025, 0.00025),
    (0.0022, 0.0005, 0.00025, 0.00025, 0.00025, 0.00025, 0.00025),
    (0.00025, 0.00025, 0.00025, 0.00025, 0.00025, 0.00025, 0.00025),
)
#: Entries that are taken one by one before sums go on from part to part.
_PART = 64
_SPANS = "array<struct<a:int,b:int,m:string>>"

_UPPER, _LOWER, _DIGITS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789"


def _let(value: Column, then) -> Column:
    """``then(value)`` with the value worked out once."""
    return F.element_at(F.transform(F.array(value), then), 1)


def _parts(values: Column) -> Column:
    """The array ``values``, which is at hand already, in parts of ``_PART`` entries."""
    last = F.floor((F.greatest(F.size(values), F.lit(1)) - 1) / _PART).cast("int")
    return F.transform(F.sequence(F.lit(0), last), lambda i: F.slice(values, i * _PART + 1, F.lit(_PART)))


def _before(values: Column, merge) -> Column:
    """For each entry of an array of integers, ``merge`` of all entries before it, zero for the first.

    Arrays grow by copying, so parts are taken one by one, and then their entries: time grows as if
    linear up to some hundred thousand entries.
    """

    def one_by_one(v: Column, at: Column) -> Column:
        start = F.struct(at.alias("at"), F.expr("cast(array() as array<int>)").alias("out"))
        return F.aggregate(v, start, lambda s, x: F.struct(merge(s["at"], x).alias("at"), F.concat(s["out"], F.array(s["at"])).alias("out")), lambda s: s["out"])

    def whole(parts: Column) -> Column:
        heads = one_by_one(F.transform(parts, lambda v: F.aggregate(v, F.lit(0), merge)), F.lit(0))
        return F.flatten(F.zip_with(parts, heads, one_by_one))

    return _let(values, lambda v: _let(_parts(v), whole))


def matches(text: Column, pattern: str) -> Column:
    """All leftmost non-overlapping matches as ``(a, b, m)``: code points, end exclusive, and the match.

    The text is cut at the matches and lengths are added up.
    """
    parts = F.struct(F.split(text, pattern, -1).alias("gap"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("m"))

    def places(x: Column) -> Column:
        gaps, found = F.slice(x["gap"], F.lit(1), F.size(x["m"])), x["m"]
        before = _before(F.zip_with(gaps, found, lambda g, m: F.char_length(g) + F.char_length(m)), lambda u, v: u + v)
        starts = F.zip_with(before, gaps, lambda n, g: n + F.char_length(g))
        return F.zip_with(starts, found, lambda n, m: F.struct(n.alias("a"), (n + F.char_length(m)).alias("b"), m.alias("m")))

    return F.when(text.rlike(pattern), _let(parts, places)).otherwise(F.expr("array()").cast(_SPANS))


def _upper_tail(z: Column) -> Column:
    """Probability of a standard normal above ``z``, to about 1e-4, by a logistic curve."""
    z = F.least(F.greatest(z, F.lit(-12.0)), F.lit(12.0))
    return 1 / (1 + F.exp(1.5976 * z + 0.070565992 * z * z * z))


def randomness(token: Column) -> Column:
    """p-value of the battery for one token; small if it isn't random."""
    plain = F.translate(token, "-_=", "+/")
    alphabet = (
        F.when(plain.rlike("^[0-9]+$"), _DIGITS)
        .when(plain.rlike("^[0-9a-f]+$"), "0123456789abcdef")
        .when(plain.rlike("^[0-9A-F]+$"), "0123456789ABCDEF")
        .when(plain.rlike("^[A-Z2-7]+$"), _UPPER + "234567")
        .when(plain.rlike("^[a-z0-9]+$"), _DIGITS + _LOWER)
        .when(plain.rlike("^[A-Z0-9]+$"), _DIGITS + _UPPER)
        .when(plain.rlike("^[A-Za-z0-9]+$"), _DIGITS + _UPPER + _LOWER)
        .otherwise(_UPPER + _LOWER + _DIGITS + "+/")
    )
    k = F.length(alphabet).cast("double")
    chars = F.filter(F.split(plain, ""), lambda c: c != "")
    values = F.transform(chars, lambda c: F.instr(alphabet, c).cast("double") - 1)
    whole = F.struct(plain.alias("t"), k.alias("k"), values.alias("v"), F.transform(F.array_distinct(chars), lambda c: F.length(plain) - F.length(F.replace(plain, c, F.lit("")))).alias("counts"))

    def score(x: Column) -> Column:
        v, size = x["v"], x["k"]
        n = F.size(v).cast("double")
        chi = F.aggregate(x["counts"], F.lit(0.0), lambda s, c: s + (c * c).cast("double")) * size / n - n
        z1 = (chi - (size - 1)) / F.sqrt(2 * (size - 1) * (n - 1) / n)
        none = F.struct(F.lit(None).cast("double").alias("last"), F.lit(0.0).alias("turns"), F.lit(0.0).alias("cross"))
        middle = (size - 1) / 2

        def step(s: Column, c: Column) -> Column:
            turn = F.when(s["last"].isNotNull() & ((s["last"] > middle) != (c > middle)), 1.0).otherwise(0.0)
            return F.struct(c.alias("last"), (s["turns"] + turn).alias("turns"), (s["cross"] + F.coalesce((s["last"] - middle) * (c - middle), F.lit(0.0))).alias("cross"))

        run = F.aggregate(v, none, step)
        z2 = (run["turns"] - (n - 1) / 2) / F.sqrt((n - 1) / 4)
        z3 = run["cross"] / (F.sqrt(n - 1) * (size * size - 1) / 12)
        least = F.least(_upper_tail(z1), 2 * _upper_tail(F.abs(z2)), 2 * _upper_tail(F.abs(z3)))
        return F.least(3 * least, F.lit(1.0))

    return F.element_at(F.transform(F.array(whole), score), 1)


def _band(token: Column) -> Column:
    return sum((F.when(F.length(token) >= b, 1).otherwise(0) for b in BANDS), F.lit(0))


def ordinary(token: Column, p: Column) -> Column:
    """The share of ordinary tokens of this length and encoding that the battery finds as random as ``p``."""
    step = sum((F.when(p >= x, 1).otherwise(0) for x in STEPS), F.lit(0))
    table = F.array(*(F.lit(x) for row in (*ONE_CASE, *MIXED) for x in (1.0, *row)))
    one_case = token.rlike("^(?:[a-z0-9]+|[A-Z0-9]+)$")
    row = _band(token) - 1 + F.when(one_case, 0).otherwise(len(BANDS))
    return F.element_at(table, row * (1 + len(STEPS)) + step + 1)


def _limits(tokens: Column) -> Column:
    """For each band, the greatest share that Benjamini-Hochberg reports among ``tokens``; below zero if none."""

    def limit(band: Column) -> Column:
        shares = F.array_sort(F.transform(F.filter(tokens, lambda t: t["band"] == band), lambda t: t["share"]))
        passed = lambda x: F.filter(F.transform(x, lambda p, i: F.when(p * F.size(x) <= RATE * (i + 1), p)), lambda p: p.isNotNull())
        return _let(shares, lambda x: F.coalesce(F.array_max(passed(x)), F.lit(-1.0)))

    return F.transform(F.array(*(F.lit(i + 1) for i in range(len(BANDS)))), limit)


def scan(docs: DataFrame, *keep: Column) -> DataFrame:
    """``(doc_id, assign, access, hex, tokens)`` and the columns ``keep``: base spans, and all tokens that aren't letters alone with band and share."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("t"), *keep)
    keep = rows.columns[2:]
    rows = rows.select("doc_id", *keep, matches(F.col("t"), ASSIGN).alias("assign"), matches(F.col("t"), ACCESS).alias("access"), matches(F.col("t"), HEX).alias("hex"), matches(F.col("t"), TOKEN).alias("tokens"))
    assign = F.filter("assign", lambda x: F.length(F.regexp_extract(x["m"], ASSIGN, 2)) >= 12)

    def rate(x: Column) -> Column:
        return F.struct(x["a"].alias("a"), x["b"].alias("b"), _band(x["m"]).alias("band"), ordinary(x["m"], randomness(x["m"])).alias("share"))

    tokens = F.transform(F.filter("tokens", lambda x: ~x["m"].rlike("^[A-Za-z]+$")), rate)
    place = lambda x: F.struct(x["a"].alias("a"), x["b"].alias("b"))
    return rows.select("doc_id", *keep, F.transform(assign, place).alias("assign"), F.transform("access", place).alias("access"), F.transform("hex", place).alias("hex"), tokens.alias("tokens"))


def _entries(i: int, kind: str) -> Column:
    return F.transform(kind, lambda x: F.struct(x["a"].alias("a"), F.lit(i).alias("i"), x["b"].alias("b"), F.lit(kind).alias("k")))


def _joined(kinds: tuple[str, ...]) -> Column:
    """All spans of the columns ``kinds`` as ``kind:start:end``, by start and then in the order of ``kinds``."""

    spans = F.array_sort(F.concat(*(_entries(i, k) for i, k in enumerate(kinds))))
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["k"], x["a"].cast("string"), x["b"].cast("string"))), ",")


def _settled(scanned: DataFrame) -> DataFrame:
    """``scanned`` with the column ``random``: the tokens that the battery adds, apart from those that overlap a base span."""

    def reported(tokens: Column) -> Column:
        return _let(_limits(tokens), lambda limit: F.filter(tokens, lambda t: t["share"] <= F.element_at(limit, t["band"])))

    rows = scanned.withColumn("base", F.concat("assign", "access", "hex"))
    added = F.when(F.size("tokens") > 0, _let(F.col("tokens"), reported)).otherwise(F.slice("tokens", 1, 0))
    rows = rows.withColumn("added", added)
    apart = F.filter("added", lambda t: ~F.exists("base", lambda x: (x["a"] < t["b"]) & (t["a"] < x["b"])))
    return rows.withColumn("random", F.transform(apart, lambda t: F.struct(t["a"].alias("a"), t["b"].alias("b")))).drop("base", "added", "tokens")


def find_secrets(docs: DataFrame) -> DataFrame:
    """``(doc_id, assign, access, hex, random)``: spans of each kind for every row of ``docs``.

    A null or empty text has no spans and repeated rows repeat.
    """
    return _settled(scan(docs))


def redact(docs: DataFrame) -> DataFrame:
    """``docs`` with every span replaced by its kind in brackets; overlapping spans become one, named by the first.

    Columns stay as they are, but for ``text`` and, where there is one, ``n_chars`` of changed rows.
    """
    names = docs.columns
    row = F.struct(*(docs[c].alias(c) for c in names)).alias("row")
    rows = _settled(scan(docs, row))
    spans = F.array_sort(F.concat(*(_entries(i, k) for i, k in enumerate(KINDS))))
    rows = rows.select("row", spans.alias("spans"))
    text = F.col("row.text").cast("string")

    def pieces(part: Column) -> Column:
        """What stands before each span of a part, cut from the part's own stretch of the text, and its kind."""
        first = F.element_at(part, 1)["pos"]
        stretch = F.substring(text, first + 1, F.element_at(part, -1)["a"] - first)
        one = lambda t, x: F.concat(F.substring(t, x["pos"] - first + 1, x["a"] - x["pos"]), F.lit("["), x["k"], F.lit("]"))
        return _let(stretch, lambda t: F.array_join(F.transform(part, lambda x: one(t, x)), ""))

    def cut(spans: Column) -> Column:
        before = _before(F.transform(spans, lambda x: x["b"]), lambda u, v: F.greatest(u, v))
        placed = F.zip_with(spans, before, lambda x, n: F.struct(n.alias("pos"), x["a"].alias("a"), x["k"].alias("k")))
        # A span that begins before another's end belongs to that one.
        return _let(F.filter(placed, lambda x: x["a"] >= x["pos"]), lambda kept: F.array_join(F.transform(_parts(kept), pieces), ""))

    end = F.array_max(F.transform("spans", lambda x: x["b"]))
    changed = F.concat(_let(F.col("spans"), cut), F.substring(text, end + 1, F.char_length(text)))
    rows = rows.withColumn("changed", F.when(F.size("spans") > 0, changed))
    new = {"text": F.coalesce("changed", text), "n_chars": F.coalesce(F.char_length("changed"), F.col("row.n_chars") if "n_chars" in names else F.lit(None))}
    return rows.select(*((new[c].cast(docs.schema[c].dataType) if c in new else F.col(f"row.`{c}`")).alias(c) for c in names))


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = find_secrets(read(spark, sf_dir, "documents"))
    counts = [F.size(k).cast("long").alias(f"n_{k}") for k in KINDS[:3]]
    return got.select("doc_id", *counts, F.sha2(_joined(KINDS[:3]), 256).alias("base_sha256"), _joined(KINDS).alias("spans"))
