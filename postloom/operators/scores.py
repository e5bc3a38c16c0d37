"""Scores of messages by rules."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import SCORE_RULES

_RULE = re.compile(r"^\s*([+-]?\d+)\s+(realname|from|subject)\s+([=~!?])(.*)$")
#: How a rule's flag matches: exactly or by pattern, and whether case counts.
_FLAGS = {"=": (True, False), "~": (True, True), "!": (False, True), "?": (False, False)}


def parse_rules(text: str) -> list[tuple]:
    """Rules of a score file, one ``score field flag+match`` a line; other lines are skipped."""
    out = []
    for line in text.splitlines():
        m = _RULE.match(line)
        if m:
            exact, fold = _FLAGS[m[3]]
            out.append((int(m[1]), m[2], exact, fold, m[4].lower() if exact and fold else m[4]))
    return out


def rules(spark: SparkSession, text: str) -> DataFrame:
    return spark.createDataFrame(parse_rules(text), SCORE_RULES)


def score(messages: DataFrame, rule_rows: list[tuple]) -> DataFrame:
    """``(idx, score, verdict)``: the sum of the matching rules, one expression per rule and no join.

    ``rule_rows`` are ``parse_rules`` of a user's file; fields are columns ``subject``, ``author``, ``realname``.
    """
    columns = {"subject": F.col("subject"), "from": F.col("author"), "realname": F.col("realname") if "realname" in messages.columns else F.col("author")}
    total = F.lit(0).cast("long")
    for points, field, exact, fold, match in rule_rows:
        c = columns[field]
        hit = ((F.lower(c) if fold else c) == match) if exact else c.rlike(("(?i)" if fold else "") + match)
        total = total + F.when(hit, points).otherwise(0)
    verdict = F.when(F.col("score") > 0, "Positive").when(F.col("score") < 0, "Negative").otherwise("Neutral")
    return messages.select("idx", total.alias("score")).withColumn("verdict", verdict)
