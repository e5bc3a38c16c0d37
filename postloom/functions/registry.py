"""The text functions under names that SQL can call: SQL bodies, which the optimizer inlines."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from . import dates, text


def _literal(s: str) -> str:
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


def bodies() -> dict[str, tuple[str, str]]:
    """Return type and SQL body of each function of one string ``s``."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    turned = upper[13:] + upper[:13] + lower[13:] + lower[:13]
    prefix = f"regexp_extract(s, {_literal(text.QUOTE_PREFIX)}, 1)"
    words = f"transform(regexp_extract_all(lower(s), {_literal(text.ASCII_WORD)}, 0), w -> rtrim('_', w))"
    return {
        "subject_kill": ("STRING", f"regexp_replace(s, {_literal(text.kill_pattern())}, '')"),
        "rot13": ("STRING", f"translate(s, '{upper + lower}', '{turned}')"),
        "html_escape": ("STRING", "replace(replace(replace(replace(s, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;')"),
        "uri_encode": ("STRING", "replace(s, '%', '%25')"),
        "is_msgid": ("BOOLEAN", "coalesce(s rlike '^[ -;=?A-~]+@[ -;=?A-~]+$', false)"),
        "quote_level": ("INT", f"length(regexp_replace({prefix}, '[^:>|]', ''))"),
        "index_words": ("ARRAY<STRING>", f"filter({words}, w -> length(w) BETWEEN {text.WORD_LEAST} AND {text.WORD_MOST})"),
    }


def register(spark: SparkSession) -> list[str]:
    """Registers all functions for the session and gives their names."""
    for name, (kind, body) in bodies().items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}(s STRING) RETURNS {kind} RETURN {body}")
    spark.udf.register("parse_message_date", F.pandas_udf(dates._parse, "epoch long, status string"))
    return [*bodies(), "parse_message_date"]
