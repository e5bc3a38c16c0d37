"""Counts over time, cross-reference maxima, and corpus counters."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import char_grams


def time_chart(messages: DataFrame) -> DataFrame:
    """``(month, n)``: dated messages per month, ``YYYYMM`` in UTC."""
    month = F.date_format(F.timestamp_seconds("epoch"), "yyyyMM")
    return messages.where("epoch <> 0").groupBy(month.alias("month")).agg(F.count("*").alias("n"))


def activity(messages: DataFrame, width: int, height: int = 8, only: DataFrame | None = None) -> DataFrame:
    """``(segment, n, n_hits, bar, label)``: a histogram of all dated messages over ``width`` columns.

    ``only(idx)`` names search hits, counted beside all messages; one hit or none counts as all messages.
    """
    dated = messages.where("epoch <> 0").select("idx", "epoch")
    span = dated.agg(F.min("epoch").alias("lo"), F.max("epoch").alias("hi"))
    if only is not None:
        dated = dated.join(only.select("idx").distinct().withColumn("hit", F.lit(1)), "idx", "left")
    else:
        dated = dated.withColumn("hit", F.lit(1))
    segment = F.floor((F.col("epoch") - F.col("lo")) * (width - 1) / (F.col("hi") - F.col("lo") + 1)).cast("long")
    counts = dated.crossJoin(F.broadcast(span)).groupBy(segment.alias("segment")).agg(F.count("*").alias("n"), F.sum(F.coalesce("hit", F.lit(0))).alias("n_hits"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    top = counts.agg(F.max("n").alias("most"))
    start = F.col("lo") + F.floor(F.col("segment") * (F.col("hi") - F.col("lo") + 1) / (width - 1))
    bar = F.floor(F.col("n") * height * 8 / (F.col("most") + 1)).cast("long")
    return counts.crossJoin(F.broadcast(top)).select("segment", "n", "n_hits", bar.alias("bar"), F.date_format(F.timestamp_seconds(start), "yyyy-MM").alias("label"))


def days_per_column(messages: DataFrame, width: int) -> DataFrame:
    return messages.where("epoch <> 0").agg(F.floor((F.max("epoch") - F.min("epoch")) / (width - 1) / 86400).cast("long").alias("days"))


def xref(messages: DataFrame, group: str, host: str | None = None) -> DataFrame:
    """``(server, last)``: the highest article number per server for ``group``, from ``xref`` values ``server group:n ...``."""
    parts = F.split(F.trim("xref"), r"\s+")
    rows = messages.where("xref is not null").select(F.get(parts, F.lit(0)).alias("server"), F.explode(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0)))).alias("entry"))
    if host:
        rows = rows.where(F.col("server") == host)
    number = F.try_to_number(F.regexp_extract("entry", r":([0-9]+)$", 1), F.lit("99999999999999999"))
    return rows.where(F.regexp_extract("entry", r"^(.*):[0-9]+$", 1) == group).groupBy("server").agg(F.max(number.cast("long")).alias("last"))


def date_stats(dated: DataFrame) -> DataFrame:
    """Counts of ``dated(date_status, ref_status)``."""
    return dated.agg(*(F.count_if(F.col("date_status") == s).alias(f"n_{s}") for s in ("bad", "recovered", "time_travel")), F.count_if(F.col("ref_status") == "broken").alias("n_broken_refs"))


def host_model(ids: DataFrame, most: int = 254) -> DataFrame:
    """``(host, n, gain)``: the hosts of message ids that a codebook of ``most`` entries would hold."""
    counts = ids.select(F.regexp_extract("msgid", r"@(.*)$", 1).alias("host")).where("host <> ''").groupBy("host").agg(F.count("*").alias("n"))
    return counts.withColumn("gain", F.col("n") * (F.length("host") - 1)).orderBy(F.desc("gain"), "host").limit(most)


def ngram_model(ids: DataFrame, n: int) -> DataFrame:
    """``(gram, n)`` of the names before the at sign."""
    name = F.regexp_extract("msgid", r"^([^@]*)", 1)
    return ids.select(F.explode(char_grams(name, n)).alias("gram")).groupBy("gram").agg(F.count("*").alias("n"))
