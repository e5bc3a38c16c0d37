"""An archive as a folder of tables: built from raw messages, opened, and queried by message."""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.dates import asctime
from ..operators import charts, fuzzy, headers, lexicon, mime, render, setops, threads, verify
from . import search as search_plan

VERSION = 1
REQUIRED, OPTIONAL = ("messages", "conn", "index"), ("similar", "archives", "manifest")


def build(raw: DataFrame, path: str, group: str | None = None, codec: str = "zstd", name: str = "", desc_short: str = "", desc_long: str = "") -> None:
    """``raw(idx, content)`` to an archive at ``path``: one encoding, no duplicates, threads, order, index, similar words."""
    spark = raw.sparkSession
    write = lambda df, table: df.write.mode("overwrite").option("compression", codec).parquet(f"{path}/{table}")
    messages = setops.kill_duplicates(headers.messages(mime.to_utf8(raw)))
    if group:
        messages = setops.filter_newsgroups(messages, group)
    write(messages, "unsorted")
    messages = spark.read.parquet(f"{path}/unsorted")
    conn = threads.connect(messages)
    order = threads.thread_order(conn.select("idx", "parent", "epoch"))
    write(order, "order")
    order = spark.read.parquet(f"{path}/order")
    write(messages.join(order, "idx").drop("idx").withColumnRenamed("new_idx", "idx").repartitionByRange("idx").sortWithinPartitions("idx"), "messages")
    links = conn.join(order, "idx").select(F.col("new_idx").alias("idx"), "parent", "epoch").join(order.select(F.col("idx").alias("parent"), F.col("new_idx").alias("new_parent")), "parent", "left")
    write(threads.connectivity(links.select("idx", F.col("new_parent").alias("parent"), "epoch")), "conn")
    messages, conn = spark.read.parquet(f"{path}/messages"), spark.read.parquet(f"{path}/conn")
    write(lexicon.postings(messages, conn, unicode=True).repartitionByRange("word", "idx").sortWithinPartitions("word", "idx"), "index")
    write(fuzzy.similar_words(lexicon.vocabulary(spark.read.parquet(f"{path}/index"))), "similar")
    manifest = json.dumps({"version": VERSION, "name": name, "desc_short": desc_short, "desc_long": desc_long})
    spark.createDataFrame([(manifest,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/manifest")


def repack(spark: SparkSession, path: str, out: str, codec: str) -> None:
    """All tables of an archive in another compression."""
    for table in (*REQUIRED, "similar"):
        spark.read.parquet(f"{path}/{table}").write.mode("overwrite").option("compression", codec).parquet(f"{out}/{table}")
    spark.read.text(f"{path}/manifest").write.mode("overwrite").text(f"{out}/manifest")


def repack_shared(spark: SparkSession, path: str, out: str, level: int = 16, sample_bytes: int = 8 << 20, dictionary_bytes: int = 128 << 10) -> None:
    """Message bodies of an archive, each compressed by itself with one dictionary that all share, so that any one can be read alone.

    The dictionary is trained on bodies of at most about ``sample_bytes``, those of the least hashes; what is too little
    to train on is packed without one.
    """
    import zstandard

    bodies = spark.read.parquet(f"{path}/messages").select("idx", "msgid", F.encode(F.coalesce("body", F.lit("")), "UTF-8").alias("content"))
    mean = bodies.agg(F.avg(F.octet_length("content"))).first()[0] or 1.0
    sample = [bytes(r[0]) for r in bodies.orderBy(*setops.by_hash(0)).limit(max(1, int(sample_bytes / max(mean, 1.0)))).select("content").collect()]
    try:
        dictionary = zstandard.train_dictionary(dictionary_bytes, sample).as_bytes()
    except zstandard.ZstdError:
        dictionary = b""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shared = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
        packer = zstandard.ZstdCompressor(level=level, dict_data=shared)
        for b in batches:
            yield b.assign(content=[packer.compress(bytes(c)) for c in b["content"]])

    bodies.mapInPandas(run, "idx long, msgid string, content binary").write.mode("overwrite").option("compression", "none").parquet(f"{out}/bodies")
    spark.createDataFrame([(bytearray(dictionary),)], "dictionary binary").coalesce(1).write.mode("overwrite").parquet(f"{out}/dictionary")


def read_shared(spark: SparkSession, out: str) -> DataFrame:
    """``(idx, msgid, body)`` of what ``repack_shared`` wrote."""
    import zstandard

    dictionary = bytes(spark.read.parquet(f"{out}/dictionary").first()[0])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shared = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
        opener = zstandard.ZstdDecompressor(dict_data=shared)
        for b in batches:
            yield pd.DataFrame({"idx": b["idx"], "msgid": b["msgid"], "body": [opener.decompress(bytes(c)).decode() for c in b["content"]]})

    return spark.read.parquet(f"{out}/bodies").mapInPandas(run, "idx long, msgid string, body string")


@dataclass
class Archive:
    spark: SparkSession
    messages: DataFrame
    conn: DataFrame
    index: DataFrame
    similar: DataFrame | None
    meta: dict

    @staticmethod
    def open(spark: SparkSession, path: str) -> Archive | None:
        """None if a required table is missing; a newer version is refused."""
        try:
            tables = [spark.read.parquet(f"{path}/{t}") for t in REQUIRED]
            meta = json.loads(spark.read.text(f"{path}/manifest").first()[0])
        except Exception as e:  # noqa: BLE001
            if "PATH_NOT_FOUND" in str(e) or "UNABLE_TO_INFER_SCHEMA" in str(e):
                return None
            raise
        if meta["version"] > VERSION:
            return None
        try:
            similar = spark.read.parquet(f"{path}/similar")
        except Exception as e:  # noqa: BLE001
            if "PATH_NOT_FOUND" not in str(e):
                raise
            similar = None
        return Archive(spark, *tables, similar, meta)

    def _one(self, key: int | str) -> DataFrame:
        return self.messages.where((F.col("msgid") if isinstance(key, str) else F.col("idx")) == key)

    def view(self, key: int | str) -> DataFrame:
        return self._one(key)

    def toplevel(self) -> DataFrame:
        return threads.toplevel(self.conn).orderBy("epoch", "idx")

    def info(self) -> DataFrame:
        return self.conn.agg(F.count("*").alias("n_messages"), F.count_if(F.col("parent").isNull()).alias("n_toplevel"))

    def parent(self, key: int | str) -> DataFrame:
        return self.conn.join(self._one(key).select("idx"), "idx").select("parent")

    def child(self, key: int | str) -> DataFrame:
        return self.conn.join(self._one(key).select("idx"), "idx").select(F.explode("children").alias("idx"))

    def date(self, key: int | str) -> DataFrame:
        return self._one(key).select(asctime(F.col("epoch")).alias("date"))

    def author(self, key: int | str) -> DataFrame:
        return self._one(key).select("author")

    def subject(self, key: int | str) -> DataFrame:
        return self._one(key).select("subject")

    def idx(self, msgid: str) -> DataFrame:
        """The number of an id, -1 if the archive lacks it."""
        return self._one(msgid).agg(F.coalesce(F.min("idx"), F.lit(-1)).alias("idx"))

    def search(self, query: str, flags: search_plan.Flags | None = None) -> DataFrame:
        return search_plan.ordered(search_plan.search(self.index, query, flags or search_plan.Flags(adjacent=True), self.similar))

    def timechart(self) -> DataFrame:
        return charts.time_chart(self.messages).orderBy("month")

    def desc(self) -> dict:
        return {k: self.meta[k] for k in ("name", "desc_short", "desc_long")}

    def xref(self, host: str | None = None) -> DataFrame:
        return charts.xref(self.messages, self.meta["name"], host)

    def verify(self) -> DataFrame:
        return verify.report(self.messages, self.conn, self.similar is not None)


def open_galaxy(spark: SparkSession, base: str, paths: list[str]) -> tuple[dict[int, Archive], DataFrame]:
    """The archives at ``paths``, tried as they are and below ``base``, and ``(archive_id, path, name, available)``."""
    found, rows = {}, []
    for i, p in enumerate(paths):
        archive = Archive.open(spark, p) or Archive.open(spark, f"{base}/{p}")
        if archive:
            found[i] = archive
        rows.append((i, p, archive.meta["name"] if archive else None, archive is not None))
    return found, spark.createDataFrame(rows, "archive_id int, path string, name string, available boolean")


def web_view(found: dict[int, Archive], msgid: str) -> tuple[int, str]:
    """The page of an id from the first archive that has it, with status 200, or 404 and nothing."""
    for _, archive in sorted(found.items()):
        page = render.html(archive.view(msgid)).first()
        if page is not None:
            return 200, page["html"]
    return 404, ""
