"""Readers of mail trees and mailboxes."""

from __future__ import annotations

import io
import re
import tarfile
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..work import kept

RAW = "source string, content binary"


def _numbered(rows: DataFrame, *order: str) -> DataFrame:
    """Numbers that rise with ``order``; gaps between partitions are left.

    The numbered rows are a table of their own, so all that reads them sees the same numbers.
    """
    return kept(rows.orderBy(*order).withColumn("idx", F.monotonically_increasing_id()).select("idx", "source", "content"), "numbered")


def maildir(spark: SparkSession, path: str) -> DataFrame:
    """``(idx, source, content)``: one message a file, all folders below ``path``; dot names are skipped, carriage returns removed."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    # What comes after the folder's own path, however the file system spells its beginning.
    root = "/" + re.sub(r"^[a-zA-Z][a-zA-Z0-9+.-]*:/*", "", path).strip("/")
    inside = F.substring("path", F.instr("path", root) + len(root), F.length("path"))
    seen = files.where(~inside.rlike(r"/\."))
    text = F.encode(F.replace(F.decode("content", "iso-8859-1"), F.lit("\r"), F.lit("")), "iso-8859-1")
    return _numbered(seen.select(F.col("path").alias("source"), text.alias("content")), "source")


def split_mbox(content: bytes) -> Iterator[bytes]:
    """Messages of a mailbox: a line over five characters that starts ``From `` opens one and is dropped.

    A ``Lines: n`` header says how many body lines follow; what then comes before the next opening is ignored.
    """
    lines = content.replace(b"\r", b"").split(b"\n")
    if lines and not lines[-1]:
        lines.pop()
    opens = lambda x: len(x) > 5 and x.startswith(b"From ")
    i = 0
    while i < len(lines):
        if not opens(lines[i]):
            i += 1
            continue
        i += 1
        message, count = [], None
        while i < len(lines) and lines[i]:
            if lines[i].startswith(b"Lines: ") and lines[i][7:].strip().isdigit():
                count = int(lines[i][7:])
            message.append(lines[i])
            i += 1
        if i < len(lines):
            message.append(b"")
            i += 1
        if count is not None:
            message += lines[i : i + count]
            i += count
        else:
            while i < len(lines) and not opens(lines[i]):
                message.append(lines[i])
                i += 1
        yield b"\n".join(message) + b"\n"


def mbox(spark: SparkSession, path: str) -> DataFrame:
    """``(idx, source, content)`` of all messages of the mailbox files at ``path``. A mailbox is read by one task: its lines decide where messages end."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for p, c in zip(b["path"], b["content"], strict=True):
                found = list(split_mbox(bytes(c)))
                yield pd.DataFrame({"source": [p] * len(found), "place": range(len(found)), "content": found})

    return _numbered(files.mapInPandas(run, "source string, place long, content binary"), "source", "place")


def packed(spark: SparkSession, path: str) -> DataFrame:
    """``(idx, source, content)`` of the files inside zip and tar archives; folders and dot names are skipped, carriage returns removed.

    Seven-zip archives have no decoder here and must be unpacked first.
    """
    files = spark.read.format("binaryFile").load(path).select("path", "content")

    def entries(c: bytes) -> Iterator[tuple[str, bytes]]:
        if zipfile.is_zipfile(io.BytesIO(c)):
            with zipfile.ZipFile(io.BytesIO(c)) as z:
                yield from ((n.filename, z.read(n)) for n in z.infolist() if not n.is_dir())
        else:
            with tarfile.open(fileobj=io.BytesIO(c)) as t:
                yield from ((m.name, t.extractfile(m).read()) for m in t if m.isfile())

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for p, c in zip(b["path"], b["content"], strict=True):
                found = [(f"{p}/{n}", x.replace(b"\r", b"")) for n, x in entries(bytes(c)) if not any(s.startswith(".") for s in n.split("/"))]
                yield pd.DataFrame(found, columns=["source", "content"])

    return _numbered(files.mapInPandas(run, RAW), "source")


def export(messages: DataFrame, path: str, per_file: int = 10_000, per_message: bool = False) -> None:
    """Message texts with their ids, ``per_file`` to a file; or, where other tools need it, each text in a file of its own below ``idx=``.

    A file a message is what an object store is worst at, so it is no default.
    """
    if per_message:
        messages.select("idx", F.col("raw").alias("value")).write.mode("overwrite").partitionBy("idx").text(path)
    else:
        messages.select("msgid", "raw").write.option("maxRecordsPerFile", per_file).mode("overwrite").json(path)
