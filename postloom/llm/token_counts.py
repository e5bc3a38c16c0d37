"""Token counts of whole texts by the whole-token shortcut (see ``pretokens``).

Any row gives a row: a null or empty text has 0 bytes and 0 tokens, repeated rows
repeat, and other columns of the input are ignored. Memory follows the longest
text. A ``.model`` vocabulary is counted by its own library.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import blocks
from .pretokens import pretokens
from .shared import map_batches, read

LIMIT = 512


@functools.cache
def _pieces(path: str):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=path)


def _count(path: str, raw: np.ndarray, offs: np.ndarray) -> np.ndarray:
    if path.endswith(".model"):
        texts = [raw[a:b].tobytes().decode() for a, b in zip(offs[:-1], offs[1:], strict=True)]
        return np.array([len(x) for x in _pieces(path).encode(texts, num_threads=1)], np.int64)
    return pretokens(path).count(raw[offs[0] : offs[-1]], offs - offs[0])


def token_counts(docs: DataFrame, path: str, limit: int = LIMIT) -> DataFrame:
    """``(doc_id, n_bytes, n_tokens, over_limit)`` for every row of ``docs``; ``path`` names a vocabulary file that all executors have."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offs = blocks.texts(batch.column(1))
            for lo, hi in blocks.slices(offs):
                n = _count(path, raw, offs[lo : hi + 1])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(offs[lo + 1 : hi + 1] - offs[lo:hi]), pa.array(n), pa.array(n > limit)], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return map_batches(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), count, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
