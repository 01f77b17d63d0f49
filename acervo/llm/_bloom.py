"""A Bloom filter of fixed size over a column of longs.

It only saves shuffled rows: rows that pass are joined exactly afterwards, so its size never changes a result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from acervo.llm._text import U64, mix

PROBES = 4


def _bits(keys: np.ndarray, log2_bits: int) -> list[np.ndarray]:
    a = mix(keys.view(U64) if keys.dtype == np.int64 else keys)
    b = mix(a ^ U64(0x5851F42D4C957F2D)) | U64(1)
    return [((a + U64(i) * b) >> U64(64 - log2_bits)).astype(np.int64) for i in range(PROBES)]


def build(frame: DataFrame, column: str, log2_bits: int = 24) -> np.ndarray:
    """Bits of all values of `column`, as 64-bit words. The driver receives 2**log2_bits / 64 words at most (2 MB of bits by default)."""

    def fill(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words = None
        for batch in batches:
            words = np.zeros(1 << (log2_bits - 6), U64) if words is None else words
            for bits in _bits(batch[column].to_numpy(np.int64), log2_bits):
                np.bitwise_or.at(words, bits >> 6, U64(1) << (bits & 63).astype(U64))
        if words is not None:
            at = np.flatnonzero(words)
            yield pd.DataFrame({"at": at.astype(np.int32), "word": words[at].view(np.int64)})

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # a row a batch: half a million rows of two numbers would take the driver some hundred MB
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.column(c).to_numpy().tobytes()], pa.binary()) for c in ("at", "word")], ["at", "word"])

    found = frame.select(F.col(column).cast("long").alias(column)).where(F.col(column).isNotNull()).mapInPandas(fill, "at int, word long").groupBy("at").agg(F.bit_or("word").alias("word")).mapInArrow(packed, "at binary, word binary").toArrow()
    out = np.zeros(1 << (log2_bits - 6), U64)
    for at, word in zip(found.column("at"), found.column("word"), strict=True):
        out[np.frombuffer(at.as_buffer(), np.int32)] = np.frombuffer(word.as_buffer(), U64)
    return out


def passes(words: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Which keys the filter may hold."""
    log2_bits = int(len(words)).bit_length() + 5
    out = np.ones(len(keys), bool)
    for bits in _bits(keys, log2_bits):
        out &= (words[bits >> 6] >> (bits & 63).astype(U64)) & U64(1) == U64(1)
    return out
