"""Shared helpers: words and hashes of Arrow text columns, tables kept in the shared folder."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

U64 = np.uint64
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
BASE = U64(0x9E3779B97F4A7C15 | 1)
_powers = np.ones(1, U64)
_local: dict[str, str] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finaliser."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


BYTE_CODES = mix(np.arange(1, 257, dtype=U64) * U64(0xD1342543DE82EF95))
WORD_CODES = np.where(SPACE, U64(0), BYTE_CODES[LOWER])


def powers(n: int) -> np.ndarray:
    """BASE to the power 0..n-1, modulo 2**64."""
    global _powers
    if len(_powers) < n:
        _powers = np.cumprod(np.concatenate([np.ones(1, U64), np.full(max(n, 4096), BASE)]), dtype=U64)
    return _powers[:n]


def text_arrays(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column, one text after the other, and where each begins (nulls are empty)."""
    if column.null_count:
        column = column.fill_null("")
    wide = np.int64 if pa.types.is_large_string(column.type) else np.int32
    buffers = column.buffers()
    offsets = np.frombuffer(buffers[1], wide, len(column) + 1, column.offset * np.dtype(wide).itemsize).astype(np.int64) if len(column) else np.zeros(1, np.int64)
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def pieces(batch: pa.RecordBatch, text: str, most: int = 1 << 20) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """The batch in runs of rows of about `most` bytes, each with its bytes and offsets: bounds the memory of what follows."""
    data, offsets = text_arrays(batch.column(text))
    lo = 0
    while lo < batch.num_rows:
        hi = min(batch.num_rows, max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + most, "right")) - 1))
        yield batch.slice(lo, hi - lo), data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        lo = hi


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and 64-bit hashes of the words of all texts; A-Z count as a-z. Words never span two texts."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, U64)
    inside = ~SPACE[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    heads = offsets[:-1][offsets[:-1] < n]
    first[heads] = inside[heads]
    starts = np.flatnonzero(first)
    if not len(starts):
        return starts, starts, np.zeros(0, U64)
    place = np.arange(n, dtype=np.int32)
    head = np.where(first, place, np.int32(0))
    place -= np.maximum.accumulate(head, out=head)
    del head
    lengths = np.add.reduceat(inside, starts, dtype=np.int64)
    place[~inside] = 0
    codes = WORD_CODES[data]
    codes *= powers(int(place.max()) + 1)[place]
    return starts, starts + lengths, mix(np.add.reduceat(codes, starts, dtype=U64) + lengths.astype(U64))


def word_bounds(starts: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Index of each text's first word, and the number of words at the end."""
    return np.searchsorted(starts, offsets)


def shingle_hashes(hashes: np.ndarray, size: int) -> np.ndarray:
    """Hashes of the runs of `size` words of one text; of the whole text if it has fewer words; none without words."""
    n = len(hashes)
    if not n:
        return hashes
    if n < size:
        return mix(np.array([(hashes * powers(n)).sum(dtype=U64) ^ U64(n)], U64))
    total, factor = np.zeros(n - size + 1, U64), powers(size)
    for i in range(size):
        total += hashes[i : n - size + 1 + i] * factor[i]
    return mix(total ^ U64(size))


def hash_bytes(data: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all strings of `size` bytes in data."""
    n = len(data)
    if n < size:
        return np.zeros(0, U64)
    total = np.zeros(n + 1, U64)
    np.cumsum(BYTE_CODES[data] * powers(n), dtype=U64, out=total[1:])
    back = np.cumprod(np.concatenate([np.ones(1, U64), np.full(n - size, U64(pow(int(BASE), -1, 1 << 64)))]), dtype=U64)
    return mix((total[size:] - total[:-size]) * back)


def signed(x: np.ndarray) -> np.ndarray:
    """64-bit hashes as Spark's long."""
    return x.view(np.int64)


def _local_folder(spark: SparkSession) -> str:
    if not spark.sparkContext.master.startswith(("local[", "local*")) and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    if "top" not in _local:
        _local["top"] = tempfile.mkdtemp(prefix="acervo-")
    return _local["top"]


def shared_folder(spark: SparkSession) -> str:
    """A new folder under spark.checkpoint.dir; where that is unset, a local one in local mode and an error on a cluster."""
    top = spark.conf.get("spark.checkpoint.dir", None) or _local_folder(spark)
    return f"{top}/acervo-{uuid.uuid4().hex}"


def kept(frame: DataFrame) -> DataFrame:
    """The frame, written to the shared folder and read from there: cuts its lineage and survives lost executors."""
    path = shared_folder(frame.sparkSession)
    frame.write.parquet(path)
    out = frame.sparkSession.read.schema(frame.schema).parquet(path)
    out.kept_in = path
    return out


def drop(*frames: DataFrame | Grown) -> None:
    """Removes kept tables from the shared folder. Nothing that is still to be computed may read them."""
    for frame in frames:
        spark, path = (frame.spark, frame.path) if isinstance(frame, Grown) else (frame.sparkSession, frame.kept_in)
        hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
        hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)


class Grown:
    """A table in the shared folder that rows are added to; plans over it stay one scan, however often it grew."""

    def __init__(self, spark: SparkSession, schema: str):
        self.spark, self.schema, self.path = spark, schema, shared_folder(spark)
        spark.createDataFrame([], schema).write.parquet(self.path)

    def add(self, frame: DataFrame) -> None:
        frame.write.mode("append").parquet(self.path)

    def frame(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(self.path)
