"""Media columns: Matroska files in binary columns, parsed into packet tables.

Elements follow the public EBML and Matroska specifications: variable-length ids and sizes, clusters of simple blocks,
lacing, and cues. The writer makes one track of 8-bit PCM samples, one sample a byte.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Element ids of the Matroska specification.
EBML, DOC_TYPE, SEGMENT, INFO, TIMESTAMP_SCALE = 0x1A45DFA3, 0x4282, 0x18538067, 0x1549A966, 0x2AD7B1
TRACKS, TRACK_ENTRY, TRACK_NUMBER, TRACK_UID, TRACK_TYPE, CODEC_ID = 0x1654AE6B, 0xAE, 0xD7, 0x73C5, 0x83, 0x86
AUDIO, SAMPLING_FREQUENCY, CHANNELS, BIT_DEPTH = 0xE1, 0xB5, 0x9F, 0x6264
CLUSTER, TIMESTAMP, SIMPLE_BLOCK, BLOCK_GROUP, BLOCK = 0x1F43B675, 0xE7, 0xA3, 0xA0, 0xA1
CUES, CUE_POINT, CUE_TIME, CUE_TRACK_POSITIONS, CUE_TRACK, CUE_CLUSTER_POSITION = 0x1C53BB6B, 0xBB, 0xB3, 0xB7, 0xF7, 0xF1
PARENTS = {EBML, SEGMENT, INFO, TRACKS, TRACK_ENTRY, AUDIO, CLUSTER, BLOCK_GROUP, CUES, CUE_POINT, CUE_TRACK_POSITIONS}

#: Samples a second (so that 8 samples are a millisecond), bytes of a frame, frames of a block, blocks of a cluster.
RATE, FRAME, LACED, BLOCKS = 8000, 512, 8, 7
PACKETS = "array<struct<track:int,timestamp:long,offset:long,size:int>>"


def vint(value: int, width: int = 0) -> bytes:
    """A variable-length size."""
    width = width or max(1, -(-(value + 1).bit_length() // 7))
    return (value | 1 << 7 * width).to_bytes(width, "big")


def element(kind: int, body: bytes) -> bytes:
    return kind.to_bytes(-(-kind.bit_length() // 8), "big") + vint(len(body)) + body


def number(kind: int, value: int) -> bytes:
    return element(kind, value.to_bytes(max(1, -(-value.bit_length() // 8)), "big"))


_HEAD = element(EBML, element(DOC_TYPE, b"matroska"))
_SETUP = element(INFO, number(TIMESTAMP_SCALE, 1_000_000)) + element(TRACKS, element(TRACK_ENTRY, number(TRACK_NUMBER, 1) + number(TRACK_UID, 1) + number(TRACK_TYPE, 2) + element(CODEC_ID, b"A_PCM/INT/LIT") + element(AUDIO, element(SAMPLING_FREQUENCY, np.array(RATE, ">f8").tobytes()) + number(CHANNELS, 1) + number(BIT_DEPTH, 8))))


def _block(frames: list[bytes], time: int) -> bytes:
    """A simple block; frames of one size are laced with fixed sizes, others by EBML differences."""
    head = b"\x81" + time.to_bytes(2, "big", signed=True)
    if len(frames) == 1:
        return element(SIMPLE_BLOCK, head + b"\x80" + frames[0])
    count = bytes([len(frames) - 1])
    if len({*map(len, frames)}) == 1:
        return element(SIMPLE_BLOCK, head + b"\x84" + count + b"".join(frames))
    sizes = vint(len(frames[0])) + b"".join(vint(len(b) - len(a) + (1 << 7 * 2 - 1) - 1, 2) for a, b in zip(frames[:-2], frames[1:-1], strict=True))
    return element(SIMPLE_BLOCK, head + b"\x86" + count + sizes + b"".join(frames))


def write(samples: bytes) -> bytes:
    """A Matroska file with the samples in clusters, and cues that point at the clusters."""
    per_cluster = FRAME * LACED * BLOCKS
    body, at, cues = [_SETUP], len(_SETUP), []
    for first in range(0, len(samples), per_cluster):
        start = first * 1000 // RATE
        parts = [number(TIMESTAMP, start)]
        for lo in range(first, min(first + per_cluster, len(samples)), FRAME * LACED):
            frames = [samples[i : i + FRAME] for i in range(lo, min(lo + FRAME * LACED, len(samples)), FRAME)]
            parts.append(_block(frames, lo * 1000 // RATE - start))
        cluster = element(CLUSTER, b"".join(parts))
        cues.append(element(CUE_POINT, number(CUE_TIME, start) + element(CUE_TRACK_POSITIONS, number(CUE_TRACK, 1) + number(CUE_CLUSTER_POSITION, at))))
        body.append(cluster)
        at += len(cluster)
    return _HEAD + element(SEGMENT, b"".join(body) + element(CUES, b"".join(cues)))


def _vint(data: bytes, at: int, end: int, marked: bool = False) -> tuple[int, int, int]:
    """Value, width and next place of a variable-length number; ids keep their marker."""
    if at >= end or not data[at]:
        raise ValueError("a variable-length number is cut off or too wide")
    width = 9 - data[at].bit_length()
    if at + width > end:
        raise ValueError("a variable-length number is cut off")
    value = int.from_bytes(data[at : at + width], "big")
    return value if marked else value & (1 << 7 * width) - 1, width, at + width


def elements(data: bytes, at: int, end: int) -> Iterator[tuple[int, int, int]]:
    """(id, start, end) of the elements between two places; an unknown size reaches to the end."""
    while at < end:
        kind, _, at = _vint(data, at, end, marked=True)
        size, width, at = _vint(data, at, end)
        stop = end if size == (1 << 7 * width) - 1 else at + size
        if stop > end:
            raise ValueError("an element reaches beyond its parent")
        yield kind, at, stop
        at = stop


def _frames(data: bytes, at: int, end: int) -> tuple[int, int, list[tuple[int, int]]]:
    """Track, relative time and the byte ranges of the frames of a block."""
    track, _, at = _vint(data, at, end)
    if at + 3 > end:
        raise ValueError("a block is cut off")
    time, lacing, at = int.from_bytes(data[at : at + 2], "big", signed=True), data[at + 2] >> 1 & 3, at + 3
    if not lacing:
        return track, time, [(at, end - at)]
    if at >= end:
        raise ValueError("a laced block is cut off")
    count, at = data[at] + 1, at + 1
    sizes: list[int] = []
    if lacing == 2:
        if (end - at) % count:
            raise ValueError("frames of a fixed-size lace differ")
        sizes = [(end - at) // count] * count
    elif lacing == 1:
        for _ in range(count - 1):
            size = 0
            while at < end and data[at] == 255:
                size, at = size + 255, at + 1
            if at >= end:
                raise ValueError("a lace is cut off")
            size, at = size + data[at], at + 1
            sizes.append(size)
    else:
        for i in range(count - 1):
            value, width, at = _vint(data, at, end)
            sizes.append(sizes[-1] + value - ((1 << 7 * width - 1) - 1) if i else value)
    if lacing != 2:
        sizes.append(end - at - sum(sizes))
    if min(sizes) < 0:
        raise ValueError("a lace is longer than its block")
    out = []
    for size in sizes:
        out.append((at, size))
        at += size
    return track, time, out


def parse(data: bytes) -> tuple[list[tuple[int, int, int, int]], list[tuple[int, int, int]]]:
    """Packets (track, timestamp in ms, offset, size) in file order, and cues (time, track, offset of the cluster)."""
    packets: list[tuple[int, int, int, int]] = []
    cues: list[tuple[int, int, int]] = []
    scale, base, segment, cue_time, cue_track = 1_000_000, 0, 0, 0, 0
    stack = [elements(data, 0, len(data))]
    while stack:
        item = next(stack[-1], None)
        if item is None:
            stack.pop()
            continue
        kind, at, end = item
        if kind in PARENTS:
            segment = at if kind == SEGMENT else segment
            stack.append(elements(data, at, end))
        elif kind in (SIMPLE_BLOCK, BLOCK):
            track, time, ranges = _frames(data, at, end)
            packets += [(track, (base + time) * scale // 1_000_000, *x) for x in ranges]
        elif kind in (TIMESTAMP, TIMESTAMP_SCALE, CUE_TIME, CUE_TRACK, CUE_CLUSTER_POSITION):
            value = int.from_bytes(data[at:end], "big")
            if kind == TIMESTAMP:
                base = value
            elif kind == TIMESTAMP_SCALE:
                scale = value
            elif kind == CUE_TIME:
                cue_time = value
            elif kind == CUE_TRACK:
                cue_track = value
            else:
                cues.append((cue_time * scale // 1_000_000, cue_track, segment + value))
    return packets, cues


def encode_texts(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id_column, n_bytes, media): each text's bytes, padded with 0 to a positive multiple of 64, as a Matroska file. Null texts are empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts, lo, held, sizes, media = batch.column("id"), batch.column("text"), 0, 0, [], []
            for i in range(batch.num_rows):
                payload = (texts[i].as_py() or "").encode()
                sizes.append(len(payload))
                media.append(write(payload + bytes(-len(payload) % 64 if payload else 64)))
                held += len(media[-1])
                if held > 4 << 20 or i + 1 == batch.num_rows:
                    yield pa.RecordBatch.from_arrays([ids.slice(lo, i + 1 - lo), pa.array(sizes, pa.int64()), pa.array(media, pa.binary())], ["id", "n_bytes", "media"])
                    lo, held, sizes, media = i + 1, 0, [], []

    return docs.select(F.col(id_column).cast("long").alias("id"), F.col(text_column).alias("text")).mapInArrow(run, "id long, n_bytes long, media binary").withColumnRenamed("id", id_column)


def packet_table(media: DataFrame, id_column: str = "doc_id") -> DataFrame:
    """One row a packet: (id_column, packet, track, timestamp, offset, size, key): offset and size are the byte range in the file.

    Null media have no packets. A file that breaks the format gives one row with packet -1 and nulls beside it.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                data = batch.column("media")[i].as_py()
                if data is None:
                    continue
                try:
                    found = [(k, *p) for k, p in enumerate(parse(data)[0])]
                except ValueError:
                    found = [(-1, None, None, None, None)]
                if found:
                    cols = list(zip(*found, strict=True))
                    kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int32()]
                    yield pa.RecordBatch.from_arrays([pa.array([batch.column("id")[i].as_py()] * len(found), pa.int64()), *[pa.array(c, k) for c, k in zip(cols, kinds, strict=True)]], ["id", "packet", "track", "timestamp", "offset", "size"])

    return media.select(F.col(id_column).cast("long").alias("id"), "media").mapInArrow(run, "id long, packet int, track int, timestamp long, offset long, size int").withColumnRenamed("id", id_column)


def feature(samples: np.ndarray, packets: int) -> str:
    """Packets, mean, root mean square around the middle level, and sign changes of the samples."""
    level = samples.astype(np.int64) - 128
    changes = int(np.count_nonzero((level[1:] < 0) != (level[:-1] < 0)))
    return f"packets={packets};mean={level.mean():.4f};rms={np.sqrt((level * level).mean()):.4f};changes={changes}"


def media_columns(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Stores each text as Matroska, reads the stored bytes back and computes digests and features of what was read.

    One row for each row of docs: (id_column, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes,
    media_sha256, feature, n_packets, n_cues). Null and empty texts give 64 bytes 0. Equal texts give equal values;
    repeated rows and null ids come out as they come in.
    """
    names = ["id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "n_packets", "n_cues"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for i in range(batch.num_rows):
                data = batch.column("media")[i].as_buffer().to_pybytes()
                packets, cues = parse(data)
                payload = b"".join(data[at : at + size] for _, _, at, size in packets)
                rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(data), hashlib.sha256(data).hexdigest(), feature(np.frombuffer(payload, np.uint8), len(packets)), len(packets), len(cues)))
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64()]
            columns = list(zip(*rows, strict=True)) if rows else [()] * len(kinds)
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("n_bytes"), *[pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]], names)

    media = encode_texts(docs, id_column, text_column).withColumnRenamed(id_column, "id")
    return media.mapInArrow(run, "id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, n_packets long, n_cues long").withColumnRenamed("id", id_column)
