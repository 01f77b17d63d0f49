"""Suffix-array dedup: every byte covered by a long enough string that also starts elsewhere is removed.

Suffixes are sampled at anchors: the anchor of a window of `length` bytes is the place of its smallest k-gram hash, so two
equal windows have the same anchor at the same place. Windows can only be equal if their anchors' k-grams are, so suffixes
are dealt out by k-gram and each group is sorted alone. The order after the anchor, and the order of what stands before it
read backwards, come from deep-shallow sorting: multikey partitioning to a shallow depth, then a blind trie for each group
that still shares a longer prefix. A window is repeated when another member of its group shares enough bytes on both
sides, which the two orders' common prefix lengths tell exactly.

Groups of equal surroundings need no sorting: they are counted before anything is shuffled with its bytes. Groups with
more than GROUP distinct surroundings are split into windows that share a longer core, and dealt out again by that core.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from acervo.llm import _bloom
from acervo.llm._text import BASE, BYTE_CODES, U64, hash_bytes, kept, mix, pieces, powers, signed
from acervo.llm.line_dedup import cut

#: Bytes of an anchor's k-gram; distinct members of a group that one task sorts; parts a larger group is split into.
GRAM, GROUP, PARTS = 64, 512, 4
#: Bytes that multikey partitioning compares before blind tries take over.
SHALLOW = 32
_CHUNK = 1 << 20


def _range_hashes(data: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Hashes of the strings data[lo:hi]."""
    total = np.zeros(len(data) + 1, U64)
    np.cumsum(BYTE_CODES[data] * powers(len(data)), dtype=U64, out=total[1:])
    back = np.cumprod(np.concatenate([np.ones(1, U64), np.full(len(data), U64(pow(int(BASE), -1, 1 << 64)))]), dtype=U64)
    return mix((total[hi] - total[lo]) * back[lo] + (hi - lo).astype(U64))


def anchors(data: np.ndarray, offsets: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, first start, last start, k-gram hash, hash of the surroundings) of all windows that lie within one text.

    The surroundings are all bytes of the windows that have the anchor.
    """
    none = np.zeros(0, np.int64)
    width = length - gram + 1
    if len(data) < length:
        return none, none, none, none.view(U64), none.view(U64)
    hashes = hash_bytes(data, gram)
    n = len(data) - length + 1
    place = np.empty(n, np.int64)
    for lo in range(0, n, _CHUNK - width):
        hi = min(n, lo + _CHUNK - width)
        part = hashes[lo : hi + width - 1] & ~U64(_CHUNK - 1) | np.arange(hi + width - 1 - lo, dtype=U64)
        place[lo:hi] = lo + (_sliding_min(part, width) & U64(_CHUNK - 1)).astype(np.int64)
    ends = np.repeat(offsets[1:], np.diff(offsets))
    starts = np.flatnonzero(ends[:n] - np.arange(n) >= length)
    if not len(starts):
        return none, none, none, none.view(U64), none.view(U64)
    place = place[starts]
    edge = np.concatenate([[True], (place[1:] != place[:-1]) | (starts[1:] != starts[:-1] + 1)])
    first = np.flatnonzero(edge)
    last = np.concatenate([first[1:], [len(starts)]]) - 1
    at, lo, hi = place[first], starts[first], starts[last]
    around = _range_hashes(data, lo, hi + length)
    return at, lo, hi, hashes[at], mix(around + (at - lo).astype(U64) * U64(0x9E3779B97F4A7C15))


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minima of all windows, by prefix and suffix minima of blocks of the same width."""
    blocks = -(-len(x) // width)
    padded = np.full(blocks * width, np.iinfo(U64).max, U64)
    padded[: len(x)] = x
    grid = padded.reshape(blocks, width)
    ahead = np.minimum.accumulate(grid, axis=1).reshape(-1)
    behind = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    n = len(x) - width + 1
    return np.minimum(behind[:n], ahead[width - 1 : width - 1 + n])


class BlindTrie:
    """Orders strings of one size by branching bytes only; each insertion compares with one string."""

    def __init__(self, strings: list[bytes]):
        self.strings, self.size = strings, len(strings[0])
        self.numbers = [int.from_bytes(s, "big") for s in strings]
        self.root: list | int = 0
        for i in range(1, len(strings)):
            self._insert(i)

    def common(self, i: int, j: int) -> int:
        """Length of the common prefix of two strings."""
        return self.size - (-(-(self.numbers[i] ^ self.numbers[j]).bit_length() // 8))

    def _insert(self, i: int) -> None:
        s, node = self.strings[i], self.root
        while isinstance(node, list):  # [depth, {byte: child}, some leaf below, equal strings]
            node = node[1].get(s[node[0]], node[2])
        leaf = node if isinstance(node, int) else node[0]
        depth = self.common(i, leaf)
        parent, node = None, self.root
        while isinstance(node, list) and node[0] < depth:
            parent, node = node, node[1][s[node[0]]]
        if depth == self.size:
            new: list | int | tuple = (*(node if isinstance(node, tuple) else (node,)), i)
        elif isinstance(node, list) and node[0] == depth:
            node[1][s[depth]] = i
            return
        else:
            new = [depth, {self.strings[leaf][depth]: node, s[depth]: i}, leaf]
        if parent is None:
            self.root = new
        else:
            parent[1][s[parent[0]]] = new

    def order(self) -> list[int]:
        out, stack = [], [self.root]
        while stack:
            node = stack.pop()
            if isinstance(node, list):
                stack += [node[1][b] for b in sorted(node[1], reverse=True)]
            elif isinstance(node, tuple):
                out += node
            else:
                out.append(node)
        return out


def deep_shallow(rows: np.ndarray, group: np.ndarray, skip: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Sorts the rows (n, size) of bytes within their groups: (order, common prefix with the row before; -1 at a group's first).

    The first `skip` bytes of a group's rows are known to be equal.
    """
    n, size = rows.shape
    order = np.argsort(group, kind="stable")
    prefix = np.full(n, size, np.int64)
    sorted_group = group[order]
    prefix[0] = -1
    prefix[1:][sorted_group[1:] != sorted_group[:-1]] = -1
    depth = skip
    while depth < min(size, skip + SHALLOW):
        width = min(8, size - depth)
        heads = np.cumsum(prefix < depth) - 1
        open_ = np.bincount(heads)[heads] > 1
        if not open_.any():
            return order, prefix
        at = np.flatnonzero(open_)
        words = np.zeros((len(at), 8), np.uint8)
        words[:, :width] = rows[order[at], depth : depth + width]
        key = words.view(">u8").reshape(-1).astype(U64)
        turn = np.lexsort((key, heads[at]))
        order[at] = order[at[turn]]
        key, head = key[turn], heads[at]
        differs = np.flatnonzero((head[1:] == head[:-1]) & (key[1:] != key[:-1]))
        bits = np.frexp((key[differs + 1] ^ key[differs]).astype(np.float64))[1]
        exact = key[differs + 1] ^ key[differs]
        bits = np.where((exact >> np.minimum(bits - 1, 63).astype(U64)) == 0, bits - 1, bits)
        prefix[at[differs + 1]] = depth + (64 - bits) // 8
        depth += width
    if depth < size:
        heads = np.flatnonzero(prefix < depth)
        for a, b in zip(heads, np.append(heads[1:], n), strict=True):
            if b - a > 1:
                ids = order[a:b]
                trie = BlindTrie([rows[i, depth:].tobytes() for i in ids])
                turn = trie.order()
                order[a:b] = ids[turn]
                prefix[a + 1 : b] = [depth + trie.common(x, y) for x, y in zip(turn[:-1], turn[1:], strict=True)]
    return order, prefix


def _clusters(order: np.ndarray, prefix: np.ndarray, least: int) -> np.ndarray:
    """For each row, a number that rows of its group share iff they have `least` first bytes in common."""
    out = np.empty(len(order), np.int64)
    out[order] = np.cumsum(prefix < least)
    return out


def repeated_starts(group: np.ndarray, before: list[bytes], after: list[bytes], length: int, gram: int) -> list[list[tuple[int, int]]]:
    """For each member, ranges (low, high) of how far before its anchor repeated windows start.

    before: bytes from the first window's start to the anchor; after: bytes from the anchor to the last window's end.
    """
    n = len(before)
    reach = np.array([len(x) for x in before])
    least = length - np.array([len(x) for x in after])
    most = int(reach.max())
    right, left = np.zeros((n, length), np.uint8), np.zeros((n, max(most, 1)), np.uint8)
    for i in range(n):
        right[i, : len(after[i])] = np.frombuffer(after[i], np.uint8)
        left[i, : reach[i]] = np.frombuffer(before[i], np.uint8)[::-1]
    right_order, left_order = deep_shallow(right, group, gram), deep_shallow(left, group)
    hit = np.zeros((n, most + 2), bool)
    for s in range(int(least.min()), most + 1):
        rows = np.flatnonzero((reach >= s) & (least <= s))
        if len(rows) > 1:
            key = _clusters(*right_order, length - s)[rows] * (n + 1) + _clusters(*left_order, s)[rows]
            _, inverse, times = np.unique(key, return_inverse=True, return_counts=True)
            hit[rows[times[inverse] > 1], s] = True
    edges = np.diff(np.concatenate([np.zeros((n, 1), np.int8), hit.view(np.int8)], axis=1), axis=1)
    out: list[list[tuple[int, int]]] = [[] for _ in range(n)]
    for (i, low), (_, high) in zip(np.argwhere(edges == 1), np.argwhere(edges == -1), strict=True):
        out[i].append((int(low), int(high) - 1))
    return out


def _marked(docs: DataFrame) -> DataFrame:
    return docs.withColumn("rid", F.xxhash64("id", "text"))


def _grams(docs: DataFrame, length: int, gram: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, data, offsets in pieces(batch, "text"):
                _, _, _, grams, around = anchors(data, offsets, length, gram)
                yield pa.RecordBatch.from_arrays([pa.array(signed(grams)), pa.array(signed(around))], ["gram", "around"])

    return docs.select("text").mapInArrow(run, "gram long, around long")


def _members(docs: DataFrame, length: int, gram: int, wanted: object, mixed: object) -> DataFrame:
    """Anchors whose k-gram may be repeated, with their surroundings where those may differ."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, offsets in pieces(batch, "text"):
                at, lo, hi, grams, around = anchors(data, offsets, length, gram)
                good = _bloom.passes(wanted.value, grams)
                at, lo, hi, grams, around = at[good], lo[good], hi[good], grams[good], around[good]
                text = np.searchsorted(offsets, lo, "right") - 1
                differ, raw = _bloom.passes(mixed.value, grams), data.tobytes()
                around_bytes = [raw[a : b + length] if d else None for a, b, d in zip(lo.tolist(), hi.tolist(), differ.tolist(), strict=True)]
                base, rows = offsets[text], pa.array(text)
                yield pa.RecordBatch.from_arrays([part.column("id").take(rows), part.column("rid").take(rows), pa.array(signed(grams)), pa.array(signed(around)), pa.array(at - base), pa.array(lo - base), pa.array(hi - base), pa.array(around_bytes, pa.binary())], ["id", "rid", "gram", "around", "at", "lo", "hi", "bytes"])

    return docs.mapInArrow(run, "id long, rid long, gram long, around long, at long, lo long, hi long, bytes binary")


def _sorted_groups(cases: DataFrame, length: int, gram: int) -> DataFrame:
    """Distinct surroundings, dealt by key -> (key, around, low, high): how far before the anchor repeated windows start."""

    def solve(table: pa.Table) -> pa.RecordBatch:
        at, raw = table.column("reach").to_pylist(), table.column("bytes").to_pylist()
        key = table.column("key").to_numpy()
        group = np.concatenate([[0], np.cumsum(key[1:] != key[:-1])])
        found = repeated_starts(group, [x[:a] for a, x in zip(at, raw, strict=True)], [x[a:] for a, x in zip(at, raw, strict=True)], length, gram)
        rows = np.array([i for i, x in enumerate(found) for _ in x], np.int64)
        ranges = np.array([r for x in found for r in x], np.int64).reshape(-1, 2)
        return pa.RecordBatch.from_arrays([pa.array(key[rows]), pa.array(table.column("around").to_numpy()[rows]), pa.array(ranges[:, 0].copy()), pa.array(ranges[:, 1].copy())], ["key", "around", "low", "high"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        rows = 0
        for batch in batches:
            held.append(batch)
            rows += batch.num_rows
            if rows >= 20_000:
                table = pa.Table.from_batches(held)
                key = table.column("key").to_numpy()
                whole = int(np.searchsorted(key, key[-1], "left"))
                if whole:
                    yield solve(table.slice(0, whole))
                    held = table.slice(whole).to_batches()
                    rows -= whole
        if rows:
            yield solve(pa.Table.from_batches(held))

    return cases.select("key", "around", "reach", "bytes").repartition("key").sortWithinPartitions("key").mapInArrow(run, "key long, around long, low long, high long")


def _split(cases: DataFrame, length: int, step: int) -> DataFrame:
    """Each case in ranges of `step` windows, keyed by the core that all windows of a range share."""
    names = ["key", "around", "times", "part_key", "part_around", "least", "reach", "bytes"]

    def digest(*parts: bytes) -> int:
        return int.from_bytes(hashlib.blake2b(b"".join(parts), digest_size=8).digest(), "little", signed=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for key, around, times, least, reach, raw in zip(*[batch.column(c).to_pylist() for c in ("key", "around", "times", "least", "reach", "bytes")], strict=True):
                for s in range(least // step * step, reach + 1, step):
                    low, high = max(s, least), min(s + step - 1, reach)
                    part = raw[reach - high : reach - low + length]
                    head = key.to_bytes(8, "little", signed=True) + s.to_bytes(4, "little")
                    out.append((key, around, times, digest(head, raw[reach - s : reach - s - step + 1 + length]), digest(head, bytes([low - s, high - s]), part), low, high, part))
            columns = list(zip(*out, strict=True)) if out else [()] * 8
            kinds = [pa.int64()] * 5 + [pa.int32()] * 2 + [pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

    return cases.mapInArrow(run, "key long, around long, times long, part_key long, part_around long, least int, reach int, bytes binary")


def _resolve(cases: DataFrame, length: int, gram: int, step: int) -> DataFrame:
    """cases, distinct by (key, around): (key, around, times, least, reach, bytes) -> (key, around, low, high).

    Windows of a case start least..reach bytes before its anchor. A case that occurs twice is repeated as a whole.
    """
    whole = cases.where("times > 1").select("key", "around", F.col("least").cast("long").alias("low"), F.col("reach").cast("long").alias("high"))
    sizes = cases.where("bytes is not null").groupBy("key").agg(F.count("*").alias("members")).where("members > 1")
    open_ = cases.join(sizes, "key")
    out = whole.union(_sorted_groups(open_.where(F.col("members") <= GROUP), length, gram))
    large = kept(open_.where(F.col("members") > GROUP).drop("members"))
    if not large.limit(1).count():
        return out
    parts = kept(_split(large, length, step))
    below = parts.groupBy(F.col("part_key").alias("key"), F.col("part_around").alias("around")).agg(F.sum("times").alias("times"), F.first("least").alias("least"), F.first("reach").alias("reach"), F.first("bytes").alias("bytes"))
    found = _resolve(kept(below), length, gram, step // PARTS or 1).select(F.col("key").alias("part_key"), F.col("around").alias("part_around"), "low", "high")
    return out.union(parts.select("key", "around", "part_key", "part_around").join(found, ["part_key", "part_around"]).select("key", "around", "low", "high"))


def repeated_spans(docs: DataFrame, length: int, gram: int) -> DataFrame:
    """docs (id, rid, text) -> (id, rid, start, end): byte ranges covered by repeated strings, not merged."""
    grams = kept(_grams(docs, length, gram).groupBy("gram").agg(F.count("*").alias("n"), F.min("around").alias("a"), F.max("around").alias("b")).where("n > 1").select("gram", (F.col("a") != F.col("b")).alias("mixed")))
    context = docs.sparkSession.sparkContext
    wanted, mixed = context.broadcast(_bloom.build(grams, "gram", 25)), context.broadcast(_bloom.build(grams.where("mixed"), "gram", 25))
    members = kept(_members(docs, length, gram, wanted, mixed))
    cases = members.groupBy(F.col("gram").alias("key"), "around").agg(F.count("*").alias("times"), F.first(F.col("at") - F.col("hi")).cast("int").alias("least"), F.first(F.col("at") - F.col("lo")).cast("int").alias("reach"), F.first("bytes").alias("bytes"))
    found = _resolve(kept(cases), length, gram, 1 << 5)
    return members.select("id", "rid", F.col("gram").alias("key"), "around", "at").join(found, ["key", "around"]).select("id", "rid", (F.col("at") - F.col("high")).alias("start"), (F.col("at") - F.col("low") + length).alias("end"))


def suffix_dedup(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", length: int = 200, gram: int = GRAM) -> DataFrame:
    """One row for each row of docs: (id_column, n_bytes, n_removed, n_spans, kept_sha256, spans).

    Texts are UTF-8 bytes (null: empty). A byte is removed if a string of `length` bytes that covers it also starts
    anywhere else in any text, the same one included; strings never cross texts and are judged on the input. spans are
    the maximal removed ranges (start, end), n_spans their number, kept_sha256 the digest of the other bytes.

    `gram` must be below `length`; it changes speed only. Repeated rows are copies of each other like any equal texts.
    Null ids come out as they come in. Other columns are not read. An empty table gives an empty one.
    """
    docs = _marked(docs.select(F.col(id_column).cast("long").alias("id"), F.coalesce(F.col(text_column), F.lit("")).alias("text")))
    spans = repeated_spans(docs.select("id", "rid", "text"), length, gram).groupBy("id", "rid").agg(F.collect_set(F.struct("start", "end")).alias("found"))
    both = docs.alias("d").join(spans.alias("s"), (F.col("d.rid") == F.col("s.rid")) & F.col("d.id").eqNullSafe(F.col("s.id")), "left").select("d.id", "d.text", "s.found")
    kinds = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, offsets in pieces(batch, "text"):
                found, rows = part.column("found"), []
                for i in range(part.num_rows):
                    raw = data[offsets[i] : offsets[i + 1]]
                    spans_ = _merged(found[i])
                    kept_ = cut(raw, spans_)
                    rows.append((len(raw), len(raw) - len(kept_), len(spans_), hashlib.sha256(kept_).hexdigest(), [{"start": a, "end": b} for a, b in spans_]))
                types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), kinds]
                yield pa.RecordBatch.from_arrays([part.column("id"), *[pa.array(c, k) for c, k in zip(zip(*rows, strict=True), types, strict=True)]], ["id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans"])

    return both.mapInArrow(run, "id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<start:long,end:long>>").withColumnRenamed("id", id_column)


def _merged(found: pa.Scalar) -> list[tuple[int, int]]:
    if not found.is_valid:
        return []
    start, end = found.values.field(0).to_numpy(), found.values.field(1).to_numpy()
    order = np.argsort(start, kind="stable")
    start, end = start[order], np.maximum.accumulate(end[order])
    new = np.concatenate([[True], start[1:] > end[:-1]])
    first = np.flatnonzero(new)
    return list(zip(start[first].tolist(), end[np.append(first[1:], len(start)) - 1].tolist(), strict=True))
