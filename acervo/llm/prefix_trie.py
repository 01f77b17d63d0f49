"""A trie of conversations' turn prefixes, from sorted sequences and range-minimum searches.

A turn is 128 bits of hash, a conversation the bytes of its turns, so byte order puts equal prefixes side by side and a prefix before
what extends it. Sequences are range-partitioned by (bytes, id); many equal ones spread over partitions by their ids.
Within a partition an array holds the turns that each sequence shares with the one before, with a sparse table of range minima over it.
Each candidate prefix binary-searches its right extent there, and each branching point its left extent, one independent of the
other; sums over the interval of members come from running sums.

A node is complete in its partition unless its prefix goes on in a neighbour. Those few, at most the prefixes of a partition's first
and last sequences, leave partial sums keyed by the prefix's hash, which are then added up. A node's sums over its subtree
are sums over its members: each member's words from the node on, less the words of the nodes that it is the first to hold.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from acervo.llm._text import kept

WORDS = r"[^\x20\x09-\x0D]+"
TURN_BYTES = 16
#: Turns and conversations of a partition: memory and speed only.
PART = 1 << 16
#: Ids in a piece of a node's list that is digested over partitions.
PIECE = 1 << 16
#: Nodes over several partitions up to which they are sent to all tasks: some MB.
SENT_NODES = 50_000
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
FOUND = "kind int, key binary, parent_key binary, conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string, first_end long, ends string"
COMPLETE, SHARED, ENDS = range(3)


def sequences(turns: DataFrame, id_column: str = "conv_id", turn_column: str = "turn", role_column: str = "role", text_column: str = "text") -> DataFrame:
    """(id, turns array<struct<turn,hash,words>>): each conversation's turns in order; ties of turn by hash."""
    role, text = F.coalesce(F.col(role_column), F.lit("")), F.coalesce(F.col(text_column), F.lit(""))
    digest = F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary"))
    rows = turns.where(F.col(id_column).isNotNull()).select(F.col(id_column).cast("long").alias("id"), F.struct(F.col(turn_column).alias("turn"), digest.alias("hash"), F.regexp_count(text, F.lit(WORDS)).alias("words")).alias("t"))
    return rows.groupBy("id").agg(F.array_sort(F.collect_list("t")).alias("turns"))


def rebuilt(chats: DataFrame, period: int = 20, most: int = 3) -> DataFrame:
    """Conversation c begins with the first h turns of c - c % period, then come its own after its first h; h = crc32(c) % (most + 1)."""
    heads = chats.where(F.col("id") % period == 0).select(F.col("id").alias("base"), F.slice("turns", 1, most).alias("head"))
    h = (F.crc32(F.col("id").cast("string").cast("binary")) % (most + 1)).cast("int")
    joined = chats.withColumn("base", F.col("id") - F.col("id") % period).join(heads, "base", "left").withColumn("h", h)
    own = F.slice("turns", F.col("h") + 1, F.size("turns"))
    return joined.select("id", F.concat(F.coalesce(F.slice("head", F.lit(1), F.col("h")), F.slice("turns", 1, 0)), own).alias("turns"))


def prefix_trie(chats: DataFrame, part: int = PART) -> DataFrame:
    """One row a node of the trie over chats (id long, turns array<struct<..., hash, words>>, hash 32 hex digits), ids distinct.

    (conv_id: smallest member, depth, parent_conv_id: the parent's, null for the root; n_convs: members; n_children;
    n_leaves: childless nodes in the subtree, the node included; saved_tokens: sum over the subtree of (n_convs - 1) * words
    of the node's last turn; ends_sha256: SHA-256 of the decimal ids of the members that end here, ascending, joined by commas).

    Conversations without turns are members of the root. Equal conversations are members of the same nodes, and equal
    turns in a row count each by itself. An empty table gives no node. One conversation's hashes are held by one row. The ids that
    end at one node pass through one task as a stream, since the digest of a list can't be split.
    """
    rows = kept(chats.select("id", F.unhex(F.array_join(F.transform("turns", lambda t: t["hash"]), "")).alias("seq"), F.transform("turns", lambda t: t["words"].cast("int")).alias("words")))
    size = rows.agg(F.sum(F.size("words") + 1)).first()[0] or 0
    parts = -(-size // part) or 1
    placed = rows.repartitionByRange(parts, "seq", "id").withColumn("part", F.spark_partition_id()) if parts > 1 else rows.withColumn("part", F.lit(0))
    placed = kept(placed)
    ends = placed.groupBy("part").agg(F.min("seq").alias("low"), F.max("seq").alias("high"))
    near = Window.orderBy("part")  # one row a partition
    ends = kept(ends.select(F.col("part"), F.lag("high").over(near).alias("before"), F.lead("low").over(near).alias("after")))
    found = kept(placed.groupBy("part").cogroup(ends.groupBy("part")).applyInArrow(_nodes, FOUND))

    sums = [F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")]
    shared = found.where(F.col("kind") == SHARED).groupBy("key").agg(F.max("parent_key").alias("parent_key"), F.min("conv_id").alias("conv_id"), F.max("depth").alias("depth"), *sums)
    lists = found.where(F.col("kind") == ENDS).select("key", "first_end", "ends").repartition("key").sortWithinPartitions("key", "first_end")
    digests = lists.mapInArrow(_digests, "key binary, ends_sha256 string")
    shared = kept(shared.join(digests, "key", "left").withColumn("ends_sha256", F.coalesce("ends_sha256", F.sha2(F.lit("").cast("binary"), 256))))
    names = shared.select(F.col("key").alias("parent_key"), F.col("conv_id").alias("named"))
    names = F.broadcast(names) if shared.count() <= SENT_NODES else names
    whole = found.where(F.col("kind") == COMPLETE).select("parent_key", *COLUMNS).unionByName(shared.withColumn("parent_conv_id", F.lit(None).cast("long")).select("parent_key", *COLUMNS))
    return whole.join(names, "parent_key", "left").withColumn("parent_conv_id", F.coalesce("parent_conv_id", "named")).select(*COLUMNS)


class Minima:
    """A sparse table of range minima."""

    def __init__(self, values: np.ndarray):
        self.levels = [values]
        while 2 << (len(self.levels) - 1) <= len(values):
            half, last = 1 << (len(self.levels) - 1), self.levels[-1]
            self.levels.append(np.minimum(last[:-half], last[half:]))

    def right(self, at: np.ndarray, least: np.ndarray) -> np.ndarray:
        """Largest r for which no value in (at, r] is below `least`."""
        at, n = at + 1, len(self.levels[0])
        for k, level in reversed(list(enumerate(self.levels))):
            inside = at + (1 << k) <= n
            at = at + ((inside & (level[np.where(inside, at, 0)] >= least)).astype(np.int64) << k)
        return at - 1

    def left(self, at: np.ndarray, least: np.ndarray) -> np.ndarray:
        """Smallest l for which no value in (l, at] is below `least`."""
        for k, level in reversed(list(enumerate(self.levels))):
            start = at - (1 << k) + 1
            inside = start > 0
            at = at - ((inside & (level[np.where(inside, start, 0)] >= least)).astype(np.int64) << k)
        return at

    def least(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """Minima over [lo, hi]."""
        k = np.frexp((hi - lo + 1).astype(np.float64))[1] - 1
        out = np.empty(len(lo), self.levels[0].dtype)
        for step in np.unique(k):
            at = k == step
            out[at] = np.minimum(self.levels[step][lo[at]], self.levels[step][hi[at] - (1 << int(step)) + 1])
        return out


def _same(a: bytes, b: bytes) -> int:
    """Turns that two sequences share at their beginning."""
    n = min(len(a), len(b)) // TURN_BYTES * 2
    differ = np.flatnonzero(np.frombuffer(a, np.uint64, n) != np.frombuffer(b, np.uint64, n))
    return int(differ[0] if len(differ) else n) // 2


def _shared_turns(blocks: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Turns that each sequence shares with the one before; 0 for the first."""
    most = np.minimum(sizes[1:], sizes[:-1])
    at = np.arange(most.sum()) - np.repeat(np.cumsum(most) - most, most)
    differ = np.any(blocks[np.repeat(starts[1:], most) + at] != blocks[np.repeat(starts[:-1], most) + at], axis=1)
    out = np.concatenate([[0], most])
    np.minimum.at(out, np.repeat(np.arange(1, len(sizes)), most)[differ], at[differ])
    return out


def _prefix_keys(seq: bytes, most: int) -> list[bytes]:
    """Hashes of the prefixes of 0 to `most` turns."""
    running, out = hashlib.blake2b(digest_size=16), []
    for i in range(most + 1):
        out.append(running.copy().digest())
        running.update(seq[i * TURN_BYTES : (i + 1) * TURN_BYTES])
    return out


def _nodes(rows: pa.Table, ends: pa.Table) -> pa.Table:
    """The nodes of one range of sequences: whole ones, and the parts of those that neighbours share."""
    rows = rows.sort_by([("seq", "ascending"), ("id", "ascending")])
    ids, seqs, words = rows.column("id").to_numpy(), rows.column("seq").combine_chunks(), rows.column("words").combine_chunks()
    before, after = ends.column("before")[0].as_py(), ends.column("after")[0].as_py()
    n = len(ids)
    sizes = np.diff(np.frombuffer(seqs.buffers()[1], np.int32, n + 1, seqs.offset * 4)).astype(np.int64) // TURN_BYTES
    starts = np.cumsum(sizes) - sizes
    blocks = np.frombuffer(b"".join(seqs.to_pylist()), np.uint64).reshape(-1, 2)
    first, last = seqs[0].as_py(), seqs[n - 1].as_py()
    back = -1 if before is None else _same(before, first)
    ahead = -1 if after is None else _same(last, after)

    same = _shared_turns(blocks, starts, sizes)
    minima, smallest = Minima(same), Minima(ids)
    below = np.concatenate([[-1], same[1:]])  # the depth up to which an earlier row of this range holds a row's prefixes
    known = np.concatenate([[back], same[1:]])  # and any earlier row
    counts = sizes - below
    offsets = np.cumsum(counts) - counts
    row = np.repeat(np.arange(n), counts)
    depth = np.arange(counts.sum()) - offsets[row] + below[row] + 1
    right = minima.right(row, depth)
    branch = minima.left(np.arange(n), same)
    owner = offsets[branch] + same - below[branch] - 1  # the node at which a row leaves the rows before it
    parent = np.where(depth - 1 > below[row], np.arange(len(row)) - 1, owner[row])

    total = np.concatenate([[0], np.cumsum(words.flatten().to_numpy().astype(np.int64))])
    upto = lambda i, d: total[starts[i] + np.maximum(d, 0)] - total[starts[i]]
    running = lambda x: np.concatenate([[0], np.cumsum(x)])
    every = np.arange(n)
    all_words, new_words = running(upto(every, sizes)), running(upto(every, sizes) - upto(every, known))
    leaves = running(np.concatenate([same[1:], [ahead]]) < sizes)
    members = right - row + 1
    children = ((known[row] <= depth) & (depth < sizes[row])).astype(np.int64)
    leaving = every[1:][sizes[1:] > same[1:]]
    np.add.at(children, owner[leaving], 1)
    held = all_words[right + 1] - all_words[row] - members * upto(row, depth - 1)
    once = new_words[right + 1] - new_words[row + 1] + upto(row, sizes[row]) - upto(row, np.maximum(known[row], depth - 1))

    from_before, to_after = (row == 0) & (depth <= back), (right == n - 1) & (depth <= ahead)
    shared = from_before | to_after
    keys: list[bytes | None] = [None] * len(row)
    for mine, seq in ((from_before, first), (to_after, last)):
        at = np.flatnonzero(mine)
        names = _prefix_keys(seq, int(depth[at].max(initial=0)))
        for i in at.tolist():
            keys[i] = names[depth[i]]
    conv = smallest.least(row, right)

    runs = np.flatnonzero(np.concatenate([[True], (same[1:] < sizes[1:]) | (same[1:] < sizes[:-1])]))
    digest: list[str | None] = [None] * len(row)
    pieces: list[tuple[bytes, int, str]] = []
    for lo, hi in zip(runs.tolist(), np.append(runs[1:], n).tolist(), strict=True):
        node = int(offsets[lo] + counts[lo] - 1)
        if shared[node]:
            pieces += [(keys[node], int(ids[i]), ",".join(map(str, ids[i : min(i + PIECE, hi)].tolist()))) for i in range(lo, hi, PIECE)]
        else:
            digest[node] = hashlib.sha256(",".join(map(str, ids[lo:hi].tolist())).encode()).hexdigest()
    empty = hashlib.sha256(b"").hexdigest()
    has_parent, parent = depth > 0, np.where(depth > 0, parent, 0)
    outside = has_parent & shared[parent]
    nodes = [
        pa.array(np.where(shared, SHARED, COMPLETE), pa.int32()),
        pa.array(keys, pa.binary()),
        pa.array([keys[p] if o else None for p, o in zip(parent.tolist(), outside.tolist(), strict=True)], pa.binary()),
        pa.array(conv),
        pa.array(depth),
        pa.array(conv[parent], mask=~has_parent | outside),
        *[pa.array(x.astype(np.int64)) for x in (members, children, leaves[right + 1] - leaves[row], held - once)],
        pa.array([None if s else d or empty for d, s in zip(digest, shared.tolist(), strict=True)], pa.string()),
        pa.nulls(len(row), pa.int64()),
        pa.nulls(len(row), pa.string()),
    ]
    none = [pa.nulls(len(pieces), a.type) for a in nodes]
    lists = [pa.array([ENDS] * len(pieces), pa.int32()), pa.array([p[0] for p in pieces], pa.binary()), *none[2:11], pa.array([p[1] for p in pieces], pa.int64()), pa.array([p[2] for p in pieces], pa.string())]
    names = [x.split()[0] for x in FOUND.split(", ")]
    return pa.concat_tables([pa.table(nodes, names), pa.table(lists, names)])


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of each key's pieces in order, joined by commas; a piece is held at a time."""
    key, running = None, None
    done = lambda: pa.RecordBatch.from_arrays([pa.array([key], pa.binary()), pa.array([running.hexdigest()])], ["key", "ends_sha256"])
    for batch in batches:
        for k, piece in zip(batch.column("key").to_pylist(), batch.column("ends"), strict=True):
            if k != key:
                if key is not None:
                    yield done()
                key, running = k, hashlib.sha256()
            else:
                running.update(b",")
            running.update(piece.as_py().encode())
    if key is not None:
        yield done()
