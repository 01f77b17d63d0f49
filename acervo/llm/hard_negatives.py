"""Hard negatives for anchors, by Fagin's threshold algorithm over blocks of candidates.

Components become integers, so scores are exact. Candidates are dealt into blocks by a hash of their ids and anchors into
chunks; each pair of a block and a chunk is one bounded group. A block sorts its rows once for each dimension. An anchor reads
those lists from the end that its component's sign favours, scores the rows it meets at random access, and stops once the
threshold, its score for the values just read, is strictly below what each search still needs: the kth score found in a window,
or the window's lower end while fewer are found. Unseen rows score the threshold at most, so nothing is lost, ties included.

Two passes: the best rows of the anchor's own label, whose scores set the windows, then the best rows of other labels in each
window. Blocks give their best few for each anchor, which are ranked over all blocks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from acervo.llm._text import kept

#: Candidates of a block and anchors of a chunk: memory and speed only.
BLOCK, CHUNK = 1 << 13, 1 << 11
#: Rows that each list gives at first; later accesses double what was read.
FIRST = 64


class Lists:
    """A block's rows and, for each dimension, their order by falling component."""

    def __init__(self, rows: np.ndarray):
        self.rows, self.order = rows, np.argsort(-rows, axis=0, kind="stable").astype(np.int32)
        self.sorted = np.take_along_axis(rows, self.order, 0)
        self.most = int(np.abs(rows).max(initial=0))
        self.forms: dict[type, np.ndarray] = {}

    def _form(self, anchor: np.ndarray) -> np.ndarray:
        """The rows in the smallest type that holds all partial sums with this anchor exactly."""
        bound = self.most * sum(map(abs, anchor.tolist()))
        kind = next((k for k, bits in ((np.float32, 24), (np.float64, 53), (np.int64, 63)) if bound < 1 << bits), object)
        if kind not in self.forms:
            self.forms[kind] = self.rows.astype(kind)
        return self.forms[kind]

    def accesses(self, anchor: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, int | None]]:
        """(rows met for the first time, their scores, threshold for rows not met yet), until all rows are met; then no threshold."""
        n = len(self.rows)
        form = self._form(anchor)
        weights, up, down = anchor.astype(form.dtype), np.flatnonzero(anchor > 0), np.flatnonzero(anchor < 0)
        unseen, depth = np.ones(n, bool), 0
        while n:
            reach = min(n, depth + max(FIRST, depth)) if len(up) or len(down) else n
            new = np.zeros(n, bool)
            new[self.order[depth:reach, up].ravel()] = True
            new[self.order[n - reach : n - depth, down].ravel()] = True
            at = np.flatnonzero(new & unseen if reach < n else unseen)
            unseen[at] = False
            scores = form[at] @ weights
            if reach == n:
                yield at, scores, None
                return
            last = np.concatenate([self.sorted[reach - 1, up], self.sorted[n - reach, down]]).tolist()
            yield at, scores, sum(x * y for x, y in zip(np.concatenate([anchor[up], anchor[down]]).tolist(), last, strict=True))
            depth = reach


def _best(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores, ties by smaller id."""
    return np.lexsort((ids, -scores))[:k]


def _search(lists: Lists, ids: np.ndarray, anchor: np.ndarray, able: np.ndarray, windows: list[tuple[int, int]] | None, k: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """(ids, scores) of the k best able rows in each window (low, high); without windows, of all able rows."""
    seen_ids, seen = np.zeros(0, np.int64), None
    for at, scores, threshold in lists.accesses(anchor):
        at, scores = at[able[at]], scores[able[at]]
        seen_ids, seen = np.concatenate([seen_ids, ids[at]]), scores if seen is None else np.concatenate([seen, scores])
        if threshold is not None and all(threshold < need for need in _needs(seen, windows, k)):
            break
    if seen is None:
        return []
    out = []
    for low, high in windows if windows is not None else [(None, None)]:
        inside = np.flatnonzero((seen >= low) & (seen <= high)) if low is not None else np.arange(len(seen))
        best = inside[_best(seen_ids[inside], seen[inside], k)]
        out.append((seen_ids[best], seen[best]))
    return out


def _needs(seen: np.ndarray, windows: list[tuple[int, int]] | None, k: int) -> Iterator[float]:
    """For each window, the score that an unseen row must reach to change its result."""
    for low, high in windows if windows is not None else [(float("-inf"), float("inf"))]:
        inside = seen[(seen >= low) & (seen <= high)] if windows is not None else seen
        yield np.partition(inside, len(inside) - k)[len(inside) - k] if len(inside) >= k else low


def _matrix(column: pa.ChunkedArray, width: int) -> np.ndarray:
    whole = column.combine_chunks()
    return (whole.flatten().to_numpy() if len(whole) else np.zeros(0, np.int64)).reshape(len(whole), width)


def _grouped(rows: DataFrame, queries: DataFrame, blocks: int, chunks: int, work: Callable, schema: str) -> DataFrame:
    """work(lists, ids, labels, query) -> rows, for each query in each block of rows with as many components."""
    names = [x.split()[0] for x in schema.split(", ")]

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        found: list[tuple] = []
        if left.num_rows and right.num_rows:
            width = left.column("width")[0].as_py()
            lists, ids, labels = Lists(_matrix(left.column("v"), width)), left.column("id").to_numpy(), left.column("label").to_numpy()
            vectors = _matrix(right.column("v"), width)
            for i, query in enumerate(right.drop_columns(["v"]).to_pylist()):
                found += work(lists, ids, labels, vectors[i], query)
        return pa.table([pa.array([r[i] for r in found], pa.int64()) for i in range(len(names))], names)

    rows = rows.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int")).withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))))
    queries = queries.withColumn("chunk", F.pmod(F.xxhash64("id"), F.lit(chunks)).cast("int")).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    key = ["width", "block", "chunk"]
    return rows.groupBy(*key).cogroup(queries.groupBy(*key)).applyInArrow(run, schema)


def hard_negatives(vectors: DataFrame, anchors: Column, id_column: str = "vec_id", vector_column: str = "embedding", label_column: str = "label", positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90, scale: int = 256) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score), by integer inner products of floor(scale * x).

    Anchors are the rows for which the condition `anchors` holds. An anchor's positives are its best other rows of the same label;
    for each, the best rows of other labels with low * positive_score <= 100 * negative_score <= high * positive_score are
    ranked from 1. Higher scores come first, ties by smaller id. Fewer rows are given where fewer exist.

    Rows with a null id, label or vector, or with a null or non-finite component, take no part. Rows that repeat an id are one: that with
    the smallest label, then the smallest vector. Rows meet only rows with as many components; without components, and for an
    anchor of zeros, all scores are 0. Components beyond a long stop at its ends, as Spark's floor does; so do scores. Other
    columns are read by the condition only. An empty table, or no anchors, gives an empty one.
    """
    x = lambda c: c.cast("double")
    finite = F.forall(F.col(vector_column), lambda c: F.coalesce(~F.isnan(x(c)) & (F.abs(x(c)) < float("inf")), F.lit(False)))
    rows = vectors.where(F.col(id_column).isNotNull() & F.col(label_column).isNotNull() & F.col(vector_column).isNotNull() & finite)
    rows = rows.select(F.col(id_column).cast("long").alias("id"), F.struct(F.col(label_column).cast("long").alias("label"), F.transform(vector_column, lambda c: F.floor(scale * x(c))).alias("v"), F.coalesce(anchors, F.lit(False)).alias("anchor")).alias("r"))
    rows = kept(rows.groupBy("id").agg(F.min("r").alias("r")).select("id", "r.*", F.size("r.v").alias("width")))
    sizes = rows.agg(F.count("*"), F.count_if("anchor")).first()
    blocks, chunks = max(1, -(-sizes[0] // BLOCK)), max(1, -(-sizes[1] // CHUNK))
    heads = kept(rows.where("anchor").drop("anchor"))
    rows = rows.drop("anchor")

    def near(lists: Lists, ids: np.ndarray, labels: np.ndarray, vector: np.ndarray, query: dict) -> list[tuple]:
        able = (labels == query["label"]) & (ids != query["id"])
        return [(query["id"], i, _long(s)) for found, scores in _search(lists, ids, vector, able, None, positives) for i, s in zip(found.tolist(), scores.tolist(), strict=True)]

    def hard(lists: Lists, ids: np.ndarray, labels: np.ndarray, vector: np.ndarray, query: dict) -> list[tuple]:
        windows = [(p, p["score"], -(-low * p["score"] // 100), high * p["score"] // 100) for p in query["positives"]]
        windows = [w for w in windows if w[2] <= w[3]]
        if not windows:
            return []
        found = _search(lists, ids, vector, labels != query["label"], [w[2:] for w in windows], negatives)
        return [(query["id"], w[0]["id"], i, w[1], _long(s)) for w, (at, scores) in zip(windows, found, strict=False) for i, s in zip(at.tolist(), scores.tolist(), strict=True)]

    found = _grouped(rows, heads, blocks, chunks, near, "anchor_id long, id long, score long")
    place = F.row_number().over(Window.partitionBy("anchor_id").orderBy(F.col("score").desc(), "id"))
    first = kept(found.withColumn("place", place).where(F.col("place") <= positives).drop("place"))
    listed = first.groupBy(F.col("anchor_id").alias("id")).agg(F.collect_list(F.struct("id", "score")).alias("positives"))
    found = _grouped(rows, heads.join(listed, "id"), blocks, chunks, hard, "anchor_id long, positive_id long, negative_id long, positive_score long, negative_score long")
    rank = F.row_number().over(Window.partitionBy("anchor_id", "positive_id").orderBy(F.col("negative_score").desc(), "negative_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= negatives).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def _long(score: float) -> int:
    return max(-(1 << 63), min((1 << 63) - 1, int(score)))
