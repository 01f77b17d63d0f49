"""Hybrid search of chunks for many queries at once: cosine and BM25 ranks, fused.

Each task scores its chunks for a block of queries with two matrix products. The first pass keeps, for each query and measure, the
best few rows of a task, which is what leaves it. Those are merged into candidates; any other row ranks too low in both lists to
matter. The second pass counts, for each candidate, the rows before it, so ranks are exact over all chunks.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from acervo.operators.retrieval import bucket, tokens

#: Queries scored in one pass: bounds what is broadcast and what a task keeps.
QUERIES = 256


def hashed_vector(text: Column, size: int = 128, first: int = 2000) -> Column:
    """Word counts of the first characters in hash buckets, scaled to unit length, rounded to 6 places; no words: zeros.

    Words and buckets are Spark expressions; an Arrow batch at a time folds a row's buckets into its vector, without a shuffle.
    """

    @F.pandas_udf("array<double>")
    def fold(places: pd.Series) -> pd.Series:
        counts = [np.bincount(p, minlength=size) for p in places]
        return pd.Series([np.round(c / max(np.sqrt((c**2).sum()), 1.0), 6) for c in counts])

    return fold(F.transform(tokens(F.substring(F.coalesce(text, F.lit("")), 1, first)), lambda w: bucket(w, size)))


class Block(NamedTuple):
    """Queries as matrices, and the terms that the rows of the second one stand for."""

    ids: list
    groups: list
    vectors: np.ndarray
    terms: list[str]
    times: np.ndarray


def _block(rows: list) -> Block:
    terms = sorted({t for r in rows for t in r["terms"]})
    place = {t: i for i, t in enumerate(terms)}
    times = np.zeros((len(terms), len(rows)))
    for i, r in enumerate(rows):
        for t in r["terms"]:
            times[place[t], i] += 1
    vectors = np.array([r["vector"] for r in rows], np.float64).T
    return Block([r["id"] for r in rows], [r["group"] for r in rows], vectors / np.maximum(np.sqrt((vectors**2).sum(0)), 1e-300), terms, times)


def _scores(batch: pa.RecordBatch, block: Block, k1: float, b: float, length: float) -> tuple[np.ndarray, np.ndarray]:
    """(rows, queries, 2) of cosine and BM25, and which rows each query may find."""
    n, width = batch.num_rows, block.vectors.shape[0]
    listed = batch.column("vector")
    fits = pc.fill_null(pc.equal(pc.list_value_length(listed), width), False)
    vectors = np.zeros((n, width))
    at = np.flatnonzero(fits.to_numpy(zero_copy_only=False))
    if len(at):
        vectors[at] = pc.list_flatten(listed.filter(fits)).to_numpy(zero_copy_only=False).reshape(-1, width)
    norms = np.sqrt((vectors**2).sum(1, keepdims=True))
    cosine = np.round(vectors @ block.vectors / np.where(norms > 0, norms, 1.0), 6) + 0.0

    words = batch.column("words")
    row = pc.list_parent_indices(words).to_numpy()
    term = pc.index_in(pc.list_flatten(words), pa.array(block.terms, pa.string())).fill_null(-1).to_numpy()
    counts = np.zeros((n, len(block.terms)))
    np.add.at(counts, (row[term >= 0], term[term >= 0]), 1)
    sizes = np.bincount(row, minlength=n).reshape(-1, 1)
    bm25 = np.round((counts * (k1 + 1) / (counts + k1 * (1 - b + b * sizes / length))) @ block.times, 4)
    groups = batch.column("group").to_pylist()
    free = np.array([g is None for g in block.groups])
    able = np.array([[f or g == h for f, g in zip(free, block.groups, strict=True)] for h in groups]) if not free.all() else np.ones((n, len(free)), bool)
    return np.stack([cosine, bm25], axis=2), able


def _slices(batches: Iterator[pa.RecordBatch], most: int = 512) -> Iterator[pa.RecordBatch]:
    """Runs of a few rows: a matrix of rows and terms stays within some MB."""
    for batch in batches:
        for at in range(0, batch.num_rows, most):
            yield batch.slice(at, most)


def _placed(scores: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Rows in the order of ranks: highest score, then smallest key."""
    out = np.empty(len(scores), [("score", np.float64), ("a", np.int64), ("b", np.int64)])
    out["score"], out["a"], out["b"] = -scores, keys[:, 0], keys[:, 1]
    return out


def hybrid_search(chunks: DataFrame, queries: DataFrame, keys: tuple[str, str] = ("doc_id", "chunk"), text: str = "body", vector: str = "vector", group: str | None = None, query: str = "query_id", query_text: str = "text", query_vector: str = "vector", query_group: str | None = None, k: int = 5, base: int = 60, k1: float = 1.5, b: float = 0.75, length: float = 200.0, least: int = 3) -> DataFrame:
    """(query, keys, rank, score, pct, cosine, bm25): the k best chunks of each query by reciprocal ranks.

    score = 1 / (base + rank by cosine) + 1 / (base + rank by BM25), to 5 places; pct = the score before rounding * 3000, to 1 place, 99.9 at most.
    Ties go to the smaller keys, in either list and in the result. BM25 counts the query's words of `least` characters or more, without
    idf and with a fixed mean length. Where query_group is not null, only chunks of that group are searched and ranked.

    Rows with a null key take no part. A null text has no words; a null vector, or one of another length, has cosine 0. Rows that
    repeat a key rank one after the other. Queries come to the driver, QUERIES at a time; chunks never do.
    """
    found = queries.select(F.col(query).alias("id"), F.filter(tokens(F.coalesce(query_text, F.lit(""))), lambda w: F.length(w) >= least).alias("terms"), F.col(query_vector).alias("vector"), (F.col(query_group) if query_group else F.lit(None)).cast("string").alias("group")).where("id IS NOT NULL")
    a, c = keys
    rows = chunks.where(F.col(a).isNotNull() & F.col(c).isNotNull()).select(F.col(a).cast("long").alias("a"), F.col(c).cast("long").alias("b"), (F.col(group) if group else F.lit(None)).cast("string").alias("group"), tokens(F.coalesce(text, F.lit(""))).alias("words"), F.col(vector).cast("array<double>").alias("vector"))
    out, part = None, []
    for r in found.toLocalIterator():
        part.append(r)
        if len(part) == QUERIES:
            out, part = _joined(out, _search(rows, _block(part), k, base, k1, b, length)), []
    if part or out is None:
        out = _joined(out, _search(rows, _block(part), k, base, k1, b, length) if part else None)
    if out is None:
        out = rows.sparkSession.createDataFrame([], "query long, a long, b long, rank int, score double, pct double, cosine double, bm25 double")
    return out.select(F.col("query").cast(queries.schema[query].dataType).alias(query), F.col("a").alias(a), F.col("b").alias(c), "rank", "score", "pct", "cosine", "bm25")


def _joined(one: DataFrame | None, other: DataFrame | None) -> DataFrame | None:
    return one.union(other) if one is not None and other is not None else one if one is not None else other


def _search(rows: DataFrame, block: Block, k: int, base: int, k1: float, b: float, length: float) -> DataFrame:
    spark = rows.sparkSession
    depth = 2 * (base + k)  # 2 / (base + depth + 1), the most for any other row, is below 1 / (base + k), the least of the k best
    sent = spark.sparkContext.broadcast(block)

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}
        for batch in _slices(batches):
            scores, able = _scores(batch, sent.value, k1, b, length)
            keys = np.stack([batch.column(x).to_numpy() for x in "ab"], axis=1)
            for q in range(scores.shape[1]):
                at = np.flatnonzero(able[:, q])
                for measure in (0, 1):
                    mine, values = keys[at], scores[at, q]
                    if (q, measure) in held:
                        mine, values = np.concatenate([held[q, measure][0], mine]), np.concatenate([held[q, measure][1], values])
                    top = np.lexsort((mine[:, 1], mine[:, 0], -values[:, measure]))[:depth]
                    held[q, measure] = mine[top], values[top]
        if held:
            out = [(q, *key, *value) for (q, _), (mine, values) in held.items() for key, value in zip(mine.tolist(), values.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate((pa.int32(), pa.int64(), pa.int64(), pa.float64(), pa.float64()))], ["q", "a", "b", "cosine", "bm25"])

    near = rows.mapInArrow(best, "q int, a long, b long, cosine double, bm25 double").distinct()
    place = lambda measure: F.row_number().over(Window.partitionBy("q").orderBy(F.desc(measure), "a", "b"))
    near = near.withColumns({"v": place("cosine"), "l": place("bm25")}).where((F.col("v") <= depth) | (F.col("l") <= depth)).drop("v", "l").toArrow()  # 2 * depth rows a query at most
    own = near.column("q").to_numpy()
    order = np.argsort(own, kind="stable")
    keys = np.stack([near.column(x).to_numpy() for x in "ab"], axis=1)[order]
    values = np.stack([near.column(x).to_numpy() for x in ("cosine", "bm25")], axis=1)[order]
    bounds = np.searchsorted(own[order], np.arange(len(block.ids) + 1))
    marks = spark.sparkContext.broadcast((keys, values, bounds))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, values, bounds = marks.value
        before = np.zeros((len(keys), 2), np.int64)
        for batch in _slices(batches):
            scores, able = _scores(batch, sent.value, k1, b, length)
            mine = np.stack([batch.column(x).to_numpy() for x in "ab"], axis=1)
            for q in range(len(bounds) - 1):
                at, lo, hi = np.flatnonzero(able[:, q]), bounds[q], bounds[q + 1]
                for measure in (0, 1):
                    order = at[np.lexsort((mine[at, 1], mine[at, 0], -scores[at, q, measure]))]
                    ordered = _placed(scores[order, q, measure], mine[order])
                    before[lo:hi, measure] += np.searchsorted(ordered, _placed(values[lo:hi, measure], keys[lo:hi]))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(keys))), pa.array(before[:, 0]), pa.array(before[:, 1])], ["i", "v", "l"])

    ranks = rows.mapInArrow(count, "i long, v long, l long").groupBy("i").agg(F.sum("v").alias("v"), F.sum("l").alias("l"))
    listed = pa.table([pa.array(np.arange(len(keys))), pa.array([block.ids[i] for i in own[order]]), pa.array(keys[:, 0]), pa.array(keys[:, 1]), pa.array(values[:, 0]), pa.array(values[:, 1])], ["i", "query", "a", "b", "cosine", "bm25"])
    scored = spark.createDataFrame(listed).join(ranks, "i").withColumn("raw", 1 / (base + 1 + F.col("v")) + 1 / (base + 1 + F.col("l"))).withColumn("score", F.round("raw", 5))
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "a", "b"))
    return scored.withColumn("rank", rank).where(F.col("rank") <= k).select("query", "a", "b", "rank", "score", F.least(F.lit(99.9), F.round(F.col("raw") * 3000, 1)).alias("pct"), "cosine", "bm25")
