"""Benchmark decontamination: a BM25 inverted index of test items, searched by block-max WAND.

Every passage of every training text is a query. Passages in which no item can reach its threshold, by the impacts of
their rare terms and the most that frequent terms could add, are passed over at once; the others run block-max WAND over the
posting lists and retrieve all items above it. Items that are retrieved count as leaked when their question and answer
words overlap the text around the passage.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from acervo.llm._text import U64, pieces, shingle_hashes, signed, word_bounds, words

#: BM25 constants; postings a block; items an index holds at most (more are dealt to several indexes, by the statistics of all).
K1, B, BLOCK, ITEMS = 1.2, 0.75, 64, 20_000


class Statistics:
    """Of all items: how many there are, their mean and largest number of words, and the sorted words with the items that hold each."""

    def __init__(self, items: DataFrame):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for _, data, offsets in pieces(batch, "text"):
                    starts, _, hashes = words(data, offsets)
                    at = word_bounds(starts, offsets)
                    sizes = np.diff(at)
                    terms = [np.unique(hashes[a:b]) for a, b in zip(at[:-1], at[1:], strict=True)]
                    found, times = np.unique(np.concatenate([*terms, np.zeros(0, U64)]), return_counts=True)
                    none = pa.nulls(1, pa.int64())
                    yield pa.RecordBatch.from_arrays([none, pa.array([len(sizes)]), pa.array([int(sizes.sum())]), pa.array([int(sizes.max(initial=0))])], ["term", "n", "total", "longest"])
                    yield pa.RecordBatch.from_arrays([pa.array(signed(found)), pa.array(times), pa.nulls(len(found), pa.int64()), pa.nulls(len(found), pa.int64())], ["term", "n", "total", "longest"])

        rows = items.select("text").mapInArrow(run, "term long, n long, total long, longest long").groupBy("term").agg(F.sum("n").alias("n"), F.sum("total").alias("total"), F.max("longest").alias("longest"))
        # without nulls, as pandas would make floats of the words
        rows = rows.withColumn("term", F.coalesce("term", F.lit(0).cast("long"))).toPandas()
        whole = rows[rows["total"].notna()]
        self.count, self.longest = int(whole["n"].sum()), int(whole["longest"].max()) if len(whole) else 0
        self.mean = max(int(whole["total"].sum()) / self.count, 1.0) if self.count else 1.0
        own = rows[rows["total"].isna()]
        terms = own["term"].to_numpy(np.int64).view(U64)
        order = np.argsort(terms)
        self.terms, self.frequency = terms[order], own["n"].to_numpy(np.int64)[order]


class Index:
    """Posting lists with block maxima. Impacts are divided by what an item needs to be retrieved, so 1 is the threshold of all.

    An item needs `threshold` of the score that its own text has, or less where a text that passes the overlap check may have
    less: of n distinct runs of words, (1 - overlap) * n may be missing, and a text that lacks so many runs lacks as many
    words at most (times as often as a run repeats). The words that bring the item most are counted as missing.
    """

    def __init__(self, ids: list[int], texts: list[str], answer_share: float, ngram: int, threshold: float, overlap: float, of_all: Statistics):
        raw = [t.encode() for t in texts]
        data, offsets = np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(x) for x in raw])]).astype(np.int64)
        starts, _, hashes = words(data, offsets)
        at = word_bounds(starts, offsets)
        self.ids, self.longest = ids, of_all.longest
        self.question: list[np.ndarray] = []
        self.answer: list[np.ndarray] = []
        self.sizes: list[int] = []
        missing: list[int] = []
        lists: dict[int, list[tuple[int, int]]] = {}
        sizes = np.diff(at)
        for i in range(len(ids)):
            own = hashes[at[i] : at[i + 1]]
            cut = max(1, len(own) - max(1, round(len(own) * answer_share)))
            self.sizes.append(min(ngram, len(own)))
            whole = shingle_hashes(own, self.sizes[-1])
            split = min(max(cut - self.sizes[-1] + 1, 1), len(whole))
            self.question.append(np.unique(whole[:split]))
            self.answer.append(np.unique(whole[split:]))
            distinct, repeats = np.unique(whole, return_counts=True)
            runs = len(self.question[-1]) + len(self.answer[-1])
            missing.append(math.floor((1 - overlap) * runs + 1e-9) * int(repeats.max()) * (1 + (runs > len(distinct))))
            terms, times = np.unique(own, return_counts=True)
            for t, n in zip(terms.tolist(), times.tolist(), strict=True):
                lists.setdefault(t, []).append((i, n))
        self.vocabulary = np.array(sorted(lists), U64)
        mean, total = of_all.mean, np.zeros(len(ids))
        holders = of_all.frequency[np.searchsorted(of_all.terms, self.vocabulary)].tolist()
        self.postings: list[tuple[np.ndarray, np.ndarray]] = []
        for t, df in zip(self.vocabulary.tolist(), holders, strict=True):
            items, times = (np.array(x) for x in zip(*lists[t], strict=True))
            idf = np.log(1 + (of_all.count - df + 0.5) / (df + 0.5))
            impact = idf * times * (K1 + 1) / (times + K1 * (1 - B + B * sizes[items] / mean))
            total[items] += impact
            self.postings.append((items, impact))
        own: list[list[float]] = [[] for _ in ids]
        for items, impact in self.postings:
            for i, x in zip(items.tolist(), impact.tolist(), strict=True):
                own[i].append(x)
        lost = np.array([sum(sorted(x, reverse=True)[:k]) for x, k in zip(own, missing, strict=True)])
        self.need = np.maximum(np.minimum(threshold, 1 - lost / total) - 1e-9, 1e-6) if len(ids) else np.zeros(0)
        self.postings = [(i, x / (total[i] * self.need[i])) for i, x in self.postings]
        self.most = np.array([x.max() for _, x in self.postings])
        self.blocks = [np.maximum.reduceat(x, np.arange(0, len(x), BLOCK)) for _, x in self.postings]
        # Lists that cannot bring any item to half the threshold together are left out of the first bound, longest first.
        frequency = np.array([len(i) for i, _ in self.postings], np.int64)
        self.rest, self.first_bound = np.zeros(len(ids)), np.ones(len(self.postings), bool)
        for t in np.argsort(-frequency, kind="stable"):
            items, impact = self.postings[t]
            if frequency[t] < 2 or (self.rest[items] + impact).max() >= 0.5:
                break
            self.rest[items] += impact
            self.first_bound[t] = False
        self.begin = np.concatenate([[0], np.cumsum(frequency)])
        self.items = np.concatenate([i for i, _ in self.postings]) if self.postings else np.zeros(0, np.int64)
        self.impacts = np.concatenate([x for _, x in self.postings]) if self.postings else np.zeros(0)

    def reachable(self, owner: np.ndarray, term: np.ndarray) -> np.ndarray:
        """Owners (windows, sorted) of the given rare terms in which some item can still be retrieved."""
        count = self.begin[term + 1] - self.begin[term]
        place = np.repeat(self.begin[term] - np.concatenate([[0], np.cumsum(count)[:-1]]), count) + np.arange(count.sum())
        item = self.items[place]
        key, inverse = np.unique(np.repeat(owner, count) * len(self.ids) + item, return_inverse=True)
        most = np.bincount(inverse, self.impacts[place], len(key)) + self.rest[key % len(self.ids)]
        return np.unique(key[most >= 1 - 1e-9] // len(self.ids))

    def search(self, terms: np.ndarray, threshold: float = 1.0) -> list[tuple[int, float]]:
        """Block-max WAND: (item, score) of all items that are retrieved; the score is a share of that of the item's own text."""
        out = []
        cursors = [[int(self.postings[t][0][0]), 0, int(t)] for t in terms]  # item, place in the list, term
        while cursors:
            cursors.sort()
            bound, pivot = 0.0, -1
            for k, (_, _, t) in enumerate(cursors):
                bound += self.most[t]
                if bound >= threshold:
                    pivot = k
                    break
            if pivot < 0:
                break
            item = cursors[pivot][0]
            while pivot + 1 < len(cursors) and cursors[pivot + 1][0] == item:
                pivot += 1
            at = [int(np.searchsorted(self.postings[t][0], item)) for _, _, t in cursors[: pivot + 1]]
            tight, jump = 0.0, 1 << 62
            for p, (_, _, t) in zip(at, cursors, strict=False):
                items = self.postings[t][0]
                if p < len(items):
                    tight += self.blocks[t][p // BLOCK]
                    jump = min(jump, int(items[min((p // BLOCK + 1) * BLOCK, len(items)) - 1]) + 1)
            if tight >= threshold:
                score = math.fsum(float(self.postings[t][1][p]) for p, (_, _, t) in zip(at, cursors, strict=False) if p < len(self.postings[t][0]) and self.postings[t][0][p] == item)
                if score >= threshold:
                    out.append((item, score * float(self.need[item])))
                jump = item + 1
            elif pivot + 1 < len(cursors):
                jump = min(jump, cursors[pivot + 1][0])
            jump = max(jump, item + 1)
            moved = []
            for c in cursors[: pivot + 1]:
                items = self.postings[c[2]][0]
                p = int(np.searchsorted(items, jump))
                if p < len(items):
                    moved.append([int(items[p]), p, c[2]])
            cursors = moved + cursors[pivot + 1 :]
        return out


def leaks(docs: DataFrame, benchmark: DataFrame, id_column: str = "doc_id", text_column: str = "text", item_id: str = "item_id", item_text: str = "text", threshold: float = 0.6, ngram: int = 5, overlap: float = 0.8, answer_share: float = 0.5, part_overlap: float = 0.5) -> DataFrame:
    """One row for each leaked item of a text: (id_column, item_id, score, overlap, question_overlap, answer_overlap, first_word).

    Passages are windows of twice the longest item (64 words at least) that overlap by the longest item, so that an item
    of any length lies within one. An item is retrieved when its BM25 score, divided by the score of its own text, reaches
    `threshold`, or the least that a text with the overlap below can have, if that is less: so no leak is missed. It has leaked when `overlap` of its runs of `ngram` words (of its whole text if shorter) stand in the
    window, and `part_overlap` of those of its question and of its answer (the last `answer_share` of its words). The
    best window of a text is reported; first_word is where it begins.

    Null and blank texts and items give no rows. Rows that repeat an id count as one document, and their best window is
    kept. Null ids are one id; items with a null id are left out. Other columns are not read.
    """
    items = _items(benchmark, item_id, item_text)
    limits = overlap, part_overlap
    plain = docs.select(F.col(id_column).cast("long").alias("id"), F.col(text_column).alias("text")).where("text is not null")
    out = _search(plain, *_indexes(items, answer_share, ngram, threshold, overlap), *limits)
    best = out.groupBy("id", "item").agg(F.max(F.struct("overlap", "score", "question_overlap", "answer_overlap", (-F.col("first_word")).alias("back"))).alias("b"))
    return best.select(F.col("id").alias(id_column), F.col("item").alias(item_id), F.round("b.score", 6).alias("score"), F.round("b.overlap", 6).alias("overlap"), F.round("b.question_overlap", 6).alias("question_overlap"), F.round("b.answer_overlap", 6).alias("answer_overlap"), (-F.col("b.back")).alias("first_word"))


def _items(benchmark: DataFrame, item_id: str, item_text: str) -> DataFrame:
    return benchmark.select(F.col(item_id).cast("long").alias("item"), F.col(item_text).alias("text")).where(F.col("item").isNotNull() & F.col("text").isNotNull() & F.col("text").rlike(r"[^\x20\x09-\x0D]"))


def _indexes(items: DataFrame, answer_share: float, ngram: int, threshold: float, overlap: float) -> tuple[list[Broadcast], int]:
    """The indexes of all items, broadcast, and the longest item's number of words."""
    of_all, shared = Statistics(items), []
    shards = max(1, -(-of_all.count // ITEMS))
    for shard in range(shards):
        rows = items.where(F.pmod(F.xxhash64("item"), F.lit(shards)) == shard).orderBy("item", "text").toPandas()
        shared.append(items.sparkSession.sparkContext.broadcast(Index(rows["item"].tolist(), rows["text"].tolist(), answer_share, ngram, threshold, overlap, of_all)))
    return shared, of_all.longest


def _search(docs: DataFrame, shared: list[Broadcast], longest: int, overlap: float, part_overlap: float) -> DataFrame:
    """One pass over the texts: each piece is split into words once and searched in every index."""
    names = ["id", "item", "score", "overlap", "question_overlap", "answer_overlap", "first_word"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stride = max(longest, 32)
        indexes = [(x.value, _Lookup(x.value.vocabulary)) for x in shared]
        for batch in batches:
            for part, data, offsets in pieces(batch, "text"):
                starts, _, hashes = words(data, offsets)
                at = word_bounds(starts, offsets)
                rows = [row for ix, table in indexes for row in _found(ix, table, hashes, at, stride, overlap, part_overlap)]
                if rows:
                    columns = list(zip(*rows, strict=True))
                    kinds = [pa.int64(), pa.float64(), pa.float64(), pa.float64(), pa.float64(), pa.int64()]
                    yield pa.RecordBatch.from_arrays([part.column("id").take(pa.array(columns[0])), *[pa.array(c, k) for c, k in zip(columns[1:], kinds, strict=True)]], names)

    return docs.mapInArrow(run, "id long, item long, score double, overlap double, question_overlap double, answer_overlap double, first_word long")


def _found(ix: Index, table: _Lookup, hashes: np.ndarray, at: np.ndarray, stride: int, overlap: float, part_overlap: float) -> Iterator[tuple]:
    """(text, item, score, overlaps, first word) of the leaked items of one index in each window of the texts."""
    term = table.find(hashes)
    known = np.flatnonzero(term >= 0)
    known = known[ix.first_bound[term[known]]]
    if not len(known):
        return
    text = np.searchsorted(at, known, "right") - 1
    tiles = np.concatenate([[0], np.cumsum(-(-np.diff(at) // stride))])
    # a window is two tiles; its terms count once
    key = np.unique((tiles[text] + (known - at[text]) // stride) << 24 | term[known])
    window = np.unique(np.concatenate([key, key[~np.isin(key >> 24, tiles)] - (1 << 24)]))
    for w in ix.reachable(window >> 24, window & 0xFFFFFF).tolist():
        doc = int(np.searchsorted(tiles, w, "right")) - 1
        tile_no = w - int(tiles[doc])
        lo = int(at[doc]) + tile_no * stride
        hi = min(lo + 2 * stride, int(at[doc + 1]))
        terms = np.unique(term[lo:hi])
        for item, score in ix.search(terms[terms >= 0]):
            there = shingle_hashes(hashes[lo:hi], ix.sizes[item])
            q, a = (int(np.isin(x[item], there).sum()) for x in (ix.question, ix.answer))
            nq, na = len(ix.question[item]), len(ix.answer[item])
            rates = (q + a) / (nq + na), q / nq, a / na if na else 1.0
            if rates[0] >= overlap and min(rates[1:]) >= part_overlap:
                yield doc, ix.ids[item], score, *rates, tile_no * stride


class _Lookup:
    """Places of 64-bit hashes in a sorted vocabulary, through a table over their top bits."""

    def __init__(self, vocabulary: np.ndarray):
        self.vocabulary = vocabulary
        self.present = np.zeros(1 << 16, bool)
        self.present[(vocabulary >> U64(48)).astype(np.int64)] = True

    def find(self, hashes: np.ndarray) -> np.ndarray:
        out = np.full(len(hashes), -1, np.int64)
        maybe = np.flatnonzero(self.present[(hashes >> U64(48)).astype(np.int64)])
        if len(self.vocabulary) and len(maybe):
            at = np.minimum(np.searchsorted(self.vocabulary, hashes[maybe]), len(self.vocabulary) - 1)
            same = self.vocabulary[at] == hashes[maybe]
            out[maybe[same]] = at[same]
        return out


def decontaminate(docs: DataFrame, benchmark: DataFrame, text_column: str = "text", item_id: str = "item_id", item_text: str = "text", threshold: float = 0.6, ngram: int = 5, overlap: float = 0.8, answer_share: float = 0.5, part_overlap: float = 0.5) -> DataFrame:
    """docs without the rows whose text holds a leaked item, by the rules of `leaks`; all columns stay.

    Rows are judged alone, in one pass without a shuffle: those that share an id with a leaked row stay, and rows without an
    id are judged like others. Null and empty texts stay.
    """
    shared, longest = _indexes(_items(benchmark, item_id, item_text), answer_share, ngram, threshold, overlap)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stride = max(longest, 32)
        indexes = [(x.value, _Lookup(x.value.vocabulary)) for x in shared]
        for batch in batches:
            for part, data, offsets in pieces(batch, text_column):
                starts, _, hashes = words(data, offsets)
                at, clean = word_bounds(starts, offsets), np.ones(part.num_rows, bool)
                for ix, table in indexes:
                    for row in _found(ix, table, hashes, at, stride, overlap, part_overlap):
                        clean[row[0]] = False
                yield part.filter(pa.array(clean))

    return docs.mapInArrow(run, docs.schema)
