"""N-gram Jaccard join: a blocked sparse product of the document by n-gram incidence.

Each document is a row of the incidence matrix: the set of hashes of its word n-grams. A block is the posting list of
one n-gram. Size-derived bounds decide what enters a block and what leaves it:

* a document of n n-grams can only reach the threshold with a partner that shares one of its n - ceil(t n) + 1 first
  n-grams in any fixed order, so only those are posted. Long n-grams come first and those found to be frequent last,
  so blocks stay small;
* a pair whose sizes differ too much, or whose places in the block leave too few n-grams behind them, is discarded.

What is left is discarded exactly in two ways before it is counted whole. A sketch holds the parity of the set's n-grams in SKETCH
places, so two sketches differ in no more places than their sets differ in n-grams. Then overlap counts are accumulated over
ranges of the n-grams: those of the first range, a SHARE-th of all, are fetched for all pairs left, and the others only for the
pairs whose count so far and n-grams to come can still reach the threshold.

Copies are not expanded. Rows with equal texts are one vertex, whose key is the hash of the text; ids come
in at the end only. In a block every vertex is compared with the hub
(the vertex with fewest rare n-grams); after connected components, only members of a block that are still in other
components are compared further, so groups of near copies cost a number of pairs in proportion to their size.

What is left after the rounds of hubs is compared within its blocks. A pair is not made where one of the two n-grams before
the block's is common too, as an earlier block makes it, and only if sketches folded by exclusive or to fewer places allow it.

Rounds of hubs find components, not all links, so links are counted afterwards, within components. Each text takes a neighbour
as its centre, and its difference from the centre's set. Two texts of one centre differ in their differences' n-grams less those
in both, so pairs whose differences are small enough by size alone are links, and are counted by size, not made. Others of one
centre are links only by n-grams that both differences hold, and are made by those. Pairs of different centres are compared
within their blocks.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from acervo.llm import _bloom
from acervo.llm._components import components
from acervo.llm._text import Grown, U64, drop, kept, mix, pieces, shingle_hashes, signed, word_bounds, words

#: Frequent n-grams held in memory for the order; the order changes speed only.
HOT_NGRAMS = 1 << 17
#: An n-gram is frequent from so many documents on.
HOT_FROM = 24
#: Rounds of hubs at most before the members that are left are compared with their blocks.
HUB_ROUNDS = 6
#: Open pairs, for each posting, that are compared at once.
OPEN_PAIRS = 64
#: An n-gram that heads a block of so many documents is counted as frequent after all, and the documents are posted again.
LARGE_BLOCK = 1 << 14
#: Places of a sketch, and of its folded form that travels with postings.
SKETCH, FOLDED = 1024, 256
#: Overlaps are counted over one of so many n-grams first.
SHARE = 4
#: A centre's n-grams meet so many of its texts at once.
MEMBERS = 256
POSTINGS = "ngram long, v long, n int, place int, rank long"


def _sets(batches: Iterator[pa.RecordBatch], text: str, ngram: int) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    """Each piece with the sorted n-gram numbers of its texts."""
    for batch in batches:
        for part, data, offsets in pieces(batch, text):
            starts, ends, hashes = words(data, offsets)
            at, sizes = word_bounds(starts, offsets), np.concatenate([[0], np.cumsum(ends - starts)])
            yield part, [np.unique(_numbered(shingle_hashes(hashes[a:b], ngram), sizes[a : b + 1], ngram)) for a, b in zip(at[:-1], at[1:], strict=True)]


def _numbered(hashes: np.ndarray, sizes: np.ndarray, ngram: int) -> np.ndarray:
    """56 bits of each n-gram's hash below 255 less its bytes: long n-grams, which are seldom shared, sort first."""
    span = min(ngram, len(sizes) - 1)
    length = np.minimum(sizes[span:] - sizes[: len(sizes) - span], 255).astype(U64) if span else np.zeros(0, U64)
    return (U64(255) - length) << U64(56) | hashes >> U64(8)


def _sketch(grams: np.ndarray) -> np.ndarray:
    """Parities of the n-grams' numbers in SKETCH places, as SKETCH / 64 longs."""
    places = (mix(grams) >> U64(32)).astype(np.int64) % SKETCH
    return np.packbits(np.bincount(places, minlength=SKETCH).astype(np.uint8) & 1).view(np.int64)


def _profile(docs: DataFrame, ngram: int) -> DataFrame:
    """A row (id, t, n, sketch) for each document, and rows (ngram, times) for what repeats within a task."""
    names = ["id", "t", "n", "sketch", "ngram", "times"]
    longs = pa.list_(pa.int64())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: list[np.ndarray] = []
        held = 0

        def repeated() -> pa.RecordBatch:
            nonlocal seen, held
            grams = np.concatenate(seen)
            seen, held = [], 0
            grams.sort()
            starts = np.flatnonzero(np.concatenate([[True], grams[1:] != grams[:-1]]))
            times = np.diff(starts, append=len(grams))
            grams, times = grams[starts[times > 1]], times[times > 1]
            none = [pa.nulls(len(grams), k) for k in (pa.int64(), pa.int64(), pa.int32(), longs)]
            return pa.RecordBatch.from_arrays([*none, pa.array(signed(grams)), pa.array(times)], names)

        for part, sets in _sets(batches, "text", ngram):
            none = pa.nulls(len(sets), pa.int64())
            yield pa.RecordBatch.from_arrays([part.column("id"), part.column("t"), pa.array([len(x) for x in sets], pa.int32()), pa.array([_sketch(x) for x in sets], longs), none, none], names)
            seen += list({t: x for t, x in zip(part.column("t").to_pylist(), sets, strict=True)}.values())
            held += sum(map(len, sets))
            if held > 4_000_000:
                yield repeated()
        if seen:
            yield repeated()

    return docs.mapInArrow(run, "id long, t long, n int, sketch array<long>, ngram long, times long")


def _postings(docs: DataFrame, ngram: int, percent: int, hot: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """The n-grams of each text's prefix: (ngram, hash of the text, n, place in the order, rank to become hub)."""
    names = ["ngram", "v", "n", "place", "rank"]
    shared = docs.sparkSession.sparkContext.broadcast(hot)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent, times = shared.value
        done: set[int] = set()
        for part, sets in _sets(batches, "text", ngram):
            grams, owner, place, sizes, ranks, keys = [], [], [], [], [], []
            for v, x in zip(part.column("t").to_pylist(), sets, strict=True):
                if not len(x) or v in done:
                    continue
                done.add(v)
                n = len(x)
                keep = n - (percent * n + 99) // 100 + 1
                at = np.minimum(np.searchsorted(frequent, x), max(len(frequent) - 1, 0))
                is_hot = frequent[at] == x if len(frequent) else np.zeros(n, bool)
                rare = x[~is_hot]
                if len(rare) < keep:
                    common, count = x[is_hot], times[at[is_hot]]
                    prefix = np.concatenate([rare, common[np.lexsort((common, count))]])[:keep]
                else:
                    prefix = rare[:keep]
                grams.append(prefix)
                place.append(np.arange(len(prefix), dtype=np.int32))
                owner.append(np.full(len(prefix), len(keys)))
                keys.append(v)
                sizes.append(n)
                ranks.append(min(len(rare), 0x7FFF) << 48 | v & 0xFFFFFFFFFFFF)
            if grams:
                owner = np.concatenate(owner)
                yield pa.RecordBatch.from_arrays([pa.array(signed(np.concatenate(grams))), pa.array(np.array(keys, np.int64)[owner]), pa.array(np.array(sizes, np.int32)[owner]), pa.array(np.concatenate(place)), pa.array(np.array(ranks, np.int64)[owner])], names)

    return docs.mapInArrow(run, POSTINGS)


def _enough(percent: int) -> object:
    """Whether sizes and places in a block leave a pair (left, right) the chance to reach the threshold."""
    n, m = F.col("l.n"), F.col("r.n")
    most = F.least(n - F.col("l.place"), m - F.col("r.place"))
    return (100 * F.least(n, m) >= percent * F.greatest(n, m)) & ((100 + percent) * most >= percent * (n + m))


def _overlaps(docs: DataFrame, pairs: DataFrame, vertices: DataFrame, ngram: int, percent: int) -> DataFrame:
    """Those of pairs (a, b) that reach the threshold, by overlap counts accumulated over ranges of the n-grams."""
    sides = [vertices.select(F.col("v").alias(v), F.struct("n", "sketch").alias(s)) for v, s in (("a", "l"), ("b", "r"))]
    whole = [(F.get("l.sketch", F.lit(i)), F.get("r.sketch", F.lit(i))) for i in range(SKETCH // 64)]
    left = pairs.join(sides[0], "a").join(sides[1], "b").where(_sketches_allow(percent, whole))
    left = kept(left.select("a", "b", (F.col("l.n") + F.col("r.n")).cast("long").alias("n"), F.lit(0).cast("long").alias("shared"), F.col("l.n").alias("more_a"), F.col("r.n").alias("more_b")))
    for first in (True, False):
        ids = kept(left.select(F.col("a").alias("v")).union(left.select("b")).distinct())
        rows = _rows(docs, ngram, ids, first)
        met = left.join(rows.select(F.col("v").alias("a"), F.col("grams").alias("x")), "a").join(rows.select(F.col("v").alias("b"), F.col("grams").alias("y")), "b")
        # within the JVM a row at a time: batches of pairs of rows would take an executor some hundred MB
        met = met.select("a", "b", "n", (F.col("shared") + F.size(F.array_intersect("x", "y"))).alias("shared"), (F.col("more_a") - F.size("x")).alias("more_a"), (F.col("more_b") - F.size("y")).alias("more_b"))
        counted = kept(met.where((100 + percent) * (F.col("shared") + F.least("more_a", "more_b")) >= percent * F.col("n")))
        drop(left, ids)
        left = counted
    return left.select("a", "b")


def ngram_jaccard(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", ngram: int = 5, percent: int = 80, links: bool = True) -> DataFrame:
    """One row for each row of docs: (id_column, n_shingles, component_id, n_links); without n_links unless `links`.

    Words are runs of bytes other than blanks, with A-Z lower-cased; a set holds the distinct runs of `ngram` words (the
    whole sequence if there are fewer words). Documents are linked when 100 * overlap >= percent * union. component_id is
    the smallest id that links reach, the own one included. n_links counts the other rows that a row is linked with, copies
    of its text included: every link counts, also those that the component does not need.

    Null or blank texts have no n-grams, n_shingles 0, and are linked with nothing; their component is their own id.
    Rows with a null id take part and get the smallest id of their component, if any has one. Repeated rows come out as
    often as they come in. Other columns of docs are not read. An empty table gives an empty one.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col(id_column).cast("long").alias("id"), F.col(text_column).alias("text")).withColumn("t", F.xxhash64("text"))
    profile = kept(_profile(docs, ngram))
    counts = kept(profile.where("ngram is not null").groupBy("ngram").agg(F.sum("times").alias("times")).where(F.col("times") >= HOT_FROM))
    vertices = kept(profile.where("n > 0").groupBy(F.col("t").alias("v")).agg(F.min("id").alias("least"), F.count("*").alias("times"), F.first("n").alias("n"), F.first("sketch").alias("sketch")))
    blocks = _blocks(docs, ngram, percent, counts)

    size = blocks.count()
    found, compared, tried = Grown(spark, "a long, b long"), Grown(spark, "a long, b long"), Grown(spark, "ngram long, hub long")
    active = blocks
    for _ in range(HUB_ROUNDS):
        hubs = active.groupBy("ngram").agg(F.min("rank").alias("first"))
        hubs = kept(active.join(hubs, "ngram").where("rank = first").select("ngram", F.col("v").alias("hub"), "n", "place"))
        tried.add(hubs.select("ngram", "hub"))
        pairs = blocks.alias("l").join(hubs.alias("r"), "ngram").where(F.col("v") != F.col("hub")).where(_enough(percent)).select(F.least("v", "hub").alias("a"), F.greatest("v", "hub").alias("b")).distinct()
        pairs = kept(pairs.join(compared.frame(), ["a", "b"], "left_anti"))
        compared.add(pairs)
        found.add(_overlaps(docs, pairs, vertices, ngram, percent))
        drop(hubs, pairs)
        labels = components(found.frame())
        active, open_pairs = _unsettled(blocks, labels, tried.frame())
        if open_pairs <= OPEN_PAIRS * size:
            break
    pairs = kept(_rest(blocks, active, labels, vertices, percent).join(compared.frame(), ["a", "b"], "left_anti"))
    drop(tried)
    more = _overlaps(docs, pairs, vertices, ngram, percent)
    if more.limit(1).count():
        found.add(more)
        labels = components(found.frame())
    compared.add(pairs)
    classes = vertices.join(labels, "v", "left").withColumn("c", F.coalesce("c", "v"))
    if links:
        counted = _linked(docs, blocks, vertices, labels, found.frame(), compared.frame(), ngram, percent)
        classes = classes.join(counted, "v", "left").withColumn("n_links", F.coalesce("others", F.lit(0)) + F.col("times") - 1)
    names = ["n_links"] if links else []
    classes = kept(classes.select(F.col("v").alias("t"), "least", "c", *names))
    drop(blocks, compared)
    named = classes.groupBy("c").agg(F.min("least").alias("component"))
    # texts without words have no class: a null key keeps their rows from meeting under one
    rows = profile.where("ngram is null").select("id", F.when(F.col("n") > 0, F.col("t")).alias("t"), "n")
    out = rows.join(classes.join(named, "c").select("t", "component", *names), "t", "left")
    return out.select(F.col("id").alias(id_column), F.col("n").cast("long").alias("n_shingles"), F.coalesce("component", "id").alias("component_id"), *[F.coalesce(x, F.lit(0)).cast("long").alias(x) for x in names])


def _blocks(docs: DataFrame, ngram: int, percent: int, counts: DataFrame) -> DataFrame:
    """Postings (ngram, v, n, place, rank, low) of the n-grams that more than one vertex posts.

    counts are those of n-grams that repeat within tasks. One that is spread too thin for that, but heads a large block, is
    added to them with the block's exact size, and all are posted again; the order changes speed only.
    """
    for again in (True, False):
        frequent = counts.where(F.col("times") >= _cutoff(counts)).toArrow()
        grams = frequent.column("ngram").to_numpy().view(U64)
        order = np.argsort(grams)
        postings = kept(_postings(docs, ngram, percent, (grams[order], frequent.column("times").to_numpy()[order])))
        # one exchange serves the choice of blocks and the removal of copies
        block = Window.partitionBy("ngram")
        dealt = postings.withColumns({"low": F.min("rank").over(block), "one": F.min("v").over(block), "other": F.max("v").over(block)})
        blocks = kept(dealt.where("one <> other").drop("one", "other").dropDuplicates(["ngram", "v"]))
        drop(postings)
        large = blocks.groupBy("ngram").agg(F.count("*").alias("times")).where(F.col("times") >= LARGE_BLOCK).join(counts.select("ngram"), "ngram", "left_anti")
        if not again or not large.limit(1).count():
            return blocks
        counts = kept(counts.union(large))
        drop(blocks)
    raise AssertionError


def _rest(blocks: DataFrame, active: DataFrame, labels: DataFrame, vertices: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of the active members of a block and its members in other components."""
    open_ = active.select("ngram", "v", F.lit(True).alias("open"))
    rows = _labelled(blocks.join(active.select("ngram").distinct(), "ngram", "left_semi"), labels).join(open_, ["ngram", "v"], "left")
    rows = _marked(rows, vertices, "c", "open")
    met = (F.col("l.ngram") == F.col("r.ngram")) & (F.col("l.c") != F.col("r.c")) & _first_met(percent)
    return rows.where("open").alias("l").join(rows.alias("r"), met).select(F.least("l.v", "r.v").alias("a"), F.greatest("l.v", "r.v").alias("b")).distinct()


def _marked(rows: DataFrame, vertices: DataFrame, *names: str) -> DataFrame:
    """Postings with their folded sketches and the two n-grams before each."""
    before = [F.lag("ngram", i).over(Window.partitionBy("v").orderBy("place")).alias(f"before{i}") for i in (1, 2)]
    folded = [reduce(Column.bitwiseXOR, [F.get("sketch", F.lit(j)) for j in range(i, SKETCH // 64, FOLDED // 64)]).alias(f"s{i}") for i in range(FOLDED // 64)]
    return kept(rows.join(vertices.select("v", *folded), "v").select("ngram", "v", "n", "place", *names, *[f"s{i}" for i in range(FOLDED // 64)], *before))


def _first_met(percent: int) -> Column:
    """Whether marked postings (left, right) of a block can reach the threshold, and no earlier block is known to make the pair."""
    near = _sketches_allow(percent, [(F.col(f"l.s{i}"), F.col(f"r.s{i}")) for i in range(FOLDED // 64)])
    earlier = [F.coalesce(F.col(f"l.before{i}") == F.col(f"r.before{j}"), F.lit(False)) for i in (1, 2) for j in (1, 2)]
    return _enough(percent) & near & ~(earlier[0] | earlier[1] | earlier[2] | earlier[3])


def _linked(docs: DataFrame, blocks: DataFrame, vertices: DataFrame, labels: DataFrame, found: DataFrame, compared: DataFrame, ngram: int, percent: int) -> DataFrame:
    """Rows (v, others): how many rows have another text that reaches the threshold with v, for each text v of a component.

    found are the links among the pairs compared so far, and labels the components they make.
    """
    ends = found.select("a", "b").union(found.select("b", "a"))
    degree = kept(ends.groupBy(F.col("a").alias("g")).agg(F.count("*").alias("d")))
    # the neighbour with most links found, or the text itself: its difference is none
    near = ends.select(F.col("a").alias("v"), F.col("b").alias("g")).join(degree, "g").union(degree.select(F.col("g").alias("v"), "g", "d"))
    centres = near.groupBy("v").agg(F.max(F.struct("d", "g")).alias("m")).select("v", F.col("m.g").alias("g"))
    members = kept(centres.join(labels, "v").join(vertices.select("v", "n", "times"), "v"))
    apart = _differences(docs, members, ngram, percent)
    here = apart.groupBy("g", "f").agg(F.sum("times").alias("w"))
    # f of one and f of the other add up to 0 at most: a running sum over the values of f counts the texts up to -f
    steps = here.select("g", F.col("f").alias("at"), F.lit(0).alias("asks"), "w").union(here.select("g", -F.col("f"), F.lit(1), F.lit(0).cast("long")))
    upto = steps.withColumn("w", F.sum("w").over(Window.partitionBy("g").orderBy("at", "asks"))).where("asks = 1").select("g", (-F.col("at")).alias("f"), "w")
    alike = apart.join(upto, ["g", "f"]).select("v", (F.col("w") - F.when(F.col("f") <= 0, F.col("times")).otherwise(0)).alias("others"))
    # what else is linked shares n-grams of its differences
    open_ = apart.join(here.groupBy("g").agg(F.max("f").alias("most")), "g").where(F.col("f") + F.col("most") > 0)
    parts = kept(open_.select("g", "v", "f", F.explode("d").alias("ngram")))
    met = parts.alias("l").join(parts.alias("r"), (F.col("l.ngram") == F.col("r.ngram")) & (F.col("l.g") == F.col("r.g")) & (F.col("l.v") < F.col("r.v")) & (F.col("l.f") + F.col("r.f") > 0))
    both = met.groupBy(F.col("l.v").alias("a"), F.col("r.v").alias("b")).agg(F.count("*").alias("k"), F.first(F.col("l.f") + F.col("r.f")).alias("f")).where(2 * (100 + percent) * F.col("k") >= F.col("f")).select("a", "b")
    # pairs of different centres
    sides = [members.select(F.col("v").alias(v), F.col("g").alias(g)) for v, g in (("a", "x"), ("b", "y"))]
    known = found.join(sides[0], "a").join(sides[1], "b").where("x <> y").select("a", "b")
    across = kept(_across(blocks, members, vertices, percent).join(compared, ["a", "b"], "left_anti"))
    new = _overlaps(docs, across, vertices, ngram, percent)
    made = kept(both.union(known).union(new))
    times = members.select(F.col("v").alias("b"), F.col("times").alias("others"))
    singly = made.union(made.select("b", "a")).join(times, "b").select(F.col("a").alias("v"), "others")
    out = kept(alike.union(singly).groupBy("v").agg(F.sum("others").alias("others")))
    drop(degree, members, apart, parts, across, made)
    return out


def _differences(docs: DataFrame, members: DataFrame, ngram: int, percent: int) -> DataFrame:
    """Rows (v, g, times, d, f) of members (v, g, n, times): the n-grams d in which v and its centre g differ, and f.

    With N the sum of sizes of two texts of one centre, S the n-grams they differ in, and k those in both differences,
    S = |d| + |e| - 2 k, and the threshold asks for (100 + percent) * S <= (100 - percent) * N. With
    f = (100 + percent) * |d| - (100 - percent) * n for each, that is: the two f add up to 2 * (100 + percent) * k at most.
    """
    rows = _rows(docs, ngram, members.select("v"), None)
    # a centre's n-grams are dealt with its texts, so no task meets all texts of a large group
    deals = kept(members.groupBy("g").agg(F.ceil(F.count("*") / MEMBERS).alias("deals")))
    dealt = members.join(deals, "g").withColumn("deal", F.expr("pmod(v, deals)"))
    centres = rows.join(deals, F.col("v") == F.col("g")).select("g", F.explode(F.sequence(F.lit(0).cast("long"), F.col("deals") - 1)).alias("deal"), F.col("grams").alias("y"))
    met = rows.select("v", F.col("grams").alias("x")).join(dealt, "v").join(centres, ["g", "deal"])
    met = met.select("v", "g", "n", "times", F.concat(F.array_except("x", "y"), F.array_except("y", "x")).alias("d"))
    out = kept(met.select("v", "g", "times", "d", ((100 + percent) * F.size("d").cast("long") - (100 - percent) * F.col("n").cast("long")).alias("f")))
    drop(deals)
    return out


def _across(blocks: DataFrame, members: DataFrame, vertices: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of a component whose texts have different centres and meet in a block."""
    rows = _marked(blocks.join(members.select("v", "g", "c"), "v"), vertices, "g", "c")
    seen = rows.select("ngram", "c", "g").distinct()
    # centres meet first: a block whose texts have one centre makes no pairs
    meets = seen.alias("l").join(seen.alias("r"), (F.col("l.ngram") == F.col("r.ngram")) & (F.col("l.c") == F.col("r.c")) & (F.col("l.g") < F.col("r.g"))).select("l.ngram", "l.g", F.col("r.g").alias("h"))
    met = (F.col("l.ngram") == F.col("r.ngram")) & (F.col("l.h") == F.col("r.g")) & _first_met(percent)
    return rows.join(meets, ["ngram", "g"]).alias("l").join(rows.alias("r"), met).select(F.least("l.v", "r.v").alias("a"), F.greatest("l.v", "r.v").alias("b")).distinct()


def _sketches_allow(percent: int, words: list[tuple[Column, Column]]) -> Column:
    """Whether sets l and r of l.n and r.n n-grams can reach the threshold, by the words of their sketches.

    2 * overlap <= n - differ, and the threshold asks for (100 + percent) * overlap >= percent * n, where n is the sum of sizes.
    """
    differ = sum((F.bit_count(x.bitwiseXOR(y)) for x, y in words), F.lit(0))
    n = F.col("l.n") + F.col("r.n")
    return (100 + percent) * (n - differ) >= 2 * percent * n


def _cutoff(counts: DataFrame) -> int:
    """The smallest number of times that HOT_NGRAMS n-grams at most reach."""
    total = 0
    rows = counts.groupBy(F.floor(F.log2("times") * 8).alias("step")).agg(F.count("*").alias("n"), F.min("times").alias("least")).orderBy(F.col("step").desc()).collect()
    out = 1 << 62
    for row in rows:  # eighths of powers of two: a few hundred rows
        total += row["n"]
        if total > HOT_NGRAMS:
            break
        out = row["least"]
    return out


def _rows(docs: DataFrame, ngram: int, ids: DataFrame, first: bool | None) -> DataFrame:
    """Rows (v, grams) of the incidence matrix for the given vertices: the n-grams of the first range, all others, or all."""
    shared = docs.sparkSession.sparkContext.broadcast(_bloom.build(ids, "v"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: set[int] = set()
        for batch in batches:
            keys = batch.column("t").to_numpy()
            new = np.zeros(len(keys), bool)
            for i in np.flatnonzero(_bloom.passes(shared.value, keys)).tolist():  # a task's copies of a text count once
                new[i] = keys[i] not in done
                done.add(keys[i])
            for part, sets in _sets([batch.filter(pa.array(new))], "text", ngram):
                if first is not None:
                    sets = [x[(x % U64(SHARE) == 0) == first] for x in sets]
                grams = pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum([len(x) for x in sets])]).astype(np.int32), pa.array(signed(np.concatenate([*sets, np.zeros(0, U64)]))))
                yield pa.RecordBatch.from_arrays([part.column("t"), grams], ["v", "grams"])

    return docs.where("text is not null").select("t", "text").mapInArrow(run, "v long, grams array<long>").join(ids, "v", "left_semi").dropDuplicates(["v"])


def _labelled(blocks: DataFrame, labels: DataFrame) -> DataFrame:
    return blocks.join(labels, "v", "left").withColumn("c", F.coalesce("c", "v"))


def _unsettled(blocks: DataFrame, labels: DataFrame, tried: DataFrame) -> tuple[DataFrame, int]:
    """Members of a block outside its first hub's component that were not its hub yet, and the pairs they can be in."""
    here = _labelled(blocks, labels)
    main = here.where("rank = low").groupBy("ngram").agg(F.min("c").alias("main"))
    sizes = here.groupBy("ngram").agg(F.count("*").alias("members"))
    left = here.join(main, "ngram").where("c <> main").join(tried, (here.ngram == tried.ngram) & (here.v == tried.hub), "left_anti").join(sizes, "ngram")
    left = kept(left.select("ngram", "v", "n", "place", "rank", "c", "members"))
    return left.drop("members"), left.agg(F.sum("members")).first()[0] or 0
