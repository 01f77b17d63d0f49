"""Mixing sources to target weights by subset-sum budget fitting.

Documents are counted by exact token length. What a source's target leaves after whole repeats is shared out over the lengths in
proportion to their words, whole documents first by rounding down and then by largest remainders, until less than ROOM times
the longest length is left; a bounded-knapsack dynamic program over the length counts fits that rest. Which documents of a
length are taken follows a seeded hash.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from acervo.llm._text import kept

#: Longest lengths that the rest left to the dynamic program stays below; the same at every size of the input.
ROOM = 8
#: Bits of the hash buckets that deal a large group of equal length out to several tasks.
DEALT_BITS = 6


def fit_budget(lengths: dict[int, int], budget: int) -> dict[int, int]:
    """How many documents of each length to take so that their sum comes nearest to budget without passing it.

    lengths: {length: count}. Each length takes its share of the budget, rounded down to documents; while the rest holds ROOM times
    the longest length, the lengths with the largest remainders (then the longest) take one more each; the dynamic program
    over reachable sums fits what is left exactly, so the sum is the nearest that those first takes allow.
    """
    lengths = {n: c for n, c in lengths.items() if n > 0}
    total = sum(n * c for n, c in lengths.items())
    if budget <= 0 or not total:
        return {}
    if budget >= total:
        return dict(lengths)
    take = {n: c * budget // total for n, c in lengths.items()}
    rest = budget - sum(n * c for n, c in take.items())
    longest = max(lengths)
    for n in sorted(take, key=lambda n: (-(lengths[n] * budget % total), -n)):
        if rest < ROOM * longest:
            break
        if take[n] < lengths[n]:
            take[n] += 1
            rest -= n
    limit = (1 << (rest + 1)) - 1
    sums, steps = 1, []
    for n in sorted(take, reverse=True):
        free, batch = min(lengths[n] - take[n], rest // n), 1
        while free > 0:
            batch = min(batch, free)
            steps.append((n, batch, sums))
            sums |= sums << (n * batch) & limit
            free, batch = free - batch, batch * 2
        if sums >> rest & 1:
            break
    at = sums.bit_length() - 1
    for n, batch, before in reversed(steps):
        if not before >> at & 1:
            take[n] += batch
            at -= n * batch
    return take


def _takes(groups: Iterator[pd.DataFrame] | pd.DataFrame) -> pd.DataFrame:
    rest = int(groups["rest"].iloc[0])
    found = fit_budget({int(n): int(c) for n, c in zip(groups["size"], groups["n"], strict=True)}, rest)
    return pd.DataFrame({"key": groups["key"].iloc[0], "size": groups["size"], "take": [found.get(int(n), 0) for n in groups["size"]]})


def targets(sources: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """sources (key, source, source_size) -> with target added.

    Sources by code point, null last, take weights in turn and share `share` times all sizes; a target stops at `most`
    times its source's size and the excess is shared again by weight until none is above. One row for each source, so
    the windows without partitions hold sources, not documents.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    ranked = sources.withColumn("weight", F.element_at(F.array(*[F.lit(x) for x in weights]), ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int")))
    up = Window.orderBy(F.col("source_size") / F.col("weight"), F.col("source").asc_nulls_last())
    level = ranked.withColumn("below", F.sum("source_size").over(up) - F.col("source_size")).withColumn("weights", F.sum("weight").over(Window.partitionBy()) - F.sum("weight").over(up) + F.col("weight")).withColumn("all", F.sum("source_size").over(Window.partitionBy()))
    level = level.withColumn("rate", (share * F.col("all") - most * F.col("below")) / F.col("weights")).withColumn("open", F.col("rate") * F.col("weight") <= most * F.col("source_size"))
    rate = F.max(F.when(F.col("open"), F.col("rate"))).over(Window.partitionBy())
    return level.withColumn("target", F.least(most * F.col("source_size"), F.coalesce(rate * F.col("weight"), most * F.col("source_size")))).select("key", "source", "source_size", "target")


def mix(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", source_column: str = "source", seed: int = 17, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, most: int = 2) -> DataFrame:
    """One row for each row of docs: (id_column, size, source_size, target, taken).

    size counts the runs of bytes other than blanks (null text: 0). taken is the number of words the mix takes from the
    row: whole repeats of its source, plus one more if it was chosen; never over `most` times its size. Documents of a length
    are chosen by a hash of seed, id and text; reruns agree. Null sources are one source. Repeated rows and null ids
    count as rows of their own. An empty table gives an empty one.
    """
    rows = kept(docs.select(F.col(id_column).alias("id"), F.col(source_column).alias("source"), F.coalesce(F.regexp_count(F.col(text_column), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long").alias("size"), F.xxhash64(F.lit(seed), F.col(id_column), F.col(text_column)).alias("order")).withColumn("key", F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("n"))).withColumn("part", F.shiftrightunsigned("order", 64 - DEALT_BITS)))
    cells = kept(rows.groupBy("key", "source", "size", "part").agg(F.count("*").alias("n")))
    sources = cells.groupBy("key", "source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"))
    plan = kept(targets(sources, weights, share, most).withColumn("repeats", F.when(F.col("source_size") > 0, F.least(F.lit(most), F.floor(F.col("target") / F.col("source_size")))).otherwise(0).cast("long")).withColumn("rest", F.round(F.col("target") - F.col("repeats") * F.col("source_size")).cast("long")))
    lengths = cells.groupBy("key", "size").agg(F.sum("n").alias("n")).join(plan.select("key", "rest"), "key")
    takes = lengths.groupBy("key").applyInPandas(_takes, "key string, size long, take long")
    before = Window.partitionBy("key", "size").orderBy("part")
    dealt = cells.join(takes, ["key", "size"]).withColumn("before", F.sum("n").over(before) - F.col("n")).select("key", "size", "part", F.greatest(F.lit(0), F.col("take") - F.col("before")).alias("quota"))
    place = F.row_number().over(Window.partitionBy("key", "size", "part").orderBy("order", "id"))
    chosen = rows.withColumn("place", place).join(dealt, ["key", "size", "part"]).join(plan.drop("source"), "key")
    return chosen.select(F.col("id").alias(id_column), "size", "source_size", "target", ((F.col("repeats") + (F.col("place") <= F.col("quota")).cast("long")) * F.col("size")).alias("taken"))
