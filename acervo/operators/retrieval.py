"""Lexical and vector search over chunk tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

WORDS = r"[\p{L}\p{N}_]+"


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(WORDS), 0)


def bucket(word: Column, size: int = 128) -> Column:
    return (F.conv(F.substring(F.md5(word.cast("binary")), 1, 2), 16, 10).cast("int") % size).cast("int")


def hashed_counts(docs: DataFrame, key: str, text: str, size: int = 128, first: int = 2000) -> DataFrame:
    """(key, bucket, weight): word counts in hash buckets, scaled to unit length, rounded to 6 places."""
    rows = docs.select(key, F.explode(tokens(F.substring(text, 1, first))).alias("_w")).groupBy(key, bucket(F.col("_w"), size).alias("bucket")).agg(F.count("*").alias("_n"))
    norm = F.sqrt(F.sum(F.col("_n") * F.col("_n")).over(Window.partitionBy(key)))
    return rows.select(key, F.col("bucket").cast("long"), F.round(F.col("_n") / norm, 6).alias("weight"))


def cosine(a: Column, b: Column) -> Column:
    """0 for empty vectors, unequal lengths or zero norms."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    whole = dot(a, b) / F.nullif(F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)), F.lit(0.0))
    return F.when(F.size(a) == F.size(b), F.coalesce(whole, F.lit(0.0))).otherwise(0.0)


def topk_cosine(vectors: DataFrame, query: list[float], key: str, vector: str, k: int = 5) -> DataFrame:
    """The k nearest vectors by rounded cosine, ties by key: one scan and a top-k."""
    score = F.round(cosine(F.col(vector), F.array(*[F.lit(float(x)) for x in query])), 4)
    return vectors.select(key, score.alias("score")).orderBy(F.col("score").desc(), key).limit(k)


def bm25(docs: DataFrame, key: str, text: str, query: list[str], k1: float = 1.5, b: float = 0.75, idf: bool = True, fixed_length: float | None = None) -> DataFrame:
    """(key, score) of the documents that hold query words; repeated query words count again.

    Only query words are counted, so the texts are scanned once and a few rows a document are shuffled.
    """
    terms = sorted({q.lower() for q in query})
    times = lambda t: F.size(F.filter("_w", lambda w: w == t))
    words = docs.select(key, tokens(F.col(text)).alias("_w"))
    counted = words.select(key, F.size("_w").alias("_len"), *[times(t).alias(f"_tf{i}") for i, t in enumerate(terms)])
    totals = counted.agg(F.count("*").alias("_n"), F.avg("_len").alias("_avg"), *[F.count_if(F.col(f"_tf{i}") > 0).alias(f"_df{i}") for i in range(len(terms))])
    rows = counted.where(" or ".join(f"_tf{i} > 0" for i in range(len(terms)))).crossJoin(F.broadcast(totals))
    mean = F.lit(float(fixed_length)) if fixed_length else F.col("_avg")

    def part(i: int, t: str) -> Column:
        tf, df = F.col(f"_tf{i}"), F.col(f"_df{i}")
        weight = F.log((F.col("_n") - df + 0.5) / (df + 0.5) + 1) if idf else F.lit(1.0)
        return [q.lower() for q in query].count(t) * weight * tf * (k1 + 1) / (tf + k1 * (1 - b + b * F.col("_len") / mean))

    return rows.select(key, F.round(sum(part(i, t) for i, t in enumerate(terms)), 4).alias("score"))


def fuse(vector: DataFrame, lexical: DataFrame, key: str, k: int = 10, base: int = 60) -> DataFrame:
    """Reciprocal-rank fusion of two (key, score) tables by the ranks of all their rows.

    The first ranks of either table are the candidates, as no other row can reach the best k; each candidate gets its
    exact rank in either table by counting the rows before it. A key that one table lacks counts in the other only.
    """
    depth = 50 * k
    candidates = _first(vector, key, depth).select(key).union(_first(lexical, key, depth).select(key)).distinct()
    both = _ranks(vector, candidates, key, "_v").join(_ranks(lexical, candidates, key, "_l"), key, "full")
    score = F.coalesce(1 / (base + F.col("_v")), F.lit(0.0)) + F.coalesce(1 / (base + F.col("_l")), F.lit(0.0))
    return both.select(key, F.round(score, 5).alias("score")).orderBy(F.col("score").desc(), key).limit(k)


def _first(scored: DataFrame, key: str, depth: int) -> DataFrame:
    return scored.orderBy(F.col("score").desc(), key).limit(depth)


def _ranks(scored: DataFrame, candidates: DataFrame, key: str, name: str, step: int = 32) -> DataFrame:
    """(key, rank among all rows of scored) of the candidates that scored has.

    Each row falls in the range before one of the sorted candidates, found among every `step`th one and then between two
    of those; the ranks are running sums over the ranges, of which there are as many as candidates.
    """
    # null scores last, then the highest, then the smallest key
    place = F.struct(F.col("score").isNull().alias("a"), F.coalesce(-F.col("score").cast("double"), F.lit(0.0)).alias("b"), F.col(key).alias("c"))
    rows = scored.select(place.alias("_p"))
    own = scored.join(F.broadcast(candidates), key, "left_semi").select(place.alias("_p"))
    marks = own.agg(F.array_sort(F.collect_list("_p")).alias("_m")).select("_m", F.filter("_m", lambda _, i: i % step == 0).alias("_coarse"))
    before = lambda marks, p: F.size(F.filter(marks, lambda m: m < p))
    coarse = F.greatest(before(F.col("_coarse"), F.col("_p")) - 1, F.lit(0)) * step
    slots = rows.crossJoin(F.broadcast(marks)).withColumn("_c", coarse).select((F.col("_c") + before(F.slice("_m", F.col("_c") + 1, F.lit(step)), F.col("_p"))).alias("_i"))
    counts = slots.groupBy("_i").agg(F.count("*").alias("_n"))
    listed = marks.select(F.posexplode("_m").alias("_i", "_p")).join(counts, "_i", "left")
    rank = F.sum(F.coalesce("_n", F.lit(0))).over(Window.orderBy("_i"))
    return listed.select(F.col("_p.c").alias(key), rank.alias(name))
