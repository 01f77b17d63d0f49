"""Extraction quality against labelled rows."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def extraction_eval(pairs: DataFrame) -> DataFrame:
    """pairs (field, truth, predicted) -> one row a field: tp, fp, fn, exact_pct, precision, recall, f1.

    Equal values are true positives, whatever they say; a wrong value is a false positive and a false negative; a missing
    prediction is a false negative.
    """
    same, missing = F.col("truth") == F.col("predicted"), F.col("predicted").isNull()
    counts = pairs.groupBy("field").agg(F.count("*").alias("n"), F.count_if(same).alias("tp"), F.count_if(~same & ~missing).alias("fp"), F.count_if(missing | ~same).alias("fn"))
    ratio = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    p, r = ratio(F.col("tp"), F.col("tp") + F.col("fp")), ratio(F.col("tp"), F.col("tp") + F.col("fn"))
    return counts.select("field", "tp", "fp", "fn", F.round(100 * F.col("tp") / F.col("n"), 1).alias("exact_pct"), F.round(p, 4).alias("precision"), F.round(r, 4).alias("recall"), F.round(ratio(2 * p * r, p + r), 4).alias("f1"))


def confusion(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy(F.upper("truth").alias("truth"), F.upper(F.coalesce("predicted", F.lit("NONE"))).alias("predicted")).agg(F.count("*").alias("n"))


#: The mark of an absent field, the score of a partial match, and the least score that counts as a match.
ABSENT, PARTIAL, MATCH = "Desconocido", 0.85, 0.5
#: Letters with marks up to U+024F, and the plain letters they are folded to.
_MARKED = {c: d[0] for c in map(chr, range(0xC0, 0x250)) if len(d := unicodedata.normalize("NFD", c)) > 1 and d[0].isascii()}


def folded(value: Column) -> Column:
    """Lower case without marks and punctuation, blanks run together; null is empty. Other scripts' letters are left out."""
    plain = F.translate(F.lower(F.coalesce(value, F.lit(""))), "".join(_MARKED), "".join(_MARKED.values()))
    return F.trim(F.regexp_replace(F.regexp_replace(plain, r"[^a-zA-Z0-9\s]", ""), r"\s+", " "))


def token_jaccard(a: Column, b: Column) -> Column:
    """Words that two folded texts share, over all their words; null where both are empty."""
    words = lambda x: F.filter(F.split(x, " "), lambda w: w != "")
    return F.try_divide(F.size(F.array_intersect(words(a), words(b))).cast("double"), F.size(F.array_union(words(a), words(b))))


def match_fields(pairs: DataFrame) -> DataFrame:
    """pairs with `exact` and `score`: 1 for equal folded values, 0.85 where one holds the other, else their token Jaccard from 0.5.

    A null truth or prediction counts as absent. One empty value and one with text score 0.
    """
    named = pairs.withColumns({c: F.coalesce(c, F.lit(ABSENT)) for c in ("truth", "predicted")}).withColumns({"_x": folded(F.col("truth")), "_y": folded(F.col("predicted"))})
    x, y, share = F.col("_x"), F.col("_y"), token_jaccard(F.col("_x"), F.col("_y"))
    score = F.when(x == y, 1.0).when((x == "") | (y == ""), 0.0).when(F.contains(x, y) | F.contains(y, x), PARTIAL).when(share >= MATCH, share).otherwise(0.0)
    return named.withColumns({"exact": x == y, "score": score}).drop("_x", "_y")


def _by_field(pairs: DataFrame) -> DataFrame:
    hit = F.col("score") >= MATCH
    said = lambda c: ~F.col(c).isin("", ABSENT)
    counts = match_fields(pairs).groupBy("field").agg(F.count("*").alias("n"), F.count_if("exact").alias("exact"), F.count_if(hit).alias("tp"), F.count_if(~hit & said("predicted")).alias("fp"), F.count_if(~hit & said("truth")).alias("fn"))
    share = lambda other: F.coalesce(F.try_divide(F.col("tp"), F.col("tp") + F.col(other)), F.lit(1.0))
    return counts.withColumns({"p": share("fp"), "r": share("fn")}).withColumn("f", F.coalesce(F.try_divide(2 * F.col("p") * F.col("r"), F.col("p") + F.col("r")), F.lit(0.0)))


def field_scores(pairs: DataFrame) -> DataFrame:
    """pairs (item, field, truth, predicted) -> one row a field by tolerant matches: tp, fp, fn, exact_pct, precision, recall, f1."""
    return _by_field(pairs).select("field", "tp", "fp", "fn", F.round(100 * F.col("exact") / F.col("n"), 2).alias("exact_pct"), *[F.round(a, 4).alias(b) for a, b in (("p", "precision"), ("r", "recall"), ("f", "f1"))])


def evaluation_summary(pairs: DataFrame) -> DataFrame:
    """One row over all fields: items, the mean score of items, and macro and micro precision, recall and f1."""
    items = match_fields(pairs).groupBy("item").agg(F.avg(F.when(F.col("score") >= MATCH, F.col("score")).otherwise(0.0)).alias("s")).agg(F.count("*").alias("items"), F.round(F.avg("s"), 4).alias("item_score"))
    share = lambda other: F.round(F.coalesce(F.try_divide(F.sum("tp"), F.sum("tp") + F.sum(other)), F.lit(0.0)), 4)
    fields = _by_field(pairs).agg(*[F.round(F.avg(a), 4).alias(f"macro_{b}") for a, b in (("p", "precision"), ("r", "recall"), ("f", "f1"))], share("fp").alias("micro_precision"), share("fn").alias("micro_recall"))
    p, r = F.col("micro_precision"), F.col("micro_recall")
    return items.crossJoin(F.broadcast(fields)).withColumn("micro_f1", F.round(F.coalesce(F.try_divide(2 * p * r, p + r), F.lit(0.0)), 4))
