"""Chunks, tags and heuristic scores of texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Signal patterns.
YES = (r"medidas?\s+de\s+mitigación", r"impacto\s+(bajo|mínimo|menor)", r"plan\s+de\s+manejo", r"restauración\s+ecológica")
NO = (r"impacto\s+(alto|significativo|grave|irreversible)", r"sin\s+medidas?\s+de\s+mitigación", r"área\s+natural\s+protegida", r"especie\s+en\s+peligro")


def chunk_chars(docs: DataFrame, key: str, text: str, size: int = 2000, step: int = 1700) -> DataFrame:
    """(key, chunk, body): windows of `size` characters; a text of at most that is one chunk."""
    n = F.length(text)
    last = F.when(n <= size, 0).otherwise(F.floor((n - 1) / step)).cast("int")
    return docs.where(F.col(text).isNotNull()).select(key, F.col(text).alias("_t"), F.explode(F.sequence(F.lit(0), last)).alias("chunk")).select(key, F.col("chunk").cast("long"), F.substring(F.col("_t"), F.col("chunk") * step + 1, F.lit(size)).alias("body"))


def chunk_words(docs: DataFrame, key: str, text: str, size: int = 500, step: int = 450) -> DataFrame:
    """(key, chunk, n_words, body): windows of `size` words up to the one that reaches the end."""
    words = F.filter(F.split(text, r"\s+"), lambda w: w != "")
    rows = docs.where(F.col(text).isNotNull()).select(key, words.alias("_w")).where(F.size("_w") > 0)
    last = F.greatest(F.lit(0), F.ceil((F.size("_w") - size) / step)).cast("int")
    part = F.slice("_w", F.col("chunk") * step + 1, F.lit(size))
    return rows.select(key, "_w", F.explode(F.sequence(F.lit(0), last)).alias("chunk")).select(key, F.col("chunk").cast("long"), F.size(part).cast("long").alias("n_words"), F.array_join(part, " ").alias("body"))


def tag_lines(docs: DataFrame, key: str, text: str, patterns: dict[str, str]) -> DataFrame:
    """(key, line_no, tag): non-blank lines that a tag's pattern matches, ignoring case."""
    lines = docs.select(key, F.posexplode(F.split(text, "\n")).alias("line_no", "_l")).where(F.trim("_l") != "")
    tags = F.array_compact(F.array(*[F.when(F.col("_l").rlike(f"(?i){p}"), F.lit(t)) for t, p in patterns.items()]))
    return lines.select(key, F.col("line_no").cast("long"), F.explode(tags).alias("tag"))


def preview(text: Column, words: int = 500) -> Column:
    """The first words with single blanks between them, and an ellipsis if there are more; null stays null."""
    parts = F.filter(F.split(text, r"\s+"), lambda w: w != "")
    return F.concat(F.array_join(F.slice(parts, 1, words), " "), F.when(F.size(parts) > words, "…").otherwise(""))


def heuristic_score(text: Column, yes: tuple[str, ...] = YES, no: tuple[str, ...] = NO) -> Column:
    """Share of positive signals. The limit of 5 stops one pattern only, so each later pattern with hits still adds one."""

    def capped(patterns: tuple[str, ...]) -> Column:
        hits = F.array(*[F.regexp_count(text, F.lit(f"(?iu){p}")) for p in patterns])
        return F.aggregate(hits, F.lit(0), lambda have, n: have + F.least(n, F.greatest(F.lit(1), 5 - have)))

    good, bad = capped(yes), capped(no)
    return F.round(good / F.greatest(good + bad, F.lit(1)), 2)


def verdict(score: Column) -> Column:
    return F.when(score >= 0.6, "FAVORABLE").when(score >= 0.3, "CONDICIONADO").otherwise("DESFAVORABLE")


def signal_contexts(text: Column, patterns: tuple[str, ...], around: int = 50, most: int = 5) -> Column:
    """The first `most` hits, pattern after pattern, each with `around` characters on both sides and no white space at its ends."""
    parts = F.array(*[F.struct(F.split(text, f"(?iu){p}").alias("between"), F.regexp_extract_all(text, F.lit(f"(?iu){p}"), F.lit(0)).alias("hits")) for p in patterns])
    total = lambda xs, n: F.aggregate(F.slice(xs, 1, n), F.lit(0), lambda have, x: have + F.length(x))

    def context(x: Column, hit: Column, i: Column) -> Column:
        start = total(x["between"], i + 1) + total(x["hits"], i)
        first = F.greatest(start - around, F.lit(0))
        return F.regexp_replace(F.substring(text, first + 1, start + F.length(hit) + around - first), r"^\s+|\s+$", "")

    found = F.transform(parts, lambda x: F.transform(F.slice(x["hits"], 1, most), lambda hit, i: context(x, hit, i)))
    return F.coalesce(F.slice(F.flatten(found), 1, most), F.array().cast("array<string>"))


def heuristic_report(text: Column, knockouts: Column, yes: tuple[str, ...] = YES, no: tuple[str, ...] = NO) -> Column:
    """(veredicto, score, confianza_pct, yes_signals, no_signals, knockouts): signals with contexts, or the knockouts alone if there are any.

    A null text has no signals; null knockouts are none.
    """
    out, none = F.coalesce(F.size(knockouts) > 0, F.lit(False)), F.array().cast("array<string>")
    score = F.when(out, 0.0).otherwise(F.coalesce(heuristic_score(text, yes, no), F.lit(0.0)))
    return F.struct(
        verdict(score).alias("veredicto"), score.alias("score"), F.when(out, 100).otherwise(40).alias("confianza_pct"), F.when(out, none).otherwise(signal_contexts(text, yes)).alias("yes_signals"),
        F.when(out, F.array(F.lit("Knockout automático detectado"))).otherwise(signal_contexts(text, no)).alias("no_signals"), F.when(out, knockouts).otherwise(none).alias("knockouts"),
    )
