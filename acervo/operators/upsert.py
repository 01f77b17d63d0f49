"""Upserts as set operations: the caller writes the result to a new path and swaps it in."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """new rows replace old rows of the same key; keys in new must be distinct."""
    return old.join(new.select(*keys), keys, "left_anti").unionByName(new, allowMissingColumns=True)


def insert_ignore(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Only keys that old lacks are added."""
    return old.unionByName(new.join(old.select(*keys), keys, "left_anti"), allowMissingColumns=True)


def upsert_coalesce(old: DataFrame, new: DataFrame, keys: list[str], placeholder: str = "Desconocido") -> DataFrame:
    """As upsert, but a null or placeholder in new keeps the old value."""
    others = [c for c in new.columns if c not in keys]
    fresh = lambda c: F.when(F.col(f"n.{c}").cast("string") != placeholder, F.col(f"n.{c}"))
    return old.alias("o").join(new.alias("n"), keys, "full").select(*keys, *[F.coalesce(fresh(c), F.col(f"o.{c}")).alias(c) for c in others])


def accumulate_weight(old: DataFrame, seen: DataFrame, keys: list[str], step: float = 0.1) -> DataFrame:
    """Edge weights: 1.0 at first sight, `step` more at each later one."""
    counts = seen.groupBy(*keys).agg(F.count("*").alias("_n"))
    added = F.coalesce("_n", F.lit(0))
    return old.join(counts, keys, "full").select(*keys, F.round(F.coalesce(F.col("weight") + step * added, 1.0 + step * (added - 1)), 4).alias("weight"))


def increment(old: DataFrame, seen: DataFrame, keys: list[str], count: str = "n") -> DataFrame:
    """Counters by key: old counts plus the rows seen."""
    return old.select(*keys, count).unionByName(seen.select(*keys, F.lit(1).cast("long").alias(count))).groupBy(*keys).agg(F.sum(count).alias(count))


def update_matching(old: DataFrame, new: DataFrame, keys: list[str], columns: list[str], stamp: str | None = None, now: Column | None = None) -> DataFrame:
    """Only keys of old are updated, only in `columns` and only by values that are not null; changed rows get the stamp."""
    both = old.alias("o").join(new.select(*keys, *columns, F.lit(True).alias("_hit")).alias("n"), keys, "left")
    pick = lambda c: F.coalesce(F.col(f"n.{c}"), F.col(f"o.{c}")).alias(c) if c in columns else F.when(F.col("_hit"), now).otherwise(F.col(f"o.{c}")).alias(c) if c == stamp else F.col(f"o.{c}")
    return both.select(*keys, *[pick(c) for c in old.columns if c not in keys])
