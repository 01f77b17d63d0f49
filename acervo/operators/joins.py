"""Enrichment by precedence, status matrices, as-of context."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from acervo.functions.lookups import is_missing


def enrich(base: DataFrame, sources: list[DataFrame], key: str, columns: list[str], default: str = "Desconocido") -> DataFrame:
    """columns of base from the first source that has a non-blank value, then base's own, then the default."""
    out = base.alias("b")
    for i, source in enumerate(sources):
        out = out.join(source.select(key, *[F.col(c).alias(f"_{i}_{c}") for c in columns]), key, "left")
    full = lambda c: F.when(F.trim(c) != "", c)
    picks = [F.coalesce(*[full(F.col(f"_{i}_{c}")) for i in range(len(sources))], full(F.col(c)), F.lit(default)).alias(c) for c in columns]
    return out.select(*[c for c in base.columns if c not in columns], *picks)


def fill_missing(base: DataFrame, extracted: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Only missing values of base are filled, and only by values that are not missing themselves."""
    other = extracted.select(key, *[F.col(c).alias(f"_{c}") for c in columns])
    pick = lambda c: F.when(is_missing(F.col(c)) & ~is_missing(F.col(f"_{c}")), F.col(f"_{c}")).otherwise(F.col(c)).alias(c)
    return base.join(other, key, "left").select(*[c if c not in columns else pick(c) for c in base.columns])


def status_matrix(keys: DataFrame, files: DataFrame, kinds: list[str], key: str = "clave") -> DataFrame:
    """For each key a flag for each kind of file, their number, and complete / partial / failed."""
    flags = files.groupBy(key).agg(*[F.max(F.when(F.col("kind") == k, 1).otherwise(0)).alias(f"has_{k}") for k in kinds])
    out = keys.select(key).distinct().join(flags, key, "left").select(key, *[F.coalesce(f"has_{k}", F.lit(0)).alias(f"has_{k}") for k in kinds])
    total = sum(F.col(f"has_{k}") for k in kinds)
    return out.withColumn("present", total).withColumn("status", F.when(total == len(kinds), "complete").when(total > 0, "partial").otherwise("failed"))


def asof_last(points: DataFrame, gaps: DataFrame, vessel: str, n: int = 12, least: int = 3) -> DataFrame:
    """The last n points before each gap of the same vessel, as (gap_id, points_before, mean_value, last_ts); fewer than `least` give none.

    A gap is put among its vessel's points by a union and one sort, so no range join is needed.
    """
    return _before(points, gaps, vessel, n, least).groupBy("gap_id").agg(F.count("*").alias("points_before"), F.round(F.avg("p_value"), 6).alias("mean_value"), F.max("p_ts").alias("last_ts"))


def asof_context(points: DataFrame, gaps: DataFrame, vessel: str, n: int = 12, least: int = 3) -> DataFrame:
    """(gap_id, context): the values of the points that asof_last takes, in time order, the last repeated until there are n."""
    taken = _before(points, gaps, vessel, n, least).groupBy("gap_id").agg(F.array_sort(F.collect_list(F.struct("_k", "p_value"))).alias("p"))
    values = F.transform("p", lambda x: x["p_value"])
    return taken.select("gap_id", F.concat(values, F.array_repeat(F.element_at(values, -1), n - F.size(values))).alias("context"))


def _before(points: DataFrame, gaps: DataFrame, vessel: str, n: int, least: int) -> DataFrame:
    """(vessel, _k, gap_id, p_ts, p_value): the last n points before each gap that has at least `least`."""
    events = points.select(vessel, F.col("ts"), F.col("value"), F.lit(None).cast("long").alias("gap_id"), F.lit(1).alias("_o")).unionByName(gaps.select(vessel, F.col("gap_start").alias("ts"), F.lit(None).cast("double").alias("value"), "gap_id", F.lit(0).alias("_o")))
    before = Window.partitionBy(vessel).orderBy("ts", "_o").rowsBetween(Window.unboundedPreceding, -1)
    recent = events.withColumn("_p", F.when(F.col("_o") == 1, F.struct("ts", "value"))).withColumn("_seen", F.count("_p").over(before))
    numbered = recent.where("_o = 1").select(vessel, F.col("ts").alias("p_ts"), F.col("value").alias("p_value"), (F.col("_seen") + 1).alias("_k"))
    wanted = recent.where("_o = 0").select(vessel, "gap_id", F.explode(F.sequence(F.greatest(F.lit(1), F.col("_seen") - n + 1), F.greatest(F.lit(1), F.col("_seen")))).alias("_k"), "_seen").where(F.col("_seen") >= least)
    return wanted.join(numbered, [vessel, "_k"])


def project_details(projects: DataFrame, sponsors: DataFrame, evaluations: DataFrame, sponsor_key: str, key: str) -> DataFrame:
    """All projects with their sponsor and evaluation where there are such; null keys match none. Sponsors and evaluations have one row a key."""
    return projects.join(sponsors, sponsor_key, "left").join(evaluations, key, "left")
