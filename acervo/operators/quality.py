"""Audits: alerts for each broken rule, and the rows that keep all of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from acervo.functions.lookups import AUDIT_KEY, STATES, is_mock_key

VERDICTS = ("VIABLE", "NO_VIABLE", "CONDICIONADO", "PENDIENTE")


def _alert(broken: Column, field: str, error: str, level: str = "CRITICAL") -> Column:
    return F.when(F.coalesce(broken, F.lit(False)), F.struct(F.lit(field).alias("field"), F.lit(error).alias("error"), F.lit(level).alias("level")))


def _blank(c: str) -> Column:
    return F.coalesce(F.trim(F.col(c).cast("string")) == "", F.lit(True))


def audit_projects(rows: DataFrame, as_of_year: int, verdict_free: tuple[str, ...] = ("evaluac", "proceso")) -> DataFrame:
    """Adds alerts, an array of (field, error, level), to projects (clave, project_name, status, state, year, files_downloaded).

    Year and state are checked for well-formed keys only. A row without a CRITICAL alert is clean.
    """
    key = F.coalesce(F.col("clave"), F.lit(""))
    known = F.upper(F.trim("state")).isin(*STATES) | F.lower(F.trim("state")).isin(*[x.lower() for x in STATES.values()])
    status = F.lower(F.coalesce("status", F.lit("")))
    facts = F.struct(
        F.substring(key, 5, 4).alias("key_year"), (~key.rlike(AUDIT_KEY) | is_mock_key(key)).alias("bad"), F.coalesce(F.col("year").cast("string"), F.lit("")).alias("year"),
        F.expr("try_cast(year AS int)").alias("number"), F.coalesce(known, F.lit(False)).alias("known"), F.array_max(F.array(*[status.contains(x) for x in verdict_free])).alias("open"),
        F.coalesce(F.exists("files_downloaded", lambda f: f.contains("estudio")), F.lit(False)).alias("study"),
    )
    # a generator's row is computed once, however many checks and filters read it
    checked = rows.withColumn("_x", F.explode(F.array(facts)))
    x = lambda c: F.col(f"_x.{c}")
    checks = [
        *[_alert(_blank(c), c, "required") for c in ("clave", "project_name", "status")],
        _alert(x("bad"), "clave", "format"),
        _alert(~x("bad") & ~F.contains(x("year"), x("key_year")), "year", "mismatch"),
        _alert(~x("bad") & x("number").isNull(), "year", "not a number"),
        _alert(~x("bad") & ~x("number").between(1990, as_of_year + 1), "year", "range"),
        _alert(~x("bad") & ~x("known"), "state", "unknown"),
        _alert(~x("bad") & x("open") & ~x("study"), "files_downloaded", "no study", "WARNING"),
    ]
    return checked.withColumn("alerts", F.array_compact(F.array(*checks))).drop("_x")


def audit_evaluations(rows: DataFrame, verdicts: tuple[str, ...] = VERDICTS) -> DataFrame:
    """Adds alerts to evaluations (veredicto, score, confianza_pct); an absent score or confidence counts as 0."""
    score, confidence = F.coalesce(F.expr("try_cast(score AS double)"), F.when(F.col("score").isNull(), 0.0)), F.coalesce(F.expr("try_cast(confianza_pct AS int)"), F.when(F.col("confianza_pct").isNull(), 0))
    checks = [
        _alert(~F.coalesce(F.upper("veredicto").isin(*verdicts), F.lit(False)), "veredicto", "unknown"),
        _alert(score.isNull(), "score", "not a number"),
        _alert(~score.between(0.0, 1.0), "score", "range"),
        _alert(confidence.isNull(), "confianza_pct", "not a number"),
        _alert(~confidence.between(0, 100), "confianza_pct", "range"),
    ]
    return rows.withColumn("alerts", F.array_compact(F.array(*checks)))


def is_clean() -> Column:
    return ~F.exists("alerts", lambda a: a["level"] == "CRITICAL")


def explode_alerts(rows: DataFrame, *keep: str) -> DataFrame:
    return rows.select(*keep, F.explode("alerts").alias("a")).select(*keep, "a.field", "a.error", "a.level")


def null_profile(rows: DataFrame) -> DataFrame:
    """(column_name, nulls, pct) of the columns that have nulls; one pass over the rows."""
    columns = rows.columns
    counts = rows.agg(F.count("*").alias("_all"), *[F.count_if(F.col(c).isNull()).alias(c) for c in columns])
    return counts.unpivot("_all", columns, "column_name", "nulls").where("nulls > 0").select("column_name", "nulls", F.round(100 * F.col("nulls") / F.col("_all"), 2).alias("pct"))


def duplicate_count(rows: DataFrame, key: str) -> DataFrame:
    """Rows beyond the first of each key; null is one key."""
    return rows.groupBy(key).count().agg((F.sum("count") - F.count("*")).alias("duplicates"))
