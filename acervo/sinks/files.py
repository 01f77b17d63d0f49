"""File sinks. Sorted outputs are range-partitioned: their files follow one another and no task holds all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_key_registry(rows: DataFrame, path: str, order: tuple[str, ...] = ("source", "file", "clave")) -> None:
    """CSV of (clave, year, source, file, name, location, promovente), sorted."""
    rows.select("clave", "year", "source", "file", "name", "location", "promovente").orderBy(*order).write.mode("overwrite").csv(path, header=True)


def quality_summary(audited: DataFrame) -> DataFrame:
    """One row (total, clean, dropped, warnings, clean_pct) of audited rows; 100 per cent where there are none."""
    bad = F.exists("alerts", lambda a: a["level"] == "CRITICAL")
    counts = audited.agg(F.count("*").alias("total"), F.count_if(~bad).alias("clean"), F.count_if(bad).alias("dropped"), F.coalesce(F.sum(F.size(F.filter("alerts", lambda a: a["level"] == "WARNING"))), F.lit(0)).alias("warnings"))
    return counts.withColumn("clean_pct", F.coalesce(F.round(F.try_divide(100.0 * F.col("clean"), F.col("total")), 1), F.lit(100.0)))


def write_quality_report(audited: DataFrame, path: str, key: str) -> None:
    """path/metrics and path/alerts as JSON, path/summary as a Markdown table."""
    summary = quality_summary(audited)
    summary.write.mode("overwrite").json(f"{path}/metrics")
    audited.select(key, F.explode("alerts").alias("a")).select(key, "a.*").write.mode("overwrite").json(f"{path}/alerts")
    lines = ["| medida | valor |", "|---|---|", *["| " + c + " | {} |" for c in summary.columns]]
    text = F.concat_ws("\n", *[F.lit(x) if "{}" not in x else F.concat(F.lit(x.split("{}")[0]), F.col(x.split()[1]).cast("string"), F.lit(" |")) for x in lines])
    summary.select(text.alias("value")).write.mode("overwrite").text(f"{path}/summary")


def write_area_report(sections: dict[str, DataFrame], path: str, preset: str = "preset") -> None:
    """path/<section>/<preset>= CSV of vessels, occurrences, encounters; null text is empty and null numbers are 0."""
    for name, rows in sections.items():
        rows.fillna("").fillna(0.0).write.mode("overwrite").partitionBy(preset).csv(f"{path}/{name}", header=True)


def write_compact_graph(links: DataFrame, metrics: DataFrame, path: str) -> None:
    links.write.mode("overwrite").json(f"{path}/links")
    metrics.write.mode("overwrite").json(f"{path}/metrics")


def write_notes(notes: DataFrame, path: str, folder: str = "folder") -> None:
    """(note_path, content) as Parquet by folder: one table, not one file a note."""
    notes.write.mode("overwrite").partitionBy(folder).parquet(path)
