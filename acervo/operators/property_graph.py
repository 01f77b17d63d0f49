"""A property graph of projects, states, types and gazettes as vertex and edge tables, with its counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from acervo.operators.keys import parse_key


def project_vertices(gazettes: DataFrame, notes: DataFrame, reports: DataFrame) -> DataFrame:
    """One row for each well-formed key that a gazette or note (stem, clave) mentions, with what the key and its report tell.

    gazette is the first gazette by name, or the first note of a key that no gazette has. reports (clave, project_name,
    veredicto, score, confianza_pct) have one row a key; what they lack is `Proyecto key`, PENDIENTE, 0 and 0. Mentions
    are reduced to the first of each key before any join; rows without a key or stem give none.
    """
    seen = gazettes.select("clave", F.struct(F.lit(0).alias("rank"), "stem").alias("at")).unionByName(notes.select("clave", F.struct(F.lit(1).alias("rank"), "stem").alias("at")))
    first = seen.where("clave IS NOT NULL AND at.stem IS NOT NULL").groupBy("clave").agg(F.min("at").alias("at"))
    rows = parse_key(first, "clave").where("valid").join(reports.select("clave", "project_name", "veredicto", "score", "confianza_pct"), "clave", "left")
    return rows.select(
        "clave", F.coalesce("project_name", F.concat(F.lit("Proyecto "), F.col("clave"))).alias("name"), F.col("key_year").alias("year"), "sector", F.coalesce("veredicto", F.lit("PENDIENTE")).alias("veredicto"),
        F.coalesce("score", F.lit(0.0)).alias("score"), F.coalesce("confianza_pct", F.lit(0)).alias("confianza_pct"), "state", "state_name", "kind",
        F.when(F.col("kind_name") == F.col("kind"), F.concat(F.lit("Tipo "), F.col("kind"))).otherwise(F.col("kind_name")).alias("kind_name"), "seq", F.col("at.stem").alias("gazette"),
    )


def other_vertices(projects: DataFrame) -> DataFrame:
    """(label, id, text): the states and types of project_vertices with their names, and its gazettes with who issued them."""
    node = lambda label, i, text: F.struct(F.lit(label).alias("label"), F.col(i).alias("id"), text.alias("text"))
    issuer = F.when(F.lower("gazette").contains("asea"), "ASEA").otherwise("SEMARNAT")
    nodes = F.array(node("Estado", "state", F.col("state_name")), node("TipoMIA", "kind", F.col("kind_name")), node("Gaceta", "gazette", issuer))
    return projects.select(F.explode(nodes).alias("n")).select("n.*").distinct()


def property_edges(projects: DataFrame) -> DataFrame:
    """(clave, relation, label, id): each project's state, type and gazette; no shuffle."""
    edge = lambda relation, label, i: F.struct(F.lit(relation).alias("relation"), F.lit(label).alias("label"), F.col(i).alias("id"))
    return projects.select("clave", F.explode(F.array(edge("UBICADO_EN", "Estado", "state"), edge("ES_TIPO", "TipoMIA", "kind"), edge("PUBLICADO_EN", "Gaceta", "gazette"))).alias("e")).select("clave", "e.*")


def property_counts(projects: DataFrame) -> DataFrame:
    """One row: n_projects, n_estados, n_tipos, n_gacetas, n_relations."""
    return projects.agg(F.count("*").alias("n_projects"), F.countDistinct("state").alias("n_estados"), F.countDistinct("kind").alias("n_tipos"), F.countDistinct("gazette").alias("n_gacetas"), (F.count("*") * 3).alias("n_relations"))
