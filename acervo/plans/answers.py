"""Queries of the property graph and of evaluations from answers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from acervo.functions.lookups import STATES, TYPES
from acervo.operators import answers, property_graph
from acervo.plans.bindings import EVALUATIONS_SQL, PROJECTS_SQL, evaluations, projects, table
from acervo.plans.registry import _case, query

_STEM = "CASE WHEN o_orderkey % 4 = 0 THEN 'G_asea_' ELSE 'G' END || (o_orderkey // 40)::VARCHAR"
_GRAPH = f"""{PROJECTS_SQL}, {EVALUATIONS_SQL},
seen AS (SELECT clave, 0 AS rank, {_STEM} AS stem FROM projects WHERE o_orderkey % 5 < 2 UNION ALL SELECT clave, 1, 'N' || o_orderkey::VARCHAR FROM projects WHERE o_orderkey % 3 = 0),
first AS (SELECT clave, arg_min(stem, rank || stem) AS gazette FROM seen GROUP BY 1),
reports AS (SELECT clave, max(CASE WHEN o_orderkey % 9 <> 0 THEN project_name END) AS project_name, max(veredicto) AS veredicto, max(score) AS score, max(confianza_pct) AS confianza_pct FROM projects JOIN evaluations USING (o_orderkey) WHERE o_orderkey % 2 = 0 GROUP BY 1),
vertices AS (SELECT clave, coalesce(project_name, 'Proyecto ' || clave) AS name, substr(clave, 5, 4)::INT AS year, substr(clave, 1, 2) AS sector, coalesce(veredicto, 'PENDIENTE') AS veredicto, coalesce(score, 0.0)::DOUBLE AS score, coalesce(confianza_pct, 0)::INT AS confianza_pct,
  substr(clave, 3, 2) AS state, {_case("substr(clave, 3, 2)", STATES)} AS state_name, substr(clave, 9, 1) AS kind, {_case("substr(clave, 9, 1)", TYPES)} AS kind_name, substr(clave, 10) AS seq, gazette FROM first LEFT JOIN reports USING (clave))"""


def _vertices(spark: SparkSession, d: str) -> DataFrame:
    """Gazettes of forty orders each, so that their number grows with the orders."""
    rows, k = projects(spark, d), F.col("o_orderkey")
    stem = F.concat(F.when(k % 4 == 0, "G_asea_").otherwise("G"), F.floor(k / 40).cast("string"))
    reports = rows.join(evaluations(spark, d), "o_orderkey").where(k % 2 == 0).groupBy("clave").agg(F.max(F.when(k % 9 != 0, F.col("project_name"))).alias("project_name"), *[F.max(c).alias(c) for c in ("veredicto", "score", "confianza_pct")])
    return property_graph.project_vertices(rows.where(k % 5 < 2).select("clave", stem.alias("stem")), rows.where(k % 3 == 0).select("clave", F.concat(F.lit("N"), k.cast("string")).alias("stem")), reports)


@query(f"WITH {_GRAPH} SELECT * FROM vertices")
def property_graph_projects(spark: SparkSession, d: str) -> DataFrame:
    return _vertices(spark, d)


@query(f"WITH {_GRAPH} SELECT DISTINCT 'Estado' AS label, state AS id, state_name AS text FROM vertices UNION SELECT 'TipoMIA', kind, kind_name FROM vertices UNION SELECT 'Gaceta', gazette, CASE WHEN contains(gazette, 'asea') THEN 'ASEA' ELSE 'SEMARNAT' END FROM vertices")
def property_graph_others(spark: SparkSession, d: str) -> DataFrame:
    return property_graph.other_vertices(_vertices(spark, d))


@query(f"WITH {_GRAPH} SELECT clave, 'UBICADO_EN' AS relation, 'Estado' AS label, state AS id FROM vertices UNION ALL SELECT clave, 'ES_TIPO', 'TipoMIA', kind FROM vertices UNION ALL SELECT clave, 'PUBLICADO_EN', 'Gaceta', gazette FROM vertices")
def property_graph_edges(spark: SparkSession, d: str) -> DataFrame:
    return property_graph.property_edges(_vertices(spark, d))


@query(f"WITH {_GRAPH} SELECT count(*) AS n_projects, count(DISTINCT state) AS n_estados, count(DISTINCT kind) AS n_tipos, count(DISTINCT gazette) AS n_gacetas, count(*) * 3 AS n_relations FROM vertices")
def property_graph_counts(spark: SparkSession, d: str) -> DataFrame:
    return property_graph.property_counts(_vertices(spark, d))


_SCORE = "CASE WHEN o_orderkey % 7 = 0 THEN NULL WHEN o_orderkey % 3 = 0 THEN (o_orderkey % 100 + 2)::DOUBLE ELSE (o_orderkey % 9 / 8)::DOUBLE END"
_VERDICT = "CASE o_orderkey % 4 WHEN 0 THEN 'DESFAVORABLE' WHEN 1 THEN 'CONDICIONADO' WHEN 2 THEN 'FAVORABLE' END"


@query(f"""WITH {PROJECTS_SQL}, r AS (SELECT *, coalesce({_SCORE}, 0.0) AS s, {_VERDICT} AS v, CASE WHEN o_orderkey % 5 <> 0 THEN (o_orderkey % 101)::INT ELSE 80 END AS pct FROM projects)
SELECT o_orderkey, clave, coalesce(v, 'CONDICIONADO') AS veredicto, CASE WHEN s > 1 THEN s / 100 ELSE s END AS score, pct AS confianza_pct, CASE WHEN o_orderkey % 6 = 0 THEN 'Proyecto ' || clave ELSE project_name END AS project_name, CASE WHEN o_orderkey % 6 = 1 THEN 'No especificado' ELSE sponsor END AS promovente,
  CASE WHEN o_orderkey % 2 = 0 THEN 'S' || o_orderkey::VARCHAR ELSE 'Evaluación de viabilidad socio-ambiental para el proyecto ' || clave END AS summary, CASE v WHEN 'DESFAVORABLE' THEN 'ALTO' WHEN 'CONDICIONADO' THEN 'MEDIO' ELSE 'BAJO' END AS legal_risk_level, pct / 100 AS confidence_score FROM r""")
def normal_evaluations(spark: SparkSession, d: str) -> DataFrame:
    k, e = F.col("o_orderkey"), lambda sql: F.expr(sql.replace("::DOUBLE", ""))
    report = F.struct(e(_VERDICT).alias("veredicto"), e(_SCORE).alias("score"), F.when(k % 5 != 0, k % 101).alias("confianza_pct"), F.when(k % 2 == 0, F.concat(F.lit("S"), k.cast("string"))).alias("summary"))
    row = answers.normal_evaluation(F.col("clave"), report, F.when(k % 6 != 0, F.col("project_name")), F.when(k % 6 == 1, "").otherwise(F.col("sponsor")))
    return projects(spark, d).select("o_orderkey", row.alias("e")).select("o_orderkey", "e.*")


@query("""SELECT event_id, CASE WHEN event_id % 4 IN (1, 2) THEN event_type ELSE 'Resumen ejecutivo no disponible para ' || user_id || '.pdf.' END AS resumen_ejecutivo, CASE WHEN event_id % 4 = 1 THEN 'a,' || event_type ELSE 'Documento ' || user_id || '.pdf procesado sin detalles del LLM.' END AS puntos_clave,
  CASE WHEN event_id % 4 IN (1, 3) THEN user_id::VARCHAR END AS promovente, CASE WHEN event_id % 4 = 1 THEN 'listo' ELSE 'N/A' END AS estatus, 'Documento general PDF' AS tipo_actividad FROM events""")
def filled_answers(spark: SparkSession, d: str) -> DataFrame:
    """Answers about events: whole and fenced, without metadata, without a summary, or no JSON at all."""
    k = F.col("event_id") % 4
    raw = F.when(k == 1, F.format_string('```json\n{"resumen_ejecutivo": "%s", "puntos_clave": ["a", "%s"], "metadatos": {"promovente": "%d", "estatus": "listo"}}\n```', "event_type", "event_type", "user_id"))
    raw = raw.when(k == 2, F.format_string('{"resumen_ejecutivo": "%s", "otro": [1]}', "event_type")).when(k == 3, F.format_string('``` {"metadatos": {"promovente": "%d"}}```', "user_id")).otherwise(F.lit("sin respuesta {"))
    rows = table(spark, d, "events").select("event_id", answers.filled_answer(raw, F.concat(F.col("user_id").cast("string"), F.lit(".pdf"))).alias("a"))
    return rows.select("event_id", "a.resumen_ejecutivo", F.array_join("a.puntos_clave", ",").alias("puntos_clave"), "a.metadatos.promovente", "a.metadatos.estatus", "a.metadatos.tipo_actividad")


_NOTE = "CASE doc_id % 3 WHEN 0 THEN '# Obra # ' || source || chr(10) || text WHEN 1 THEN 'a' || chr(10) || '# D' || doc_id::VARCHAR || chr(10) || text ELSE '' END"


@query(f"""SELECT doc_id, 'D' || doc_id AS clave, CASE WHEN doc_id % 3 = 0 THEN 'Obra ' || source ELSE 'Proyecto D' || doc_id END AS project_name, 'Información no extractable' AS promovente, CASE WHEN doc_id % 3 = 2 THEN 'Sin resumen disponible.' ELSE regexp_replace(replace(substr({_NOTE}, 1, 300), chr(10), ' '), '^\\s+|\\s+$', '', 'g') END AS summary,
  'Suelo/Flora' AS category, 'MEDIA' AS severity, 2::BIGINT AS n_mitigations, 'MEDIO' AS legal_risk_level, 0.7::DOUBLE AS confidence_score FROM documents WHERE source IS NOT NULL""")
def text_evaluations(spark: SparkSession, d: str) -> DataFrame:
    """Texts under a title, under their own key, and none."""
    docs = table(spark, d, "documents").where("source IS NOT NULL")
    rows = docs.select("doc_id", answers.text_evaluation(F.concat(F.lit("D"), F.col("doc_id").cast("string")), F.expr(_NOTE.replace("::VARCHAR", ""))).alias("e")).select("doc_id", "e.*")
    return rows.withColumns({"category": F.col("impacts")[0]["category"], "severity": F.col("impacts")[0]["severity"], "n_mitigations": F.size("mitigations").cast("long")}).drop("impacts", "mitigations")
