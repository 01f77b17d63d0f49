"""Domain shapes over the given tables, in SQL that Spark and DuckDB share where they can."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CODES = ("AG", "BC", "BS", "CM", "CS", "CH", "CO", "CL", "DF", "DG", "GT", "GR", "HG", "JL", "ME", "MI", "MO", "NA", "NL", "OA", "PU", "QT", "QR", "SL", "SI")
VERDICT_RULE = "CASE WHEN o_totalprice % 5 < 1 THEN 'VIABLE' WHEN o_totalprice % 5 < 2 THEN 'NO_VIABLE' WHEN o_totalprice % 5 < 3 THEN 'CONDICIONADO' WHEN o_totalprice % 5 < 4 THEN 'PENDIENTE' ELSE 'FAVORABLE' END"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def projects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """orders with their customers as projects: (o_orderkey, clave, project_name, sponsor, municipality, status, year, state)."""
    orders, customers = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    state = F.element_at(F.array(*[F.lit(c) for c in CODES]), F.col("c_nationkey") + 1)
    key = F.concat(F.lpad((F.col("c_nationkey") + 1).cast("string"), 2, "0"), state, F.year("o_orderdate").cast("string"), F.substring(F.lit("HGITDX"), (F.col("o_orderkey") % 6).cast("int") + 1, F.lit(1)), F.lpad((F.col("o_orderkey") % 10000).cast("string"), 4, "0"))
    rows = orders.join(customers, orders.o_custkey == customers.c_custkey)
    return rows.select("o_orderkey", key.alias("clave"), F.concat(F.lit("Proyecto "), F.col("o_orderkey").cast("string")).alias("project_name"), F.col("c_name").alias("sponsor"), F.when(F.col("o_orderkey") % 3 == 0, F.col("c_mktsegment")).alias("municipality"), F.when(F.col("o_orderstatus") == "O", "en evaluacion").otherwise("resuelto").alias("status"), F.year("o_orderdate").alias("year"), state.alias("state"), "o_totalprice", "o_orderdate")


PROJECTS_SQL = f"""projects AS (
  SELECT o_orderkey, lpad((c_nationkey + 1)::VARCHAR, 2, '0') || state || year(o_orderdate)::VARCHAR
           || substr('HGITDX', (o_orderkey % 6)::INT + 1, 1) || lpad((o_orderkey % 10000)::VARCHAR, 4, '0') AS clave,
         'Proyecto ' || o_orderkey::VARCHAR AS project_name, c_name AS sponsor,
         CASE WHEN o_orderkey % 3 = 0 THEN c_mktsegment END AS municipality,
         CASE WHEN o_orderstatus = 'O' THEN 'en evaluacion' ELSE 'resuelto' END AS status,
         year(o_orderdate)::INT AS year, state, o_totalprice, o_orderdate
  FROM orders JOIN (SELECT *, list_extract([{", ".join(f"'{c}'" for c in CODES)}], c_nationkey + 1) AS state FROM customer) ON o_custkey = c_custkey)"""


def dirty_projects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """projects with faults by order key: broken key, blank status, wrong year, unknown state, and no study on file."""
    k = F.col("o_orderkey")
    return projects(spark, sf_dir).select("o_orderkey", F.when(k % 7 == 0, F.concat(F.lit("X"), "clave")).otherwise(F.col("clave")).alias("clave"), "project_name", F.when(k % 11 == 0, "  ").otherwise(F.col("status")).alias("status"), F.when(k % 13 == 0, "Atlantis").otherwise(F.col("state")).alias("state"), F.when(k % 17 == 0, 1980).when(k % 19 != 0, F.col("year")).alias("year"), F.when(k % 2 == 0, F.array(F.lit("estudio.pdf"))).otherwise(F.array().cast("array<string>")).alias("files_downloaded"))


DIRTY_SQL = (
    PROJECTS_SQL
    + """, dirty AS (
  SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN 'X' || clave ELSE clave END AS clave, project_name,
         CASE WHEN o_orderkey % 11 = 0 THEN '  ' ELSE status END AS status,
         CASE WHEN o_orderkey % 13 = 0 THEN 'Atlantis' ELSE state END AS state,
         CASE WHEN o_orderkey % 17 = 0 THEN 1980 WHEN o_orderkey % 19 <> 0 THEN year END AS year,
         o_orderkey % 2 = 0 AS has_study FROM projects),
checked AS (SELECT *, NOT regexp_full_match(clave, '[0-9]{2}[A-Z]{2}[0-9]{4}[A-Z0-9][0-9]{3,5}') OR clave LIKE '%9999' AS bad_key FROM dirty),
alerts AS (
  SELECT o_orderkey, 'status' AS field, 'required' AS error, 'CRITICAL' AS level FROM checked WHERE trim(status) = ''
  UNION ALL SELECT o_orderkey, 'clave', 'format', 'CRITICAL' FROM checked WHERE bad_key
  UNION ALL SELECT o_orderkey, 'year', 'mismatch', 'CRITICAL' FROM checked WHERE NOT bad_key AND NOT contains(coalesce(year::VARCHAR, ''), substr(clave, 5, 4))
  UNION ALL SELECT o_orderkey, 'year', 'not a number', 'CRITICAL' FROM checked WHERE NOT bad_key AND year IS NULL
  UNION ALL SELECT o_orderkey, 'year', 'range', 'CRITICAL' FROM checked WHERE NOT bad_key AND NOT year BETWEEN 1990 AND 2027
  UNION ALL SELECT o_orderkey, 'state', 'unknown', 'CRITICAL' FROM checked WHERE NOT bad_key AND state = 'Atlantis'
  UNION ALL SELECT o_orderkey, 'files_downloaded', 'no study', 'WARNING' FROM checked WHERE NOT bad_key AND contains(status, 'evaluac') AND NOT has_study)"""
)


def evaluations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """orders as evaluations (o_orderkey, veredicto, score, confianza_pct), some out of range."""
    return table(spark, sf_dir, "orders").select("o_orderkey", F.expr(VERDICT_RULE).alias("veredicto"), F.round(F.col("o_totalprice") % 1.1, 4).alias("score"), (F.col("o_orderkey") % 108).cast("int").alias("confianza_pct"))


EVALUATIONS_SQL = f"evaluations AS (SELECT o_orderkey, {VERDICT_RULE} AS veredicto, round(o_totalprice % 1.1, 4) AS score, (o_orderkey % 108)::INT AS confianza_pct FROM orders)"
