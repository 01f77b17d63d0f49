"""Queries of hybrid search, the maintained index, SQL functions and staged runs over the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from acervo.functions.scratch import folder
from acervo.functions.sql import register_anomaly_search, register_functions
from acervo.operators.hybrid import hashed_vector, hybrid_search as search
from acervo.operators.text import chunk_chars
from acervo.plans.bindings import table
from acervo.plans.registry import query
from acervo.sinks.index import read_index, update_index
from acervo.streaming.ingest import run_stages

_CHUNKS = """c AS (
  SELECT doc_id, lang, chunk, substr(text, chunk * 1700 + 1, 2000) AS body FROM (
    SELECT *, unnest(range(CASE WHEN length(text) <= 2000 THEN 1 ELSE (length(text) - 1) // 1700 + 1 END)) AS chunk FROM {})
)"""
_VECTOR = r"""{0}w AS (
  SELECT *, regexp_extract_all(lower({1}), '[\p{{L}}\p{{N}}_]+') AS w, [('0x' || left(md5(x), 2))::INT % 128 FOR x IN regexp_extract_all(lower(substr({1}, 1, 2000)), '[\p{{L}}\p{{N}}_]+')] AS b FROM {2}
), {0}n AS (
  SELECT *, [len([y FOR y IN b IF y = i])::DOUBLE FOR i IN range(128)] AS n FROM {0}w
), {0}v AS (
  SELECT * EXCLUDE (b, n), [round(x / greatest(sqrt(list_dot_product(n, n)), 1), 6) FOR x IN n] AS v FROM {0}n
)"""


def _questions(spark: SparkSession, d: str) -> DataFrame:
    """Each benchmark item as a query, every second one over the English documents only."""
    return table(spark, d, "benchmark").select("item_id", "text", hashed_vector(F.col("text")).alias("vector"), F.when(F.col("item_id") % 2 == 1, "en").alias("lang"))


@query(f"""WITH {_CHUNKS.format('documents')}, {_VECTOR.format('c', 'body', 'c')}, q AS (SELECT item_id, text, CASE WHEN item_id % 2 = 1 THEN 'en' END AS lang FROM benchmark), {_VECTOR.format('q', 'text', 'q')},
s AS (
  SELECT item_id, doc_id, chunk,
    round(coalesce(list_dot_product(cv.v, qv.v) / nullif(sqrt(list_dot_product(cv.v, cv.v)) * sqrt(list_dot_product(qv.v, qv.v)), 0), 0), 6) AS cosine,
    round(coalesce(list_sum([len([y FOR y IN cv.w IF y = x]) * 2.5::DOUBLE / (len([y FOR y IN cv.w IF y = x]) + 1.5::DOUBLE * (0.25 + 0.75 * len(cv.w) / 200::DOUBLE)) FOR x IN qv.w IF length(x) > 2]), 0), 4) AS bm25
  FROM cv JOIN qv ON qv.lang IS NULL OR qv.lang = cv.lang
), r AS (
  SELECT *, 1 / (60 + row_number() OVER (PARTITION BY item_id ORDER BY cosine DESC, doc_id, chunk))::DOUBLE + 1 / (60 + row_number() OVER (PARTITION BY item_id ORDER BY bm25 DESC, doc_id, chunk))::DOUBLE AS raw FROM s
)
SELECT item_id, doc_id, chunk::BIGINT AS chunk, (row_number() OVER w)::INTEGER AS rank, round(raw, 5) AS score, least(99.9, round(raw * 3000, 1))::DOUBLE AS pct, cosine, bm25
FROM r WINDOW w AS (PARTITION BY item_id ORDER BY round(raw, 5) DESC, doc_id, chunk) QUALIFY row_number() OVER w <= 5""")
def hybrid_search(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    chunks = chunk_chars(docs.select(F.struct("doc_id", "lang").alias("k"), "text"), "k", "text").select("k.doc_id", "k.lang", "chunk", "body", hashed_vector(F.col("body")).alias("vector"))
    return search(chunks, _questions(spark, d), group="lang", query="item_id", query_group="lang")


def _editions(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """documents before and after an edit: a fifth new, a seventh gone, a thirteenth changed."""
    docs = table(spark, d, "documents").select("doc_id", "text")
    edited = F.when(F.col("doc_id") % 13 == 0, F.concat("text", F.lit(" edited"))).otherwise(F.col("text"))
    return docs.where("doc_id % 5 <> 0"), docs.where("doc_id % 7 <> 0").withColumn("text", edited)


_AFTER = "(SELECT doc_id, lang, CASE WHEN doc_id % 13 = 0 THEN text || ' edited' ELSE text END AS text FROM documents WHERE doc_id % 7 <> 0)"


@query(f"WITH {_CHUNKS.format(_AFTER + ''' WHERE trim(text) <> '' ''')}, {_VECTOR.format('c', 'body', 'c')} SELECT doc_id::VARCHAR AS key, chunk::BIGINT AS chunk, sha256(body) AS body_sha256, round(list_sum(v), 4) AS weight FROM cv")
def incremental_index(spark: SparkSession, d: str) -> DataFrame:
    """The index after an edit: only what is new or changed is chunked and embedded anew."""
    path = folder(spark)
    for docs in _editions(spark, d):
        update_index(docs, path)
    return read_index(spark, path).select("key", "chunk", F.sha2(F.col("body").cast("binary"), 256).alias("body_sha256"), F.round(F.aggregate("vector", F.lit(0.0), lambda s, x: s + x), 4).alias("weight"))


@query("""WITH t AS (SELECT doc_id, doc_id % 5 <> 0 AS old, doc_id % 7 <> 0 AS new, trim(text) = '' AS blank FROM documents)
SELECT CASE WHEN NOT old OR (blank AND doc_id % 13 = 0) THEN 'new' WHEN NOT new THEN 'gone' WHEN doc_id % 13 = 0 THEN 'changed' ELSE 'same' END AS state, count(*)::BIGINT AS n
FROM t WHERE (old AND NOT blank) OR (new AND (NOT blank OR doc_id % 13 = 0)) GROUP BY 1""")
def index_states(spark: SparkSession, d: str) -> DataFrame:
    """What the update of the index found: how many documents are new, changed, same and gone."""
    path = folder(spark)
    before, after = _editions(spark, d)
    update_index(before, path)
    return update_index(after, path)


@query("""WITH q AS (SELECT embedding::DOUBLE[] AS q FROM embeddings ORDER BY vec_id LIMIT 1), s AS (
  SELECT e.vec_id AS id, c_name AS vessel_name, 'T' || label AS anomaly_type, 'vector ' || e.vec_id AS description,
         list_dot_product(embedding::DOUBLE[], q) / (sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) * sqrt(list_dot_product(q, q))) AS s
  FROM embeddings e JOIN customer ON c_custkey = vec_id % 150 + 1, q)
SELECT id, vessel_name, anomaly_type, description, round(s, 6) AS similarity FROM s WHERE s > 0.1 ORDER BY s DESC, id LIMIT 20""")
def match_anomalies(spark: SparkSession, d: str) -> DataFrame:
    """A table function in SQL text: the anomalies nearest to the first one's vector."""
    table(spark, d, "embeddings").selectExpr("vec_id AS id", "vec_id % 150 + 1 AS vessel_id", "concat('T', label) AS anomaly_type", "concat('vector ', vec_id) AS description", "embedding").createOrReplaceTempView("traffic_anomalies")
    table(spark, d, "customer").selectExpr("c_custkey AS id", "c_name AS name").createOrReplaceTempView("vessels")
    register_anomaly_search(spark, "traffic_anomalies", "vessels")
    first = table(spark, d, "embeddings").orderBy("vec_id").select(F.col("embedding").cast("array<double>")).first()
    values = ", ".join(f"{x!r}D" for x in first[0])
    return spark.sql(f"SELECT id, vessel_name, anomaly_type, description, round(similarity, 6) AS similarity FROM match_anomalies(array({values}), 0.1D, 20)")


@query("""SELECT doc_id, ceil(length(text) / 4.0)::BIGINT AS tokens, nullif(regexp_extract(upper(text), '(^|[^A-Z0-9])([0-9]{2}[A-Z]{2}[0-9]{4}[A-Z0-9][0-9]{3,5})', 2), '') AS key FROM documents""")
def sql_functions(spark: SparkSession, d: str) -> DataFrame:
    """Scalar functions called from SQL text."""
    register_functions(spark)
    table(spark, d, "documents").createOrReplaceTempView("library_documents")
    return spark.sql("SELECT doc_id, token_estimate(text) AS tokens, project_key(text) AS key FROM library_documents")


@query("""SELECT 0 AS place, 'load' AS stage, 'done' AS status, 25 AS pct, count(*)::BIGINT AS n_rows FROM documents
UNION ALL SELECT 1, 'clean', 'done', 60, count(*) FILTER (length(trim(text)) >= 80) FROM documents
UNION ALL SELECT 2, 'count', 'done', 100, count(DISTINCT source) FILTER (length(trim(text)) >= 80) FROM documents""")
def progress_events(spark: SparkSession, d: str) -> DataFrame:
    """The progress rows of a run of three stages, counted within their own jobs."""
    stages = [("load", lambda x: x.select("source", "text"), 25), ("clean", lambda x: x.where(F.length(F.trim("text")) >= 80), 60), ("count", lambda x: x.where("source IS NOT NULL").groupBy("source").count(), 100)]
    return run_stages(table(spark, d, "documents"), stages, folder(spark))[1]
