"""The engine's functions under SQL names, for queries written as text."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: name: (parameters, result, expression); null or empty vectors, unequal lengths and zero norms give a similarity of 0.
SCALARS = {
    "vector_dot": ("a ARRAY<DOUBLE>, b ARRAY<DOUBLE>", "DOUBLE", "aggregate(zip_with(a, b, (x, y) -> x * y), 0D, (s, v) -> s + v)"),
    "vector_norm": ("a ARRAY<DOUBLE>", "DOUBLE", "sqrt(aggregate(a, 0D, (s, x) -> s + x * x))"),
    "cosine_similarity": ("a ARRAY<DOUBLE>, b ARRAY<DOUBLE>", "DOUBLE", "CASE WHEN size(a) = size(b) THEN coalesce(aggregate(zip_with(a, b, (x, y) -> x * y), 0D, (s, v) -> s + v) / nullif(sqrt(aggregate(a, 0D, (s, x) -> s + x * x)) * sqrt(aggregate(b, 0D, (s, x) -> s + x * x)), 0D), 0D) ELSE 0D END"),
    "token_estimate": ("text STRING", "BIGINT", "CAST(ceil(length(text) / 4D) AS BIGINT)"),
    "project_key": ("text STRING", "STRING", "nullif(regexp_extract(upper(text), '(^|[^A-Z0-9])([0-9]{2}[A-Z]{2}[0-9]{4}[A-Z0-9][0-9]{3,5})', 2), '')"),
}


def register_functions(spark: SparkSession) -> list[str]:
    """Makes the scalar functions temporary functions of the session; gives their names. They are inlined into plans."""
    for name, (parameters, result, expression) in SCALARS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS {result} RETURN {expression}")
    return list(SCALARS)


def register_anomaly_search(spark: SparkSession, anomalies: str, vessels: str, name: str = "match_anomalies") -> None:
    """A table function name(query ARRAY<DOUBLE>, threshold DOUBLE, most INT) over two tables or views.

    anomalies (id, vessel_id, anomaly_type, description, embedding) with vessels (id, name): those more similar to the query than the
    threshold, the `most` nearest, ties by id. Anomalies without a vessel are left out. Scores are filtered in the scan's
    stage, and each task passes on `most` rows at most.
    """
    register_functions(spark)
    spark.sql(f"""CREATE OR REPLACE TEMPORARY FUNCTION {name}(query ARRAY<DOUBLE>, threshold DOUBLE, most INT)
        RETURNS TABLE (id BIGINT, vessel_name STRING, anomaly_type STRING, description STRING, similarity DOUBLE)
        RETURN SELECT id, vessel_name, anomaly_type, description, similarity FROM (
            SELECT *, row_number() OVER (ORDER BY similarity DESC, id) AS place FROM (
                SELECT a.id, v.name AS vessel_name, a.anomaly_type, a.description, cosine_similarity(CAST(a.embedding AS ARRAY<DOUBLE>), query) AS similarity
                FROM {anomalies} a JOIN {vessels} v ON a.vessel_id = v.id) WHERE similarity > threshold)
        WHERE place <= most""")
