"""Queries of the engine's operators by name, each with DuckDB SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from acervo.functions.lookups import STATES, TYPES, heal_key
from acervo.operators import evaluate, graph, joins, keys, quality, retrieval, sequences, text, upsert
from acervo.plans.bindings import DIRTY_SQL, EVALUATIONS_SQL, PROJECTS_SQL, dirty_projects, evaluations, projects, table

AS_OF_YEAR = 2026
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
_KEY = r"(^|[^A-Z0-9])([0-9]{2}[A-Z]{2}[0-9]{4}[A-Z0-9][0-9]{3,5})"


def query(sql: str | None) -> Callable:
    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _case(column: str, pairs: dict[str, str]) -> str:
    return f"CASE {column} " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in pairs.items()) + f" ELSE {column} END"


@query(f"WITH {PROJECTS_SQL} SELECT state, {_case('state', STATES)} AS state_name, year AS key_year, {_case('substr(clave, 9, 1)', TYPES)} AS kind_name, count(*)::BIGINT AS n FROM projects GROUP BY ALL")
def keys_by_state_year(spark: SparkSession, d: str) -> DataFrame:
    return keys.parse_key(projects(spark, d).select("clave"), "clave").where("valid").groupBy("state", "state_name", "key_year", "kind_name").agg(F.count("*").alias("n"))


@query(f"WITH {DIRTY_SQL} SELECT o_orderkey, clave, project_name, count(field)::BIGINT AS warnings FROM checked LEFT JOIN alerts USING (o_orderkey) GROUP BY ALL HAVING count(*) FILTER (level = 'CRITICAL') = 0")
def audited_projects(spark: SparkSession, d: str) -> DataFrame:
    return quality.audit_projects(dirty_projects(spark, d), AS_OF_YEAR).where(quality.is_clean()).select("o_orderkey", "clave", "project_name", F.size("alerts").cast("long").alias("warnings"))


@query(f"WITH {DIRTY_SQL} SELECT * FROM alerts")
def audit_alerts(spark: SparkSession, d: str) -> DataFrame:
    return quality.explode_alerts(quality.audit_projects(dirty_projects(spark, d), AS_OF_YEAR), "o_orderkey")


@query(f"WITH {EVALUATIONS_SQL} SELECT o_orderkey, veredicto, score, confianza_pct FROM evaluations WHERE veredicto <> 'FAVORABLE' AND score BETWEEN 0 AND 1 AND confianza_pct BETWEEN 0 AND 100")
def audited_evaluations(spark: SparkSession, d: str) -> DataFrame:
    return quality.audit_evaluations(evaluations(spark, d)).where(quality.is_clean()).drop("alerts")


@query(f"WITH {DIRTY_SQL} SELECT o_orderkey, veredicto FROM ({EVALUATIONS_SQL[len('evaluations AS (') : -1]}) WHERE o_orderkey IN (SELECT o_orderkey FROM checked WHERE o_orderkey NOT IN (SELECT o_orderkey FROM alerts WHERE level = 'CRITICAL'))")
def evaluations_of_clean(spark: SparkSession, d: str) -> DataFrame:
    return evaluations(spark, d).join(audited_projects(spark, d), "o_orderkey", "left_semi").select("o_orderkey", "veredicto")


@query(f"WITH {EVALUATIONS_SQL} SELECT veredicto, count(*)::BIGINT AS n FROM evaluations GROUP BY 1")
def verdict_histogram(spark: SparkSession, d: str) -> DataFrame:
    return evaluations(spark, d).groupBy("veredicto").agg(F.count("*").alias("n"))


@query(f"WITH {DIRTY_SQL} SELECT 'year' AS column_name, count(*) FILTER (year IS NULL)::BIGINT AS nulls, round(100.0 * count(*) FILTER (year IS NULL) / count(*), 2)::DOUBLE AS pct FROM dirty HAVING count(*) FILTER (year IS NULL) > 0")
def null_profile(spark: SparkSession, d: str) -> DataFrame:
    return quality.null_profile(dirty_projects(spark, d))


@query(f"WITH {PROJECTS_SQL} SELECT (count(*) - count(DISTINCT clave))::BIGINT AS duplicates FROM projects")
def duplicate_keys(spark: SparkSession, d: str) -> DataFrame:
    return quality.duplicate_count(projects(spark, d), "clave")


@query(f"""WITH {PROJECTS_SQL}, raw AS (SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN replace(clave, '0', 'O') WHEN 1 THEN replace(clave, '1', 'I') WHEN 2 THEN clave || 'Z' ELSE replace(clave, 'S', '5') END AS raw FROM projects),
healed AS (SELECT o_orderkey, raw, translate(substr(raw,1,2),'OILSZ','01152') || translate(substr(raw,3,2),'015','OIS') || translate(substr(raw,5,4),'OILSZ','01152') || translate(substr(raw,9,1),'015','OIS') || translate(substr(raw,10,4),'OILSZ','01152') AS h FROM raw)
SELECT o_orderkey, raw, CASE WHEN length(raw) = 13 AND regexp_full_match(h, '[0-9]{{2}}[A-Z]{{2}}[0-9]{{4}}[A-Z][0-9]{{4}}') THEN h END AS healed FROM healed""")
def heal_keys(spark: SparkSession, d: str) -> DataFrame:
    k, c = F.col("o_orderkey") % 4, F.col("clave")
    raw = F.when(k == 0, F.replace(c, F.lit("0"), F.lit("O"))).when(k == 1, F.replace(c, F.lit("1"), F.lit("I"))).when(k == 2, F.concat(c, F.lit("Z"))).otherwise(F.replace(c, F.lit("S"), F.lit("5")))
    return projects(spark, d).select("o_orderkey", raw.alias("raw")).withColumn("healed", heal_key(F.col("raw")))


_GAZETTES = f"{PROJECTS_SQL}, gazettes AS (SELECT 'G' || (o_orderkey % 97)::VARCHAR AS stem, clave FROM projects WHERE o_orderkey % 5 < 2)"


def _gazettes(spark: SparkSession, d: str) -> DataFrame:
    """Documents that each announce some projects, line by line."""
    rows = projects(spark, d).where("o_orderkey % 5 < 2").select(F.concat(F.lit("G"), (F.col("o_orderkey") % 97).cast("string")).alias("stem"), F.concat(F.lit("| "), F.lower("clave"), F.lit(" | obra |")).alias("line"))
    return rows.groupBy("stem").agg(F.array_join(F.collect_list("line"), "\n").alias("content"))


@query(f"WITH {_GAZETTES} SELECT stem, count(DISTINCT clave)::BIGINT AS n FROM gazettes GROUP BY 1")
def keys_in_text(spark: SparkSession, d: str) -> DataFrame:
    return keys.extract_keys(_gazettes(spark, d), "stem", "content").groupBy("stem").agg(F.count("*").alias("n"))


@query(f"WITH {_GAZETTES} SELECT clave, max(stem) AS origin, count(DISTINCT stem)::BIGINT AS mentions FROM gazettes GROUP BY 1")
def link_gazettes(spark: SparkSession, d: str) -> DataFrame:
    return keys.link_sources(keys.extract_keys(_gazettes(spark, d), "stem", "content"), projects(spark, d), "stem")


@query(f"WITH {_GAZETTES} SELECT DISTINCT clave FROM projects WHERE clave NOT IN (SELECT clave FROM projects WHERE o_orderkey % 3 = 1)")
def pending_keys(spark: SparkSession, d: str) -> DataFrame:
    all_ = projects(spark, d)
    return keys.pending_keys(all_, keys.extract_keys(_gazettes(spark, d), "stem", "content"), all_.where("o_orderkey % 3 = 1"))


@query(f"WITH {PROJECTS_SQL} SELECT clave, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY clave ORDER BY o_orderdate DESC, o_orderkey DESC) AS n FROM projects) WHERE n = 1")
def latest_by_key(spark: SparkSession, d: str) -> DataFrame:
    return keys.keep_one(projects(spark, d), ["clave"], [F.col("o_orderdate").desc(), F.col("o_orderkey").desc()]).select("clave", "o_orderkey")


@query("SELECT o_orderkey AS id, CASE WHEN o_orderkey % 3 = 0 THEN o_totalprice + 1 ELSE o_totalprice END AS price FROM orders WHERE o_orderkey % 3 = 0 OR o_orderkey % 2 = 0")
def upsert_projects(spark: SparkSession, d: str) -> DataFrame:
    orders = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("price"))
    return upsert.upsert(orders.where("id % 2 = 0"), orders.where("id % 3 = 0").withColumn("price", F.col("price") + 1), ["id"])


@query("SELECT o_orderkey AS id, CASE WHEN o_orderkey % 2 = 0 THEN o_totalprice ELSE o_totalprice + 1 END AS price FROM orders WHERE o_orderkey % 3 = 0 OR o_orderkey % 2 = 0")
def insert_ignore(spark: SparkSession, d: str) -> DataFrame:
    orders = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("price"))
    return upsert.insert_ignore(orders.where("id % 2 = 0"), orders.where("id % 3 = 0").withColumn("price", F.col("price") + 1), ["id"])


@query("SELECT o_orderkey AS id, CASE WHEN o_orderkey % 3 <> 0 OR o_orderkey % 4 = 0 THEN CASE WHEN o_orderkey % 2 = 0 THEN o_orderpriority END ELSE 'nuevo' END AS name FROM orders WHERE o_orderkey % 3 = 0 OR o_orderkey % 2 = 0")
def upsert_coalesce(spark: SparkSession, d: str) -> DataFrame:
    orders = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("name"))
    return upsert.upsert_coalesce(orders.where("id % 2 = 0"), orders.where("id % 3 = 0").select("id", F.when(F.col("id") % 4 == 0, "Desconocido").otherwise("nuevo").alias("name")), ["id"])


@query("SELECT l_partkey AS src, l_suppkey AS dst, round(1.0 + 0.1 * (count(*) - 1), 4)::DOUBLE AS weight FROM lineitem GROUP BY 1, 2")
def edge_weights(spark: SparkSession, d: str) -> DataFrame:
    seen = table(spark, d, "lineitem").select(F.col("l_partkey").alias("src"), F.col("l_suppkey").alias("dst"), "l_orderkey")
    first = upsert.accumulate_weight(spark.createDataFrame([], "src long, dst long, weight double"), seen.where("l_orderkey % 2 = 0"), ["src", "dst"])
    return upsert.accumulate_weight(first, seen.where("l_orderkey % 2 = 1"), ["src", "dst"])


@query("SELECT user_id, event_type, count(*)::BIGINT AS n FROM events GROUP BY 1, 2")
def attempt_counters(spark: SparkSession, d: str) -> DataFrame:
    events = table(spark, d, "events")
    old = events.where("event_id % 2 = 0").groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
    return upsert.increment(old, events.where("event_id % 2 = 1"), ["user_id", "event_type"])


@query(f"WITH {PROJECTS_SQL} SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN 'R' || o_orderkey::VARCHAR WHEN o_orderkey % 3 = 0 THEN 'W' || o_orderkey::VARCHAR ELSE project_name END AS project_name, coalesce(CASE WHEN o_orderkey % 3 = 0 AND o_orderkey % 9 <> 0 THEN 'W' END, municipality, 'Desconocido') AS municipality FROM projects")
def enriched_metadata(spark: SparkSession, d: str) -> DataFrame:
    base = projects(spark, d).select("o_orderkey", "project_name", "municipality")
    k = F.col("o_orderkey")
    report = base.where(k % 2 == 0).select("o_orderkey", F.concat(F.lit("R"), k.cast("string")).alias("project_name"), F.lit("").alias("municipality"))
    warehouse = base.where(k % 3 == 0).select("o_orderkey", F.concat(F.lit("W"), k.cast("string")).alias("project_name"), F.when(k % 9 == 0, "  ").otherwise("W").alias("municipality"))
    return joins.enrich(base, [report, warehouse], "o_orderkey", ["project_name", "municipality"])


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 AND o_orderkey % 3 <> 0 THEN 'extraido' WHEN o_orderkey % 4 = 0 THEN 'Desconocido' ELSE o_orderpriority END AS o_orderpriority FROM orders")
def fill_missing(spark: SparkSession, d: str) -> DataFrame:
    base = table(spark, d, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 4 == 0, "Desconocido").otherwise(F.col("o_orderpriority")).alias("o_orderpriority"))
    found = base.select("o_orderkey", F.when(F.col("o_orderkey") % 3 == 0, "n/a").otherwise("extraido").alias("o_orderpriority"))
    return joins.fill_missing(base, found, "o_orderkey", ["o_orderpriority"])


@query("""WITH f AS (SELECT o_orderkey, coalesce(max((l_linenumber = 1)::INT), 0) AS a, coalesce(max((l_linenumber = 2)::INT), 0) AS b, coalesce(max((l_linenumber = 3)::INT), 0) AS c
FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1)
SELECT o_orderkey, a AS has_estudio, b AS has_resumen, c AS has_resolutivo, a + b + c AS present, CASE WHEN a + b + c = 3 THEN 'complete' WHEN a + b + c > 0 THEN 'partial' ELSE 'failed' END AS status FROM f""")
def status_matrix(spark: SparkSession, d: str) -> DataFrame:
    files = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), F.element_at(F.array(F.lit("estudio"), F.lit("resumen"), F.lit("resolutivo")), F.least(F.col("l_linenumber"), F.lit(3))).alias("kind"), "l_linenumber").where("l_linenumber <= 3")
    return joins.status_matrix(table(spark, d, "orders"), files, ["estudio", "resumen", "resolutivo"], "o_orderkey")


@query("""WITH p AS (SELECT user_id, ts, value FROM events WHERE event_type <> 'error'), g AS (SELECT user_id, ts AS gap_start, event_id AS gap_id FROM events WHERE event_type = 'error'),
j AS (SELECT gap_id, ts, value, row_number() OVER (PARTITION BY gap_id ORDER BY ts DESC, value DESC) AS n, count(*) OVER (PARTITION BY gap_id) AS seen FROM g JOIN p USING (user_id) WHERE ts < gap_start)
SELECT gap_id, count(*)::BIGINT AS points_before, max(ts) AS last_ts FROM j WHERE n <= 12 AND seen >= 3 GROUP BY 1""")
def asof_last_12(spark: SparkSession, d: str) -> DataFrame:
    events = table(spark, d, "events")
    gaps = events.where("event_type = 'error'").select("user_id", F.col("ts").alias("gap_start"), F.col("event_id").alias("gap_id"))
    return joins.asof_last(events.where("event_type <> 'error'").select("user_id", "ts", "value"), gaps, "user_id").select("gap_id", "points_before", "last_ts")


_EDGES = f"""{PROJECTS_SQL}, edges AS (
  SELECT clave AS src, coalesce('muni_' || state || '_' || upper(municipality), 'state_' || state) AS dst, 'UBICADO_EN' AS relation FROM projects
  UNION ALL SELECT 'muni_' || state || '_' || upper(municipality), 'state_' || state, 'PERTENECE_A' FROM projects WHERE municipality IS NOT NULL
  UNION ALL SELECT clave, 'prom_' || upper(sponsor), 'PROMOVIDO_POR' FROM projects
  UNION ALL SELECT clave, 'type_' || substr(clave, 9, 1), 'ES_TIPO' FROM projects
  UNION ALL SELECT clave, 'year_' || substr(clave, 5, 4), 'DEL_AÑO' FROM projects
  UNION ALL SELECT clave, 'sector_' || substr(clave, 1, 2), 'DEL_SECTOR' FROM projects)"""


def _edges(spark: SparkSession, d: str) -> DataFrame:
    rows = keys.parse_key(projects(spark, d).select("clave", "municipality", "sponsor"), "clave").where("valid")
    return graph.project_edges(rows)


@query(f"WITH {_EDGES} SELECT relation, dst, count(*)::BIGINT AS n FROM edges GROUP BY 1, 2")
def project_graph_edges(spark: SparkSession, d: str) -> DataFrame:
    return _edges(spark, d).groupBy("relation", "dst").agg(F.count("*").alias("n"))


@query(f"WITH {_EDGES}, deg AS (SELECT node, count(*)::BIGINT AS degree FROM (SELECT src AS node FROM edges UNION ALL SELECT dst FROM edges) GROUP BY 1) SELECT node, degree, round(degree / (SELECT max(degree) FROM deg), 6)::DOUBLE AS centrality FROM deg")
def degree_centrality(spark: SparkSession, d: str) -> DataFrame:
    return graph.degrees(_edges(spark, d))


@query(f"WITH {_EDGES}, deg AS (SELECT node, count(*) AS degree FROM (SELECT src AS node FROM edges UNION ALL SELECT dst FROM edges) GROUP BY 1) SELECT count(*)::BIGINT AS nodes, round(avg(degree), 2)::DOUBLE AS mean_degree, (SELECT count(*) FROM edges)::BIGINT AS edges FROM deg")
def graph_metrics(spark: SparkSession, d: str) -> DataFrame:
    return graph.metrics(_edges(spark, d))


@query(f"""WITH {_EDGES}, names AS (SELECT name, row_number() OVER (ORDER BY name) - 1 AS i FROM (SELECT src AS name FROM edges UNION SELECT dst FROM edges)), kinds AS (SELECT relation, row_number() OVER (ORDER BY relation) - 1 AS i FROM (SELECT DISTINCT relation FROM edges))
SELECT a.i::BIGINT AS src_index, b.i::BIGINT AS dst_index, k.i::BIGINT AS relation_index FROM edges e JOIN names a ON a.name = e.src JOIN names b ON b.name = e.dst JOIN kinds k ON k.relation = e.relation""")
def compact_graph(spark: SparkSession, d: str) -> DataFrame:
    return graph.compact(_edges(spark, d))


_MERGED = "old AS (SELECT DISTINCT 'p' || l_partkey::VARCHAR AS src, 's' || l_suppkey::VARCHAR AS dst, 'HAS' AS relation FROM lineitem WHERE l_orderkey % 2 = 0), fresh AS (SELECT DISTINCT 'p' || l_partkey::VARCHAR AS src, 's' || l_suppkey::VARCHAR AS dst, CASE WHEN l_orderkey % 3 = 0 THEN 'IS_CLASS' ELSE 'HAS' END AS relation FROM lineitem WHERE l_orderkey % 2 = 1), nodes AS (SELECT src AS id FROM old UNION SELECT dst FROM old)"


@query(f"WITH {_MERGED} SELECT * FROM old UNION SELECT f.* FROM fresh f WHERE f.src IN (SELECT id FROM nodes) AND f.dst IN (SELECT id FROM nodes)")
def merged_graph(spark: SparkSession, d: str) -> DataFrame:
    items = table(spark, d, "lineitem").select(F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("src"), F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("dst"), "l_orderkey")
    old = items.where("l_orderkey % 2 = 0").select("src", "dst", F.lit("HAS").alias("relation")).distinct()
    fresh = items.where("l_orderkey % 2 = 1").select("src", "dst", F.when(F.col("l_orderkey") % 3 == 0, "is").otherwise("HAS").alias("relation"))
    nodes = old.select(F.explode(F.array("src", "dst")).alias("id")).distinct()
    return graph.merge(nodes, old, nodes.limit(0), fresh, {"is": "IS_CLASS", "detected": "DETECTED_IN"})[1]


@query("SELECT event_id, round(least(24, greatest(0, coalesce((epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id)) / 3600000000, 0))), 6)::DOUBLE AS delta_hours FROM events")
def delta_hours(spark: SparkSession, d: str) -> DataFrame:
    return sequences.delta_hours(table(spark, d, "events"), "user_id", "ts", "event_id").select("event_id", "delta_hours")


@query("SELECT user_id, CASE WHEN i <= floor(n * 0.8) THEN 'train' ELSE 'validation' END AS part, count(*)::BIGINT AS points FROM (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i, count(*) OVER (PARTITION BY user_id) AS n FROM events) WHERE n >= 10 GROUP BY 1, 2")
def chronological_split(spark: SparkSession, d: str) -> DataFrame:
    return sequences.chronological_split(table(spark, d, "events"), "user_id", "ts", "event_id").groupBy("user_id", "part").agg(F.count("*").alias("points"))


@query("""WITH p AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS i, count(*) OVER (PARTITION BY user_id) AS n FROM events),
w AS (SELECT DISTINCT user_id, n, unnest(range((n - 32) // 16 + 1)) AS window_id FROM p WHERE n >= 32)
SELECT user_id, window_id::BIGINT AS window_id, count(*)::BIGINT AS points, round(avg(value), 8) AS mean, round(avg(value) FILTER (i - window_id * 16 < 19), 8) AS past_mean, round(avg(value) FILTER (i - window_id * 16 >= 19), 8) AS future_mean
FROM w JOIN p USING (user_id) WHERE i BETWEEN window_id * 16 AND window_id * 16 + 31 GROUP BY 1, 2""")
def sliding_windows(spark: SparkSession, d: str) -> DataFrame:
    return sequences.sliding_windows(table(spark, d, "events"), "user_id", "ts", "event_id", "value")


@query("SELECT doc_id, c::BIGINT AS chunk, substr(text, c * 1700 + 1, 2000) AS body FROM (SELECT doc_id, text, unnest(range(CASE WHEN length(text) <= 2000 THEN 1 ELSE (length(text) - 1) // 1700 + 1 END)) AS c FROM documents)")
def chunk_chars(spark: SparkSession, d: str) -> DataFrame:
    return text.chunk_chars(table(spark, d, "documents"), "doc_id", "text")


@query(r"""WITH w AS (SELECT doc_id, [x FOR x IN regexp_split_to_array(text, '\s+') IF x <> ''] AS w FROM documents),
c AS (SELECT doc_id, w, unnest(range(greatest(0, ceil((len(w) - 500) / 450.0))::BIGINT + 1)) AS chunk FROM w WHERE len(w) > 0)
SELECT doc_id, chunk::BIGINT AS chunk, len(w[chunk * 450 + 1 : chunk * 450 + 500])::BIGINT AS n_words, array_to_string(w[chunk * 450 + 1 : chunk * 450 + 500], ' ') AS body FROM c""")
def chunk_words(spark: SparkSession, d: str) -> DataFrame:
    return text.chunk_words(table(spark, d, "documents"), "doc_id", "text")


_TAGS = {"LAW": r"licen[sc]e|version", "GEO": r"\d+\.\d+", "BIO": r"token|key"}


@query("WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS l, unnest(range(len(string_split(text, chr(10))))) AS line_no FROM documents) " + " UNION ALL ".join(f"SELECT doc_id, line_no::BIGINT AS line_no, '{t}' AS tag FROM l WHERE trim(l) <> '' AND regexp_matches(l, '(?i){p}')" for t, p in _TAGS.items()))
def tag_lines(spark: SparkSession, d: str) -> DataFrame:
    return text.tag_lines(table(spark, d, "documents"), "doc_id", "text", _TAGS)


@query("""WITH h AS (SELECT doc_id, len(regexp_extract_all(text, '(?i)the')) AS a, len(regexp_extract_all(text, '(?i)of')) AS b, len(regexp_extract_all(text, '(?i)and')) AS c FROM documents),
g AS (SELECT doc_id, least(a, 5) + least(b, greatest(1, 5 - least(a, 5))) AS yes, least(c, 5) AS no FROM h), s AS (SELECT doc_id, round(yes / greatest(yes + no, 1), 2)::DOUBLE AS score FROM g)
SELECT doc_id, score, CASE WHEN score >= 0.6 THEN 'FAVORABLE' WHEN score >= 0.3 THEN 'CONDICIONADO' ELSE 'DESFAVORABLE' END AS veredicto FROM s""")
def heuristic_report(spark: SparkSession, d: str) -> DataFrame:
    scored = table(spark, d, "documents").select("doc_id", text.heuristic_score(F.col("text"), ("the", "of"), ("and",)).alias("score"))
    return scored.withColumn("veredicto", text.verdict(F.col("score")))


@query("SELECT doc_id, text FROM (SELECT doc_id, text, row_number() OVER (PARTITION BY sha256(text) ORDER BY doc_id) AS n FROM documents) WHERE n = 1")
def dedup_documents(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    first = docs.groupBy(F.sha2("text", 256).alias("sha")).agg(F.min("doc_id").alias("doc_id"))
    return docs.join(first, "doc_id", "left_semi").select("doc_id", "text")


@query(r"""WITH w AS (SELECT doc_id, unnest(regexp_extract_all(lower(substr(text, 1, 2000)), '[\p{L}\p{N}_]+')) AS w FROM documents),
c AS (SELECT doc_id, (('0x' || substr(md5(w), 1, 2))::INT % 128)::BIGINT AS bucket, count(*) AS n FROM w GROUP BY 1, 2)
SELECT doc_id, bucket, round(n / sqrt(sum(n * n) OVER (PARTITION BY doc_id)), 6)::DOUBLE AS weight FROM c""")
def hashed_embedding(spark: SparkSession, d: str) -> DataFrame:
    return retrieval.hashed_counts(table(spark, d, "documents"), "doc_id", "text")


_QUERY = [((i * 7) % 11 - 5) / 10 for i in range(64)]


@query(f"WITH q AS (SELECT {_QUERY}::DOUBLE[] AS q) SELECT vec_id, round(list_dot_product(embedding::DOUBLE[], q) / (sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) * sqrt(list_dot_product(q, q))), 4)::DOUBLE AS score FROM embeddings, q ORDER BY score DESC, vec_id LIMIT 10")
def topk_cosine(spark: SparkSession, d: str) -> DataFrame:
    return retrieval.topk_cosine(table(spark, d, "embeddings"), _QUERY, "vec_id", "embedding", 10)


_BM25 = r"""w AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}_]+') AS w FROM documents), c AS (SELECT doc_id, len(w) AS len, len([x FOR x IN w IF x = 'license']) AS a, len([x FOR x IN w IF x = 'version']) AS b FROM w),
t AS (SELECT count(*) AS n, avg(len) AS mean, count(*) FILTER (a > 0) AS da, count(*) FILTER (b > 0) AS db FROM c)
SELECT doc_id, round({ia} * a * 2.5 / (a + 1.5 * (0.25 + 0.75 * len / {mean})) + {ib} * b * 2.5 / (b + 1.5 * (0.25 + 0.75 * len / {mean})), 4)::DOUBLE AS score FROM c, t WHERE a > 0 OR b > 0"""
_IDF = "ln((n - {0} + 0.5) / ({0} + 0.5) + 1)"


@query("WITH " + _BM25.format(ia=_IDF.format("da"), ib=_IDF.format("db"), mean="mean"))
def bm25_idf(spark: SparkSession, d: str) -> DataFrame:
    return retrieval.bm25(table(spark, d, "documents"), "doc_id", "text", ["license", "version"])


@query("WITH " + _BM25.format(ia="1.0", ib="1.0", mean="200"))
def bm25_fixed(spark: SparkSession, d: str) -> DataFrame:
    return retrieval.bm25(table(spark, d, "documents"), "doc_id", "text", ["license", "version"], idf=False, fixed_length=200)


@query("SELECT field, (sum((t = p)::INT))::BIGINT AS tp, count(*) FILTER (t <> p)::BIGINT AS fp, count(*) FILTER (p IS NULL OR t <> p)::BIGINT AS fn FROM (SELECT 'quality' AS field, quality::VARCHAR AS t, CASE WHEN contains(text, '###') THEN '0' WHEN length(text) > 100 THEN '1' END AS p FROM labels JOIN documents USING (doc_id) UNION ALL SELECT 'toxic', toxic::VARCHAR, CASE WHEN contains(text, 'idiot') THEN '1' ELSE '0' END FROM labels JOIN documents USING (doc_id)) GROUP BY 1")
def extraction_eval(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.extraction_eval(_predictions(spark, d)).select("field", "tp", "fp", "fn")


def _predictions(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id")
    guess = F.when(F.contains("text", F.lit("###")), "0").when(F.length("text") > 100, "1")
    toxic = F.when(F.contains("text", F.lit("idiot")), "1").otherwise("0")
    return rows.select(F.explode(F.array(F.struct(F.lit("quality").alias("field"), F.col("quality").cast("string").alias("truth"), guess.alias("predicted")), F.struct(F.lit("toxic").alias("field"), F.col("toxic").cast("string").alias("truth"), toxic.alias("predicted")))).alias("p")).select("p.*")


@query("SELECT truth, predicted, count(*)::BIGINT AS n FROM (SELECT toxic::VARCHAR AS truth, CASE WHEN contains(text, 'idiot') THEN '1' ELSE '0' END AS predicted FROM labels JOIN documents USING (doc_id)) GROUP BY 1, 2")
def confusion(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.confusion(_predictions(spark, d).where("field = 'toxic'"))


_FOLD = "trim(regexp_replace(regexp_replace(strip_accents(lower({0})), '[^a-z0-9\\s]', '', 'g'), '\\s+', ' ', 'g'))"
_MATCHED = f"""pairs AS (SELECT p_partkey AS item, 'name' AS field, p_name AS truth, CASE p_partkey % 6 WHEN 0 THEN upper(replace(p_name, 'a', 'á')) WHEN 1 THEN split_part(p_name, ' ', 1) WHEN 2 THEN split_part(p_name, ' ', 2) || ' ' || split_part(p_name, ' ', 1) || ' ñ' WHEN 3 THEN 'Desconocido' WHEN 4 THEN 'otro valor' END AS predicted FROM part
  UNION ALL SELECT p_partkey, 'brand', p_brand, CASE WHEN p_partkey % 2 = 0 THEN replace(p_brand, '#', '-') ELSE p_type END FROM part),
named AS (SELECT item, field, coalesce(truth, 'Desconocido') AS truth, coalesce(predicted, 'Desconocido') AS predicted FROM pairs),
fold AS (SELECT *, {_FOLD.format('truth')} AS x, {_FOLD.format('predicted')} AS y FROM named),
shared AS (SELECT *, len(list_intersect(string_split(x, ' '), string_split(y, ' ')))::DOUBLE / len(list_distinct(list_concat(string_split(x, ' '), string_split(y, ' ')))) AS j FROM fold),
matched AS (SELECT *, CASE WHEN x = y THEN 1.0::DOUBLE WHEN x = '' OR y = '' THEN 0 WHEN contains(x, y) OR contains(y, x) THEN 0.85 WHEN j >= 0.5 THEN j ELSE 0 END AS score FROM shared),
counts AS (SELECT field, count(*) AS n, count(*) FILTER (x = y) AS exact, count(*) FILTER (score >= 0.5) AS tp, count(*) FILTER (score < 0.5 AND predicted NOT IN ('', 'Desconocido')) AS fp, count(*) FILTER (score < 0.5 AND truth NOT IN ('', 'Desconocido')) AS fn FROM matched GROUP BY 1),
rates AS (SELECT *, coalesce(tp / nullif(tp + fp, 0), 1.0)::DOUBLE AS p, coalesce(tp / nullif(tp + fn, 0), 1.0)::DOUBLE AS r FROM counts),
fields AS (SELECT *, coalesce(2 * p * r / nullif(p + r, 0), 0)::DOUBLE AS f FROM rates)"""


def _part_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Names and brands of parts beside values that differ by accents, case, order or words, or are absent."""
    k, name, word = F.col("p_partkey"), F.col("p_name"), lambda i: F.split_part("p_name", F.lit(" "), F.lit(i))
    guess = F.when(k % 6 == 0, F.upper(F.replace(name, F.lit("a"), F.lit("á")))).when(k % 6 == 1, word(1)).when(k % 6 == 2, F.concat(word(2), F.lit(" "), word(1), F.lit(" ñ"))).when(k % 6 == 3, "Desconocido").when(k % 6 == 4, "otro valor")
    brand = F.when(k % 2 == 0, F.replace("p_brand", F.lit("#"), F.lit("-"))).otherwise(F.col("p_type"))
    both = [F.struct(k.alias("item"), F.lit(f).alias("field"), t.alias("truth"), p.alias("predicted")) for f, t, p in (("name", name, guess), ("brand", F.col("p_brand"), brand))]
    return table(spark, d, "part").select(F.explode(F.array(*both)).alias("p")).select("p.*")


@query(f"WITH {_MATCHED} SELECT field, tp, fp, fn, round(100 * exact / n, 2)::DOUBLE AS exact_pct, round(p, 4) AS precision, round(r, 4) AS recall, round(f, 4) AS f1 FROM fields")
def field_scores(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.field_scores(_part_pairs(spark, d))


@query(f"""WITH {_MATCHED}, items AS (SELECT avg(s) AS s, count(*) AS n FROM (SELECT avg(CASE WHEN score >= 0.5 THEN score ELSE 0 END) AS s FROM matched GROUP BY item)),
micro AS (SELECT round(avg(p), 4) AS macro_precision, round(avg(r), 4) AS macro_recall, round(avg(f), 4) AS macro_f1, round(coalesce(sum(tp) / nullif(sum(tp) + sum(fp), 0), 0), 4)::DOUBLE AS micro_precision, round(coalesce(sum(tp) / nullif(sum(tp) + sum(fn), 0), 0), 4)::DOUBLE AS micro_recall FROM fields)
SELECT n AS items, round(s, 4) AS item_score, micro.*, round(coalesce(2 * micro_precision * micro_recall / nullif(micro_precision + micro_recall, 0), 0), 4)::DOUBLE AS micro_f1 FROM items, micro""")
def evaluation_summary(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.evaluation_summary(_part_pairs(spark, d))


@query(f"WITH {EVALUATIONS_SQL} SELECT o.o_orderkey, o_custkey, c_name, veredicto, score FROM orders o LEFT JOIN customer ON o_custkey = c_custkey AND c_acctbal > 0 LEFT JOIN evaluations e ON o.o_orderkey = e.o_orderkey AND veredicto <> 'PENDIENTE'")
def project_details(spark: SparkSession, d: str) -> DataFrame:
    sponsors = table(spark, d, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("o_custkey"), "c_name")
    judged = evaluations(spark, d).where("veredicto <> 'PENDIENTE'").select("o_orderkey", "veredicto", "score")
    return joins.project_details(table(spark, d, "orders").select("o_orderkey", "o_custkey"), sponsors, judged, "o_custkey", "o_orderkey")


@query("SELECT doc_id, array_to_string(w[1:100], ' ') || CASE WHEN len(w) > 100 THEN '…' ELSE '' END AS preview FROM (SELECT doc_id, [x FOR x IN string_split_regex(text, '[ \\t\\n\\f\\r\\v]+') IF x <> ''] AS w FROM documents)")
def previews(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", text.preview(F.col("text"), 100).alias("preview"))
