"""Queries over records, notes, the maritime side and chunks, beside their DuckDB SQL; they join the registry's."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from acervo.operators import files, graph, records, retrieval, sections, text, upsert
from acervo.plans.bindings import DIRTY_SQL, EVALUATIONS_SQL, PROJECTS_SQL, dirty_projects, evaluations, projects, table
from acervo.plans.collection import NAMES_SQL, names
from acervo.plans.registry import _EDGES, _GAZETTES, _edges, _gazettes, keys, query

_ASEA = "(?i)asea.*gaceta.*?([0-9]+)[-_]([0-9]{4})"


@query(f"""WITH {NAMES_SQL}, s AS (SELECT o_orderkey, upper(split_part(name, '.', 1)) AS stem, regexp_extract(name, '{_ASEA}', 1) AS num, regexp_extract(name, '{_ASEA}', 2) AS y FROM names),
v AS (SELECT *, regexp_full_match(stem, '[0-9]{{2}}[A-Z]{{2}}[0-9]{{4}}[A-Z][0-9]{{3,5}}') AS ok FROM s)
SELECT o_orderkey, CASE WHEN num <> '' THEN 'ASEA-GACETA-' || lpad(num, 2, '0') || '-' || y ELSE stem END AS clave, ok AS valid, CASE WHEN ok THEN substr(stem, 1, 2) WHEN num <> '' THEN '21' END AS sector_code,
CASE WHEN ok THEN substr(stem, 5, 4)::INT WHEN num <> '' THEN y::INT END AS year, CASE WHEN ok THEN substr(stem, 3, 2) WHEN num <> '' THEN 'MG' END AS state_code, CASE WHEN ok THEN substr(stem, 10) WHEN num <> '' THEN num END AS sequence FROM v""")
def classified_items(spark: SparkSession, d: str) -> DataFrame:
    return files.classify(names(spark, d), "name").select("o_orderkey", "item.clave", "item.valid", "item.sector_code", "item.year", "item.state_code", "item.sequence")


@query(f"WITH {PROJECTS_SQL} SELECT o_orderkey, clave FROM projects WHERE regexp_matches(clave, '1995[EHTUVIM]')")
def routed_keys(spark: SparkSession, d: str) -> DataFrame:
    return projects(spark, d).where(F.col("clave").rlike("1995[EHTUVIM]")).select("o_orderkey", "clave")


@query(f"WITH {PROJECTS_SQL} SELECT o_orderkey, clave FROM projects WHERE municipality IS NULL ORDER BY o_orderkey LIMIT 20")
def incomplete_projects(spark: SparkSession, d: str) -> DataFrame:
    """The next batch of projects to enrich; the limit is the batch size."""
    return projects(spark, d).where(records.is_missing(F.col("municipality"))).orderBy("o_orderkey").limit(20).select("o_orderkey", "clave")


@query(f"WITH {EVALUATIONS_SQL} SELECT o_orderkey, score FROM evaluations WHERE veredicto = 'PENDIENTE' AND o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_linenumber = 6)")
def pending_evaluations(spark: SparkSession, d: str) -> DataFrame:
    """Pending evaluations without a cached report."""
    done = table(spark, d, "lineitem").where("l_linenumber = 6").select(F.col("l_orderkey").alias("o_orderkey"))
    return evaluations(spark, d).where("veredicto = 'PENDIENTE'").join(done, "o_orderkey", "left_anti").select("o_orderkey", "score")


@query(f"WITH {_EDGES} SELECT node, count(*) AS degree FROM (SELECT src AS node FROM edges UNION ALL SELECT dst FROM edges) WHERE contains(lower(node), 'pu') GROUP BY 1 ORDER BY degree DESC, node LIMIT 15")
def search_nodes(spark: SparkSession, d: str) -> DataFrame:
    return graph.search(graph.degrees(_edges(spark, d)), "PU")


@query("SELECT o_orderpriority, count(*) AS n FROM orders GROUP BY 1 ORDER BY 1 LIMIT 20")
def guarded_select(spark: SparkSession, d: str) -> DataFrame:
    return records.guarded_select(spark, "SELECT o_orderpriority, count(*) AS n FROM acervo_orders GROUP BY 1 ORDER BY 1", {"acervo_orders": table(spark, d, "orders")})


@query("SELECT event_id FROM events WHERE ts + INTERVAL 72 HOUR > (SELECT max(ts) FROM events)")
def fresh_snapshots(spark: SparkSession, d: str) -> DataFrame:
    events = table(spark, d, "events").select("event_id", F.expr("ts + INTERVAL 72 HOURS").alias("expires_at"), "ts")
    return records.fresh(events.crossJoin(F.broadcast(events.agg(F.max("ts").alias("now")))), "expires_at", F.col("now")).select("event_id")


@query("SELECT o_orderkey, coalesce(max(l_shipdate) >= o_orderdate, false) AS valid FROM orders LEFT JOIN (SELECT * FROM lineitem WHERE l_linenumber = 2) ON l_orderkey = o_orderkey GROUP BY o_orderkey, o_orderdate")
def valid_derived(spark: SparkSession, d: str) -> DataFrame:
    derived = table(spark, d, "lineitem").where("l_linenumber = 2").select(F.col("l_orderkey").alias("o_orderkey"), "l_shipdate")
    return records.still_valid(table(spark, d, "orders"), derived, "o_orderkey", "o_orderdate", "l_shipdate")


@query("SELECT c_custkey, c_name || ' | Bandera: ' || n_name || ' | Clase: ' || CASE WHEN c_custkey % 3 = 0 THEN c_mktsegment ELSE 'sin clase' END AS description FROM customer JOIN nation ON c_nationkey = n_nationkey")
def vessel_descriptions(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "customer").join(F.broadcast(table(spark, d, "nation")), F.col("c_nationkey") == F.col("n_nationkey"))
    kind = F.when(F.col("c_custkey") % 3 == 0, F.col("c_mktsegment"))
    return rows.select("c_custkey", records.described(F.col("c_name"), {"Bandera": (F.col("n_name"), "desconocida"), "Clase": (kind, "sin clase")}).alias("description"))


@query("SELECT l_orderkey, l_linenumber, o_orderdate FROM lineitem LEFT JOIN orders ON o_orderkey = l_orderkey AND o_totalprice > 100000 WHERE l_discount > 0.02 AND l_discount < 0.05")
def encounters_with_effort(spark: SparkSession, d: str) -> DataFrame:
    effort = table(spark, d, "orders").where("o_totalprice > 100000").select(F.col("o_orderkey").alias("l_orderkey"), "o_orderdate")
    return table(spark, d, "lineitem").where("l_discount > 0.02D AND l_discount < 0.05D").select("l_orderkey", "l_linenumber").join(effort, "l_orderkey", "left")


@query("SELECT c_custkey, s_suppkey FROM customer JOIN supplier ON contains(lower(c_name), s_suppkey::VARCHAR)")
def permit_match(spark: SparkSession, d: str) -> DataFrame:
    permits = table(spark, d, "supplier").select("s_suppkey", F.concat(F.lit(" "), F.col("s_suppkey").cast("string")).alias("registration"))
    return records.contained(table(spark, d, "customer").select("c_custkey", "c_name"), "c_name", permits, "registration").select("c_custkey", "s_suppkey")


@query("WITH c AS (SELECT DISTINCT p_partkey % 40 AS x, p_partkey // 40 % 40 AS y FROM part WHERE p_size > 10) SELECT a.x AS ax, a.y AS ay, b.x AS bx, b.y AS by FROM c a JOIN c b ON abs(a.x - b.x) <= 1 AND abs(a.y - b.y) <= 1 AND (b.x > a.x OR (b.x = a.x AND b.y > a.y))")
def cell_borders(spark: SparkSession, d: str) -> DataFrame:
    cells = table(spark, d, "part").where("p_size > 10").selectExpr("p_partkey % 40 AS x", "p_partkey div 40 % 40 AS y")
    return graph.borders(cells, "x", "y").select("ax", "ay", "bx", "by")


@query("SELECT p_size AS cell, count(*) AS n FROM part GROUP BY 1")
def occurrence_density(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").groupBy(F.col("p_size").alias("cell")).agg(F.count("*").alias("n"))


@query("SELECT c_custkey, CASE WHEN contains(upper(c_name), '17') THEN 'B' WHEN contains(upper(c_name), '1') THEN 'A' END AS profile FROM customer")
def profile_match(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").select("c_custkey", records.first_profile(F.col("c_name"), [("17", "B"), ("1", "A")]).alias("profile"))


@query("SELECT c_custkey, count(*) AS permits FROM customer JOIN orders ON c_custkey = o_custkey GROUP BY 1")
def permits_by_id(spark: SparkSession, d: str) -> DataFrame:
    """Permits as spreadsheets hold them, with `12.0 ` for vessel 12."""
    permits = table(spark, d, "orders").select(records.plain_id(F.concat(F.col("o_custkey").cast("string"), F.lit(".0 "))).alias("id"))
    return table(spark, d, "customer").select("c_custkey", records.plain_id(F.col("c_custkey")).alias("id")).join(permits, "id").groupBy("c_custkey").agg(F.count("*").alias("permits"))


@query(f"WITH {EVALUATIONS_SQL} SELECT o_orderkey, veredicto AS in_warehouse, CASE WHEN o_orderkey % 4 = 0 THEN 'PENDIENTE' ELSE 'VIABLE' END AS in_note FROM evaluations WHERE o_orderkey % 3 <> 0 AND veredicto <> CASE WHEN o_orderkey % 4 = 0 THEN 'PENDIENTE' ELSE 'VIABLE' END")
def verdict_mismatches(spark: SparkSession, d: str) -> DataFrame:
    notes = table(spark, d, "orders").where("o_orderkey % 3 <> 0").select("o_orderkey", F.when(F.col("o_orderkey") % 4 == 0, "SinDictamen").otherwise("viable").alias("veredicto"))
    return records.verdict_mismatches(evaluations(spark, d), notes, "o_orderkey")


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 AND o_orderkey % 4 <> 0 THEN o_orderpriority WHEN o_orderkey % 3 = 0 THEN 'hallado' WHEN o_orderkey % 2 = 0 THEN NULL END AS state FROM orders WHERE o_orderkey % 2 = 0 OR o_orderkey % 3 = 0")
def merged_truth(spark: SparkSession, d: str) -> DataFrame:
    orders = table(spark, d, "orders")
    labelled = orders.where("o_orderkey % 2 = 0").select("o_orderkey", F.when(F.col("o_orderkey") % 4 == 0, "No especificado").otherwise(F.col("o_orderpriority")).alias("state"))
    return records.merge_truth(labelled, orders.where("o_orderkey % 3 = 0").select("o_orderkey", F.lit("hallado").alias("state")), "o_orderkey", ["state"])


_KINDS = "CASE l_linenumber WHEN 1 THEN 'resolutivo' WHEN 2 THEN 'resumen' WHEN 3 THEN 'estudio' ELSE 'otro' END"


@query(f"SELECT l_orderkey, kind, name FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY CASE kind WHEN 'estudio' THEN 1 WHEN 'resumen' THEN 2 ELSE 3 END, name) AS n FROM (SELECT l_orderkey, {_KINDS} AS kind, l_partkey::VARCHAR || '.pdf' AS name FROM lineitem) WHERE kind <> 'otro') WHERE n = 1")
def preferred_document(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem").select("l_orderkey", F.expr(_KINDS).alias("kind"), F.concat(F.col("l_partkey").cast("string"), F.lit(".pdf")).alias("name"))
    return records.preferred(rows, "l_orderkey", "kind", "name")


@query(f"WITH {_GAZETTES}, l AS (SELECT DISTINCT 'G' || (c_custkey % 120)::VARCHAR AS stem FROM customer WHERE c_custkey % 120 > 50), c AS (SELECT stem, count(DISTINCT clave) AS n FROM gazettes GROUP BY 1) SELECT coalesce(l.stem, c.stem) AS stem, l.stem IS NOT NULL AS listed, coalesce(n, 0) AS n FROM l FULL JOIN c ON l.stem = c.stem")
def gazette_key_counts(spark: SparkSession, d: str) -> DataFrame:
    listed = table(spark, d, "customer").where("c_custkey % 120 > 50").select(F.concat(F.lit("G"), (F.col("c_custkey") % 120).cast("string")).alias("stem"))
    return records.listed_counts(listed, keys.extract_keys(_gazettes(spark, d), "stem", "content"), "stem")


@query(f"WITH {PROJECTS_SQL}, k AS (SELECT clave, unnest(['state', 'sector', 'type']) AS kind, unnest([substr(clave, 3, 2), substr(clave, 1, 2), substr(clave, 9, 1)]) AS code FROM projects) SELECT kind, code, count(*) AS n, min(clave) AS first_key, max(clave) AS last_key FROM k GROUP BY 1, 2")
def collector_groups(spark: SparkSession, d: str) -> DataFrame:
    rows = keys.parse_key(projects(spark, d).select("clave"), "clave").where("valid")
    return records.collector_groups(rows, "clave", {"state": "state", "sector": "sector", "type": "kind"})


@query("WITH f AS (SELECT o_orderkey, coalesce(count(DISTINCT l_linenumber), 0) AS n FROM orders LEFT JOIN (SELECT * FROM lineitem WHERE l_linenumber <= 3) ON l_orderkey = o_orderkey GROUP BY 1) SELECT CASE WHEN n = 3 THEN 'complete' WHEN n > 0 THEN 'partial' ELSE 'failed' END AS status, count(*) AS n FROM f GROUP BY 1")
def batch_outcomes(spark: SparkSession, d: str) -> DataFrame:
    from acervo.plans.registry import status_matrix

    return status_matrix(spark, d).groupBy("status").agg(F.count("*").alias("n"))


@query(f"WITH {PROJECTS_SQL} SELECT count(*) AS projects, count(DISTINCT state) AS states, count(*) FILTER (status = 'resuelto') AS rulings, count(*) FILTER (municipality IS NOT NULL) AS placed FROM projects")
def vault_stats(spark: SparkSession, d: str) -> DataFrame:
    return projects(spark, d).agg(F.count("*").alias("projects"), F.countDistinct("state").alias("states"), F.count_if(F.col("status") == "resuelto").alias("rulings"), F.count_if(F.col("municipality").isNotNull()).alias("placed"))


@query("SELECT l_orderkey, count(*) AS pages, count(*) FILTER (l_returnflag = 'N') AS blank_pages, '# ' || l_orderkey || chr(10) || chr(10) || string_agg(CASE WHEN l_returnflag = 'N' THEN '' ELSE l_partkey::VARCHAR END, chr(10) || chr(10) ORDER BY l_linenumber, CASE WHEN l_returnflag = 'N' THEN '' ELSE l_partkey::VARCHAR END) AS content FROM lineitem GROUP BY l_orderkey")
def page_stats(spark: SparkSession, d: str) -> DataFrame:
    pages = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.when(F.col("l_returnflag") != "N", F.col("l_partkey").cast("string")).alias("t"))
    return sections.concat_pages(pages, "l_orderkey", "l_linenumber", "t")


@query("SELECT s_suppkey, coalesce(p, 'Sin permisos registrados') AS permits FROM supplier LEFT JOIN (SELECT l_suppkey, string_agg(p, ', ' ORDER BY p) AS p FROM (SELECT DISTINCT l_suppkey, l_returnflag || ' con ' || l_linestatus AS p FROM lineitem WHERE l_suppkey % 5 <> 0) GROUP BY 1) ON l_suppkey = s_suppkey")
def permit_text(spark: SparkSession, d: str) -> DataFrame:
    """What each vessel may catch, distinct and sorted, or a fixed sentence."""
    items = table(spark, d, "lineitem").where("l_suppkey % 5 <> 0").groupBy(F.col("l_suppkey").alias("s_suppkey")).agg(F.array_join(F.array_sort(F.collect_set(F.concat("l_returnflag", F.lit(" con "), "l_linestatus"))), ", ").alias("_p"))
    return table(spark, d, "supplier").join(items, "s_suppkey", "left").select("s_suppkey", F.coalesce("_p", F.lit("Sin permisos registrados")).alias("permits"))


@query(" UNION ALL ".join(f"SELECT '{s}' AS strategy, source AS field, count(*) AS samples, count(*) FILTER (contains(lower({e}), lang)) AS hits, round(100.0 * count(*) FILTER (contains(lower({e}), lang)) / count(*), 1)::DOUBLE AS pct FROM documents GROUP BY 2" for s, e in (("prefix", "substr(text, 1, 200)"), ("whole", "text"))))
def snippet_hit_rate(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "documents").select("source", "lang", F.explode(F.array(F.struct(F.lit("prefix").alias("strategy"), F.substring("text", 1, 200).alias("snippet")), F.struct(F.lit("whole").alias("strategy"), F.col("text").alias("snippet")))).alias("s"))
    return records.hit_rate(rows.select("s.strategy", F.col("source").alias("field"), "lang", "s.snippet"), "strategy", "field", "lang", "snippet")


@query(f"WITH {_GAZETTES}, k AS (SELECT DISTINCT clave FROM gazettes), r AS (SELECT DISTINCT clave FROM projects WHERE o_orderkey % 4 = 0) SELECT count(*) AS keys, count(*) FILTER (clave IN (SELECT clave FROM r)) AS with_report, (SELECT count(DISTINCT stem) FROM gazettes) AS texts FROM k")
def data_summary(spark: SparkSession, d: str) -> DataFrame:
    found = keys.extract_keys(_gazettes(spark, d), "stem", "content")
    reports = projects(spark, d).where("o_orderkey % 4 = 0").select("clave", F.lit(True).alias("_r")).distinct()
    counts = found.select("clave").distinct().join(reports, "clave", "left").agg(F.count("*").alias("keys"), F.count("_r").alias("with_report"))
    return counts.crossJoin(found.agg(F.countDistinct("stem").alias("texts")))


@query(f"WITH {PROJECTS_SQL} SELECT DISTINCT clave FROM projects ORDER BY clave DESC LIMIT 15")
def recent_keys(spark: SparkSession, d: str) -> DataFrame:
    return projects(spark, d).select("clave").distinct().orderBy(F.desc("clave")).limit(15)


_Q = [((i * 5) % 7 - 3) / 10 for i in range(64)]


@query(f"WITH q AS (SELECT {_Q}::DOUBLE[] AS q), s AS (SELECT vec_id, r_name, round(list_dot_product(embedding::DOUBLE[], q) / (sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) * sqrt(list_dot_product(q, q))), 4)::DOUBLE AS score FROM embeddings JOIN region ON label % 5 = r_regionkey, q) SELECT * FROM s WHERE score > 0.1 ORDER BY score DESC, vec_id LIMIT 20")
def threshold_match(spark: SparkSession, d: str) -> DataFrame:
    score = F.round(retrieval.cosine(F.col("embedding"), F.array(*[F.lit(x) for x in _Q])), 4)
    rows = table(spark, d, "embeddings").select("vec_id", (F.col("label") % 5).alias("r_regionkey"), score.alias("score")).where("score > 0.1D")
    return rows.join(F.broadcast(table(spark, d, "region")), "r_regionkey").select("vec_id", "r_name", "score").orderBy(F.desc("score"), "vec_id").limit(20)


@query("""WITH c AS (SELECT doc_id, c AS chunk, substr(text, c * 1700 + 1, 2000) AS body FROM (SELECT doc_id, text, unnest(range(CASE WHEN length(text) <= 2000 THEN 1 ELSE (length(text) - 1) // 1700 + 1 END)) AS c FROM documents)),
s AS (SELECT doc_id, chunk, count(*) OVER (PARTITION BY doc_id) AS n, """ + ", ".join(f"row_number() OVER (PARTITION BY doc_id ORDER BY len(regexp_extract_all(body, '{w}')) DESC, chunk) AS r{i}" for i, w in enumerate(("a", "e", "o"))) + """ FROM c) SELECT doc_id, chunk::BIGINT AS chunk FROM s WHERE n <= 8 OR least(r0, r1, r2) <= 2""")
def best_chunks(spark: SparkSession, d: str) -> DataFrame:
    """The two best chunks for each of three themes; short documents pass whole."""
    chunks, doc = text.chunk_chars(table(spark, d, "documents"), "doc_id", "text"), Window.partitionBy("doc_id")
    scored = chunks.select("doc_id", "chunk", *[F.regexp_count("body", F.lit(w)).alias(f"s{i}") for i, w in enumerate(("a", "e", "o"))])
    ranks = [F.row_number().over(doc.orderBy(F.desc(f"s{i}"), "chunk")) for i in range(3)]
    return scored.withColumns({"n": F.count("*").over(doc), "r": F.least(*ranks)}).where("n <= 8 OR r <= 2").select("doc_id", "chunk")


@query("SELECT o_orderkey AS id, CASE WHEN o_orderkey % 3 = 0 THEN 'ASEA' ELSE 'SEMARNAT' END AS source FROM orders WHERE o_orderkey % 3 = 0 OR o_orderkey % 5 = 0")
def merged_registry(spark: SparkSession, d: str) -> DataFrame:
    ids = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"))
    old = ids.where("id % 5 = 0").unionByName(ids.where("id % 7 = 0 AND id % 5 <> 0")).select("id", F.when((F.col("id") % 7 == 0) & (F.col("id") % 5 != 0), "ASEA").otherwise("SEMARNAT").alias("source"))
    return records.merge_other_source(old, ids.where("id % 3 = 0").select("id", F.lit("ASEA").alias("source")), "id", "source", "ASEA")


@query("SELECT o_orderkey AS id, CASE WHEN o_orderkey % 2 = 0 THEN o_orderpriority ELSE 'nuevo' END AS name, CASE WHEN o_orderkey % 2 = 0 AND o_orderkey % 4 <> 0 THEN 'f.pdf' WHEN o_orderkey % 3 = 0 THEN 'n.pdf' END AS file FROM orders WHERE o_orderkey % 2 = 0 OR o_orderkey % 3 = 0")
def refined_registry(spark: SparkSession, d: str) -> DataFrame:
    orders, k = table(spark, d, "orders"), F.col("o_orderkey")
    old = orders.where("o_orderkey % 2 = 0").select(k.alias("id"), F.col("o_orderpriority").alias("name"), F.when(k % 4 == 0, " ").otherwise("f.pdf").alias("file"))
    return records.keep_refined(old, orders.where("o_orderkey % 3 = 0").select(k.alias("id"), F.lit("nuevo").alias("name"), F.lit("n.pdf").alias("file")), "id", "file")


@query("SELECT r_name AS name FROM region")
def default_if_empty(spark: SparkSession, d: str) -> DataFrame:
    found = table(spark, d, "customer").where("c_custkey < 0").select(F.col("c_name").alias("name"))
    return records.or_default(found, table(spark, d, "region").select(F.col("r_name").alias("name")))


@query(f"WITH {PROJECTS_SQL} SELECT o_orderkey, o_orderkey % 3 = 0 OR o_orderkey % 2 = 0 AS dom, coalesce(n >= 3, false) AS ocr, o_orderkey % 5 <> 0 AS dw, o_orderkey % 4 = 0 AS vault FROM projects LEFT JOIN (SELECT l_orderkey, max(l_linenumber) AS n FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey")
def stage_contracts(spark: SparkSession, d: str) -> DataFrame:
    base, k = projects(spark, d).select("o_orderkey", "municipality"), F.col("o_orderkey")
    meta = base.select("o_orderkey", "municipality", F.when(k % 2 == 0, "x").otherwise("").alias("sponsor"))
    texts = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), F.repeat(F.lit("p"), F.col("l_linenumber") * 30).alias("text"))
    notes = base.select("o_orderkey", F.repeat(F.lit("ñ"), F.when(k % 4 == 0, 60).otherwise(50)).alias("content"))
    return records.contracts(base, meta, texts, base.where("o_orderkey % 5 <> 0"), notes, "o_orderkey", ["municipality", "sponsor"])


@query(f"WITH {PROJECTS_SQL}, f AS (SELECT *, CASE WHEN clave LIKE '%9999' THEN 'mock' WHEN o_orderkey % 6 = 0 THEN 'no file' END AS bad FROM projects), g AS (SELECT coalesce(bad, CASE WHEN o_orderkey <> min(CASE WHEN bad IS NULL THEN o_orderkey END) OVER (PARTITION BY clave) THEN 'duplicate' END, 'kept') AS reason FROM f) SELECT reason, count(*) AS n FROM g GROUP BY 1")
def remediated(spark: SparkSession, d: str) -> DataFrame:
    """Rows by what became of them."""
    return records.remediation(projects(spark, d), "clave", "o_orderkey", F.col("o_orderkey") % 6 != 0).groupBy(F.coalesce("reason", F.lit("kept")).alias("reason")).agg(F.count("*").alias("n"))


_NOTE_SQL = f"""{PROJECTS_SQL}, notes AS (SELECT o_orderkey, clave, status, '---' || chr(10) || 'clave: ' || clave || chr(10) || 'estado: ' || state || coalesce(chr(10) || 'municipio: ' || municipality, '') || chr(10) || '---' || chr(10) || '# ' || project_name || chr(10) || chr(10) || '- [[' || state || ']]' || coalesce(chr(10) || '- [[' || municipality || ']]', '') || chr(10) AS content FROM projects)"""


def _notes(spark: SparkSession, d: str) -> DataFrame:
    note = records.render_note(F.col("clave"), F.col("project_name"), {"estado": F.col("state"), "municipio": F.col("municipality")}, [F.col("state"), F.col("municipality")])
    return projects(spark, d).select("o_orderkey", "clave", "status", note.alias("content"))


@query(f"WITH {_NOTE_SQL} SELECT o_orderkey, content FROM notes")
def rendered_notes(spark: SparkSession, d: str) -> DataFrame:
    return _notes(spark, d).select("o_orderkey", "content")


@query(f"WITH {_NOTE_SQL} SELECT o_orderkey FROM notes WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem)")
def purged_notes(spark: SparkSession, d: str) -> DataFrame:
    """Notes whose project is still there."""
    alive = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"))
    return _notes(spark, d).join(alive, "o_orderkey", "left_semi").select("o_orderkey")


@query(f"WITH {_NOTE_SQL} SELECT o_orderkey, replace(content, chr(10) || '---' || chr(10) || '# ', chr(10) || chr(10) || 'riesgo: ALTO---' || chr(10) || '# ') AS content FROM notes")
def patched_notes(spark: SparkSession, d: str) -> DataFrame:
    return _notes(spark, d).select("o_orderkey", sections.patch_frontmatter(F.col("content"), "riesgo", F.lit("ALTO")).alias("content"))


@query(f"WITH {_NOTE_SQL} SELECT clave, state, coalesce(municipality, 'sin municipio') AS municipality, CASE WHEN o_orderkey % 2 = 0 THEN '2026' ELSE 'viejo' END AS stamp FROM (SELECT clave, state, municipality, o_orderkey FROM projects QUALIFY count(*) OVER (PARTITION BY clave) = 1)")
def backsynced(spark: SparkSession, d: str) -> DataFrame:
    """Fields of edited notes written back to the rows that exist; keys that stand twice are left to the audit."""
    unique = projects(spark, d).groupBy("clave").agg(F.count("*").alias("n"), F.max("o_orderkey").alias("o_orderkey")).where("n = 1").select("clave", "o_orderkey")
    old = unique.select("clave", F.substring("clave", 3, 2).alias("state"), F.lit("sin municipio").alias("municipality"), F.lit("viejo").alias("stamp"), "o_orderkey")
    notes = _notes(spark, d).join(unique.select("o_orderkey"), "o_orderkey", "left_semi")
    fields = notes.select("clave", sections.labelled(F.col("content"), {"state": "^estado", "municipality": "^municipio"}).alias("f")).select("clave", "f.*")
    fields = fields.join(unique.where("o_orderkey % 2 = 0 OR o_orderkey % 3 = 0").select("clave"), "clave", "left_semi")
    out = upsert.update_matching(old, fields, ["clave"], ["state", "municipality"], "stamp", F.lit("2026"))
    return out.select("clave", "state", "municipality", F.when(F.col("o_orderkey") % 2 == 0, F.col("stamp")).otherwise("viejo").alias("stamp"))


@query(f"WITH {_NOTE_SQL} SELECT state, count(*) AS n FROM (SELECT CASE WHEN o_orderkey % 5 = 0 THEN 'missing' WHEN o_orderkey % 2 = 0 THEN 'detailed' ELSE 'skeleton' END AS state, clave FROM projects QUALIFY row_number() OVER (PARTITION BY o_orderkey) = 1) GROUP BY 1")
def audited_vault(spark: SparkSession, d: str) -> DataFrame:
    notes = projects(spark, d).where("o_orderkey % 5 <> 0").select("o_orderkey", F.repeat(F.lit("x"), F.when(F.col("o_orderkey") % 2 == 0, 1001).otherwise(1000)).alias("content"))
    return records.note_state(projects(spark, d), notes, "o_orderkey").groupBy("state").agg(F.count("*").alias("n"))


@query("SELECT o_orderkey, list_filter(['estudio', 'resumen', 'resolutivo'], lambda x: list_contains(k, x))::VARCHAR AS files, CASE WHEN list_contains(k, 'resolutivo') THEN 'Resuelto' ELSE 'En evaluación' END AS status FROM (SELECT o_orderkey, coalesce(list(k) FILTER (k IS NOT NULL), []) AS k FROM orders LEFT JOIN (SELECT l_orderkey, " + _KINDS + " AS k FROM lineitem) ON l_orderkey = o_orderkey GROUP BY 1)")
def assembled_projects(spark: SparkSession, d: str) -> DataFrame:
    kinds = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), F.expr(_KINDS).alias("kind"))
    return records.assemble(table(spark, d, "orders"), kinds, "o_orderkey").select("o_orderkey", F.concat(F.lit("["), F.array_join("files", ", "), F.lit("]")).alias("files"), "status")


@query("SELECT reason, count(*) AS n FROM (SELECT CASE WHEN NOT length(text) >= 200 THEN 'short' WHEN lang = 'fr' THEN 'language' ELSE 'accepted' END AS reason FROM documents) GROUP BY 1")
def quarantined(spark: SparkSession, d: str) -> DataFrame:
    rows = records.quarantine(table(spark, d, "documents"), {"short": F.length("text") >= 200, "language": F.col("lang") != "fr"})
    return rows.groupBy(F.coalesce("reason", F.lit("accepted")).alias("reason")).agg(F.count("*").alias("n"))


@query("SELECT doc_id, array_to_string(list_sort(list_filter([CASE WHEN contains(lower(text), 'license') THEN 'licencia' END, CASE WHEN contains(lower(text), 'the') THEN 'inglés' END], lambda x: x IS NOT NULL)), ',') AS tags FROM documents")
def autotags(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.array_join(sections.autotag(F.col("text"), {"License": "licencia", "the": "inglés"}), ",").alias("tags"))


@query("SELECT doc_id, 'Proyecto' AS project_name, substr(text, 1, 300) AS summary, 'MEDIO' AS legal_risk_level, 0.7::DOUBLE AS confidence_score FROM documents WHERE NOT regexp_matches(text, '(?m)^# ')")
def fallback_evaluations(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "documents").where(~F.col("text").rlike("(?m)^# "))
    return rows.select("doc_id", sections.fallback_evaluation(F.col("text")).alias("e")).select("doc_id", "e.*")


@query(None)
def chunk_headers(spark: SparkSession, d: str) -> DataFrame:
    """Lines that start with A to M serve as headers; tests hold the chunks against a plain loop."""
    marked = F.regexp_replace(F.regexp_replace("text", r"(?m)^(?=[A-F])", "# "), r"(?m)^(?=[G-M])", "## ")
    return sections.chunk_by_headers(table(spark, d, "documents").select("doc_id", marked.alias("text")), "doc_id", "text")


@query(None)
def targeted_snippets(spark: SparkSession, d: str) -> DataFrame:
    """Tests hold the snippets against a plain loop."""
    return table(spark, d, "documents").select("doc_id", sections.targeted_snippet(F.col("text"), ("license", r"version\s", "token"), 500).alias("snippet"))


def _encounters(spark: SparkSession, d: str) -> DataFrame:
    events = table(spark, d, "events").where("event_type = 'error'")
    return events.select(F.col("event_id").alias("event"), F.col("user_id").alias("vessel"), (F.col("user_id") % 64).alias("cell"), F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("Sp "), (F.col("event_id") % 10).cast("string"))).alias("species"))


_MARITIME = """e AS (SELECT event_id AS event, user_id AS vessel, user_id % 64 AS cell, CASE WHEN event_id % 3 = 0 THEN 'sp_' || (event_id % 10)::VARCHAR END AS species FROM events WHERE event_type = 'error'),
edges AS (SELECT 'vessel_' || vessel AS src, 'cell_' || cell AS dst, 'DETECTED_IN' AS relation FROM e UNION SELECT 'vessel_' || vessel, 'event_' || event, 'ENCOUNTERED' FROM e UNION SELECT 'event_' || event, 'species_' || species, 'ENCOUNTERED' FROM e WHERE species IS NOT NULL
UNION SELECT 'cell_' || c, 'cell_' || (c + 1), 'BORDERS' FROM (SELECT DISTINCT cell AS c FROM e) WHERE c % 8 < 7 UNION SELECT 'vessel_' || c_custkey, 'permit_' || c_nationkey, 'HAS_PERMIT' FROM customer WHERE c_custkey IN (SELECT vessel FROM e))"""


def _maritime(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    seen = _encounters(spark, d)
    touch = seen.select(F.col("cell").alias("a")).distinct().where("a % 8 < 7").withColumn("b", F.col("a") + 1)
    return graph.maritime(seen, touch, table(spark, d, "customer").select(F.col("c_custkey").alias("vessel"), F.col("c_nationkey").alias("permit")))


@query(f"WITH {_MARITIME} SELECT * FROM edges")
def maritime_graph(spark: SparkSession, d: str) -> DataFrame:
    return _maritime(spark, d)[1]


@query(f"""WITH RECURSIVE {_MARITIME}, n AS (SELECT DISTINCT unnest([src, dst]) AS id FROM edges WHERE NOT (relation = 'BORDERS')), own AS (SELECT id FROM n WHERE id NOT LIKE 'cell%'),
b AS (SELECT src, dst FROM edges WHERE src NOT LIKE 'cell%' AND dst NOT LIKE 'cell%' UNION SELECT dst, src FROM edges WHERE src NOT LIKE 'cell%' AND dst NOT LIKE 'cell%'),
r AS (SELECT id, id AS seen FROM own UNION SELECT r.id, b.dst FROM r JOIN b ON b.src = r.seen), c AS (SELECT id, min(seen) AS top FROM r GROUP BY 1)
SELECT id, dense_rank() OVER (ORDER BY top) - 1 AS community FROM c UNION ALL SELECT id, (SELECT count(DISTINCT top) FROM c) FROM (SELECT DISTINCT unnest([src, dst]) AS id FROM edges) WHERE id LIKE 'cell%'""")
def communities(spark: SparkSession, d: str) -> DataFrame:
    nodes, edges = _maritime(spark, d)
    return graph.components(nodes, edges, "cell")


@query(f"WITH {PROJECTS_SQL} SELECT DISTINCT 'Project' AS label, clave AS id FROM projects UNION SELECT 'State', state FROM projects UNION SELECT 'Type', substr(clave, 9, 1) FROM projects")
def property_graph_nodes(spark: SparkSession, d: str) -> DataFrame:
    item = lambda label, c: F.struct(F.lit(label).alias("label"), c.alias("id"))
    return projects(spark, d).select(F.explode(F.array(item("Project", F.col("clave")), item("State", F.col("state")), item("Type", F.substring("clave", 9, 1)))).alias("n")).select("n.*").distinct()


@query(f"WITH {_NOTE_SQL}, l AS (SELECT clave, upper(state) AS dst FROM projects UNION ALL SELECT clave, upper(municipality) FROM projects WHERE municipality IS NOT NULL) SELECT 'PROYECTO_' || clave AS src, dst, 'VINCULADO_A' AS relation, round(1.0 + 0.1 * (count(*) - 1), 4)::DOUBLE AS weight FROM l GROUP BY 1, 2")
def note_graph(spark: SparkSession, d: str) -> DataFrame:
    from acervo.operators.notes import targets

    return graph.note_edges(_notes(spark, d).select("clave", F.explode(targets(F.col("content"))).alias("target")), "clave", "target")


_FUSED = "SELECT doc_id, row_number() OVER (ORDER BY {} DESC, doc_id) AS r FROM (SELECT doc_id, {} AS {} FROM documents)"


@query(f"WITH v AS ({_FUSED.format('a', 'doc_id * 7 % 101', 'a')}), l AS ({_FUSED.format('b', 'doc_id * 11 % 103', 'b')}) SELECT doc_id, round(coalesce(1.0::DOUBLE / (60 + v.r), 0) + coalesce(1.0::DOUBLE / (60 + l.r), 0), 5)::DOUBLE AS score FROM v FULL JOIN l USING (doc_id) ORDER BY score DESC, doc_id LIMIT 10")
def fused_ranks(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    ranked = lambda a, m: docs.select("doc_id", (F.col("doc_id") * a % m).cast("double").alias("score"))
    return retrieval.fuse(ranked(7, 101), ranked(11, 103), "doc_id")


@query("SELECT source, string_agg('[' || doc_id || ' | ' || lang || ']' || chr(10) || substr(text, 1, 80), chr(10) || chr(10) ORDER BY r) AS context FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS r FROM documents QUALIFY r <= 5) GROUP BY 1")
def cited_context(spark: SparkSession, d: str) -> DataFrame:
    """Tags and starts of the five longest documents of each source; the rank limit is pushed below the shuffle by the engine."""
    docs = table(spark, d, "documents").select("doc_id", "source", "lang", "n_chars", F.substring("text", 1, 80).alias("body"))
    ranked = docs.withColumn("r", F.row_number().over(Window.partitionBy("source").orderBy(F.desc("n_chars"), "doc_id"))).where("r <= 5")
    return records.citations(ranked, "source", "r", "doc_id", "lang", "body", 5)


@query("SELECT vec_id, score FROM (SELECT vec_id, round(embedding[1]::DOUBLE, 4) AS score FROM embeddings ORDER BY score DESC, vec_id LIMIT 2) WHERE score >= 0.05")
def auto_context(spark: SparkSession, d: str) -> DataFrame:
    """Of the two best hits, those good enough."""
    return table(spark, d, "embeddings").select("vec_id", F.round(F.col("embedding")[0].cast("double"), 4).alias("score")).orderBy(F.desc("score"), "vec_id").limit(2).where("score >= 0.05D")


@query(f"WITH {DIRTY_SQL} SELECT o_orderkey FROM dirty WHERE NOT clave LIKE '%9999' AND has_study")
def verified_projects(spark: SparkSession, d: str) -> DataFrame:
    rows = dirty_projects(spark, d)
    return rows.where(~records.is_mock_key(F.col("clave")) & (F.size("files_downloaded") > 0)).select("o_orderkey")
