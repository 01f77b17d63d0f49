"""Queries of curation: verified files, manifest, ledger, remediation, assembled records, signals with contexts, padded as-of context."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from acervo.functions.lookups import STATES, TYPES
from acervo.operators import curation, graph, joins, text
from acervo.plans.bindings import EVALUATIONS_SQL, PROJECTS_SQL, evaluations, projects, table
from acervo.plans.registry import _case, query

_KEY = "'21PU2025H' || lpad((doc_id % 10000)::VARCHAR, 4, '0')"
_PATH = f"'d/' || CASE WHEN doc_id % 14 = 0 THEN {_KEY} ELSE 'f' END || '.' || doc_id::VARCHAR || '.pdf'"
_BYTES = "CASE WHEN doc_id % 11 = 0 THEN '<html>' ELSE '%PDF-1.7' END || text"
_PAGE = f"CASE WHEN doc_id % 5 = 0 THEN ' ' || chr(10) WHEN doc_id % 7 = 0 THEN '01AG2024H0001' ELSE 'Clave ' || {_KEY} || ' ' || text END"
_LEAST = 300


def _downloads(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Texts as files of bytes, and what a reader says of those that it opens; some are absent, damaged, closed or empty."""
    e = lambda sql: F.expr(sql.replace("::VARCHAR", "").replace("(doc_id % 10000)", "cast(doc_id % 10000 as string)"))
    docs = table(spark, d, "documents")
    files = docs.select(e(_PATH).alias("path"), e(_KEY).alias("clave"), F.when(F.col("doc_id") % 29 != 0, F.encode(e(_BYTES), "UTF-8")).alias("content")).withColumn("length", F.octet_length("content"))
    pages = docs.where("doc_id % 23 <> 0").select(e(_PATH).alias("path"), F.when(F.col("doc_id") % 19 == 0, 0).otherwise(3).alias("page_count"), (F.col("doc_id") % 17 == 0).alias("encrypted"), e(_PAGE).alias("text"))
    return files, pages


_VERIFIED = f"""f AS (SELECT doc_id, {_PATH} AS path, {_KEY} AS clave, CASE WHEN doc_id % 29 <> 0 THEN {_BYTES} END AS content FROM documents),
checks AS (SELECT *, CASE WHEN content IS NULL THEN 'MISSING' WHEN strlen(content) < {_LEAST} THEN 'EMPTY' WHEN doc_id % 11 = 0 OR doc_id % 23 = 0 THEN 'CORRUPT' WHEN doc_id % 17 = 0 THEN 'ENCRYPTED'
    WHEN doc_id % 19 = 0 THEN 'EMPTY' WHEN doc_id % 5 = 0 THEN 'VERIFIED_NO_TEXT' WHEN doc_id % 7 = 0 AND doc_id % 14 <> 0 THEN 'MISMATCH' ELSE 'VERIFIED' END AS status FROM f),
checked AS (SELECT *, status IN ('VERIFIED', 'VERIFIED_NO_TEXT', 'MISMATCH') AS valid FROM checks),
verified AS (SELECT path, clave, status, valid, CASE WHEN strlen(content) >= {_LEAST} AND doc_id % 11 <> 0 THEN sha256(content) END AS sha256, strlen(content) AS file_size, CASE WHEN valid THEN 3 END AS page_count,
    CASE WHEN status IN ('VERIFIED', 'MISMATCH') THEN CASE WHEN doc_id % 7 = 0 THEN '01AG2024H0001' ELSE clave END ELSE '' END AS found_keys FROM checked)"""


def _verified(spark: SparkSession, d: str) -> DataFrame:
    return curation.verify_files(*_downloads(spark, d), least=_LEAST)


@query(f"WITH {_VERIFIED} SELECT * FROM verified")
def verified_downloads(spark: SparkSession, d: str) -> DataFrame:
    return _verified(spark, d).withColumn("found_keys", F.array_join("found_keys", ","))


_MANIFEST = f"""{_VERIFIED}, old AS (SELECT path, 'KNOWN' AS clave, 'estudio' AS file_type, 'CORRUPT' AS status, '' AS sha256, 1 AS file_size, 0 AS page_count, 1 AS day FROM f WHERE doc_id % 2 = 0),
fresh AS (SELECT verified.* FROM verified JOIN f USING (path) WHERE doc_id % 3 <> 0),
manifest AS (SELECT path, CASE WHEN old.status IS NOT NULL THEN old.clave ELSE fresh.clave END AS clave, coalesce(old.file_type, 'resumen') AS file_type, coalesce(fresh.status, old.status) AS status, CASE WHEN fresh.status IS NOT NULL THEN coalesce(fresh.sha256, '') ELSE old.sha256 END AS sha256,
    CASE WHEN fresh.status IS NOT NULL THEN coalesce(fresh.file_size, 0) ELSE old.file_size END AS file_size, CASE WHEN fresh.status IS NOT NULL THEN coalesce(fresh.page_count, 0) ELSE old.page_count END AS page_count, CASE WHEN fresh.status IS NOT NULL THEN 2 ELSE old.day END AS verified_at
  FROM old FULL JOIN fresh USING (path))"""


@query(f"WITH {_MANIFEST} SELECT * FROM manifest")
def download_manifest(spark: SparkSession, d: str) -> DataFrame:
    """A manifest of every second file after two thirds of all were verified; verified_at is the number of the run."""
    number = F.regexp_extract("path", r"([0-9]+)\.pdf$", 1).cast("long")
    found, files = _verified(spark, d), _downloads(spark, d)[0]
    old = files.where(number % 2 == 0).select("path", F.lit("KNOWN").alias("clave"), F.lit("estudio").alias("file_type"), F.lit("CORRUPT").alias("status"), F.lit("").alias("sha256"), F.lit(1).cast("long").alias("file_size"), F.lit(0).alias("page_count"), F.lit(1).alias("verified_at"))
    return curation.upsert_manifest(old, found.where(number % 3 != 0).withColumn("file_type", F.lit("resumen")), F.lit(2))


@query(f"WITH {_MANIFEST} SELECT count(*) AS total, count(*) FILTER (status = 'VERIFIED') AS verified, count(*) FILTER (status IN ('CORRUPT', 'EMPTY', 'MISMATCH')) AS corrupt, coalesce(round(100.0::DOUBLE * count(*) FILTER (status = 'VERIFIED') / nullif(count(*), 0), 1), 100.0)::DOUBLE AS health_pct FROM manifest")
def manifest_totals(spark: SparkSession, d: str) -> DataFrame:
    return curation.manifest_totals(download_manifest(spark, d))


_OUTCOME = "CASE WHEN event_type = 'purchase' THEN 'done' ELSE event_type END"


@query(f"""WITH a AS (SELECT 'K' || user_id::VARCHAR AS clave, {_OUTCOME} AS status, event_id AS t, props AS files FROM events WHERE user_id % 3 <> 0),
n AS (SELECT clave, count(*) AS n, max(t) AS t, arg_max(status, t) AS status, arg_max(files, t) AS files FROM a GROUP BY 1),
o AS (SELECT 'K' || user_id::VARCHAR AS clave, 'failed' AS status, count(*) AS attempts, -1 AS last_try, 'old' AS files FROM events WHERE user_id % 2 = 0 GROUP BY 1)
SELECT clave, coalesce(n.status, o.status) AS status, (coalesce(o.attempts, 0) + coalesce(n.n, 0))::BIGINT AS attempts, coalesce(n.t, o.last_try)::BIGINT AS last_try, coalesce(n.files, o.files) AS files, coalesce(n.status = 'done', false) AS done FROM o FULL JOIN n USING (clave)""")
def attempt_ledger(spark: SparkSession, d: str) -> DataFrame:
    """Events as attempts on the key of their user; places in time are their ids."""
    events = table(spark, d, "events").select(F.concat(F.lit("K"), F.col("user_id").cast("string")).alias("clave"), F.expr(_OUTCOME).alias("status"), F.col("event_id").alias("at"), F.col("props").alias("files"), "user_id")
    old = events.where("user_id % 2 = 0").groupBy("clave").agg(F.lit("failed").alias("status"), F.count("*").alias("attempts"), F.lit(-1).cast("long").alias("last_try"), F.lit("old").alias("files"))
    return curation.record_attempts(old, events.where("user_id % 3 <> 0").drop("user_id"))


_FILE_KIND = "CASE l_linenumber WHEN 1 THEN 'resolutivo' WHEN 2 THEN 'resumen' WHEN 3 THEN 'estudio' ELSE 'extraccion' END"
_FILE_NAME = "clave || CASE l_partkey % 3 WHEN 0 THEN '' WHEN 1 THEN '.a' ELSE '_v2' END || CASE WHEN l_linenumber > 3 THEN '.md' ELSE '.pdf' END"
_FILES = f"{PROJECTS_SQL}, files AS (SELECT {_FILE_NAME} AS name, {_FILE_KIND} AS kind, l_orderkey * 10 + l_linenumber AS place, l_partkey % 50 AS part, substr(clave, 1, 13) AS clave FROM lineitem JOIN projects ON l_orderkey = o_orderkey WHERE l_quantity > 15)"


def _files(spark: SparkSession, d: str) -> DataFrame:
    """Lines as files of their order's project: (name, kind, place, digest)."""
    rows = table(spark, d, "lineitem").where("l_quantity > 15").join(projects(spark, d).select(F.col("o_orderkey").alias("l_orderkey"), "clave"), "l_orderkey")
    return rows.select(F.expr(_FILE_NAME).alias("name"), F.expr(_FILE_KIND).alias("kind"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("place"), F.when(F.col("l_partkey") % 50 != 0, F.sha2((F.col("l_partkey") % 50).cast("string"), 256)).alias("digest"))


@query(f"""WITH {_FILES}, m AS (SELECT *, regexp_matches(name, '_v.*[.](pdf|md)$') AS copy FROM files),
g AS (SELECT part, min(place) AS first FROM m WHERE NOT copy AND kind <> 'extraccion' AND part <> 0 GROUP BY 1)
SELECT place, name, CASE WHEN copy THEN 'version' WHEN kind <> 'extraccion' AND place > first THEN 'repeated' END AS reason FROM m LEFT JOIN g USING (part)""")
def remediated_files(spark: SparkSession, d: str) -> DataFrame:
    return curation.remediate_files(_files(spark, d), "name", "digest", "place").select("place", "name", "reason")


_REMEDIATED = f"""{_FILES}, dirty AS (SELECT o_orderkey, clave, CASE WHEN o_orderkey % 13 = 0 THEN 'Desconocido' WHEN o_orderkey % 7 = 0 THEN NULL ELSE state END AS state, CASE WHEN o_orderkey % 17 = 0 THEN 1980 WHEN o_orderkey % 19 <> 0 THEN year END AS year FROM projects),
r AS (SELECT *, CASE WHEN clave LIKE '%9999' THEN 'mock' WHEN clave NOT IN (SELECT clave FROM files) THEN 'no file' END AS reason FROM dirty),
x AS (SELECT *, reason IS NULL AND (state IS NULL OR state = 'Desconocido') AS state_fixed, reason IS NULL AND year IS DISTINCT FROM substr(clave, 5, 4)::INT AS year_fixed FROM r),
remediated AS (SELECT o_orderkey, clave, CASE WHEN state_fixed THEN {_case("substr(clave, 3, 2)", STATES)} ELSE state END AS state, CASE WHEN year_fixed THEN substr(clave, 5, 4)::INT ELSE year END AS year, reason, state_fixed, year_fixed FROM x)"""


@query(f"WITH {_REMEDIATED} SELECT * FROM remediated")
def remediated_projects(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    dirty = projects(spark, d).select("o_orderkey", "clave", F.when(k % 13 == 0, "Desconocido").when(k % 7 != 0, F.col("state")).alias("state"), F.when(k % 17 == 0, 1980).when(k % 19 != 0, F.col("year")).alias("year"))
    return curation.remediate_projects(dirty, _files(spark, d))


@query(f"WITH {_REMEDIATED} SELECT count(reason) AS purged, count(*) FILTER (state_fixed) AS states_fixed, count(*) FILTER (year_fixed) AS years_fixed FROM remediated")
def remediation_counts(spark: SparkSession, d: str) -> DataFrame:
    return curation.remediation_counts(remediated_projects(spark, d))


_TITLE = "CASE WHEN o_orderkey % 8 = 1 THEN 'R' || o_orderkey::VARCHAR END"


@query(f"""WITH {_FILES}, {EVALUATIONS_SQL},
have AS (SELECT clave, bool_or(kind = 'resumen') AS a, bool_or(kind = 'estudio') AS b, bool_or(kind = 'resolutivo') AS c, bool_or(kind = 'resolutivo' AND name = clave || '.pdf') AS ruling FROM files WHERE NOT clave LIKE '%9999' GROUP BY 1),
listed AS (SELECT clave, max('L' || o_orderkey::VARCHAR) AS project_name, max(CASE WHEN o_orderkey % 2 = 0 THEN 'Lugar' ELSE '' END) AS location, max(CASE WHEN o_orderkey % 5 <> 0 THEN sponsor END) AS promovente FROM projects WHERE o_orderkey % 3 = 0 GROUP BY 1),
reports AS (SELECT clave, max({_TITLE}) AS title, max(veredicto) AS veredicto, max(score) AS score, max(confianza_pct) AS pct, max(sponsor) AS s FROM projects JOIN evaluations USING (o_orderkey) WHERE o_orderkey % 4 = 1 GROUP BY 1)
SELECT clave, coalesce(title, project_name, 'Proyecto ' || clave) AS project_name, CASE WHEN (a AND b AND c) OR ruling THEN 'Resuelto' ELSE 'En evaluación' END AS status, substr(clave, 1, 2) AS sector,
  CASE WHEN location <> '' THEN location ELSE {_case("substr(clave, 3, 2)", STATES)} END AS state, substr(clave, 5, 4)::INT AS year, concat_ws(',', CASE WHEN a THEN 'resumen' END, CASE WHEN b THEN 'estudio' END, CASE WHEN c THEN 'resolutivo' END) AS files_downloaded,
  coalesce(promovente, 'Desconocido') AS promovente, coalesce(veredicto, 'PENDIENTE') AS veredicto, coalesce(score, 0.0)::DOUBLE AS score, coalesce(pct, 0)::INT AS confianza_pct, coalesce(s, '') AS yes_signals, '' AS no_signals FROM have LEFT JOIN listed USING (clave) LEFT JOIN reports USING (clave)""")
def assembled_records(spark: SparkSession, d: str) -> DataFrame:
    rows, k = projects(spark, d), F.col("o_orderkey")
    listed = rows.where(k % 3 == 0).groupBy("clave").agg(F.max(F.concat(F.lit("L"), k.cast("string"))).alias("project_name"), F.max(F.when(k % 2 == 0, "Lugar").otherwise("")).alias("location"), F.max(F.when(k % 5 != 0, F.col("sponsor"))).alias("promovente"))
    none = F.array().cast("array<string>")
    reports = rows.join(evaluations(spark, d), "o_orderkey").where(k % 4 == 1).groupBy("clave").agg(F.max(F.when(k % 8 == 1, F.concat(F.lit("R"), k.cast("string")))).alias("project_name"), *[F.max(c).alias(c) for c in ("veredicto", "score", "confianza_pct", "sponsor")])
    reports = reports.select("clave", "project_name", "veredicto", "score", "confianza_pct", F.array("sponsor").alias("yes_signals"), *[none.alias(c) for c in ("knockouts", "no_signals", "condicionantes")])
    out = curation.assemble_records(rows, _files(spark, d), listed, reports)
    lists = {c: F.array_join(c, ",") for c in ("files_downloaded", "yes_signals", "no_signals")}
    return out.withColumns(lists).drop("knockouts", "condicionantes")


def _contexts(patterns: tuple[str, ...]) -> str:
    """SQL of the contexts of at most five hits, of which each pattern in turn gives its first."""
    each = []
    for p in patterns:
        m, s = f"regexp_extract_all(text, '(?i){p}')", f"string_split_regex(text, '(?i){p}')"
        start = f"(list_sum(list_transform({s}[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform({m}[1:i - 1], lambda x: length(x))), 0))::BIGINT"
        context = f"regexp_replace(substr(text, greatest({start} - 50, 0) + 1, {start} + length({m}[i]) + 50 - greatest({start} - 50, 0)), '^\\s+|\\s+$', '', 'g')"
        each.append(f"list_transform(range(1, least(len({m}), 5) + 1), lambda i: {context})")
    return f"array_to_string(list_concat({', '.join(each)})[1:5], '|')" if len(each) > 1 else f"array_to_string({each[0]}, '|')"


@query(f"""WITH h AS (SELECT doc_id, len(regexp_extract_all(text, '(?i)the')) AS a, len(regexp_extract_all(text, '(?i)of')) AS b, len(regexp_extract_all(text, '(?i)and')) AS c, {_contexts(("the", "of"))} AS y, {_contexts(("and",))} AS n FROM documents),
s AS (SELECT *, least(a, 5) + least(b, greatest(1, 5 - least(a, 5))) AS good, least(c, 5) AS bad, doc_id % 29 = 0 AS out FROM h), t AS (SELECT *, CASE WHEN out THEN 0.0::DOUBLE ELSE round(good::DOUBLE / greatest(good + bad, 1), 2) END AS score FROM s)
SELECT doc_id, CASE WHEN score >= 0.6 THEN 'FAVORABLE' WHEN score >= 0.3 THEN 'CONDICIONADO' ELSE 'DESFAVORABLE' END AS veredicto, score, CASE WHEN out THEN 100 ELSE 40 END AS confianza_pct, CASE WHEN out THEN '' ELSE y END AS yes_signals, CASE WHEN out THEN 'Knockout automático detectado' ELSE n END AS no_signals, CASE WHEN out THEN 'K' ELSE '' END AS knockouts FROM t""")
def signal_reports(spark: SparkSession, d: str) -> DataFrame:
    report = text.heuristic_report(F.col("text"), F.when(F.col("doc_id") % 29 == 0, F.array(F.lit("K"))), ("the", "of"), ("and",))
    rows = table(spark, d, "documents").select("doc_id", report.alias("r")).select("doc_id", "r.*")
    return rows.withColumns({c: F.array_join(c, "|") for c in ("yes_signals", "no_signals", "knockouts")})


@query("""WITH p AS (SELECT user_id, ts, value FROM events WHERE event_type <> 'error'), g AS (SELECT user_id, ts AS start, event_id AS gap_id FROM events WHERE event_type = 'error'),
n AS (SELECT gap_id, value, row_number() OVER (PARTITION BY gap_id ORDER BY ts DESC) AS back FROM g JOIN p ON g.user_id = p.user_id AND ts < start), k AS (SELECT gap_id, value, back, least(count(*) OVER (PARTITION BY gap_id), 12) AS held FROM n),
c AS (SELECT gap_id, held, list(value ORDER BY back DESC) AS v FROM k WHERE back <= 12 AND held >= 3 GROUP BY 1, 2)
SELECT gap_id, unnest(range(0, 12)) AS place, v[least(unnest(range(0, 12)) + 1, held)] AS value FROM c""")
def asof_context_12(spark: SparkSession, d: str) -> DataFrame:
    """Twelve values before each gap; short ones are filled by their last."""
    events = table(spark, d, "events")
    gaps = events.where("event_type = 'error'").select("user_id", F.col("ts").alias("gap_start"), F.col("event_id").alias("gap_id"))
    rows = joins.asof_context(events.where("event_type <> 'error'").select("user_id", "ts", "value"), gaps, "user_id")
    return rows.select("gap_id", F.posexplode("context").alias("place", "value")).withColumn("place", F.col("place").cast("long"))


@query(f"""WITH {PROJECTS_SQL}, e AS (SELECT clave AS src, 'muni_' || state || '_' || municipality AS dst FROM projects WHERE municipality IS NOT NULL), w AS (SELECT DISTINCT clave AS id FROM projects WHERE o_orderkey % 2 = 0),
a AS (SELECT id FROM w WHERE id NOT IN (SELECT src FROM e))
SELECT DISTINCT id, 'out' AS way, 'UBICADO_EN' AS relation, dst AS other FROM w JOIN e ON id = src UNION ALL SELECT id, 'key', 'UBICADO_EN', {_case("substr(id, 3, 2)", STATES)} FROM a UNION ALL SELECT id, 'key', 'ES_TIPO', {_case("substr(id, 9, 1)", TYPES)} FROM a
UNION ALL SELECT id, 'key', 'DEL_SECTOR', 'Sector ' || substr(id, 1, 2) FROM a UNION ALL SELECT id, 'key', 'DEL_AÑO', substr(id, 5, 4) FROM a""")
def one_hop_or_key(spark: SparkSession, d: str) -> DataFrame:
    rows = projects(spark, d)
    edges = rows.where("municipality IS NOT NULL").select(F.col("clave").alias("src"), F.concat(F.lit("muni_"), "state", F.lit("_"), "municipality").alias("dst"), F.lit("UBICADO_EN").alias("relation"))
    return graph.one_hop_or_key(edges, rows.where("o_orderkey % 2 = 0").select(F.col("clave").alias("id")))
