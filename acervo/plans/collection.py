"""Queries over the collection's files, notes and histories, beside their DuckDB SQL; they join the registry's."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from acervo.functions.lookups import is_mock_key
from acervo.operators import files, graph, notes
from acervo.operators.keys import keep_one
from acervo.plans.bindings import EVALUATIONS_SQL, PROJECTS_SQL, evaluations, projects, table
from acervo.plans.registry import query

NAME_RULE = "CASE o_orderkey % 6 WHEN 0 THEN concat(clave, '.estudio.', o_orderkey % 4, '.pdf') WHEN 1 THEN concat(clave, '.resumen.2.pdf') WHEN 2 THEN concat('ASEA_GACETA_0', o_orderkey % 9, '-2023.pdf') WHEN 3 THEN concat('gaceta_', o_orderkey % 90, '-24.pdf') WHEN 4 THEN concat(clave, '.resolutivo.x.pdf') ELSE concat('nota', o_orderkey, '.pdf') END"
NAMES_SQL = f"{PROJECTS_SQL}, names AS (SELECT o_orderkey, o_orderdate, clave, {NAME_RULE} AS name FROM projects)"


def names(spark: SparkSession, d: str) -> DataFrame:
    """projects as files (o_orderkey, o_orderdate, clave, name)."""
    return projects(spark, d).select("o_orderkey", "o_orderdate", "clave", F.expr(NAME_RULE).alias("name"))


@query(f"""WITH {NAMES_SQL} SELECT o_orderkey, CASE WHEN contains(lower(name), 'asea') THEN 'ASEA' ELSE 'SEMARNAT' END AS source, contains(lower(name), 'gaceta') OR name LIKE 'ASEA\\_%' ESCAPE '\\' AS gazette,
CASE WHEN regexp_matches(lower(name), 'estudio|mia') THEN 'estudio' WHEN contains(lower(name), 'resumen') THEN 'resumen' WHEN regexp_matches(lower(name), 'resolutivo|resolucion') THEN 'resolutivo' WHEN contains(lower(name), 'gaceta') THEN 'gaceta' ELSE 'desconocido' END AS category FROM names""")
def classified_files(spark: SparkSession, d: str) -> DataFrame:
    name = F.col("name")
    return names(spark, d).select("o_orderkey", files.source_tag(name).alias("source"), files.is_gazette(name).alias("gazette"), files.category(name).alias("category"))


@query(rf"""WITH {NAMES_SQL} SELECT o_orderkey, coalesce(nullif(regexp_extract(name, '20\d{{2}}'), '')::INT, nullif(regexp_extract(lower(name), '-(\d{{2}})\.pdf$', 1), '')::INT + 2000) AS year FROM names""")
def year_from_name(spark: SparkSession, d: str) -> DataFrame:
    return names(spark, d).select("o_orderkey", files.year_from_name(F.col("name")).alias("year"))


@query(f"WITH {NAMES_SQL} SELECT o_orderkey, nullif(split_part(name, '.', 2), '') AS kind, CASE WHEN len(string_split(name, '.')) > 3 THEN try_cast(split_part(name, '.', 3) AS INT) END AS version FROM names")
def type_and_version(spark: SparkSession, d: str) -> DataFrame:
    kind, version = files.type_and_version(F.col("name"))
    return names(spark, d).select("o_orderkey", kind.alias("kind"), version.alias("version"))


@query("""SELECT owner, event_id, kind, version FROM (SELECT *, row_number() OVER (PARTITION BY owner ORDER BY CASE kind WHEN 'estudio' THEN 1 WHEN 'resumen' THEN 2 WHEN 'resolutivo' THEN 3 ELSE 4 END, version DESC, event_id DESC) AS n
FROM (SELECT user_id % 400 AS owner, event_id, CASE event_type WHEN 'click' THEN 'estudio' WHEN 'view' THEN 'resumen' WHEN 'error' THEN 'resolutivo' ELSE 'otro' END AS kind, (event_id % 7)::INT AS version FROM events WHERE user_id % 3 <> 0 OR event_type <> 'click')) WHERE n = 1""")
def best_extraction(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "events").where("user_id % 3 <> 0 OR event_type <> 'click'")
    kind = F.when(F.col("event_type") == "click", "estudio").when(F.col("event_type") == "view", "resumen").when(F.col("event_type") == "error", "resolutivo").otherwise("otro")
    # event_id stands first in the row, so it settles ties.
    return files.best_extraction(rows.select("event_id", (F.col("user_id") % 400).alias("owner"), kind.alias("kind"), (F.col("event_id") % 7).cast("int").alias("version")), "owner")


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 9 = 0 THEN 'estudio' WHEN n = 1 THEN 'estudio' WHEN n = 2 THEN ['resumen', 'resolutivo'][i] WHEN n = 3 THEN ['resumen', 'estudio', 'resolutivo'][i] ELSE 'resumen' END AS kind
FROM (SELECT *, count(*) OVER (PARTITION BY o_custkey, o_orderstatus) AS n, row_number() OVER (PARTITION BY o_custkey, o_orderstatus ORDER BY o_orderdate, o_orderkey) AS i FROM orders)""")
def positional_type(spark: SparkSession, d: str) -> DataFrame:
    batch = table(spark, d, "orders").withColumn("name", F.when(F.col("o_orderkey") % 9 == 0, "Estudio.pdf").otherwise("a.pdf")).withColumn("batch", F.concat_ws("/", "o_custkey", "o_orderstatus"))
    return files.positional_type(batch, "batch", ["o_orderdate", "o_orderkey"]).select("o_orderkey", "kind")


@query("""SELECT name, digest, first, CASE WHEN n = 1 THEN name ELSE replace(name, '.txt', '_v' || n || '.txt') END AS stored_name
FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY first, digest) AS n FROM (SELECT 'doc' || (doc_id % 1000) || '.txt' AS name, sha256(text) AS digest, min(doc_id) AS first FROM documents GROUP BY 1, 2))""")
def version_suffix(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", F.concat(F.lit("doc"), (F.col("doc_id") % 1000).cast("string"), F.lit(".txt")).alias("name"), F.sha2("text", 256).alias("digest"))
    return files.version_suffix(docs, "name", "digest", "doc_id")


@query("SELECT user_id, event_type, event_id, place FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS place FROM events WHERE event_type IN ('error', 'purchase')) WHERE place <= 5")
def last_events(spark: SparkSession, d: str) -> DataFrame:
    return files.last_events(table(spark, d, "events"), ["user_id", "event_type"], "event_type", ("error", "purchase"), [F.desc("ts"), F.desc("event_id")], 5).select("user_id", "event_type", "event_id", "place")


_VERIFIED = """SELECT doc_id, CASE WHEN length(text) < 500 THEN 'EMPTY' WHEN doc_id % 11 = 0 THEN 'CORRUPT' WHEN doc_id % 13 = 0 THEN 'VERIFIED_NO_TEXT' WHEN NOT contains(upper(text), 'TION') THEN 'MISMATCH' ELSE 'VERIFIED' END AS status FROM documents"""


@query(_VERIFIED)
def verified_files(spark: SparkSession, d: str) -> DataFrame:
    head = F.when(F.col("doc_id") % 11 == 0, "<html").otherwise("%PDF-1.7")
    page = F.when(F.col("doc_id") % 13 != 0, F.col("text"))
    return table(spark, d, "documents").select("doc_id", files.verify(F.length("text"), head, page, F.lit("a.pdf"), F.lit("TION"), least=500).alias("status"))


@query(f"SELECT count(*) AS total, count(*) FILTER (status LIKE 'VERIFIED%') AS verified, count(*) FILTER (status IN ('CORRUPT', 'EMPTY', 'MISMATCH')) AS corrupt, round(100.0 * count(*) FILTER (status LIKE 'VERIFIED%') / count(*), 1)::DOUBLE AS pct FROM ({_VERIFIED})")
def manifest_health(spark: SparkSession, d: str) -> DataFrame:
    return files.manifest_health(verified_files(spark, d))


@query("""SELECT doc_id, CASE WHEN a IS NULL THEN 'new' WHEN b IS NULL THEN 'gone' WHEN a = b THEN 'same' ELSE 'changed' END AS state
FROM (SELECT doc_id, sha256(text) AS a FROM documents WHERE doc_id % 5 <> 0) FULL JOIN (SELECT doc_id, sha256(CASE WHEN doc_id % 3 = 0 THEN text || '!' ELSE text END) AS b FROM documents WHERE doc_id % 7 <> 0) USING (doc_id)""")
def index_changes(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    old = docs.where("doc_id % 5 <> 0").select("doc_id", F.sha2("text", 256).alias("sha"))
    new = docs.where("doc_id % 7 <> 0").select("doc_id", F.sha2(F.when(F.col("doc_id") % 3 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text")), 256).alias("sha"))
    return files.index_changes(old, new, "doc_id")


@query("""SELECT doc_id, concat_ws(',', CASE WHEN regexp_matches(text, '(?i)licen[sc]e') THEN 'licence' END, CASE WHEN regexp_matches(text, '(?i)token.*key') THEN 'secret' END) AS labels FROM documents""")
def knockouts(spark: SparkSession, d: str) -> DataFrame:
    rules = {"licence": r"(?i)licen[sc]e", "secret": r"(?i)token.*key"}
    return table(spark, d, "documents").select("doc_id", F.array_join(notes.knockouts(F.col("text"), rules), ",").alias("labels"))


@query("SELECT doc_id, CASE WHEN length(text) > 400 THEN substr(text, 1, 200) || chr(10) || chr(10) || '[...]' || chr(10) || chr(10) || right(text, 200) ELSE text END AS body, length(trim(text)) < 80 AS scanned FROM documents")
def middle_truncate(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", notes.middle_truncate(F.col("text"), 400).alias("body"), notes.is_scanned(F.col("text")).alias("scanned"))


@query("""SELECT DISTINCT page_id, regexp_extract(a, 'href="([^"]*)"', 1) AS href, trim(regexp_extract(a, '>([^<]*)$', 1)) AS label FROM (SELECT page_id, unnest(regexp_extract_all(html, '(<a\\s+href="[^"]*">[^<]*)</a>', 1)) AS a FROM pages)""")
def page_anchors(spark: SparkSession, d: str) -> DataFrame:
    return notes.anchors(table(spark, d, "pages"), "page_id", "html")


@query("SELECT event_id, CASE WHEN event_id % 4 <> 0 THEN (props->>'k')::BIGINT END AS k FROM events")
def repaired_json(spark: SparkSession, d: str) -> DataFrame:
    fenced = F.when(F.col("event_id") % 4 == 0, F.lit("no answer")).otherwise(F.concat(F.lit("```json\n"), "props", F.lit("\n```")))
    return table(spark, d, "events").select("event_id", notes.json_fields(fenced, "k long")["k"].alias("k"))


@query("""WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents) SELECT doc_id, i::BIGINT AS line_no, l[i + 1] AS line, len(l)::BIGINT AS total_lines, ceil(len(l) / 3)::BIGINT AS total_pages FROM (SELECT doc_id, l, unnest(range(3, least(6, len(l)))) AS i FROM l)""")
def page_lines(spark: SparkSession, d: str) -> DataFrame:
    return notes.page_lines(table(spark, d, "documents"), "doc_id", "text", page=2, size=3)


@query("SELECT doc_id, round(CASE WHEN quality IS NOT NULL THEN 0.7 * quality * 8 / 10 + 0.3 * s ELSE 0.5 * s END, 4)::DOUBLE AS blended FROM (SELECT doc_id, (doc_id % 97) / 97.0::DOUBLE AS s FROM documents) LEFT JOIN labels USING (doc_id)")
def blended_scores(spark: SparkSession, d: str) -> DataFrame:
    """Own scores are 97ths, so none stands exactly between two rounded values: there the two engines round doubles differently."""
    rows = table(spark, d, "documents").select("doc_id", ((F.col("doc_id") % 97) / 97.0).alias("score"))
    outside = table(spark, d, "labels").select("doc_id", (F.col("quality") * 8).alias("outside"))
    return notes.blend(rows, outside, "doc_id").select("doc_id", "blended")


@query(f"WITH {EVALUATIONS_SQL} SELECT o_orderkey, CASE veredicto WHEN 'NO_VIABLE' THEN 'ALTO' WHEN 'CONDICIONADO' THEN 'MEDIO' ELSE 'BAJO' END AS risk, confianza_pct / 100.0::DOUBLE AS confidence FROM evaluations")
def risk_level(spark: SparkSession, d: str) -> DataFrame:
    risk = F.when(F.col("veredicto") == "NO_VIABLE", "ALTO").when(F.col("veredicto") == "CONDICIONADO", "MEDIO").otherwise("BAJO")
    return evaluations(spark, d).select("o_orderkey", risk.alias("risk"), (F.col("confianza_pct") / 100.0).alias("confidence"))


@query(f"WITH {PROJECTS_SQL} SELECT count(*) AS total, count(*) FILTER (municipality IS NULL) AS incomplete, count(*) FILTER (clave LIKE '%9999') AS mock FROM projects")
def curation_health(spark: SparkSession, d: str) -> DataFrame:
    return projects(spark, d).agg(F.count("*").alias("total"), F.count_if(F.col("municipality").isNull()).alias("incomplete"), F.count_if(is_mock_key(F.col("clave"))).alias("mock"))


@query(" UNION ALL ".join(f"SELECT '{t}' AS name, count(*) AS n FROM {t}" for t in ("customer", "orders", "documents", "pages")))
def table_counts(spark: SparkSession, d: str) -> DataFrame:
    out = None
    for name in ("customer", "orders", "documents", "pages"):
        one = table(spark, d, name).agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n")
        out = one if out is None else out.unionByName(one)
    return out


@query(f"WITH {PROJECTS_SQL} SELECT o_orderkey, substr(clave, 3, 2) AS state, substr(clave, 5, 4)::INT AS year FROM projects")
def fixed_attributes(spark: SparkSession, d: str) -> DataFrame:
    """State and year, some missing or wrong, put right from the key."""
    k = F.col("o_orderkey")
    dirty = projects(spark, d).select("o_orderkey", "clave", F.when(k % 13 == 0, "Desconocido").otherwise(F.col("state")).alias("state"), F.when(k % 17 == 0, 1980).otherwise(F.col("year")).alias("year"))
    key_year = F.substring("clave", 5, 4).cast("int")
    return dirty.select("o_orderkey", F.when(F.col("state") == "Desconocido", F.substring("clave", 3, 2)).otherwise(F.col("state")).alias("state"), F.when(F.col("year") != key_year, key_year).otherwise(F.col("year")).alias("year"))


@query("SELECT user_id % 64 AS cell, count(DISTINCT user_id) AS vessels, count(*) FILTER (event_type = 'error') AS encounters, round(avg(value), 2)::DOUBLE AS mean_risk FROM events GROUP BY 1")
def cell_summary(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").groupBy((F.col("user_id") % 64).alias("cell")).agg(F.countDistinct("user_id").alias("vessels"), F.count_if(F.col("event_type") == "error").alias("encounters"), F.round(F.avg("value"), 2).alias("mean_risk"))


@query("SELECT event_id, coalesce(n, 0)::DOUBLE AS density FROM events LEFT JOIN (SELECT p_partkey % 64 AS cell, count(*) AS n FROM part WHERE p_size > 25 AND p_partkey % 64 < 40 GROUP BY 1) ON user_id % 64 = cell")
def cell_density(spark: SparkSession, d: str) -> DataFrame:
    cells = table(spark, d, "part").where("p_size > 25").groupBy((F.col("p_partkey") % 64).alias("cell")).agg(F.count("*").alias("n")).where("cell < 40")
    return table(spark, d, "events").select("event_id", (F.col("user_id") % 64).alias("cell")).join(cells, "cell", "left").select("event_id", F.coalesce(F.col("n").cast("double"), F.lit(0.0)).alias("density"))


@query("""WITH g AS (SELECT event_id, value, (epoch_us(ts) - lag(epoch_us(ts)) OVER w) / 3600000000 AS h, value - lag(value) OVER w AS dv FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
SELECT event_id, round(CASE WHEN h IS NULL THEN 2.0 ELSE greatest(0.1, h) END, 6)::DOUBLE AS hours, round(coalesce(abs(dv) * 111000, 500.0), 3)::DOUBLE AS metres FROM g""")
def gap_features(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    hours = F.greatest(F.lit(0.1), F.when(F.lag("event_id").over(w).isNotNull(), (at - F.lag(at).over(w)) / 3_600_000_000))
    first = F.lag("event_id").over(w).isNull()
    return table(spark, d, "events").select("event_id", F.round(F.when(first, 2.0).otherwise(hours), 6).alias("hours"), F.round(F.when(first, 500.0).otherwise(F.abs(F.col("value") - F.lag("value").over(w)) * 111000), 3).alias("metres"))


@query("SELECT DISTINCT o.o_custkey AS id, 'out' AS way, o.o_orderpriority AS other FROM orders o WHERE o.o_custkey % 50 = 7 UNION SELECT o.o_custkey, 'in', o.o_orderstatus FROM orders o WHERE o.o_custkey % 50 = 7")
def one_hop(spark: SparkSession, d: str) -> DataFrame:
    orders = table(spark, d, "orders")
    out = orders.select(F.col("o_custkey").cast("string").alias("src"), F.col("o_orderpriority").alias("dst"), F.lit("a").alias("relation"))
    into = orders.select(F.col("o_orderstatus").alias("src"), F.col("o_custkey").cast("string").alias("dst"), F.lit("b").alias("relation"))
    wanted = table(spark, d, "customer").where("c_custkey % 50 = 7").select(F.col("c_custkey").cast("string").alias("id"))
    return graph.one_hop(out.unionByName(into), wanted).select(F.col("id").cast("long").alias("id"), "way", "other")


@query(f"WITH {PROJECTS_SQL} SELECT clave, o_orderkey FROM (SELECT clave, o_orderkey, row_number() OVER (PARTITION BY clave ORDER BY o_totalprice DESC, o_orderkey) AS n FROM projects WHERE NOT clave LIKE '%9999') WHERE n = 1")
def largest_file(spark: SparkSession, d: str) -> DataFrame:
    """The largest file of each real key."""
    rows = projects(spark, d).where(~is_mock_key(F.col("clave")))
    return keep_one(rows, ["clave"], [F.desc("o_totalprice"), F.asc("o_orderkey")]).select("clave", "o_orderkey")


@query("SELECT vec_id, a, b FROM (SELECT vec_id, embedding[1]::DOUBLE AS a, embedding[2]::DOUBLE AS b FROM embeddings) WHERE a > -0.1 AND a < 0.1 AND b > -0.1 AND b < 0.1")
def bbox_filter(spark: SparkSession, d: str) -> DataFrame:
    """Points strictly inside a box."""
    points = table(spark, d, "embeddings").select("vec_id", F.col("embedding")[0].cast("double").alias("a"), F.col("embedding")[1].cast("double").alias("b"))
    return points.where("a > -0.1D AND a < 0.1D AND b > -0.1D AND b < 0.1D")
