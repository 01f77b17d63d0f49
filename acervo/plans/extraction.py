"""Queries of extraction, derived values, numbered pages and the project graph in first-seen order."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from acervo.functions.derived import cylindrical_loss, expected_similarity, natural_id
from acervo.functions.lookups import STATES, TYPES
from acervo.operators import extraction, graph, keys, numbering
from acervo.plans.bindings import PROJECTS_SQL, projects, table
from acervo.plans.registry import _EDGES, _case, query

_NOTICE = r"""'x' || chr(10) || CASE o_orderkey % 5
    WHEN 0 THEN '| ' || o_orderkey::VARCHAR || ' | ' || lower(clave) || ' | ' || replace(sponsor, '#', ' ') || ' | Obra larga ' || project_name || ' |'
    WHEN 1 THEN 'Clave ' || clave || chr(10) || '**Proyecto:** ' || project_name || chr(10) || 'Municipio : "' || replace(sponsor, '#', ' ') || '"' || chr(10) || 'Empresa: ' || replace(sponsor, '#', ' ') || ' S.A. de C.V.'
    WHEN 2 THEN clave || chr(10) || 'a' || chr(10) || 'b' || chr(10) || 'Nombre: no' || chr(10) || 'Proyecto: ' || project_name
    WHEN 3 THEN 'Proyecto: ' || project_name
    ELSE 'Responsable: ' || replace(sponsor, '#', ' ') || chr(10) || chr(10) || 'El proyecto ' || clave || ' de la empresa: ' || replace(sponsor, '#', ' ') || ' S.A. y otros' END"""


def _notices(spark: SparkSession, d: str) -> DataFrame:
    """A notice of each project: a table row, labels, labels too far off, no key, or prose with a company."""
    notice = _NOTICE.replace("::VARCHAR", "")
    return projects(spark, d).select("o_orderkey", "clave", "state", "sponsor", F.expr(notice).alias("notice"))


@query(f"""WITH {PROJECTS_SQL} SELECT o_orderkey,
  CASE o_orderkey % 5 WHEN 0 THEN 'Obra larga ' || project_name WHEN 1 THEN project_name END AS name,
  CASE WHEN o_orderkey % 5 < 2 THEN replace(sponsor, '#', ' ') END AS place,
  CASE o_orderkey % 5 WHEN 1 THEN replace(sponsor, '#', ' ') || ' S.A. de C.V.' WHEN 4 THEN replace(sponsor, '#', ' ') END AS sponsor FROM projects""")
def key_contexts(spark: SparkSession, d: str) -> DataFrame:
    rows = _notices(spark, d).select("o_orderkey", extraction.key_context(F.col("notice"), F.col("clave")).alias("c"))
    return rows.select("o_orderkey", "c.name", "c.place", "c.sponsor")


_TEXT_GRAPH = f"""{PROJECTS_SQL}, t AS (SELECT *, substr(clave, 3, 2) AS code, {_NOTICE} AS notice FROM projects),
f AS (SELECT code, CASE WHEN o_orderkey % 5 NOT IN (0, 3) THEN clave END AS k, nullif(trim(regexp_extract(notice, '([A-Z][A-Za-z0-9\\s,.]+ S\\.A\\.(?: de C\\.V\\.)?)', 1)), '') AS company FROM t),
g AS (SELECT *, replace(replace(upper(company), ' ', '_'), '.', '') AS c FROM f)"""


@query(f"""WITH {_TEXT_GRAPH}, n AS (SELECT k AS id, 'proyecto' AS type, 'Proyecto ' || k AS label FROM g WHERE k IS NOT NULL
  UNION ALL SELECT 'ESTADO_' || code, 'estado', {_case("code", STATES)} FROM g WHERE k IS NOT NULL UNION ALL SELECT c, 'promovente', company FROM g WHERE c IS NOT NULL)
SELECT id, type, min(label) AS label, count(*) AS n FROM n GROUP BY 1, 2""")
def text_graph_nodes(spark: SparkSession, d: str) -> DataFrame:
    return extraction.text_graph_nodes(extraction.text_graph(_notices(spark, d), "o_orderkey", "notice"))


@query(f"""WITH {_TEXT_GRAPH}, e AS (SELECT k AS src, 'ESTADO_' || code AS dst, 'UBICADO_EN' AS relation FROM g WHERE k IS NOT NULL
  UNION ALL SELECT k, c, 'PRESENTADO_POR' FROM g WHERE k IS NOT NULL AND c IS NOT NULL)
SELECT src, dst, relation, round(1.0::DOUBLE + 0.1::DOUBLE * (count(*) - 1), 4)::DOUBLE AS weight FROM e GROUP BY ALL""")
def text_graph_edges(spark: SparkSession, d: str) -> DataFrame:
    return extraction.text_graph_edges(extraction.text_graph(_notices(spark, d), "o_orderkey", "notice"))


_DAMAGED = "CASE o_orderkey % 4 WHEN 0 THEN lower(clave) || replace(clave, '0', 'O') WHEN 1 THEN 'clave:' || replace(clave, '1', 'l') || '.' || replace(clave, '2', 'z') WHEN 2 THEN 'x' || clave || ' ' || clave || 'x' ELSE 'ABCDEFGHIJKLM' || replace(clave, '5', 'S') END"
_MASK = "translate(substr({0},1,2),'OILSZ','01152') || translate(substr({0},3,2),'015','OIS') || translate(substr({0},5,4),'OILSZ','01152') || translate(substr({0},9,1),'015','OIS') || translate(substr({0},10,4),'OILSZ','01152')"


@query(f"""WITH {PROJECTS_SQL}, r AS (SELECT o_orderkey, regexp_extract_all({_DAMAGED}, '[a-zA-Z0-9]{{13}}') AS l FROM projects),
h AS (SELECT o_orderkey, [y FOR y IN [{_MASK.format("upper(x)")} FOR x IN l] IF regexp_full_match(y, '[0-9]{{2}}[A-Z]{{2}}[0-9]{{4}}[A-Z][0-9]{{4}}')] AS k FROM r)
SELECT o_orderkey, unnest(range(len(k)))::INT AS place, unnest(k) AS healed FROM h""")
def healed_in_text(spark: SparkSession, d: str) -> DataFrame:
    rows = projects(spark, d).select("o_orderkey", F.expr(_DAMAGED).alias("raw"))
    return rows.select("o_orderkey", F.posexplode(extraction.healed_keys(F.col("raw"))).alias("place", "healed"))


_LINKS = """'<p><a class="pdf" href="../archivos/G' || page_id || '_2024.pdf"> Gaceta <b>de</b> 2023</a><div class=x data-href="/docs/./a/../' || page_id || '.PDF?a=1&amp;b=2">Anexo</div><a href=''//files.example.org/gaceta/' || page_id || '-2018.pdf/''>sin fecha</a><a href="?gaceta=' || page_id || '.pdf">consulta</a><a href="/otros/x.pdf">no</a><a name=y>no</a>'"""


@query(r"""WITH p AS (SELECT page_id::VARCHAR AS id, page_id, regexp_extract(url, '^[a-zA-Z]+:', 0) AS s, regexp_extract(url, '^[a-zA-Z]+://[^/?#]*', 0) AS host, regexp_extract(url, '^[a-zA-Z]+://[^/?#]*([^?#]*)', 1) AS path FROM pages),
b AS (SELECT *, regexp_replace(regexp_replace(path, '[^/]*$', ''), '[^/]+/$', '') AS up FROM p)
SELECT page_id, 0 AS place, 'href' AS attribute, host || up || 'archivos/G' || id || '_2024.pdf' AS url, 'G' || id || '_2024.pdf' AS filename, 'Gacetade2023' AS label, 2023 AS year FROM b
UNION ALL SELECT page_id, 1, 'href', s || '//files.example.org/gaceta/' || id || '-2018.pdf/', id || '-2018.pdf', 'sin fecha', regexp_extract(id || '-2018', '20[0-9][0-9]')::INT FROM b
UNION ALL SELECT page_id, 2, 'href', host || path || '?gaceta=' || id || '.pdf', '?gaceta=' || id || '.pdf', 'consulta', CASE WHEN regexp_matches(id, '20[0-9][0-9]') THEN regexp_extract(id, '20[0-9][0-9]')::INT END FROM b
UNION ALL SELECT page_id, 3, 'data-href', host || '/docs/' || id || '.PDF?a=1&b=2', id || '.PDF?a=1&b=2', 'Anexo', CASE WHEN regexp_matches(id, '20[0-9][0-9]') THEN regexp_extract(id, '20[0-9][0-9]')::INT END FROM b""")
def gazette_links(spark: SparkSession, d: str) -> DataFrame:
    pages = table(spark, d, "pages").select("page_id", "url", F.concat("html", F.expr(_LINKS.replace("''", "\\'"))).alias("html"))
    return extraction.file_links(pages, "page_id", "html", "url")


@query("SELECT event_id, round(CASE WHEN value - 50 > 0 THEN 10 * log10((value - 50) * 100) + 0.0015::DOUBLE * ((value - 50) * 100) ELSE 0 END, 6)::DOUBLE AS loss, round(1 / (1 + CASE WHEN value - 50 > 0 THEN 10 * log10((value - 50) * 100) + 0.0015::DOUBLE * ((value - 50) * 100) ELSE 0 END / 10), 6)::DOUBLE AS similarity FROM events")
def acoustic_similarity(spark: SparkSession, d: str) -> DataFrame:
    metres = (F.col("value") - 50) * 100
    return table(spark, d, "events").select("event_id", F.round(cylindrical_loss(metres), 6).alias("loss"), F.round(expected_similarity(metres), 6).alias("similarity"))


@query("SELECT l_orderkey, l_linenumber, sha256(length(l_orderkey::VARCHAR) || ':' || l_orderkey || ',' || length(l_linenumber::VARCHAR) || ':' || l_linenumber || ',' || CASE WHEN l_returnflag = 'R' THEN '-' ELSE '1:' || l_returnflag END) AS id FROM lineitem")
def natural_ids(spark: SparkSession, d: str) -> DataFrame:
    flag = F.when(F.col("l_returnflag") != "R", F.col("l_returnflag"))
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", natural_id(F.col("l_orderkey"), F.col("l_linenumber"), flag).alias("id"))


@query(f"""WITH {PROJECTS_SQL}, k AS (SELECT DISTINCT clave, unnest(['state', 'sector', 'type']) AS kind, unnest([substr(clave, 3, 2), substr(clave, 1, 2), substr(clave, 9, 1)]) AS code FROM projects),
n AS (SELECT *, row_number() OVER (PARTITION BY kind, code ORDER BY clave) - 1 AS place FROM k) SELECT kind, code, place // 100 AS page, place, clave FROM n""")
def collector_pages(spark: SparkSession, d: str) -> DataFrame:
    rows = keys.parse_key(projects(spark, d).select("clave"), "clave").where("valid")
    return numbering.collector_pages(rows, "clave", {"state": "state", "sector": "sector", "type": "kind"}, 100)


def _graph(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    rows = keys.parse_key(projects(spark, d).select("o_orderkey", "clave", "municipality", "sponsor", "project_name", F.when(F.col("o_orderkey") % 2 == 0, "FAVORABLE").alias("verdict")), "clave").where("valid")
    return graph.encode(graph.project_nodes(rows, "o_orderkey"), graph.project_edges(rows, ("o_orderkey",)), "o_orderkey")


_NODES = f"""{_EDGES}, raw AS (
  SELECT clave AS id, 'proyecto' AS type, clave AS label, '#FFB000' AS color, substr(clave, 5, 4)::INT AS year, 0 AS community, project_name, CASE WHEN o_orderkey % 2 = 0 THEN 'FAVORABLE' END AS verdict, o_orderkey AS o, 0 AS p FROM projects
  UNION ALL SELECT 'state_' || substr(clave, 3, 2), 'estado', {_case("substr(clave, 3, 2)", STATES)}, '#27AE60', NULL, 1, NULL, NULL, o_orderkey, 1 FROM projects
  UNION ALL SELECT 'muni_' || substr(clave, 3, 2) || '_' || upper(municipality), 'municipio', municipality, '#5DADE2', NULL, 6, NULL, NULL, o_orderkey, 2 FROM projects WHERE municipality IS NOT NULL
  UNION ALL SELECT 'prom_' || upper(sponsor), 'promovente', sponsor, '#E84393', NULL, 5, NULL, NULL, o_orderkey, 3 FROM projects
  UNION ALL SELECT 'type_' || substr(clave, 9, 1), 'tipo_mia', {_case("substr(clave, 9, 1)", TYPES)}, '#9B59B6', NULL, 2, NULL, NULL, o_orderkey, 4 FROM projects
  UNION ALL SELECT 'year_' || substr(clave, 5, 4), 'año', substr(clave, 5, 4), '#3498DB', NULL, 3, NULL, NULL, o_orderkey, 5 FROM projects
  UNION ALL SELECT 'sector_' || substr(clave, 1, 2), 'sector', 'Sector ' || substr(clave, 1, 2), '#E67E22', NULL, 4, NULL, NULL, o_orderkey, 6 FROM projects),
first AS (SELECT * FROM raw QUALIFY row_number() OVER (PARTITION BY id ORDER BY o, p) = 1),
nodes AS (SELECT *, row_number() OVER (ORDER BY o, p) - 1 AS index FROM first)"""


@query(f"""WITH {_NODES}, deg AS (SELECT node, count(*) AS degree FROM (SELECT src AS node FROM edges UNION ALL SELECT dst FROM edges) GROUP BY 1)
SELECT index, id, type, label, color, year, degree, community, project_name, verdict FROM nodes JOIN deg ON node = id""")
def graph_nodes(spark: SparkSession, d: str) -> DataFrame:
    return _graph(spark, d)[0]


@query(f"""WITH {_NODES}, kinds AS (SELECT unnest(['UBICADO_EN', 'PERTENECE_A', 'PROMOVIDO_POR', 'ES_TIPO', 'DEL_AÑO', 'DEL_SECTOR']) AS relation),
seen AS (SELECT relation, min(e) AS e FROM (SELECT 'PERTENECE_A' AS relation, o_orderkey * 10 + 1 AS e FROM projects WHERE municipality IS NOT NULL UNION ALL SELECT relation, o_orderkey * 10 + CASE relation WHEN 'UBICADO_EN' THEN 0 WHEN 'PROMOVIDO_POR' THEN 2 WHEN 'ES_TIPO' THEN 3 WHEN 'DEL_AÑO' THEN 4 ELSE 5 END FROM projects, kinds WHERE relation <> 'PERTENECE_A') GROUP BY 1),
numbers AS (SELECT relation, row_number() OVER (ORDER BY e) - 1 AS i FROM seen)
SELECT a.index AS src_index, b.index AS dst_index, n.i AS relation_index FROM edges e JOIN nodes a ON a.id = e.src JOIN nodes b ON b.id = e.dst JOIN numbers n ON n.relation = e.relation""")
def graph_links(spark: SparkSession, d: str) -> DataFrame:
    return _graph(spark, d)[1]
