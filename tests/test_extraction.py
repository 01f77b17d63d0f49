import random
from urllib.parse import urljoin

import pytest
from pyspark.sql import functions as F

from acervo.functions.derived import cylindrical_loss, expected_similarity, natural_id
from acervo.operators import extraction, graph, numbering
from acervo.plans import extraction as _  # noqa: F401
from acervo.plans import registry
from tests.test_core import SF, duck, rows  # noqa: F401

KEY = "21PU2025H0155"


@pytest.mark.parametrize("name", ["key_contexts", "text_graph_nodes", "text_graph_edges", "healed_in_text", "gazette_links", "natural_ids", "collector_pages", "graph_nodes", "graph_links"])
def test_matches_sql(spark, duck, name):  # noqa: F811
    got, found = registry.QUERIES[name](spark, SF), duck.execute(registry.ORACLE_SQL[name])
    columns = [d[0] for d in found.description]
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    assert rows(got) == sorted(str(tuple(r[i] for i in order)) for r in found.fetchall())


@pytest.mark.parametrize(
    "text, want",
    [
        (f"| 12 | {KEY} | Planta de gas | Puebla |", ("Planta de gas", "Puebla", None)),
        (f"Gas del Norte|{KEY.lower()}|Gas del Este|123456", ("Gas del Norte", "Gas del Este", None)),
        (f"| {KEY} | 12 | ab |", (None, None, None)),
        (f"| Obra en {KEY} grande | {KEY} | Sur |", (KEY, None, None)),
        (f"Ubicación:\n  Atlixco\n{KEY}\nPROYECTO : **\"Dos\" presas**\nempresa: (Agua SA)", ('Dos" presas', "Atlixco", "Agua SA")),
        (f"nombre: uno\nDenominación is la presa\n{KEY}", ("la presa", None, None)),
        (f"proyecto is la presa\n{KEY}", ("la presa", None, None)),
        (f"proyecto: lejos\na\nb\nc\n{KEY}\na\nb\nc\nestado: Puebla", (None, None, None)),
        (f"proyecto: {'x' * 300} {KEY}", ("x" * 197 + "...", None, None)),
        (f"{KEY}\nproyecto: uno dos\n{KEY} proyecto: tres", ("uno dos", None, None)),
        ("proyecto: sin clave", (None, None, None)),
        ("", (None, None, None)),
        (None, (None, None, None)),
    ],
)
def test_key_context(spark, text, want):
    assert tuple(spark.createDataFrame([(text,)], "t string").select(extraction.key_context(F.col("t"), F.lit(KEY)).alias("c")).first().c) == want


def test_healed_keys(spark):
    texts = ["", None, "O2BC2024E0044", "a" * 12, "ab" + KEY, KEY + KEY.lower() + ".08CH2O26H0134", "x" * 200_000 + " " + KEY]
    got = [list(r.k) for r in spark.createDataFrame(list(enumerate(texts)), "i int, t string").orderBy("i").select(extraction.healed_keys(F.col("t")).alias("k")).collect()]
    assert got == [[], [], ["02BC2024E0044"], [], [], [KEY, KEY, "08CH2026H0134"], [KEY]]


def test_urls_resolve_as_the_standard_says(spark):
    bases = ["http://a/b/c/d;p?q", "http://a", "https://a.b:80/x/y/?k=/v#f", "http://a/../x"]
    refs = ["g:h", "g", "./g", "g/", "/g", "?y", "g?y", "#s", "g#s", "g?y#s", ";x", "g;x", "g;x?y#s", "", ".", "./", "..", "../", "../g", "../..", "../../", "../../g", "../../../g", "../../../../g", "/./g", "/../g", "g.", ".g", "g..", "..g", "./../g", "./g/.", "g/./h", "g/../h", "g;x=1/./y", "g;x=1/../y", "g?y/./x", "g?y/../x", "g#s/../x", "//h/p", "á b.pdf", " g "]
    data = spark.createDataFrame([(b, r) for b in bases for r in refs], "b string, r string")
    got = {(x.b, x.r): x.u for x in data.select("b", "r", extraction.resolve_url(F.col("b"), F.col("r")).alias("u")).collect()}
    assert got == {(b, r): urljoin(b, r.strip()) if r else b.split("#")[0] for b in bases for r in refs}
    assert spark.createDataFrame([(None, "g"), ("http://a/", None)], "b string, r string").select(extraction.resolve_url(F.col("b"), F.col("r")).alias("u")).dropna().isEmpty()


def test_file_links(spark):
    html = """<DIV data-href='a.pdf'>Anexo 2020</DIV><A HREF=archivos/x.PDF>Uno<br>2021 </A><a href="gaceta.pdf" data-href="b.pdf">dos</a><a href="gaceta.doc">no</a><a href="x.pdf">no</a><a href="gaceta_2019.pdf"""
    pages = spark.createDataFrame([(1, html, "http://h/p/"), (2, None, "http://h/"), (3, "", None), (4, '<a href="gaceta.pdf">z', None)], "id long, html string, url string")
    got = [tuple(r) for r in extraction.file_links(pages, "id", "html", "url").orderBy("id", "place").collect()]
    assert got == [
        (1, 0, "href", "http://h/p/archivos/x.PDF", "x.PDF", "Uno2021", 2021), (1, 1, "href", "http://h/p/gaceta.pdf", "gaceta.pdf", "dos", None),
        (1, 2, "data-href", "http://h/p/a.pdf", "a.pdf", "Anexo 2020", 2020), (1, 3, "data-href", "http://h/p/b.pdf", "b.pdf", "dos", None), (4, 0, "href", None, "gaceta.pdf", "z", None),
    ]
    assert [r.label for r in extraction.file_links(pages, "id", "html", "url", (), 2021).collect()] == ["Uno2021"]


def test_text_graph(spark):
    texts = [f"La obra {KEY} de Gas, Luz y Sol S.A. de C.V. y 09XX2025H0001", "Alfa S.A. con Beta S.A.", "99QQ2025H0001", None, "", "S.A. " * 20_000 + "A" * 50_000]
    found = extraction.text_graph(spark.createDataFrame(list(enumerate(texts)), "i int, t string"), "i", "t").orderBy("i").collect()
    name = "PU2025H0155 de Gas, Luz y Sol"  # the name takes in what stands before it, back to a capital
    assert [n.type for n in found[0].nodes] == ["proyecto", "estado", "promovente"] and name in found[0].nodes[2].label
    assert [(r.src, r.relation) for r in found[0].relations] == [(KEY, "UBICADO_EN"), (KEY, "PRESENTADO_POR")]
    assert [n.id for n in found[1].nodes] == ["ALFA_SA_CON_BETA"] or [n.id for n in found[1].nodes] == ["ALFA_SA_CON_BETA_SA"]
    assert [n.id for n in found[2].nodes] == ["99QQ2025H0001"] and not found[2].relations
    assert [len(r.nodes) for r in found[3:5]] == [0, 0] and len(found[5].nodes) == 1


def test_derived_values(spark):
    got = spark.createDataFrame([(-1.0,), (0.0,), (1.0,), (1000.0,), (None,)], "r double").select(cylindrical_loss(F.col("r")), expected_similarity(F.col("r"))).collect()
    assert [None if r[0] is None else (round(r[0], 6), round(r[1], 6)) for r in got] == [(0, 1), (0, 1), (0.0015, 0.99985), (31.5, 0.240964), None]
    pairs = [("a", "b"), ("a,1:b", None), (None, "a"), ("", "a"), ("a", None), (None, None)]
    ids = [r[0] for r in spark.createDataFrame(pairs, "a string, b string").select(natural_id(F.col("a"), F.col("b"))).collect()]
    assert len(set(ids)) == len(pairs)


def test_numbers_without_one_task_for_a_group(spark):
    r = random.Random(5)
    data = [(None if k % 7 == 0 else "hot" if k % 3 else f"g{k % 5}", r.randint(0, 50) if k % 11 else None, k) for k in range(2000)]
    frame = spark.createDataFrame(data, "g string, x int, k int").repartition(5)
    for groups in ((), ("g",)):
        got = {x.k: x.place for x in numbering.numbered(frame, ["x", "k"], "place", groups).collect()}
        want = {}
        for group in {d[0] if groups else 0 for d in data}:
            own = sorted((d for d in data if not groups or d[0] == group), key=lambda d: (d[1] is not None, d[1] or 0, d[2]))
            want |= {d[2]: i for i, d in enumerate(own)}
        assert got == want
    assert numbering.numbered(frame.limit(0), ["x"], "place", ("g",)).collect() == []


def test_graph_in_first_seen_order(spark):
    columns = "o long, clave string, state string, state_name string, municipality string, sponsor string, kind string, kind_name string, key_year int, sector string, project_name string, verdict string"
    data = [(2, "21PU2025H0002", "PU", "Puebla", "puebla", None, "H", None, 2025, "21", None, None), (1, KEY, "PU", "Puebla", "Puebla", "Bosques SA", "H", "MIA Particular", 2025, "21", "Proyecto Bosques", "FAVORABLE"), (3, "09DF2024G0001", "DF", None, " ", "BOSQUES SA", "G", None, 2024, "09", None, None)]
    projects = spark.createDataFrame(data, columns)
    nodes, links, kinds = graph.encode(graph.project_nodes(projects, "o"), graph.project_edges(projects, ("o",)), "o")
    by = {n["index"]: n for n in nodes.collect()}
    assert [by[i].id for i in range(len(by))] == [KEY, "state_PU", "muni_PU_PUEBLA", "prom_BOSQUES SA", "type_H", "year_2025", "sector_21", "21PU2025H0002", "09DF2024G0001", "state_DF", "type_G", "year_2024", "sector_09"]
    assert (by[0].project_name, by[0].verdict, by[0].color, by[0].degree, by[7].project_name, by[3].label) == ("Proyecto Bosques", "FAVORABLE", "#FFB000", 5, "Proyecto 21PU2025H0002", "Bosques SA")
    names = {k.relation_index: k.relation for k in kinds.collect()}
    assert names == dict(enumerate(["UBICADO_EN", "PERTENECE_A", "PROMOVIDO_POR", "ES_TIPO", "DEL_AÑO", "DEL_SECTOR"]))
    got = sorted((by[x.src_index].id, by[x.dst_index].id, names[x.relation_index]) for x in links.collect())
    assert got == sorted((e.src, e.dst, e.relation) for e in graph.project_edges(projects).collect())
