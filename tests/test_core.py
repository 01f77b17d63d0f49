import datetime as dt

import duckdb
import pytest

from acervo.functions.lookups import heal_key
from acervo.operators import files, joins, keys, notes, quality, sequences, text, upsert
from acervo.operators import graph, records
from acervo.plans import collection, registry, vault  # noqa: F401
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"


def rows(frame):
    columns = sorted(frame.columns)
    return sorted(str(tuple(r[c] for c in columns)) for r in frame.collect())


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in "region nation supplier customer orders lineitem events documents embeddings labels part pages".split():
        con.execute(f"create view {name} as select * from '{SF}/{name}.parquet'")
    return con


@pytest.mark.parametrize("name", ["keys_by_state_year", "audit_alerts", "audited_evaluations", "status_matrix", "pending_keys", "asof_last_12", "sliding_windows", "chunk_words", "bm25_idf", "compact_graph", "merged_graph"])
def test_matches_sql(spark, duck, name):
    got = registry.QUERIES[name](spark, SF)
    found = duck.execute(registry.ORACLE_SQL[name])
    columns = [d[0] for d in found.description]
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    want = sorted(str(tuple(r[i] for i in order)) for r in found.fetchall())
    assert sorted(got.columns) == sorted(columns)
    assert rows(got) == want


def test_heal_key(spark):
    raw = ["12GE2026I0021", "02BC2026I0026", "O2BC2024E0044", "08CH2O26H0134", "Clave_Basura", None]
    got = spark.createDataFrame([(x,) for x in raw], "raw string").select(heal_key(F.col("raw"))).collect()
    assert [r[0] for r in got] == ["12GE2026I0021", "02BC2026I0026", "02BC2024E0044", "08CH2026H0134", None, None]


def test_parse_key(spark):
    row = keys.parse_key(spark.createDataFrame([("21PU2025H0155.pdf",)], "name string"), "name").first()
    assert (row.valid, row.state_name, row.key_year, row.kind_name) == (True, "Puebla", 2025, "MIA Particular")


def test_audit_keeps_the_good_row(spark):
    data = [
        ("09PU2026I0001", "Good", "resuelto", "PU", 2026, ["estudio.pdf"]),
        ("BAD", "x", "resuelto", "PU", 2026, []),
        ("09PU1980I0001", "x", "resuelto", "PU", 1980, []),
        ("09PU2026I0002", "x", "resuelto", "PU", 2024, []),
        ("09PU2026I0003", "x", "resuelto", "??", 2026, []),
        ("09PU2026I0004", "x", " ", "PU", 2026, []),
    ]
    out = quality.audit_projects(spark.createDataFrame(data, "clave string, project_name string, status string, state string, year int, files_downloaded array<string>"), 2026)
    assert [r.clave for r in out.where(quality.is_clean()).collect()] == ["09PU2026I0001"]
    assert out.where(~quality.is_clean()).count() == 5


def test_audit_evaluations(spark):
    out = quality.audit_evaluations(spark.createDataFrame([("VIABLE", 0.9, 80), ("NADA", 0.5, 50), ("VIABLE", 1.5, 50), ("VIABLE", 0.5, 120), ("VIABLE", None, None)], "veredicto string, score double, confianza_pct int"))
    assert out.where(quality.is_clean()).count() == 2


def test_upsert_twice_is_once(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "id long, v string")
    new = spark.createDataFrame([(2, "c"), (3, "d")], "id long, v string")
    once = upsert.upsert(old, new, ["id"])
    assert rows(once) == rows(upsert.upsert(once, new, ["id"])) == ["(1, 'a')", "(2, 'c')", "(3, 'd')"]


def test_enrichment_takes_the_first_source(spark):
    base = spark.createDataFrame([(1, None), (2, "own"), (3, "")], "k long, name string")
    report = spark.createDataFrame([(1, "report"), (2, " ")], "k long, name string")
    got = {r.k: r.name for r in joins.enrich(base, [report], "k", ["name"]).collect()}
    assert got == {1: "report", 2: "own", 3: "Desconocido"}


def test_later_patterns_add_one_beyond_the_limit(spark):
    t = "impacto bajo " * 7 + "plan de manejo " * 3 + "especie en peligro"
    assert spark.createDataFrame([(t,)], "t string").select(text.heuristic_score(F.col("t"))).first()[0] == round(6 / 7, 2)


def test_windows_cover_one_vessel(spark):
    t0 = dt.datetime(2026, 1, 1)
    points = spark.createDataFrame([(v, t0 + dt.timedelta(hours=i), i, float(i)) for v in (1, 2) for i in range(70)] + [(3, t0, 0, 1.0)], "v long, ts timestamp, i long, x double")
    got = sequences.sliding_windows(points, "v", "ts", "i", "x").collect()
    assert len(got) == 6 and all(r.points == 32 for r in got)


@pytest.mark.parametrize("name", ["classified_files", "year_from_name", "type_and_version", "best_extraction", "positional_type", "version_suffix", "manifest_health", "index_changes", "repaired_json", "page_lines", "fixed_attributes", "gap_features", "one_hop"])
def test_collection_matches_sql(spark, duck, name):
    test_matches_sql(spark, duck, name)


def test_names(spark):
    name = F.col("n")
    got = spark.createDataFrame([("21PU2025H0155.estudio.03.pdf",), ("ASEA_GACETA_01-2026.pdf",), ("gaceta_0001-26.pdf",), ("",), (None,)], "n string").select(files.source_tag(name), files.is_gazette(name), files.category(name), files.year_from_name(name), *files.type_and_version(name)).collect()
    assert [tuple(r) for r in got] == [
        ("SEMARNAT", False, "estudio", 2025, "estudio", 3),
        ("ASEA", True, "gaceta", 2026, "pdf", None),
        ("SEMARNAT", True, "gaceta", 2026, "pdf", None),
        ("SEMARNAT", False, "desconocido", None, None, None),
        ("SEMARNAT", False, "desconocido", None, None, None),
    ]


def test_notes(spark):
    body = "---\nclave: 21PU2025H0155\nestado: \"Puebla\"\nclave: x\n---\n[[A|b]] [[a/c]] [[B]] [[B]]"
    row = notes.parse_note(spark.createDataFrame([(1, body)], "k long, b string"), "k", "b").first()
    assert row.fields == {"estado": "Puebla", "clave": "x"} and row.links == ["A", "B", "a/c"]
    links = spark.createDataFrame([("A",), ("a/c",), ("B",), ("",)], "t string")
    stems = spark.createDataFrame([("a",)], "s string")
    assert [r.t for r in notes.broken_links(links, stems, "t", "s").collect()] == ["B"]
    texts = spark.createDataFrame([("zona  núcleo",), ("NOM-059 especie P sin nada",), ("nom-059 P con plan de manejo",), (None,)], "t string")
    assert [len(r[0]) for r in texts.select(notes.knockouts(F.col("t"))).collect()] == [1, 1, 0, 0]


@pytest.mark.parametrize("name", ["classified_items", "permit_match", "cell_borders", "preferred_document", "page_stats", "best_chunks", "refined_registry", "stage_contracts", "patched_notes", "backsynced", "maritime_graph", "note_graph", "cited_context"])
def test_vault_matches_sql(spark, duck, name):
    test_matches_sql(spark, duck, name)


def test_components(spark):
    nodes = spark.createDataFrame([(x, "a") for x in "bcdefgh"] + [("z", "cell"), ("y", "cell")], "id string, type string")
    edges = [("h", "g"), ("g", "f"), ("f", "e"), ("c", "d"), ("b", "z"), ("c", "z"), ("e", "?"), ("b", "b")]
    want = {"b": 0, "c": 1, "d": 1, **dict.fromkeys("efgh", 2), "y": 3, "z": 3}
    for order in (edges, edges[::-1]):
        got = graph.components(nodes, spark.createDataFrame(order, "src string, dst string"), "cell")
        assert {r.id: r.community for r in got.collect()} == want
    assert graph.components(nodes.limit(0), spark.createDataFrame(edges, "src string, dst string")).count() == 0


def test_classify(spark):
    paths = ["x/21PU2025H0155.estudio.pdf", "ASEA_GACETA_1-2026.pdf", "gaceta_ASEA_12_2025.pdf", "otro.pdf", "99ZZ2020Q123.pdf", None]
    got = [r.item for r in files.classify(spark.createDataFrame([(i, p) for i, p in enumerate(paths)], "i long, p string"), "p").orderBy("i").collect()]
    assert [(x.clave, x.valid, x.source, x.sector_name, x.state_name, x.year, x.category) for x in got] == [
        ("21PU2025H0155", True, "SEMARNAT", "Sector Hidrocarburos", "Puebla", 2025, "estudio"),
        ("ASEA-GACETA-01-2026", False, "ASEA", "Sector Hidrocarburos", "Nacional/Marino", 2026, "gaceta"),
        ("ASEA-GACETA-12-2025", False, "ASEA", "Sector Hidrocarburos", "Nacional/Marino", 2025, "gaceta"),
        ("OTRO", False, "SEMARNAT", "Desconocido", "Desconocido", None, "desconocido"),
        ("99ZZ2020Q123", True, "SEMARNAT", "Sector 99", "ZZ", 2020, "desconocido"),
        ("", False, "SEMARNAT", "Desconocido", "Desconocido", None, "desconocido"),
    ]


def test_records(spark):
    names = spark.createDataFrame([(1, "Mar Azul 77"), (2, "77-B"), (3, None), (4, "")], "k long, n string")
    permits = spark.createDataFrame([("p", " 77 "), ("q", "AZUL"), ("r", ""), ("s", None)], "id string, reg string")
    assert sorted((r.k, r.id) for r in records.contained(names, "n", permits, "reg").collect()) == [(1, "p"), (1, "q"), (2, "p")]
    with pytest.raises(ValueError):
        records.guarded_select(spark, "SELECT 1; DROP TABLE x", {})
    rows = spark.createDataFrame([("a9999", 1, True), ("b", 2, True), ("b", 3, True), ("c", 4, False)], "k string, o long, f boolean")
    assert {r.o: r.reason for r in records.remediation(rows, "k", "o", F.col("f")).collect()} == {1: "mock", 2: None, 3: "duplicate", 4: "no file"}
    old = spark.createDataFrame([(1, "a", "x"), (2, "b", "x")], "id long, v string, at string")
    new = spark.createDataFrame([(1, None), (2, "c"), (3, "d")], "id long, v string")
    assert rows_of(upsert.update_matching(old, new, ["id"], ["v"], "at", F.lit("now"))) == [(1, "a", "now"), (2, "c", "now")]


def rows_of(frame):
    return sorted(tuple(r) for r in frame.collect())
