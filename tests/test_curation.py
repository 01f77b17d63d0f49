import hashlib
import re

import pytest
from pyspark.sql import functions as F

from acervo.operators import curation, graph, joins
from acervo.operators import text as texts
from acervo.plans import curation as _  # noqa: F401
from acervo.plans import registry
from tests.test_core import SF, duck, rows  # noqa: F401

KEY = "21PU2025H0155"
NAMES = ["verified_downloads", "download_manifest", "manifest_totals", "attempt_ledger", "remediated_files", "remediated_projects", "remediation_counts", "assembled_records", "signal_reports", "asof_context_12", "one_hop_or_key"]


@pytest.mark.parametrize("name", NAMES)
def test_matches_sql(spark, duck, name):  # noqa: F811
    got, found = registry.QUERIES[name](spark, SF), duck.execute(registry.ORACLE_SQL[name])
    columns = [d[0] for d in found.description]
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    assert rows(got) == sorted(str(tuple(r[i] for i in order)) for r in found.fetchall())


def test_files_are_judged_on_their_bytes(spark):
    body = b"%PDF-1.7" + b"x" * 6000
    cases = {
        "d/missing.pdf": (None, None, "MISSING"),
        "d/small.pdf": (body[:100], (1, False, "t"), "EMPTY"),
        "d/html.pdf": (b"<html>" + body, (1, False, "t"), "CORRUPT"),
        "d/unread.pdf": (body, None, "CORRUPT"),
        "d/closed.pdf": (body, (1, True, None), "ENCRYPTED"),
        "d/none.pdf": (body, (0, False, None), "EMPTY"),
        "d/scan.pdf": (body, (2, False, " \n\t"), "VERIFIED_NO_TEXT"),
        "d/null.pdf": (body, (2, False, None), "VERIFIED_NO_TEXT"),
        "d/good.pdf": (body, (2, False, f"\nClave {KEY}, y 02BC2026I0026"), "VERIFIED"),
        f"d/{KEY}.pdf": (body, (2, False, "otra"), "VERIFIED"),
        f"{KEY}/other.pdf": (body, (2, False, f"X{KEY}"), "MISMATCH"),
    }
    files = spark.createDataFrame([(p, KEY, c and len(c), c) for p, (c, _, _) in cases.items()] + [("d/any.pdf", None, len(body), body)], "path string, clave string, length long, content binary")
    pages = spark.createDataFrame([(p, *x) for p, (_, x, _) in cases.items() if x] + [("d/any.pdf", 1, False, "y")], "path string, page_count int, encrypted boolean, text string")
    got = {r["path"]: r for r in curation.verify_files(files, pages).collect()}
    assert {p: r["status"] for p, r in got.items()} == {p: s for p, (_, _, s) in cases.items()} | {"d/any.pdf": "VERIFIED"}
    assert got["d/good.pdf"]["found_keys"] == [KEY, "02BC2026I0026"] and got["d/good.pdf"]["sha256"] == hashlib.sha256(body).hexdigest()
    assert [p for p, r in got.items() if r["valid"]] and all(r["valid"] == (r["status"] in ("VERIFIED", "VERIFIED_NO_TEXT", "MISMATCH")) for r in got.values())
    assert got["d/html.pdf"]["sha256"] is None and got["d/closed.pdf"]["sha256"] == hashlib.sha256(body).hexdigest()
    assert curation.verify_files(files.limit(0), pages.limit(0)).count() == 0
    assert curation.manifest_totals(curation.verify_files(files.limit(0), pages)).first()["health_pct"] == 100.0


def test_manifest_keeps_key_and_type_of_known_paths(spark):
    schema = "path string, clave string, file_type string, status string, sha256 string, file_size long, page_count int, verified_at int"
    old = spark.createDataFrame([("a", "K1", "estudio", "EMPTY", "", 3, 0, 1), ("b", "K2", None, "VERIFIED", "f", 9, 4, 1)], schema)
    new = spark.createDataFrame([("a", "K9", "resumen", "VERIFIED", "e", 8, 2, 0), ("c", "K3", "resumen", None, None, None, None, 0)], schema).drop("verified_at")
    got = {r["path"]: tuple(r)[1:] for r in curation.upsert_manifest(old, new, F.lit(7)).collect()}
    assert got == {"a": ("K1", "estudio", "VERIFIED", "e", 8, 2, 7), "b": ("K2", None, "VERIFIED", "f", 9, 4, 1), "c": ("K3", "resumen", "CORRUPT", "", 0, 0, 7)}


def test_ledger_counts_and_takes_the_last_attempt(spark):
    old = spark.createDataFrame([("a", "failed", 2, 1.0, "x"), ("b", "done", 1, 1.0, "y"), (None, "done", 1, 1.0, "y")], "clave string, status string, attempts long, last_try double, files string")
    new = spark.createDataFrame([("a", "failed", 3.0, "p"), ("a", "done", 5.0, None), ("c", None, 2.0, "q"), (None, "done", 2.0, "q")], "clave string, status string, at double, files string")
    got = sorted(tuple(r) for r in curation.record_attempts(old, new).collect())
    assert got == [("a", "done", 4, 5.0, None, True), ("b", "done", 1, 1.0, "y", True), ("c", None, 1, 2.0, "q", False)]
    assert sorted(tuple(r)[:3] for r in curation.record_attempts(old.limit(0), new).collect()) == [("a", "done", 2), ("c", None, 1)]


def test_repeated_files_with_one_hot_digest(spark):
    files = spark.range(200).select(F.concat(F.when(F.col("id") == 0, "k_v2").otherwise("k"), F.lit("."), "id", F.when(F.col("id") % 50 == 3, ".md").otherwise(".pdf")).alias("name"), F.when(F.col("id") % 7 != 5, F.when(F.col("id") % 3 > 0, "hot").otherwise(F.col("id").cast("string"))).alias("digest"), "id", F.lit(1).alias("_first_seen"))
    got = {r["id"]: r["reason"] for r in curation.remediate_files(files, "name", "digest", "id").collect()}
    want = {i: "version" if i == 0 else "repeated" if i > 1 and i % 3 and i % 7 != 5 and i % 50 != 3 else None for i in range(200)}
    assert got == want


def test_remediation_fixes_only_rows_that_stay(spark):
    projects = spark.createDataFrame([(KEY, None, None), (KEY[:12] + "6", " Desconocida ", 2024), ("21PU2025H9999", None, 1), ("XX", None, 1), (None, "Puebla", 1), ("21PU2025H01551", "x", 2000)], "clave string, state string, year int")
    files = spark.createDataFrame([(f"{KEY}.estudio.pdf",), (f"{KEY[:12]}6_a.md",), ("21PU2025H9999.pdf",), ("21PU2025H01551.pdf",)], "name string")
    got = {r["clave"]: tuple(r)[1:] for r in curation.remediate_projects(projects, files).collect()}
    assert got == {
        KEY: ("Puebla", 2025, None, True, True), KEY[:12] + "6": ("Puebla", 2025, None, True, True), "21PU2025H9999": (None, 1, "mock", False, False),
        "XX": (None, 1, "no file", False, False), None: ("Puebla", 1, "no file", False, False), "21PU2025H01551": ("x", 2000, None, False, False),
    }
    assert tuple(curation.remediation_counts(curation.remediate_projects(projects, files)).first()) == (3, 2, 2)


def test_records_follow_the_order_of_sources(spark):
    keys = spark.createDataFrame([(KEY,), (KEY,), ("02BC2026I0026",), ("02BC2026I0027",), ("02BC2026I9999",), (None,), ("ODD",)], "clave string")
    files = spark.createDataFrame([(f"{KEY}.pdf", "resolutivo"), (f"{KEY}.pdf", "resumen"), ("02BC2026I0026_v2.pdf", "resolutivo"), ("02BC2026I0026.txt", "resumen"), ("02BC2026I9999.pdf", "estudio"), ("ODD.x.md", "extraccion")], "name string, kind string")
    listed = spark.createDataFrame([(KEY, "Planta", "", "Gas SA"), ("02BC2026I0026", "Muelle", "Ensenada", "")], "clave string, project_name string, location string, promovente string")
    report = spark.createDataFrame([(KEY, "Planta de gas", "VIABLE", 0.9, 80, ["k"], ["y"], [], None)], "clave string, project_name string, veredicto string, score double, confianza_pct int, knockouts array<string>, yes_signals array<string>, no_signals array<string>, condicionantes array<string>")
    got = {r["clave"]: tuple(r)[1:] for r in curation.assemble_records(keys, files, listed, report).collect()}
    assert got == {
        KEY: ("Planta de gas", "Resuelto", "21", "Puebla", 2025, ["resumen", "resolutivo"], "Gas SA", "VIABLE", 0.9, 80, ["k"], ["y"], [], []),
        "02BC2026I0026": ("Muelle", "En evaluación", "02", "Ensenada", 2026, ["resolutivo"], "Desconocido", "PENDIENTE", 0.0, 0, [], [], [], []),
        "ODD": ("Proyecto ODD", "En evaluación", None, None, None, [], "Desconocido", "PENDIENTE", 0.0, 0, [], [], [], []),
    }


def test_contexts_equal_a_plain_loop(spark):
    samples = ["", None, "plan de manejo", "Medida de mitigación " * 7 + "x" * 60 + "\nPLAN  DE\nMANEJO y más", "á" * 49 + "Impacto BAJO" + "ñ" * 51 + "impacto menor", "área natural protegida; plan de manejo" * 3, "a😀" * 40 + " restauración ecológica " + "😀" * 60]

    def plain(text, patterns):
        out = []
        for p in patterns:
            for m in re.finditer(p, text or "", re.IGNORECASE):
                out.append(text[max(0, m.start() - 50) : m.end() + 50].strip())
                if len(out) >= 5:
                    break
        return out[:5]

    docs = spark.createDataFrame(list(enumerate(samples)), "id long, text string")
    got = {r["id"]: r["r"] for r in docs.select("id", texts.heuristic_report(F.col("text"), F.when(F.col("id") == 2, F.array(F.lit("k")))).alias("r")).collect()}
    for i, text in enumerate(samples):
        if i != 2:
            assert (got[i]["yes_signals"], got[i]["no_signals"], got[i]["confianza_pct"]) == (plain(text, texts.YES), plain(text, texts.NO), 40)
    assert tuple(got[2]) == ("DESFAVORABLE", 0.0, 100, [], ["Knockout automático detectado"], ["k"])


def test_context_is_filled_by_its_last_point(spark):
    points = spark.createDataFrame([(1, i, float(i)) for i in range(4)] + [(2, i, float(i)) for i in range(20)] + [(3, 0, 0.0), (3, 1, 1.0)], "v long, ts long, value double")
    gaps = spark.createDataFrame([(1, 3, 10), (2, 15, 20), (3, 9, 30)], "v long, gap_start long, gap_id long")
    got = dict(tuple(r) for r in joins.asof_context(points, gaps, "v").collect())
    assert got == {10: [0.0, 1.0] + [2.0] * 10, 20: [float(i) for i in range(3, 15)]}


def test_keys_without_edges_tell_four_relations(spark):
    edges = spark.createDataFrame([("a", "b", "R")], "src string, dst string, relation string")
    wanted = spark.createDataFrame([("b",), (KEY,), (KEY,), ("c",), (None,)], "id string")
    got = sorted(tuple(r) for r in graph.one_hop_or_key(edges, wanted).collect())
    assert got == [(KEY, "key", "DEL_AÑO", "2025"), (KEY, "key", "DEL_SECTOR", "Sector 21"), (KEY, "key", "ES_TIPO", "MIA Particular"), (KEY, "key", "UBICADO_EN", "Puebla"), ("b", "in", "R", "a")]
