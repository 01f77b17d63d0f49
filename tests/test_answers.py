import json
import re

import pytest
from pyspark.sql import functions as F

from acervo.operators import answers, property_graph
from acervo.plans import answers as _  # noqa: F401
from acervo.plans import registry
from tests.test_core import SF, duck, rows  # noqa: F401

KEY = "21PU2025H0155"
DEFAULTS = ("N/A", "Documento general PDF", [])


@pytest.mark.parametrize("name", ["property_graph_projects", "property_graph_others", "property_graph_edges", "property_graph_counts", "normal_evaluations", "filled_answers", "text_evaluations"])
def test_matches_sql(spark, duck, name):  # noqa: F811
    got, found = registry.QUERIES[name](spark, SF), duck.execute(registry.ORACLE_SQL[name])
    columns = [d[0] for d in found.description]
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    assert rows(got) == sorted(str(tuple(r[i] for i in order)) for r in found.fetchall())


@pytest.mark.parametrize(
    "raw, want",
    [
        (None, None),
        ("", None),
        ("nada", None),
        ("[1, 2]", None),
        ('{"resumen_ejecutivo": "x"', None),
        ('{"resumen_ejecutivo": "x", "metadatos": [1]}', ("x", None, (None, None, None, None, *DEFAULTS))),
        ('```JSON\n{"puntos_clave": ["p", "q"], "metadatos": {"estado": "Puebla", "fechas_clave": ["2025"]}}\n``` ', (None, ["p", "q"], (None, None, "Puebla", None, "N/A", "Documento general PDF", ["2025"]))),
        (json.dumps({"resumen_ejecutivo": "a {b} ```", "puntos_clave": [], "metadatos": {"clave_proyecto": KEY, "promovente": None, "municipio": "M", "estatus": "ok", "tipo_actividad": "t"}}), ("a {b} ```", [], (KEY, None, None, "M", "ok", "t", []))),
    ],
)
def test_answers_are_filled(spark, raw, want):
    got = spark.createDataFrame([(raw,)], "raw string").select(answers.filled_answer(F.col("raw"), F.lit("f.pdf")).alias("a")).select("a.*").first()
    summary, points, meta = want or (None, None, (None, None, None, None, *DEFAULTS))
    assert (got["resumen_ejecutivo"], got["puntos_clave"]) == (summary or "Resumen ejecutivo no disponible para f.pdf.", ["Documento f.pdf procesado sin detalles del LLM."] if points is None else points)
    assert tuple(got["metadatos"]) == meta


def test_texts_without_an_answer(spark):
    samples = {"": (f"Proyecto {KEY}", "Sin resumen disponible."), f"# {KEY}": (f"Proyecto {KEY}", f"# {KEY}"), "x\r\n#  Obra # 2 \ny": ("Obra 2", None), "a\n" * 9 + "# En diez": ("En diez", None), "a\n" * 10 + "# Once": (f"Proyecto {KEY}", None), "## No\n# ": ("", None), "\n z" * 200: (f"Proyecto {KEY}", None)}
    docs = spark.createDataFrame([(t,) for t in samples] + [(None,)], "text string")
    got = {r["text"]: r["e"] for r in docs.select("text", answers.text_evaluation(F.lit(KEY), F.col("text")).alias("e")).collect()}
    for text, (title, summary) in samples.items():
        assert got[text]["project_name"] == title and got[text]["summary"] == (summary or re.sub("\n", " ", text[:300]).strip())
    assert got[None]["summary"] == "Sin resumen disponible." and got[None]["project_name"] == f"Proyecto {KEY}"
    assert len(got[None]["impacts"]) == 1 and len(got[None]["mitigations"]) == 2 and got[None]["legal_risk_level"] == "MEDIO"


def test_evaluations_take_one_form(spark):
    reports = spark.createDataFrame([(1, "DESFAVORABLE", 45.0, 60, "s", "n", "p"), (2, None, None, None, None, None, ""), (3, "CONDICIONADO", 1.0, 0, "", "", None)], "id int, veredicto string, score double, confianza_pct int, summary string, name string, sponsor string")
    row = answers.normal_evaluation(F.lit("K"), F.struct("veredicto", "score", "confianza_pct", "summary"), F.col("name"), F.col("sponsor"))
    got = [tuple(r["e"]) for r in reports.orderBy("id").select(row.alias("e")).collect()]
    assert got == [
        ("K", "DESFAVORABLE", 0.45, 60, "n", "p", "s", "ALTO", 0.6),
        ("K", "CONDICIONADO", 0.0, 80, "Proyecto K", "No especificado", "Evaluación de viabilidad socio-ambiental para el proyecto K", "BAJO", 0.8),
        ("K", "CONDICIONADO", 1.0, 0, "Proyecto K", "No especificado", "", "MEDIO", 0.0),
    ]


def test_gazettes_come_before_notes(spark):
    seen = "stem string, clave string"
    gazettes = spark.createDataFrame([("b", KEY), ("ASEA_1", KEY), ("a", "ODD"), ("c", None), (None, KEY)], seen)
    notes = spark.createDataFrame([("A", KEY), ("n", "02BC2026Z0026"), ("m", "02BC2026Z0026")], seen)
    report = spark.createDataFrame([(KEY, None, "VIABLE", 0.5, None)], "clave string, project_name string, veredicto string, score double, confianza_pct int")
    got = property_graph.project_vertices(gazettes, notes, report)
    assert sorted(tuple(r) for r in got.collect()) == [
        ("02BC2026Z0026", "Proyecto 02BC2026Z0026", 2026, "02", "PENDIENTE", 0.0, 0, "BC", "Baja California", "Z", "Tipo Z", "0026", "m"),
        (KEY, f"Proyecto {KEY}", 2025, "21", "VIABLE", 0.5, 0, "PU", "Puebla", "H", "MIA Particular", "0155", "ASEA_1"),
    ]
    assert ("Gaceta", "ASEA_1", "ASEA") in [tuple(r) for r in property_graph.other_vertices(got).collect()]
    assert tuple(property_graph.property_counts(got).first()) == (2, 2, 2, 2, 6) and property_graph.property_edges(got).count() == 6
    assert tuple(property_graph.property_counts(property_graph.project_vertices(gazettes.limit(0), notes.limit(0), report)).first()) == (0, 0, 0, 0, 0)
