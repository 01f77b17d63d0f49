import json
import time

from acervo.sinks import files as sinks
from acervo.sources import files
from acervo.streaming import ingest


def test_sources(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "21PU2025H0155.md").write_text("uno\ndos")
    (tmp_path / "a" / "r1.json").write_text(json.dumps({"nombre_proyecto": "Presa", "score": 0.5}))
    (tmp_path / "a" / "bad.json").write_text("{")
    (tmp_path / "a" / "x.pdf").write_bytes(b"%PDF-" + b"0" * 20000)
    doc = files.read_documents(spark, str(tmp_path)).first()
    assert (doc.stem, doc.folder, doc.content) == ("21PU2025H0155", "a", "uno\ndos")
    assert [(r.clave, r.project_name) for r in files.read_reports(spark, str(tmp_path / "a" / "*.json")).collect()] == [("R1", "Presa")]
    assert [(r.name, r.size, r.size_mb) for r in files.list_corpus(spark, str(tmp_path)).collect()] == [("x.pdf", 20005, 0.02)]


def test_stream_equals_batch(spark, tmp_path):
    source, target = tmp_path / "in", str(tmp_path / "out")
    source.mkdir()

    def run():
        ingest.ingest(ingest.stream_documents(spark, str(source)), target, str(tmp_path / "checkpoint"), lambda d: d.select("sha", "name", "content")).awaitTermination(90)

    (source / "a.md").write_text("same")
    (source / "b.md").write_text("other")
    run()
    (source / "c.md").write_text("same")
    (source / "d.md").write_text("new")
    run()
    assert sorted(r.content for r in spark.read.parquet(target).collect()) == ["new", "other", "same"]


def test_registry_layouts(spark, tmp_path):
    (tmp_path / "claves_2024.csv").write_text("CLAVE,YEAR,FILE,NAME,LOC,PROM\n21pu2024H0001,2024,ASEA_1.pdf,Uno,,\nx,2\n02BC2024H0002,2024,g.pdf,Dos,Tijuana,Ana\n")
    (tmp_path / "claves_2025.csv").write_text('21PU2024H0001,2025,SEMARNAT,f.pdf,"Nuevo, largo",Puebla,\n')
    got = {r.clave: tuple(r)[1:] for r in files.read_key_registry(spark, str(tmp_path)).collect()}
    assert got == {"21PU2024H0001": (2025, "SEMARNAT", "f.pdf", "Nuevo, largo", "Puebla", "Desconocido"), "02BC2024H0002": (2024, "SEMARNAT", "g.pdf", "Dos", "Tijuana", "Ana")}
    sinks.write_key_registry(files.read_key_registry(spark, str(tmp_path)), str(tmp_path / "out"))
    assert {r.clave for r in files.read_key_registry(spark, str(tmp_path / "out")).collect()} == set(got)


def test_mixed_projects(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"clave": "21PU2025H0155", "project_name": "", "nombre_proyecto": "Presa"}))
    (tmp_path / "b.md").write_text("\n# Planta de gas\nclave 09PU2025H0001\n")
    (tmp_path / "c.md").write_text("nada")
    assert sorted(tuple(r)[:2] for r in files.read_mixed_projects(spark, str(tmp_path)).collect()) == [("09PU2025H0001", "Planta de gas"), ("21PU2025H0155", "Presa")]
    (tmp_path / "t.json").write_text(json.dumps([{"Clave": "a"}, {"Clave": "b"}]))
    assert files.read_ground_truth(spark, str(tmp_path / "t.json"), "Clave string").count() == 2


def test_reports(spark, tmp_path):
    audited = spark.createDataFrame([(1, []), (2, [("f", "e", "CRITICAL")]), (3, [("f", "e", "WARNING")])], "k long, alerts array<struct<field:string,error:string,level:string>>")
    sinks.write_quality_report(audited, str(tmp_path), "k")
    assert tuple(sinks.quality_summary(audited).first()) == (3, 2, 1, 1, 66.7)
    assert tuple(sinks.quality_summary(audited.limit(0)).first()) == (0, 0, 0, 0, 100.0)
    assert "| clean_pct | 66.7 |" in [r.value for r in spark.read.text(str(tmp_path / "summary")).collect()]
    sinks.write_area_report({"vessels": spark.createDataFrame([("golfo", None, None)], "preset string, name string, x double")}, str(tmp_path / "area"))
    assert spark.read.csv(str(tmp_path / "area" / "vessels"), header=True).first().x == "0.0"


def test_events_and_schedule(spark, tmp_path):
    rows = spark.createDataFrame([("/a/gaceta_1.pdf", 1), ("/a/x.pdf", 2), ("/a/x.tmp", 3), ("/a/r.json", 4)], "path string, mtime long")
    assert [r.kind for r in ingest.change_events(rows).orderBy("at").collect()] == ["gazette", "document", "report"]
    ran = []
    assert [ingest.once_a_date(spark, lambda: ran.append(1), str(tmp_path / "ledger"), x) for x in ("2026-01-05", "2026-01-05", "2026-01-12")] == [True, False, True]
    assert len(ran) == 2


def test_poll_and_progress(spark, tmp_path):
    seen, listener = [], ingest.Progress()
    spark.streams.addListener(listener)
    stream = ingest.poll(spark, lambda s: s.range(9).orderBy("id").limit(5), lambda d: seen.append(d.count()), str(tmp_path / "c"), "1 second")
    for _ in range(60):
        if seen:
            break
        time.sleep(0.5)
    stream.stop()
    spark.streams.removeListener(listener)
    assert seen[0] == 5 and any(e[0] == "started" for e in listener.events)
