"""Evaluations from answers of models: repaired and filled, put into one form, or made up from the text where there is none."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from acervo.operators.sections import strip

#: Fields of an answer about a document.
ANSWER = "resumen_ejecutivo string, puntos_clave array<string>, metadatos struct<clave_proyecto: string, promovente: string, estado: string, municipio: string, estatus: string, tipo_actividad: string, fechas_clave: array<string>>"


def filled_answer(raw: Column, name: Column) -> Column:
    """The struct ANSWER in a fenced or plain JSON answer about the document `name`; what is absent or null gets its default.

    An answer that is null, does not parse or is no object gives the defaults alone. Other fields are not read.
    """
    plain = F.regexp_replace(F.regexp_replace(strip(raw), r"(?i)^```(json)?\s*", ""), r"\s*```$", "")
    got = F.from_json(F.when(F.startswith(plain, F.lit("{")), plain), ANSWER)

    def fill(x: Column) -> Column:
        meta = x["a"]["metadatos"]
        none = F.array().cast("array<string>")
        fields = [meta[c].alias(c) for c in ("clave_proyecto", "promovente", "estado", "municipio")]
        defaults = [F.coalesce(meta["estatus"], F.lit("N/A")).alias("estatus"), F.coalesce(meta["tipo_actividad"], F.lit("Documento general PDF")).alias("tipo_actividad"), F.coalesce(meta["fechas_clave"], none).alias("fechas_clave")]
        summary = F.coalesce(x["a"]["resumen_ejecutivo"], F.concat(F.lit("Resumen ejecutivo no disponible para "), x["n"], F.lit(".")))
        points = F.coalesce(x["a"]["puntos_clave"], F.array(F.concat(F.lit("Documento "), x["n"], F.lit(" procesado sin detalles del LLM."))))
        return F.struct(summary.alias("resumen_ejecutivo"), points.alias("puntos_clave"), F.struct(*fields, *defaults).alias("metadatos"))

    # within a lambda the answer is parsed once, however many fields are read
    return F.transform(F.array(F.struct(got.alias("a"), F.coalesce(name, F.lit("")).alias("n"))), fill)[0]


def normal_evaluation(key: Column, report: Column, name: Column, sponsor: Column) -> Column:
    """An evaluation as the warehouse holds it, from a report (veredicto, score, confianza_pct, summary; null where absent).

    Scores over 1 are per cent. The risk is ALTO for DESFAVORABLE, MEDIO for CONDICIONADO, else BAJO, also without a verdict, which
    is stored as CONDICIONADO. Absent confidence is 80, an absent or empty name `Proyecto key`, such a sponsor No especificado.
    """
    score, verdict = F.coalesce(report["score"].cast("double"), F.lit(0.0)), report["veredicto"]
    sure = F.coalesce(report["confianza_pct"].cast("int"), F.lit(80))
    full = lambda c, other: F.coalesce(F.when(c != "", c), other)
    return F.struct(
        key.alias("clave"), F.coalesce(verdict, F.lit("CONDICIONADO")).alias("veredicto"), F.when(score > 1, score / 100).otherwise(score).alias("score"), sure.alias("confianza_pct"),
        full(name, F.concat(F.lit("Proyecto "), key)).alias("project_name"), full(sponsor, F.lit("No especificado")).alias("promovente"),
        F.coalesce(report["summary"], F.concat(F.lit("Evaluación de viabilidad socio-ambiental para el proyecto "), key)).alias("summary"),
        F.when(verdict == "DESFAVORABLE", "ALTO").when(verdict == "CONDICIONADO", "MEDIO").otherwise("BAJO").alias("legal_risk_level"), (sure / 100).alias("confidence_score"),
    )


def text_evaluation(key: Column, text: Column) -> Column:
    """The evaluation of a text that no model has read: its title and start, one impact and two mitigations that hold for any work.

    The title is the first of the first ten lines that starts with `# `, without any `# `; without one, or where it is
    the key, `Proyecto key`. Null and empty texts have no summary.
    """
    lines = F.slice(F.split(F.coalesce(text, F.lit("")), "\r\n|\n|\r", 11), 1, 10)
    title = strip(F.replace(F.get(F.filter(lines, lambda x: F.startswith(x, F.lit("# "))), F.lit(0)), F.lit("# "), F.lit("")))
    summary = strip(F.replace(F.substring(text, 1, 300), F.lit("\n"), F.lit(" ")))
    impact = F.struct(F.lit("Suelo/Flora").alias("category"), F.lit("Afección potencial a cobertura vegetal por preparación del sitio").alias("description"), F.lit("MEDIA").alias("severity"), F.lit("Programa de rescate de flora y reforestación compensatoria").alias("mitigation_measure"))
    return F.struct(
        key.alias("clave"), F.when(title != key, title).otherwise(F.concat(F.lit("Proyecto "), key)).alias("project_name"), F.lit("Información no extractable").alias("promovente"),
        F.when(F.coalesce(text, F.lit("")) == "", "Sin resumen disponible.").otherwise(summary).alias("summary"), F.array(impact).alias("impacts"),
        F.array(F.lit("Programa de monitoreo ambiental"), F.lit("Delimitación del área de trabajo")).alias("mitigations"), F.lit("MEDIO").alias("legal_risk_level"), F.lit(0.7).alias("confidence_score"),
    )
