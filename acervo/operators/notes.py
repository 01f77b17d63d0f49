"""Fields, links and cuts of notes, pages and model answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Rules that end an evaluation at once.
KNOCKOUTS = {
    "Traslape con ANP categoría I-III": r"(?iu)(zona\s+núcleo|categoría\s+i{1,3}|reserva\s+de\s+biosfera)",
    "Especie en peligro (P) NOM-059 sin plan de manejo": r"(?iu)nom-059.*\bP\b(?!.*plan\s+de\s+manejo)",
}


def knockouts(text: Column, rules: dict[str, str] = KNOCKOUTS) -> Column:
    """Labels of the rules that a text meets; empty for null."""
    return F.array_compact(F.array(*[F.when(text.rlike(p), F.lit(label)) for label, p in rules.items()]))


def middle_truncate(text: Column, most: int, marker: str = "\n\n[...]\n\n") -> Column:
    """Both ends of a text longer than `most` with a marker between, else the text."""
    half = most // 2
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, half), F.lit(marker), F.right(text, F.lit(half)))).otherwise(text)


def is_scanned(text: Column, least: int = 80) -> Column:
    return F.length(F.trim(F.coalesce(text, F.lit("")))) < least


def targets(body: Column) -> Column:
    """Distinct [[link]] targets before any bar, sorted."""
    return F.array_sort(F.array_distinct(F.transform(F.regexp_extract_all(body, F.lit(r"\[\[([^\]|]+)"), 1), lambda x: F.trim(x))))


def parse_note(notes: DataFrame, key: str, body: str) -> DataFrame:
    """(key, fields, links): the `k: v` lines between the first two `---` without quotes, and the [[links]]."""
    front = F.when(F.col(body).startswith("---"), F.split_part(F.col(body), F.lit("---"), F.lit(2)))
    lines = F.filter(F.split(F.coalesce(front, F.lit("")), "\n"), lambda x: x.contains(":"))
    pairs = F.transform(lines, lambda x: F.struct(F.trim(F.regexp_extract(x, r"^([^:]*):", 1)).alias("k"), F.btrim(F.regexp_extract(x, r"^[^:]*:(.*)$", 1), F.lit(" \"'")).alias("v")))
    last = F.filter(pairs, lambda p, i: ~F.exists(F.slice(pairs, i + 2, F.size(pairs)), lambda q: q["k"] == p["k"]))
    return notes.select(key, F.map_from_entries(last).alias("fields"), targets(F.col(body)).alias("links"))


def broken_links(links: DataFrame, stems: DataFrame, target: str, stem: str) -> DataFrame:
    """Links whose target is no note, without empty targets and paths."""
    known = stems.select(F.upper(stem).alias("_t")).distinct()
    return links.where((F.col(target) != "") & ~F.col(target).contains("/")).withColumn("_t", F.upper(target)).join(known, "_t", "left_anti").drop("_t")


def anchors(pages: DataFrame, key: str, html: str) -> DataFrame:
    """(key, href, label): anchors of a page, each distinct pair once."""
    found = F.regexp_extract_all(F.col(html), F.lit(r'(<a\s+href="[^"]*">[^<]*)</a>'), 1)
    rows = pages.select(key, F.explode(F.array_distinct(found)).alias("_a"))
    return rows.select(key, F.regexp_extract("_a", r'href="([^"]*)"', 1).alias("href"), F.trim(F.regexp_extract("_a", r">([^<]*)$", 1)).alias("label")).distinct()


def json_fields(raw: Column, schema: str) -> Column:
    """The struct in the outermost braces of an answer, fenced or not; null where it does not parse."""
    return F.from_json(F.nullif(F.regexp_extract(raw, r"(?s)(\{.*\})", 1), F.lit("")), schema)


def page_lines(docs: DataFrame, key: str, text: str, page: int, size: int) -> DataFrame:
    """(key, line_no, line, total_lines, total_pages): one page of each text's lines, counted from 1."""
    lines = F.split(F.coalesce(F.col(text), F.lit("")), "\n")
    rows = docs.select(key, F.size(lines).cast("long").alias("total_lines"), F.slice(lines, (page - 1) * size + 1, size).alias("_p"))
    return rows.select(key, F.posexplode("_p").alias("_i", "line"), "total_lines").select(key, (F.col("_i") + (page - 1) * size).cast("long").alias("line_no"), "line", "total_lines", F.ceil(F.col("total_lines") / size).alias("total_pages"))


def blend(rows: DataFrame, outside: DataFrame, key: str, score: str = "score", share: float = 0.7) -> DataFrame:
    """Adds blended: outside scores of 0 to 10 weigh `share`, own ones the rest; without an outside score half the own."""
    both = rows.join(outside.select(key, F.col("outside").cast("double").alias("_o")), key, "left")
    return both.withColumn("blended", F.round(F.when(F.col("_o").isNotNull(), share * F.col("_o") / 10 + (1 - share) * F.col(score)).otherwise(0.5 * F.col(score)), 4)).drop("_o")
