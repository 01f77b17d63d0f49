"""Chunks by headers and keyword snippets: both are folds over one text's parts, kept inside expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_BLANK = " \t\r\n\f\x0b"
_HEADER = r"^[ \t]*(#{1,3})[ \t]+(\S.*)"

# What marks the places in a report that name its sponsor, place and sector.
KEYWORDS = (
    r"promovente[:\s]", r"solicitante[:\s]", r"raz[oó]n social[:\s]", r"nombre\s+de\s+la\s+empresa", r"responsable\s+del\s+proyecto",
    r"ubicad[oa]\s+en", r"municipio\s+de", r"localidad\s+de", r"sector\s+(productivo|econ[oó]mico)?",
    "Aguascalientes", "Baja California Sur", "Baja California", "Campeche", "Chiapas", "Chihuahua", "Coahuila", "Colima",
    "Ciudad de México", "Durango", "Guanajuato", "Guerrero", "Hidalgo", "Jalisco", "México", "Michoacán", "Morelos", "Nayarit",
    "Nuevo León", "Oaxaca", "Puebla", "Querétaro", "Quintana Roo", "San Luis Potosí", "Sinaloa", "Sonora", "Tabasco",
    "Tamaulipas", "Tlaxcala", "Veracruz", "Yucatán", "Zacatecas",
)


def strip(text: Column) -> Column:
    """Without white space at both ends."""
    return F.btrim(text, F.lit(_BLANK))


def sections(text: Column, least: int = 30) -> Column:
    """array<struct<section, body>>: bodies under H1 to H3 with the path of their headers; short bodies are left out.

    A text without such a body is one section; null gives one empty section.
    """
    whole = F.regexp_replace(F.coalesce(text, F.lit("")), r"\r\n?", "\n")
    parts = F.transform(F.split(whole, r"(?m)(?=^[ \t]*#{1,3}[ \t]+\S)", -1), lambda p: F.struct(F.length(F.regexp_extract(p, _HEADER, 1)).alias("level"), strip(F.regexp_extract(p, _HEADER, 2)).alias("title"), strip(F.regexp_replace(p, r"^[ \t]*#{1,3}[ \t]+\S.*", "")).alias("body")))

    def step(have: Column, part: Column) -> Column:
        level, title = part["level"], part["title"]
        one = F.when(level == 1, title).otherwise(have["one"])
        two = F.when(level == 1, "").when(level == 2, title).otherwise(have["two"])
        three = F.when((level == 1) | (level == 2), "").when(level == 3, title).otherwise(have["three"])
        path = F.array_join(F.filter(F.array(one, two, three), lambda t: t != ""), " > ")
        body = F.when(F.length(part["body"]) > least, F.array(F.struct(F.when(path == "", "Introducción / General").otherwise(path).alias("section"), part["body"].alias("body")))).otherwise(F.array().cast("array<struct<section:string,body:string>>"))
        return F.struct(one.alias("one"), two.alias("two"), three.alias("three"), F.concat(have["out"], body).alias("out"))

    start = F.struct(F.lit("").alias("one"), F.lit("").alias("two"), F.lit("").alias("three"), F.array().cast("array<struct<section:string,body:string>>").alias("out"))
    found = F.aggregate(parts, start, step, lambda s: s["out"])
    return F.when(F.size(found) > 0, found).otherwise(F.array(F.struct(F.lit("Documento Completo").alias("section"), strip(whole).alias("body"))))


def pack(body: Column, most: int = 1500, overlap: int = 200) -> Column:
    """Paragraphs packed into chunks of about `most` characters; a short last paragraph opens the next chunk again."""
    cut = lambda p: F.when(F.length(p) > most, F.transform(F.sequence(F.lit(0), F.floor((F.length(p) - 1) / (most - overlap)).cast("int")), lambda i: strip(F.substring(p, i * (most - overlap) + 1, F.lit(most))))).otherwise(F.array(p))
    paragraphs = F.filter(F.flatten(F.transform(F.split(body, "\n\n", -1), lambda p: cut(strip(p)))), lambda p: p != "")
    start = F.struct(F.array().cast("array<string>").alias("now"), F.lit(0).alias("size"), F.array().cast("array<array<string>>").alias("out"))

    def step(have: Column, p: Column) -> Column:
        full = (have["size"] + F.length(p) > most) & (F.size(have["now"]) > 0)
        last = F.try_element_at(have["now"], F.lit(-1))
        carry = F.length(last) < 2 * overlap
        now = F.when(full & carry, F.array(last, p)).when(full, F.array(p)).otherwise(F.concat(have["now"], F.array(p)))
        size = F.when(full & carry, F.length(last) + F.length(p)).when(full, F.length(p)).otherwise(have["size"] + F.length(p) + 2)
        return F.struct(now.alias("now"), size.alias("size"), F.when(full, F.concat(have["out"], F.array(have["now"]))).otherwise(have["out"]).alias("out"))

    packed = F.aggregate(paragraphs, start, step, lambda s: F.when(F.size(s["now"]) > 0, F.concat(s["out"], F.array(s["now"]))).otherwise(s["out"]))
    return F.when(F.length(body) <= most, F.array(body)).otherwise(F.transform(packed, lambda c: F.array_join(c, "\n\n")))


def chunk_by_headers(docs: DataFrame, key: str, text: str, most: int = 1500, overlap: int = 200) -> DataFrame:
    """(key, chunk, section_title, chunk_text): sections of a text, long ones in parts, each under its header path.

    No row leaves its partition. An empty or null text is one chunk without a body.
    """
    rows = docs.select(key, F.posexplode(sections(F.col(text))).alias("_s", "_x")).select(key, "_s", "_x.section", pack(F.col("_x.body"), most, overlap).alias("_c"))
    rows = rows.select(key, "_s", "section", F.size("_c").alias("_n"), F.posexplode("_c").alias("_i", "body"))
    title = F.when(F.col("_n") > 1, F.concat("section", F.lit(" (Parte "), (F.col("_i") + 1).cast("string"), F.lit(")"))).otherwise(F.col("section"))
    return rows.select(key, F.format_string("%06d.%06d", "_s", "_i").alias("chunk"), title.alias("section_title"), F.concat(F.lit("[Sección: "), "section", F.lit("]\n"), "body").alias("chunk_text"))


def targeted_snippet(text: Column, keywords: tuple[str, ...] = KEYWORDS, prefix: int = 2000, before: int = 60, after: int = 220, most: int = 5000) -> Column:
    """The start of a text and windows around keywords that overlap nothing taken so far; empty for null."""
    whole = F.coalesce(text, F.lit(""))
    pattern = "(?iu)(?:" + "|".join(keywords) + ")"
    pairs = F.arrays_zip(F.split(whole, pattern, -1).alias("gap"), F.regexp_extract_all(whole, F.lit(pattern), F.lit(0)).alias("hit"))
    start = F.struct(F.lit(0).alias("at"), F.lit(prefix).alias("end"), F.least(F.length(whole), F.lit(prefix)).alias("size"), F.array(F.substring(whole, 1, prefix)).alias("out"))

    def step(have: Column, pair: Column) -> Column:
        begin = have["at"] + F.length(pair["gap"])
        stop = begin + F.coalesce(F.length(pair["hit"]), F.lit(0))
        left, right = F.greatest(F.lit(0), begin - before), F.least(F.length(whole), stop + after)
        take = pair["hit"].isNotNull() & (left >= have["end"]) & (have["size"] < most)
        return F.struct(stop.alias("at"), F.when(take, right).otherwise(have["end"]).alias("end"), F.when(take, have["size"] + right - left).otherwise(have["size"]).alias("size"), F.when(take, F.concat(have["out"], F.array(F.substring(whole, left + 1, right - left)))).otherwise(have["out"]).alias("out"))

    return F.substring(F.array_join(F.aggregate(pairs, start, step, lambda s: s["out"]), "\n[...]\n"), 1, most)


def relevance(docs: DataFrame, key: str, text: str, words: list[str], most: int = 3) -> DataFrame:
    """(key, hits, excerpt) of the notes that contain most of the words; ties by key."""
    low = F.lower(F.coalesce(F.col(text), F.lit("")))
    hits = sum((F.when(low.contains(w.lower()), 1).otherwise(0) for w in words), F.lit(0))
    plain = F.filter(F.split(F.col(text), "\n"), lambda x: (strip(x) != "") & ~x.startswith("#"))
    excerpt = F.substring(F.array_join(F.transform(F.slice(plain, 1, 4), strip), " "), 1, 300)
    return docs.select(key, hits.cast("long").alias("hits"), text).where("hits > 0").orderBy(F.desc("hits"), key).limit(most).select(key, "hits", excerpt.alias("excerpt"))


def fallback_evaluation(text: Column) -> Column:
    """Title, summary, risk and confidence of a text that no model has read."""
    head = F.array_join(F.slice(F.split(F.coalesce(text, F.lit("")), "\n", -1), 1, 10), "\n")
    title = F.nullif(strip(F.regexp_extract(head, r"(?m)^# (.*)", 1)), F.lit(""))
    return F.struct(F.coalesce(title, F.lit("Proyecto")).alias("project_name"), F.substring(F.coalesce(text, F.lit("")), 1, 300).alias("summary"), F.lit("MEDIO").alias("legal_risk_level"), F.lit(0.7).alias("confidence_score"))


def concat_pages(pages: DataFrame, doc: str, page: str, text: str, separator: str = "\n\n") -> DataFrame:
    """(doc, pages, blank_pages, content): page texts in order under a title, with counts of pages and of those without text."""
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(page, F.coalesce(F.col(text), F.lit("")).alias("_t")))), lambda p: p["_t"]), separator)
    return pages.groupBy(doc).agg(F.count("*").alias("pages"), F.count_if(strip(F.coalesce(F.col(text), F.lit(""))) == "").alias("blank_pages"), F.concat(F.lit("# "), F.first(F.col(doc).cast("string")), F.lit("\n\n"), whole).alias("content"))


def labelled(text: Column, labels: dict[str, str]) -> Column:
    """struct of fields: what follows each label and a colon on its line, else the cell beside it in a two-cell table row."""
    row = lambda p: F.regexp_extract(text, rf"(?imu)^\s*\|\s*(?:{p})\s*\|\s*([^|\n]+?)\s*\|\s*$", 1)
    colon = lambda p: F.regexp_extract(text, rf"(?imu)(?:{p})\s*:[ \t]*\**[ \t]*([^\n|]+)", 1)
    return F.struct(*[F.coalesce(F.nullif(strip(row(p)), F.lit("")), F.nullif(strip(colon(p)), F.lit(""))).alias(n) for n, p in labels.items()])


def autotag(text: Column, rules: dict[str, str]) -> Column:
    """Sorted tags whose keyword a text contains in any case."""
    low = F.lower(F.coalesce(text, F.lit("")))
    return F.array_sort(F.array_distinct(F.array_compact(F.array(*[F.when(low.contains(word.lower()), F.lit(tag)) for word, tag in rules.items()]))))


def autolink(notes: DataFrame, key: str, text: str, known: DataFrame, target: str, pattern: str = r"\d{2}[A-Z]{2}\d{4}[A-Z]\d{4}") -> DataFrame:
    """(key, text): keys in a text that have a note become [[links]], each not yet linked. Keys are joined, never gathered.

    The text is cut at its keys; pieces carry a number and come together again, so a text costs one shuffle.
    """
    mark = rf"(?<!\[\[)\b({pattern})\b(?!\]\])"
    pieces = F.split(F.regexp_replace(F.coalesce(F.col(text), F.lit("")), mark, "\u0001$1\u0001"), "\u0001", -1)
    rows = notes.select(key, F.posexplode(pieces).alias("_i", "_p"))
    linked = rows.join(known.select(F.col(target).alias("_p"), F.lit(True).alias("_k")).distinct(), "_p", "left")
    piece = F.when(F.col("_k") & (F.col("_i") % 2 == 1), F.concat(F.lit("[["), "_p", F.lit("]]"))).otherwise(F.col("_p"))
    return linked.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_i", piece.alias("_t")))), lambda s: s["_t"]), "").alias(text))


def patch_frontmatter(note: Column, field: str, value: Column) -> Column:
    """The note with `field: value` at the end of its front matter, unless the field is there or there is no front matter."""
    front = F.regexp_extract(note, r"(?s)^---(.*?)---", 1)
    fits = note.rlike(r"(?s)^---.*?---") & ~front.contains(f"{field}:")
    return F.when(fits, F.concat(F.lit("---"), front, F.lit(f"\n{field}: "), value, F.substring(note, F.length(front) + 4, F.length(note)))).otherwise(note)
