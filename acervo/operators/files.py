"""What file names and histories say: source, category, year, type, version, and which file counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from acervo.functions.lookups import SECTORS, STATES, TYPES, lookup

KIND_RANK = ("estudio", "resumen", "resolutivo")


def source_tag(path: Column) -> Column:
    """ASEA where the path names it, else SEMARNAT (also for null)."""
    return F.when(F.lower(path).contains("asea"), "ASEA").otherwise("SEMARNAT")


def is_gazette(name: Column) -> Column:
    return F.coalesce(F.lower(name).contains("gaceta") | name.startswith("ASEA_"), F.lit(False))


def category(name: Column) -> Column:
    """Document kind by the first keyword in the name."""
    low = F.lower(name)
    return F.when(low.rlike("estudio|mia"), "estudio").when(low.contains("resumen"), "resumen").when(low.rlike("resolutivo|resolucion"), "resolutivo").when(low.contains("gaceta"), "gaceta").otherwise("desconocido")


def classify(rows: DataFrame, path: str) -> DataFrame:
    """Adds item, what a file's name tells: key, source, sector, state, year, type, sequence and category.

    A project key comes first, then a numbered gazette; other names keep their stem as the key.
    """
    name = F.coalesce(F.element_at(F.split(F.col(path), "/"), -1), F.lit(""))
    stem = F.upper(F.split_part(name, F.lit("."), F.lit(1)))
    ok = stem.rlike(r"^\d{2}[A-Z]{2}\d{4}[A-Z]\d{3,5}$")
    number, of_year = [F.regexp_extract(name, r"(?i)(?:asea.*gaceta|gaceta.*asea).*?(\d+)[-_](\d{4})", i) for i in (1, 2)]
    gazette, padded = number != "", F.when(F.length(number) < 2, F.lpad(number, 2, "0")).otherwise(number)
    part = lambda a, n: F.substring(stem, a, n)
    pick = lambda a, b, other=None: F.when(ok, a).when(gazette, b).otherwise(F.lit(other))
    named = lambda code, table, word: F.when(lookup(code, table) == code, F.concat(F.lit(word), code)).otherwise(lookup(code, table))
    item = F.struct(
        pick(stem, F.concat(F.lit("ASEA-GACETA-"), padded, F.lit("-"), of_year)).alias("_k"), ok.alias("valid"), pick(source_tag(F.col(path)), F.lit("ASEA")).alias("_s"),
        pick(part(1, 2), F.lit("21")).alias("sector_code"), pick(named(part(1, 2), SECTORS, "Sector "), F.lit("Sector Hidrocarburos"), "Desconocido").alias("sector_name"),
        pick(part(3, 2), F.lit("MG")).alias("state_code"), pick(lookup(part(3, 2), STATES), F.lit("Nacional/Marino"), "Desconocido").alias("state_name"),
        pick(part(5, 4), of_year).cast("int").alias("year"), pick(part(9, 1), F.lit("GACETA")).alias("type_code"),
        pick(named(part(9, 1), TYPES, "Tipo "), F.lit("Gaceta Informativa ASEA"), "Desconocido").alias("type_name"),
        pick(F.regexp_extract(stem, r"(\d{3,5})$", 1), number).alias("sequence"), pick(category(name), F.lit("gaceta")).alias("_c"),
    )
    item = item.withField("clave", F.coalesce(item["_k"], stem)).withField("source", F.coalesce(item["_s"], source_tag(F.col(path)))).withField("category", F.coalesce(item["_c"], category(name)))
    return rows.withColumn("item", item.dropFields("_k", "_s", "_c"))


def year_from_name(name: Column) -> Column:
    """The first year 20xx, else a two-digit year right before .pdf, else null."""
    full, short = F.regexp_extract(name, r"(20\d{2})", 1), F.regexp_extract(F.lower(name), r"-(\d{2})\.pdf$", 1)
    return F.when(full != "", F.nullif(full, F.lit("")).cast("int")).when(short != "", F.nullif(short, F.lit("")).cast("int") + 2000)


def type_and_version(name: Column) -> tuple[Column, Column]:
    """kind and version of `{key}.{kind}.{NN}.ext`; version is null where it is no number."""
    return F.nullif(F.split_part(name, F.lit("."), F.lit(2)), F.lit("")), F.nullif(F.regexp_extract(name, r"^[^.]*\.[^.]*\.(\d{1,9})\.", 1), F.lit("")).cast("int")


def best_extraction(rows: DataFrame, key: str, kind: str = "kind", version: str = "version") -> DataFrame:
    """One row for each key: study before summary before ruling before others, then the highest version.

    A maximum of structs combines on the map side, so a key with many files costs no sort.
    """
    rank = F.when(F.col(kind).isin(*KIND_RANK), -F.array_position(F.array(*[F.lit(k) for k in KIND_RANK]), F.col(kind))).otherwise(-len(KIND_RANK) - 1)
    best = F.max(F.struct(rank.alias("_r"), F.coalesce(F.col(version), F.lit(-1)).alias("_v"), F.struct(*rows.columns).alias("row")))
    return rows.groupBy(key).agg(best.alias("_b")).select("_b.row.*")


def positional_type(rows: DataFrame, key: str, order: list[str], name: str = "name") -> DataFrame:
    """Adds kind to the valid files of a batch: a keyword in the name wins, else the place among the batch's files."""
    w = Window.partitionBy(key)
    named = F.when(F.lower(name).contains("resumen"), "resumen").when(F.lower(name).contains("estudio"), "estudio").when(F.lower(name).contains("resolutivo"), "resolutivo")
    at = lambda *kinds: F.try_element_at(F.array(*[F.lit(k) for k in kinds]), F.col("_i"))
    place = F.when(F.col("_n") == 1, "estudio").when(F.col("_n") == 2, at("resumen", "resolutivo")).when(F.col("_n") == 3, at("resumen", "estudio", "resolutivo")).otherwise("resumen")
    counted = rows.withColumn("_n", F.count("*").over(w)).withColumn("_i", F.row_number().over(w.orderBy(*order)))
    return counted.withColumn("kind", F.coalesce(named, place)).drop("_n", "_i")


def version_suffix(rows: DataFrame, name: str, digest: str, order: str) -> DataFrame:
    """(name, digest, first, stored_name): each new content of a name gets _v2, _v3 and so on by arrival; repeats go."""
    first = rows.groupBy(name, digest).agg(F.min(order).alias("first"))
    n = F.row_number().over(Window.partitionBy(name).orderBy("first", digest))
    stem, ext = F.regexp_extract(name, r"^(.*?)(\.[^.]*)?$", 1), F.regexp_extract(name, r"^(.*?)(\.[^.]*)?$", 2)
    return first.withColumn("_n", n).select(name, digest, "first", F.when(F.col("_n") == 1, F.col(name)).otherwise(F.concat(stem, F.lit("_v"), F.col("_n").cast("string"), ext)).alias("stored_name"))


def last_events(rows: DataFrame, keys: list[str], kind: str, kinds: tuple[str, ...], order: list[Column], n: int) -> DataFrame:
    """The last n events of the given kinds for each key, with their place counted from the end."""
    return rows.where(F.col(kind).isin(*kinds)).withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)).cast("long")).where(F.col("place") <= n)


def verify(size: Column, head: Column, text: Column, name: Column, expected: Column, least: int = 5120) -> Column:
    """Status of a downloaded file from its size, first characters, first page's text and expected key."""
    seen = F.upper(F.coalesce(text, F.lit(""))).contains(expected) | F.upper(name).contains(expected)
    return F.when(size < least, "EMPTY").when(~F.coalesce(head.startswith("%PDF-"), F.lit(False)), "CORRUPT").when(F.trim(F.coalesce(text, F.lit(""))) == "", "VERIFIED_NO_TEXT").when(expected.isNotNull() & ~seen, "MISMATCH").otherwise("VERIFIED")


def manifest_health(rows: DataFrame, status: str = "status") -> DataFrame:
    """One row: total, verified, corrupt and the verified share in per cent (100 when there are no files)."""
    good, bad = F.count_if(F.col(status).startswith("VERIFIED")), F.count_if(F.col(status).isin("CORRUPT", "EMPTY", "MISMATCH"))
    return rows.agg(F.count("*").alias("total"), good.alias("verified"), bad.alias("corrupt"), F.coalesce(F.round(F.try_divide(100.0 * good, F.count("*")), 1), F.lit(100.0)).alias("pct"))


def index_changes(old: DataFrame, new: DataFrame, key: str, digest: str = "sha") -> DataFrame:
    """(key, state): new, changed, same or gone, by comparing digests."""
    both = old.select(key, F.col(digest).alias("_old")).join(new.select(key, F.col(digest).alias("_new")), key, "full")
    return both.select(key, F.when(F.col("_old").isNull(), "new").when(F.col("_new").isNull(), "gone").when(F.col("_old") == F.col("_new"), "same").otherwise("changed").alias("state"))
