"""Project keys: parsing, extraction from text, and one row for each key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from acervo.functions.lookups import STATES, STRICT_KEY, TYPES, lookup


def parse_key(rows: DataFrame, column: str) -> DataFrame:
    """Adds sector, state, state_name, key_year, kind, kind_name, seq and valid, read from the stem before the first dot."""
    stem = F.upper(F.split_part(F.col(column), F.lit("."), F.lit(1)))
    valid = stem.rlike(STRICT_KEY)
    part = lambda a, n: F.when(valid, F.substring(stem, a, n))
    return rows.withColumns({"valid": F.coalesce(valid, F.lit(False)), "sector": part(1, 2), "state": part(3, 2), "state_name": lookup(part(3, 2), STATES), "key_year": part(5, 4).cast("int"), "kind": part(9, 1), "kind_name": lookup(part(9, 1), TYPES), "seq": part(10, 4)})


def extract_keys(docs: DataFrame, id_column: str, text_column: str, pattern: str = r"(?<![A-Z0-9])(\d{2}[A-Z]{2}\d{4}[A-Z0-9]\d{3,5})(?![A-Z0-9])") -> DataFrame:
    """(id_column, clave): distinct keys in the upper-cased text of each document."""
    found = F.array_distinct(F.regexp_extract_all(F.upper(F.col(text_column)), F.lit(pattern), 1))
    return docs.select(id_column, F.explode(found).alias("clave"))


def keep_one(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in the given order."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")


def pending_keys(known: DataFrame, extracted: DataFrame, done: DataFrame, key: str = "clave") -> DataFrame:
    """Keys known or extracted that are not done."""
    return known.select(key).union(extracted.select(key)).distinct().join(done.select(key), key, "left_anti")


def link_sources(found: DataFrame, projects: DataFrame, source: str, key: str = "clave") -> DataFrame:
    """(key, origin, mentions): the last document by name that mentions each known project."""
    return found.join(projects.select(key).distinct(), key, "left_semi").groupBy(key).agg(F.max(source).alias("origin"), F.count("*").alias("mentions"))
