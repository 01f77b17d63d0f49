"""Project records: filters, preferences, merges, contracts and audits around the warehouse and its notes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from acervo.functions.lookups import is_missing, is_mock_key

WRITE_WORDS = r"(?i)\b(insert|update|delete|drop|alter|create|truncate|grant|revoke)\b"


def guarded_select(spark: SparkSession, sql: str, tables: dict[str, DataFrame], most: int = 20) -> DataFrame:
    """The first rows of a SELECT over the given tables; any other statement is a ValueError."""
    import re

    if not re.match(r"(?i)\s*select\b", sql) or re.search(WRITE_WORDS, sql):
        raise ValueError("only SELECT statements are allowed")
    for name, frame in tables.items():
        frame.createOrReplaceTempView(name)
    return spark.sql(sql).limit(most)


def fresh(rows: DataFrame, expires: str, now: Column) -> DataFrame:
    """Rows that have not expired; rows without an expiry have."""
    return rows.where(F.col(expires) > now)


def still_valid(sources: DataFrame, derived: DataFrame, key: str, source_time: str, derived_time: str) -> DataFrame:
    """(key, valid): whether what was derived from each source is at least as new; false where nothing was derived."""
    newest = derived.groupBy(key).agg(F.max(derived_time).alias("_d"))
    return sources.join(newest, key, "left").select(key, F.coalesce(F.col("_d") >= F.col(source_time), F.lit(False)).alias("valid"))


def described(base: Column, parts: dict[str, tuple[Column, str]], default: str = "Sin descripción") -> Column:
    """base, or the default, with bar-joined `label: value` parts, each with its own default."""
    full = lambda c, d: F.coalesce(F.when(F.trim(c) != "", c), F.lit(d))
    return F.concat_ws(" | ", full(base, default), *[F.concat(F.lit(f"{label}: "), full(c, d)) for label, (c, d) in parts.items()])


def contained(names: DataFrame, name: str, permits: DataFrame, registration: str) -> DataFrame:
    """names joined with the permits whose trimmed lower-case registration stands anywhere in the lower-case name.

    A name is cut into its substrings of the lengths that registrations have, so this is an equality join. The lengths
    travel as one array of at most as many numbers as the longest registration has characters. Blank ones match nothing.
    """
    wanted = permits.withColumn("_r", F.lower(F.trim(registration))).where("_r <> ''")
    lengths = wanted.agg(F.collect_set(F.length("_r")).alias("_l"))
    low = F.lower(F.col(name))
    cuts = F.array_distinct(F.flatten(F.transform("_l", lambda n: F.when(F.length(low) >= n, F.transform(F.sequence(F.lit(1), F.length(low) - n + 1), lambda i: F.substring(low, i, n))).otherwise(F.array().cast("array<string>")))))
    return names.where(F.col(name).isNotNull()).crossJoin(F.broadcast(lengths)).withColumn("_r", F.explode(cuts)).drop("_l").join(wanted, "_r").drop("_r")


def first_profile(name: Column, profiles: list[tuple[str, str]]) -> Column:
    """The value of the first profile, in list order, whose name stands in the upper-case name; else null."""
    return F.coalesce(*[F.when(F.upper(name).contains(p.upper()), F.lit(v)) for p, v in profiles], F.lit(None).cast("string"))


def plain_id(value: Column) -> Column:
    """An id without its decimal part and blanks, as spreadsheets leave them."""
    return F.trim(F.split_part(value.cast("string"), F.lit("."), F.lit(1)))


def verdict_mismatches(warehouse: DataFrame, notes: DataFrame, key: str, verdict: str = "veredicto") -> DataFrame:
    """(key, in_warehouse, in_note) where they differ; a note's SINDICTAMEN stands for PENDIENTE. Keys without a note are left out."""
    said = F.when(F.upper(verdict) == "SINDICTAMEN", "PENDIENTE").otherwise(F.upper(verdict))
    return warehouse.select(key, F.upper(verdict).alias("in_warehouse")).join(notes.select(key, said.alias("in_note")), key).where("in_warehouse <> in_note")


def merge_truth(labelled: DataFrame, found: DataFrame, key: str, columns: list[str], placeholders: tuple[str, ...] = ("desconocido", "no especificado", "")) -> DataFrame:
    """All keys; a labelled value stays unless it is missing or a placeholder."""
    both = labelled.alias("a").join(found.alias("b"), key, "full")
    return both.select(key, *[F.when(is_missing(F.col(f"a.{c}"), placeholders), F.col(f"b.{c}")).otherwise(F.col(f"a.{c}")).alias(c) for c in columns])


def preferred(rows: DataFrame, key: str, kind: str, name: str, order: tuple[str, ...] = ("estudio", "resumen", "resolutivo")) -> DataFrame:
    """(key, kind, name): the first file by name of the best kind; kinds that are not listed don't count."""
    rank = F.array_position(F.array(*[F.lit(k) for k in order]), F.col(kind))
    best = rows.where(rank > 0).groupBy(key).agg(F.min(F.struct(rank.alias("r"), F.col(name).alias("n"), F.col(kind).alias("k"))).alias("_b"))
    return best.select(key, F.col("_b.k").alias("kind"), F.col("_b.n").alias("name"))


def listed_counts(listed: DataFrame, found: DataFrame, key: str) -> DataFrame:
    """(key, listed, n): rows found by key; a listed key without rows has 0, an unlisted one says so."""
    counts = found.groupBy(key).agg(F.count("*").alias("_n"))
    return listed.select(key, F.lit(True).alias("_l")).distinct().join(counts, key, "full").select(key, F.coalesce("_l", F.lit(False)).alias("listed"), F.coalesce("_n", F.lit(0)).alias("n"))


def collector_groups(projects: DataFrame, key: str, columns: dict[str, str]) -> DataFrame:
    """(kind, code, n, first_key, last_key) by state, sector and type: a summary, since a group's keys may be very many."""
    codes = F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.col(c).cast("string").alias("code")) for k, c in columns.items()]))
    return projects.select(key, codes.alias("_c")).groupBy("_c.kind", "_c.code").agg(F.count("*").alias("n"), F.min(key).alias("first_key"), F.max(key).alias("last_key"))


def hit_rate(rows: DataFrame, strategy: str, field: str, truth: str, snippet: str) -> DataFrame:
    """(strategy, field, samples, hits, pct): how often the snippet holds the truth; placeholder truths are left out."""
    valid = rows.where(~is_missing(F.col(truth)))
    return valid.groupBy(strategy, field).agg(F.count("*").alias("samples"), F.count_if(F.lower(snippet).contains(F.lower(truth))).alias("hits")).withColumn("pct", F.round(100.0 * F.col("hits") / F.col("samples"), 1))


def merge_other_source(old: DataFrame, new: DataFrame, key: str, source: str, value: str) -> DataFrame:
    """new rows of one source, and old rows of all others whose key new lacks."""
    return new.unionByName(old.where(~F.col(source).eqNullSafe(value)).join(new.select(key), key, "left_anti"))


def keep_refined(old: DataFrame, new: DataFrame, key: str, fill: str) -> DataFrame:
    """Old rows win; only a blank `fill` is taken from the new row of the same key."""
    both = old.withColumn("_old", F.lit(True)).alias("o").join(new.alias("n"), key, "full")
    pick = lambda c: F.when(F.col("o._old"), F.coalesce(F.when(F.trim(f"o.{c}") != "", F.col(f"o.{c}")), F.col(f"n.{c}")) if c == fill else F.col(f"o.{c}")).otherwise(F.col(f"n.{c}")).alias(c)
    return both.select(key, *[pick(c) for c in old.columns if c != key])


def or_default(rows: DataFrame, default: DataFrame) -> DataFrame:
    """rows, or the default rows where there are none: decided inside the plan."""
    any_ = rows.limit(1).agg((F.count("*") > 0).alias("_any"))
    return rows.unionByName(default.crossJoin(F.broadcast(any_)).where("NOT _any").drop("_any"))


def contracts(keys: DataFrame, metadata: DataFrame, texts: DataFrame, warehouse: DataFrame, notes: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """(key, dom, ocr, dw, vault): any field known; a text of 80 characters; a row; a note of more than 100 bytes."""
    full = lambda c: F.coalesce(F.col(c).cast("string") != "", F.lit(False))
    any_ = metadata.groupBy(key).agg(F.max(F.greatest(*[full(c) for c in fields], F.lit(False))).alias("dom"))
    text = texts.groupBy(key).agg(F.max(F.length(F.trim("text")) >= 80).alias("ocr"))
    row = warehouse.select(key, F.lit(True).alias("dw")).distinct()
    note = notes.groupBy(key).agg(F.max(F.octet_length("content") > 100).alias("vault"))
    out = keys.select(key).distinct()
    for part in (any_, text, row, note):
        out = out.join(part, key, "left")
    return out.select(key, *[F.coalesce(c, F.lit(False)).alias(c) for c in ("dom", "ocr", "dw", "vault")])


def remediation(rows: DataFrame, key: str, order: str, has_file: Column) -> DataFrame:
    """Adds reason: mock, no file, duplicate (a later row of a kept key), or null for rows to keep."""
    bad = F.when(is_mock_key(F.col(key)), "mock").when(~has_file, "no file")
    marked = rows.withColumn("_bad", bad)
    first = marked.where("_bad IS NULL").groupBy(key).agg(F.min(order).alias("_first"))
    return marked.join(first, key, "left").withColumn("reason", F.coalesce("_bad", F.when(F.col(order) != F.col("_first"), "duplicate"))).drop("_bad", "_first")


def note_state(projects: DataFrame, notes: DataFrame, key: str, least: int = 1000) -> DataFrame:
    """(key, state): missing, skeleton (at most `least` bytes) or detailed."""
    size = notes.groupBy(key).agg(F.max(F.octet_length("content")).alias("_s"))
    return projects.select(key).distinct().join(size, key, "left").select(key, F.when(F.col("_s").isNull(), "missing").when(F.col("_s") <= least, "skeleton").otherwise("detailed").alias("state"))


def assemble(keys: DataFrame, files: DataFrame, key: str, kind: str = "kind") -> DataFrame:
    """(key, files, status): the kinds on file, and Resuelto where all three or a ruling is there, else En evaluación."""
    order = ("estudio", "resumen", "resolutivo")
    flags = files.groupBy(key).agg(*[F.max(F.col(kind) == k).alias(f"_{k}") for k in order])
    out = keys.select(key).distinct().join(flags, key, "left")
    have = F.array_compact(F.array(*[F.when(F.col(f"_{k}"), F.lit(k)) for k in order]))
    return out.select(key, have.alias("files"), F.when(F.coalesce("_resolutivo", F.lit(False)), "Resuelto").otherwise("En evaluación").alias("status"))


def quarantine(rows: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """Adds reason: the first rule that a row breaks (a null verdict breaks it), or null. Callers split by it."""
    return rows.withColumn("reason", F.coalesce(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules.items()]))


def render_note(key: Column, title: Column, fields: dict[str, Column], links: list[Column]) -> Column:
    """A note: front matter of key and fields, a title and a list of [[links]]; null fields and links are left out."""
    front = F.concat_ws("\n", F.concat(F.lit("clave: "), key), *[F.concat(F.lit(f"{n}: "), c.cast("string")) for n, c in fields.items()])
    body = F.concat_ws("\n", *[F.concat(F.lit("- [["), c, F.lit("]]")) for c in links])
    return F.concat(F.lit("---\n"), front, F.lit("\n---\n# "), F.coalesce(title, key), F.lit("\n\n"), body, F.lit("\n"))


def citations(hits: DataFrame, query: str, rank: str, key: str, section: str, text: str, most: int = 10) -> DataFrame:
    """(query, context): tags and texts of each query's first `most` hits in rank order."""
    entry = F.struct(F.col(rank).alias("r"), F.concat(F.lit("["), F.col(key).cast("string"), F.lit(" | "), F.col(section).cast("string"), F.lit("]\n"), F.col(text)).alias("t"))
    return hits.where(F.col(rank) <= most).groupBy(query).agg(F.array_join(F.transform(F.array_sort(F.collect_list(entry)), lambda e: e["t"]), "\n\n").alias("context"))
