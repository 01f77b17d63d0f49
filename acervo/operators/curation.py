"""Curation of downloads and projects: files verified on their bytes, manifest, attempt ledger, remediation, assembled records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from acervo.functions.lookups import is_mock_key
from acervo.operators.keys import parse_key

PDF = b"%PDF-"
KEY_IN_TEXT = r"(?<![A-Z0-9])(\d{2}[A-Z]{2}\d{4}[A-Z0-9]\d{3,5})(?![A-Z0-9])"
#: Parts that the rows of one digest are dealt to.
SALTS = 16


def verify_files(files: DataFrame, pages: DataFrame, least: int = 5120) -> DataFrame:
    """(path, clave, status, valid, sha256, file_size, page_count, found_keys) of each row of files (path, length, content, clave).

    pages has one row for each file that a reader could open: (path, page_count, encrypted, text), the text of page 1. The
    first rule that holds decides: no length MISSING, under `least` bytes EMPTY, no PDF header CORRUPT, not among pages
    CORRUPT, encrypted ENCRYPTED, no pages EMPTY, blank text VERIFIED_NO_TEXT, expected key neither on page 1 nor in the
    file's name MISMATCH, else VERIFIED. The last three are valid. A null or empty clave is expected nowhere. Contents are
    reduced to header and digest before the join; files too small or without a header have no digest.
    """
    whole = (F.col("length") >= least) & (F.substring("content", 1, len(PDF)) == F.lit(bytearray(PDF)))
    rows = files.select("path", "clave", F.col("length").alias("file_size"), F.coalesce(whole, F.lit(False)).alias("_whole"), F.when(whole, F.sha2("content", 256)).alias("sha256"))
    seen = pages.select("path", "page_count", "encrypted", F.trim(F.regexp_replace("text", r"^\s+|\s+$", "")).alias("_text"), F.lit(True).alias("_open"))
    text, key = F.coalesce("_text", F.lit("")), F.col("clave")
    found = F.regexp_extract_all(text, F.lit(KEY_IN_TEXT), 1)
    here = F.array_contains(found, key) | F.contains(F.regexp_extract("path", r"[^/]*$", 0), key)
    status = (
        F.when(F.col("file_size").isNull(), "MISSING")
        .when(F.col("file_size") < least, "EMPTY")
        .when(~F.col("_whole") | F.col("_open").isNull(), "CORRUPT")
        .when(F.col("encrypted"), "ENCRYPTED")
        .when(F.coalesce("page_count", F.lit(0)) == 0, "EMPTY")
        .when(text == "", "VERIFIED_NO_TEXT")
        .when((key != "") & ~here, "MISMATCH")
        .otherwise("VERIFIED")
    )
    out = rows.join(seen, "path", "left").withColumn("status", status)
    read = F.col("status").isin("VERIFIED", "VERIFIED_NO_TEXT", "MISMATCH")
    return out.select("path", "clave", "status", read.alias("valid"), "sha256", "file_size", F.when(read, F.col("page_count")).alias("page_count"), F.when(read, found).otherwise(F.array().cast("array<string>")).alias("found_keys"))


def upsert_manifest(old: DataFrame, found: DataFrame, now: Column) -> DataFrame:
    """The manifest (path, clave, file_type, status, sha256, file_size, page_count, verified_at) after the files of found were verified.

    A known path keeps its clave and file_type and takes all else from found; both have one row a path. Absent digests
    become empty and absent numbers 0. Null paths match none.
    """
    fresh = found.select("path", F.coalesce("status", F.lit("CORRUPT")).alias("status"), F.coalesce("sha256", F.lit("")).alias("sha256"), F.coalesce("file_size", F.lit(0)).cast("long").alias("file_size"), F.coalesce("page_count", F.lit(0)).cast("int").alias("page_count"), now.alias("verified_at"), F.lit(True).alias("hit"), "clave", "file_type")
    both = old.withColumn("hit", F.lit(True)).alias("o").join(fresh.alias("n"), "path", "full")
    take = lambda c: F.when(F.col("n.hit"), F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")).alias(c)
    keep = lambda c: F.when(F.col("o.hit"), F.col(f"o.{c}")).otherwise(F.col(f"n.{c}")).alias(c)
    return both.select("path", keep("clave"), keep("file_type"), *[take(c) for c in ("status", "sha256", "file_size", "page_count", "verified_at")])


def manifest_totals(manifest: DataFrame) -> DataFrame:
    """One row: total, verified (with text and the right key), corrupt and the verified share in per cent, 100 without files."""
    good, bad = F.count_if(F.col("status") == "VERIFIED"), F.count_if(F.col("status").isin("CORRUPT", "EMPTY", "MISMATCH"))
    return manifest.agg(F.count("*").alias("total"), good.alias("verified"), bad.alias("corrupt"), F.coalesce(F.round(F.try_divide(100.0 * good, F.count("*")), 1), F.lit(100.0)).alias("health_pct"))


def record_attempts(ledger: DataFrame, attempts: DataFrame) -> DataFrame:
    """The ledger (clave, status, attempts, last_try, files) after more attempts (clave, status, at, files), with done beside it.

    The last attempt by time decides status and files (of those at one time, the greatest status, then files), and
    comes after all that the ledger holds. Attempts are counted before the join. Rows without a key are left out.
    """
    last = attempts.where("clave IS NOT NULL").groupBy("clave").agg(F.max(F.struct("at", "status", "files")).alias("last"), F.count("*").alias("n"))
    both = ledger.where("clave IS NOT NULL").alias("o").join(last, "clave", "full")
    take = lambda new, c: F.when(F.col("n").isNotNull(), F.col(f"last.{new}")).otherwise(F.col(f"o.{c}"))
    status = take("status", "status")
    return both.select("clave", status.alias("status"), (F.coalesce("o.attempts", F.lit(0)) + F.coalesce("n", F.lit(0))).cast("long").alias("attempts"), take("at", "last_try").alias("last_try"), take("files", "files").alias("files"), F.coalesce(status == "done", F.lit(False)).alias("done"))


def files_of_keys(keys: DataFrame, files: DataFrame, key: str = "clave", name: str = "name", shortest: int = 12, longest: int = 14) -> DataFrame:
    """Rows of files with the key that their name starts with, once for each such key.

    Names are joined on their prefixes of the lengths that keys have, `shortest` to `longest`, and on all before the
    first dot, so no range of keys is scanned; a key of another length has files of its own name only.
    """
    stem = F.split_part(F.col(name), F.lit("."), F.lit(1))
    starts = F.array_distinct(F.array(stem, *[F.substring(name, 1, n) for n in range(shortest, longest + 1)]))
    return files.withColumn(key, F.explode(starts)).join(keys.select(key).where(F.col(key) != "").distinct(), key, "left_semi")


def remediate_files(files: DataFrame, name: str, digest: str, order: str) -> DataFrame:
    """Adds reason: version (a `_v` copy of a PDF or extract), repeated (a PDF whose digest an earlier one by `order` has), or null.

    Version copies go first and hide no other file. Rows without a digest repeat none. Digests are counted before the
    join, and each repeated one is dealt to several parts, so a digest that most files share is no single task's work.
    """
    copy = F.col(name).rlike(r"_v[^/]*\.(pdf|md)$")
    marked = files.withColumns({"_copy": F.coalesce(copy, F.lit(False)), "_salt": F.pmod(F.xxhash64(order), F.lit(SALTS))})
    pdfs = marked.where(~F.col("_copy") & F.col(name).endswith(".pdf") & F.col(digest).isNotNull())
    first = pdfs.groupBy(digest).agg(F.min(order).alias("_first"), F.count("*").alias("_n")).where("_n > 1")
    first = first.select(digest, "_first", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))).alias("_salt"))
    again = F.col(name).endswith(".pdf") & (F.col(order) > F.col("_first"))
    return marked.join(first, [digest, "_salt"], "left").select(*[F.col(c) for c in files.columns], F.when(F.col("_copy"), "version").when(again, "repeated").alias("reason"))


def remediate_projects(projects: DataFrame, files: DataFrame, name: str = "name") -> DataFrame:
    """projects (clave, state, year and others) with reason (mock, no file, or null for those that stay), state_fixed and year_fixed.

    A file counts for a key that its name starts with. Where the key is well formed, a missing state is read from it, and
    so is a year that differs or is missing; rows that go keep what they had. Rows without a key have no file.
    """
    have = files_of_keys(projects, files, name=name).select("clave").distinct().withColumn("_file", F.lit(True))
    key = parse_key(projects.select("clave").where("clave IS NOT NULL").distinct(), "clave").where("valid").select("clave", F.col("state_name").alias("_state"), F.col("key_year").alias("_year"))
    rows = projects.join(have, "clave", "left").join(key, "clave", "left")
    reason = F.when(is_mock_key(F.col("clave")), "mock").when(F.col("_file").isNull(), "no file")
    rows = rows.withColumn("reason", reason)
    blank = F.coalesce(F.lower(F.trim("state")).isin("desconocido", "desconocida", "", "none"), F.lit(True))
    fix = F.col("reason").isNull() & F.col("_state").isNotNull()
    state, year = fix & blank, fix & ~F.col("year").eqNullSafe(F.col("_year"))
    own = [c for c in projects.columns if c not in ("state", "year")]
    return rows.select(*own, F.when(state, F.col("_state")).otherwise(F.col("state")).alias("state"), F.when(year, F.col("_year")).otherwise(F.col("year")).alias("year"), "reason", state.alias("state_fixed"), year.alias("year_fixed"))


def remediation_counts(rows: DataFrame) -> DataFrame:
    """One row over remediate_projects: purged, states_fixed, years_fixed."""
    return rows.agg(F.count("reason").alias("purged"), F.count_if("state_fixed").alias("states_fixed"), F.count_if("year_fixed").alias("years_fixed"))


def assemble_records(keys: DataFrame, files: DataFrame, listed: DataFrame, reports: DataFrame) -> DataFrame:
    """One row for each key that has a download or an extract: the project's columns and, beside them, its evaluation's.

    files are (name, kind), of kind resumen, estudio, resolutivo or extraccion, and belong to keys that their names start
    with. The status is Resuelto with all three downloads or a ruling named by the key alone. The name comes from the report, else
    from the list (listed: clave, project_name, location, promovente), else from the key; the state from the list, else
    from the key; a sponsor that no list has is Desconocido. Without a report (reports: clave, project_name, veredicto,
    score, confianza_pct, knockouts, yes_signals, no_signals, condicionantes, the last four arrays) the evaluation is
    PENDIENTE with zeros and empty lists. Mock keys, null keys and keys without files go. listed and reports have one row a key.
    """
    wanted = keys.select("clave").where(F.col("clave").isNotNull() & ~is_mock_key(F.col("clave"))).distinct()
    kinds, signals = ("resumen", "estudio", "resolutivo"), ("knockouts", "yes_signals", "no_signals", "condicionantes")
    ends = F.when(F.col("kind") == "extraccion", F.col("name").endswith(".md")).otherwise(F.col("name").endswith(".pdf"))
    flags = files_of_keys(wanted, files.where(ends & F.col("kind").isin(*kinds, "extraccion"))).groupBy("clave").agg(*[F.max(F.col("kind") == k).alias(f"_{k}") for k in kinds], F.max((F.col("kind") == "resolutivo") & (F.col("name") == F.concat("clave", F.lit(".pdf")))).alias("_ruling"))
    parsed = parse_key(flags, "clave")
    full = lambda c: F.when(F.col(c) != "", F.col(c))
    rows = parsed.join(listed.select("clave", F.col("project_name").alias("_name"), "location", F.col("promovente").alias("_sponsor")), "clave", "left")
    rows = rows.join(reports.select("clave", F.col("project_name").alias("_title"), "veredicto", "score", "confianza_pct", *signals), "clave", "left")
    have = F.array_compact(F.array(*[F.when(F.col(f"_{k}"), F.lit(k)) for k in kinds]))
    return rows.select(
        "clave", F.coalesce("_title", "_name", F.concat(F.lit("Proyecto "), F.col("clave"))).alias("project_name"),
        F.when((F.size(have) == len(kinds)) | F.col("_ruling"), "Resuelto").otherwise("En evaluación").alias("status"), "sector",
        F.coalesce(full("location"), "state_name").alias("state"), F.col("key_year").alias("year"), have.alias("files_downloaded"), F.coalesce(full("_sponsor"), F.lit("Desconocido")).alias("promovente"),
        F.coalesce("veredicto", F.lit("PENDIENTE")).alias("veredicto"), F.coalesce("score", F.lit(0.0)).alias("score"), F.coalesce("confianza_pct", F.lit(0)).alias("confianza_pct"),
        *[F.coalesce(c, F.array().cast("array<string>")).alias(c) for c in signals],
    )
