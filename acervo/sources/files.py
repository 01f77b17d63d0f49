"""File sources with declared schemas; bad rows are left out, not guessed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from acervo.operators.files import source_tag

REPORT = "clave string, project_name string, nombre_proyecto string, promovente string, municipio string, veredicto string, score double, confianza_pct int"


def _named(frame: DataFrame) -> DataFrame:
    """Adds name, stem, folder and mtime of the file each row comes from."""
    parts = F.split(F.col("_metadata.file_path"), "/")
    return frame.select("*", F.col("_metadata.file_name").alias("name"), F.regexp_replace("_metadata.file_name", r"\.[^.]*$", "").alias("stem"), F.element_at(parts, -2).alias("folder"), F.col("_metadata.file_modification_time").alias("mtime"))


def read_documents(spark: SparkSession, path: str, glob: str = "*.md") -> DataFrame:
    """(content, name, stem, folder, mtime): one row a text file."""
    files = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", glob).text(path, wholetext=True)
    return _named(files.withColumnRenamed("value", "content"))


def read_reports(spark: SparkSession, path: str) -> DataFrame:
    """One row a JSON report; the key is its clave or the file's stem, upper-cased; unreadable files are skipped."""
    rows = _named(spark.read.schema(REPORT).json(path, multiLine=True, mode="DROPMALFORMED"))
    name = F.coalesce(F.nullif("project_name", F.lit("")), "nombre_proyecto")
    return rows.select(F.upper(F.coalesce(F.nullif("clave", F.lit("")), "stem")).alias("clave"), name.alias("project_name"), "promovente", "municipio", "veredicto", "score", "confianza_pct")


def list_corpus(spark: SparkSession, path: str, glob: str = "*.pdf") -> DataFrame:
    """(path, name, folder, size, size_mb, mtime) of files; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(path)
    parts = F.split("path", "/")
    return files.select("path", F.element_at(parts, -1).alias("name"), F.element_at(parts, -2).alias("folder"), F.col("length").alias("size"), F.round(F.col("length") / 1e6, 2).alias("size_mb"), F.col("modificationTime").alias("mtime"))


def read_event_log(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines; bad lines are skipped."""
    return spark.read.schema(schema).json(path, mode="DROPMALFORMED")


def read_permits(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Latin-1 CSV with a header."""
    return spark.read.schema(schema).csv(path, header=True, encoding="ISO-8859-1")


def read_key_registry(spark: SparkSession, path: str) -> DataFrame:
    """(clave, year, source, file, name, location, promovente) of CSV registries with six or seven fields a row.

    Six fields have no source: it is told from the file. Rows below three fields are skipped; of a key the row of the
    last file by name counts.
    """
    # A row shorter than the schema is kept whole in _short, which tells six fields from seven with an empty last one.
    raw = spark.read.schema(", ".join(f"c{i} string" for i in range(1, 8)) + ", _short string").csv(path, columnNameOfCorruptRecord="_short")
    seven = F.col("_short").isNull() | F.col("c7").isNotNull()
    pick = lambda a, b: F.when(seven, F.col(a)).otherwise(F.col(b))
    full = lambda c, d: F.coalesce(F.when(F.trim(c) != "", F.trim(c)), d)
    clave, file = F.upper(F.trim("c1")), pick("c4", "c3")
    rows = raw.where("_short IS NULL OR _short LIKE '%,%,%'").where(F.upper(F.trim("c1")) != "CLAVE").select(clave.alias("clave"), F.expr("try_cast(trim(c2) AS int)").alias("year"), F.when(seven, F.col("c3")).otherwise(source_tag(file)).alias("source"), full(file, F.lit("")).alias("file"), full(pick("c5", "c4"), F.concat(F.lit("Proyecto "), clave)).alias("name"), full(pick("c6", "c5"), F.lit("")).alias("location"), full(pick("c7", "c6"), F.lit("Desconocido")).alias("promovente"), F.col("_metadata.file_name").alias("_f"))
    columns = [c for c in rows.columns if c not in ("clave", "_f")]
    return rows.groupBy("clave").agg(F.max(F.struct("_f", *columns)).alias("_r")).select("clave", *[f"_r.{c}" for c in columns])


def read_warehouse(spark: SparkSession, path: str, tables: tuple[str, ...]) -> dict[str, DataFrame]:
    """Parquet tables of a folder by name."""
    return {t: spark.read.parquet(f"{path}/{t}") for t in tables}


def read_warehouse_jdbc(spark: SparkSession, url: str, table: str, column: str, lower: int, upper: int, partitions: int, **options: str) -> DataFrame:
    """A database table, read in ranges of a numeric column by several tasks."""
    return spark.read.format("jdbc").options(url=url, dbtable=table, partitionColumn=column, lowerBound=lower, upperBound=upper, numPartitions=partitions, **options).load()


def read_mixed_projects(spark: SparkSession, path: str, pattern: str = r"\d{2}[A-Z]{2}\d{4}[A-Z0-9]+") -> DataFrame:
    """(clave, project_name, promovente) of JSON and Markdown project files; Markdown gives its first key and first plain line."""
    reports = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.json").schema(REPORT).json(path, multiLine=True, mode="DROPMALFORMED")
    full = lambda c: F.nullif(F.trim(c), F.lit(""))
    left = reports.select(F.upper(full("clave")).alias("clave"), F.coalesce(full("project_name"), full("nombre_proyecto")).alias("project_name"), full("promovente").alias("promovente"))
    first = F.try_element_at(F.filter(F.split("content", "\n"), lambda x: F.trim(x) != ""), F.lit(1))
    right = read_documents(spark, path).select(full(F.regexp_extract(F.upper("content"), f"({pattern})", 1)).alias("clave"), F.substring(F.btrim(first, F.lit("# \r")), 1, 150).alias("project_name"), F.lit(None).cast("string").alias("promovente"))
    return left.unionByName(right).where("clave IS NOT NULL")


def read_ground_truth(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Labelled records of a JSON array."""
    return spark.read.schema(schema).json(path, multiLine=True)
