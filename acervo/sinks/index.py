"""A persistent index of chunks and their vectors, maintained by what changed."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from acervo.functions.scratch import kept
from acervo.operators.hybrid import hashed_vector
from acervo.operators.text import chunk_chars

SIZE = 128


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """(key, sha, chunk, body, vector, part) of an index."""
    return spark.read.parquet(path).where("key IS NOT NULL")


def update_index(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", parts: int = 64, size: int = SIZE) -> DataFrame:
    """Brings the index at `path` in line with docs; gives (state, n): the documents that are new, changed, invalid, same or gone.

    A document is indexed anew if the index lacks it, holds another digest of its text, or holds a vector of another length
    (invalid). Only those are chunked and embedded, and only the parts of the index that hold them or what is gone are written, by
    dynamic partition overwrite: a part is a hash of the key. `parts` must stay the same for the life of an index. Blank and null texts
    have no chunks: they count as not there. Of rows that repeat a key, that with the greatest digest counts; rows without a key
    don't. A repeated or interrupted update ends in the same index.
    """
    spark = docs.sparkSession
    part = F.pmod(F.xxhash64("key"), F.lit(parts)).cast("int")
    now = docs.where(F.col(key).isNotNull() & (F.trim(F.col(text)) != "")).select(F.col(key).cast("string").alias("key"), F.sha2(F.col(text).cast("binary"), 256).alias("sha"))
    now = now.groupBy("key").agg(F.max("sha").alias("sha"))
    try:
        held = read_index(spark, path)
    except AnalysisException:
        held = spark.createDataFrame([], "key string, sha string, chunk long, body string, vector array<double>, part int")
    was = held.groupBy("key").agg(F.max("sha").alias("old"), F.bool_and(F.size("vector") == size).alias("fits"))
    state = F.when(F.col("old").isNull(), "new").when(F.col("sha").isNull(), "gone").when(~F.col("fits"), "invalid").when(F.col("sha") == F.col("old"), "same").otherwise("changed")
    states = kept(now.join(was, "key", "full").select("key", "sha", state.alias("state")))

    changes = states.where("state <> 'same'").withColumn("part", part)
    touched = [r["part"] for r in changes.select("part").distinct().collect()]  # `parts` at most
    if touched:
        fresh = docs.select(F.col(key).cast("string").alias("key"), F.col(text).alias("text")).withColumn("sha", F.sha2(F.col("text").cast("binary"), 256))
        fresh = fresh.join(changes.where("state <> 'gone'").select("key", "sha"), ["key", "sha"], "left_semi").dropDuplicates(["key", "sha"])
        pieces = chunk_chars(fresh.select(F.struct("key", "sha").alias("k"), "text"), "k", "text").select("k.key", "k.sha", "chunk", "body")
        pieces = pieces.withColumn("vector", hashed_vector(F.col("body"), size)).withColumn("part", part)
        stay = held.where(F.col("part").isin(touched)).join(changes.select("key"), "key", "left_anti").select("key", "sha", "chunk", "body", "vector", "part")
        # a row without a key in each part that is written, so that a part whose documents are all gone is overwritten too
        marks = changes.select("part").distinct().selectExpr("CAST(NULL AS STRING) AS key", "CAST(NULL AS STRING) AS sha", "CAST(NULL AS LONG) AS chunk", "CAST(NULL AS STRING) AS body", "CAST(NULL AS ARRAY<DOUBLE>) AS vector", "part")
        rows = pieces.union(stay).union(marks).repartition("part")
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("part").parquet(path)
    return states.groupBy("state").agg(F.count("*").alias("n"))
