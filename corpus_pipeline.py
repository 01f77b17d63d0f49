"""A corpus pipeline of five of the training-data operators; each stage works on what its predecessor kept."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from acervo.llm._text import kept, shared_folder
from acervo.llm.decontaminate import decontaminate
from acervo.llm.line_dedup import line_dedup
from acervo.llm.mixing import mix
from acervo.llm.ngram_jaccard import ngram_jaccard
from acervo.llm.quality import fit_quality, score_rows

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Score from which the classifier accepts a text, as in `quality`.
THRESHOLD = 0.7


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose text the quality classifier accepts, whatever their id; rows without an id too. A null text is scored as empty."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return score_rows(docs, fit_quality(docs, labels), COLUMNS).where(F.col("score") >= THRESHOLD).select(COLUMNS)


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of rows that share 0.8 or more of their five-word n-grams: that with the smallest id, then the
    smallest hash of id and text; rows without an id come last. Of rows that repeat id and text one stays. Null and blank
    texts have no n-grams, so they are like no other row: all of them stay, but for repeats of id and text."""
    keyed = docs.withColumn("_key", F.xxhash64("doc_id", F.col("doc_id").isNull(), "text", F.col("text").isNull()))
    groups = ngram_jaccard(keyed.select("_key", "text"), id_column="_key", ngram=5, percent=80, links=False).groupBy("_key").agg(F.min("component_id").alias("_group"), F.count("*").alias("_times"))
    place = F.struct(F.col("doc_id").isNull().alias("a"), F.col("doc_id").alias("b"), F.col("_key").alias("c"))
    ids = kept(keyed.select("doc_id", "_key").distinct().join(groups, "_key"))
    first = kept(ids.groupBy("_group").agg(F.min(F.struct(place.alias("p"), "_times")).alias("f")).select("_group", F.col("f.p.c").alias("_first"), "f._times"))
    # the rows that go are fewer than those that stay, so they are what texts are joined with
    gone = ids.join(first.select("_group", "_first"), "_group").where("_key <> _first").select("_key")
    repeated = first.where("_times > 1").select(F.col("_first").alias("_key"))
    single = keyed.join(gone.union(repeated), "_key", "left_anti").select(COLUMNS)
    if not repeated.limit(1).count():
        return single
    return single.union(keyed.join(repeated, "_key", "left_semi").groupBy("_key").agg(F.min(F.struct(*COLUMNS)).alias("r")).select("r.*"))


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines and passages that stand in an earlier one; n_chars follows the text. Null and empty texts stay."""
    out = line_dedup(docs.select(COLUMNS), unit="line")
    return out.withColumn("n_chars", F.when(F.size("dedup.spans") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(COLUMNS)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose text holds no benchmark item, whatever other rows with their id hold. Null and empty texts stay."""
    return decontaminate(docs.select(COLUMNS), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """How many words the mix takes from each document."""
    return mix(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", keep_quality),
    ("ngram_jaccard", keep_one_of_each),
    ("line_dedup", cut_repeats),
    ("decontaminate", drop_leaks),
    ("mixing", mix_sources),
]
#: SQL can express neither the classifier nor the joins; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each result is written as Parquet and read as the next one's input."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        path = shared_folder(spark)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
