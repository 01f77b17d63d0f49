"""Dropping lines that many documents share, with Spark expressions only.

Lines are exploded and normalised, long ones hashed to 128 bits; a hash found in enough documents keeps the document with the
largest id. What is shuffled for the counts is one row for each distinct (hash, document). The places that go are gathered
for each row and its text is put together again from the places that stay. Texts move once, and not at all where the places
that go are few enough to be sent to all tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from acervo.llm._text import kept

BLANKS = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Longs up to which a counted table is sent to all tasks: 8 MB.
SENT_LONGS = 1_000_000


def _hash(*columns: Column, name: str) -> list[Column]:
    """128 bits over the columns and over which of them are null."""
    nulls = [c.isNull() for c in columns]
    return [F.xxhash64(*columns, *nulls).alias(f"{name}1"), F.xxhash64(F.lit(0x5DEECE66D), *columns, *nulls).alias(f"{name}2")]


def _sent(frame: DataFrame, width: Column) -> DataFrame:
    """The written table, marked for broadcast only if its rows, of `width` longs each, are no more than SENT_LONGS in all."""
    frame = kept(frame)
    return F.broadcast(frame) if (frame.agg(F.sum(width)).first()[0] or 0) <= SENT_LONGS else frame


def drop_frequent_lines(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", min_chars: int = 40, min_docs: int = 5) -> DataFrame:
    """docs with text_column rebuilt and a column lines struct<n_lines long, n_dropped long>.

    A line's key is the line without blanks at its ends and with A-Z lower-cased. Keys of min_chars code points or more that
    min_docs documents hold lose all their lines, except in the document with the largest id among them, where all stay.

    A null or empty text is one empty line; a null text becomes an empty one. Rows that share an id are one document for the
    counts; each row is rebuilt by itself. Rows with a null id are together one document, which ranks below every id.
    Repeated rows come out as often as they come in. Other columns pass through; names that begin with _line_ are taken.
    An empty table gives an empty one.
    """
    whole = F.coalesce(F.col(text_column), F.lit(""))
    rows = docs.select(*_hash(F.col(id_column), F.col(text_column), name="_line_row"), F.col(id_column).alias("_line_id"), F.posexplode(F.split(whole, "\n")).alias("_line_at", "_line"))
    key = F.trim(F.col("_line"), F.lit(BLANKS))
    long = rows.where(F.length(key) >= min_chars).select("_line_row1", "_line_row2", "_line_id", "_line_at", *_hash(F.translate(key, UPPER, LOWER), name="_line_key"))
    # two steps, each with map-side sums: one row for each key and document, then one for each key
    once = long.select("_line_key1", "_line_key2", "_line_id").distinct()
    common = once.groupBy("_line_key1", "_line_key2").agg(F.count("*").alias("_line_docs"), F.max("_line_id").alias("_line_stays")).where(F.col("_line_docs") >= min_docs)
    common = _sent(common.select("_line_key1", "_line_key2", "_line_stays"), F.lit(3))
    gone = long.join(common, ["_line_key1", "_line_key2"]).where(~F.col("_line_id").eqNullSafe(F.col("_line_stays")))
    gone = _sent(gone.groupBy("_line_row1", "_line_row2").agg(F.collect_set("_line_at").alias("_line_gone")), 4 + F.size("_line_gone"))
    keyed = docs.select("*", *_hash(F.col(id_column), F.col(text_column), name="_line_row"))
    found = keyed.join(gone, ["_line_row1", "_line_row2"], "left").withColumn("_line_all", F.split(whole, "\n"))
    # places, not lines, are compared, so the work is in proportion to the lines of a text
    stay = F.array_except(F.sequence(F.lit(0), F.size("_line_all") - 1), F.coalesce("_line_gone", F.array().cast("array<int>")))
    rebuilt = F.when(F.col("_line_gone").isNull(), whole).otherwise(F.array_join(F.transform(stay, lambda i: F.get("_line_all", i)), "\n"))
    counts = F.struct(F.size("_line_all").cast("long").alias("n_lines"), F.coalesce(F.size("_line_gone"), F.lit(0)).cast("long").alias("n_dropped"))
    out = found.select(*[F.col(c) for c in docs.columns if c not in (text_column, "lines")], rebuilt.alias(text_column), counts.alias("lines"))
    return out.select(*[F.col(c) for c in docs.columns if c != "lines"], "lines")
