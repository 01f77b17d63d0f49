"""The operators over the whole given tables, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from acervo.llm.chat import chat_digests
from acervo.llm.decontaminate import leaks
from acervo.llm.frequent_lines import drop_frequent_lines
from acervo.llm.hard_negatives import hard_negatives
from acervo.llm.license_scan import license_scan
from acervo.llm.line_dedup import line_dedup
from acervo.llm.matroska import media_columns
from acervo.llm.mixing import mix
from acervo.llm.ngram_jaccard import ngram_jaccard
from acervo.llm.prefix_trie import prefix_trie, rebuilt, sequences
from acervo.llm.quality import quality
from acervo.llm.suffix_dedup import suffix_dedup
from acervo.llm.url_rules import judge


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_jaccard(_table(spark, sf_dir, "documents"), ngram=3, percent=90)


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(_table(spark, sf_dir, "documents"))


def op4_matroska(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_columns(_table(spark, sf_dir, "documents"))


def op5_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(_table(spark, sf_dir, "pages"), _table(spark, sf_dir, "labels"))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup(_table(spark, sf_dir, "documents").select("doc_id", "text"), unit="line")
    return out.select("doc_id", "dedup.n_units", "dedup.n_removed", "dedup.kept_sha256", "dedup.spans")


def op7_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(_table(spark, sf_dir, "documents"))


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup(_table(spark, sf_dir, "documents")).drop("spans")


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op10_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = F.lit("</s>[INST] ok [/INST]")
    extra = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), said.alias("text"))
    return chat_digests(turns.unionByName(extra))


def op11_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = drop_frequent_lines(_table(spark, sf_dir, "documents").select("doc_id", "text"), min_chars=40, min_docs=5)
    return out.select("doc_id", "lines.n_lines", "lines.n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _table(spark, sf_dir, "embeddings").withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))
    return hard_negatives(vectors, anchors=F.col("vec_id") % 100 == 0)


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(rebuilt(sequences(_table(spark, sf_dir, "conversations"))))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_ngram_jaccard, op2_quality, op3_mixing, op4_matroska, op5_url_rules, op6_line_dedup, op7_licenses, op8_suffix_dedup, op9_decontaminate, op10_chat, op11_line_dedup, op12_hard_negatives, op13_prefix_trie, pipeline)}

#: The other operators have no plain SQL and are held against brute force in tests/llm.
ORACLE_SQL: dict[str, str] = {
    "op10_chat": r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
), n AS (
  SELECT *, lag(role) OVER w AS before, lead(role) OVER w AS after,
         row_number() OVER w AS place
  FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)
)
SELECT conv_id, count(*)::BIGINT AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY place)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY place) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(length(replace(replace(text, '&', '&amp;'), '<', '&lt;'))
           + CASE WHEN before IS NOT DISTINCT FROM role THEN 8
                  ELSE 9 + length(replace(replace(replace(role, '&', '&amp;'), '<', '&lt;'), chr(10), '&#10;')) END
           + CASE WHEN after IS NOT DISTINCT FROM role THEN 0 ELSE 8 END)::BIGINT AS formatted_chars
FROM n GROUP BY conv_id
""",
    "op11_line_dedup": r"""
WITH t AS (
  SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents
), l AS (
  SELECT r, doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS place FROM t
), k AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l
), c AS (
  SELECT key, max(doc_id) AS stays FROM k WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5
)
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (stays IS NOT NULL AND doc_id IS DISTINCT FROM stays)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY place) FILTER (stays IS NULL OR doc_id IS NOT DISTINCT FROM stays), '')) AS kept_sha256
FROM k LEFT JOIN c USING (key) GROUP BY r, doc_id
""",
    "op12_hard_negatives": r"""
WITH r AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS same, list_inner_product(a.v, b.v)::BIGINT AS score
  FROM r a JOIN r b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0
), p AS (
  SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5
)
SELECT p.anchor_id, positive_id, (row_number() OVER w)::INTEGER AS rank, other_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
WINDOW w AS (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, other_id)
QUALIFY row_number() OVER w <= 10
""",
    "op13_prefix_trie": r"""
WITH t AS (
  SELECT conv_id, md5(length(coalesce(role, ''))::VARCHAR || ':' || coalesce(role, '') || coalesce(text, '')) AS k,
         len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS words, turn
  FROM conversations WHERE conv_id IS NOT NULL
), o AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, k, words) AS place FROM t
), c AS (
  SELECT DISTINCT conv_id AS c, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(conv_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
    lambda a, b: list_reduce(list_prepend(xor(a, b), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]),
      lambda x, y: CASE WHEN x % 2 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)), 4294967295) % 4 AS h
  FROM o
), r AS (
  SELECT c, 0 AS own, place, k, words FROM c JOIN o ON conv_id = c - c % 20 AND place <= h
  UNION ALL SELECT c, 1, place, k, words FROM c JOIN o ON conv_id = c AND place > h
), s AS (
  SELECT c, row_number() OVER w AS depth, string_agg(k, '') OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS key, words
  FROM r WINDOW w AS (PARTITION BY c ORDER BY own, place)
), m AS (
  SELECT c, 0 AS depth, '' AS key, 0 AS words FROM c UNION ALL SELECT * FROM s
), l AS (
  SELECT c, max(depth) AS size FROM m GROUP BY c
), n AS (
  SELECT key, depth, min(m.c) AS conv_id, count(*) AS n_convs, any_value(words) AS words,
         sha256(coalesce(string_agg(m.c::VARCHAR, ',' ORDER BY m.c) FILTER (size = depth), '')) AS ends_sha256
  FROM m JOIN l ON l.c = m.c GROUP BY key, depth
), k AS (
  SELECT left(key, 32 * (depth - 1)::INTEGER) AS key, count(*) AS n_children FROM n WHERE depth > 0 GROUP BY 1
), u AS (
  SELECT x.key, count(*) FILTER (k.key IS NULL) AS n_leaves, sum((n.n_convs - 1) * n.words) AS saved_tokens
  FROM n LEFT JOIN k ON k.key = n.key JOIN m x ON x.c = n.conv_id AND x.depth <= n.depth GROUP BY x.key
)
SELECT n.conv_id, n.depth::BIGINT AS depth, p.conv_id AS parent_conv_id, n.n_convs::BIGINT AS n_convs, coalesce(n_children, 0)::BIGINT AS n_children,
       n_leaves::BIGINT AS n_leaves, saved_tokens::BIGINT AS saved_tokens, n.ends_sha256
FROM n JOIN u ON u.key = n.key LEFT JOIN k ON k.key = n.key
LEFT JOIN n p ON n.depth > 0 AND p.key = left(n.key, 32 * (n.depth - 1)::INTEGER)
""",
}
