"""URL filters: fixed host and path rules, and association rules mined from labels with FP-growth."""

from __future__ import annotations

from statistics import NormalDist

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from acervo.llm._text import kept

#: (host, path, verdict): fits the host and its subdomains where the path starts so.
RULES = (("com", "/en/", "block"), ("example.com", "/en/7", "allow"), ("net", "/de/", "allow"), ("example.net", "/de/8", "block"), ("org", "/es/", "block"))
LABEL = "label=block"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _rest(url: Column) -> Column:
    """What follows the first ://, or null."""
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url)))


def host_of(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(_rest(url), r"^([^/?#]*)", 1), _UPPER, _LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def tokens_of(url: Column) -> Column:
    """Host labels (with what stands under them), path parts, and names of query fields; distinct, sorted."""
    rest = F.coalesce(_rest(url), F.lit(""))
    labels = F.transform(F.split(host_of(url), r"\."), lambda x: F.concat(F.lit("host:"), x))
    parts = F.transform(F.split(F.regexp_replace(F.lower(path_of(url)), r"[0-9]+", "0"), "/"), lambda x: F.concat(F.lit("path:"), x))
    fields = F.transform(F.regexp_extract_all(rest, F.lit(r"[?&]([^=&#]+)"), 1), lambda x: F.concat(F.lit("field:"), F.lower(x)))
    return F.array_sort(F.array_distinct(F.filter(F.concat(labels, parts, fields, F.array(F.concat(F.lit("scheme:"), F.lower(F.split_part(url, F.lit("://"), F.lit(1)))))), lambda x: F.length(x) > 5)))


def mine(urls: DataFrame, min_support: float = 0.002, min_confidence: float = 0.5, min_count: int = 10, level: float = 0.05) -> DataFrame:
    """urls (url, block) -> rules (rule_id, tokens, n_tokens, confidence, support, lower) whose consequent is the block label.

    Itemsets below `min_support` (or `min_count` rows) and rules below `min_confidence` are pruned, and so are rules that
    chance explains: `lower`, the Wilson bound of the confidence at `level` divided by the number of rules tested, must lie
    above the share of blocked rows.
    """
    from pyspark.ml.fpm import FPGrowth

    labelled = urls.where("url is not null and block is not null")
    rows, share = labelled.agg(F.count("*"), F.avg(F.col("block").cast("int"))).first()
    if not rows:
        return urls.sparkSession.createDataFrame([], "rule_id long, tokens array<string>, n_tokens int, confidence double, support double, lower double")
    items = labelled.select(F.when(F.col("block"), F.array_append(tokens_of(F.col("url")), F.lit(LABEL))).otherwise(tokens_of(F.col("url"))).alias("items"))
    model = FPGrowth(itemsCol="items", minSupport=min(1.0, max(min_support, min_count / rows)), minConfidence=0.0).fit(items)
    rules = kept(model.associationRules.where(F.element_at("consequent", 1) == LABEL).select(F.array_sort("antecedent").alias("tokens"), "confidence", "support"))
    z = NormalDist().inv_cdf(1 - level / max(rules.count(), 1))
    n, p = F.round(F.col("support") * rows / F.col("confidence")), F.col("confidence")
    lower = (p + z * z / (2 * n) - z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n)
    good = rules.withColumn("lower", lower).where((F.col("confidence") >= min_confidence) & (F.col("lower") > share))
    return good.select(F.xxhash64(F.concat_ws(" ", "tokens")).alias("rule_id"), "tokens", F.size("tokens").alias("n_tokens"), "confidence", "support", "lower")


def match(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """urls (url) -> (url, confidence): the highest confidence of the rules all of whose tokens a url has.

    Through an inverted index from token to rules: each rule is listed under its rarest token only, so tokens that most
    urls have bring up no rules but those of nothing else.
    """
    parsed = urls.where("url is not null").select("url").distinct().select("url", tokens_of(F.col("url")).alias("have"))
    times = parsed.select(F.explode("have").alias("token")).groupBy("token").agg(F.count("*").alias("times"))
    listed = rules.select("rule_id", "tokens", "confidence", F.explode("tokens").alias("token")).join(times, "token")
    index = listed.groupBy("rule_id").agg(F.first("tokens").alias("tokens"), F.first("confidence").alias("confidence"), F.min(F.struct("times", "token"))["token"].alias("token"))
    met = parsed.select("url", "have", F.explode("have").alias("token")).join(index, "token")
    return met.where(F.size(F.array_except("tokens", "have")) == 0).groupBy("url").agg(F.max("confidence").alias("confidence"))


def fixed_rule(host: Column, path: Column, rules: tuple[tuple[str, str, str], ...] = RULES) -> Column:
    """The longest fixed rule that fits, as struct(rule, verdict), or null."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for rule_host, rule_path, verdict in sorted(rules, key=lambda r: (len(r[0]) + len(r[1]), r)):
        fits = ((host == rule_host) | F.endswith(host, F.lit(f".{rule_host}"))) & F.startswith(path, F.lit(rule_path))
        out = F.when(fits, F.struct(F.lit(rule_host + rule_path).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def judge(pages: DataFrame, labels: DataFrame, id_column: str = "page_id", url_column: str = "url", label_id: str = "doc_id", min_confidence: float = 0.5) -> DataFrame:
    """One row for each row of pages: (id_column, host, path, rule, verdict, confidence).

    A url that a fixed rule fits has that rule's verdict. Else it is blocked if a mined rule matches. Rules are mined
    from the pages whose id has a label: quality 0 or toxic 1 counts as block. Without a rule that beats chance all of them are
    allowed. Null urls, and urls without ://, have
    empty host and path and are allowed unless a mined rule matches. Repeated rows and null ids come out as they come in.
    """
    pages = pages.select(F.col(id_column).alias("id"), F.col(url_column).alias("url"))
    bad = labels.groupBy(F.col(label_id).alias("id")).agg(F.max((F.coalesce(F.col("quality") == 0, F.lit(False)) | F.coalesce(F.col("toxic") == 1, F.lit(False)))).alias("block"))
    found = match(pages, mine(pages.join(bad, "id"), min_confidence=min_confidence))
    out = pages.join(found, "url", "left").withColumn("host", host_of(F.col("url"))).withColumn("path", path_of(F.col("url"))).withColumn("fixed", fixed_rule(F.col("host"), F.col("path")))
    learned = F.when(F.col("confidence") >= min_confidence, "block").otherwise("allow")
    return out.select(F.col("id").alias(id_column), "host", "path", F.col("fixed.rule").alias("rule"), F.coalesce("fixed.verdict", learned).alias("verdict"), "confidence")
