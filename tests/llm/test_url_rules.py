"""Mined rules and their matching against plain counting."""

import random
from itertools import combinations

from acervo.llm import url_rules
from pyspark.sql import functions as F


def table(spark, seed, flip):
    r = random.Random(seed)
    urls = [f"https://{r.choice(['a', 'b', 'spam'])}.{r.choice(['com', 'net'])}/{r.choice(['x', 'y', 'cheap'])}/{r.randint(0, 9)}?{r.choice(['q', 'id'])}=1" for _ in range(300)]
    rows = [(u, ("spam" in u or ("cheap" in u and "net" in u)) if r.random() > flip else r.random() < 0.4) for u in urls]
    return spark.createDataFrame(rows, "url string, block boolean")


def itemsets(data):
    """{tokens: (rows, blocked)} of all sets of tokens that some url has."""
    out = {}
    for tokens, block in data.select(url_rules.tokens_of(F.col("url")), "block").collect():
        for n in range(1, len(tokens) + 1):
            for c in combinations(sorted(tokens), n):
                rows, bad = out.get(c, (0, 0))
                out[c] = rows + 1, bad + block
    return out


def test_rules_and_matches(spark):
    data = table(spark, 1, 0.1)
    mined = url_rules.mine(data, min_count=10)
    rules = {tuple(x.tokens): (x.confidence, x.lower) for x in mined.collect()}
    sets, share = itemsets(data), data.agg(F.avg(F.col("block").cast("int"))).first()[0]
    least = max(0.002 * 300, 10)
    likely = {c: b / n for c, (n, b) in sets.items() if b >= least and b / n >= 0.5}
    assert set(rules) <= set(likely) and all(abs(rules[c][0] - likely[c]) < 1e-9 for c in rules)
    assert ("host:spam",) in rules and all(low > share for _, low in rules.values())
    # every rule that is sure and frequent is there
    assert all(c in rules for c, p in likely.items() if p > 0.95 and sets[c][0] >= 40)
    got = {x.url: x.confidence for x in url_rules.match(data, mined).collect()}
    want = {}
    for url, tokens in data.select("url", url_rules.tokens_of(F.col("url"))).distinct().collect():
        if fits := [p for c, (p, _) in rules.items() if set(c) <= set(tokens)]:
            want[url] = max(fits)
    assert got == want and want


def test_chance_gives_no_rules(spark):
    assert url_rules.mine(table(spark, 2, 1.0)).count() == 0
