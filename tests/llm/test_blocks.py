"""Blocks that hubs don't settle, n-grams that no task counts, and sketches."""

import random

import brute
import numpy as np
import pytest
from acervo.llm import ngram_jaccard
from pyspark.sql import functions as F


def docs_around(r, groups, members, shared, own, near):
    """Groups whose members share words and differ in others, with a near copy of every `near`th member."""
    out = []
    for g in range(groups):
        body = [f"g{g}s{i}" for i in range(shared)]
        for m in range(members):
            at = r.randint(0, shared)
            text = [*body[:at], *(f"g{g}m{m}o{i}" for i in range(own)), *body[at:]]
            out.append((len(out), " ".join(text)))
            if m % near == 0:
                out.append((len(out), " ".join(text) + " end"))
    return out


def rows(spark, docs, n, percent):
    data = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    return sorted(str((r.doc_id, r.n_shingles, r.component_id)) for r in ngram_jaccard.ngram_jaccard(data, ngram=n, percent=percent).collect())


@pytest.mark.parametrize("rounds", [1, 6])
def test_members_that_no_hub_settles(spark, monkeypatch, rounds):
    monkeypatch.setattr(ngram_jaccard, "HUB_ROUNDS", rounds)
    monkeypatch.setattr(ngram_jaccard, "OPEN_PAIRS", 0)
    docs = docs_around(random.Random(5), 3, 40, 60, 9, 7)
    assert rows(spark, docs, 3, 90) == sorted(map(str, brute.jaccard(docs, 3, 90)))


def test_large_blocks_are_posted_again(spark, monkeypatch):
    monkeypatch.setattr(ngram_jaccard, "LARGE_BLOCK", 20)
    monkeypatch.setattr(ngram_jaccard, "HOT_FROM", 10**9)
    calls, post = [], ngram_jaccard._postings
    monkeypatch.setattr(ngram_jaccard, "_postings", lambda *a: calls.append(len(a[3][0])) or post(*a))
    docs = docs_around(random.Random(6), 2, 60, 50, 8, 9)
    assert rows(spark, docs, 3, 80) == sorted(map(str, brute.jaccard(docs, 3, 80)))
    assert calls[0] == 0 and len(calls) == 2 and calls[1] > 0


def test_a_block_of_thousands_of_unlike_documents(spark, monkeypatch):
    made = []
    overlaps = ngram_jaccard._overlaps
    monkeypatch.setattr(ngram_jaccard, "_overlaps", lambda d, p, *a: made.append(p.count()) or overlaps(d, p, *a))
    monkeypatch.setattr(ngram_jaccard, "HOT_FROM", 10**9)  # so that the common n-grams head blocks
    r = random.Random(7)
    head = [f"h{i}" for i in range(20)]
    docs = [(i, " ".join([*head, *(f"d{i}w{k}" for k in range(r.randint(4, 9)))])) for i in range(2500)]
    docs += [(5000 + i, docs[i * 20][1] + " end") for i in range(40)]
    got = {x.doc_id: x.component_id for x in ngram_jaccard.ngram_jaccard(spark.createDataFrame(docs, "doc_id long, text string").repartition(4), ngram=3, percent=80).collect()}
    want = {d: c for d, _, c in brute.jaccard(docs, 3, 80)}
    assert got == want
    assert sum(made) < 40 * len(docs)


def test_sketches_never_differ_more_than_their_sets():
    r = np.random.default_rng(3)
    for n, m, both in ((5, 9, 3), (200, 180, 150), (3000, 2500, 2000), (0, 4, 0)):
        pool = np.unique(r.integers(0, 2**63, n + m + 50).astype(np.uint64))
        r.shuffle(pool)
        a, b = pool[:n], pool[n - both : n - both + m]
        x, y = (np.unpackbits(ngram_jaccard._sketch(s).view(np.uint8)) for s in (a, b))
        assert (x != y).sum() <= len(np.setxor1d(a, b))
    assert len(ngram_jaccard._sketch(np.zeros(0, np.uint64))) == ngram_jaccard.SKETCH // 64


def test_columns_of_the_caller_do_not_matter(spark):
    docs = [(1, "a b c d e", 5), (2, "a b c d e", 6), (3, None, 7)]
    data = spark.createDataFrame(docs, "doc_id long, text string, v long").withColumns({c: F.lit(1) for c in ("t", "id", "digest", "ngram", "c")})
    assert sorted((r.doc_id, r.component_id) for r in ngram_jaccard.ngram_jaccard(data, ngram=3, percent=90).collect()) == [(1, 1), (2, 1), (3, 3)]
