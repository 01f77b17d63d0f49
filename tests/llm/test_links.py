"""Every link counts: rows linked with each row, held against all pairs."""

import random

import brute
import pytest
from acervo.llm import ngram_jaccard


def degrees(docs, n, percent):
    sets = [brute.shingles(t, n) for _, t in docs]
    linked = lambda a, b: bool(a) and 100 * len(a & b) >= percent * len(a | b)
    return [(d, sum(linked(s, o) for j, o in enumerate(sets) if j != i)) for i, ((d, _), s) in enumerate(zip(docs, sets, strict=True))]


def counted(spark, docs, n, percent):
    data = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    return sorted(str((r.doc_id, r.n_links)) for r in ngram_jaccard.ngram_jaccard(data, ngram=n, percent=percent).collect())


def edited(r, words, most):
    words = list(words)
    for _ in range(r.randint(0, most)):
        words[r.randrange(len(words))] = f"e{r.randint(0, 30)}"
    return " ".join(words)


@pytest.mark.parametrize(("percent", "members"), [(80, 256), (90, 3)])
def test_all_links_of_near_copies(spark, monkeypatch, percent, members):
    monkeypatch.setattr(ngram_jaccard, "MEMBERS", members)
    r = random.Random(percent + members)
    docs = []
    for g, (size, most) in enumerate([(120, 4), (60, 3), (30, 2), (200, 14)]):
        body = [f"g{g}w{i}" for i in range(size)]
        docs += [(len(docs) + i, edited(r, body, most)) for i in range(50)]
    # copies, other case and blanks with equal n-grams, rows without id, and texts without words
    docs += [(1000, docs[0][1]), (1001, docs[0][1]), (1002, docs[0][1].upper().replace(" ", "  ")), (None, docs[60][1]), (1003, None), (1004, " "), (1005, " "), (1006, "alone here"), (1007, "Alone here")]
    want = degrees(docs, 3, percent)
    assert sum(x for _, x in want) > 1000
    assert counted(spark, docs, 3, percent) == sorted(map(str, want))


def test_links_of_a_chain_have_several_centres(spark):
    # each text drops words at its start and gains some at its end, so components hold many centres
    body = [f"w{i}" for i in range(400)]
    docs = [(i, " ".join(body[2 * i : 2 * i + 120])) for i in range(100)]
    assert counted(spark, docs, 3, 90) == sorted(map(str, degrees(docs, 3, 90)))


def test_near_copies_of_one_centre_are_not_made_as_pairs(spark, monkeypatch):
    made, overlaps = [], ngram_jaccard._overlaps
    monkeypatch.setattr(ngram_jaccard, "_overlaps", lambda d, p, *a: made.append(p.count()) or overlaps(d, p, *a))
    body = [f"w{i}" for i in range(300)]
    docs = [(i, " ".join([*body[:i], f"own{i}", *body[i + 1 :]])) for i in range(300)]
    assert counted(spark, docs, 3, 90) == sorted(map(str, degrees(docs, 3, 90)))
    assert sum(made) < 10 * len(docs)


def test_links_are_left_out_on_request(spark):
    data = spark.createDataFrame([(1, "a b c d"), (2, "a b c d")], "doc_id long, text string")
    out = ngram_jaccard.ngram_jaccard(data, ngram=3, percent=90, links=False)
    assert out.columns == ["doc_id", "n_shingles", "component_id"]
    assert sorted((r.doc_id, r.component_id) for r in out.collect()) == [(1, 1), (2, 1)]
