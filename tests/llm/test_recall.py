"""Retrieval against an exhaustive overlap check, where BM25 alone would miss leaks."""

import random

import brute
import pytest
from acervo.llm import decontaminate


def exhaustive(docs, items, overlap=0.8, part=0.5):
    """{(doc, item)} by the rules of the overlap check, over each text's windows."""
    parsed = {k: brute.words(t) for k, t in items}
    stride, found = max(max(len(w) for w in parsed.values()), 32), set()
    for d, text in docs:
        w = brute.words(text)
        for lo in range(0, max(len(w), 1), stride):
            window = w[lo : lo + 2 * stride]
            for k, own in parsed.items():
                n = min(5, len(own))
                runs = lambda x: [tuple(x[i : i + n]) for i in range(len(x) - n + 1)]  # noqa: B023, E731
                whole, there = runs(own), set(runs(window))
                cut = max(1, len(own) - max(1, round(len(own) * 0.5)))
                split = min(max(cut - n + 1, 1), len(whole))
                q, a = set(whole[:split]), set(whole[split:])
                hits = len(q & there), len(a & there)
                if sum(hits) / (len(q) + len(a)) >= overlap and hits[0] / len(q) >= part and (not a or hits[1] / len(a) >= part):
                    found.add((d, k))
    return found


@pytest.mark.parametrize("tail", [1, 3, 5])
def test_common_bodies_with_rare_tails(spark, tail):
    r = random.Random(tail)
    body = [f"c{i}" for i in range(17)]
    items = [(k, " ".join([*r.sample(body, 17), *(f"rare{k}x{i}" for i in range(tail))])) for k in range(60)]
    items += [(100 + k, " ".join([*body, *(f"other{k}x{i}" for i in range(tail))])) for k in range(60)]
    items += [(200, "a b c d e a b c d e a b c d e q"), (201, "one two"), (202, "one")]
    docs = []
    for i in range(200):
        w = r.choice(items)[1].split()
        docs.append((i, " ".join([*(r.choice(body) for _ in range(r.randint(0, 40))), *w[: len(w) - r.randint(0, tail)], *(f"z{r.randint(0, 99)}" for _ in range(20))])))
    got = {(x.doc_id, x.item_id) for x in decontaminate.leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    want = exhaustive(docs, items)
    assert got == want and len(want) > 100


def test_columns_of_the_caller_stay(spark):
    item = " ".join(f"q{i}" for i in range(20))
    docs = spark.createDataFrame([(1, "clean", 3, 4), (2, f"x {item}", 5, 6), (None, None, 7, 8), (None, item, 9, 10)], "doc_id long, text string, _leaked int, item int")
    out = decontaminate.decontaminate(docs, spark.createDataFrame([(1, item)], "item_id long, text string"))
    assert out.columns == docs.columns and sorted(map(tuple, out.collect()), key=str) == [(1, "clean", 3, 4), (None, None, 7, 8)]
    assert len(decontaminate.leaks(docs, spark.createDataFrame([(1, item)], "item_id long, text string")).collect()) == 2


def test_very_long_texts(spark):
    r = random.Random(2)
    item = " ".join(f"q{i}" for i in range(25))
    long = " ".join(f"w{r.randint(0, 5000)}" for _ in range(200_000))
    docs = spark.createDataFrame([(1, long + " " + item), (2, long), (3, item + " " + long)], "doc_id long, text string")
    assert sorted(x.doc_id for x in decontaminate.leaks(docs, spark.createDataFrame([(1, item)], "item_id long, text string")).collect()) == [1, 3]
