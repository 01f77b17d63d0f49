import random

from acervo.operators import retrieval
from pyspark.sql import functions as F


def _want(v, b, k=10):
    rank = lambda s: {d: i for i, (d, _) in enumerate(sorted(s.items(), key=lambda x: (-x[1], x[0])), 1)}
    x, y = rank(v), rank(b)
    score = {d: round((1 / (60 + x[d]) if d in x else 0) + (1 / (60 + y[d]) if d in y else 0), 5) for d in {*x, *y}}
    return sorted(score.items(), key=lambda z: (-z[1], z[0]))[:k]


def test_ranks_beyond_the_first_500_count(spark):
    v, b = ({i: float(i * m % p) for i in range(10_000)} for m, p in ((7, 101), (11, 103)))
    frame = lambda s: spark.createDataFrame(list(s.items()), "doc_id long, score double")
    assert [(r.doc_id, r.score) for r in retrieval.fuse(frame(v), frame(b), "doc_id").collect()] == _want(v, b)


def test_cosine_and_bm25_are_fused(spark):
    r = random.Random(2)
    docs = [(i, " ".join(r.choice("stone river hill tree lake".split()) for _ in range(r.randint(3, 30))), [r.random() - 0.5 for _ in range(6)]) for i in range(2000)]
    data = spark.createDataFrame(docs, "doc_id long, text string, vector array<double>")
    vector = data.select("doc_id", F.round(retrieval.cosine(F.col("vector"), F.array(*[F.lit(x) for x in (1.0, 0.5, -0.2, 0.1, 0.0, 0.3)])), 4).alias("score"))
    lexical = retrieval.bm25(data, "doc_id", "text", ["river", "lake"])
    got = [(x.doc_id, x.score) for x in retrieval.fuse(vector, lexical, "doc_id").collect()]
    assert got == _want(dict(vector.collect()), dict(lexical.collect()))
