from acervo.llm import quality


def test_fit_takes_one_text_of_an_id(spark, monkeypatch):
    seen = []
    features = quality._features
    monkeypatch.setattr(quality, "_features", lambda d: seen.append(sorted(tuple(r) for r in d.select("id", "text").collect())) or features(d))
    docs = [(i, f"text {i}") for i in range(12)] + [(i, f"other {i} {k}") for i in range(12) for k in range(5)]
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(12)], "doc_id long, quality int, toxic int")
    for order in (docs, docs[::-1]):
        quality.fit_quality(spark.createDataFrame(order, "doc_id long, text string").repartition(3), labels)
    assert seen[0] == seen[1] and len({i for i, _ in seen[0]}) == len(seen[0]) > 0
