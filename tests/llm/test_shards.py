import random

from acervo.llm import decontaminate


def test_shards_give_equal_rows(spark, monkeypatch):
    r = random.Random(4)
    common = ["".join(r.choice("klmnop") for _ in range(3)) for _ in range(30)]
    items = [(k, " ".join(r.choice(common) if r.random() < 0.6 else f"w{r.randint(0, 400)}" for _ in range(r.choice([8, 20, 45])))) for k in range(60)]
    docs = []
    for i in range(180):
        w = items[i % 60][1].split()
        for _ in range(len(w) * (i // 60) // 8):
            w[r.randrange(len(w))] = r.choice(common)
        docs.append((i, " ".join([*(r.choice(common) for _ in range(r.randint(0, 90))), *w, "end"])))
    data, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    rows = lambda: sorted(map(str, decontaminate.leaks(data, bench, overlap=0.3, part_overlap=0.1).collect()))
    one = rows()
    monkeypatch.setattr(decontaminate, "ITEMS", 20)
    assert rows() == one and len(one) > 50


def test_statistics_are_those_of_all_items(spark):
    import numpy as np

    texts = [f"a b c{i} d{i % 3} a" for i in range(50)]
    got = decontaminate.Statistics(spark.createDataFrame([(t,) for t in texts], "text string").repartition(5))
    raw = [t.encode() for t in texts]
    offsets = np.concatenate([[0], np.cumsum([len(x) for x in raw])])
    hashes = decontaminate.words(np.frombuffer(b"".join(raw), np.uint8), offsets)[2].reshape(50, 5)
    terms, times = np.unique(np.concatenate([np.unique(x) for x in hashes]), return_counts=True)
    assert (got.count, got.mean, got.longest) == (50, 5.0, 5)
    assert got.terms.tolist() == terms.tolist() and got.frequency.tolist() == times.tolist()
