import brute
from acervo.llm.ngram_jaccard import ngram_jaccard


def test_near_copies_with_null_and_repeated_ids(spark):
    w = [f"w{i}" for i in range(200)]
    edit = lambda *places: " ".join(f"x{i}" if i in places else x for i, x in enumerate(w))
    other = lambda k: " ".join(f"{k}v{i}" for i in range(60))
    docs = [(10, edit()), (None, edit(5)), (11, edit(5, 60)), (None, other("a")), (None, other("a") + " end")]
    # a chain whose middle has no id, and one id with two texts that both have near copies
    docs += [(20, other("b")), (None, other("b") + " e1 e2"), (21, other("b") + " e1 e2 e3 e4"), (7, other("c")), (7, other("d")), (30, other("c") + " end"), (31, other("d") + " end")]
    for percent in (90, 95):
        got = ngram_jaccard(spark.createDataFrame(docs, "doc_id long, text string").repartition(3), ngram=3, percent=percent).collect()
        assert sorted(str((r.doc_id, r.n_shingles, r.component_id)) for r in got) == sorted(map(str, brute.jaccard(docs, 3, percent)))
