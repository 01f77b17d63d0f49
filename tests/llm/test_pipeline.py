import random

import brute
import corpus_pipeline

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def table(spark, docs):
    return spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in docs], SCHEMA).repartition(3)


def rows(frame):
    return sorted(str((r.doc_id, r.text)) for r in frame.collect())


def test_quality_decides_by_row(spark, tmp_path):
    good, bad = (lambda i: f"stone river hill tree {i} " * 9), (lambda i: f"### buy !!! {i} " * 9)
    docs = [(i, good(i) if i % 2 else bad(i)) for i in range(120)] + [(None, good(500)), (None, bad(501)), (1, bad(502)), (3, good(3))]
    spark.createDataFrame([(i, i % 2, 0) for i in range(120)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    data = table(spark, docs)
    out = rows(corpus_pipeline.keep_quality(spark, data, str(tmp_path)))
    assert out == sorted(str(x) for x in docs if x[1].startswith("stone"))


def test_one_of_each_by_row(spark):
    text = lambda k: " ".join(f"{k}v{i}" for i in range(60))
    docs = [(1, text("a")), (1, text("a")), (2, text("a") + " end"), (None, text("b")), (None, text("b")), (None, text("c")), (9, text("c") + " end"), (5, text("d")), (5, text("e"))]
    assert rows(corpus_pipeline.keep_one_of_each(spark, table(spark, docs), "")) == sorted(map(str, [(1, text("a")), (None, text("b")), (9, text("c") + " end"), (5, text("d")), (5, text("e"))]))


def test_leaks_decide_by_row(spark, tmp_path):
    item = " ".join(f"q{i}" for i in range(30))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = [(None, "before " + item), (None, "clean words"), (4, item), (4, "other clean words")]
    assert rows(corpus_pipeline.drop_leaks(spark, table(spark, docs), str(tmp_path))) == sorted(map(str, [docs[1], docs[3]]))


def test_whole_run_against_plain_python(spark, tmp_path):
    """All stages in order on one small corpus: each decision of a stage holds for the next one."""
    r = random.Random(4)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(r.randint(3, 7)))
    body = lambda n: " ".join(word() for _ in range(n))
    item = body(30)
    docs = [(i, f"{body(40)}\n{body(6)}") for i in range(60)]
    docs += [(100 + i, "### buy !!! " * 12 + body(3)) for i in range(60)]
    docs += [(200, docs[3][1]), (201, docs[4][1] + " end"), (None, docs[5][1]), (None, None), (202, ""), (203, f"{body(20)} {item} {body(20)}")]
    docs += [(204 + i, f"{docs[i][1].splitlines()[1]}\n{body(40)}") for i in range(3)]
    rows = [(i, t, "en", f"s{(i or 0) % 2}", len(t or "")) for i, t in docs]
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, int(i < 100), 0) for i, _ in docs[:120]], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")

    data = spark.read.parquet(f"{tmp_path}/documents.parquet")
    good = {(x.doc_id, x.text) for x in corpus_pipeline.keep_quality(spark, data, str(tmp_path)).collect()}
    assert not any(t and t.startswith("###") for _, t in good) and {d for d in docs[:60]} <= good
    # one of each group of near copies: the least id, rows without one last
    ordered = sorted(good, key=lambda d: (d[0] is None, d[0] or 0))
    components = brute.jaccard([(n, t) for n, (_, t) in enumerate(ordered)], 5, 80)
    one = [d for n, d in enumerate(ordered) if components[n][2] == n]
    lines, kept = set(), []
    for i, t in one:
        own = [x for x in (t or "").split("\n") if x]
        left = "\n".join(x for x in own if x not in lines)
        lines |= set(own)
        kept.append((i, left if t is not None else None))
    want = {i for i, t in kept if item not in (t or "")}
    sizes = {i: len(brute.words(t)) for i, t in kept if i in want}
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {x.doc_id: x.size for x in out} == sizes and len(out) == len([1 for i, t in kept if i in want])
    for x in out:
        assert x.taken in (0, x.size, 2 * x.size)
