import random

import pytest
from acervo.operators import hybrid
from acervo.operators.hybrid import hashed_vector, hybrid_search
from acervo.sinks.index import read_index, update_index
from pyspark.sql import functions as F

WORDS = "stone river hill tree lake of a to ñandú".split()


def plain(chunks, queries, k, base=60):
    """Ranks of all chunks for each query, in plain Python."""
    out = []
    for q, text, group, qv in queries:
        terms = [w for w in text.lower().split() if len(w) > 2]
        rows = []
        for a, b, g, body, v in chunks:
            if group is not None and g != group:
                continue
            words = (body or "").lower().split()
            dot, norms = (sum(x * y for x, y in zip(v, qv, strict=True)), (sum(x * x for x in v) * sum(x * x for x in qv)) ** 0.5) if v and len(v) == len(qv) else (0, 0)
            bm = sum(words.count(t) * 2.5 / (words.count(t) + 1.5 * (0.25 + 0.75 * len(words) / 200)) for t in terms)
            rows.append((a, b, round(dot / norms, 6) if norms else 0.0, round(bm, 4)))
        ranks = [{r[:2]: i for i, r in enumerate(sorted(rows, key=lambda r: (-r[m], r[:2])), 1)} for m in (2, 3)]
        raw = {r: sum(1 / (base + x[r[:2]]) for x in ranks) for r in rows}
        scored = sorted(rows, key=lambda r: (-round(raw[r], 5), r[:2]))[:k]
        out += [(q, *r[:2], i, round(raw[r], 5), min(99.9, round(raw[r] * 3000, 1)), *r[2:]) for i, r in enumerate(scored, 1)]
    return sorted(out)


@pytest.mark.parametrize("most", [256, 2])
def test_many_queries_against_plain_python(spark, monkeypatch, most):
    monkeypatch.setattr(hybrid, "QUERIES", most)
    r = random.Random(7)
    vector = lambda: [round(r.random() - 0.4, 2) for _ in range(5)]
    chunks = [(i // 3, i % 3, r.choice(["x", "y", None]), " ".join(r.choices(WORDS, k=r.randint(1, 30))), vector()) for i in range(900)]
    chunks += [(400, 0, "x", None, None), (401, 0, "y", "river", [1.0]), (402, 0, "x", "", [0.0] * 5)]
    queries = [(q, " ".join(r.choices(WORDS, k=4)), r.choice([None, "x", "y"]), vector()) for q in range(5)] + [(9, "of a to", "none", vector())]
    data = spark.createDataFrame(chunks, "doc_id long, chunk long, grp string, body string, vector array<double>").repartition(5)
    asked = spark.createDataFrame(queries, "query_id long, text string, grp string, vector array<double>")
    got = hybrid_search(data, asked, group="grp", query_group="grp", k=7)
    assert sorted(map(tuple, got.collect())) == plain(chunks, queries, 7)


def test_no_queries_and_no_chunks(spark):
    chunks = spark.createDataFrame([], "doc_id long, chunk long, body string, vector array<double>")
    asked = spark.createDataFrame([(1, "river", [1.0])], "query_id long, text string, vector array<double>")
    assert hybrid_search(chunks, asked).collect() == []
    assert hybrid_search(chunks, asked.limit(0)).columns == ["query_id", "doc_id", "chunk", "rank", "score", "pct", "cosine", "bm25"]


def test_hashed_vector_has_unit_length(spark):
    v = spark.createDataFrame([("a b a",), ("",), (None,)], "t string").select(hashed_vector(F.col("t")).alias("v")).collect()
    assert abs(sum(x * x for x in v[0].v) - 1) < 1e-5 and len(v[0].v) == 128 and max(v[0].v) == 0.894427
    assert v[1].v == v[2].v == [0.0] * 128


def test_index_follows_edits(spark, tmp_path):
    path, rebuilt = str(tmp_path / "index"), str(tmp_path / "rebuilt")
    rows = {i: f"text {i} " + "word " * (i * 40) for i in range(1, 60)}
    frame = lambda d: spark.createDataFrame(list(d.items()), "doc_id long, text string")
    counts = lambda d, p: {r.state: r.n for r in update_index(frame(d), p, parts=8).collect()}
    assert counts(rows, path) == {"new": 59}
    files = {f: f.stat().st_mtime_ns for f in (tmp_path / "index").rglob("*.parquet")}
    edited = {k: v for k, v in rows.items() if k != 7} | {3: "another text", 99: "an added one", 100: "  ", 101: None}
    assert counts(edited, path) == {"new": 1, "changed": 1, "gone": 1, "same": 57}
    left = {f for f in files if f.exists()}
    assert left and len(left) < len(files)  # other parts were not written
    assert counts(edited, rebuilt) == {"new": 59}
    read = lambda p: sorted(map(tuple, read_index(spark, p).select("key", "sha", "chunk", "body", "vector", "part").collect()))
    assert read(path) == read(rebuilt)
    assert counts(edited, path) == {"same": 59}
    assert counts({3: "another text"}, path) == {"gone": 58, "same": 1}
    assert [r[0] for r in read(path)] == ["3"]
    assert {r.state: r.n for r in update_index(frame({3: "another text"}), path, parts=8, size=64).collect()} == {"invalid": 1}
    assert len(read(path)[0][4]) == 64
