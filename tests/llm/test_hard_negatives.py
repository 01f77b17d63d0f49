"""Hard negatives against plain Python, with small blocks and chunks."""

import math
import random

import pytest
from pyspark.sql import functions as F

from acervo.llm import hard_negatives as module
from acervo.llm.hard_negatives import hard_negatives

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, is_anchor, positives=5, negatives=10):
    able = {}
    for i, v, label in rows:
        if i is None or v is None or label is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        row = (label, [max(-(1 << 63), min((1 << 63) - 1, math.floor(256 * x))) for x in v])
        able[i] = min(able.get(i, row), row)
    out = []
    for a, (label, v) in able.items():
        if not is_anchor(a):
            continue
        scores = {b: max(-(1 << 63), min((1 << 63) - 1, sum(x * y for x, y in zip(v, w, strict=True)))) for b, (_, w) in able.items() if b != a and len(w) == len(v)}
        best = sorted((-s, b) for b, s in scores.items() if able[b][0] == label)[:positives]
        for s, p in [(-s, p) for s, p in best]:
            hard = sorted((-t, b) for b, t in scores.items() if able[b][0] != label and 30 * s <= 100 * t <= 90 * s)[:negatives]
            out += [(a, p, rank, b, s, -t) for rank, (t, b) in enumerate(hard, 1)]
    return sorted(out)


def run(spark, rows, schema=SCHEMA, **options):
    return sorted(map(tuple, hard_negatives(spark.createDataFrame(rows, schema), F.col("vec_id") % 10 == 0, **options).collect()))


@pytest.mark.parametrize(("block", "chunk"), [(1 << 13, 1 << 11), (16, 3)])
def test_against_plain_python(spark, monkeypatch, block, chunk):
    monkeypatch.setattr(module, "BLOCK", block)
    monkeypatch.setattr(module, "CHUNK", chunk)
    monkeypatch.setattr(module, "FIRST", 2)
    draw = random.Random(3)
    rows = [(i, [round(draw.gauss(0, 0.3), 1) for _ in range(4)], draw.randint(0, 2)) for i in range(160)]
    rows += [(200 + i, [0.5, -0.5, 0.25, 0.0], i % 3) for i in range(40)]  # ties over blocks
    rows += [(300, [0.0] * 4, 1), (310, None, 1), (320, [None, 1.0, 1.0, 1.0], 1), (321, [math.nan, 1.0, 1.0, 1.0], 1), (322, [math.inf, 1.0, 1.0, 1.0], 2), (330, [0.1] * 4, None), (None, [1.0] * 4, 1), (331, [0.5, 0.5], 1), (340, [0.5, 0.4], 1), (341, [0.25, 0.25], 0), (350, [], 1), (351, [], 1), (352, [], 2)]
    rows += [rows[0], (0, rows[1][1], 2)]
    want = brute(rows, lambda i: i % 10 == 0)
    assert any(r[0] == 300 for r in want) and any(r[0] == 350 for r in want) and any(r[0] == 340 for r in want)
    assert run(spark, rows) == want


def test_large_components_stay_exact(spark):
    draw = random.Random(4)
    rows = [(i, [draw.choice([-1, 1]) * draw.random() * 10.0 ** draw.choice([0, 4, 9]) for _ in range(3)], i % 2) for i in range(60)]
    schema = SCHEMA.replace("float", "double")
    assert run(spark, rows, schema) == brute(rows, lambda i: i % 10 == 0)
    far = [(0, [1e300, 0.0], 0), (1, [1e300, 0.0], 0), (2, [3e16, 0.0], 1), (3, [0.001, 0.0], 1)]
    assert run(spark, far, schema) == brute(far, lambda i: i % 10 == 0)


def test_few_rows_and_clashing_columns(spark):
    assert run(spark, []) == []
    assert run(spark, [(0, [1.0], 1)]) == []
    assert run(spark, [(1, [1.0], 1), (2, [1.0], 1)]) == []
    rows = [(0, [1.0, 0.0], 1, 5, 6, "a"), (1, [1.0, 0.0], 1, 5, 6, "b"), (2, [0.5, 0.0], 2, 5, 6, "c")]
    assert run(spark, rows, SCHEMA + ", rank int, id int, block string") == [(0, 1, 1, 2, 65536, 32768)]


def test_reads_less_than_all_rows():
    import numpy as np

    rows = np.arange(-500, 500)[:, None] * np.array([[2, 3]])
    lists, reads = module.Lists(rows), 0
    for at, _, threshold in lists.accesses(np.array([1, 1])):
        reads += len(at)
        if threshold < 2400:
            break
    assert reads == module.FIRST
