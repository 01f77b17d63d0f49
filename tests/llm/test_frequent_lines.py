"""Dropping of shared lines against plain Python."""

import random

from pyspark.sql import functions as F

from acervo.llm import frequent_lines
from acervo.llm.frequent_lines import drop_frequent_lines

BLANKS = " \t\n\x0b\x0c\r"


def _lower(s):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s)


def brute(rows, min_chars, min_docs):
    """(id, text, n_lines, n_dropped) of each row; an id of None ranks below all others."""
    rank = lambda i: (i is not None, i or 0)
    split = [(i, (t or "").split("\n")) for i, t in rows]
    holders = {}
    for i, lines in split:
        for line in lines:
            holders.setdefault(_lower(line.strip(BLANKS)), set()).add(i)
    stays = {k: max(ids, key=rank) for k, ids in holders.items() if len(k) >= min_chars and len(ids) >= min_docs}
    out = []
    for i, lines in split:
        left = [x for x in lines if (k := _lower(x.strip(BLANKS))) not in stays or stays[k] == i]
        out.append((i, "\n".join(left), len(lines), len(lines) - len(left)))
    return sorted(out, key=str)


def run(spark, rows, schema="doc_id long, text string", **options):
    out = drop_frequent_lines(spark.createDataFrame(rows, schema), **options)
    return sorted([(r.doc_id, r.text, r.lines.n_lines, r.lines.n_dropped) for r in out.collect()], key=str)


def test_against_plain_python(spark, monkeypatch):
    draw = random.Random(5)
    pool = ["  Shared line %d É" % i for i in range(8)] + ["", " ", "x", "SHARED LINE 1 É\t", "shared line 1 é"]
    rows = [(draw.choice([None, *range(12)]), draw.choice([None, "", "\n"] + ["\n".join(draw.choices(pool, k=draw.randint(1, 9)))] * 9)) for _ in range(80)]
    rows += rows[:5]
    want = brute(rows, 10, 3)
    assert want != brute(rows, 10, 99)
    assert run(spark, rows, min_chars=10, min_docs=3) == want
    monkeypatch.setattr(frequent_lines, "SENT_LONGS", -1)  # joins in place of broadcasts
    assert run(spark, rows, min_chars=10, min_docs=3) == want


def test_thresholds_and_largest_id(spark):
    line = "a line of exactly forty code points: áé."
    assert len(line) == 40
    rows = [(i, f"{line}\n{line[:39]}\n{line.upper().replace('ÁÉ', 'áé')}") for i in range(5)]
    got = run(spark, rows)
    assert got == brute(rows, 40, 5)
    assert [r[3] for r in got] == [2, 2, 2, 2, 0]
    assert run(spark, rows[:4]) == brute(rows[:4], 40, 5)


def test_empty_table_long_text_and_clashing_columns(spark):
    assert run(spark, []) == []
    long = "\n".join(["a common line that stands in all of the texts"] * 20_000 + ["end"])
    rows = [(i, long) for i in range(6)]
    assert run(spark, rows) == brute(rows, 40, 5)
    docs = spark.createDataFrame([(1, "a", 7, "b")], "doc_id long, text string, lines int, word string").withColumn("x", F.lit(1)).withColumn("x_1", F.lit(2))
    out = drop_frequent_lines(docs)
    assert out.columns == ["doc_id", "text", "word", "x", "x_1", "lines"]
    assert out.first().lines.n_lines == 1


def test_no_python_on_executors(spark):
    plan = drop_frequent_lines(spark.createDataFrame([(1, "a")], "doc_id long, text string"))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
