"""The prefix trie against a plain dictionary of prefixes, with ranges of a few turns."""

import hashlib
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from acervo.llm.prefix_trie import prefix_trie, rebuilt, sequences

SCHEMA = "conv_id long, turn long, role string, text string"


def ordered(rows):
    chats = {}
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            digest = hashlib.md5(f"{len(role)}:{role}{text}".encode()).hexdigest()
            chats.setdefault(c, []).append((turn is not None, turn or 0, digest, role, text))
    return {c: [t[3:] for t in sorted(turns)] for c, turns in chats.items()}


def brute(chats, rebuild=True):
    if rebuild:
        h = {c: zlib.crc32(str(c).encode()) % 4 for c in chats}
        base = lambda c: (abs(c) - abs(c) % 20) * (1 if c >= 0 else -1)
        chats = {c: chats.get(base(c), [])[: h[c]] + turns[h[c] :] for c, turns in chats.items()}
    members = {}
    for c, turns in chats.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
    out = []
    for prefix, ids in members.items():
        below = [p for p in members if p[: len(prefix)] == prefix]
        leaves = [p for p in below if not any(len(q) == len(p) + 1 and q[: len(p)] == p for q in below)]
        saved = sum((len(members[p]) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", p[-1][1])) for p in below if p)
        ends = ",".join(str(c) for c in sorted(ids) if len(chats[c]) == len(prefix))
        out.append((min(ids), len(prefix), min(members[prefix[:-1]]) if prefix else None, len(ids), sum(len(p) == len(prefix) + 1 for p in below), len(leaves), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def run(spark, rows, schema=SCHEMA, rebuild=True, **options):
    chats = sequences(spark.createDataFrame(rows, schema))
    return sorted(map(tuple, prefix_trie(rebuilt(chats) if rebuild else chats, **options).collect()), key=str)


@pytest.mark.parametrize("part", [1 << 16, 40, 7])
def test_against_dictionary(spark, part):
    draw = random.Random(11)
    texts = [None, "", "a b", "a  b", " c\n", "d e f"]
    rows = []
    for c in [*range(-25, 60), 20, 140, 161]:
        rows += [(c, draw.choice([None, i, i]), draw.choice([None, "user", "assistant"]), draw.choice(texts)) for i in range(draw.choice([1, 1, 2, 5]))]
    rows += [(None, 1, "user", "lost"), *rows[:6]]
    draw.shuffle(rows)
    assert run(spark, rows, part=part) == brute(ordered(rows))


@pytest.mark.parametrize("part", [1 << 16, 50])
def test_many_equal_conversations_and_a_long_one(spark, part):
    turns = [("user", "hello there"), ("assistant", "general"), ("user", "bye")]
    rows = [(c, i, *t) for c in range(60) for i, t in enumerate(turns[: 1 + c % 3])]
    rows += [(1000, i, "user", "one more word") for i in range(300)]
    chats = ordered(rows)
    assert run(spark, rows, rebuild=False, part=part) == brute(chats, rebuild=False)


def test_turnless_empty_and_clashing_columns(spark):
    assert run(spark, []) == []
    turnless = next(c for c in range(21, 40) if zlib.crc32(str(c).encode()) % 4)
    got = run(spark, [(turnless, 0, "user", "a")])
    assert got == brute(ordered([(turnless, 0, "user", "a")])) and len(got) == 1
    rows = [(1, 1, "user", "a", "x", 1), (2, 1, "user", "a", "y", 2)]
    assert run(spark, rows, SCHEMA + ", seq string, part int") == brute(ordered([r[:4] for r in rows]))


def test_words_of_a_very_long_text(spark):
    rows = [(c, 0, "user", "word " * 200_000) for c in (0, 20)]
    assert run(spark, rows, rebuild=False) == brute(ordered(rows), rebuild=False)
    assert sequences(spark.createDataFrame(rows, SCHEMA)).select(F.col("turns")[0]["words"]).first()[0] == 200_000
