"""Whole lines as units, ranks of rows, and column names that could clash."""

import random

import brute
from acervo.llm.line_dedup import line_dedup

SCHEMA = "doc_id long, text string"


def line_units(text):
    """[(start, end of the line's words, words)] of the lines that hold words."""
    out, at = [], 0
    for line in (text or "").split("\n"):
        if w := tuple(brute.words(line)):
            out.append((at, w))
        at += len(line) + 1
    return out


def test_whole_lines_against_brute_force(spark):
    r = random.Random(8)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(4))
    pool = [" ".join(word() for _ in range(n)) + "." for n in (1, 1, 2, 3, 5, 8, 30)]
    docs = []
    for i in range(80):
        lines = [r.choice(pool) if r.random() < 0.4 else " ".join(word() for _ in range(r.randint(1, 9))) for _ in range(r.randint(0, 7))]
        docs.append((None if i % 11 == 0 else r.randint(0, 50), "\n".join(lines)))
    docs += [(3, docs[5][1]), docs[7], (None, None), (60, ""), (61, " \n \n"), (62, "x " * 5000), (63, "x " * 5000)]
    rank = lambda d: (2**63 - 1 if d[0] is None else d[0])
    first = {}
    for d in docs:
        for _, w in line_units(d[1]):
            first.setdefault(w, set()).add((rank(d), d[1]))
    out = line_dedup(spark.createDataFrame(docs, SCHEMA).repartition(3), unit="line").collect()
    assert len(out) == len(docs)
    left = {w: sum(1 for o in out for _, u in line_units(o.text) if u == w) for w in first}
    rows = {}
    for d, t in docs:
        rows.setdefault((rank((d, t)), t), 0)
        rows[(rank((d, t)), t)] += 1
    for w, holders in first.items():
        low = min(i for i, _ in holders)
        keepers = [h for h in holders if h[0] == low]
        # one row keeps the line (each repeat of that row does); it is of the lowest id
        assert left[w] in {rows[h] for h in keepers}, (w, left[w])
    for o in out:
        assert (not o.dedup.spans) == (o.dedup.n_removed == 0) and o.dedup.n_removed <= o.dedup.n_units


def test_short_sentences_within_lines_stay(spark):
    docs = [(1, "A first line of its own. Of the. In."), (2, "A second line, also its own. Of the. In. And more of it")]
    assert {r.doc_id: r.text for r in line_dedup(spark.createDataFrame(docs, SCHEMA), unit="line").collect()} == dict(docs)


def test_passage_with_short_sentences_goes(spark):
    r = random.Random(9)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(5))
    passage = " ".join(" ".join(word() for _ in range(5)) + ". No. It is. " + word() for _ in range(8)) + "."
    docs = [(1, f"{word()} {word()} {word()}. {passage} {word()} {word()}"), (2, f"{word()} {word()} {word()} {word()}. {passage} {word()} {word()} {word()}")]
    out = {x.doc_id: x.text for x in line_dedup(spark.createDataFrame(docs, SCHEMA), unit="line").collect()}
    assert out[1] == docs[0][1] and len(out[2].split()) <= 12


def test_rows_without_id_and_rows_that_share_one(spark):
    docs = [(None, "shared line here\nown a"), (5, "shared line here\nown b"), (5, "shared line here\nown c"), (None, "own d\nother shared line"), (None, "own e\nother shared line")]
    out = [r.text for r in line_dedup(spark.createDataFrame(docs, SCHEMA), unit="line").collect()]
    assert sum("shared line here" in t for t in out) == 1 and sum("other shared line" in t for t in out) == 1
    assert "own a" in out and sum("shared line here" in r.text for r in line_dedup(spark.createDataFrame(docs, SCHEMA), unit="line").where("doc_id = 5").collect()) == 1


def test_columns_of_the_caller_stay(spark):
    names = ["doc_id", "text", "_id", "_found", "id", "t", "found", "row", "h1", "first", "dedup", "a.b"]
    data = spark.createDataFrame([(1, "a line of words", *range(10)), (2, "a line of words\nmore", *range(10))], names)
    out = line_dedup(data, unit="line")
    assert out.columns == [c for c in names if c != "dedup"] + ["dedup"]
    got = {r.doc_id: r for r in out.collect()}
    assert got[2].text == "more" and [got[2][c] for c in ("_id", "_found", "id", "t", "found", "row", "h1", "first", "a.b")] == [0, 1, 2, 3, 4, 5, 6, 7, 9]


def test_short_sentence_of_its_own_between_repeated_ones_stays(spark):
    one, two = "the quick brown fox jumps over nine lazy dogs.", "and eight more of them sleep beside the river."
    docs = [(1, f"{one} Yes. {two}"), (2, f"{one} Never again. {two}"), (3, f"{one} Yes. {two}"), (4, f"Oh. {one} Yes. {two}")]
    out = {r.doc_id: r for r in line_dedup(spark.createDataFrame(docs, SCHEMA)).collect()}
    assert out[1].text == docs[0][1] and "Never again." in out[2].text
    assert out[3].text == ""
    assert out[4].text.split() == ["Oh."]


def test_no_word_goes_that_stands_nowhere_earlier(spark):
    """Spans, digests and texts of random documents of shared and own sentences, short ones among them."""
    import hashlib

    r = random.Random(21)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(5))
    sentence = lambda n: " ".join(word() for _ in range(n)) + r.choice(".!?")
    pool = [sentence(n) for n in (1, 1, 2, 2, 4, 7, 9, 12, 20, 33)]
    docs = []
    for i in range(60):
        parts = [r.choice(pool) if r.random() < 0.7 else sentence(r.choice([1, 1, 2, 3, 9])) for _ in range(r.randint(1, 12))]
        docs.append((i, "".join(p + r.choice([" ", " ", "\n"]) for p in parts)))
    out = {x.doc_id: x for x in line_dedup(spark.createDataFrame(docs, SCHEMA), unit="line").collect()}
    pairs, lines, gone_words, short_gone = set(), set(), 0, 0
    for i, text in docs:  # ids are ranks
        raw, row = text.encode(), out[i]
        kept_bytes, at = b"", 0
        for s in row.dedup.spans:
            assert at <= s.start < s.end <= len(raw)
            kept_bytes, at = kept_bytes + raw[at : s.start], s.end
        kept_bytes += raw[at:]
        assert row.text.encode() == kept_bytes and row.dedup.kept_sha256 == hashlib.sha256(kept_bytes).hexdigest()
        own, place, before = [], 0, None
        for line in text.split("\n"):
            key = " ".join(line.split())
            words = key.split()
            for w in words:
                place = text.index(w, place)
                own.append((w, place, key))
                place += len(w)
        for k, (w, begin, key) in enumerate(own):
            if any(s.start <= begin < s.end for s in row.dedup.spans):
                gone_words += 1
                short_gone += w[-1] in ".!?" and (k == 0 or own[k - 1][0][-1] in ".!?")
                seen_line = key in lines or sum(x[2] == key for x in own[:k]) > 0
                near = {(own[j][0], own[j + 1][0]) for j in (k - 1, k) if 0 <= j < len(own) - 1}
                earlier = pairs | {(a[0], b[0]) for a, b in zip(own[:k], own[1:k], strict=False)}
                assert seen_line or near & earlier, (i, w)
        lines |= {x[2] for x in own}
        pairs |= {(a[0], b[0]) for a, b in zip(own, own[1:], strict=False)}
    assert gone_words > 300 and short_gone > 5
