import hashlib
import random
import zlib

import brute
import pytest

from acervo.llm import chat, decontaminate, license_scan, line_dedup, matroska, mixing, ngram_jaccard, quality, suffix_dedup, url_rules
from pyspark.sql import functions as F

DOCS = "doc_id long, text string, lang string, source string, n_chars long, dedup string"


def corpus(n=60, seed=3):
    """Copies, near copies, shared passages, nulls, blanks, a repeated row, and a long text."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(r.randint(2, 6)))
    sentence = lambda: " ".join(word() for _ in range(r.randint(4, 14))).capitalize() + "."
    passage = " ".join(sentence() for _ in range(9))
    texts = []
    for i in range(n):
        if i % 6 == 1:
            w = texts[-1].split(" ")
            w[len(w) // 2] = "ÉDIT"
            texts.append(" ".join(w))
        elif i % 6 == 2:
            texts.append(texts[-2])
        elif i % 6 == 3:
            texts.append(sentence() + "\n" + passage + " " + sentence())
        else:
            texts.append("\n".join(" ".join(sentence() for _ in range(3)) for _ in range(r.randint(3, 6))))
    texts += ["", None, "  \n ", "one two", "ONE two", "ab" * 400, " ".join(word() for _ in range(3000))]
    return [(i, t) for i, t in enumerate(texts)] + [(0, texts[0]), (None, texts[4])]


def frame(spark, docs):
    return spark.createDataFrame([(i, t, "en", f"s{(i or 0) % 3}" if i != 5 else None, None, "x") for i, t in docs], DOCS).repartition(3)


@pytest.mark.parametrize(("n", "percent"), [(3, 90), (5, 80)])
def test_jaccard(spark, n, percent):
    docs = corpus()
    got = ngram_jaccard.ngram_jaccard(frame(spark, docs), ngram=n, percent=percent).collect()
    assert sorted(str((r.doc_id, r.n_shingles, r.component_id)) for r in got) == sorted(map(str, brute.jaccard(docs, n, percent)))


def test_suffix(spark):
    docs = corpus()
    got = suffix_dedup.suffix_dedup(frame(spark, docs), length=200).collect()
    assert sorted(str((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256)) for r in got) == sorted(map(str, brute.suffix(docs, 200)))


def test_large_groups_are_split(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "GROUP", 2)
    docs = corpus(30)
    got = suffix_dedup.suffix_dedup(frame(spark, docs), length=120).collect()
    assert sorted(str((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256)) for r in got) == sorted(map(str, brute.suffix(docs, 120)))


def test_deep_shallow():
    import numpy as np

    r = np.random.default_rng(1)
    rows = r.integers(97, 99, (300, 90)).astype(np.uint8)
    rows[100:200, :70] = rows[0, :70]
    rows[150:200] = rows[150]
    group = r.integers(0, 4, 300)
    order, prefix = suffix_dedup.deep_shallow(rows, group)
    listed = [(group[i], rows[i].tobytes()) for i in order]
    assert listed == sorted(listed)
    for k in range(1, 300):
        (g, a), (h, b) = listed[k - 1], listed[k]
        assert prefix[k] == (next((i for i in range(90) if a[i] != b[i]), 90) if g == h else -1)


def test_lines(spark):
    docs = [d for d in corpus() if d[0] is not None][:-1]
    out = line_dedup.line_dedup(frame(spark, docs), min_words=25)
    got = [(r.doc_id, r.dedup.n_units, r.dedup.n_removed, r.text or "", r.dedup.kept_sha256) for r in out.collect()]
    want = [(*r, hashlib.sha256(r[3].encode()).hexdigest()) for r in brute.lines(docs, 25)]
    assert sorted(map(str, got)) == sorted(map(str, want))
    assert any(r[2] for r in got)


def test_quality_learns_and_respects_held_out_rows(spark):
    r = random.Random(1)
    docs = [(i, ("### " if i % 3 == 0 else "") + " ".join(r.choice(["stone", "river", "hill", "###" if i % 3 == 0 else "tree"]) for _ in range(40))) for i in range(300)] + [(999, None), (1000, "")]
    data = frame(spark, docs)
    labels = spark.createDataFrame([(i, int(i % 3 != 0), 0) for i in range(300)], "doc_id long, quality int, toxic int")
    out = {x.doc_id: x for x in quality.quality(data, labels).collect()}
    assert len(out) == len(docs) and all(0 <= x.score <= 1 for x in out.values())
    held = [i for i in range(300) if out[i].held_out]
    assert all((zlib.crc32(str(i).encode()) % 4 == 2) == out[i].held_out for i in range(300))
    assert sum(out[i].predicted == int(i % 3 != 0) for i in held) / len(held) > 0.95
    flipped = labels.withColumn("quality", F.when(quality.held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")).cast("int"))
    assert {x.doc_id: x.score for x in quality.quality(data, flipped).collect()} == {i: x.score for i, x in out.items()}


def test_mix(spark):
    docs = corpus(90)
    out = mixing.mix(frame(spark, docs)).collect()
    assert len(out) == len(docs)
    by = {}
    for x in out:
        assert x.taken <= 2 * x.size and (not x.size or x.taken % x.size == 0)
        t = by.setdefault((x.source_size, x.target), [0, 0])
        t[0] += x.taken
        t[1] += x.size
    for (size, target), (taken, total) in by.items():
        assert total == size and abs(taken - target) <= 1 and target <= 2 * size
    assert abs(sum(t for _, t in by) - 1.5 * sum(s for s, _ in by)) < 1e-6


def test_fit_budget_is_exact_where_it_can_be():
    assert sum(n * c for n, c in mixing.fit_budget({7: 10, 11: 4, 3: 1}, 60).items()) == 60
    assert sum(n * c for n, c in mixing.fit_budget({10: 3}, 25).items()) == 20
    assert mixing.fit_budget({}, 5) == {}


def test_matroska(spark):
    docs = corpus(20) + [(77, "x" * 300_000)]
    out = matroska.media_columns(frame(spark, docs)).collect()
    want = {}
    for i, t in docs:
        raw = (t or "").encode()
        pay = raw + bytes(-len(raw) % 64 if raw else 64)
        want.setdefault(i, []).append((len(raw), len(pay), hashlib.sha256(pay).hexdigest(), zlib.crc32(pay[-64:])))
    assert len(out) == len(docs)
    for x in out:
        assert (x.n_bytes, x.payload_bytes, x.payload_sha256, x.tail_crc32) in want[x.doc_id]


def test_matroska_lacing_and_broken_files(spark):
    block = lambda flags, body: matroska.element(matroska.SIMPLE_BLOCK, b"\x81\x00\x05" + bytes([flags]) + body)
    xiph = block(0x82, bytes([1, 255, 1]) + b"a" * 256 + b"b" * 9)
    ebml = block(0x86, bytes([2]) + matroska.vint(5) + matroska.vint(2 + 63, 1) + b"c" * 5 + b"d" * 7 + b"e")
    body = matroska.element(matroska.CLUSTER, matroska.number(matroska.TIMESTAMP, 10) + xiph + ebml)
    data = matroska.element(matroska.SEGMENT, body)
    packets, _ = matroska.parse(data)
    assert [(t, ts, data[o : o + n]) for t, ts, o, n in packets] == [(1, 15, b"a" * 256), (1, 15, b"b" * 9), (1, 15, b"c" * 5), (1, 15, b"d" * 7), (1, 15, b"e")]
    for cut in range(1, len(data)):
        try:
            matroska.parse(data[:cut])
        except ValueError:
            pass
    table = matroska.packet_table(spark.createDataFrame([(1, data), (2, None), (3, data[:40])], "doc_id long, media binary")).collect()
    assert [x.packet for x in table if x.doc_id == 1] == [0, 1, 2, 3, 4] and [x.packet for x in table if x.doc_id == 3] == [-1]


def test_urls(spark):
    urls = [("http://Example.COM/en/7x?q", "example.com/en/7", "allow"), ("https://a.example.com/en/8", "com/en/", "block"), ("http://b.example.net/de/81", "example.net/de/8", "block"), ("http://b.net/de/", "net/de/", "allow"), (None, None, "allow"), ("nothing", None, "allow"), ("http://notorg/es/", None, "allow")]
    pages = spark.createDataFrame([(i, u) for i, (u, _, _) in enumerate(urls)] + [(100 + i, f"http://bad.test/{i}" if i % 2 else f"http://ok.test/{i}") for i in range(40)], "page_id long, url string")
    labels = spark.createDataFrame([(100 + i, 1 - i % 2, 0) for i in range(40)], "doc_id long, quality int, toxic int")
    out = {x.page_id: x for x in url_rules.judge(pages, labels).collect()}
    assert [(out[i].rule, out[i].verdict) for i in range(len(urls))] == [(r, v) for _, r, v in urls]
    assert out[0].host == "example.com" and out[0].path == "/en/7x"
    assert {out[100 + i].verdict for i in range(1, 40, 2)} == {"block"} and {out[100 + i].verdict for i in range(0, 40, 2)} == {"allow"}


def test_licenses(spark):
    bsd = " ".join(s for k in ("bsd-grant", "bsd-source", "bsd-binary") for s in license_scan.SENTENCES[k])
    docs = [(1, "Words here.\nReleased under the  MIT license."), (2, bsd), (3, None), (4, "plain"), (5, "Licensed under CC BY-NC 4.0.\n" + license_scan.SENTENCES["bsd-grant"][0])]
    out = {x.doc_id: x for x in license_scan.license_scan(frame(spark, docs)).collect()}
    assert {i: x.licenses for i, x in out.items()} == {1: "MIT", 2: "BSD-2-Clause", 3: "", 4: "", 5: "CC-BY-NC-4.0"}
    assert out[1].first_offset == 12 and out[4].first_offset == -1


def test_leaks(spark):
    docs = [d for d in corpus() if d[0] is not None][:-1]
    r = random.Random(9)
    items = [(k, " ".join("".join(r.choice("klmnop") for _ in range(5)) for _ in range(20))) for k in range(12)]
    docs = [(i, t + " " + items[i % 12][1] + " end" if t and i % 4 == 0 else t) for i, t in docs]
    bench = spark.createDataFrame([*items, (50, None), (51, " ")], "item_id long, text string")
    got = {(x.doc_id, x.item_id) for x in decontaminate.leaks(frame(spark, docs), bench).collect()}
    want = {(i, k) for i, t in docs for k, x in items if len(brute.shingles(x, 5) & brute.shingles(t, 5)) / len(brute.shingles(x, 5)) >= 0.8}
    assert got == want and want
    kept = {x.doc_id for x in decontaminate.decontaminate(frame(spark, docs), bench).collect()}
    assert kept == {i for i, _ in docs} - {i for i, _ in want}


def test_chat(spark):
    turns = [(1, 0, "user", "a<b & c"), (1, 1, "user", None), (1, 2, "assistant", "<|end|>\n&lt;"), (1, 3, "assistant", "é"), (2, 0, None, "x\n"), (3, 1, "ro\nle<", ""), (3, 0, "assistant", "</s>[INST]")]
    data = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
    back = {x.conv_id: x for x in chat.read_chats(chat.format_chats(data)).collect()}
    for c in (1, 2, 3):
        want = [(r or "", t or "") for _, _, r, t in sorted((x for x in turns if x[0] == c), key=lambda x: x[1])]
        assert [(t.role, t.text) for t in back[c].turns] == want
        assert back[c].loss_text == "".join(t for r, t in want if r == "assistant")


def test_empty_tables(spark):
    none = frame(spark, [(1, "x")]).limit(0)
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    bench = spark.createDataFrame([], "item_id long, text string")
    pages = spark.createDataFrame([], "page_id long, url string")
    for out in (ngram_jaccard.ngram_jaccard(none), quality.quality(none, labels), mixing.mix(none), matroska.media_columns(none), url_rules.judge(pages, labels), line_dedup.line_dedup(none), license_scan.license_scan(none), suffix_dedup.suffix_dedup(none), decontaminate.leaks(none, bench)):
        assert out.count() == 0
