import random
import re

import pytest
from acervo.operators import sections
from pyspark.sql import functions as F


def plain_chunks(md, most=1500, overlap=200):
    path, body, found, out = ["", "", ""], [], [], []

    def close():
        text = "\n".join(body).strip()
        if len(text) > 30:
            found.append((" > ".join(x for x in path if x) or "Introducción / General", text))
        body.clear()

    for line in md.splitlines():
        m = re.match(r"(#{1,3})\s+(.*)$", line.strip())
        if not m:
            body.append(line)
            continue
        close()
        level = len(m[1])
        path[level - 1 :] = [m[2].strip()] + [""] * (3 - level)
    close()
    for title, text in found or [("Documento Completo", md.strip())]:
        parts, now, size = [], [], 0
        pieces = [text] if len(text) <= most else [q.strip() for p in text.split("\n\n") for q in ([p.strip()] if len(p.strip()) <= most else [p.strip()[i : i + most] for i in range(0, len(p.strip()), most - overlap)]) if q.strip()]
        for p in pieces:
            if now and size + len(p) > most:
                parts.append(now)
                now = [now[-1], p] if len(now[-1]) < 2 * overlap else [p]
                size = sum(map(len, now))
            else:
                now = [*now, p]
                size += len(p) + 2
        parts += [now] if now else []
        out += [(f"{title} (Parte {i + 1})" if len(parts) > 1 else title, f"[Sección: {title}]\n" + "\n\n".join(p)) for i, p in enumerate(parts)]
    return out


def texts():
    r = random.Random(3)
    word = lambda: "".join(r.choice("abcdeé") for _ in range(r.randint(1, 9)))
    made = ["\n".join(r.choice(["# ", "## ", "### ", "#### ", "", "", "", "  # "]) + " ".join(word() for _ in range(r.randint(0, 60))) + r.choice(["", "\n"]) for _ in range(r.randint(1, 40))) for _ in range(60)]
    return [*made, "", "short", "# only a title", "x" * 4000, "# A\n" + "y " * 2500 + "\n## B\n" + "z" * 40]


def test_chunks_by_headers_match_a_plain_loop(spark):
    data = list(enumerate(texts()))
    got = {}
    for r in sections.chunk_by_headers(spark.createDataFrame(data, "k long, t string"), "k", "t", 300, 40).orderBy("k", "chunk").collect():
        got.setdefault(r.k, []).append((r.section_title, r.chunk_text))
    for k, t in data:
        assert got[k] == (plain_chunks(t, 300, 40) or [("Documento Completo", "[Sección: Documento Completo]\n")]), t
    assert sections.chunk_by_headers(spark.createDataFrame([(1, None)], "k long, t string"), "k", "t").count() == 1


def plain_snippet(text, words, prefix, before, after, most):
    pieces, end = [text[:prefix]], prefix
    for m in re.finditer("|".join(words), text, re.I):
        a, b = max(0, m.start() - before), min(len(text), m.end() + after)
        if a >= end:
            pieces.append(text[a:b])
            end = b
            if sum(map(len, pieces)) >= most:
                break
    return "\n[...]\n".join(pieces)[:most]


def test_snippets_match_a_plain_loop(spark):
    r = random.Random(5)
    data = [(i, "".join(r.choice(["abc ", "Puebla ", "x", "municipio  de ", "\n"]) for _ in range(r.randint(0, 200)))) for i in range(50)]
    words = ("puebla", r"municipio\s+de")
    got = {x.k: x.s for x in spark.createDataFrame([*data, (99, None)], "k long, t string").select("k", sections.targeted_snippet(F.col("t"), words, 50, 6, 22, 200).alias("s")).collect()}
    assert got.pop(99) == ""
    assert got == {k: plain_snippet(t, words, 50, 6, 22, 200) for k, t in data}


@pytest.mark.parametrize("note, want", [("---\na: 1\n---\nx", "---\na: 1\n\nb: 2---\nx"), ("---\nb: 1\n---\nx", "---\nb: 1\n---\nx"), ("x", "x"), (None, None)])
def test_patch(spark, note, want):
    assert spark.createDataFrame([(note,)], "n string").select(sections.patch_frontmatter(F.col("n"), "b", F.lit("2"))).first()[0] == want


def test_links_and_fields(spark):
    notes = spark.createDataFrame([(1, "ver 21PU2025H0155 y [[21PU2025H0155]] y 09PU2025H0001"), (2, None)], "k long, t string")
    known = spark.createDataFrame([("21PU2025H0155",)], "c string")
    assert {r.k: r.t for r in sections.autolink(notes, "k", "t", known, "c").collect()} == {1: "ver [[21PU2025H0155]] y [[21PU2025H0155]] y 09PU2025H0001", 2: ""}
    t = "Promovente: Uno SA\n| Estado | Puebla |\nEstado: Otro"
    assert tuple(spark.createDataFrame([(t,)], "t string").select(sections.labelled(F.col("t"), {"promovente": "promovente", "estado": "estado", "sector": "sector"}).alias("s")).first().s) == ("Uno SA", "Puebla", None)
    pages = spark.createDataFrame([("d", 2, "dos"), ("d", 1, "uno"), ("d", 3, None)], "d string, p int, t string")
    assert tuple(sections.concat_pages(pages, "d", "p", "t").first()) == ("d", 3, 1, "# d\n\nuno\n\ndos\n\n")
    assert [tuple(r) for r in sections.relevance(spark.createDataFrame([(1, "# T\nGas y agua"), (2, "gas"), (3, None)], "k long, t string"), "k", "t", ["gas", "agua"]).collect()] == [(1, 2, "Gas y agua"), (2, 1, "gas")]
