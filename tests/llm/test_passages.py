import random

import brute
import pytest
from acervo.llm.line_dedup import line_dedup


def test_short_repeated_lines_go(spark):
    docs = [(1, "Home | About | Help\nFirst text of its own."), (2, "Home | About | Help\nSecond text, also its own.\nHome | About | Help"), (3, "Third.\nHome | About | Help")]
    out = {r.doc_id: r.text for r in line_dedup(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert out == {1: docs[0][1], 2: "Second text, also its own.\n", 3: "Third.\n"}


@pytest.mark.parametrize("kind", ["unpunctuated", "amid", "edited", "wrapped"])
def test_long_passages_go_inside_other_lines(spark, kind):
    r = random.Random(kind)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(r.randint(3, 7)))
    docs, passages = [], {}
    for i in range(40):
        p = [word() for _ in range(103 if kind == 'edited' else 51)]
        if kind == "amid":
            p[20] += "."
        other = list(p)
        if kind == "edited":
            other[51] = "EDIT"
        glue = ["\n" if kind == "wrapped" and k % 9 == 8 else " " for k in range(len(p) - 1)]
        own = lambda: " ".join(word() for _ in range(30))
        docs.append((i, f"{own()} {' '.join(p)} {own()}"))
        text = "".join(w + g for w, g in zip(other, [*glue, ""], strict=True))
        docs.append((100 + i, f"{own()} {text} {own()}"))
        passages[100 + i] = p
    out = {x.doc_id: x for x in line_dedup(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    for i, text in docs:
        if i < 100:
            assert out[i].text == text
            continue
        kept, lost = out[i].text.split(), brute.WORD.findall(text)
        assert kept[:30] == lost[:30] and kept[-30:] == lost[-30:]
        stays = [passages[i][k : k + 25] for k in range(len(passages[i]) - 24)]
        assert not any(kept[k : k + 25] in stays for k in range(len(kept)))
