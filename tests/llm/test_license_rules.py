"""Licence scans against a plain matcher over lists of words."""

import random
import re

import pytest
from acervo.llm.license_scan import RULES, SENTENCES, TAGS, license_scan, match_rules

STOPS = ".!?:;"


def _words(text):
    """(word without its one stop, whether it ends a sentence, whether it ends a line) of a text without comment marks."""
    out = []
    lines = text.lower().split("\n")
    for i, line in enumerate(lines):
        parts = line.split()
        for j, w in enumerate(parts):
            stop, last = w[-1] in STOPS, j == len(parts) - 1
            bare = w[:-1] if stop and len(w) > 1 and w[-2] not in STOPS else w
            out.append([bare, stop or (last and i + 1 < len(lines) and not lines[i + 1].strip()), last])
    if out:
        out[-1][1] = True
    return out


KNOWN = [(name, [w[0] for w in _words(v)], next(k for k, w in enumerate(_words(v), 1) if w[1])) for name, x in SENTENCES.items() for v in x]


def _plain(text):
    words, i, found, skip = _words(text), 0, [], 0
    for i in range(len(words)):
        if i < skip or not (i == 0 or words[i - 1][1] or words[i - 1][2]):
            continue
        best = (0, None)
        for name, known, head in KNOWN:
            n = len(known)
            if n > best[0] and [w[0] for w in words[i : i + n]] == known:
                stop = next(k for k in range(i, len(words)) if words[k][1]) + 1 - i
                line = next(k for k in range(i, len(words)) if words[k][2] or words[k][1]) + 1 - i
                if head in (stop, line):
                    best = (n, name)
        if best[1]:
            found.append(best[1])
            skip = i + best[0]
    return " ".join(found), " ".join(sorted({n for _, n in match_rules(found, RULES)}))


@pytest.mark.parametrize(
    "text, want",
    [
        ("SPDX-License-Identifier: MIT", "MIT"),
        ("code\n// SPDX-License-Identifier: GPL-2.0-or-later\nmore", "GPL-2.0-or-later"),
        ("License: MIT\nAuthor: x", "MIT"),
        ("License: unknown", ""),
        ("Released under the MIT License", "MIT"),
        ("This software is released under the MIT license", "MIT"),
        ("Apache License\n   Version 2.0, January 2004\n\nTERMS", "Apache-2.0"),
        ("This Source Code Form is subject to the terms of the Mozilla Public\n * License, v. 2.0. If a copy", "MPL-2.0"),
        ("Licensed under the Mozilla Public License 2.0!", "MPL-2.0"),
        ("Not released under the MIT License", ""),
        ("released under the MIT License and more", ""),
        ("MIT", ""),
        (": ; .", ""),
    ],
)
def test_forms(spark, text, want):
    assert license_scan(spark.createDataFrame([(1, text)], "doc_id long, text string")).first().licenses == want


def test_every_tag(spark):
    docs = spark.createDataFrame([(k, f"a b\n# SPDX-License-Identifier: {t}\nc") for k, t in enumerate(TAGS)], "doc_id long, text string")
    assert {TAGS[x.doc_id]: x.licenses for x in license_scan(docs).collect()} == {t: t for t in TAGS} and len(TAGS) > 30


def test_against_plain_matcher(spark):
    r = random.Random(11)
    variants = [v for x in SENTENCES.values() for v in x]
    texts = []
    for _ in range(400):
        parts = []
        for _ in range(r.randint(1, 7)):
            v = r.choice(variants) if r.random() < 0.6 else " ".join(r.choice(["license", "MIT", "the", "under.", "a;", "...", "License:", "x"]) for _ in range(r.randint(1, 6)))
            v = v[:-1] if r.random() < 0.3 and v[-1] == "." else v
            v = re.sub(" ", lambda m: r.choice([" "] * 9 + ["\n", "  "]), v)
            parts.append(v.upper() if r.random() < 0.2 else v)
        texts.append("".join(p + r.choice(["\n", " ", "\n\n", ". "]) for p in parts))
    got = {x.doc_id: (x.sentence_ids, x.licenses) for x in license_scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    want = {i: _plain(t) for i, t in enumerate(texts)}
    wrong = [(texts[i], got[i], want[i]) for i in want if got[i] != want[i]]
    assert not wrong, wrong[:2]
    assert sum(bool(w[1]) for w in want.values()) > 200
