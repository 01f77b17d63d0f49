import textwrap

import pytest
from acervo.llm.license_scan import SENTENCES, license_scan

TEXTS = {
    "MIT": ["mit-grant", "mit-notice"],
    "BSD-2-Clause": ["bsd-grant", "bsd-source", "bsd-binary"],
    "BSD-3-Clause": ["bsd-grant", "bsd-source", "bsd-binary", "bsd-endorse"],
    "Apache-2.0": ["apache2-header", "apache2-comply", "apache2-copy"],
    "GPL-3.0-or-later": ["gpl-free", "gpl-hope"],
    "GPL-2.0-or-later": ["gpl2-free", "gpl-hope"],
}


@pytest.mark.parametrize("mark", ["", "# ", " * ", "// ", "-- "])
def test_wrapped_and_commented_licences(spark, mark):
    docs = []
    for k, ids in enumerate(TEXTS.values()):
        known = [SENTENCES[i][0] for i in ids]
        bullets = [known[0], *(f"{n}. {x}" for n, x in enumerate(known[1:], 1))] if ids[0].startswith("bsd") else known
        for j, text in enumerate((" ".join(known), "\n\n".join(bullets))):
            for width in (70, 80):
                lines = [x for part in text.split("\n\n") for x in [*textwrap.wrap(part, width), ""]]
                docs.append((1000 * k + 100 * j + width, "\n".join((mark + x).rstrip() for x in ["Copyright (c) 2020 Some One", *lines, "code = 1"])))
    out = {x.doc_id: x for x in license_scan(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    names = list(TEXTS)
    assert {i: x.licenses for i, x in out.items()} == {i: names[i // 1000] for i, _ in docs}
    for i, text in docs:
        assert text[out[i].first_offset :].startswith(SENTENCES[TEXTS[names[i // 1000]][0]][0][:20])


def test_lines_alone_and_stops_still_count(spark):
    docs = [(1, "A title\nLicensed under the MIT License.\nmore words"), (2, "A title Licensed under the MIT License."), (3, "Licensed under\n\nthe MIT License."), (4, "Redistribution\nand\nuse")]
    out = {x.doc_id: (x.licenses, x.n_sentences) for x in license_scan(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert out == {1: ("MIT", 2), 2: ("", 1), 3: ("", 2), 4: ("", 1)}
