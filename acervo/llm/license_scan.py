"""Licence scans by sentence rules: sentences become identifiers, sequences of identifiers become licences."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from acervo.llm._text import BASE, SPACE, U64, mix, pieces, powers, words

#: Last bytes of a sentence; bytes of comment marks and bullets, which are left out at line starts.
STOPS, MARKS = b".!?:;", b"#*/;%>-<!|"
#: Known sentences of public licence texts: identifier -> sentences that mean it.
SENTENCES: dict[str, tuple[str, ...]] = {
    "copyright-all": ("All rights reserved.",),
    "mit-by-name": ("Released under the MIT License.", "Licensed under the MIT License.", "This project is licensed under the MIT License."),
    "mit-grant": ('Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:',),
    "mit-notice": ("The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",),
    "apache2-by-name": ("Licensed under the Apache License, Version 2.0.", "This work is licensed under the Apache License, Version 2.0."),
    "apache2-header": ('Licensed under the Apache License, Version 2.0 (the "License");',),
    "apache2-comply": ("you may not use this file except in compliance with the License.",),
    "apache2-copy": ("You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0", "You may obtain a copy of the License at"),
    "gpl3-by-name": ("This work is licensed under the GNU General Public License, version 3.", "Licensed under the GNU General Public License, version 3."),
    "gpl-free": ("This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",),
    "gpl2-free": ("This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",),
    "gpl-hope": ("This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.",),
    "bsd-grant": ("Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",),
    "bsd-source": ("Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",),
    "bsd-binary": ("Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",),
    "bsd-endorse": ("Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",),
    "cc-by-nc4": ("Licensed under CC BY-NC 4.0.", "This work is licensed under CC BY-NC 4.0."),
    "cc-by4": ("Licensed under CC BY 4.0.", "This work is licensed under CC BY 4.0."),
    "cc-by-sa4": ("Licensed under CC BY-SA 4.0.", "This work is licensed under CC BY-SA 4.0."),
    "cc0": ("This work is dedicated to the public domain under CC0 1.0.",),
    "mit-warranty": ('THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.',),
    "mit-liability": ("IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",),
    "isc-grant": ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.", "Permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    "0bsd-grant": ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.",),
    "isc-warranty": ('THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS.',),
    "bsd-warranty": ('THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.',),
    "apache2-title": ("Apache License Version 2.0, January 2004",),
    "mpl2-header": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",),
    "lgpl21-free": ("This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",),
    "lgpl3-free": ("This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",),
    "agpl3-free": ("This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",),
    "unlicense": ("This is free and unencumbered software released into the public domain.",),
    "zlib-warranty": ("This software is provided 'as-is', without any express or implied warranty.",),
    "epl2-terms": ("This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0",),
}
#: Rules in order of precedence: the first whose identifiers stand next to each other takes them.
RULES: tuple[tuple[str, tuple[str, ...]], ...] = (
    ("BSD-3-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-endorse")),
    ("BSD-2-Clause", ("bsd-grant", "bsd-source", "bsd-binary")),
    ("MIT", ("mit-grant", "mit-notice", "mit-warranty", "mit-liability")),
    ("MIT", ("mit-grant", "mit-notice")),
    ("ISC", ("isc-grant", "isc-warranty")),
    ("ISC", ("isc-grant",)),
    ("0BSD", ("0bsd-grant",)),
    ("Apache-2.0", ("apache2-title",)),
    ("Apache-2.0", ("apache2-header", "apache2-comply", "apache2-copy")),
    ("Apache-2.0", ("apache2-header", "apache2-comply")),
    ("GPL-3.0-or-later", ("gpl-free", "gpl-hope")),
    ("GPL-2.0-or-later", ("gpl2-free", "gpl-hope")),
    ("LGPL-2.1-or-later", ("lgpl21-free",)),
    ("LGPL-3.0-or-later", ("lgpl3-free",)),
    ("AGPL-3.0-or-later", ("agpl3-free",)),
    ("MPL-2.0", ("mpl2-header",)),
    ("Unlicense", ("unlicense",)),
    ("Zlib", ("zlib-warranty",)),
    ("EPL-2.0", ("epl2-terms",)),
    ("GPL-3.0-or-later", ("gpl-free",)),
    ("GPL-2.0-or-later", ("gpl2-free",)),
    ("MIT", ("mit-grant",)),
    ("MIT", ("mit-by-name",)),
    ("Apache-2.0", ("apache2-by-name",)),
    ("GPL-3.0", ("gpl3-by-name",)),
    ("CC-BY-NC-4.0", ("cc-by-nc4",)),
    ("CC-BY-SA-4.0", ("cc-by-sa4",)),
    ("CC-BY-4.0", ("cc-by4",)),
    ("CC0-1.0", ("cc0",)),
)
#: Identifiers of licences as tags name them.
TAGS = (
    "0BSD", "AGPL-3.0-only", "AGPL-3.0-or-later", "Apache-2.0", "Artistic-2.0", "BSD-2-Clause", "BSD-3-Clause", "BSL-1.0", "CC-BY-4.0", "CC-BY-NC-4.0",
    "CC-BY-NC-SA-4.0", "CC-BY-SA-4.0", "CC0-1.0", "CDDL-1.0", "EPL-2.0", "EUPL-1.2", "GPL-2.0", "GPL-2.0-only", "GPL-2.0-or-later", "GPL-3.0",
    "GPL-3.0-only", "GPL-3.0-or-later", "ISC", "LGPL-2.1-only", "LGPL-2.1-or-later", "LGPL-3.0-only", "LGPL-3.0-or-later", "MIT", "MIT-0", "MPL-2.0",
    "OFL-1.1", "PostgreSQL", "PSF-2.0", "Unlicense", "WTFPL", "X11", "Zlib",
)
#: Names of licences in prose.
NAMES = {
    "MIT": ("the MIT License",), "ISC": ("the ISC License",), "Zlib": ("the zlib License",), "Unlicense": ("the Unlicense",),
    "Apache-2.0": ("the Apache License, Version 2.0", "the Apache License 2.0", "the Apache 2.0 License"),
    "BSD-2-Clause": ("the BSD 2-Clause License",), "BSD-3-Clause": ("the BSD 3-Clause License",),
    "GPL-2.0": ("the GNU General Public License, version 2", "the GNU General Public License v2.0"),
    "GPL-3.0": ("the GNU General Public License, version 3", "the GNU General Public License v3.0"),
    "LGPL-2.1": ("the GNU Lesser General Public License, version 2.1", "the GNU Lesser General Public License v2.1"),
    "LGPL-3.0": ("the GNU Lesser General Public License, version 3", "the GNU Lesser General Public License v3.0"),
    "AGPL-3.0": ("the GNU Affero General Public License, version 3", "the GNU Affero General Public License v3.0"),
    "MPL-2.0": ("the Mozilla Public License 2.0", "the Mozilla Public License, version 2.0"), "EPL-2.0": ("the Eclipse Public License 2.0",),
    "BSL-1.0": ("the Boost Software License 1.0", "the Boost Software License, Version 1.0"),
    "CC-BY-4.0": ("CC BY 4.0",), "CC-BY-SA-4.0": ("CC BY-SA 4.0",), "CC-BY-NC-4.0": ("CC BY-NC 4.0",), "CC-BY-NC-SA-4.0": ("CC BY-NC-SA 4.0",),
}
OPENINGS = ("Released under", "Licensed under", "Distributed under", "This project is licensed under", "This project is released under", "This software is licensed under", "This software is released under", "This work is licensed under", "This code is licensed under")
_listed = {v.lower().rstrip(".") for x in SENTENCES.values() for v in x}
SENTENCES |= {f"tag-{t}": (f"SPDX-License-Identifier: {t}", f"License: {t}") for t in TAGS}
SENTENCES |= {f"named-{t}": tuple(v for n in names for o in OPENINGS if (v := f"{o} {n}").lower() not in _listed) for t, names in NAMES.items()}
RULES += tuple((t, (f"tag-{t}",)) for t in TAGS) + tuple((t, (f"named-{t}",)) for t in NAMES)


class _Text:
    """Words of texts without comment marks, and the candidates for known sentences.

    A candidate starts at a line or sentence start and ends at the next sentence end or at the end of its line.
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        data = _unmarked(data, offsets)
        bare = _bare(data, offsets)
        self.begin, ends, hashes = words(bare, offsets)
        ends = ends + np.append(bare != data, False)[ends]
        n = len(self.begin)
        self.text = np.searchsorted(offsets, self.begin, "right") - 1
        self.sums = np.concatenate([np.zeros(1, U64), np.cumsum(hashes * powers(n), dtype=U64)])
        self.back = np.cumprod(np.concatenate([np.ones(1, U64), np.full(n, U64(pow(int(BASE), -1, 1 << 64)))]), dtype=U64)
        if not n:
            self.sentences = self.first = self.end = np.zeros(0, np.int64)
            return
        breaks = np.concatenate([[0], np.cumsum(data == 10)])
        gap = breaks[self.begin[1:]] - breaks[ends[:-1]]
        line, stop = np.ones(n, bool), np.isin(data[ends - 1], np.frombuffer(STOPS, np.uint8))
        apart = self.text[1:] != self.text[:-1]
        line[:-1] = apart | (gap > 0)
        stop[:-1] |= apart | (gap > 1)
        stop[-1] = True
        self.sentences = np.flatnonzero(np.concatenate([[True], stop[:-1]]))
        starts = np.flatnonzero(np.concatenate([[True], (stop | line)[:-1]]))
        to = [np.flatnonzero(x) for x in (stop, stop | line)]
        ends_ = [x[np.searchsorted(x, starts)] + 1 for x in to]
        short = ends_[1] < ends_[0]
        self.first, self.end = np.concatenate([starts, starts[short]]), np.concatenate([ends_[0], ends_[1][short]])

    def digests(self, first: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hashes of runs of words."""
        return mix((self.sums[end] - self.sums[first]) * self.back[first] + (end - first).astype(U64))


def _unmarked(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The bytes with blanks in place of the comment marks at line starts; carriage returns go the same way as blanks."""
    if not len(data):
        return data
    mark = np.isin(data, np.frombuffer(MARKS, np.uint8))
    other = np.concatenate([[0], np.cumsum(~(mark | SPACE[data]))])
    head = np.concatenate([[True], data[:-1] == 10])
    head[offsets[:-1][offsets[:-1] < len(data)]] = True
    at = np.maximum.accumulate(np.where(head, np.arange(len(data)), 0))
    return np.where(mark & (other[:-1] == other[at]), np.uint8(32), data)


def _bare(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The bytes with a blank for the one stop that ends a word, so that sentences count alike with and without it."""
    if not len(data):
        return data
    stop = np.isin(data, np.frombuffer(STOPS, np.uint8))
    last = np.append(SPACE[data[1:]], True)
    last[offsets[1:][offsets[1:] > 0] - 1] = True
    inner = np.append(False, ~(stop | SPACE[data])[:-1])
    inner[offsets[:-1][offsets[:-1] < len(data)]] = False
    return np.where(stop & last & inner, np.uint8(32), data)


def _sentence_digests(sentences: dict[str, tuple[str, ...]]) -> tuple[np.ndarray, list[list[tuple[int, dict[int, str]]]]]:
    """Hashes of the known sentences up to their first stops, sorted, and for each (words, {hash of all: identifier}) with most words first."""
    found: dict[int, dict[int, dict[int, str]]] = {}
    for name, variants in sentences.items():
        for variant in variants:
            raw = np.frombuffer(variant.encode(), np.uint8)
            known = _Text(raw, np.array([0, len(raw)]))
            n = len(known.begin)
            whole = known.digests(np.array([0]), np.array([n]))
            found.setdefault(int(known.digests(known.first[:1], known.end[:1])[0]), {}).setdefault(n, {})[int(whole[0])] = name
    keys = np.array(sorted(found), np.uint64)
    return keys, [sorted(found[int(k)].items(), reverse=True) for k in keys]


def match_rules(sequence: list[str], rules: tuple[tuple[str, tuple[str, ...]], ...]) -> list[tuple[int, str]]:
    """(place, licence) of the ordered rules that fit; an identifier counts for one rule only."""
    used, out = [False] * len(sequence), []
    for name, pattern in rules:
        n = len(pattern)
        for i in range(len(sequence) - n + 1):
            if tuple(sequence[i : i + n]) == pattern and not any(used[i : i + n]):
                used[i : i + n] = [True] * n
                out.append((i, name))
    return sorted(out)


def license_scan(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", sentences: dict[str, tuple[str, ...]] | None = None, rules: tuple[tuple[str, tuple[str, ...]], ...] = RULES) -> DataFrame:
    """One row for each row of docs: (id_column, n_sentences, sentence_ids, licenses, first_offset).

    Sentences end at . ! ? : ; or at a blank line and run on over single line breaks; A-Z count as a-z, blanks as one, and
    comment marks at line starts as blanks; a stop at the end of a word counts for nothing within a match. A known sentence may begin at a sentence or a line start, and may be a line
    or a part of one up to its end. n_sentences counts sentences, not the lines within. sentence_ids joins the known sentences
    in text order; licenses joins the distinct licences found, sorted; first_offset is the byte where the first known
    sentence begins (-1 without one). Null, empty and plain texts give empty strings. Repeated rows and null ids come out
    as they come in; other columns are not read.
    """
    keys, known = _sentence_digests(SENTENCES if sentences is None else sentences)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, offsets in pieces(batch, "text"):
                parsed = _Text(data, offsets)
                ones = parsed.digests(parsed.first, parsed.end)
                hits = np.flatnonzero(np.isin(ones, keys))
                found: dict[int, list[tuple[str, int]]] = {}
                skip = 0
                for h in sorted(hits.tolist(), key=lambda h: (parsed.first[h], -parsed.end[h])):
                    first = int(parsed.first[h])
                    for n, wholes in known[int(np.searchsorted(keys, ones[h]))]:
                        end = first + n
                        if first >= skip and end <= len(parsed.text) and parsed.text[end - 1] == parsed.text[first] and (name := wholes.get(int(parsed.digests(np.array([first]), np.array([end]))[0]))):
                            doc = int(parsed.text[first])
                            found.setdefault(doc, []).append((name, int(parsed.begin[first] - offsets[doc])))
                            skip = end
                counts = np.bincount(parsed.text[parsed.sentences], minlength=part.num_rows)
                rows = [found.get(i, []) for i in range(part.num_rows)]
                ids = [" ".join(n for n, _ in x) for x in rows]
                licenses = [" ".join(sorted({n for _, n in match_rules([n for n, _ in x], rules)})) for x in rows]
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(counts.astype(np.int64)), pa.array(ids, pa.string()), pa.array(licenses, pa.string()), pa.array([x[0][1] if x else -1 for x in rows], pa.int64())], ["id", "n_sentences", "sentence_ids", "licenses", "first_offset"])

    return docs.select(F.col(id_column).cast("long").alias("id"), F.col(text_column).alias("text")).mapInArrow(run, "id long, n_sentences long, sentence_ids string, licenses string, first_offset long").withColumnRenamed("id", id_column)
