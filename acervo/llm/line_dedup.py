"""Substring dedup by line hashing.

A unit is a line, or a sentence within a line: words up to one that ends in . ! or ?, or up to a line break. Its digest
hashes its words, with A-Z lower-cased and blanks ignored. Digests are grouped over all documents and the first occurrence,
by rank of document and place, is kept.

Passages are also found inside other lines. Parts are sentences, whatever line breaks stand in them; those of more than
LONG words are cut into pieces where the hash of a word pair is the least of its surroundings. Parts depend on the words
around them only, so a passage meets its copy in a line without stops, in a sentence with an edited word, or under other
line breaks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from acervo.llm import _bloom
from acervo.llm._text import U64, kept, mix, pieces, powers, signed, word_bounds, words

#: Runs of repeated units are removed from so many words on.
MIN_WORDS = 1
#: Sentences of more words are cut into pieces; a piece begins at the least word pair among so many on either side.
LONG, AROUND = 16, 3
#: Parts of fewer words are digested together with the part before them: alone they would be repeated everywhere.
SHORT = 3
#: Runs that hold parts of lines are removed from so many words on.
PASSAGE = 12
#: Rank of a row: its id, those without one last, then the hash of its text.
RANK = ["id", "t"]
FOUND = "\u0000found"


class Atoms:
    """Words of all texts, and their units and parts as (first word, number of words, two hashes as (n, 2))."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, whole_lines: bool):
        self.starts, ends, hashes = words(data, offsets)
        self.at = word_bounds(self.starts, offsets)
        self.text = np.searchsorted(offsets, self.starts, "right") - 1
        none = np.zeros(0, np.int64)
        self.units = self.parts = none, none, np.zeros((0, 2), U64)
        if not len(self.starts):
            return
        lines = np.concatenate([[0], np.cumsum(data == 10)])
        apart = np.ones(len(ends), bool)
        apart[:-1] = self.text[1:] != self.text[:-1]
        stop = apart | np.isin(data[ends - 1], np.frombuffer(b".!?", np.uint8))
        broken = apart.copy() if whole_lines else stop.copy()
        broken[:-1] |= lines[self.starts[1:]] != lines[ends[:-1]]
        self.units = _runs_of(hashes, broken, U64(0))
        sentence = np.cumsum(np.concatenate([[False], stop[:-1]]))
        words_in = np.flatnonzero(np.bincount(sentence)[sentence] > LONG)
        stop[words_in] |= _cuts(hashes[words_in], sentence[words_in])
        first, count, digest = _runs_of(hashes, stop, U64(0x8EBC6AF09C88C6E3))
        self.parts = first, count, _with_neighbours(count, self.text[first], digest)


def _runs_of(hashes: np.ndarray, stop: np.ndarray, salt: np.uint64) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First word, number of words and two hashes of the runs of words that end where stop is set."""
    last = np.flatnonzero(stop)
    first = np.concatenate([[0], last[:-1] + 1])
    count = last - first + 1
    factor = powers(int(count.max()) + 1)[np.arange(len(hashes)) - np.repeat(first, count)]
    one = mix(np.add.reduceat(hashes * factor, first, dtype=U64) + count.astype(U64) ^ salt)
    two = mix(np.add.reduceat(mix(hashes ^ U64(0xA0761D6478BD642F)) * factor, first, dtype=U64) ^ count.astype(U64) ^ salt)
    return first, count, np.stack([one, two], axis=1)


def _with_neighbours(count: np.ndarray, text: np.ndarray, digest: np.ndarray) -> np.ndarray:
    """Digests of parts, those of short ones over the part before too (at a text's beginning, over the one after)."""
    short = np.flatnonzero(count < SHORT)
    before = np.maximum(short - 1, 0)
    after = np.minimum(short + 1, len(count) - 1)
    other = np.where((short > 0) & (text[before] == text[short]), before, after)
    side = np.where(other < short, U64(0x9FB21C651E98DF25), U64(0xD6E8FEB86659FD93))[:, None]
    out = digest.copy()
    out[short] = np.where((text[other] == text[short])[:, None], mix(digest[short] * U64(5) + digest[other] ^ side), digest[short])
    return out


def _cuts(hashes: np.ndarray, sentence: np.ndarray) -> np.ndarray:
    """Which words end a piece: the last of each sentence, and those before a least pair."""
    pair = mix(hashes * U64(3))
    pair[:-1] = mix(hashes[:-1] * U64(3) + hashes[1:])
    least = np.zeros(len(hashes), bool)
    inner = slice(AROUND, len(hashes) - AROUND - 1)
    middle = pair[inner]
    good = (sentence[: len(middle)] == sentence[inner]) & (sentence[2 * AROUND + 1 :][: len(middle)] == sentence[inner])
    for d in range(1, AROUND + 1):
        good &= (middle < pair[AROUND - d :][: len(middle)]) & (middle <= pair[AROUND + d :][: len(middle)])
    least[inner] = good
    stop = np.ones(len(hashes), bool)
    stop[:-1] = least[1:] | (sentence[1:] != sentence[:-1])
    return stop


def _rank(id_column: str, text_column: str) -> list[Column]:
    return [F.coalesce(F.col(id_column).cast("long"), F.lit(2**63 - 1)).alias("id"), F.xxhash64(text_column).alias("t")]


def _digests(docs: DataFrame, whole_lines: bool, filter_: object = None) -> DataFrame:
    """(id, t, h1, h2): the distinct units and parts of each row of docs (id, t, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, offsets in pieces(batch, "text"):
                atoms = Atoms(data, offsets, whole_lines)
                text = atoms.text[np.concatenate([atoms.units[0], atoms.parts[0]])]
                digest = np.concatenate([atoms.units[2], atoms.parts[2]])
                if filter_ is not None:
                    good = _bloom.passes(filter_.value, digest[:, 0])
                    text, digest = text[good], digest[good]
                order = np.lexsort((digest[:, 1], digest[:, 0], text))
                text, digest = text[order], digest[order]
                new = np.ones(len(text), bool)
                new[1:] = (text[1:] != text[:-1]) | (digest[1:] != digest[:-1]).any(axis=1)
                rows, digest = pa.array(text[new]), digest[new]
                yield pa.RecordBatch.from_arrays([part.column("id").take(rows), part.column("t").take(rows), pa.array(signed(digest[:, 0].copy())), pa.array(signed(digest[:, 1].copy()))], ["id", "t", "h1", "h2"])

    return docs.where("text is not null").mapInArrow(run, "id long, t long, h1 long, h2 long")


def repeated_units(docs: DataFrame, whole_lines: bool = True) -> DataFrame:
    """docs (id, t, text) -> (id, t, h1, h2): units and parts that a row of lower rank has too.

    A very common digest stands in many rows of the join. No step after the join needs the rows of a digest together, so
    Spark may deal such a digest out to several tasks.
    """
    rank = F.struct(*RANK)
    shared = kept(_digests(docs, whole_lines).groupBy("h1", "h2").agg(F.min(rank).alias("first"), F.max(rank).alias("last")).where("first < last").select("h1", "h2", "first"))
    filter_ = docs.sparkSession.sparkContext.broadcast(_bloom.build(shared, "h1", 25))
    return _digests(docs, whole_lines, filter_).join(shared, ["h1", "h2"]).where(rank > F.col("first")).select("id", "t", "h1", "h2")


def line_dedup(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", min_words: int = MIN_WORDS, unit: str = "sentence") -> DataFrame:
    """One row for each row of docs: all its columns, with the text replaced by what is kept, and `dedup`.

    dedup is a struct (n_units, n_removed, kept_sha256, spans): spans are the removed byte ranges (start, end) of the
    UTF-8 of the original text, and n_removed counts the units that lose words. `unit` is "line", or "sentence" for the
    sentences within lines. A unit or part is repeated if it stands earlier in the text or in a row of lower rank. Runs of
    repeated units that hold `min_words` words or more are removed, with the blanks up to the next word; by default each
    repeated unit is. Repeated parts of lines are removed where they and repeated units next to them make a run of
    `min_words` words, and PASSAGE at least; the few words of a repeated passage before its first cut and after its last
    one stay. A part of fewer than SHORT words counts as repeated only where it stood before after the same part (at the beginning
    of a text, before the same part), so a short sentence of its own between two repeated ones stays.

    Rows rank by id, those with a null id last, then by the hash of their text. A null text stays null with no units; a text
    that is wholly repeated becomes empty. Rows that repeat both id and text count as one and don't remove each other's
    units. A column of docs named dedup is replaced; others keep their names and values. An empty table gives an empty one.
    """
    whole_lines = {"line": True, "sentence": False}[unit]
    found = repeated_units(docs.select(*_rank(id_column, text_column), F.col(text_column).alias("text")), whole_lines).groupBy(*RANK).agg(F.collect_set(F.struct("h1", "h2")).alias("found"))
    fields = {"n_units": pa.int64(), "n_removed": pa.int64(), "kept_sha256": pa.string(), "spans": pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))}
    others = docs.drop("dedup")
    names = others.columns
    # the caller's columns travel as one struct, so that none can clash with those added here
    rows = others.select(*_rank(id_column, text_column), F.struct(*[F.col(f"`{c}`") for c in names]).alias("row")).join(found, RANK, "left").select("row", "found")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = pa.RecordBatch.from_arrays([*batch.column("row").flatten(), batch.column("found")], [*names, FOUND])
            for part, data, offsets in pieces(own, text_column):
                atoms = Atoms(data, offsets, whole_lines)
                ufirst, ucount, udigest = atoms.units
                pfirst, pcount, pdigest = atoms.parts
                uat, pat = np.searchsorted(ufirst, atoms.at), np.searchsorted(pfirst, atoms.at)
                found_, nulls = part.column(FOUND), part.column(text_column).is_null()
                texts, rows = [], []
                for i in range(part.num_rows):
                    raw = data[offsets[i] : offsets[i + 1]]
                    u, p, w = slice(uat[i], uat[i + 1]), slice(pat[i], pat[i + 1]), slice(atoms.at[i], atoms.at[i + 1])
                    spans: list[tuple[int, int]] = []
                    removed = 0
                    again, part_again = _repeats(udigest[u], found_[i]), _repeats(pdigest[p], found_[i])
                    if again.any() or part_again.any():
                        gone = _gone(w.stop - w.start, (ufirst[u] - w.start, ucount[u], again), (pfirst[p] - w.start, pcount[p], part_again), min_words)
                        removed = int(np.logical_or.reduceat(gone, ufirst[u] - w.start).sum())
                        begin = np.append(atoms.starts[w] - offsets[i], len(raw))
                        spans = [(int(begin[a]), int(begin[b])) for a, b in _edges(gone)]
                    keep = cut(raw, spans)
                    texts.append(None if nulls[i].as_py() else keep.decode())
                    rows.append({"n_units": u.stop - u.start, "n_removed": removed, "kept_sha256": hashlib.sha256(keep).hexdigest(), "spans": [{"start": a, "end": b} for a, b in spans]})
                columns = [pa.array(texts, part.schema.field(text_column).type) if c == text_column else part.column(c) for c in names]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(rows, pa.struct(list(fields.items())))], [*names, "dedup"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in others.schema.fields)
    return rows.mapInArrow(run, f"{schema}, dedup struct<n_units:long,n_removed:long,kept_sha256:string,spans:array<struct<start:long,end:long>>>")


def _repeats(mine: np.ndarray, found: pa.Scalar) -> np.ndarray:
    """Which units or pieces of a text repeat an earlier one of it, or are among those found elsewhere."""
    keys = np.ascontiguousarray(mine).view([("a", U64), ("b", U64)]).reshape(-1)
    _, first = np.unique(keys, return_index=True)
    out = np.ones(len(keys), bool)
    out[first] = False
    if found.is_valid and len(found.values):
        other = np.stack([found.values.field(0).to_numpy(), found.values.field(1).to_numpy()], axis=1).view(U64)
        out |= np.isin(keys, np.ascontiguousarray(other).view([("a", U64), ("b", U64)]).reshape(-1))
    return out


def _edges(mask: np.ndarray) -> np.ndarray:
    """(first, end) of the runs of set places."""
    return np.flatnonzero(np.diff(np.concatenate([[0], mask.view(np.int8), [0]]))).reshape(-1, 2)


def _spread(size: int, runs: tuple[np.ndarray, np.ndarray, np.ndarray]) -> np.ndarray:
    """Which of `size` words lie in the marked ones of runs (first word, number of words, mark)."""
    first, count, mark = runs
    steps = np.zeros(size + 1, np.int64)
    np.add.at(steps, first[mark], 1)
    np.add.at(steps, first[mark] + count[mark], -1)
    return np.cumsum(steps[:-1]) > 0


def _gone(size: int, units: tuple[np.ndarray, np.ndarray, np.ndarray], parts: tuple[np.ndarray, np.ndarray, np.ndarray], min_words: int) -> np.ndarray:
    """Which words of a text go: those of long enough runs of repeated units, and of repeated parts beside them."""
    whole = _spread(size, units)
    gone = np.zeros(size, bool)
    for a, b in _edges(whole):
        gone[a:b] = b - a >= min_words
    if parts[2].any():
        both = whole | _spread(size, parts)
        for a, b in _edges(both):
            if b - a >= max(min_words, PASSAGE):
                gone[a:b] = True
    return gone


def cut(raw: np.ndarray, spans: list[tuple[int, int]]) -> bytes:
    """The bytes outside the spans."""
    if not spans:
        return raw.tobytes()
    at = 0
    out = []
    for a, b in spans:
        out.append(raw[at:a].tobytes())
        at = b
    return b"".join([*out, raw[at:].tobytes()])
