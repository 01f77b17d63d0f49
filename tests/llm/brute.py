"""Plain Python versions of the operators, for small inputs."""

import hashlib
import re
from collections import Counter

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def shingles(text, n):
    w = words(text)
    return {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


def jaccard(docs, n, percent):
    """[(id, text)] -> [(id, size, component)], in order."""
    sets = [shingles(t, n) for _, t in docs]
    parent = list(range(len(docs)))

    def root(i):
        while parent[i] != i:
            i = parent[i] = parent[parent[i]]
        return i

    where = {}
    for i, s in enumerate(sets):
        for g in s:
            where.setdefault(g, []).append(i)
    for i, s in enumerate(sets):
        overlap = Counter(j for g in s for j in where[g] if j < i)
        for j, both in overlap.items():
            if 100 * both >= percent * (len(s) + len(sets[j]) - both):
                parent[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(docs):
        r = root(i)
        if d is not None:
            least[r] = min(d, least.get(r, d))
    return [(d, len(s), least.get(root(i), d)) for i, ((d, _), s) in enumerate(zip(docs, sets, strict=True))]


def suffix(docs, length):
    """[(id, text)] -> [(id, n_bytes, n_removed, n_spans, sha)], in order."""
    raw = [(t or "").encode() for _, t in docs]
    times = Counter(x[i : i + length] for x in raw for i in range(len(x) - length + 1))
    out = []
    for (d, _), x in zip(docs, raw, strict=True):
        gone = bytearray(len(x))
        end = 0
        for i in range(len(x) - length + 1):
            if times[x[i : i + length]] > 1:
                for j in range(max(i, end), i + length):
                    gone[j] = 1
                end = i + length
        keep = bytes(b for b, g in zip(x, gone, strict=True) if not g)
        spans = sum(1 for j in range(len(x)) if gone[j] and (not j or not gone[j - 1]))
        out.append((d, len(x), len(x) - len(keep), spans, hashlib.sha256(keep).hexdigest()))
    return out


def units(text):
    """[(start, end of the run up to the next unit, words)] in code points of the text."""
    found, current = [], []
    text = text or ""
    for m in WORD.finditer(text):
        if current and "\n" in text[current[-1].end() : m.start()]:
            found.append(current)
            current = []
        current.append(m)
        if m.group()[-1] in ".!?":
            found.append(current)
            current = []
    if current:
        found.append(current)
    return [(u[0].start(), tuple(w.group().translate(LOWER) for w in u)) for u in found]


def lines(docs, min_words):
    """[(id, text)] -> [(id, units, removed units, kept text)], in order; ids are distinct or null."""
    first = {}
    parsed = [units(t) for _, t in docs]
    for (d, _), us in zip(docs, parsed, strict=True):
        for _, w in us:
            if d is not None:
                first[w] = min(d, first.get(w, d))
    out = []
    for (d, t), us in zip(docs, parsed, strict=True):
        seen, again = set(), []
        for _, w in us:
            again.append(w in seen or (d is not None and first[w] < d))
            seen.add(w)
        keep, removed, i = t or "", 0, len(us)
        while i > 0:
            if not again[i - 1]:
                i -= 1
                continue
            b = i
            while i > 0 and again[i - 1]:
                i -= 1
            if sum(len(w) for _, w in us[i:b]) >= min_words:
                removed += b - i
                keep = keep[: us[i][0]] + (keep[us[b][0] :] if b < len(us) else "")
        out.append((d, len(us), removed, keep))
    return out
