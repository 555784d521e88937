"""Brute-force versions of the operators, on plain Python values."""

from __future__ import annotations

import hashlib
import math
import zlib
from collections import Counter, defaultdict


def repeated_strings(rows, length=100):
    """(id, bytes, removed, spans, digest) by a table of every string; rows of distinct ids."""
    first, out = {}, []
    for doc, text in sorted(rows, key=lambda r: r[0]):
        raw = (text or "").encode()
        covered = bytearray(len(raw))
        for s in range(len(raw) - length + 1):
            w = raw[s:s + length]
            if w in first and first[w] < (doc, s):
                covered[s:s + length] = b"\1" * length
            else:
                first.setdefault(w, (doc, s))
        spans = sum(1 for i, c in enumerate(covered) if c and (i == 0 or not covered[i - 1]))
        kept = bytes(x for x, c in zip(raw, covered, strict=True) if not c)
        out.append((doc, len(raw), sum(covered), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def jaccard_components(rows, size=4, percent=85):
    """(id, set size, component) by counting the overlap of every pair that shares a shingle."""
    sets = []
    for _, text in rows:
        w = (text or "").encode().lower().split()
        sets.append({tuple(w[i:i + size]) for i in range(max(1, len(w) - size + 1))} if w else set())
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    holders = defaultdict(list)
    for i, s in enumerate(sets):
        overlap = Counter(j for x in s for j in holders[x])
        for x in s:
            holders[x].append(i)
        for j, o in overlap.items():
            if 100 * o >= percent * (len(s) + len(sets[j]) - o):
                parent[root(i)] = root(j)
    least = {}
    for i, (doc, _) in enumerate(rows):
        least[root(i)] = min(least.get(root(i), doc), doc)
    return sorted((doc, len(sets[i]), least[root(i)] if sets[i] else doc) for i, (doc, _) in enumerate(rows))


def jaccard_links(rows, size=4, percent=85):
    """(id, number of other sets linked with the set of the row), comparing every pair of distinct sets."""
    sets = []
    for _, text in rows:
        w = (text or "").encode().lower().split()
        sets.append(frozenset(tuple(w[i:i + size]) for i in range(max(1, len(w) - size + 1))) if w else frozenset())
    distinct = list({s for s in sets if s})
    n = Counter()
    for i, a in enumerate(distinct):
        for b in distinct[:i]:
            o = len(a & b)
            if o and 100 * o >= percent * (len(a) + len(b) - o):
                n[a] += 1
                n[b] += 1
    return sorted((doc, n[s]) for (doc, _), s in zip(rows, sets, strict=True))


def unigram_scores(rows):
    """id -> (tokens, known, training tokens, base score)."""
    counts = Counter()
    for doc, text in rows:
        if zlib.crc32(str(doc).encode()) % 10:
            counts.update((text or "").encode().lower().split())
            counts[None] += 1
    n, v = sum(counts.values()), len(counts)
    out = {}
    for doc, text in rows:
        tokens = [*(text or "").encode().lower().split(), None]
        score = sum(math.log10((counts[t] + 0.1) / (n + 0.1 * (v + 1))) for t in tokens)
        out[doc] = (len(tokens), sum(counts[t] > 0 for t in tokens), n, score)
    return out


def text_rules(text):
    """(words, characters, marks, equal lines, words in repeated windows)."""
    import re

    words = [w for w in re.split(r"[\x20\x09-\x0D]+", text or "") if w]
    windows = Counter(tuple(words[i:i + 3]) for i in range(len(words) - 2))
    hit = {i + k for i in range(len(words) - 2) for k in range(3) if windows[tuple(words[i:i + 3])] > 1}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    equal = sum(x in lines[:i] for i, x in enumerate(lines))
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), equal, len(hit)
