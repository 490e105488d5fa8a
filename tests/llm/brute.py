"""Plain second implementations that the operators are held against."""

from __future__ import annotations

import hashlib
import re
from collections import defaultdict

SPACE = " \t\n\x0b\x0c\r"
UPPER = {c: c + 32 for c in range(65, 91)}


def words(text):
    return [w for w in re.split(r"[\x20\x09-\x0d]+", (text or "").translate(UPPER)) if w]


def shingle_set(text, size):
    w = words(text)
    return frozenset(" ".join(w[i : i + size]) for i in range(max(1, len(w) - size + 1))) if w else frozenset()


def components(rows, size, num, den):
    """{doc_id: (n_shingles, component)} of (doc_id, text) rows, by comparing all pairs."""
    sets = [(i, shingle_set(t, size)) for i, t in rows if i is not None]
    up = {i: i for i, _ in sets}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for k, (i, a) in enumerate(sets):
        for j, b in sets[:k]:
            if a and b and den * len(a & b) >= num * len(a | b):
                x, y = sorted((find(i), find(j)))
                up[y] = x
    return {i: (len(s), find(i)) for i, s in sets}


def deduped(rows, least, keep_first=False):
    """[(doc_id, n_lines, n_dropped, kept text)] of (doc_id, text) rows."""
    key = lambda line: line.strip(SPACE).translate(UPPER)
    docs = defaultdict(set)
    for i, t in rows:
        for line in (t or "").split("\n"):
            if i is not None:
                docs[key(line)].add(i)
    out = []
    for i, t in rows:
        kept, seen, lines = [], set(), (t or "").split("\n")
        for line in lines:
            k = key(line)
            first = keep_first and docs[k] and i == min(docs[k]) and k not in seen
            if k and len(docs[k]) >= least and not first:
                continue
            seen.add(k)
            kept.append(line)
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return out


def sha256(text):
    return hashlib.sha256(text.encode()).hexdigest()
