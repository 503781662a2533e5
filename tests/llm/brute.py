"""Plain Python versions of the operators' results, for small tables."""

from __future__ import annotations

import hashlib
import re
from collections import defaultdict

import numpy as np


class Groups:
    def __init__(self, nodes):
        self.parent = {n: n for n in nodes}

    def root(self, x):
        while self.parent[x] != x:
            x = self.parent[x]
        return x

    def join(self, a, b):
        a, b = self.root(a), self.root(b)
        self.parent[max(a, b)] = min(a, b)


def shingles(text, n):
    lower = {i: i + 32 for i in range(65, 91)}
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(lower))
    if not words:
        return frozenset()
    return frozenset(tuple(words[i:i + n]) for i in range(max(len(words) - n + 1, 1)))


def components(rows, n, percent):
    """{doc_id: (set size, component)} of (doc_id, text) rows with distinct ids."""
    sets = {i: shingles(t, n) for i, t in rows}
    groups, ids = Groups(sets), sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1:]:
            common = len(sets[a] & sets[b])
            if common and 100 * common >= percent * len(sets[a] | sets[b]):
                groups.join(a, b)
    return {i: (len(sets[i]), groups.root(i)) for i in ids}


def removed(rows, length):
    """{doc_id: (bytes, removed, spans, sha256 of the rest)} of (doc_id, text) rows with distinct ids."""
    first = {}
    texts = {i: (t or "").encode() for i, t in rows}
    for i in sorted(texts):
        for k in range(len(texts[i]) - length + 1):
            first.setdefault(texts[i][k:k + length], i)
    out = {}
    for i, text in texts.items():
        cut = np.zeros(len(text), bool)
        for k in range(len(text) - length + 1):
            if first[text[k:k + length]] < i:
                cut[k:k + length] = True
        spans = int((cut & ~np.concatenate([[False], cut[:-1]])).sum()) if len(cut) else 0
        rest = bytes(b for b, c in zip(text, cut, strict=True) if not c)
        out[i] = (len(text), int(cut.sum()), spans, hashlib.sha256(rest).hexdigest())
    return out


def nearest(ids, x, query_ids, k, score):
    """{query: [(id, score)]}: the k highest scores, ties to the smaller id."""
    out = defaultdict(list)
    for q in query_ids:
        own = x[list(ids).index(q)]
        ranked = sorted(((score(own, v), i) for i, v in zip(ids, x, strict=True) if i != q), key=lambda t: (-t[0], t[1]))
        out[q] = [(i, s) for s, i in ranked[:k]]
    return out
