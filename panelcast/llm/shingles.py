"""Word-shingle sets of whole texts as arrays of 64-bit hashes."""

from __future__ import annotations

import numpy as np

from panelcast.llm.common import distinct, mix64, span_hashes, word_spans

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_STEP = np.uint64(0x9E3779B97F4A7C15)


def shingle_hashes(buf: np.ndarray, offs: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, document) of every n-word shingle in text order; A-Z count as a-z. A text of fewer
    words is one shingle; one without words has none."""
    buf = _LOWER[buf]
    start, end, doc = word_spans(buf, offs)
    w = span_hashes(buf, start, end)
    h = np.zeros(len(w), np.uint64)
    size = np.bincount(doc, minlength=len(offs) - 1)
    first = np.cumsum(size) - size
    rank = np.arange(len(w)) - first[doc]          # of a word in its document
    left = np.minimum(size[doc], n)                # words of the shingle that starts here
    for k in range(n):
        h[:len(w) - k] = np.where(k < left[:len(w) - k], mix64((h[:len(w) - k] + w[k:]) * _STEP + np.uint64(k + 1)), h[:len(w) - k])
    starts = rank <= np.maximum(size[doc] - n, 0)
    return h[starts], doc[starts]


def unique_sets(h: np.ndarray, doc: np.ndarray, n_docs: int) -> list[np.ndarray]:
    """The distinct hashes of each document, ascending."""
    cut = np.searchsorted(doc, np.arange(n_docs + 1))
    return [distinct(h[cut[k]:cut[k + 1]]) for k in range(n_docs)]
