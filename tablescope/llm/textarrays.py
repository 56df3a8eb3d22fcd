"""Vectorised word hashing over Arrow string batches (numpy, no per-word Python).

A batch of texts is looked at as one flat byte array plus document offsets. A
word is a maximal run of bytes that are not in ``[\\x20\\x09-\\x0D]`` and does
not cross a document boundary. Its 64-bit hash is a polynomial over its bytes
(A-Z lower-cased on request), read off one prefix sum per slice: with an odd
base ``p`` the hash of bytes ``s..e`` is ``(C[e] - C[s]) * p^-s`` modulo 2^64.
Work runs in slices of at most ``SLICE`` bytes cut at word boundaries, so the
temporary memory does not follow the size of a text.
"""
from __future__ import annotations

import numpy as np
import pyarrow as pa

SLICE = 1 << 20
_P = 0x9E3779B97F4A7C15 | 1
_P_INV = pow(_P, -1, 1 << 64)

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_PLAIN = np.arange(256, dtype=np.uint64) + np.uint64(1)
_LOWER = _PLAIN.copy()
_LOWER[65:91] += np.uint64(32)

_POWERS: dict[int, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    have = _POWERS.get(base)
    if have is None or len(have) < n:
        size = max(n, SLICE + 1)
        steps = np.full(size, base, np.uint64)
        steps[0] = 1
        have = _POWERS[base] = np.multiply.accumulate(steps)
    return have[:n]


def fmix(x: np.ndarray) -> np.ndarray:
    """Finalising mix: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


def flat(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string array; a null counts as the empty text."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_string()).fill_null("")
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = texts.buffers()
    off = np.frombuffer(offsets, np.int64)[texts.offset: texts.offset + len(texts) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[off[0]: off[-1]], off - off[0]


def _cuts(space: np.ndarray, starts: np.ndarray, total: int):
    """Slice bounds of about SLICE bytes that never split a word."""
    a = 0
    while a < total:
        b = min(a + SLICE, total)
        if b < total:
            # the last document start or white space in the slice, else the next one after it
            i = np.searchsorted(starts, b, "right") - 1
            doc = int(starts[i]) if i >= 0 else 0
            gaps = np.flatnonzero(space[a:b])
            cut = max(doc, a + int(gaps[-1]) + 1 if len(gaps) else 0)
            if cut <= a:
                after = np.argmax(space[b:]) if space[b:].any() else total - b
                nxt = int(starts[i + 1]) if i + 1 < len(starts) else total
                cut = min(b + int(after), nxt)
            b = max(cut, a + 1)
        yield a, b
        a = b


def words(data: np.ndarray, offsets: np.ndarray, lower: bool = True):
    """(hash, start, end) of every word in text order, and the word count of every document."""
    total, n_docs = len(data), len(offsets) - 1
    counts = np.zeros(n_docs, np.int64)
    hashes, begins, ends = [], [], []
    table = _LOWER if lower else _PLAIN
    starts = np.unique(offsets[:-1])
    starts = starts[starts < total]
    is_space = _SPACE[data]
    for a, b in _cuts(is_space, starts, total):
        part = data[a:b]
        inside = ~is_space[a:b]
        first = inside.copy()
        first[1:] &= ~inside[:-1]
        here = starts[np.searchsorted(starts, a):np.searchsorted(starts, b)] - a
        first[here] = inside[here]
        last = inside.copy()
        last[:-1] &= ~inside[1:]
        before = here[here > 0] - 1
        last[before] = inside[before]
        s, e = np.flatnonzero(first), np.flatnonzero(last) + 1
        sums = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(table[part] * _powers(_P, len(part)), out=sums[1:])
        hashes.append(fmix((sums[e] - sums[s]) * _powers(_P_INV, len(part) + 1)[s]))
        begins.append(s + a)
        ends.append(e + a)
    if not hashes:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), counts
    begin = np.concatenate(begins)
    bounds = np.searchsorted(begin, offsets)
    counts = np.diff(bounds)
    return np.concatenate(hashes), begin, np.concatenate(ends), counts


def batches_of(counts_or_bytes: np.ndarray, limit: int):
    """Consecutive document ranges [i, j) whose sizes sum to at most ``limit`` (one document at least)."""
    ends = np.cumsum(counts_or_bytes)
    i, n = 0, len(ends)
    while i < n:
        base = ends[i - 1] if i else 0
        j = max(i + 1, int(np.searchsorted(ends, base + limit, "right")))
        yield i, j
        i = j
