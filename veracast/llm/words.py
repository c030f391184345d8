"""Hashing of words and shingles straight from Arrow's text buffers.

A word is a maximal run of ASCII letters, digits and non-ASCII bytes of the
lower-cased text. Words are hashed with a polynomial over their bytes that is
read off a running sum, so a batch costs a few vector operations and no
Python object per word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_IS_WORD = np.zeros(256, dtype=bool)
_IS_WORD[[*b"0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ", *range(128, 256)]] = True
_BLOCK = 1 << 19
_power: tuple[np.ndarray, np.ndarray] = (np.ones(1, np.uint64), np.ones(1, np.uint64))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Of the base and of its inverse, modulo 2**64, up to n at least."""
    global _power
    if len(_power[0]) < n:
        _power = tuple(np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(max(n, _BLOCK), b, np.uint64)])) for b in (_BASE, _INVERSE))  # type: ignore[assignment]
    return _power


def mix(h: np.ndarray) -> np.ndarray:
    """Finalise 64-bit hashes so that every bit depends on all others."""
    h = h ^ (h >> np.uint64(31))
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(32)
    return h


def pieces(batch: pa.RecordBatch | pa.Table, text: str, most: int = 4 << 20) -> Iterator[pa.RecordBatch | pa.Table]:
    """Slices of whole rows with about ``most`` bytes of text each."""
    if not batch.num_rows:
        return
    size = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    group = (np.cumsum(size) - size) // most
    cuts = [0, *(np.flatnonzero(np.diff(group)) + 1), batch.num_rows]
    for a, b in zip(cuts, cuts[1:]):
        yield batch.slice(a, b - a)


def spans(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, word starts, word ends, index of each text's first word, then the number of words)."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    low = pc.utf8_lower(pc.fill_null(texts.cast(pa.large_string()), ""))
    at = np.frombuffer(low.buffers()[1], np.int64)[low.offset : low.offset + len(low) + 1]
    data = low.buffers()[2]
    if data is None or at[-1] == at[0]:
        none = np.zeros(0, np.int64)
        return np.zeros(0, np.uint8), none, none, np.zeros(len(low) + 1, np.int64)
    buf = np.frombuffer(data, np.uint8)[at[0] : at[-1]]
    at = at - at[0]
    inside = np.zeros(len(buf) + 2, dtype=bool)
    inside[1:-1] = _IS_WORD[buf]
    first = inside[1:-1] & ~inside[:-2]
    last = inside[1:-1] & ~inside[2:]
    cut = at[1:-1]
    cut = cut[(cut > 0) & (cut < len(buf))]  # words don't run on into the next text
    first[cut] = inside[cut + 1]
    last[cut - 1] = inside[cut]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    return buf, start, end, np.searchsorted(start, at)


def word_hashes(texts: pa.Array, stem: int = 0) -> tuple[np.ndarray, ...]:
    """(64-bit hash of each word of all texts, offset of each text's first word
    and the end); with ``stem``, then the hash of each word's first bytes, too."""
    buf, start, end, offset = spans(texts)
    out = np.empty(len(start), np.uint64)
    begin = np.empty(len(start) if stem else 0, np.uint64)
    i = 0
    while i < len(start):
        j = max(i + 1, int(np.searchsorted(end, start[i] + _BLOCK, side="right")))
        part = buf[start[i] : end[j - 1]].astype(np.uint64) + np.uint64(1)
        up, down = _powers(len(part))
        part *= up[: len(part)]
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(part)])
        a, b = start[i:j] - start[i], end[i:j] - start[i]
        out[i:j] = (total[b] - total[a]) * down[a]
        if stem:
            begin[i:j] = (total[np.minimum(a + stem, b)] - total[a]) * down[a]
        i = j
    return (mix(out), offset, mix(begin)) if stem else (mix(out), offset)


def shingle_hashes(words: np.ndarray, offset: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each run of k words within a text, offsets); a text of fewer
    words, if any, has one shingle, of all its words."""
    n = np.diff(offset)
    count = np.where(n >= k, n - k + 1, np.minimum(n, 1))
    after = np.concatenate([[0], np.cumsum(count)])
    owner = np.repeat(np.arange(len(n)), count)
    at = np.arange(after[-1]) - after[owner] + offset[owner]
    h = np.zeros(len(at), np.uint64)
    stop = offset[owner + 1] if len(owner) else at
    for j in range(k):
        odd = np.uint64((_BASE * (2 * j + 1)) & ((1 << 64) - 1))
        if j == 0:
            h += words[at] * odd
        else:
            there = at + j < stop
            h += np.where(there, words[np.minimum(at + j, max(0, len(words) - 1))] * odd, np.uint64(0))
    return mix(h), after
