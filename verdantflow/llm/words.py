"""Words and word shingles of whole texts as 64-bit hashes, computed over Arrow buffers.

A word is a run of bytes other than space and 0x09-0x0D; A-Z count as a-z. Null text has no words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_U = np.uint64
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[32, *range(9, 14)]] = True
_BYTE = np.random.default_rng(20240611).integers(1, 2**63, 256, dtype=np.uint64)
_CASED = _BYTE.copy()
_BYTE[65:91] = _BYTE[97:123]
_BASE = _U(0x9E3779B97F4A7C15)
_UNBASE = _U(pow(0x9E3779B97F4A7C15, -1, 2**64))
_STEP = _U(0xD6E8FEB86659FD93)
_PIECE = 1 << 18
_powers: tuple[np.ndarray, np.ndarray] = (np.ones(1, _U), np.ones(1, _U))


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = x ^ (x >> _U(32))
    x *= _U(0xD6E8FEB86659FD93)
    x ^= x >> _U(29)
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(32)
    return x


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _powers
    if len(_powers[0]) < n:
        up, down = np.full(n, _BASE), np.full(n, _UNBASE)
        up[0] = down[0] = 1
        _powers = np.multiply.accumulate(up), np.multiply.accumulate(down)
    return _powers


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column and the n + 1 places where its rows begin; null is empty."""
    texts = pc.fill_null(texts, "")
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    kind = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, kind)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64) if len(texts) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, at - at[0]


def word_spans(raw: np.ndarray, at: np.ndarray, fold: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where each word of the texts in a buffer begins and ends, and its hash; ``fold`` takes A-Z as a-z."""
    begins, ends, hashes, done = [], [], [], 0
    byte = _BYTE if fold else _CASED
    while done < len(raw):
        to = min(done + _PIECE, len(raw))
        while to < len(raw):  # no word is cut
            cut = np.flatnonzero(_SPACE[raw[to : to + 4096]])
            if len(cut):
                to += int(cut[0])
                break
            to = min(to + 4096, len(raw))
        piece = raw[done:to]
        word = ~_SPACE[piece]
        fresh = np.zeros(len(piece) + 1, dtype=bool)
        fresh[at[np.searchsorted(at, done) : np.searchsorted(at, to)] - done] = True
        first, last = word.copy(), word.copy()
        first[1:] &= ~word[:-1] | fresh[1:-1]
        last[:-1] &= ~word[1:] | fresh[1:-1]
        first, last = np.flatnonzero(first), np.flatnonzero(last)
        up, down = _power(len(piece))
        value = byte[piece] * up[: len(piece)]
        total = np.cumsum(value)
        begins.append(first + done)
        ends.append(last + 1 + done)
        hashes.append(mixed((total[last] - total[first] + value[first]) * down[first] + (last - first).astype(_U)))
        done = to
    if not begins:
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(0, _U)
    return np.concatenate(begins), np.concatenate(ends), np.concatenate(hashes)


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words in order, and the n + 1 places where each text's words begin."""
    raw, at = buffers(texts)
    begins, _, hashes = word_spans(raw, at)
    return hashes, np.searchsorted(begins, at)


def shingle_sets(texts: pa.Array, n: int) -> Iterator[np.ndarray]:
    """For each text the sorted distinct hashes of its ``n``-word shingles; a shorter text is one shingle."""
    word, at = word_hashes(texts)
    every = np.zeros(0, _U)
    if len(word) >= n:
        every = word[: len(word) - n + 1].copy()
        for k in range(1, n):
            every *= _STEP
            every += word[k : len(word) - n + 1 + k]
        every = mixed(every)
    for a, b in zip(at[:-1].tolist(), at[1:].tolist()):
        if b - a >= n:
            own = np.sort(every[a : b - n + 1])
            yield own[np.concatenate(([True], own[1:] != own[:-1]))]
        elif b > a:
            value = word[a : a + 1].copy()
            for k in range(1, n):
                value *= _STEP
                value += word[a + k] if a + k < b else _U(b - a)
            yield mixed(value)
        else:
            yield np.zeros(0, _U)
