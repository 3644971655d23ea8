"""Word shingles of whole texts as 64-bit hashes, in numpy, a batch of texts at a time."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash

_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
#: Words of more bytes are hashed one by one.
LONG = 256


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * _A
    h = (h ^ (h >> np.uint64(29))) * _B
    return h ^ (h >> np.uint64(32))


_KEEP = np.array([(1 << 8 * k) - 1 for k in range(9)], dtype=np.uint64)


def _of_words(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of each word of lower-cased bytes, which are followed by eight more: eight bytes of all words at a time."""
    sizes = ends - starts
    out = mixed(sizes.astype(np.uint64) * _A)
    eights = np.ndarray(len(raw) - 7, dtype="<u8", buffer=raw, strides=(1,))
    todo = np.flatnonzero(sizes <= LONG)
    at = 0
    while len(todo):
        value = eights[starts[todo] + at] & _KEEP[np.minimum(sizes[todo] - at, 8)]
        out[todo] = mixed((out[todo] ^ value) * _B)
        at += 8
        todo = todo[sizes[todo] > at]
    for k in np.flatnonzero(sizes > LONG):
        out[k] = xxhash.xxh64_intdigest(raw[starts[k] : ends[k]])
    return out


def hashed_words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all texts' words in order, and where each text's begin: text i has hashes[at[i]:at[i + 1]].

    Words are runs of other characters than ASCII's white space, with A-Z lower-cased. A null is an empty text.
    """
    texts = texts.fill_null("").cast(pa.large_string())
    _, bounds, data = texts.buffers()
    bounds = np.frombuffer(bounds, dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.zeros(bounds[-1] - bounds[0] + 8, dtype=np.uint8)
    n = len(raw) - 8
    if n:
        raw[:n] = np.frombuffer(data, dtype=np.uint8)[bounds[0] : bounds[-1]]
    bounds = bounds - bounds[0]
    raw += ((raw - np.uint8(65)) < 26).view(np.uint8) << np.uint8(5)
    inside = (raw[:n] != 32) & ((raw[:n] - np.uint8(9)) > 4)
    begins, closes = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1]
    closes[:-1] &= ~inside[1:]
    edges = bounds[(bounds > 0) & (bounds < n)]  # a word ends with its text
    begins[edges], closes[edges - 1] = inside[edges], inside[edges - 1]
    starts, ends = np.flatnonzero(begins), np.flatnonzero(closes) + 1
    return _of_words(raw, starts, ends), np.searchsorted(starts, bounds)


def shingled(h: np.ndarray, n: int) -> np.ndarray:
    """The hash of each n words that stand together, in order; of fewer words, one hash of them all."""
    return shingled_rows(h, np.array([0, len(h)]), n)[0]


def shingled_rows(h: np.ndarray, at: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """shingled() of each row of hashed_words(), and where each row's shingles begin."""
    size = np.diff(at)
    count = np.where(size >= n, size - n + 1, size > 0)
    to = np.concatenate([[0], np.cumsum(count)])
    if not len(h):
        return h, to
    every = np.empty(len(h), dtype=np.uint64)
    last = max(0, len(h) - n + 1)
    rolled = h[:last].copy()
    for k in range(1, n):
        rolled = mixed(rolled) + h[k : last + k]
    every[:last] = mixed(rolled)
    out = every[np.arange(to[-1]) + np.repeat(at[:-1] - to[:-1], count)]
    for k in range(1, n):
        short = np.flatnonzero(size == k)
        if len(short):
            whole = np.full(len(short), k, dtype=np.uint64)
            for j in range(k):
                whole = mixed(whole * _B + h[at[short] + j])
            out[to[short]] = whole
    return out, to
