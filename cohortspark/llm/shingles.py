"""64-bit hashes of word shingles, computed on the bytes of a whole text with array operations.

A text is hashed in stretches of about a megabyte cut at white space, so memory beyond the result
(eight bytes a word) does not grow with the text.
"""

from __future__ import annotations

import numpy as np

_STRETCH = 1 << 20
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values in which every bit depends on every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


# one value per byte; A-Z share theirs with a-z, which folds the case of A-Z only
_BYTES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_BASE))
_BYTES[65:91] = _BYTES[97:123]


def _powers(base: int, n: int) -> np.ndarray:
    steps = np.full(n, base, dtype=np.uint64)
    steps[0] = 1
    return np.multiply.accumulate(steps)


_UP, _DOWN = _powers(_BASE, 4096), _powers(_INVERSE, 4096)


def _grown(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _UP, _DOWN
    if len(_UP) < n:
        size = 1 << (n - 1).bit_length()
        _UP, _DOWN = _powers(_BASE, size), _powers(_INVERSE, size)
    return _UP, _DOWN


def _stretch_words(data: np.ndarray) -> np.ndarray:
    inside = ~_SPACE[data]
    edges = np.flatnonzero(np.diff(np.concatenate(([False], inside, [False])).view(np.int8)))
    starts, ends = edges[0::2], edges[1::2]
    up, down = _grown(len(data) + 1)
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_BYTES[data] * up[: len(data)], dtype=np.uint64)))
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def word_hashes(text: str | None) -> np.ndarray:
    """One value per word `[^\\x20\\x09-\\x0D]+` of the text, in order, A-Z lower-cased."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    parts, at = [], 0
    while at < len(raw):
        end = min(len(raw), at + _STRETCH)
        while end < len(raw) and raw[end] not in b" \t\n\x0b\x0c\r":
            end += 1
        parts.append(_stretch_words(np.frombuffer(raw, np.uint8, end - at, at)))
        at = end
    return np.concatenate(parts) if parts else np.zeros(0, np.uint64)


def shingle_set(text: str | None, words: int) -> np.ndarray:
    """Sorted distinct hashes of the shingles of `words` words.

    A text with fewer words has its whole sequence as its one shingle; without words it has none.
    """
    w = word_hashes(text)
    if not len(w):
        return w
    size = min(words, len(w))
    out = np.full(len(w) - size + 1, size, dtype=np.uint64)
    for k in range(size):
        out = mix(out * np.uint64(_BASE) + w[k : len(w) - size + 1 + k])
    return np.unique(out)
