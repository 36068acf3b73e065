"""Word n-grams of texts as 64-bit hashes, by array arithmetic over the bytes of many texts at once.

Words are what stands between ASCII white space, A-Z lower-cased. A word's hash is a polynomial of its bytes modulo 2^64, mixed; that of a window
mixes the hashes of its words in order. Two different windows with the same hash would count as one.
"""

from __future__ import annotations

import numpy as np

#: Bytes of words that are hashed at a time.
STEP_BYTES = 1 << 19
_BLANK = np.zeros(256, bool)
_BLANK[[32, *range(9, 14)]] = True
_LOWER = np.arange(256, dtype=np.uint64)
_LOWER[65:91] += np.uint64(32)
_MIX, _END, _BASE = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), 0xD6E8FEB86659FD93


def word_hashes(rows: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of every word of the texts (A-Z lower-cased, between ASCII blanks), and the number of words of each text."""
    raw = np.frombuffer(b"\n".join([*rows, b""]), np.uint8)
    inside = ~_BLANK[raw]
    edges = np.flatnonzero(np.diff(np.concatenate([[False], inside, [False]]).view(np.int8)))
    starts, sizes = edges[::2], edges[1::2] - edges[::2]
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(len(rows), np.int64)
    first = np.cumsum(sizes) - sizes
    powers = np.ones(int(sizes.max()), np.uint64)
    powers[1:] = _BASE
    np.multiply.accumulate(powers, out=powers)
    h = np.empty(len(starts), np.uint64)
    cuts = np.unique(np.append(np.searchsorted(first, np.arange(0, first[-1] + 1, STEP_BYTES)), len(starts))).tolist()
    for i, j in zip(cuts, cuts[1:]):
        low, high = starts[i], starts[j - 1] + sizes[j - 1]
        part, at = raw[low:high][inside[low:high]], first[i:j] - first[i]
        place = np.arange(len(part)) - np.repeat(at, sizes[i:j])
        h[i:j] = np.add.reduceat((_LOWER[part] + np.uint64(1)) * powers[place], at)
    h = (h ^ (sizes.astype(np.uint64) * _END)) * _MIX
    h ^= h >> np.uint64(32)
    ends = np.cumsum([len(x) + 1 for x in rows])
    return h, np.diff(np.searchsorted(starts, ends), prepend=0)


def shingles(rows: list[str | None], size: int) -> list[np.ndarray]:
    """Hashes of the windows of ``size`` words of each text, repeats included; of a shorter text that of all its words."""
    h, counts = word_hashes([(x or "").encode() for x in rows])

    def windows(words: np.ndarray, width: int) -> np.ndarray:
        g = np.full(len(words) - width + 1, width, np.uint64)
        for k in range(width):
            g = (g ^ words[k : k + len(g)]) * _MIX
            g ^= g >> np.uint64(29)
        g *= _END
        return g ^ (g >> np.uint64(32))

    whole = windows(h, size) if len(h) >= size else h[:0]
    out, at = [], 0
    for n in counts.tolist():
        out.append(whole[at : at + n - size + 1] if n >= size else windows(h[at : at + n], n) if n else h[:0])
        at += n
    return out


def shingle_sets(rows: list[str | None], size: int) -> list[np.ndarray]:
    """The same as sorted sets."""
    return [np.unique(x) for x in shingles(rows, size)]
