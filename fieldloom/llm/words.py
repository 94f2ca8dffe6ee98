"""Words of many documents at once: positions, hashes and shingles as NumPy vectors over UTF-8 bytes.

ASCII letters are lower-cased, other bytes stay. A word's hash depends on its bytes alone, so
equal words have equal hashes in every task; the 64 bits keep chance collisions near 2**-60.
"""

from __future__ import annotations

import numpy as np

_SEED = np.random.Generator(np.random.PCG64(20240611))
_BYTE = _SEED.integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_BASE = np.uint64(0xD6E8FEB86659FD95 & ~7 | 5)
_BACK = np.uint64(pow(int(_BASE), -1, 2**64))

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Words are runs of anything but ASCII white space.
SPACED = np.ones(256, bool)
SPACED[[32, *range(9, 14)]] = False
#: Words are runs of digits, letters and all beyond ASCII.
ALNUM = np.zeros(256, bool)
ALNUM[48:58] = ALNUM[97:123] = ALNUM[128:] = True

#: Bytes hashed at once, unless one range is longer.
STRETCH = (1 << 18) - 1

_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, at least ``n`` of each; kept up to 4 million."""
    if len(_powers[0]) < n:
        size = 1 << max(16, int(n - 1).bit_length())
        made = []
        for base in (_BASE, _BACK):
            x = np.full(size, base, np.uint64)
            x[0] = 1
            made.append(np.multiply.accumulate(x))
        if size > 1 << 22:
            return made[0], made[1]
        _powers[:] = made
    return _powers[0], _powers[1]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values whose every output bit depends on all input bits."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


class Words:
    """Words of the documents ``bounds`` cuts ``data`` into.

    ``start`` and ``end`` are byte positions in ``data``; words of document i are those numbered
    ``first[i]`` to ``first[i + 1]``; ``hash`` is of the lower-cased bytes.
    """

    def __init__(self, data: np.ndarray, bounds: np.ndarray, kind: np.ndarray, hashed: bool = True):
        low = LOWER[data]
        inside = np.zeros(len(data) + 1, bool)
        inside[:-1] = kind[low]
        begins = inside.copy()
        begins[1:] &= ~inside[:-1]
        cut = bounds[:-1]
        begins[cut] = inside[cut]
        ends = inside.copy()
        ends[:-1] &= ~inside[1:] | begins[1:]
        self.start = np.flatnonzero(begins)
        self.end = np.flatnonzero(ends) + 1
        self.first = np.searchsorted(self.start, bounds)
        self.hash = hash_spans(low, self.start, self.end) if hashed else None

    def doc(self) -> np.ndarray:
        """The document of each word."""
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


def hash_spans(low: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte ranges, each by differences of a running sum; ranges in order are taken stretch by stretch, so that sums and powers are held for ``STRETCH`` bytes."""
    out, a = np.empty(len(start), np.uint64), 0
    ordered = bool((start[1:] >= start[:-1]).all() and (end[1:] >= end[:-1]).all())
    while a < len(start):
        b = max(a + 1, int(np.searchsorted(end, start[a] + STRETCH, "right"))) if ordered else len(start)
        at = int(start[a]) if ordered else 0
        part, begins = low[at : int(end[b - 1]) if ordered else len(low)], start[a:b] - at
        power, back = _power(len(part) + 1)
        run = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(_BYTE[part] * power[: len(part)], out=run[1:])
        out[a:b] = mix((run[end[a:b] - at] - run[begins]) * back[begins])
        a = b
    return out


def hash_words(words: list[str]) -> np.ndarray:
    """Hashes that :class:`Words` gives these words, for vocabularies and tests."""
    raw = [w.encode() for w in words]
    bounds = np.cumsum([0, *map(len, raw)])
    flat = LOWER[np.frombuffer(b"".join(raw), np.uint8)]
    return hash_spans(flat, bounds[:-1], bounds[1:])


_SALT = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xFF51AFD7ED558CCD, 0xA0761D6478BD642F], np.uint64)


def shingles(hashes: np.ndarray, first: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each run of ``width`` words, and where each document's begin.

    A document of fewer words, but not none, has its whole sequence as one shingle.
    """
    power = [np.uint64(pow(int(_SALT[1]) | 1, k, 2**64)) for k in range(width)]
    n = np.diff(first)
    total = len(hashes)
    out = np.zeros(total, np.uint64)
    for k in range(width):
        out[: total - k] += hashes[k:] * power[k]
    live = np.zeros(total + 1, np.int64)
    live[first[:-1][n >= width]] += 1
    np.subtract.at(live, (first[1:] - width + 1)[n >= width], 1)
    whole = np.cumsum(live[:-1]) > 0
    for i in np.flatnonzero((n > 0) & (n < width)):
        at = first[i]
        whole[at] = True
        out[at] = sum((int(h) * int(p) for h, p in zip(hashes[at : at + n[i]], power, strict=False)), int(n[i])) % 2**64
    counts = np.add.reduceat(np.append(whole, False).astype(np.int64), first[:-1]) if len(n) else np.zeros(0, np.int64)
    counts[n == 0] = 0
    return mix(out[whole]), np.concatenate([[0], np.cumsum(counts)])
