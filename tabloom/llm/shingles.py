"""Sets of word shingles as 64-bit hashes, and their minima under many universal hash functions.

Words are runs of bytes other than 20 and 09-0D (hex) after A-Z are lower-cased; a shingle is a run of WIDTH words. A
text with fewer words has its whole sequence as one shingle; a text without words has none.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

WIDTH = 5
BANDS, ROWS = 24, 5
HASHES = BANDS * ROWS

_rng = np.random.default_rng(20_240_601)
_draw = lambda n: _rng.integers(0, 1 << 64, n, dtype=np.uint64)
_LETTER = _draw(256)
_STEP = np.uint64(int(_draw(1)[0]) & ~7 | 5)  # 5 modulo 8: of the largest order modulo 2**64
_BACK = np.uint64(pow(int(_STEP), -1, 1 << 64))
_PLACE = _draw(WIDTH) | np.uint64(1)
_SHORT = _draw(WIDTH + 1)
_A, _B = _draw(HASHES) | np.uint64(1), _draw(HASHES)
_BAND_PLACE, _BAND = _draw(ROWS) | np.uint64(1), _draw(BANDS)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_BLOCK = 1 << 16


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_UP, _DOWN = _powers(_STEP, _BLOCK), _powers(_BACK, _BLOCK)


def mix(x: np.ndarray) -> np.ndarray:
    """A one-to-one mixing of 64 bits."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def word_hashes(text: str) -> np.ndarray:
    """A hash of each word: a polynomial over random values of its bytes, from differences of running sums."""
    data = np.frombuffer(text.encode("utf-8", "surrogatepass").lower(), np.uint8)
    if not len(data):
        return np.zeros(0, np.uint64)
    inside = np.concatenate([[False], ~_SPACE[data], [False]])
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    starts, ends = edges[::2], edges[1::2]
    # Words in blocks of about _BLOCK bytes; only a longer word needs more powers than those at hand.
    out, at = np.empty(len(starts), np.uint64), 0
    while at < len(starts):
        to = max(at + 1, int(np.searchsorted(ends, starts[at] + _BLOCK, "right")))
        first = starts[at]
        some = data[first : ends[to - 1]]
        up, down = (_UP, _DOWN) if len(some) <= _BLOCK else (_powers(_STEP, len(some)), _powers(_BACK, len(some)))
        sums = np.zeros(len(some) + 1, np.uint64)
        np.cumsum(_LETTER[some] * up[: len(some)], out=sums[1:])
        a, b = starts[at:to] - first, ends[at:to] - first
        out[at:to] = mix((sums[b] - sums[a]) * down[a] + (b - a).astype(np.uint64))
        at = to
    return out


def shingle_set(words: np.ndarray) -> np.ndarray:
    """Sorted distinct shingle hashes of a sequence of word hashes."""
    n = len(words)
    if not n:
        return words
    if n < WIDTH:
        return mix((words * _PLACE[:n]).sum(dtype=np.uint64, keepdims=True) + _SHORT[n : n + 1])
    total = words[: n - WIDTH + 1] * _PLACE[0]
    for k in range(1, WIDTH):
        total += words[k : n - WIDTH + 1 + k] * _PLACE[k]
    return np.unique(mix(total))


def minima(shingles: np.ndarray) -> np.ndarray:
    """The high 32 bits of the least (a x + b) mod 2**64 for each of the hash functions."""
    low = np.full(HASHES, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(shingles), 256):
        some = shingles[at : at + 256]
        np.minimum(low, (_A[:, None] * some + _B[:, None]).min(1), out=low)
    return (low >> np.uint64(32)).astype(np.uint32)


def band_keys(signature: np.ndarray) -> np.ndarray:
    rows = signature.reshape(BANDS, ROWS).astype(np.uint64)
    return mix((rows * _BAND_PLACE).sum(1, dtype=np.uint64) + _BAND).astype(np.int64)


def linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """100 * intersection >= percent * union, of two sorted sets."""
    if 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= percent * (len(a) + len(b) - both)


def sets_of(texts: list[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(word hashes, shingle set) of each text."""
    for t in texts:
        words = word_hashes(t or "")
        yield words, shingle_set(words)
