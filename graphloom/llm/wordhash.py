"""Words of many texts as 64-bit hashes, with numpy over the bytes of a whole batch.

All arithmetic is modulo 2**64. A word's hash is a polynomial in random values of
its bytes, mixed with its length; the same word has the same hash in every process.
"""

from __future__ import annotations

import numpy as np

U = np.uint64
_rng = np.random.Generator(np.random.PCG64(0x5EED))
#: A random value for each byte; odd multipliers for what follows.
BYTE_VALUE = _rng.integers(1, 2**64, 256, dtype=np.uint64, endpoint=False)
BASE = U((0x9E3779B97F4A7C15 * 4 + 5) % 2**64)
INVERSE = U(pow(int(BASE), -1, 2**64))
LOWER_VALUE = BYTE_VALUE.copy()
LOWER_VALUE[65:91] = BYTE_VALUE[97:123]
#: Space and 0x09-0x0D.
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[32, 9, 10, 11, 12, 13]] = True

_powers: dict[str, np.ndarray] = {}


def powers(n: int, inverse: bool = False) -> np.ndarray:
    """BASE**0 .. BASE**(n-1), or those of its inverse."""
    key = "inverse" if inverse else "base"
    have = _powers.get(key)
    if have is None or len(have) < n:
        step = np.full(max(n, 1 << 16), INVERSE if inverse else BASE, np.uint64)
        step[0] = 1
        have = _powers[key] = np.cumprod(step, dtype=np.uint64)
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits that spreads every bit."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
        return x ^ (x >> U(31))


class Words:
    """Words of a list of texts (bytes; None has no words), in order.

    ``hash``, ``start`` and ``end`` (byte places in ``data``, end exclusive) hold all
    words; those of text k are ``first[k]:first[k + 1]``.
    """

    def __init__(self, texts: list[bytes | None], lower: bool = False):
        texts = [t or b"" for t in texts]
        self.data = b"\n".join(texts) + b"\n"
        raw = np.frombuffer(self.data, np.uint8)
        space = IS_SPACE[raw]
        edge = np.flatnonzero(np.diff(space.astype(np.int8), prepend=np.int8(1)))
        self.start, self.end = edge[0::2], edge[1::2]  # the data ends with a space, so every word has an end
        with np.errstate(over="ignore"):
            value = (LOWER_VALUE if lower else BYTE_VALUE)[raw]
            value *= powers(len(raw))
            total = np.empty(len(raw) + 1, np.uint64)
            total[0] = 0
            np.cumsum(value, out=total[1:])
            got = (total[self.end] - total[self.start]) * powers(len(raw), True)[self.start]
            self.hash = mix(got + (self.end - self.start).astype(np.uint64) * U(0xD6E8FEB86659FD93))
        length = np.fromiter(map(len, texts), np.int64, len(texts))
        self.at = np.concatenate([[0], np.cumsum(length + 1)])  # byte place of each text
        self.first = np.searchsorted(self.start, self.at)


def window_hash(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of each n consecutive values (len(h) - n + 1 of them)."""
    if len(h) < n:
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        total = np.empty(len(h) + 1, np.uint64)
        total[0] = 0
        np.cumsum(h * powers(len(h)), out=total[1:])
        return mix((total[n:] - total[:-n]) * powers(len(h) - n + 1, True) + U(n))


def shingles(words: np.ndarray, n: int) -> np.ndarray:
    """Sorted distinct hashes of a text's n-word shingles; of all its words if fewer; none without words."""
    if not len(words):
        return np.zeros(0, np.uint64)
    return np.unique(window_hash(words, min(n, len(words))))


def sliding_min(v: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each ``width`` consecutive values, from block-wise prefix and suffix minima."""
    n = len(v)
    if n < width:
        return v[:0]
    padded = np.full(-(-n // width) * width, np.iinfo(v.dtype).max, v.dtype)
    padded[:n] = v
    blocks = padded.reshape(-1, width)
    before = np.minimum.accumulate(blocks, axis=1).ravel()
    after = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(after[: n - width + 1], before[width - 1 : n])


def prefix_hash(h: np.ndarray) -> np.ndarray:
    """Running sums from which ``range_hash`` takes the hash of any range."""
    with np.errstate(over="ignore"):
        total = np.empty(len(h) + 1, np.uint64)
        total[0] = 0
        np.cumsum(h * powers(len(h)), out=total[1:])
    return total


def range_hash(total: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        got = (total[end] - total[start]) * powers(len(total), True)[start]
        return mix(got + (end - start).astype(np.uint64) * U(0xD6E8FEB86659FD93))
