"""Word shingles of texts as 64-bit hashes, in numpy over whole batches."""

from __future__ import annotations

import numpy as np

SIZE = 5
_U = np.uint64
_BYTE = np.random.default_rng(7).integers(1, 2**64, 256, dtype=np.uint64)
_BASE = _U(0x9E3779B97F4A7C15)
_INVERSE = _U(pow(0x9E3779B97F4A7C15, -1, 2**64))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def word_hashes(text: bytes) -> np.ndarray:
    """A hash of each ASCII-lower-cased word of a text. Words are runs of bytes other than space
    and U+0009 to U+000D; a word's hash is a polynomial of its bytes, taken from running sums."""
    return _words(text)[0]


def _words(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of a text's words, and where they start."""
    raw = np.frombuffer(text.lower(), np.uint8)
    inside = ~((raw == 32) | ((raw >= 9) & (raw <= 13)))
    edge = np.flatnonzero(np.diff(inside, prepend=False, append=False))
    starts, stops = edge[::2], edge[1::2]
    if not len(starts):
        return np.zeros(0, np.uint64), starts
    n = len(raw)
    powers = _powers(n)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(_BYTE[raw] * powers[:n], out=sums[1:])
    value = (sums[stops] - sums[starts]) * _inverses(n)[starts]
    return mix(value + (stops - starts).astype(np.uint64) * _BASE), starts


def words_in(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The word hashes of several texts, and which text each is of."""
    words, starts = _words(b"\n".join(texts))
    ends = np.cumsum([len(t) + 1 for t in texts])
    return words, np.searchsorted(ends, starts, "right")


_cached: dict[str, np.ndarray] = {}


def _table(name: str, base: np.uint64, n: int) -> np.ndarray:
    have = _cached.get(name)
    if have is None or len(have) < n:
        size = max(1 << 16, 1 << int(n).bit_length())
        have = np.full(size, base, np.uint64)
        have[0] = 1
        have = np.cumprod(have)
        if size <= 1 << 19:
            _cached[name] = have
    return have


def _powers(n: int) -> np.ndarray:
    return _table("powers", _BASE, n)


def _inverses(n: int) -> np.ndarray:
    return _table("inverses", _INVERSE, n)


def shingle_set(text: str | None, size: int = SIZE) -> np.ndarray:
    """The sorted distinct shingles of a text; the whole sequence as one if it is shorter, none
    without words."""
    words = word_hashes((text or "").encode("utf-8", "surrogatepass"))
    if not len(words):
        return words
    k = min(size, len(words))
    n = len(words) - k + 1
    h = np.full(n, k, np.uint64)
    for i in range(k):
        h = mix(h * _U(0xD1342543DE82EF95) + words[i : i + n])
    return np.unique(h)
