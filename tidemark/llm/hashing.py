"""Vectorised 64-bit hashing of words and byte strings."""

from __future__ import annotations

import numpy as np

_ODD = np.uint64(0x9E3779B97F4A7C15)
_MIX1 = np.uint64(0xBF58476D1CE4E5B9)
_MIX2 = np.uint64(0x94D049BB133111EB)
#: A random 64-bit value for each byte.
_BYTES = np.random.default_rng(20240101).integers(1, 2**64, 256, dtype=np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x *= _MIX1
    x ^= x >> np.uint64(27)
    x *= _MIX2
    x ^= x >> np.uint64(31)
    return x


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, np.uint64(base), np.uint64)
    if n:
        out[0] = 1
    return np.multiply.accumulate(out)


_POWERS: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse modulo 2**64."""
    if len(_POWERS.get("up", ())) < n:
        size = 1 << max(16, int(n - 1).bit_length())
        base = int(_ODD)
        _POWERS["up"], _POWERS["down"] = _powers(base, size), _powers(pow(base, -1, 2**64), size)
    return _POWERS["up"][:n], _POWERS["down"][:n]


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of data[start:end] for every span; equal bytes have equal hashes."""
    up, down = powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTES[data] * up[:-1], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64) * _MIX1)


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words [^\\x20\\x09-\\x0D]+ of all texts, A-Z lower-cased, and how many words each text has."""
    if not texts:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    data = _LOWER[np.frombuffer(b" ".join(texts) + b" ", np.uint8)]
    inside = np.empty(len(data) + 1, bool)
    inside[0] = False
    np.logical_not(_SPACE[data], out=inside[1:])
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    starts, ends = edges[::2], edges[1::2]
    lengths = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
    bounds = np.cumsum(lengths)
    counts = np.diff(np.searchsorted(starts, bounds), prepend=0)
    return span_hashes(data, starts, ends), counts


def shingle_sets(texts: list[bytes], size: int) -> list[np.ndarray]:
    """The sorted distinct hashes of each text's shingles of size words; with fewer words the whole sequence is one shingle."""
    words, counts = word_hashes(texts)
    ends = np.cumsum(counts)
    n = max(0, len(words) - size + 1)
    rolled = np.zeros(len(words), np.uint64)
    for k in range(size):
        rolled[:n] = (rolled[:n] + words[k : k + n]) * _ODD if k else words[:n] * _ODD
    rolled[:n] = mix(rolled[:n])
    out = []
    for end, count in zip(ends.tolist(), counts.tolist(), strict=True):
        start = end - count
        if count >= size:
            out.append(np.unique(rolled[start : end - size + 1]))
        elif count:
            h = np.uint64(count)
            with np.errstate(over="ignore"):
                for w in words[start:end]:
                    h = (h + w) * _ODD
            out.append(mix(np.array([h], np.uint64)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out
