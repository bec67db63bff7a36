"""Vectorised hashing of words, windows and bytes for the Python stages of the operators."""

from __future__ import annotations

import numpy as np
import xxhash

U64 = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: list[np.ndarray] = [np.ones(1, U64), np.ones(1, U64)]


def words_of(data: bytes) -> list[bytes]:
    """Words between runs of the six ASCII white-space characters."""
    return data.split()


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, words), dtype=U64, count=len(words))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers whose every output bit depends on every input bit."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the base and of its inverse modulo 2^64."""
    if len(_powers[0]) < n:
        size = max(n, 2 * len(_powers[0]), 1024)
        for at, base in enumerate((_BASE, _INVERSE)):
            factors = np.full(size, base & ((1 << 64) - 1), U64)
            factors[0] = 1
            _powers[at] = np.cumprod(factors)
    return _powers[0][:n], _powers[1][:n]


def prefix_sums(x: np.ndarray) -> np.ndarray:
    """Polynomial prefix hashes: entry i covers x[:i], element k weighed by base^-k."""
    out = np.zeros(len(x) + 1, U64)
    np.cumsum(x * powers(len(x))[1], out=out[1:])
    return out


def window_hashes(prefix: np.ndarray, width: int, starts: np.ndarray | None = None) -> np.ndarray:
    """Hashes of the windows of ``width`` elements at ``starts`` (all, if not given)."""
    n = len(prefix) - width
    if n <= 0:
        return np.zeros(0, U64)
    if starts is None:
        return mix((prefix[width:] - prefix[:n]) * powers(n)[0])
    return mix((prefix[starts + width] - prefix[starts]) * powers(n)[0][starts])


def digest(data: bytes) -> bytes:
    return xxhash.xxh3_128_digest(data)
