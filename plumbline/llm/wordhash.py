"""Words of a chunk of texts, and hashes of windows of them, with NumPy.

A word's value is its XXH3. A window's hash is a polynomial of its words' values modulo the prime
2^61 - 1, from running sums, so any window costs the same; two unlike windows of n words agree
with a chance of n in 2^61 for a base that does not depend on them, whatever their words are.
``Words.digest`` is BLAKE2b of a window's words themselves.
"""

from __future__ import annotations

import hashlib

import numpy as np
import xxhash

PRIME = (1 << 61) - 1
BASES = (0x0E3779B97F4A7C15, 0x16E8FEB86659FD93)
_P = np.uint64(PRIME)
_LOW29, _LOW30, _LOW31, _LOW32 = (np.uint64((1 << k) - 1) for k in (29, 30, 31, 32))
_29, _30, _31, _32, _61 = map(np.uint64, (29, 30, 31, 32, 61))
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def reduced(x: np.ndarray) -> np.ndarray:
    """x modulo the prime, for any 64 bits."""
    x = (x >> _61) + (x & _P)
    return np.where(x >= _P, x - _P, x)


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a * b modulo the prime, both below it; 2^61 is 1 there."""
    a1, a0, b1, b0 = a >> _31, a & _LOW31, b >> _31, b & _LOW31
    middle = a0 * b1 + a1 * b0
    return reduced(a1 * b1 * np.uint64(2) + (middle >> _30) + ((middle & _LOW30) << _31) + a0 * b0)


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of a base and of its inverse, and perhaps more."""
    have = _powers.get(base)
    if have is None or len(have[0]) < n:
        out = []
        for b in (base, pow(base, -1, PRIME)):
            p, step = np.ones(1, np.uint64), b
            while len(p) < max(n, 1 << 16):
                p = np.concatenate((p, product(p, np.full(len(p), step, np.uint64))))
                step = step * step % PRIME
            out.append(p)
        have = (out[0], out[1])
        if len(out[0]) <= 1 << 22:
            _powers[base] = have
    return have


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits that spreads each of them."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Sums:
    """Running sums of values, for the hash of any span of them."""

    def __init__(self, values: np.ndarray, base: int):
        up, self.down = powers(base, len(values) + 1)
        terms = product(reduced(values), up[: len(values)])
        high, low = (np.cumsum(x, dtype=np.uint64) for x in (terms >> _32, terms & _LOW32))
        high = reduced(high)
        total = reduced(((high & _LOW29) << _32) + (high >> _29) + reduced(low))
        self.total = np.concatenate((np.zeros(1, np.uint64), total))

    def spans(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """The mixed hash of values[start:end] for each span, as signed numbers."""
        inside = reduced(self.total[end] + _P - self.total[start])
        length = (end - start).astype(np.uint64)
        return mix(product(inside, self.down[start]) ^ (length << _32)).view(np.int64)


class Words:
    """The words of some texts, cut at ASCII white space; ``first`` has where each text's words start."""

    def __init__(self, texts: list[bytes]):
        words: list[bytes] = []
        first = [0]
        for t in texts:
            words += t.split()
            first.append(len(words))
        self.words, self.first = words, np.array(first, np.int64)
        self.joined = b" ".join(words)
        self.at = np.concatenate((np.zeros(1, np.int64), np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)))

    def __len__(self) -> int:
        return len(self.words)

    def values(self, seed: int = 0) -> np.ndarray:
        digest = xxhash.xxh3_64_intdigest
        return np.fromiter((digest(w, seed) for w in self.words), np.uint64, len(self.words))

    def digests(self, start: np.ndarray, end: np.ndarray, size: int = 16) -> list[bytes]:
        """BLAKE2b of the words of each span, a space between."""
        joined, blake = memoryview(self.joined), hashlib.blake2b
        return [blake(joined[a:b], digest_size=size).digest() for a, b in zip(self.at[start].tolist(), (self.at[end] - 1).tolist(), strict=True)]
