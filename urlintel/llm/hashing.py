"""64-bit hashes of substrings and words by prefix sums, in numpy. The values are fixed, so every task agrees.

The sums are polynomials modulo 2^64, for which regular texts of about a thousand bytes can be found that collide. So
substrings of at most SHORT bytes are hashed that way; words longer than that are hashed by BLAKE2.
"""

from __future__ import annotations

import hashlib

import numpy as np

U = np.uint64
_STEP = 0x9E3779B97F4A7C15
_BASE = 0xD6E8FEB86659FD93
_INVERSE = pow(_BASE, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection that spreads every bit (the splitmix64 finaliser)."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


CODES = mix(np.arange(1, 257, dtype=U) * U(_STEP))
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
LOWER_CODES = CODES[LOWER]
SHORT = 512
_powers = {_BASE: np.ones(1, U), _INVERSE: np.ones(1, U)}


def powers(n: int, base: int = _BASE) -> np.ndarray:
    """base ** 0 .. base ** n; the table grows by doubling and is kept."""
    got = _powers[base]
    while len(got) <= n:
        got = np.concatenate([got, got * U(pow(base, len(got), 1 << 64))])
        _powers[base] = got
    return got


class Substrings:
    """Hashes of any substrings of one text."""

    def __init__(self, raw: bytes):
        codes = CODES[np.frombuffer(raw, np.uint8)]
        self.n = len(codes)
        self.sums = np.zeros(self.n + 1, U)
        np.cumsum(codes * powers(self.n)[: self.n], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * powers(self.n, _INVERSE)[start] + (end - start).astype(U))


SPACES = np.zeros(256, bool)
SPACES[[0x20, *range(0x09, 0x0E)]] = True
#: Word bytes of "anything but white space", and of "letters, digits and all that isn't ASCII" after lower-casing.
VISIBLE = ~SPACES
ALNUM = np.zeros(256, bool)
ALNUM[48:58] = ALNUM[65:91] = ALNUM[97:123] = ALNUM[128:] = True
BLOCK = 1 << 20


def words(raw: bytes, is_word: np.ndarray) -> np.ndarray:
    """The hash of every word of a text, A-Z lower-cased, in order. Long texts go block by block, cut between words."""
    data = np.frombuffer(raw, np.uint8)
    out, at = [], 0
    while at < len(data):
        end = at + BLOCK
        if end < len(data):
            gaps = np.flatnonzero(~is_word[data[at:end]])
            while not len(gaps) and end < len(data):  # one word fills the block: take more
                end += BLOCK
                gaps = np.flatnonzero(~is_word[data[at:end]])
            end = at + int(gaps[-1]) + 1 if len(gaps) else end
        part = data[at:end]
        at = end
        inside = np.zeros(len(part) + 2, np.int8)
        inside[1:-1] = is_word[part]
        edge = np.diff(inside)
        start, stop = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        sums = np.zeros(len(part) + 1, U)
        np.cumsum(LOWER_CODES[part] * powers(len(part))[: len(part)], out=sums[1:])
        found = mix((sums[stop] - sums[start]) * powers(len(part), _INVERSE)[start] + (stop - start).astype(U))
        for i in np.flatnonzero(stop - start > SHORT).tolist():
            word = LOWER[part[start[i] : stop[i]]].tobytes()
            found[i] = int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little")
        out.append(found)
    return np.concatenate(out) if out else np.zeros(0, U)


def grams(hashes: np.ndarray, k: int) -> np.ndarray:
    """The hash of every run of k consecutive words."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, U)
    out = np.full(n, k, U)
    for j in range(k):
        out = (out + hashes[j : j + n]) * U(_BASE)
    return mix(out)


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """The least of every ``width`` consecutive values, by doubling."""
    out, have = values, 1
    while have < width:
        step = min(have, width - have)
        out = np.minimum(out[:-step], out[step:])
        have += step
    return out


def word_spans(data: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where every word starts and ends, and its hash as in ``words``. Sums are taken over BLOCK bytes at a time."""
    inside = np.zeros(len(data) + 2, np.int8)
    inside[1:-1] = is_word[data]
    edge = np.diff(inside)
    start, stop = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    out = np.zeros(len(start), U)
    short = stop - start <= SHORT
    for at in range(0, len(data), BLOCK):
        i, j = np.searchsorted(start, (at, at + BLOCK))
        own = np.flatnonzero(short[i:j]) + i
        part = data[at : at + BLOCK + SHORT]
        sums = np.zeros(len(part) + 1, U)
        np.cumsum(LOWER_CODES[part] * powers(len(part))[: len(part)], out=sums[1:])
        a, b = start[own] - at, stop[own] - at
        out[own] = mix((sums[b] - sums[a]) * powers(len(part), _INVERSE)[a] + (b - a).astype(U))
    for i in np.flatnonzero(~short).tolist():
        word = LOWER[data[start[i] : stop[i]]].tobytes()
        out[i] = int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little")
    return start, stop, out
