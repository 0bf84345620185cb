"""Texts as flat arrays of code points, words and word shingles (NumPy only).

A word is a maximal run of letters and digits, lower-cased one code point at a
time. Word and shingle fingerprints are 64-bit; two different shingles of one
comparison agree by accident with a chance of about 1e-19 times their number.
"""

from __future__ import annotations

from functools import cache

import numpy as np

SHINGLE = 5
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)


@cache
def word_codes() -> np.ndarray:
    """For each code point its lower-case form if it is a letter or digit, else 0."""
    out = np.zeros(0x110000, np.uint32)
    for i in range(0x110000):
        ch = chr(i)
        if ch.isalnum():
            low = ch.lower()
            out[i] = ord(low) if len(low) == 1 else i
    return out


@cache
def _powers(n: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n - 1, _BASE, np.uint64)]))


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser, in place where possible."""
    with np.errstate(over="ignore"):
        x = x ^ (x >> np.uint64(31))
        x *= np.uint64(0x7FB5D329728EA185)
        x ^= x >> np.uint64(27)
        x *= np.uint64(0x81DADEF4BC2DD44D)
        x ^= x >> np.uint64(33)
    return x


def flat(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """All code points of the texts one after another, and where each begins (with the end)."""
    starts = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t) if t else 0 for t in texts], out=starts[1:])
    joined = "".join([t for t in texts if t])
    return np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32), starts


def words(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprints of all words, and where each text's words begin (with the end)."""
    codes, starts = flat(texts)
    n = len(codes)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(len(texts) + 1, np.int64)
    low = word_codes()[codes]
    inside = low > 0
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    at = starts[:-1][starts[:-1] < n]
    first[at] |= inside[at]
    last = inside.copy()
    last[:-1] &= ~inside[1:] | first[1:]
    s, e = np.flatnonzero(first), np.flatnonzero(last) + 1
    size = 1 << max(16, int(n).bit_length())
    power = _powers(size)
    with np.errstate(over="ignore"):
        total = np.zeros(n + 1, np.uint64)
        np.cumsum((low.astype(np.uint64) + np.uint64(1)) * power[:n], out=total[1:])
        # The same word gives the same value wherever it stands, in any batch.
        found = (total[e] - total[s]) * _inverse(size)[s]
    found = mix(found + (e - s).astype(np.uint64))
    return found, np.searchsorted(s, starts)


@cache
def _inverse(n: int) -> np.ndarray:
    inverse = pow(int(_BASE), -1, 1 << 64)
    with np.errstate(over="ignore"):
        return np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n - 1, inverse, np.uint64)]))


def shingles(texts: list[str | None], size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprints of all word shingles in text order, repeats included.

    A text of 1 to ``size - 1`` words is one shingle; one without words has none.
    """
    word, at = words(texts)
    count = np.diff(at)
    made = np.where(count >= size, count - size + 1, np.minimum(count, 1))
    out_at = np.zeros(len(texts) + 1, np.int64)
    np.cumsum(made, out=out_at[1:])
    rank = np.arange(out_at[-1]) - np.repeat(out_at[:-1], made)
    begin = np.repeat(at[:-1], made) + rank
    width = np.repeat(np.minimum(count, size), made)
    with np.errstate(over="ignore"):
        out = np.zeros(len(begin), np.uint64)
        for k in range(size):
            place = np.minimum(begin + k, max(len(word) - 1, 0))
            out *= np.uint64(0xD6E8FEB86659FD93)
            out += np.where(k < width, word[place] if len(word) else 0, 0).astype(np.uint64)
    return mix(out), out_at


def shingle_sets(texts: list[str | None], size: int = SHINGLE) -> list[np.ndarray]:
    """Each text's set of shingles as a sorted array."""
    all_, at = shingles(texts, size)
    return [np.unique(all_[a:b]) for a, b in zip(at[:-1], at[1:], strict=True)]


@cache
def hash_parameters(k: int, seed: int = 1) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(seed)
    return rng.integers(0, 1 << 31, k, dtype=np.uint32) * np.uint32(2) + np.uint32(1), rng.integers(0, 1 << 32, k, dtype=np.uint32)


def minhash(all_: np.ndarray, at: np.ndarray, k: int, seed: int = 1) -> np.ndarray:
    """(pieces, k) minima of k hash functions over each non-empty piece [at[i], at[i+1])."""
    a, b = hash_parameters(k, seed)
    low = (all_ >> np.uint64(32)).astype(np.uint32)
    out = np.empty((len(at) - 1, k), np.uint32)
    value = np.empty_like(low)
    for i in range(k):
        np.multiply(low, a[i], out=value)
        value += b[i]
        value ^= value >> np.uint32(15)
        value *= np.uint32(0x2C1B3C6D)
        out[:, i] = np.minimum.reduceat(value, at[:-1])
    return out
