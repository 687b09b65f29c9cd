"""Text kernels shared by the operators: words, tokens, hashes and min-hashes on numpy arrays."""

from __future__ import annotations

import re

import numpy as np
import xxhash

WORD = re.compile(r"[^\W_]+")
TOKEN = re.compile(r"[A-Za-zА-Яа-яЁё0-9-]+")

#: Entries a worker keeps of its word -> hash cache before it starts anew.
CACHE_WORDS = 400_000


class _WordHashes(dict):
    def __missing__(self, word: str) -> int:
        if len(self) >= CACHE_WORDS:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word.encode("utf-8", "surrogatepass"))
        return value


_HASHES = _WordHashes()


def words(text: str | None) -> list[str]:
    """Maximal runs of letters or digits of any script in the lower-cased text; none for null."""
    return WORD.findall(text.lower()) if text else []


def tokens(text: str | None) -> list[str]:
    """Maximal matches of the Latin/Cyrillic token class in the lower-cased text; none for null."""
    return TOKEN.findall(text.lower()) if text else []


def hash_words(found: list[str]) -> np.ndarray:
    return np.fromiter(map(_HASHES.__getitem__, found), dtype=np.uint64, count=len(found))


def hash_text(text: str) -> int:
    """64-bit hash as a signed long."""
    value = xxhash.xxh3_64_intdigest(text.encode("utf-8", "surrogatepass"))
    return value - (1 << 64) if value >> 63 else value


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash (xor-shift and multiply)."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


def grams(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hash of every run of k consecutive words, in order; empty if there are fewer than k."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.empty(0, dtype=np.uint64)
    out = hashes[:n].copy()
    for i in range(1, k):
        out *= np.uint64(0xD1342543DE82EF95)
        out += hashes[i : n + i]
    return mix(out)


class MinHasher:
    """K multiply-add min-hashes of a set of 64-bit values."""

    def __init__(self, k: int, seed: int = 7) -> None:
        rng = np.random.default_rng(seed)
        self.a = rng.integers(1, 1 << 63, size=(k, 1), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.b = rng.integers(0, 1 << 63, size=(k, 1), dtype=np.uint64)

    def __call__(self, values: np.ndarray) -> np.ndarray:
        best = None
        for at in range(0, len(values), 1024):  # blocks, so that a very long text needs no more memory
            low = (values[at : at + 1024] * self.a + self.b).min(axis=1)
            best = low if best is None else np.minimum(best, low)
        return best


def winnow(hashes: np.ndarray, window: int) -> np.ndarray:
    """Positions of the fingerprints: of every ``window`` consecutive hashes the smallest, the rightmost of equals.

    Any run of ``window + k - 1`` words holds at least one of them, whatever surrounds it. Fewer hashes than
    ``window`` give none: such a text has no run of the guaranteed length.
    """
    if len(hashes) < window:
        return np.empty(0, dtype=np.int64)
    view = np.lib.stride_tricks.sliding_window_view(hashes, window)[:, ::-1]
    return np.unique(np.arange(len(view)) + (window - 1) - view.argmin(axis=1))
