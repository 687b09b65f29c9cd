"""String similarity and SimHash as Arrow-batched kernels."""

from __future__ import annotations

import functools
import hashlib
import math
import re

import numpy as np
import pandas as pd
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import LongType

_WORDS = re.compile(r"\S+")
#: Entries a worker keeps of its word -> hash cache before it starts anew.
CACHE_WORDS = 400_000


class _WordHashes(dict):
    def __missing__(self, word: str) -> bytes:
        if len(self) >= CACHE_WORDS:
            self.clear()
        value = self[word] = hashlib.blake2b(word.encode("utf-8", "ignore"), digest_size=8).digest()
        return value


_HASHES = _WordHashes()


def char_places(text: str) -> dict[str, int]:
    """The places of every character as the bits of an integer."""
    x = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    known = np.unique(x)
    where: dict[str, int] = {}
    step = max(1, (1 << 20) // max(1, len(x)))
    for part in (known[k : k + step] for k in range(0, len(known), step)):
        for code, places in zip(part.tolist(), np.packbits(x == part[:, None], axis=1, bitorder="little")):
            where[chr(code)] = int.from_bytes(places.tobytes(), "little")
    return where


def lcs_length(a: str, b: str, least: int = 0, places: dict[str, int] | None = None) -> int:
    """Length of the longest common subsequence, bit-parallel on Python integers; -1 once it can't reach ``least``.

    A common subsequence of ``least`` characters leaves so many of either text unmatched that its matches stay in a band
    around the diagonal; every few dozen characters, what the band has cost so far is held against what may be lost.
    ``places`` are the :func:`char_places` of ``a``, for a text that is compared with many.
    """
    if places is None and len(a) > len(b):
        a, b = b, a
    head = 0
    shorter = min(len(a), len(b))
    while head < shorter and a[head] == b[head]:
        head += 1
    a, b = a[head:], b[head:]
    tail = 0
    while tail < shorter - head and a[-1 - tail] == b[-1 - tail]:
        tail += 1
    if tail:
        a, b = a[:-tail], b[:-tail]
    if not a or not b:
        return head + tail
    full = (1 << len(a)) - 1
    where = char_places(a) if places is None else {ch: bits >> head & full for ch, bits in places.items()}
    row = full
    least -= head + tail
    band = max(0, len(a) - least)  # characters of a that may stay unmatched
    for start in range(0, len(b), 64):
        for ch in b[start : start + 64]:
            match = row & where.get(ch, 0)
            row = row + match | row - match
        row &= full
        done = min(start + 64, len(b))
        low = (1 << min(done + band, len(a))) - 1
        if low.bit_length() - (row & low).bit_count() + len(b) - done < least:
            return -1
    return head + tail + len(a) - row.bit_count()


def indel_ratio(a: str, b: str, cutoff: float = 0.0, places: dict[str, int] | None = None) -> float:
    """2 * LCS / (length of both); 1 for two empty texts; 0 where it is below ``cutoff``."""
    if a == b:
        return 1.0
    total = len(a) + len(b)
    ratio = 2 * lcs_length(a, b, least_common(total, cutoff), places) / total
    return ratio if ratio >= cutoff else 0.0


def least_common(total, cutoff: float):
    """Least length of a common subsequence for a ratio of ``cutoff``; ``total`` is the length of both texts."""
    return np.ceil(cutoff * total / 2 - 1e-9).astype(np.int64) if isinstance(total, np.ndarray) else math.ceil(cutoff * total / 2 - 1e-9)


def may_be_near(texts: list[str], cutoff: float, allowed=None) -> tuple[np.ndarray, np.ndarray]:
    """Indexes i < j of the pairs of ``texts`` whose ratio may reach ``cutoff``; ``allowed(i)`` marks the texts before i
    that it is paired with. Two bounds on the common subsequence are held against it, so no pair is lost:

    * it has no character more often than either text (characters in 64 buckets);
    * a character of one text that is left out breaks at most three of its trigrams, one of the other text at most two. The
      trigrams that aren't broken stand in the other text too, at most as far off as characters may be left out.
      Trigrams are hashed, places are rounded to 64 windows a text.
    """
    lengths = np.array([len(t) for t in texts], dtype=np.int64)
    chars = np.zeros((len(texts), 64), dtype=np.uint32)
    bits = 14 if lengths.max(initial=0) <= 4096 else 15
    grams = []
    for i, text in enumerate(texts):
        x = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        chars[i] = np.bincount(x & 63, minlength=64)
        gram = (x[:-2] * np.uint32(0x9E3779B1) ^ x[1:-1]) * np.uint32(0x85EBCA77) ^ x[2:]
        grams.append((gram * np.uint32(0xC2B2AE3D) >> np.uint32(32 - bits)).astype(np.uint16))
    thirds = np.full((len(texts), max((len(x) + 2) // 3 for x in grams) if grams else 0), 1 << bits, dtype=np.uint16)
    for i, gram in enumerate(grams):
        thirds[i, : (len(gram) + 2) // 3] = gram[::3]
    table = np.zeros((1 << bits) + 1, dtype=np.uint64)  # the last entry, of no trigram, stays empty
    found: list[tuple[int, int]] = []
    for j in range(1, len(texts)):
        least = least_common(lengths[:j] + lengths[j], cutoff)
        fits = (lengths[:j] >= least) & (lengths[j] >= least)
        if allowed is not None:
            fits &= allowed(j)
        near = np.flatnonzero(fits)
        near = near[np.minimum(chars[near], chars[j]).sum(axis=1) >= least[near]]
        found += ((i, j) for i in _sharing(grams, thirds, lengths, table, j, near, cutoff))
    back: dict[int, list[int]] = {}
    for i, j in found:
        back.setdefault(i, []).append(j)
    left, right = [], []
    for i, others in back.items():
        others = _sharing(grams, thirds, lengths, table, i, np.array(others), cutoff)
        left.append(np.full(len(others), i))
        right.append(others)
    none = [np.zeros(0, dtype=np.int64)]
    return np.concatenate(left or none), np.concatenate(right or none)


@functools.cache
def _windows(reach: int) -> np.ndarray:
    """For each of 64 windows the bits of those at most ``reach`` away."""
    return np.array([sum(1 << k for k in range(max(0, i - reach), min(64, i + reach + 1))) for i in range(64)], dtype=np.uint64)


def _sharing(grams: list[np.ndarray], thirds: np.ndarray, lengths: np.ndarray, table: np.ndarray, a: int, others: np.ndarray, cutoff: float) -> np.ndarray:
    """Which of ``others`` have as many trigrams in common with text ``a``, about where they stand, as the ratio takes;
    first by every third trigram, of which a character left out breaks one. ``table`` is empty before and after: of each
    trigram the windows of ``a`` it stands in, as bits."""
    if not len(others):
        return others
    least = least_common(lengths[others] + lengths[a], cutoff)
    lost, lost_a = lengths[others] - least, lengths[a] - least
    width = int(max(lengths[a], lengths[others].max())) // 64 + 1
    table_of = np.repeat(_windows(0), width)
    np.bitwise_or.at(table, grams[a], table_of[: len(grams[a])])
    reach = np.minimum(63, -(-np.maximum(lost, lost_a) // width))
    wanted = -(-(lengths[others] - 2) // 3) - lost - lost_a
    keep = wanted <= 0
    step = max(1, 16_000 // max(1, thirds.shape[1]))
    for r in set(reach.tolist()):
        near = np.repeat(_windows(r), width)
        near_thirds = near[::3].copy()
        chosen = np.flatnonzero(reach == r)
        for at in (chosen[k : k + step] for k in range(0, len(chosen), step)):
            rows = thirds[others[at], : len(near_thirds)]
            seen = table.take(rows, mode="clip")
            seen &= near_thirds[: rows.shape[1]]
            keep[at] |= (seen != 0).sum(axis=1) >= wanted[at]
        for k in chosen[keep[chosen]].tolist():
            gram = grams[others[k]]
            shared = np.count_nonzero(table.take(gram, mode="clip") & near[: len(gram)])
            keep[k] = shared >= len(gram) - 3 * lost[k] - 2 * lost_a[k]
    table[grams[a]] = 0
    return others[keep]


def simhash64(text: str) -> int:
    """64-bit SimHash of the case-folded words as a signed long; a bit with as many votes for as against it is set."""
    hashes = b"".join(map(_HASHES.__getitem__, _WORDS.findall(text.casefold())))
    votes = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), 8 << 16):
        bits = np.unpackbits(np.frombuffer(hashes[at : at + (8 << 16)], dtype=np.uint8), bitorder="little").reshape(-1, 64)
        votes += 2 * bits.sum(axis=0, dtype=np.int64) - len(bits)
    return int(np.packbits(votes >= 0, bitorder="little").view(np.int64)[0])


@pandas_udf(LongType())
def simhash_udf(text: pd.Series) -> pd.Series:
    return pd.Series([None if t is None else simhash64(t) for t in text], dtype="Int64")
