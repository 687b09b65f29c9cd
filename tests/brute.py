"""Plain Python versions of what SQL can't say, written from the definitions."""

import hashlib
import re

import numpy as np

from docloom.functions.terms import term_regex


def lcs(a, b):
    """Length of the longest common subsequence by the textbook table, one row at a time."""
    x = np.frombuffer(a.encode("utf-32-le"), dtype=np.uint32)
    row = np.zeros(len(x) + 1, dtype=np.int32)
    for ch in np.frombuffer(b.encode("utf-32-le"), dtype=np.uint32):
        best = row.copy()
        best[1:] = np.maximum(row[1:], row[:-1] + (x == ch))
        row = np.maximum.accumulate(best)
    return int(row[-1])


def naive_simhash(text):
    votes = [0] * 64
    for word in text.casefold().split():
        value = int.from_bytes(hashlib.blake2b(word.encode("utf-8", "ignore"), digest_size=8).digest(), "little")
        for bit in range(64):
            votes[bit] += 1 if value >> bit & 1 else -1
    return sum(1 << bit for bit in range(64) if votes[bit] >= 0)


def phrase(text, terms, longest=280):
    """90 characters before the earliest first match, ``longest`` behind the end of the latest one."""
    low = text.lower()
    found = []
    for term in terms:
        pattern = term_regex(term)
        if pattern and term.lower().strip() in low and (m := re.search(pattern.replace("(?U)", ""), low)):
            found.append(m)
    if not found:
        return " ".join(text.split())[:longest]
    start = max(0, min(m.start() for m in found) - 90)
    end = min(len(text), max(m.end() for m in found) + longest)
    out = " ".join(text[start:end].split())
    return (("..." if start > 0 else "") + out + ("..." if end < len(text) else ""))[: longest + 6]
