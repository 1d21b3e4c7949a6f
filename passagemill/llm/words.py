"""Word sequences for comparing texts: case, punctuation, spacing, invisible characters and Unicode form are ignored."""

from __future__ import annotations

import sys
import unicodedata

import numpy as np
import xxhash

#: Marks of category Mn that have no form of their own.
INVISIBLE_MARKS = "͏᠋᠌᠍" + "".join(map(chr, range(0xFE00, 0xFE10)))
_TABLE: dict[int, None] | None = None
_CACHE: dict[str, int] = {}
_CACHE_MAX = 400_000


def _table() -> dict[int, None]:
    global _TABLE
    if _TABLE is None:
        _TABLE = {
            c: None
            for c in range(sys.maxunicode + 1)
            if unicodedata.category(chr(c))[0] in "PS" or unicodedata.category(chr(c)) in ("Cf", "Cn", "Co", "Cs") and c < 0x3FFFF or chr(c) in INVISIBLE_MARKS
        }
        for c in "\t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85":
            _TABLE.pop(ord(c), None)
    return _TABLE


def words(text: str | None) -> list[str]:
    """What white space separates, without case, punctuation and symbols (the bars and arrows of quoted lines too), invisible characters and Unicode form; null gives none."""
    if not text:
        return []
    return unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", text).translate(_table()).lower()).split()


def word_ids(text: str | None) -> np.ndarray:
    """The words of a text as 32-bit hashes that are the same in every process."""
    if len(_CACHE) > _CACHE_MAX:
        _CACHE.clear()
    out = []
    for w in words(text):
        h = _CACHE.get(w)
        if h is None:
            h = _CACHE[w] = xxhash.xxh32_intdigest(w)
        out.append(h)
    return np.array(out, dtype=np.uint32)


def gram_hashes(ids: np.ndarray, n: int) -> np.ndarray:
    """A 64-bit hash of each run of n words."""
    if len(ids) < n:
        return np.zeros(0, dtype=np.uint64)
    h = np.zeros(len(ids) - n + 1, dtype=np.uint64)
    for k in range(n):
        h = (h ^ ids[k : len(ids) - n + 1 + k].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    return h


def edit_distance_within(a: np.ndarray, b: np.ndarray, most: int) -> int:
    """Words added, dropped or changed between a and b; most + 1 if there are more. Diagonal by diagonal over furthest points, O(len + most^2)."""
    la, lb = len(a), len(b)
    if abs(la - lb) > most:
        return most + 1
    a, b = a.tobytes(), b.tobytes()
    a, b = memoryview(a).cast("I"), memoryview(b).cast("I")

    def run(i: int, j: int) -> int:
        while i < la and j < lb and a[i] == b[j]:
            i += 1
            j += 1
        return i

    far = {0: run(0, 0)}
    if la == lb and far[0] == la:
        return 0
    for e in range(1, most + 1):
        nxt = {}
        for k in range(max(-e, -lb), min(e, la) + 1):  # i - j
            i = max(far.get(k - 1, -9) + 1, far.get(k, -9) + 1, far.get(k + 1, -9))
            i = min(i, la, lb + k)
            if i < max(0, k):
                continue
            nxt[k] = i = run(i, i - k)
            if i == la and i - k == lb:
                return e
        far = nxt
    return most + 1
