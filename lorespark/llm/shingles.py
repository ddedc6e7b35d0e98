"""Five-word shingle sets as sorted arrays of 64-bit hashes."""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd

WIDTH = 5
_MUL = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xFF51AFD7ED558CCD)
_SHIFT = np.uint64(33)
EMPTY = np.zeros(0, np.uint64)


def word_hashes(text: str | None) -> np.ndarray:
    """Hashes of the words of a text: A-Z lower-cased, split at space and \\t-\\r.

    ``bytes.lower`` and ``bytes.split`` touch ASCII only, which is that rule.
    """
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return EMPTY
    column = np.empty(len(words), dtype=object)
    column[:] = words
    return pd.util.hash_array(column, categorize=False)


def shingle_hashes(text: str | None, width: int = WIDTH) -> np.ndarray:
    """Sorted distinct hashes of the ``width``-word shingles; fewer words: one hash of all."""
    w = word_hashes(text)
    if not len(w):
        return EMPTY
    span = min(width, len(w))
    s = w[: len(w) - span + 1].copy()
    for k in range(1, span):
        s *= _MUL
        s += w[k : len(w) - span + 1 + k]
    s ^= s >> _SHIFT
    s *= _MIX
    s ^= s >> _SHIFT
    s.sort()
    if len(s) > 1:
        s = s[np.concatenate(([True], s[1:] != s[:-1]))]
    return s


def set_id(s: np.ndarray) -> int:
    """63-bit identity of a shingle set."""
    return int.from_bytes(hashlib.blake2b(s.tobytes(), digest_size=8).digest(), "little") >> 1


def overlap(a: np.ndarray, b: np.ndarray) -> int:
    """Common values of two sorted distinct arrays."""
    if len(a) > len(b):
        a, b = b, a
    if not len(a):
        return 0
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    return int((b[at] == a).sum())


def width_for(n: int, per: int) -> int:
    """Bitmap width in bits: the power of two at or above ``per * n``, 64 at least."""
    return max(64, 1 << (per * max(n, 1) - 1).bit_length())


def bitmap(s: np.ndarray, bits: int) -> np.ndarray:
    """Little-endian bitmap of the hashes' low bits as uint64 words."""
    out = np.zeros(bits, np.uint8)
    out[(s & np.uint64(bits - 1)).astype(np.int64)] = 1
    return np.packbits(out, bitorder="little").view(np.uint64)


def fold(m: np.ndarray, words: int) -> np.ndarray:
    """The bitmap at a smaller power-of-two width: halves OR-ed; bounds stay valid."""
    while len(m) > words:
        half = len(m) // 2
        m = m[:half] | m[half:]
    return m
