"""Hashes of n-grams: FNV-1a over 16-bit units or tags, then the 32-bit murmur finaliser, on whole arrays at once."""

from __future__ import annotations

import unicodedata

import numpy as np

# Fixed values of the two published hashes.
OFFSET, PRIME = 2166136261, 16777619
FIRST, SECOND = 0x85EBCA6B, 0xC2B2AE35

_ALNUM: np.ndarray | None = None


def alnum() -> np.ndarray:
    """For each 16-bit unit, whether it is a letter or a decimal digit."""
    global _ALNUM
    if _ALNUM is None:
        _ALNUM = np.array([(c := unicodedata.category(chr(u)))[0] == "L" or c == "Nd" for u in range(1 << 16)])
    return _ALNUM


def gram_hashes(units: np.ndarray, n: int) -> np.ndarray:
    """Unsigned 32-bit hashes of all windows of n units."""
    count = max(0, len(units) - n + 1)
    h = np.full(count, OFFSET, np.uint32)
    for k in range(n):
        h = (h ^ units[k : k + count].astype(np.uint32)) * np.uint32(PRIME)
    h ^= h >> np.uint32(16)
    h *= np.uint32(FIRST)
    h ^= h >> np.uint32(13)
    h *= np.uint32(SECOND)
    return h ^ (h >> np.uint32(16))


def buckets_of(hashes: np.ndarray, buckets: int) -> np.ndarray:
    """Floor modulus of the hash as a signed number."""
    return hashes.view(np.int32).astype(np.int64) % buckets


def units_of(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-16-le", "surrogatepass"), "<u2")
