"""Minimal perfect hashing by cascades of collision-free bits (Limasset et al. 2017), on numpy arrays."""

from __future__ import annotations

import io

import numpy as np

from quillmark.llm.common import mix64

SPACE = 2.0
MOST_LEVELS = 48


def _place(keys: np.ndarray, level: int, bits: int) -> np.ndarray:
    step = np.uint64(level * 0x9E3779B97F4A7C15 % 2**64)
    return (mix64(keys + step) % np.uint64(bits)).astype(np.int64)


class PerfectHash:
    """Gives each of n distinct 64-bit keys its own place from 0 to n - 1; another key gets any place or -1."""

    def __init__(self, levels: list[np.ndarray]):
        self.levels, self.ranks, before = levels, [], 0
        for words in levels:
            ones = np.bitwise_count(words).astype(np.int64)
            self.ranks.append(before + np.concatenate(([0], np.cumsum(ones)[:-1])))
            before += int(ones.sum())
        self.n = before

    @classmethod
    def build(cls, keys: np.ndarray) -> PerfectHash:
        levels, left = [], np.asarray(keys, np.uint64)
        while len(left):
            if len(levels) == MOST_LEVELS:
                raise ValueError("the keys are not distinct")
            words = max(1, -(-int(SPACE * len(left)) // 64))
            at = _place(left, len(levels), words * 64)
            alone = np.bincount(at, minlength=words * 64)[at] == 1
            mask = np.zeros(words * 64, bool)
            mask[at[alone]] = True
            levels.append(np.packbits(mask, bitorder="little").view("<u8").astype(np.uint64))
            left = left[~alone]
        return cls(levels)

    def places(self, keys: np.ndarray) -> np.ndarray:
        out = np.full(len(keys), -1, np.int64)
        open_, left = np.arange(len(keys)), np.asarray(keys, np.uint64)
        for k, words in enumerate(self.levels):
            if not len(left):
                break
            at = _place(left, k, len(words) * 64)
            word, bit = words[at >> 6], (at & 63).astype(np.uint64)
            hit = (word >> bit) & np.uint64(1) == 1
            low = word & ((np.uint64(1) << bit) - np.uint64(1))
            out[open_[hit]] = (self.ranks[k][at >> 6] + np.bitwise_count(low))[hit]
            open_, left = open_[~hit], left[~hit]
        return out


class LineIndex:
    """One shard: a perfect hash over line digests, and at each place a 64-bit fingerprint, a count and the last holder."""

    def __init__(self, salt: int, hashed: PerfectHash, prints: np.ndarray, counts: np.ndarray, last: np.ndarray):
        self.salt, self.hashed, self.prints, self.counts, self.last = salt, hashed, prints, counts, last

    @staticmethod
    def _keys(digests: np.ndarray, salt: int) -> np.ndarray:
        return digests[:, 0] + np.uint64(salt) * mix64(digests[:, 1])

    @classmethod
    def build(cls, digests: np.ndarray, counts: np.ndarray, last: np.ndarray) -> LineIndex:
        """digests: n x 2 words of 64 bits, distinct rows. A salt is tried until the first words, salted, are distinct."""
        for salt in range(64):
            keys = cls._keys(digests, salt)
            if len(np.unique(keys)) == len(keys):
                break
        hashed = PerfectHash.build(keys)
        order = np.argsort(hashed.places(keys))
        return cls(salt, hashed, digests[order, 1], np.minimum(counts[order], 2**32 - 1).astype(np.uint32), last[order])

    def find(self, digests: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Count and last holder of each digest; count 0 where it isn't indexed."""
        if not self.hashed.n or not len(digests):
            return np.zeros(len(digests), np.int64), np.zeros(len(digests), np.int64)
        at = self.hashed.places(self._keys(digests, self.salt))
        known = (at >= 0) & (self.prints[at] == digests[:, 1])
        return np.where(known, self.counts[at].astype(np.int64), 0), self.last[at]

    def dumps(self) -> bytes:
        out = io.BytesIO()
        np.savez(out, salt=self.salt, prints=self.prints, counts=self.counts, last=self.last, sizes=[len(x) for x in self.hashed.levels], words=np.concatenate([np.zeros(0, np.uint64), *self.hashed.levels]))
        return out.getvalue()

    @classmethod
    def loads(cls, data: bytes) -> LineIndex:
        x = np.load(io.BytesIO(data))
        cuts = np.cumsum(x["sizes"])[:-1].astype(np.int64) if len(x["sizes"]) else []
        levels = np.split(x["words"], cuts) if len(x["sizes"]) else []
        return cls(int(x["salt"]), PerfectHash(levels), x["prints"], x["counts"], x["last"])
