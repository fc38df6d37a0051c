"""Minimal perfect hashing of distinct 64-bit keys, bucket by bucket, with the keys kept for verification.

A bucket goes through levels of bit arrays: a key that is alone at its place in a level sets the bit
there, keys that collide go on to the next level. The index of a key is the rank of its bit, so n keys
fill the indices 0 to n - 1, and a vector of n numbers holds a value for each key.
"""

from __future__ import annotations

import numpy as np

SPACE = 2  # places of a level for each of its keys
LEVELS = 40
_MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))  # fixed values of a public 64-bit mixer
_STEP = 0x9E3779B97F4A7C15


def mixed(keys: np.ndarray, seed: int) -> np.ndarray:
    """A hash of 64 bits of each key; a one-to-one map for a given seed."""
    z = keys.astype(np.uint64) + np.uint64((seed + 1) * _STEP % (1 << 64))
    z = (z ^ (z >> np.uint64(30))) * _MIX[0]
    z = (z ^ (z >> np.uint64(27))) * _MIX[1]
    return z ^ (z >> np.uint64(31))


class PerfectHash:
    """The function of one set of distinct keys; `index` is -1 for any other key."""

    def __init__(self, bits: np.ndarray, sizes: np.ndarray, keys: np.ndarray):
        self.bits, self.sizes, self.keys = bits, sizes, keys  # packed bits of all levels, places of each, keys by index
        words = np.zeros(-(-len(bits) // 8) * 8, np.uint8)
        words[: len(bits)] = bits
        self.words = words.view("<u8")
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.words), dtype=np.int64)])

    @classmethod
    def of(cls, keys: np.ndarray) -> PerfectHash:
        left, levels, sizes = keys.astype(np.uint64), [], []
        while len(left):
            if len(sizes) == LEVELS:
                raise ValueError("the keys are not distinct")
            size = SPACE * len(left)
            place = (mixed(left, len(sizes)) % np.uint64(size)).astype(np.int64)
            alone = np.bincount(place, minlength=size) == 1
            levels.append(alone)
            sizes.append(size)
            left = left[~alone[place]]
        bits = np.packbits(np.concatenate(levels) if levels else np.zeros(0, bool), bitorder="little")
        made = cls(bits, np.array(sizes, np.int64), np.zeros(0, np.uint64))
        at = made._ranks(keys.astype(np.uint64))
        made.keys = np.empty(len(keys), np.uint64)
        made.keys[at] = keys
        return made

    def _ranks(self, keys: np.ndarray) -> np.ndarray:
        out, open_, start = np.full(len(keys), -1, np.int64), np.arange(len(keys)), 0
        for level, size in enumerate(self.sizes.tolist()):
            place = (mixed(keys[open_], level) % np.uint64(size)).astype(np.int64) + start
            word, bit = place >> 6, (place & 63).astype(np.uint64)
            value = self.words[word]
            found = (value >> bit) & np.uint64(1) == 1
            lower = value & ((np.uint64(1) << bit) - np.uint64(1))
            out[open_[found]] = (self.before[word] + np.bitwise_count(lower))[found]
            open_, start = open_[~found], start + size
            if not len(open_):
                break
        return out

    def index(self, keys: np.ndarray) -> np.ndarray:
        """The index of each key, -1 where the stored key is another one."""
        keys = keys.astype(np.uint64)
        at = self._ranks(keys)
        known = at >= 0
        known[known] = self.keys[at[known]] == keys[known]
        return np.where(known, at, -1)

    def parts(self) -> tuple[bytes, bytes, bytes]:
        return self.bits.tobytes(), self.sizes.astype("<i8").tobytes(), self.keys.astype("<u8").tobytes()

    @classmethod
    def from_parts(cls, bits: bytes, sizes: bytes, keys: bytes) -> PerfectHash:
        return cls(np.frombuffer(bits, np.uint8), np.frombuffer(sizes, "<i8"), np.frombuffer(keys, "<u8"))
