"""Minimal perfect hash over distinct 64-bit keys, built and probed with array operations.

Level by level, each remaining key takes one bit of an array of twice as many bits as keys; a key alone
on its bit stays at that level, the others go to the next.  A key's index is the number of set bits
before its own, so n keys get exactly the indices 0 to n - 1.
"""

from __future__ import annotations

import struct

import numpy as np

from ._runs import distinct
from ._text import U, mix

GAMMA = 2


def _slot(keys, level: int, size: int):
    return (mix(keys ^ mix(np.array([level + 1], U))) % U(size)).astype(np.int64)


class PerfectHash:
    """bits: one array a level; ranks: set bits before each level."""

    def __init__(self, levels: list[np.ndarray]):
        self.levels = levels
        self.before = np.concatenate([[0], np.cumsum([int(x.sum()) for x in levels])]).astype(np.int64)
        self.ranks = [np.cumsum(x) - x for x in levels]

    @classmethod
    def build(cls, keys) -> PerfectHash:
        levels, left = [], distinct(np.asarray(keys, U))
        while len(left):
            size = max(64, GAMMA * len(left))
            slot = _slot(left, len(levels), size)
            count = np.bincount(slot, minlength=size)
            levels.append(count == 1)
            left = left[count[slot] != 1]
        return cls(levels)

    @property
    def n(self) -> int:
        return int(self.before[-1])

    def index(self, keys):
        """Index of each key; a key that was not built in gets -1 or, by chance, the index of another."""
        keys = np.asarray(keys, U)
        out = np.full(len(keys), -1, np.int64)
        left = np.arange(len(keys))
        for level, bits in enumerate(self.levels):
            if not len(left):
                break
            slot = _slot(keys[left], level, len(bits))
            hit = bits[slot]
            out[left[hit]] = self.before[level] + self.ranks[level][slot[hit]]
            left = left[~hit]
        return out

    def to_bytes(self) -> bytes:
        return struct.pack(f"<I{len(self.levels)}Q", len(self.levels), *map(len, self.levels)) + b"".join(np.packbits(x).tobytes() for x in self.levels)

    @classmethod
    def from_bytes(cls, blob: bytes) -> PerfectHash:
        (n,) = struct.unpack_from("<I", blob)
        sizes = struct.unpack_from(f"<{n}Q", blob, 4)
        at, levels = 4 + 8 * n, []
        for s in sizes:
            k = -(-s // 8)
            levels.append(np.unpackbits(np.frombuffer(blob, np.uint8, k, at), count=s).astype(bool))
            at += k
        return cls(levels)
