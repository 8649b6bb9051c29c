"""Minimal perfect hash of a fixed key set, by levels of bit arrays.

Each level keeps the keys that fall alone into a cell; the others go on to the next,
smaller level.  A key's slot is the rank of its bit over all levels, so n keys fill the
slots 0 .. n-1 exactly.  Keys are pairs of 64-bit words (parts of a digest); building and
looking up are whole-array operations.
"""

from __future__ import annotations

import struct

import numpy as np

from tilewright.llm.common import mix64

_STEP = 0x9E3779B97F4A7C15


class PerfectHash:
    """slots(a, b): the slot of each key, or -1 for keys that are surely not in the set.

    A key outside the set may still get a slot; the caller compares the full key there.
    """

    def __init__(self, bits: list[np.ndarray]):
        self.bits = bits
        self.ranks = []
        n = 0
        for level in bits:
            rank = np.cumsum(level, dtype=np.int64) - 1 + n
            self.ranks.append(rank)
            n += int(level.sum())
        self.n = n

    @staticmethod
    def _cells(a: np.ndarray, b: np.ndarray, level: int, size: int) -> np.ndarray:
        seed = np.uint64((level + 1) * _STEP & 0xFFFFFFFFFFFFFFFF)
        return (mix64(a ^ mix64(b + seed)) % np.uint64(size)).astype(np.int64)

    @classmethod
    def build(cls, a: np.ndarray, b: np.ndarray, gamma: float = 2.0) -> PerfectHash:
        """Keys must be distinct as pairs."""
        bits = []
        while len(a):
            if len(bits) > 200:
                raise ValueError("keys of a perfect hash must be distinct")
            size = max(8, int(gamma * len(a)))
            at = cls._cells(a, b, len(bits), size)
            alone = np.bincount(at, minlength=size) == 1
            bits.append(alone)
            rest = ~alone[at]
            a, b = a[rest], b[rest]
        return cls(bits)

    def slots(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        out = np.full(len(a), -1, np.int64)
        left = np.arange(len(a))
        for level, (bits, ranks) in enumerate(zip(self.bits, self.ranks, strict=True)):
            if not len(left):
                break
            at = self._cells(a[left], b[left], level, len(bits))
            hit = bits[at]
            out[left[hit]] = ranks[at[hit]]
            left = left[~hit]
        return out

    def dump(self) -> bytes:
        sizes = [len(x) for x in self.bits]
        return struct.pack(f"<I{len(sizes)}I", len(sizes), *sizes) + b"".join(np.packbits(x).tobytes() for x in self.bits)

    @classmethod
    def load(cls, blob: bytes) -> PerfectHash:
        (n,) = struct.unpack_from("<I", blob)
        sizes = struct.unpack_from(f"<{n}I", blob, 4)
        at, bits = 4 + 4 * n, []
        for size in sizes:
            step = (size + 7) // 8
            bits.append(np.unpackbits(np.frombuffer(blob, np.uint8, step, at), count=size).astype(bool))
            at += step
        return cls(bits)
