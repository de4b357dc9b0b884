"""Minimal perfect hash of a set of 64-bit keys: levels of bit arrays, built and asked for many keys at once.

Level by level every key still without a place is hashed into twice as many bits as there are keys; a bit that only one
key hits is that key's place. A place's number is its rank among all set bits, so n keys get 0..n-1. Expected 3 to 4 bits
a key and under two probes a lookup. A stored fingerprint tells keys that are not in the set.
"""

from __future__ import annotations

import struct

import numpy as np

from bagframe.llm.words import mix

_MAGIC = b"MPH64v1\0"


def _place(keys: np.ndarray, level: int, size: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return (mix(keys ^ mix(np.array([level + 1], np.uint64))) % np.uint64(size)).astype(np.int64)


def fingerprints(keys: np.ndarray) -> np.ndarray:
    return (mix(keys ^ np.uint64(0xA0761D6478BD642F)) >> np.uint64(32)).astype(np.uint32)


class PerfectHash:
    def __init__(self, sizes: list[int], bits: np.ndarray):
        self.sizes = sizes
        self.bits = bits                      # one bool per bit, all levels after each other
        self.starts = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
        self.rank = np.concatenate([[0], np.cumsum(bits, dtype=np.int64)])

    @classmethod
    def build(cls, keys: np.ndarray) -> PerfectHash:
        """keys: distinct, as unsigned 64-bit integers."""
        rest, sizes, levels = np.asarray(keys, np.uint64), [], []
        while len(rest):
            size = max(64, 2 * len(rest))
            at = _place(rest, len(sizes), size)
            hits = np.bincount(at, minlength=size)
            sizes.append(size)
            levels.append(hits == 1)
            rest = rest[hits[at] != 1]
        return cls(sizes, np.concatenate(levels) if levels else np.zeros(0, bool))

    def __len__(self) -> int:
        return int(self.rank[-1])

    def lookup(self, keys: np.ndarray) -> np.ndarray:
        """Place of each key; -1 if no level knows it. Compare fingerprints before trusting a place."""
        keys = np.asarray(keys, np.uint64)
        out, live = np.full(len(keys), -1, np.int64), np.arange(len(keys))
        for level, size in enumerate(self.sizes):
            if not len(live):
                break
            at = _place(keys[live], level, size) + self.starts[level]
            hit = self.bits[at]
            out[live[hit]] = self.rank[at[hit]]
            live = live[~hit]
        return out

    def to_bytes(self) -> bytes:
        head = _MAGIC + struct.pack("<I", len(self.sizes)) + struct.pack(f"<{len(self.sizes)}Q", *self.sizes)
        return head + np.packbits(self.bits, bitorder="little").tobytes()

    @classmethod
    def from_bytes(cls, data: bytes) -> tuple[PerfectHash, int]:
        """(the hash, how many bytes it took)."""
        if data[:8] != _MAGIC:
            raise ValueError("not a perfect hash")
        (n,) = struct.unpack_from("<I", data, 8)
        sizes = list(struct.unpack_from(f"<{n}Q", data, 12))
        at, total = 12 + 8 * n, sum(sizes)
        length = (total + 7) // 8
        bits = np.unpackbits(np.frombuffer(data, np.uint8, length, at), bitorder="little")[:total].astype(bool)
        return cls(sizes, bits), at + length
