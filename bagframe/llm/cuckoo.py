"""Cuckoo filter over 64-bit keys with inserts, deletes and lookups of many keys at once."""

from __future__ import annotations

import struct

import numpy as np

from bagframe.llm.words import mix

_MAGIC = b"CUCKOO1\0"
_SLOTS = 4


class CuckooFilter:
    """Buckets of four 16-bit fingerprints; a key lives in one of two buckets, which its fingerprint links.

    Only keys that were inserted may be deleted, each as often as it was inserted. When the buckets are full the caller
    gets `False` and builds a larger filter from the exact table behind it.
    """

    def __init__(self, buckets: int):
        if buckets & (buckets - 1) or buckets < 2:
            raise ValueError("the number of buckets is a power of two, 2 or more")
        self.table = np.zeros((buckets, _SLOTS), np.uint16)

    @classmethod
    def for_keys(cls, n: int) -> CuckooFilter:
        """Room for n keys at 80 % load or less."""
        buckets = 2
        while buckets * _SLOTS * 4 < n * 5:
            buckets *= 2
        return cls(buckets)

    def _prints(self, keys: np.ndarray) -> np.ndarray:
        return (mix(keys) % np.uint64(65535) + np.uint64(1)).astype(np.uint16)

    def _first(self, keys: np.ndarray) -> np.ndarray:
        return (mix(keys ^ np.uint64(0x2545F4914F6CDD1D)) & np.uint64(len(self.table) - 1)).astype(np.int64)

    def _other(self, bucket: np.ndarray, prints: np.ndarray) -> np.ndarray:
        return bucket ^ (mix(prints.astype(np.uint64)) & np.uint64(len(self.table) - 1)).astype(np.int64)

    def contains(self, keys: np.ndarray) -> np.ndarray:
        f, a = self._prints(keys), self._first(keys)
        return (self.table[a] == f[:, None]).any(1) | (self.table[self._other(a, f)] == f[:, None]).any(1)

    def _put(self, bucket: np.ndarray, prints: np.ndarray) -> np.ndarray:
        """Put prints into free slots of their buckets; True where one found a slot."""
        order = np.argsort(bucket, kind="stable")
        b = bucket[order]
        first = np.ones(len(b), bool)
        first[1:] = b[1:] != b[:-1]
        turn = np.arange(len(b)) - np.maximum.accumulate(np.where(first, np.arange(len(b)), 0))
        free = self.table[b] == 0
        number = np.cumsum(free, 1)
        chosen = free & (number == turn[:, None] + 1)
        found = chosen.any(1)
        self.table[b[found], chosen[found].argmax(1)] = prints[order[found]]
        out = np.zeros(len(b), bool)
        out[order] = found
        return out

    def insert(self, keys: np.ndarray, rounds: int = 500) -> bool:
        f, at = self._prints(keys), self._first(keys)
        done = self._put(at, f)
        f, at = f[~done], self._other(at[~done], f[~done])
        for turn in range(rounds):
            if not len(f):
                return True
            done = self._put(at, f)
            f, at = f[~done], at[~done]
            # one newcomer per full bucket takes the place of an older print, which moves to its other bucket
            _, one = np.unique(at, return_index=True)
            rest = np.ones(len(f), bool)
            rest[one] = False
            slot = (mix(f[one].astype(np.uint64) + np.uint64(turn)) % np.uint64(_SLOTS)).astype(np.int64)
            evicted = self.table[at[one], slot].copy()
            self.table[at[one], slot] = f[one]
            f, at = np.concatenate([evicted, f[rest]]), np.concatenate([self._other(at[one], evicted), at[rest]])
        return not len(f)

    def delete(self, keys: np.ndarray) -> None:
        f, a = self._prints(keys), self._first(keys)
        for print_, one, two in zip(f, a, self._other(a, f)):
            for bucket in (one, two):
                hit = np.flatnonzero(self.table[bucket] == print_)
                if len(hit):
                    self.table[bucket, hit[0]] = 0
                    break
            else:
                raise KeyError("the key is not in the filter")

    def to_bytes(self) -> bytes:
        return _MAGIC + struct.pack("<Q", len(self.table)) + self.table.astype("<u2").tobytes()

    @classmethod
    def from_bytes(cls, data: bytes) -> CuckooFilter:
        if data[:8] != _MAGIC:
            raise ValueError("not a cuckoo filter")
        (buckets,) = struct.unpack_from("<Q", data, 8)
        out = cls(buckets)
        out.table = np.frombuffer(data, "<u2", buckets * _SLOTS, 16).reshape(buckets, _SLOTS).astype(np.uint16)
        return out
