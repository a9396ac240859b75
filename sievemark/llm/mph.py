"""Minimal perfect hashing of 64-bit keys in numpy: levels of bit maps, ranks, and a fingerprint for each slot."""

from __future__ import annotations

import numpy as np

_GAMMA = 1.6
_LEVELS = 64
_MAGIC = 0x5348415244494458


def mix(keys: np.ndarray, seed: int) -> np.ndarray:
    """A 64-bit finalizer of keys and a seed."""
    with np.errstate(over="ignore"):
        x = keys.view(np.uint64) + np.uint64((seed * 0x9E3779B97F4A7C15) & (2**64 - 1))
        x ^= x >> np.uint64(30)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(27)
        x *= np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
        return x


def _prints(keys: np.ndarray) -> np.ndarray:
    return (mix(keys, 0) >> np.uint64(32)).astype(np.uint32)


class PerfectHash:
    """Maps n distinct keys to 0..n-1: a key's slot is the rank of the first level's bit that it has for itself."""

    def __init__(self, sizes: np.ndarray, bits: np.ndarray, before: np.ndarray):
        self.sizes, self.bits, self.before = sizes, bits, before
        self.starts = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)

    @classmethod
    def of(cls, keys: np.ndarray) -> PerfectHash:
        left, sizes, maps = np.unique(np.asarray(keys, np.int64)), [], []
        while len(left):
            if len(sizes) == _LEVELS:
                raise RuntimeError("keys can't be told apart")
            m = int(_GAMMA * len(left) + 64) // 64 * 64
            at = (mix(left, len(sizes) + 1) % np.uint64(m)).astype(np.int64)
            count = np.bincount(at, minlength=m)
            maps.append(count == 1)
            sizes.append(m)
            left = left[count[at] != 1]
        bits = np.packbits(np.concatenate(maps), bitorder="little").view(np.uint64) if maps else np.zeros(0, np.uint64)
        before = np.concatenate([[0], np.cumsum(np.bitwise_count(bits).astype(np.int64))])[:-1]
        return cls(np.array(sizes, np.int64), bits, before)

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """The slot of each key, -1 where no level takes it. Touches a word and a rank a level, whatever the size."""
        keys = np.ascontiguousarray(keys, np.int64)
        out, todo = np.full(len(keys), -1, np.int64), np.arange(len(keys))
        for level, m in enumerate(self.sizes.tolist()):
            at = (mix(keys[todo], level + 1) % np.uint64(m)).astype(np.int64) + self.starts[level]
            word, bit = self.bits[at >> 6], (at & 63).astype(np.uint64)
            here = (word >> bit) & np.uint64(1) == 1
            below = np.bitwise_count(word[here] & ((np.uint64(1) << bit[here]) - np.uint64(1)))
            out[todo[here]] = self.before[at[here] >> 6] + below
            todo = todo[~here]
            if not len(todo):
                break
        return out


class Index:
    """Key -> places of its documents in a shard whose documents lie in key order, those without a key first.

    Keys aren't stored. A slot has the key's 32-bit fingerprint, the place of its first document and how many follow;
    `ends` has the running number of ids by place. A key that the shard doesn't have passes for another with a
    probability of 2**-32; one that it has is always found.
    """

    def __init__(self, n_null: int, hashed: PerfectHash, prints: np.ndarray, first: np.ndarray, count: np.ndarray, ends: np.ndarray):
        self.n_null, self.hash, self.prints, self.first, self.count, self.ends = n_null, hashed, prints, first, count, ends

    @classmethod
    def of(cls, keys: np.ndarray, n_null: int, ends: np.ndarray) -> Index:
        """keys: of the documents that have one, in order."""
        unique, first, count = np.unique(np.asarray(keys, np.int64), return_index=True, return_counts=True)
        hashed = PerfectHash.of(unique)
        by = np.argsort(hashed.slots(unique))
        return cls(n_null, hashed, _prints(unique)[by], (first + n_null)[by].astype(np.uint32), count[by].astype(np.uint32), np.asarray(ends, np.int64))

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place of the first document, number of documents) of each key; (-1, 0) if there is none."""
        keys = np.ascontiguousarray(keys, np.int64)
        place, count = np.full(len(keys), -1, np.int64), np.zeros(len(keys), np.int64)
        slot = self.hash.slots(keys)
        ok = np.flatnonzero(slot >= 0)
        ok = ok[self.prints[slot[ok]] == _prints(keys[ok])]
        place[ok], count[ok] = self.first[slot[ok]], self.count[slot[ok]]
        return place, count

    def spans(self, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First id and end of the documents at these places."""
        before = np.where(places > 0, self.ends[np.maximum(places, 1) - 1], 0)
        return before, self.ends[places]

    def dump(self) -> bytes:
        """A header, then each part at a multiple of 8 bytes, so that a mapped file can be used in place."""
        head = np.array([_MAGIC, len(self.ends), self.n_null, len(self.prints), len(self.hash.sizes), len(self.hash.bits)], np.int64)
        parts = [head, self.hash.sizes, self.hash.bits, self.hash.before, self.ends, self.prints, self.first, self.count]
        return b"".join(p.tobytes() + b"\0" * (-p.nbytes % 8) for p in parts)

    @classmethod
    def view(cls, data) -> Index:
        """The index in a buffer (a mapped file's or bytes); nothing but the header is read before it is asked for."""
        magic, n_docs, n_null, n_slots, n_levels, n_words = np.frombuffer(data, np.int64, 6).tolist()
        if magic != _MAGIC:
            raise ValueError("not an index")
        at, parts = 48, []
        for kind, n in ((np.int64, n_levels), (np.uint64, n_words), (np.int64, n_words), (np.int64, n_docs), *((np.uint32, n_slots),) * 3):
            parts.append(np.frombuffer(data, kind, n, at))
            at += -(-parts[-1].nbytes // 8) * 8
        return cls(n_null, PerfectHash(*parts[:3]), parts[4], parts[5], parts[6], parts[3])
