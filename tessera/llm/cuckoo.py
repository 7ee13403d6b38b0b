"""A cuckoo filter in numpy: 16-bit fingerprints, four slots a bucket, with deletion.

Keys are pairs of 64-bit hashes: the first picks the bucket, the second the fingerprint.
"""

from __future__ import annotations

import numpy as np

SLOTS, FILL, ROUNDS = 4, 0.8, 400


class Cuckoo:
    def __init__(self, slots: np.ndarray):
        self.slots = slots

    @classmethod
    def sized(cls, n: int) -> Cuckoo:
        buckets = 1 << max(3, int(np.ceil(np.log2(max(n, 1) / (SLOTS * FILL)))))
        return cls(np.zeros((buckets, SLOTS), np.uint16))

    @classmethod
    def read(cls, data: bytes) -> Cuckoo:
        return cls(np.frombuffer(data, np.uint16).reshape(-1, SLOTS).copy())

    def write(self) -> bytes:
        return self.slots.tobytes()

    def _place(self, h1, h2):
        mask = np.uint64(len(self.slots) - 1)
        print_ = (np.asarray(h2, np.int64).view(np.uint64) >> np.uint64(48)).astype(np.uint16)
        print_[print_ == 0] = 1
        return print_, (np.asarray(h1, np.int64).view(np.uint64) & mask).astype(np.int64)

    def _other(self, bucket, print_):
        spread = (print_.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(20)
        return bucket ^ (spread & np.uint64(len(self.slots) - 1)).astype(np.int64)

    def contains(self, h1, h2) -> np.ndarray:
        print_, a = self._place(h1, h2)
        b = self._other(a, print_)
        return (self.slots[a] == print_[:, None]).any(1) | (self.slots[b] == print_[:, None]).any(1)

    def insert(self, h1, h2) -> bool:
        """Add distinct keys; False if they don't fit, which leaves the filter unusable."""
        print_, bucket = self._place(h1, h2)
        turn = np.random.default_rng(len(print_))
        for step in range(ROUNDS):
            if not len(print_):
                return True
            order = np.argsort(bucket, kind="stable")
            print_, bucket = print_[order], bucket[order]
            first = np.searchsorted(bucket, bucket)
            rank = np.arange(len(bucket)) - first
            empty = self.slots[bucket] == 0
            fits = rank < empty.sum(1)
            if fits.any():
                where = np.argsort(~empty[fits], axis=1, kind="stable")[np.arange(fits.sum()), rank[fits]]
                self.slots[bucket[fits], where] = print_[fits]
            print_, bucket, rank = print_[~fits], bucket[~fits], rank[~fits]
            if step:  # one of each bucket takes another's slot, which moves on
                swap = np.unique(bucket, return_index=True)[1]
                slot = turn.integers(0, SLOTS, len(swap))
                moved = self.slots[bucket[swap], slot]
                self.slots[bucket[swap], slot] = print_[swap]
                print_[swap] = moved
            bucket = self._other(bucket, print_)
        return not len(print_)

    def delete(self, h1, h2) -> None:
        """Remove keys that were inserted, one copy for each."""
        print_, a = self._place(h1, h2)
        for p, i in zip(print_, a, strict=True):
            for bucket in (i, self._other(np.array([i]), np.array([p], np.uint16))[0]):
                (found,) = np.nonzero(self.slots[bucket] == p)
                if len(found):
                    self.slots[bucket, found[0]] = 0
                    break


def built(h1: np.ndarray, h2: np.ndarray) -> Cuckoo:
    """A filter of these keys, doubled until they fit."""
    n = len(h1)
    while True:
        out = Cuckoo.sized(n)
        if out.insert(h1, h2):
            return out
        n = 2 * max(n, 8)
