"""A hash table of arrays: finds many 64-bit keys at once."""

from __future__ import annotations

import numpy as np

#: Spreads keys over the slots.
SPREAD = np.uint64(0x9E3779B97F4A7C15)


class Lookup:
    """Places of distinct 64-bit integers among `keys`. A quarter of the slots is used at most; a key is in the first free slot from its own on."""

    def __init__(self, keys: np.ndarray):
        self.keys = np.ascontiguousarray(keys, dtype=np.int64)
        self.slots = 1 << (max(4, 4 * len(keys)) - 1).bit_length()
        self.shift = np.uint64(64 - (self.slots.bit_length() - 1))
        self.place = np.full(self.slots, -1, dtype=np.int32)
        left = np.arange(len(keys))
        at = self._slot(self.keys)
        while len(left):
            free = np.flatnonzero(self.place[at] < 0)
            one = np.zeros(len(left), dtype=bool)
            one[free[np.unique(at[free], return_index=True)[1]]] = True  # of those that want a free slot, one gets it
            self.place[at[one]] = left[one]
            left, at = left[~one], (at[~one] + 1) & (self.slots - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.view(np.uint64) * SPREAD) >> self.shift).astype(np.int64)

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        """Where each key stands, -1 where it doesn't."""
        if not len(self.keys):
            return np.full(len(keys), -1, dtype=np.int64)
        at = self._slot(keys)
        found = self.place[at].astype(np.int64)
        todo = np.flatnonzero((found >= 0) & (self.keys[found] != keys))
        while len(todo):
            at[todo] = (at[todo] + 1) & (self.slots - 1)
            now = self.place[at[todo]]
            found[todo] = now
            todo = todo[(now >= 0) & (self.keys[now] != keys[todo])]
        return found
