"""A hash map from 64-bit keys to small integers, looked up for whole NumPy arrays at once."""

from __future__ import annotations

import numpy as np

_MIX = np.uint64(0x9E3779B97F4A7C15)


class U64Map:
    """Open addressing with linear probing at a load of a half or less; missing keys give `default`.

    The key 2**64 - 1 marks free slots and can't be stored."""

    FREE = np.uint64(0xFFFFFFFFFFFFFFFF)

    def __init__(self, keys: np.ndarray, values: np.ndarray, default: int = -1, room: int = 0):
        bits = max(4, int(max(room, 4 * max(1, len(keys))) - 1).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys = np.full(1 << bits, self.FREE, np.uint64)
        self.values = np.full(1 << bits, default, np.int32)
        self.default = default
        self.n = 0
        self.add(keys, values)

    def add(self, keys: np.ndarray, values: np.ndarray) -> None:
        """Adds keys that aren't there; none may come twice. There are slots for twice the keys at least."""
        keys = np.ascontiguousarray(keys, np.uint64)
        self.n += len(keys)
        if 2 * self.n > len(self.keys):
            old = self.keys != self.FREE
            self.__init__(self.keys[old], self.values[old], self.default, 4 * self.n)
            self.n += len(keys)
        slot, todo = self._home(keys), np.arange(len(keys))
        while len(todo):
            free = self.keys[slot] == self.FREE
            at, first = np.unique(slot[free], return_index=True)
            won = todo[free][first]
            self.keys[at], self.values[at] = keys[won], values[won]
            lost = self.keys[slot] != keys[todo]
            todo, slot = todo[lost], (slot[lost] + 1) & self.mask

    def _home(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * _MIX) >> self.shift).astype(np.int64)

    def get(self, keys: np.ndarray) -> np.ndarray:
        shape, keys = keys.shape, keys.ravel()
        slot = self._home(keys)
        found = self.keys[slot]
        out = self.values[slot]
        off = np.flatnonzero((found != keys) & (found != self.FREE))
        out[found != keys] = self.default
        at = slot[off]
        while len(off):
            at = (at + 1) & self.mask
            found = self.keys[at]
            hit = found == keys[off]
            out[off[hit]] = self.values[at[hit]]
            go = ~hit & (found != self.FREE)
            off, at = off[go], at[go]
        return out.reshape(shape)
