"""Compressed bitmaps over the integers of one key range, as numpy arrays.

A bitmap holds offsets 0 .. width-1 of a range of consecutive keys. It is kept in the smaller of two
forms, chosen by cardinality: sorted 16-bit or 32-bit offsets (few bits set), or one bit per offset.
"""

from __future__ import annotations

import numpy as np


class Bitmap:
    """An immutable set of offsets below width."""

    __slots__ = ("width", "dense", "data")

    def __init__(self, width: int, dense: bool, data: np.ndarray):
        self.width, self.dense, self.data = width, dense, data

    @classmethod
    def of(cls, offsets: np.ndarray, width: int) -> Bitmap:
        """From offsets in any order, repeats allowed."""
        kind = np.uint16 if width <= 1 << 16 else np.uint32
        if len(offsets) * np.dtype(kind).itemsize * 8 < width:
            return cls(width, False, np.unique(offsets).astype(kind))
        bits = np.zeros(width, bool)
        bits[offsets] = True
        return cls(width, True, np.packbits(bits, bitorder="little"))

    def _packed(self) -> np.ndarray:
        if self.dense:
            return self.data
        bits = np.zeros(self.width, bool)
        bits[self.data] = True
        return np.packbits(bits, bitorder="little")

    def offsets(self) -> np.ndarray:
        """The offsets in ascending order."""
        if not self.dense:
            return self.data.astype(np.int64)
        return np.flatnonzero(np.unpackbits(self.data, count=self.width, bitorder="little"))

    def has(self, offsets: np.ndarray) -> np.ndarray:
        """Which of the offsets are set."""
        if self.dense:
            return (self.data[offsets >> 3] >> (offsets & 7).astype(np.uint8)) & 1 == 1
        return np.isin(offsets, self.data)

    def and_not(self, other: Bitmap) -> Bitmap:
        """The offsets of self that are not in other."""
        if not self.dense:
            mine = self.offsets()
            return Bitmap.of(mine[~other.has(mine)], self.width)
        return Bitmap(self.width, True, self.data & ~other._packed())

    def __or__(self, other: Bitmap) -> Bitmap:
        if not self.dense and not other.dense:
            return Bitmap.of(np.concatenate([self.offsets(), other.offsets()]), self.width)
        return Bitmap(self.width, True, self._packed() | other._packed())

    def __len__(self) -> int:
        return len(self.data) if not self.dense else int(np.bitwise_count(self.data).sum())
