"""Elias-Fano coding of a non-decreasing sequence, with select.

Each value is split: its low bits are packed side by side, its high part is
written in unary as the gaps of a bit vector (the i-th one stands at place
``high + i``).  A value is the low part plus the place of the i-th one less i;
the place is found from a sample of every ``SAMPLE``-th one, so an offset costs
the reading of a few words and no table of 64-bit offsets exists.  The space is
about ``2 + log2(universe / n)`` bits a value.
"""

from __future__ import annotations

import struct
from dataclasses import dataclass

import numpy as np

SAMPLE = 256
_HEAD = struct.Struct("<QQB")
_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little")
#: Place of the i-th one of each byte.
_SELECT = np.argsort(1 - _BITS, axis=1, kind="stable")


@dataclass
class EliasFano:
    n: int
    low_bits: int
    low: np.ndarray
    high: np.ndarray
    samples: np.ndarray

    @classmethod
    def of(cls, values: np.ndarray) -> EliasFano:
        """``values``: non-decreasing, not negative."""
        values = np.asarray(values, dtype=np.uint64)
        n = len(values)
        universe = int(values[-1]) + 1 if n else 1
        low_bits = max(0, (universe // max(n, 1)).bit_length() - 1)
        if low_bits:
            shifts = np.arange(low_bits, dtype=np.uint64)
            low = np.packbits(((values[:, None] >> shifts) & np.uint64(1)).astype(np.uint8).ravel(), bitorder="little")
        else:
            low = np.zeros(0, dtype=np.uint8)
        ones = (values >> np.uint64(low_bits)).astype(np.int64) + np.arange(n)
        bits = np.zeros(int(ones[-1]) + 1 if n else 0, dtype=np.uint8)
        bits[ones] = 1
        return cls(n, low_bits, low, np.packbits(bits, bitorder="little"), ones[::SAMPLE].astype(np.uint32))

    def to_bytes(self) -> bytes:
        return _HEAD.pack(self.n, len(self.high), self.low_bits) + self.samples.astype("<u4").tobytes() + self.high.tobytes() + self.low.tobytes()

    @classmethod
    def from_bytes(cls, raw: bytes) -> EliasFano:
        n, n_high, low_bits = _HEAD.unpack_from(raw)
        at = _HEAD.size
        n_samples = -(-n // SAMPLE)
        samples = np.frombuffer(raw, "<u4", n_samples, at)
        at += 4 * n_samples
        high = np.frombuffer(raw, np.uint8, n_high, at)
        at += n_high
        return cls(n, low_bits, np.frombuffer(raw, np.uint8, -1, at), high, samples)

    def _low(self, first: int, count: int) -> np.ndarray:
        if not self.low_bits:
            return np.zeros(count, dtype=np.uint64)
        lo, hi = first * self.low_bits, (first + count) * self.low_bits
        bits = np.unpackbits(self.low[lo // 8 : -(-hi // 8)], bitorder="little")[lo % 8 : lo % 8 + hi - lo]
        return bits.reshape(count, self.low_bits).astype(np.uint64) @ (np.uint64(1) << np.arange(self.low_bits, dtype=np.uint64))

    def select(self, i: int) -> int:
        """Place of the i-th one in the high bits, from the nearest sample before it."""
        place = int(self.samples[i // SAMPLE])
        left = i % SAMPLE
        byte = place // 8
        skip = place % 8
        step = 64
        while True:
            bits = np.unpackbits(self.high[byte : byte + step], bitorder="little")
            bits[:skip] = 0
            ones = np.flatnonzero(bits)
            if left < len(ones):
                return byte * 8 + int(ones[left])
            left -= len(ones)
            byte += step
            skip = 0

    def __getitem__(self, i: int) -> int:
        if not 0 <= i < self.n:
            raise IndexError(i)
        return ((self.select(i) - i) << self.low_bits) + int(self._low(i, 1)[0])

    def at(self, which: np.ndarray) -> np.ndarray:
        """The values asked for, by select: from counts of ones before each byte of the high bits, then within the byte."""
        which = np.asarray(which, dtype=np.int64)
        if not len(which):
            return np.zeros(0, dtype=np.int64)
        before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.high), dtype=np.uint32)])
        byte = np.searchsorted(before, which, side="right") - 1
        place = byte * 8 + _SELECT[self.high[byte], which - before[byte]]
        high = (place - which).astype(np.uint64) << np.uint64(self.low_bits)
        if not self.low_bits:
            return high.astype(np.int64)
        low = np.zeros(len(which), dtype=np.uint64)
        for k in range(self.low_bits):
            bit = which * self.low_bits + k
            low |= ((self.low[bit // 8] >> (bit % 8).astype(np.uint8)) & 1).astype(np.uint64) << np.uint64(k)
        return (high | low).astype(np.int64)

    def values(self) -> np.ndarray:
        """All values at once."""
        ones = np.flatnonzero(np.unpackbits(self.high, bitorder="little"))[: self.n]
        return (((ones - np.arange(self.n)).astype(np.uint64) << np.uint64(self.low_bits)) + self._low(0, self.n)).astype(np.int64)
