"""Elias-Fano code of a non-decreasing sequence, with select by sampled positions.

A value's low bits are stored as they are; its high part is a one in a bit vector at (high part + index).
select(i) finds the i-th one: it starts at a sampled position and counts ones in the bytes that follow.
"""

from __future__ import annotations

import struct

import numpy as np

SAMPLE = 256
_HEAD = struct.Struct("<4sBQQQ")
_MAGIC = b"EFS1"
_ONES = np.array([bin(x).count("1") for x in range(256)], dtype=np.int64)


class EliasFano:
    def __init__(self, n: int, top: int, low_bits: int, low: np.ndarray, high: np.ndarray, samples: np.ndarray):
        self.n, self.top, self.low_bits, self.low, self.high, self.samples = n, top, low_bits, low, high, samples

    @classmethod
    def encode(cls, values: np.ndarray) -> EliasFano:
        values = np.asarray(values, dtype=np.int64)
        n = len(values)
        if n and (values[0] < 0 or (np.diff(values) < 0).any()):
            raise ValueError("values must be non-negative and not decrease")
        top = int(values[-1]) if n else 0
        low_bits = max(0, (top // max(n, 1)).bit_length() - 1)
        ones = (values >> low_bits) + np.arange(n)
        bits = np.zeros((int(ones[-1]) + 1) if n else 0, dtype=np.uint8)
        bits[ones] = 1
        lows = ((values[:, None] >> np.arange(low_bits)) & 1).astype(np.uint8)
        # 32 bits for a sample: a sample is below n + top / 2^low_bits, which is at most 3 n + 1
        return cls(n, top, low_bits, np.packbits(lows.ravel(), bitorder="little"), np.packbits(bits, bitorder="little"), ones[::SAMPLE].astype("<u4"))

    def to_bytes(self) -> bytes:
        return _HEAD.pack(_MAGIC, self.low_bits, self.n, self.top, len(self.high)) + self.samples.tobytes() + self.low.tobytes() + self.high.tobytes()

    @classmethod
    def from_bytes(cls, data: bytes) -> EliasFano:
        magic, low_bits, n, top, n_high = _HEAD.unpack_from(data)
        if magic != _MAGIC:
            raise ValueError("not an Elias-Fano block")
        at, n_samples, n_low = _HEAD.size, -(-n // SAMPLE), (n * low_bits + 7) // 8
        samples = np.frombuffer(data, "<u4", n_samples, at)
        low = np.frombuffer(data, np.uint8, n_low, at + 4 * n_samples)
        return cls(n, top, low_bits, low, np.frombuffer(data, np.uint8, n_high, at + 4 * n_samples + n_low), samples)

    def _low(self, i: int) -> int:
        value = 0
        for b in range(self.low_bits):
            bit = i * self.low_bits + b
            value |= ((int(self.low[bit >> 3]) >> (bit & 7)) & 1) << b
        return value

    def select(self, i: int) -> int:
        """The i-th value."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        start, left = int(self.samples[i // SAMPLE]), i % SAMPLE
        byte = start >> 3
        bits = int(self.high[byte]) & (0xFF << (start & 7)) & 0xFF
        while (ones := bits.bit_count()) <= left:
            left -= ones
            byte += 1
            bits = int(self.high[byte])
        for _ in range(left):
            bits &= bits - 1
        return ((8 * byte + (bits & -bits).bit_length() - 1 - i) << self.low_bits) | self._low(i)

    def select_range(self, a: int, b: int) -> np.ndarray:
        """Values a to b - 1, from the sample before a on."""
        if a >= b:
            return np.empty(0, np.int64)
        byte = int(self.samples[a // SAMPLE]) >> 3
        end = (int(self.samples[(b - 1) // SAMPLE + 1]) >> 3) + 1 if (b - 1) // SAMPLE + 1 < len(self.samples) else len(self.high)
        ones = np.flatnonzero(np.unpackbits(self.high[byte:end], bitorder="little")) + 8 * byte
        ones = ones[ones >= int(self.samples[a // SAMPLE])]
        first = a - a % SAMPLE
        high = ones[a - first : b - first] - np.arange(a, b)
        if not self.low_bits:
            return high
        bit = np.arange(a * self.low_bits, b * self.low_bits)
        lows = ((self.low[bit >> 3] >> (bit & 7).astype(np.uint8)) & 1).reshape(b - a, self.low_bits).astype(np.int64)
        return (high << self.low_bits) | (lows << np.arange(self.low_bits)).sum(axis=1)
