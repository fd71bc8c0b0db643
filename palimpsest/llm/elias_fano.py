"""Elias-Fano encoding of a non-decreasing sequence, with sampled select structures."""

from __future__ import annotations

import struct

import numpy as np

#: One sample of the high part's one-bits for so many values.
SAMPLE = 256
_HEAD = struct.Struct("<QQBI")  # number of values, base, bits of the low part, bytes of the high part


class EliasFano:
    """Values x[0] <= x[1] <= ... less a base: low bits packed, high bits in unary.

    About 2 + log2(range / count) bits a value. `select(i)` needs one sample (32 bits for 256
    values) and a short scan of the unary part, no table of offsets.
    """

    def __init__(self, n: int, base: int, low_bits: int, low: np.ndarray, high: np.ndarray, samples: np.ndarray):
        self.n, self.base, self.low_bits, self.low, self.high, self.samples = n, base, low_bits, low, high, samples

    @classmethod
    def build(cls, values: np.ndarray) -> EliasFano:
        values = np.asarray(values, np.int64)
        n = len(values)
        base = int(values[0]) if n else 0
        # Ids may span the whole signed range; the differences fit unsigned 64 bits.
        x = values.astype(np.uint64) - np.uint64(base & 0xFFFFFFFFFFFFFFFF)
        if (values[1:] < values[:-1]).any():
            raise ValueError("the values must not decrease")
        top = int(x[-1]) if n else 0
        low_bits = max(0, (top // max(n, 1)).bit_length() - 1)
        low = (x & np.uint64((1 << low_bits) - 1)) if low_bits else x[:0]
        bits = ((low[:, None] >> np.arange(low_bits, dtype=np.uint64)) & np.uint64(1)).astype(np.uint8) if low_bits else np.zeros((0, 0), np.uint8)
        at = (x >> np.uint64(low_bits)).astype(np.int64) + np.arange(n)
        unary = np.zeros(int(at[-1]) + 1 if n else 0, np.uint8)
        unary[at] = 1
        pack = lambda b: np.packbits(b.ravel(), bitorder="little")
        return cls(n, base, low_bits, pack(bits), pack(unary), at[::SAMPLE].astype("<u4"))

    def to_bytes(self) -> bytes:
        head = _HEAD.pack(self.n, self.base & 0xFFFFFFFFFFFFFFFF, self.low_bits, len(self.high))
        return head + self.samples.tobytes() + self.high.tobytes() + self.low.tobytes()

    @classmethod
    def from_bytes(cls, data: bytes | memoryview) -> EliasFano:
        n, base, low_bits, n_high = _HEAD.unpack_from(data)
        at = _HEAD.size
        samples = np.frombuffer(data, "<u4", -(-n // SAMPLE), at)
        at += samples.nbytes
        high = np.frombuffer(data, np.uint8, n_high, at)
        low = np.frombuffer(data, np.uint8, -(-n * low_bits // 8), at + n_high)
        return cls(n, base - (1 << 64) if base >> 63 else base, low_bits, low, high, samples)

    def _low_of(self, i: int) -> int:
        first, bits = divmod(i * self.low_bits, 8)
        last = -(-(i + 1) * self.low_bits // 8)
        return int.from_bytes(self.low[first:last].tobytes(), "little") >> bits & ((1 << self.low_bits) - 1)

    def select(self, i: int) -> int:
        """Value i, without decoding the others."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        start, left = int(self.samples[i // SAMPLE]), i % SAMPLE
        byte, skip = divmod(start, 8)
        # The next `left` one-bits after the sample lie close by: read on in steps.
        step = 64
        while True:
            bits = np.unpackbits(self.high[byte : byte + step], bitorder="little")
            ones = np.nonzero(bits[skip:])[0]
            if len(ones) > left:
                position = byte * 8 + skip + int(ones[left])
                return self.base + ((position - i) << self.low_bits | (self._low_of(i) if self.low_bits else 0))
            step *= 4

    def values(self) -> np.ndarray:
        """All values at once."""
        at = np.nonzero(np.unpackbits(self.high, bitorder="little"))[0][: self.n]
        x = (at - np.arange(self.n)).astype(np.uint64) << np.uint64(self.low_bits)
        if self.low_bits:
            bits = np.unpackbits(self.low, bitorder="little", count=self.n * self.low_bits).reshape(self.n, self.low_bits)
            for k in range(self.low_bits):
                x |= bits[:, k].astype(np.uint64) << np.uint64(k)
        return (x + np.uint64(self.base & 0xFFFFFFFFFFFFFFFF)).astype(np.int64)
