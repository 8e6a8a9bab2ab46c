"""Elias-Fano coding of a non-decreasing sequence, with sampled select."""

from __future__ import annotations

import struct

import numpy as np

_HEAD = struct.Struct("<qqBxxxxxxxQQ")  # count, smallest value, low bits, bytes of the low part, bytes of the high part
#: One position of a set bit is stored for so many values.
SAMPLE = 512


def encode(values: np.ndarray) -> bytes:
    """values: int64, non-decreasing. About 2 + log2(range / count) bits a value, and 32 bits for each SAMPLE values."""
    n = len(values)
    least = int(values[0]) if n else 0
    up = (values.astype(np.int64) - least).astype(np.uint64)
    span = int(up[-1]) if n else 0
    low_bits = max(0, (span // n).bit_length() - 1) if n else 0
    shifts = np.arange(low_bits, dtype=np.uint64)
    low = np.packbits(((up[:, None] >> shifts) & np.uint64(1)).astype(np.uint8).ravel(), bitorder="little").tobytes()
    ones = (up >> np.uint64(low_bits)).astype(np.int64) + np.arange(n)
    bits = np.zeros(int(ones[-1]) + 1 if n else 0, np.uint8)
    bits[ones] = 1
    high = np.packbits(bits, bitorder="little").tobytes()
    return _HEAD.pack(n, least, low_bits, len(low), len(high)) + low + high + ones[::SAMPLE].astype("<u4").tobytes()


class EliasFano:
    """Reads what encode() wrote, without expanding it."""

    def __init__(self, data: bytes) -> None:
        self.n, self.least, self.low_bits, low, high = _HEAD.unpack_from(data)
        raw = np.frombuffer(data, np.uint8, offset=_HEAD.size)
        self.low, self.high = raw[:low], raw[low : low + high]
        self.samples = np.frombuffer(data, "<u4", offset=_HEAD.size + low + high)

    def __len__(self) -> int:
        return self.n

    def slice(self, start: int, stop: int) -> np.ndarray:
        """Values start to stop, int64; it looks only at the bits between the two samples around them."""
        stop = min(stop, self.n)
        if start >= stop:
            return np.zeros(0, np.int64)
        first, last = start // SAMPLE, (stop - 1) // SAMPLE + 1
        begin = int(self.samples[first])
        end = int(self.samples[last]) if last < len(self.samples) else len(self.high) * 8
        found = np.flatnonzero(np.unpackbits(self.high[begin // 8 : -(-end // 8)], bitorder="little")[begin % 8 :]) + begin
        ones = found[start - first * SAMPLE : stop - first * SAMPLE].astype(np.int64)
        up = (ones - np.arange(start, stop)) << self.low_bits
        if self.low_bits:
            b, e = start * self.low_bits, stop * self.low_bits
            bits = np.unpackbits(self.low[b // 8 : -(-e // 8)], bitorder="little")[b % 8 : b % 8 + e - b].reshape(-1, self.low_bits)
            up |= bits.astype(np.int64) @ (np.int64(1) << np.arange(self.low_bits, dtype=np.int64))
        return up + self.least

    def __getitem__(self, i: int) -> int:
        return int(self.slice(i, i + 1)[0])
