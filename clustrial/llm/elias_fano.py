"""Elias-Fano coding of non-decreasing whole numbers, with select."""

from __future__ import annotations

import struct

import numpy as np

SAMPLE = 256  # every so many values, the place of their high bit is kept
_HEAD = "<QQBQ"


class EliasFano:
    """Values v[0] <= v[1] <= ...: low bits packed, high parts in unary in a bit vector.

    About 2 + log2(largest / count) bits for each value. ``select`` reads one value and
    ``run`` some consecutive ones without decoding the others; ``values`` decodes all.
    """

    def __init__(self, count: int, low_bits: int, low: bytes, high: bytes, samples: np.ndarray):
        self.count, self.low_bits, self.samples = count, low_bits, samples
        self.low = np.frombuffer(low, np.uint8)
        self.high = np.frombuffer(high, np.uint8)

    @classmethod
    def encode(cls, values: np.ndarray) -> EliasFano:
        v = np.asarray(values, np.uint64)
        n = len(v)
        top = int(v[-1]) if n else 0
        low_bits = max(0, (top // n).bit_length() - 1) if n else 0
        shifts = np.arange(low_bits, dtype=np.uint64)
        low = np.packbits(
            ((v[:, None] >> shifts) & np.uint64(1)).astype(np.uint8).ravel(), bitorder="little"
        )
        places = (v >> np.uint64(low_bits)).astype(np.int64) + np.arange(n)
        bits = np.zeros(int(places[-1]) + 1 if n else 0, np.uint8)
        bits[places] = 1
        high = np.packbits(bits, bitorder="little")
        return cls(n, low_bits, low.tobytes(), high.tobytes(), places[::SAMPLE].astype("<u8"))

    def tobytes(self) -> bytes:
        head = struct.pack(_HEAD, self.count, len(self.high), self.low_bits, len(self.low))
        return head + self.low.tobytes() + self.high.tobytes() + self.samples.tobytes()

    @classmethod
    def frombytes(cls, data: bytes) -> EliasFano:
        count, high, low_bits, low = struct.unpack_from(_HEAD, data)
        at = struct.calcsize(_HEAD)
        samples = np.frombuffer(data, "<u8", -(-count // SAMPLE), at + low + high)
        return cls(count, low_bits, data[at : at + low], data[at + low : at + low + high], samples)

    def _low(self, i: int) -> int:
        first = i * self.low_bits
        last = first + self.low_bits
        word = int.from_bytes(self.low[first >> 3 : (last + 7) >> 3].tobytes(), "little")
        return (word >> (first & 7)) & ((1 << self.low_bits) - 1)

    def select(self, i: int) -> int:
        """The value at position ``i``, from the nearest kept place onward."""
        if not 0 <= i < self.count:
            raise IndexError(i)
        place = int(self.samples[i // SAMPLE])
        left = i % SAMPLE
        byte = place >> 3
        word = int(self.high[byte]) >> (place & 7) << (place & 7)
        while left >= word.bit_count():
            left -= word.bit_count()
            byte += 1
            word = int(self.high[byte])
        for _ in range(left):
            word &= word - 1
        place = (byte << 3) + (word & -word).bit_length() - 1
        return ((place - i) << self.low_bits) | self._low(i)

    def run(self, first: int, last: int) -> np.ndarray:
        """The values from position ``first`` up to ``last``, from the nearest kept place onward."""
        if not 0 <= first <= last <= self.count:
            raise IndexError((first, last))
        if first == last:
            return np.empty(0, np.uint64)
        byte = int(self.samples[first // SAMPLE]) >> 3
        following = (last - 1) // SAMPLE + 1
        end = (int(self.samples[following]) >> 3) + 1 if following < len(self.samples) else len(self.high)
        places = np.flatnonzero(np.unpackbits(self.high[byte:end], bitorder="little")) + (byte << 3)
        skip = int(np.searchsorted(places, self.samples[first // SAMPLE])) + first % SAMPLE
        places = places[skip : skip + last - first]
        high = (places - np.arange(first, last)).astype(np.uint64) << np.uint64(self.low_bits)
        start = first * self.low_bits
        packed = self.low[start >> 3 : (last * self.low_bits + 7) >> 3]
        bits = np.unpackbits(packed, bitorder="little")[start & 7 :][: (last - first) * self.low_bits]
        low = bits.reshape(last - first, self.low_bits).astype(np.uint64)
        return high | (low << np.arange(self.low_bits, dtype=np.uint64)).sum(axis=1, dtype=np.uint64)

    def values(self) -> np.ndarray:
        return self.run(0, self.count)
