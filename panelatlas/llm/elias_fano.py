"""Elias-Fano coding of monotone integer sequences, with select, as flat bytes that can be memory-mapped.

A value below ``universe`` is split into ``low`` bits, stored packed, and a high part, stored in unary: value i sets bit
``high(i) + i``. That takes about ``2 + log2(universe / n)`` bits a value. ``select`` samples hold the position of
every 256th set bit, so one value is found by looking at a few bytes behind its sample.

``get`` and ``find`` answer many questions at once in the packed form: a directory of the set and unset bits before each
64-bit word, stored behind the samples and mapped with them, gives select on ones and zeros, and only the low parts between
two zeros are compared. So what a reader holds besides the mapped bytes goes by its questions, not by the sequence.
"""

from __future__ import annotations

import struct

import numpy as np

_HEAD = struct.Struct("<4sBxxxQQQ")
_MAGIC = b"EFS3"
_STEP = 256
_MOST_LOW = 57  # so that a low part lies within eight bytes from its first


def _pack_low(values: np.ndarray, low: int) -> bytes:
    if low == 0:
        return b""
    n = len(values)
    out = bytearray()
    for at in range(0, n, 1 << 20):  # a multiple of 8 values, so chunks meet at whole bytes
        part = values[at : at + (1 << 20)]
        bits = np.unpackbits(part.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, count=low, bitorder="little")
        out += np.packbits(bits.reshape(-1), bitorder="little").tobytes()
    return bytes(out)


def _unpack_low(data: np.ndarray, n: int, low: int) -> np.ndarray:
    out = np.zeros(n, dtype=np.uint64)
    if low == 0:
        return out
    for at in range(0, n, 1 << 20):
        k = min(1 << 20, n - at)
        first = at * low // 8
        bits = np.unpackbits(data[first : first + (k * low + 7) // 8], count=k * low, bitorder="little").reshape(k, low)
        full = np.zeros((k, 64), dtype=np.uint8)
        full[:, :low] = bits
        out[at : at + k] = np.packbits(full, axis=1, bitorder="little").reshape(-1, 8).view("<u8").reshape(-1)
    return out


def encode(values: np.ndarray) -> bytes:
    """Encode a non-decreasing sequence of unsigned integers (any length, also none)."""
    v = np.asarray(values, dtype=np.uint64)
    n = len(v)
    if n and (v[1:] < v[:-1]).any():
        raise ValueError("Elias-Fano needs a non-decreasing sequence")
    universe = int(v[-1]) + 1 if n else 0
    low = min(_MOST_LOW, max(0, (universe // n).bit_length() - 1)) if n else 0
    high = (v >> np.uint64(low)).astype(np.int64)
    at = high + np.arange(n, dtype=np.int64)
    bits = int(at[-1]) + 1 if n else 0
    upper = np.zeros((bits + 63) // 64 * 8, dtype=np.uint8)
    np.bitwise_or.at(upper, at >> 3, (1 << (at & 7)).astype(np.uint8))
    samples = at[::_STEP].astype("<u8")
    lower = _pack_low(v, low)
    lower += bytes(-len(lower) % 8 + 8)  # eight bytes can be read from any low part on
    before = np.zeros(len(upper) // 8 + 1, dtype=np.int64)
    np.cumsum(np.bitwise_count(upper.view("<u8")), out=before[1:])
    width = _width(len(upper))
    directory = before.astype(width).tobytes() + (64 * np.arange(len(before)) - before).astype(width).tobytes()
    return _HEAD.pack(_MAGIC, low, n, len(upper), len(lower)) + upper.tobytes() + lower + samples.tobytes() + directory


def _width(n_upper: int) -> str:
    """Type of the directory's numbers; an array of 4 and one of 8 bytes' numbers are never mixed."""
    return "<u4" if 8 * n_upper < 1 << 32 else "<u8"


def _nth_bit(words: np.ndarray, k: np.ndarray) -> np.ndarray:
    """Place of the set bit number ``k`` (from 0) in each 64-bit word."""
    words, k, place = words.copy(), k.astype(np.int64), np.zeros(len(words), dtype=np.int64)
    for width in (32, 16, 8, 4, 2, 1):
        n = np.bitwise_count(words & np.uint64((1 << width) - 1))
        up = k >= n
        k -= np.where(up, n, 0)
        place += np.where(up, width, 0)
        words >>= np.where(up, np.uint64(width), np.uint64(0))
    return place


class EliasFano:
    """A view over encoded bytes (``bytes``, ``memoryview`` or ``numpy.memmap``)."""

    def __init__(self, data, start: int = 0):
        raw = np.frombuffer(data, dtype=np.uint8) if not isinstance(data, np.ndarray) else data
        magic, self.low, self.n, n_upper, n_lower = _HEAD.unpack(raw[start : start + _HEAD.size].tobytes())
        if magic != _MAGIC:
            raise ValueError("not an Elias-Fano block")
        at = start + _HEAD.size
        self.upper = raw[at : at + n_upper]
        self.lower = raw[at + n_upper : at + n_upper + n_lower]
        at += n_upper + n_lower
        n_samples = -(-self.n // _STEP)
        self.samples = raw[at : at + 8 * n_samples]
        at += 8 * n_samples
        self.words = self.upper.view("<u8")
        width, n = np.dtype(_width(n_upper)), n_upper // 8 + 1
        self.ones, self.zeros = raw[at : at + 2 * n * width.itemsize].view(width).reshape(2, n)  # set and unset bits before each word
        self.end = at + 2 * n * width.itemsize

    def __len__(self) -> int:
        return self.n

    def _low(self, i: int) -> int:
        if not self.low:
            return 0
        first = i * self.low
        chunk = self.lower[first >> 3 : (first + self.low + 7) >> 3].tobytes()
        return (int.from_bytes(chunk, "little") >> (first & 7)) & ((1 << self.low) - 1)

    def select(self, i: int) -> int:
        """Value number ``i``, without decoding the sequence."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        sample = i // _STEP
        at = int.from_bytes(self.samples[8 * sample : 8 * sample + 8].tobytes(), "little")
        left = i - sample * _STEP  # set bits still to pass behind the sampled one
        byte, skip = at >> 3, at & 7
        while True:
            chunk = self.upper[byte : byte + 64]
            bits = np.flatnonzero(np.unpackbits(chunk, bitorder="little"))
            bits = bits[bits >= skip]
            if left < len(bits):
                return ((byte * 8 + int(bits[left]) - i) << self.low) | self._low(i)
            left -= len(bits)
            byte, skip = byte + 64, 0

    def _lows(self, i: np.ndarray) -> np.ndarray:
        """Low parts of values by number."""
        if not self.low:
            return np.zeros(len(i), dtype=np.uint64)
        at = i * self.low
        eight = np.ndarray((len(self.lower) - 7,), dtype="<u8", buffer=self.lower, strides=(1,))
        return (eight[at >> 3] >> (at & 7).astype(np.uint64)) & np.uint64((1 << self.low) - 1)

    def get(self, i: np.ndarray) -> np.ndarray:
        """Values by number, without decoding the sequence."""
        i = np.asarray(i, dtype=np.int64)
        at = np.searchsorted(self.ones, i.astype(self.ones.dtype), side="right") - 1
        bit = 64 * at + _nth_bit(self.words[at], i - self.ones[at].astype(np.int64))
        return ((bit - i).astype(np.uint64) << np.uint64(self.low)) | self._lows(i)

    def _before(self, high: np.ndarray) -> np.ndarray:
        """How many values have a high part below ``high``."""
        out = np.zeros(len(high), dtype=np.int64)
        last = int(self.zeros[-1])
        out[high > last] = self.n
        ask = np.flatnonzero((high > 0) & (high <= last))
        z = high[ask] - 1
        at = np.searchsorted(self.zeros, z.astype(self.zeros.dtype), side="right") - 1
        out[ask] = 64 * at + _nth_bit(~self.words[at], z - self.zeros[at].astype(np.int64)) - z
        return np.minimum(out, self.n)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Number of the first value not below each key, where it equals the key, else -1. Only the values that share the
        key's high part are looked at, by halves; keys in ascending order touch memory in order."""
        keys = np.asarray(keys, dtype=np.uint64)
        out = np.full(len(keys), -1, dtype=np.int64)
        if not self.n or not len(keys):
            return out
        high = (keys >> np.uint64(self.low)).astype(np.int64)
        lo, hi = self._before(high), self._before(high + 1)
        want = keys & np.uint64((1 << self.low) - 1)
        ask = np.flatnonzero(lo < hi)
        a, b, w = lo[ask], hi[ask], want[ask]
        end = b.copy()
        on = np.arange(len(ask))
        while len(on):
            mid = (a[on] + b[on]) >> 1
            less = self._lows(mid) < w[on]
            a[on[less]] = mid[less] + 1
            b[on[~less]] = mid[~less]
            on = on[a[on] < b[on]]
        inside = np.flatnonzero(a < end)
        hit = inside[self._lows(a[inside]) == w[inside]]
        out[ask[hit]] = a[hit]
        return out

    def decode(self) -> np.ndarray:
        """All values; besides the result it needs a few MB."""
        out = np.empty(self.n, dtype=np.uint64)
        done = 0
        for at in range(0, len(self.upper), 1 << 16):
            ones = np.flatnonzero(np.unpackbits(self.upper[at : at + (1 << 16)], bitorder="little"))[: self.n - done]
            high = ones + (8 * at - done) - np.arange(len(ones))
            out[done : done + len(ones)] = high.astype(np.uint64) << np.uint64(self.low)
            done += len(ones)
        for at in range(0, self.n if self.low else 0, 1 << 16):
            k = min(1 << 16, self.n - at)
            first = at * self.low // 8
            out[at : at + k] |= _unpack_low(self.lower[first : first + (k * self.low + 7) // 8], k, self.low)
        return out
