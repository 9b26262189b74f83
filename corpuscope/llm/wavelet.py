"""Wavelet matrix over unsigned integers: bit-planes with rank directories, in NumPy.

Bit-plane l holds bit l (from the top) of every symbol in the order that stable partitions by the planes above left.
A plane is a bit array in 64-bit words with a directory of two levels: the ones before each block of BLOCK bits (kept in
the file) and, made when first asked for, the ones before each word within its block in 16 bits. Rank adds both and a
popcount; the directories take 5/16 of the plane's bits.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np

BLOCK = 512
_WORDS = BLOCK // 64
MAGIC = b"WVM1"


def _words(bits: np.ndarray) -> np.ndarray:
    """Bits (uint8, 0 or 1) as little-endian 64-bit words, padded to whole blocks and one block more."""
    n = (len(bits) // BLOCK + 1) * _WORDS
    out = np.zeros(n * 8, dtype=np.uint8)
    packed = np.packbits(bits, bitorder="little")
    out[: len(packed)] = packed
    return out.view(np.uint64)


def _directory(words: np.ndarray) -> np.ndarray:
    ones = np.bitwise_count(words).reshape(-1, _WORDS).sum(axis=1, dtype=np.int64)
    before = np.cumsum(ones) - ones
    return before.astype(np.uint32 if len(words) << 6 < 1 << 32 else np.int64)


class WaveletMatrix:
    """Access, rank and occurrence lookup over n symbols of `levels` bits; queries take arrays of positions."""

    def __init__(self, n: int, levels: int, planes: list[np.ndarray], zeros: list[int], blocks: list[np.ndarray] | None = None):
        self.n, self.levels, self.planes, self.zeros = n, levels, planes, zeros
        self._blocks = blocks
        self._inner: list[np.ndarray] | None = None

    @classmethod
    def build(cls, symbols: np.ndarray, levels: int) -> WaveletMatrix:
        a = np.ascontiguousarray(symbols, dtype=np.uint16 if levels <= 16 else np.uint32)
        planes, zeros = [], []
        for level in range(levels):
            bit = (a & np.asarray(1 << (levels - 1 - level), dtype=a.dtype)) != 0
            planes.append(_words(bit.view(np.uint8)))
            low = np.flatnonzero(~bit)
            zeros.append(len(low))
            a = np.concatenate((a.take(low), a.take(np.flatnonzero(bit))))
        return cls(len(symbols), levels, planes, zeros)

    # -- queries -------------------------------------------------------------------------------------------------

    @property
    def blocks(self) -> list[np.ndarray]:
        """Ones before each block, by plane."""
        if self._blocks is None:
            self._blocks = [_directory(w) for w in self.planes]
        return self._blocks

    @property
    def inner(self) -> list[np.ndarray]:
        """Ones before each word within its block, by plane: blocks x words."""
        if self._inner is None:
            self._inner = []
            for w in self.planes:
                ones = np.bitwise_count(w).reshape(-1, _WORDS).astype(np.uint16)
                self._inner.append(np.cumsum(ones, axis=1, dtype=np.uint16) - ones)
        return self._inner

    def _rank1(self, level: int, i: np.ndarray) -> np.ndarray:
        w = i >> 6
        mask = (np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)
        return self.blocks[level][i // BLOCK] + self.inner[level].reshape(-1)[w] + np.bitwise_count(self.planes[level][w] & mask)

    def rank(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        """Occurrences of symbol[k] before position i[k]."""
        symbol = np.asarray(symbol, dtype=np.int64)
        hi = np.asarray(i, dtype=np.int64)
        lo = np.zeros_like(hi)
        for level in range(self.levels):
            bit = ((symbol >> (self.levels - 1 - level)) & 1).astype(bool)
            lo1, hi1 = self._rank1(level, lo), self._rank1(level, hi)
            lo = np.where(bit, self.zeros[level] + lo1, lo - lo1)
            hi = np.where(bit, self.zeros[level] + hi1, hi - hi1)
        return hi - lo

    def count(self, symbol: int) -> int:
        """Occurrences of a symbol in the whole sequence."""
        return int(self.rank(np.array([symbol]), np.array([self.n]))[0])

    def access(self, i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Symbols at positions i, and their ranks there (occurrences of the same symbol before i)."""
        i = np.asarray(i, dtype=np.int64)
        lo = np.zeros_like(i)
        symbol = np.zeros_like(i)
        for level in range(self.levels):
            bit = (self.planes[level][i >> 6] >> (i & 63).astype(np.uint64)) & np.uint64(1)
            one = bit.astype(bool)
            symbol = (symbol << 1) | bit.astype(np.int64)
            r, l1 = self._rank1(level, i), self._rank1(level, lo)
            i = np.where(one, self.zeros[level] + r, i - r)
            lo = np.where(one, self.zeros[level] + l1, lo - l1)
        return symbol, i - lo

    def select(self, symbol: int, k: np.ndarray) -> np.ndarray:
        """Position of the occurrence number k (from 0) of a symbol: occurrence lookup, bottom plane to top."""
        k = np.asarray(k, dtype=np.int64)
        bits = [(symbol >> (self.levels - 1 - level)) & 1 for level in range(self.levels)]
        start = 0
        for level, bit in enumerate(bits):
            r = int(self._rank1(level, np.array([start]))[0])
            start = self.zeros[level] + r if bit else start - r
        at = start + k
        for level in range(self.levels - 1, -1, -1):
            at = self._select_bit(level, bits[level], at - self.zeros[level] if bits[level] else at)
        return at

    def _select_bit(self, level: int, bit: int, k: np.ndarray) -> np.ndarray:
        ones, inner = self.blocks[level].astype(np.int64), self.inner[level]
        before = ones if bit else np.arange(len(ones), dtype=np.int64) * BLOCK - ones
        block = np.searchsorted(before, k, side="right") - 1
        left = k - before[block]
        within = inner[block].astype(np.int64)
        if not bit:
            within = np.arange(_WORDS, dtype=np.int64) * 64 - within
        place = (within <= left[:, None]).sum(axis=1) - 1
        left = left - np.take_along_axis(within, place[:, None], axis=1)[:, 0]
        w = block * _WORDS + place
        word = self.planes[level][w] if bit else ~self.planes[level][w]
        at = np.zeros_like(left)
        for step in (32, 16, 8, 4, 2, 1):
            low = word & np.uint64((1 << step) - 1)
            c = np.bitwise_count(low).astype(np.int64)
            up = left >= c
            left = np.where(up, left - c, left)
            at = np.where(up, at + step, at)
            word = np.where(up, word >> np.uint64(step), low)
        return w * 64 + at

    def decode(self) -> np.ndarray:
        """All symbols in order: the stable partitions undone from the bottom plane up."""
        kind = np.uint16 if self.levels <= 16 else np.uint32
        a = np.zeros(self.n, dtype=kind)
        for level in range(self.levels - 1, -1, -1):
            bit = np.unpackbits(self.planes[level].view(np.uint8), count=self.n, bitorder="little").view(bool)
            up = np.empty_like(a)
            z = self.zeros[level]
            up[np.flatnonzero(~bit)] = a[:z]
            up[np.flatnonzero(bit)] = a[z:] | np.asarray(1 << (self.levels - 1 - level), dtype=kind)
            a = up
        return a

    # -- file form -----------------------------------------------------------------------------------------------

    def to_bytes(self) -> bytes:
        """MAGIC, n, levels, then per plane: zeros, the rank directory (deflated differences), the words."""
        parts = [MAGIC, struct.pack("<QI", self.n, self.levels)]
        for words, blocks, z in zip(self.planes, self.blocks, self.zeros, strict=True):
            steps = zlib.compress(np.diff(blocks.astype(np.int64), prepend=0).astype("<u2").tobytes(), 1)
            body = words.astype("<u8").tobytes()
            parts += [struct.pack("<QII", z, len(steps), len(body)), steps, body]
        return b"".join(parts)

    @classmethod
    def from_bytes(cls, blob: bytes) -> WaveletMatrix:
        """Raises ValueError for another format or a directory that does not fit its plane."""
        if blob[:4] != MAGIC:
            raise ValueError("not a wavelet matrix file")
        n, levels = struct.unpack_from("<QI", blob, 4)
        at, planes, zeros, blocks = 16, [], [], []
        for _ in range(levels):
            z, n_steps, n_body = struct.unpack_from("<QII", blob, at)
            at += 16
            steps = np.cumsum(np.frombuffer(zlib.decompress(blob[at : at + n_steps]), dtype="<u2").astype(np.int64))
            words = np.frombuffer(blob, dtype="<u8", count=n_body // 8, offset=at + n_steps)
            if not np.array_equal(steps, _directory(words).astype(np.int64)) or n - z != int(np.bitwise_count(words).sum()):
                raise ValueError("rank directory and bit-plane differ")
            at += n_steps + n_body
            planes.append(words)
            zeros.append(z)
            blocks.append(steps.astype(np.uint32 if n < 1 << 32 else np.int64))
        return cls(n, levels, planes, zeros, blocks)
