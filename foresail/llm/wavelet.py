"""Wavelet matrix: a sequence of ids as succinct bit-planes with rank and select.

Plane k holds bit ``bits - 1 - k`` of every id, in the order left by sorting stably on the bits above:
zeros first, then ones. Access, rank and select walk the planes once, whatever the alphabet's size.
Every plane carries its running count of ones per 512 bits. ``to_bytes`` gives one image that also
holds a payload of the caller; each section is compressed."""

from __future__ import annotations

import struct

import numpy as np
import zstandard

_MAGIC = b"WMX1"
_BLOCK_WORDS = 8


class WaveletMatrix:
    def __init__(self, size: int, bits: int, planes: list[np.ndarray], zeros: list[int], super_ranks: list[np.ndarray]):
        self.size, self.bits, self.planes, self.zeros, self.super_ranks = size, bits, planes, zeros, super_ranks

    @classmethod
    def build(cls, ids: np.ndarray, bits: int = 16) -> WaveletMatrix:
        if len(ids) and (int(np.min(ids)) < 0 or int(np.max(ids)) >> bits):
            raise ValueError(f"an id does not fit {bits} bits")
        current = np.ascontiguousarray(ids, np.uint16 if bits <= 16 else np.uint32)
        planes, zeros, supers = [], [], []
        blocks = -(-len(current) // (64 * _BLOCK_WORDS))
        for k in range(bits - 1, -1, -1):
            ones = (current & current.dtype.type(1 << k)).astype(bool)
            words = np.zeros(blocks * _BLOCK_WORDS + 1, "<u8")
            packed = np.packbits(ones, bitorder="little")
            words.view(np.uint8)[:len(packed)] = packed
            one, zero = np.flatnonzero(ones), np.flatnonzero(~ones)
            after = np.empty_like(current)
            np.take(current, zero, out=after[:len(zero)])
            np.take(current, one, out=after[len(zero):])
            current = after
            planes.append(words)
            zeros.append(len(zero))
            supers.append(_super(words))
        return cls(len(ids), bits, planes, zeros, supers)

    def _rank1(self, plane: int, at: np.ndarray) -> np.ndarray:
        """Ones before each place (0 to size)."""
        words, word = self.planes[plane], at >> 6
        block = word // _BLOCK_WORDS
        out = self.super_ranks[plane][block].astype(np.int64)
        for k in range(_BLOCK_WORDS - 1):
            inside = block * _BLOCK_WORDS + k
            out += np.where(inside < word, np.bitwise_count(words[np.minimum(inside, len(words) - 1)]).astype(np.int64), 0)
        mask = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return out + np.bitwise_count(words[word] & mask).astype(np.int64)

    def _select(self, plane: int, bit: int, nth: np.ndarray) -> np.ndarray:
        """Place of the nth (from 0) zero or one of a plane."""
        words, ones = self.planes[plane], self.super_ranks[plane].astype(np.int64)
        before = ones if bit else np.arange(len(ones), dtype=np.int64) * 64 * _BLOCK_WORDS - ones
        block = np.searchsorted(before, nth, side="right") - 1
        rest = nth - before[block]
        place = np.minimum(block[:, None] * _BLOCK_WORDS + np.arange(_BLOCK_WORDS), len(words) - 1)
        flags = np.unpackbits(words[place].view(np.uint8), axis=1, bitorder="little")
        within = np.cumsum(flags == bit, axis=1, dtype=np.int32)
        return block * 64 * _BLOCK_WORDS + (within <= rest[:, None]).sum(axis=1)

    def access(self, at: np.ndarray) -> np.ndarray:
        """Ids at the given places."""
        at = np.asarray(at, np.int64).copy()
        out = np.zeros(len(at), np.int64)
        for k in range(self.bits):
            one = ((self.planes[k][at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1)).astype(bool)
            ones = self._rank1(k, at)
            out = (out << 1) | one
            at = np.where(one, self.zeros[k] + ones, at - ones)
        return out

    def _range(self, symbol: int, begin: int, end: int) -> tuple[int, int]:
        for k in range(self.bits):
            ones = self._rank1(k, np.array([begin, end], np.int64))
            if symbol >> (self.bits - 1 - k) & 1:
                begin, end = self.zeros[k] + int(ones[0]), self.zeros[k] + int(ones[1])
            else:
                begin, end = begin - int(ones[0]), end - int(ones[1])
        return begin, end

    def count(self, symbol: int, begin: int = 0, end: int | None = None) -> int:
        """How often an id occurs in [begin, end)."""
        if not 0 <= symbol < 1 << self.bits:
            return 0
        low, high = self._range(symbol, begin, self.size if end is None else end)
        return high - low

    def rank(self, symbol: int, end: int) -> int:
        return self.count(symbol, 0, end)

    def select(self, symbol: int, nth: np.ndarray) -> np.ndarray:
        """Places of the nth (from 0) occurrences of an id."""
        low, high = self._range(symbol, 0, self.size)
        at = low + np.asarray(nth, np.int64)
        if len(at) and (at.min() < low or at.max() >= high):
            raise IndexError("no such occurrence")
        for k in range(self.bits - 1, -1, -1):
            bit = symbol >> (self.bits - 1 - k) & 1
            at = self._select(k, bit, at - self.zeros[k] if bit else at)
        return at

    def occurrences(self, symbol: int) -> np.ndarray:
        """All places of an id, ascending."""
        return self.select(symbol, np.arange(self.count(symbol)))

    def values(self) -> np.ndarray:
        """The whole sequence, by undoing the stable sorts from the last plane up."""
        kind = np.uint16 if self.bits <= 16 else np.uint32
        current = np.zeros(self.size, kind)
        for k in range(self.bits - 1, -1, -1):
            ones = np.unpackbits(self.planes[k].view(np.uint8), count=self.size, bitorder="little").view(bool)
            out = np.empty(self.size, kind)
            out[np.flatnonzero(~ones)] = current[:self.zeros[k]]
            out[np.flatnonzero(ones)] = current[self.zeros[k]:] | kind(1 << (self.bits - 1 - k))
            current = out
        return current

    def to_bytes(self, payload: bytes = b"") -> bytes:
        """One image: header, payload, then for every plane its bits and its counts."""
        press = zstandard.ZstdCompressor(level=1).compress
        sections = [press(payload), press(np.array(self.zeros, "<u8").tobytes())]
        for words, ranks in zip(self.planes, self.super_ranks):
            sections += [press(words.tobytes()), press(ranks.tobytes())]
        return b"".join([_MAGIC, struct.pack("<QII", self.size, self.bits, len(sections)), np.array([len(s) for s in sections], "<u8").tobytes(), *sections])

    @classmethod
    def from_bytes(cls, image: bytes) -> tuple[WaveletMatrix, bytes]:
        """The matrix and the payload of an image; raises ValueError for anything else."""
        if image[:4] != _MAGIC:
            raise ValueError("not a wavelet matrix image")
        size, bits, n = struct.unpack_from("<QII", image, 4)
        lengths = np.frombuffer(image, "<u8", n, 20)
        at = 20 + 8 * n + np.concatenate([[0], np.cumsum(lengths)]).astype(int)
        if at[-1] != len(image):
            raise ValueError("cut image")
        press = zstandard.ZstdDecompressor()
        sections = [press.decompress(image[at[k]:at[k + 1]]) for k in range(n)]
        zeros = np.frombuffer(sections[1], "<u8").astype(int).tolist()
        planes = [np.frombuffer(s, "<u8") for s in sections[2::2]]
        return cls(size, bits, planes, zeros, [np.frombuffer(s, "<u4") for s in sections[3::2]]), sections[0]


def _super(words: np.ndarray) -> np.ndarray:
    """Ones before every block of 512 bits, and before the end."""
    whole = np.bitwise_count(words[:len(words) - 1]).astype(np.uint32).reshape(-1, _BLOCK_WORDS).sum(axis=1, dtype=np.uint32)
    return np.concatenate([[0], np.cumsum(whole, dtype=np.uint32)]).astype("<u4")
