"""Counting quotient filters over packed word-id n-grams: lossless, since the whole permuted key is kept.

An n-gram of word ids is packed into an integer of 3 * width bits and permuted by an invertible Feistel network, so that
keys spread evenly. The upper bits of the permuted key name the shard, the next the quotient, the rest is the remainder.
A filter stores one bit a quotient (occupied), one bit a slot (end of a run), the remainders in whole bytes and the counts.
"""

from __future__ import annotations

import struct
from collections.abc import Iterable

import numpy as np

U = np.uint64
ROUND_KEYS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5)
HEAD = struct.Struct("<IBBI")


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(33))) * U(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> U(29))) * U(0xC4CEB9FE1A85EC53)
    return x ^ (x >> U(32))


class Packing:
    """Packs three ids of at most `width` bits (0: none) and permutes them; width is even and at most 40.

    A key is (hi, lo): lo has its lower 64 bits, hi the rest, None if there is no rest.
    """

    def __init__(self, greatest: int) -> None:
        self.width = max(2, (int(greatest).bit_length() + 1) // 2 * 2)
        if self.width > 40:
            raise ValueError("more than 2^40 words")
        self.half = 3 * self.width // 2
        self.bits = 2 * self.half
        self.mask = U((1 << self.half) - 1)

    def key(self, a: np.ndarray, b: np.ndarray, c: np.ndarray) -> tuple[np.ndarray | None, np.ndarray]:
        a, b, c = (x.astype(U) for x in (a, b, c))
        part = self.width // 2
        left = (a << U(part)) | (b >> U(part))
        right = ((b & U((1 << part) - 1)) << U(self.width)) | c
        for k in ROUND_KEYS:
            left, right = right, left ^ (mix(right + U(k)) & self.mask)
        if self.bits <= 64:
            return None, (left << U(self.half)) | right
        return left >> U(64 - self.half), (left << U(self.half)) | right

    def ids(self, hi: np.ndarray | None, lo: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        right = lo & self.mask
        left = lo >> U(self.half) if hi is None else (hi << U(64 - self.half)) | (lo >> U(self.half))
        for k in reversed(ROUND_KEYS):
            left, right = right ^ (mix(left + U(k)) & self.mask), left
        part = self.width // 2
        low = U((1 << self.width) - 1)
        b = ((left & U((1 << part) - 1)) << U(part)) | (right >> U(self.width))
        return (left >> U(part)).astype(np.int64), b.astype(np.int64), (right & low).astype(np.int64)

    def upper(self, hi: np.ndarray | None, lo: np.ndarray, least: int) -> np.ndarray:
        """The key's bits from `least` on."""
        if least >= 64:
            return np.zeros(len(lo), U) if hi is None else hi >> U(least - 64)
        if hi is None or least == 0:
            return lo >> U(least)
        return (hi << U(64 - least)) | (lo >> U(least))


Counts = tuple[np.ndarray | None, np.ndarray, np.ndarray]  # hi, lo, count: sorted by key, each key once


def counted(hi: np.ndarray | None, lo: np.ndarray, count: np.ndarray | None = None) -> Counts:
    """Sorted distinct keys with the sums of their counts."""
    if hi is None and count is None:
        lo = np.sort(lo)
    else:
        order = np.argsort(lo, kind="stable") if hi is None else np.lexsort((lo, hi))
        lo, hi = lo[order], None if hi is None else hi[order]
        count = None if count is None else count[order]
    if not len(lo):
        return hi, lo, np.zeros(0, np.int64)
    new = np.r_[True, lo[1:] != lo[:-1]] if hi is None else np.r_[True, (lo[1:] != lo[:-1]) | (hi[1:] != hi[:-1])]
    first = np.flatnonzero(new)
    sums = np.diff(np.r_[first, len(lo)]) if count is None else np.add.reduceat(count, first)
    return None if hi is None else hi[first], lo[first], sums.astype(np.int64)


def joined(parts: list[Counts]) -> Counts:
    """One sorted list of several: what merging filters of one shard comes to."""
    if len(parts) == 1:
        return parts[0]
    hi = None if parts[0][0] is None else np.concatenate([p[0] for p in parts])
    return counted(hi, np.concatenate([p[1] for p in parts]), np.concatenate([p[2] for p in parts]))


def low_bytes(x: np.ndarray, bits: int) -> bytes:
    """The lower bits of each number, in whole bytes."""
    x = x & U((1 << bits) - 1) if bits < 64 else x
    return np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(len(x), 8)[:, : (bits + 7) // 8]).tobytes()


def to_filter(packing: Packing, part: Counts, shard_bits: int) -> bytes:
    """The filter of sorted counts that share their shard's bits. Its quotient has about as many values as there are entries."""
    hi, lo, count = part
    n, free = len(lo), packing.bits - shard_bits
    q = min(free, max(n.bit_length() - 1, 1))
    r = free - q
    quotient = packing.upper(hi, lo, r) & U((1 << q) - 1)
    occupied = np.zeros(1 << q, np.uint8)
    occupied[quotient] = 1
    ends = np.r_[quotient[1:] != quotient[:-1], True].astype(np.uint8)
    remainder = low_bytes(lo, min(r, 64)) + (low_bytes(hi, r - 64) if r > 64 else b"")
    small = np.minimum(count, 255).astype(np.uint8)
    more = count[count >= 255].astype("<i8")
    return HEAD.pack(n, q, r, len(more)) + np.packbits(occupied).tobytes() + np.packbits(ends).tobytes() + remainder + small.tobytes() + more.tobytes()


def from_filter(packing: Packing, data: bytes, shard: int, shard_bits: int) -> Counts:
    n, q, r, m = HEAD.unpack_from(data)
    at = HEAD.size

    def take(size: int) -> np.ndarray:
        nonlocal at
        at += size
        return np.frombuffer(data, np.uint8, size, at - size)

    def numbers(bits: int) -> np.ndarray:
        out = np.zeros((n, 8), np.uint8)
        out[:, : (bits + 7) // 8] = take(n * ((bits + 7) // 8)).reshape(n, -1)
        return out.view("<u8").reshape(n)

    occupied = np.flatnonzero(np.unpackbits(take(((1 << q) + 7) // 8)))
    ends = np.flatnonzero(np.unpackbits(take((n + 7) // 8), count=n))
    quotient = np.repeat(occupied, np.diff(np.r_[-1, ends])).astype(U)
    lo, rest = numbers(min(r, 64)), numbers(r - 64) if r > 64 else None
    count = take(n).astype(np.int64)
    count[count == 255] = take(8 * m).view("<i8")
    upper = quotient | (U(shard) << U(q))  # the bits from r on
    if r < 64:
        lo = lo | (upper << U(r))
    if packing.bits <= 64:
        return None, lo, count
    return (upper >> U(64 - r) if r < 64 else (upper << U(r - 64)) | (0 if rest is None else rest)), lo, count


def by_shard(packing: Packing, part: Counts, shard_bits: int) -> Iterable[tuple[int, bytes]]:
    """(shard, filter) of each shard that has entries."""
    hi, lo, count = part
    if not len(lo):
        return
    shard = packing.upper(hi, lo, packing.bits - shard_bits)
    first = np.flatnonzero(np.r_[True, shard[1:] != shard[:-1]])
    for i, j in zip(first, np.r_[first[1:], len(lo)], strict=True):
        yield int(shard[i]), to_filter(packing, (None if hi is None else hi[i:j], lo[i:j], count[i:j]), shard_bits)
