"""Counting quotient filters that lose nothing: sorted counters of packed numbers.

A gram of up to four word ids (each of ``width`` bits, 0: none) is one number of 4 x width bits. A
Feistel network permutes these numbers invertibly, so that the permuted ones are spread
evenly. The leading bits of a permuted number, its quotient, are not stored: the filter keeps how
many entries each quotient has, then the remainders in order, in full, and their counts. Equal
quotient and remainder are equal grams; nothing is ever confused. Filters of one prefix of the
quotients are sorted alike, so any number of them merge into one by summing counts.
"""

from __future__ import annotations

import struct

import numpy as np
import zstandard

MAX_WIDTH = 31
_ROUNDS = (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93)  # any odd numbers
_HEAD = struct.Struct("<BBBQQQ")  # remainder bytes, quotient bits, bytes of an occupancy, entries, large counts, bytes of the packed part

Numbers = tuple[np.ndarray, np.ndarray]  # high and low 64 bits


def shift_right(x: Numbers, n: int) -> Numbers:
    hi, lo = x
    if n >= 64:
        return np.zeros_like(hi), hi >> np.uint64(n - 64)
    return (hi >> np.uint64(n), lo >> np.uint64(n) | hi << np.uint64(64 - n)) if n else x


def shift_left(x: Numbers, n: int) -> Numbers:
    hi, lo = x
    if n >= 64:
        return lo << np.uint64(n - 64), np.zeros_like(lo)
    return (hi << np.uint64(n) | lo >> np.uint64(64 - n), lo << np.uint64(n)) if n else x


def _scramble(x: np.ndarray, odd: int, half: int) -> np.ndarray:
    x = x * np.uint64(odd)
    return (x ^ x >> np.uint64(32)) & np.uint64((1 << half) - 1)


def pack(ids: list[np.ndarray], width: int) -> Numbers:
    """Permuted numbers of four columns of word ids."""
    a, b, c, d = (x.astype(np.uint64) for x in ids)
    w, half = np.uint64(width), 2 * width
    left, right = a << w | b, c << w | d
    for odd in _ROUNDS:
        left, right = right, left ^ _scramble(right, odd, half)
    hi, lo = shift_left((np.zeros_like(left), left), half)
    return hi, lo | right


def unpack(x: Numbers, width: int) -> list[np.ndarray]:
    """The word ids of permuted numbers."""
    w, half = np.uint64(width), 2 * width
    right, left = x[1] & np.uint64((1 << half) - 1), shift_right(x, half)[1]
    for odd in reversed(_ROUNDS):
        left, right = right ^ _scramble(left, odd, half), left
    mask = np.uint64((1 << width) - 1)
    return [y.astype(np.int64) for y in (left >> w, left & mask, right >> w, right & mask)]


def counted(x: Numbers, counts: np.ndarray | None = None) -> tuple[Numbers, np.ndarray]:
    """Sorted different numbers and the sum of the counts (default: 1) of each."""
    hi, lo = x
    if not len(lo):
        return x, np.zeros(0, np.int64)
    if counts is None and not hi.any():
        lo = np.sort(lo)
        new = np.flatnonzero(np.concatenate([[True], lo[1:] != lo[:-1]]))
        return (np.zeros(len(new), np.uint64), lo[new]), np.diff(np.append(new, len(lo)))
    order = np.argsort(lo, kind="stable") if not hi.any() else np.lexsort((lo, hi))
    hi, lo = hi[order], lo[order]
    new = np.flatnonzero(np.concatenate([[True], (lo[1:] != lo[:-1]) | (hi[1:] != hi[:-1])]))
    sums = np.diff(np.append(new, len(lo))) if counts is None else np.add.reduceat(counts[order], new)
    return (hi[new], lo[new]), sums


def split(x: Numbers, counts: np.ndarray, bits: int, prefix_bits: int) -> list[tuple[int, bytes]]:
    """(prefix, filter) of each prefix of sorted numbers of ``bits`` bits that has entries."""
    prefix = shift_right(x, bits - prefix_bits)[1]
    cuts = [0, *(np.flatnonzero(prefix[1:] != prefix[:-1]) + 1).tolist(), len(prefix)]
    return [(int(prefix[i]), encode((x[0][i:j], x[1][i:j]), counts[i:j], bits - prefix_bits)) for i, j in zip(cuts, cuts[1:]) if j > i]


def encode(x: Numbers, counts: np.ndarray, bits: int) -> bytes:
    """The filter of sorted different numbers; only their last ``bits`` bits are kept. It has
    no more quotients than entries."""
    m = len(counts)
    whole = -(-max(0, bits - max(0, m.bit_length() - 1)) // 8)  # bytes of a remainder
    quotients = max(0, bits - 8 * whole)
    if 8 * whole >= bits:
        quotient = np.zeros(m, np.int64)
    else:
        quotient = (shift_right(x, 8 * whole)[1] & np.uint64((1 << quotients) - 1)).astype(np.int64)
    filled = np.bincount(quotient, minlength=1 << quotients)
    size = next(s for s in (1, 2, 4, 8) if int(filled.max()) < 1 << 8 * s)
    rest = np.stack([x[1], x[0]], axis=1).astype("<u8").view(np.uint8).reshape(m, 16)[:, :whole]
    if 8 * whole > bits:  # no quotient, and no bits of the prefix either
        rest = rest.copy()
        rest[:, -1] &= (1 << bits % 8) - 1
    large = counts[counts >= 255]
    # occupancies and counts are small numbers, most of them 0 or 1, and packed; remainders are as good as random
    packed = zstandard.ZstdCompressor(level=1).compress(filled.astype(f"<u{size}").tobytes() + np.minimum(counts, 255).astype(np.uint8).tobytes())
    return b"".join([_HEAD.pack(whole, quotients, size, m, len(large), len(packed)), packed, rest.tobytes(), large.astype("<i8").tobytes()])


def decode(block: bytes, prefix: int, bits: int) -> tuple[Numbers, np.ndarray]:
    """The numbers of a filter, with the prefix above their last ``bits`` bits, and their counts."""
    whole, quotients, size, m, n_large, n_packed = _HEAD.unpack_from(block)
    at = _HEAD.size + n_packed
    small = zstandard.ZstdDecompressor().decompress(block[_HEAD.size:at])
    filled = np.frombuffer(small, f"<u{size}", 1 << quotients)
    rest = np.zeros((m, 16), np.uint8)
    rest[:, :whole] = np.frombuffer(block, np.uint8, m * whole, at).reshape(m, whole)
    counts = np.frombuffer(small, np.uint8, m, size << quotients).astype(np.int64)
    counts[counts == 255] = np.frombuffer(block, "<i8", n_large, at + m * whole)
    low = rest.reshape(-1).view("<u8").reshape(m, 2)
    quotient = np.repeat(np.arange(1 << quotients, dtype=np.uint64), filled.astype(np.int64))
    q = shift_left((np.zeros_like(quotient), quotient), min(8 * whole, 127))
    p = shift_left((np.zeros(1, np.uint64), np.array([prefix], np.uint64)), bits)
    return (low[:, 1] | q[0] | p[0], low[:, 0] | q[1] | p[1]), counts
