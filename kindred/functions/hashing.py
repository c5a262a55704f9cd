"""Feature hashes, permutations and signature kernels, as columns and as NumPy over Arrow lists."""

from __future__ import annotations

from collections.abc import Iterable
from functools import lru_cache
from hashlib import sha1

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import ConfigurationError

# The seed stream's increment and multipliers, and the Murmur3 finalisers' multipliers.
STREAM = (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB)
FMIX32 = (0x85EBCA6B, 0xC2B2AE35)
FMIX64 = (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53)
FNV_BASIS, FNV_PRIME = 0xCBF29CE484222325, 0x100000001B3

M32, M64 = (1 << 32) - 1, (1 << 64) - 1


@lru_cache(maxsize=64)
def permutations(num_perm: int, seed: int, width: int = 32) -> tuple[tuple[int, ...], tuple[int, ...]]:
    """(odd multipliers, offsets) of the affine permutations, all multipliers being drawn first."""
    if isinstance(num_perm, bool) or num_perm < 1 or width not in (32, 64):
        raise ConfigurationError("num_perm must be positive and width 32 or 64")
    state, drawn = seed & M64, []
    for _ in range(2 * num_perm):
        state = (state + STREAM[0]) & M64
        z = ((state ^ (state >> 30)) * STREAM[1]) & M64
        z = ((z ^ (z >> 27)) * STREAM[2]) & M64
        drawn.append((z ^ (z >> 31)) & (M32 if width == 32 else M64))
    return tuple(x | 1 for x in drawn[:num_perm]), tuple(drawn[num_perm:])


# --- columns ---------------------------------------------------------------------------------------------------------


def _little_endian(col: Column, n: int) -> Column:
    digest = F.sha1(col)
    return F.concat(*[F.substring(digest, 2 * i + 1, 2) for i in reversed(range(n))])


def sha1_hash32(col: Column) -> Column:
    """First four SHA-1 bytes, little-endian, as BIGINT."""
    return F.conv(_little_endian(col, 4), 16, 10).cast("bigint")


def sha1_hash64(col: Column) -> Column:
    """First eight SHA-1 bytes, little-endian, as DECIMAL(20,0)."""
    return F.conv(_little_endian(col, 8), 16, 10).cast("decimal(20,0)")


def times32(a: Column | int, h: Column) -> Column:
    """a * h modulo 2**32 without a 64-bit overflow: a is taken in two halves."""
    a = F.lit(a).cast("bigint") if isinstance(a, int) else a
    high = F.shiftright(a, 16) * h
    return (high.bitwiseAND(F.lit(65535)) * 65536 + a.bitwiseAND(F.lit(65535)) * h).bitwiseAND(F.lit(M32))


def fmix32(h: Column) -> Column:
    h = times32(FMIX32[0], h.bitwiseXOR(F.shiftright(h, 16)))
    h = times32(FMIX32[1], h.bitwiseXOR(F.shiftright(h, 13)))
    return h.bitwiseXOR(F.shiftright(h, 16))


def affine32(h: Column, a: int, b: int) -> Column:
    return (times32(a, h) + F.lit(b)).bitwiseAND(F.lit(M32))


def times64(a: Column | int, h: Column) -> Column:
    """a * h modulo 2**64 on BIGINTs that hold the bits; Spark's product may not overflow, so it is made of 16-bit parts."""
    a = F.lit(a - (1 << 64) if isinstance(a, int) and a >= 1 << 63 else a).cast("bigint") if isinstance(a, int) else a
    part = lambda x, i: F.shiftrightunsigned(x, 16 * i).bitwiseAND(F.lit(0xFFFF))
    low = part(a, 0) * part(h, 0)
    c1 = F.shiftrightunsigned(low, 16) + part(a, 0) * part(h, 1) + part(a, 1) * part(h, 0)
    c2 = F.shiftrightunsigned(c1, 16) + part(a, 0) * part(h, 2) + part(a, 1) * part(h, 1) + part(a, 2) * part(h, 0)
    c3 = F.shiftrightunsigned(c2, 16) + part(a, 0) * part(h, 3) + part(a, 1) * part(h, 2) + part(a, 2) * part(h, 1) + part(a, 3) * part(h, 0)
    word = lambda x: x.bitwiseAND(F.lit(0xFFFF))
    return F.shiftleft(word(c3), 48).bitwiseOR(F.shiftleft(word(c2), 32)).bitwiseOR(F.shiftleft(word(c1), 16)).bitwiseOR(word(low))


def fmix64(h: Column) -> Column:
    """The 64-bit finaliser on the bits of a BIGINT."""
    for factor in FMIX64:
        h = times64(factor, h.bitwiseXOR(F.shiftrightunsigned(h, 33)))
    return h.bitwiseXOR(F.shiftrightunsigned(h, 33))


def band_hash_column(values: Column) -> Column:
    """``band_hash`` of an array of BIGINTs, as the bits of a BIGINT."""
    basis = F.lit(FNV_BASIS - (1 << 64)).cast("bigint")
    folded = F.aggregate(values, basis, lambda h, v: times64(FNV_PRIME, h.bitwiseXOR(v)))
    return F.aggregate(F.array(folded.bitwiseXOR(F.size(values).cast("bigint"))), F.lit(0).cast("bigint"), lambda _, h: fmix64(h))


def candidate_probability(similarity: Column, bands: int, rows: int) -> Column:
    """Probability that two records of this similarity share a band bucket."""
    return 1 - F.pow(1 - F.pow(similarity, F.lit(float(rows))), F.lit(float(bands)))


# --- kernels ---------------------------------------------------------------------------------------------------------


def hashes(features: list[bytes] | Iterable[bytes], width: int) -> np.ndarray:
    """Finalised feature hashes."""
    size, kind = width // 8, np.uint32 if width == 32 else np.uint64
    digests = np.frombuffer(b"".join([sha1(f).digest() for f in features]), np.uint8).reshape(-1, 20)
    return _finalised(np.ascontiguousarray(digests[:, :size]).view(f"<u{size}").ravel().astype(kind), width)


def _finalised(h: np.ndarray, width: int) -> np.ndarray:
    kind = h.dtype.type
    with np.errstate(over="ignore"):
        for shift, factor in zip((16, 13) if width == 32 else (33, 33), FMIX32 if width == 32 else FMIX64, strict=True):
            h = (h ^ (h >> kind(shift))) * kind(factor)
        return h ^ (h >> kind(16 if width == 32 else 33))


#: Messages that are hashed at a time, whose arrays then stay in a core's cache, and bytes of the longest of them: what one block of SHA-1 holds.
LANES, BLOCK_BYTES = 1 << 14, 55

_K = (0x5A827999, 0x6ED9EBA1, 0x8F1BBCDC, 0xCA62C1D6)
_KEYS = np.repeat(np.array(_K, np.uint32), 20)[:, None]
_START = (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476, 0xC3D2E1F0)

#: Rows of the schedule from which on others can be made at once: none needs another of them, and their sources lie together.
_TOGETHER = {0: 3, 3: 3, 6: 2, 8: 3, 11: 3, 14: 2}

#: For each length, the bytes of a block that belong to a message, and what follows it there: a bit, and the length at the end.
_KEPT = np.zeros((BLOCK_BYTES + 1, 64), np.uint8)
_AFTER = np.zeros((BLOCK_BYTES + 1, 64), np.uint8)
for _n in range(BLOCK_BYTES + 1):
    _KEPT[_n, :_n], _AFTER[_n, _n] = 255, 128
    _AFTER[_n, 62], _AFTER[_n, 63] = divmod(8 * _n, 256)
_KEPT, _AFTER = _KEPT.view(np.uint64), _AFTER.view(np.uint64)


def _one_block(w: np.ndarray, words: int) -> list[np.ndarray]:
    """The first words of the SHA-1 digests of messages of one block; ``w`` (16 rows of 32-bit words, a column each) is overwritten.

    Every step is one for all messages, so none of them costs an object of Python's."""
    n = w.shape[1]
    state = [np.full(n, x, np.uint32) for x in _START]
    spare, f, g = np.empty(n, np.uint32), np.empty(n, np.uint32), np.empty(n, np.uint32)
    turned, keyed = np.empty((3, n), np.uint32), np.empty((3, n), np.uint32)
    u = {i: np.array(i, np.uint32) for i in (1, 2, 5, 27, 30, 31)}
    for t in range(80):
        a, b, c, d, e = state
        if t % 16 in _TOGETHER:
            first, rows = t % 16, _TOGETHER[t % 16]
            own = w[first : first + rows]
            if t >= 16:
                for back in (14, 8, 3):  # of 14 back some are among these, so they come first
                    other = (t - back) % 16
                    np.bitwise_xor(own, w[other : other + rows], out=own)
                np.right_shift(own, u[31], out=turned[:rows])
                np.left_shift(own, u[1], out=own)
                np.bitwise_or(own, turned[:rows], out=own)
            np.add(own, _KEYS[t : t + rows], out=keyed[:rows])
        if t < 20:
            np.bitwise_xor(c, d, out=f)
            np.bitwise_and(f, b, out=f)
            np.bitwise_xor(f, d, out=f)
        elif 40 <= t < 60:
            np.bitwise_xor(c, d, out=f)
            np.bitwise_and(f, b, out=f)
            np.bitwise_and(c, d, out=g)
            np.bitwise_xor(f, g, out=f)
        else:
            np.bitwise_xor(b, c, out=f)
            np.bitwise_xor(f, d, out=f)
        np.add(e, keyed[t % 16 - first], out=e)
        np.add(e, f, out=e)
        np.left_shift(a, u[5], out=f)
        np.right_shift(a, u[27], out=g)
        np.bitwise_or(f, g, out=f)
        np.add(e, f, out=e)
        np.right_shift(b, u[2], out=g)
        np.left_shift(b, u[30], out=spare)
        np.bitwise_or(spare, g, out=spare)
        state, spare = [e, a, spare, c, d], b
    return [state[i] + np.uint32(_START[i]) for i in range(words)]


def cut_hashes(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray, width: int) -> np.ndarray:
    """``hashes`` of the pieces of ``data`` (bytes, and 64 more at the end that no piece has)."""
    size, kind = width // 8, np.uint32 if width == 32 else np.uint64
    out = np.empty(len(starts), kind)
    if not len(starts):
        return out
    views = np.lib.stride_tricks.sliding_window_view(data, 64)
    short = np.flatnonzero(lengths <= BLOCK_BYTES)
    for at in range(0, len(short), LANES):
        part = short[at : at + LANES]
        n = lengths[part]
        block = views[starts[part]].view(np.uint64)
        block &= _KEPT[n]
        block |= _AFTER[n]
        found = _one_block(np.ascontiguousarray(block.view(">u4").T.astype(np.uint32)), size // 4)
        found = [x.byteswap() for x in found]
        out[part] = found[0] if width == 32 else found[0].astype(np.uint64) | (found[1].astype(np.uint64) << np.uint64(32))
    long = np.flatnonzero(lengths > BLOCK_BYTES)
    if len(long):
        digests = [sha1(data[s : s + n]).digest()[:size] for s, n in zip(starts[long].tolist(), lengths[long].tolist(), strict=True)]
        out[long] = np.frombuffer(b"".join(digests), f"<u{size}")
    return _finalised(out, width)


#: Features of a set from which on it is signed by itself, all permutations at once, and how many of them at a time.
LONG, PIECE = 48, 1 << 9


def signatures(features: list[bytes], lengths: np.ndarray, num_perm: int, seed: int, width: int) -> np.ndarray:
    """Signatures of consecutive feature sets, one row each; an empty set has all ones."""
    return minima(hashes(features, width), lengths, num_perm, seed, width)


def minima(h: np.ndarray, lengths: np.ndarray, num_perm: int, seed: int, width: int) -> np.ndarray:
    """The same from the features' hashes."""
    kind = np.uint32 if width == 32 else np.uint64
    a, b = (np.array(x, kind) for x in permutations(num_perm, seed, width))
    out = np.full((len(lengths), num_perm), M32 if width == 32 else M64, kind)
    every = np.cumsum(lengths) - lengths
    room, a1, b1 = np.empty(num_perm * PIECE, kind), a[:, None], b[:, None]
    with np.errstate(over="ignore"):
        for r in np.flatnonzero(lengths >= LONG):
            end = every[r] + lengths[r]
            for start in range(every[r], end, PIECE):
                n = min(PIECE, end - start)
                part = room[: num_perm * n].reshape(num_perm, n)
                np.multiply(h[start : start + n], a1, out=part)
                np.add(part, b1, out=part)
                np.minimum(out[r], part.min(axis=1), out=out[r])
        # Short sets lie together, so that one pass for each permutation signs them all.
        filled = np.flatnonzero((lengths > 0) & (lengths < LONG))
        if len(filled):
            if len(filled) < np.count_nonzero(lengths):
                h = h[np.repeat(lengths < LONG, lengths)]
            starts = np.cumsum(lengths[filled]) - lengths[filled]
            for i in range(num_perm):
                out[filled, i] = np.minimum.reduceat(h * a[i] + b[i], starts)
    return out


def band_hashes(values: np.ndarray) -> np.ndarray:
    """``band_hash`` of each row of a matrix of unsigned 64-bit values."""
    h = np.full(len(values), FNV_BASIS, np.uint64)
    with np.errstate(over="ignore"):
        for i in range(values.shape[1]):
            h = (h ^ values[:, i]) * np.uint64(FNV_PRIME)
        h ^= np.uint64(values.shape[1])
        for factor in FMIX64:
            h = (h ^ (h >> np.uint64(33))) * np.uint64(factor)
        return h ^ (h >> np.uint64(33))


def band_hash(values: list[int]) -> int:
    """The published 64-bit hash of a signature's band."""
    h = FNV_BASIS
    for v in values:
        h = ((h ^ v) * FNV_PRIME) & M64
    h ^= len(values)
    for factor in FMIX64:
        h = ((h ^ (h >> 33)) * factor) & M64
    return h ^ (h >> 33)
