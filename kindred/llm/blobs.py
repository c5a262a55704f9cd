"""Numpy arrays as compact binary values, and keys that spread evenly over partitions."""

from __future__ import annotations

import struct

import numpy as np
import pyarrow as pa

_HEAD = struct.Struct("<2sQQ")
_codec = pa.Codec("zstd", compression_level=1)


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays of numbers, each by its byte planes, compressed."""
    out = []
    for a in arrays:
        a = np.ascontiguousarray(a)
        planes = a.view(np.uint8).reshape(len(a), a.itemsize).T.tobytes()
        data = _codec.compress(planes, asbytes=True)
        out += [_HEAD.pack(a.dtype.str[1:].encode(), len(a), len(data)), data]
    return b"".join(out)


def unpack(data: bytes) -> list[np.ndarray]:
    out, at = [], 0
    view = memoryview(data)
    while at < len(data):
        kind, n, size = _HEAD.unpack_from(data, at)
        at += _HEAD.size
        dtype = np.dtype(kind.decode())
        planes = np.frombuffer(_codec.decompress(view[at : at + size], n * dtype.itemsize), np.uint8)
        out.append(np.ascontiguousarray(planes.reshape(dtype.itemsize, n).T).view(dtype).reshape(n))
        at += size
    return out


def narrow(a: np.ndarray) -> np.ndarray:
    """Numbers from 0 on in the smallest type that holds them."""
    return a.astype(np.min_scalar_type(int(a.max()) if len(a) else 0))


def steps_of(ascending: np.ndarray) -> np.ndarray:
    """Differences of an ascending sequence, the first being its first value; ``np.cumsum`` undoes it."""
    return np.diff(ascending, prepend=ascending.dtype.type(0)) if len(ascending) else ascending


def _murmur3(x: np.ndarray) -> np.ndarray:
    """Spark's hash of 32-bit integers."""
    with np.errstate(over="ignore"):
        k = x.astype(np.uint32) * np.uint32(0xCC9E2D51)
        k = ((k << np.uint32(15)) | (k >> np.uint32(17))) * np.uint32(0x1B873593)
        h = np.uint32(42) ^ k
        h = ((h << np.uint32(13)) | (h >> np.uint32(19))) * np.uint32(5) + np.uint32(0xE6546B64)
        h ^= np.uint32(4)
        h = (h ^ (h >> np.uint32(16))) * np.uint32(0x85EBCA6B)
        h = (h ^ (h >> np.uint32(13))) * np.uint32(0xC2B2AE35)
        return (h ^ (h >> np.uint32(16))).view(np.int32)


def even_keys(n: int) -> np.ndarray:
    """n integers, the i-th of which Spark's hash partitioning by an int column puts into partition i of n."""
    many = 32 * n + 64
    while True:
        at, first = np.unique(np.mod(_murmur3(np.arange(many, dtype=np.int32)).astype(np.int64), n), return_index=True)
        if len(at) == n:
            return first.astype(np.int32)
        many *= 2
