"""Blocks of numbers that batches of documents and buckets of keys exchange."""

from __future__ import annotations

import numpy as np
import zstandard

_U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads their bits."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def pack(*arrays: np.ndarray | bytes) -> bytes:
    """Numbers and bytes as one compressed block."""
    parts = [x if isinstance(x, bytes) else x.tobytes() for x in arrays]
    return zstandard.compress(np.array([len(x) for x in parts], np.int64).tobytes() + b"".join(parts), 1)


def unpack(block: bytes, *types) -> list[np.ndarray]:
    data = zstandard.decompress(block)
    ends = np.cumsum(np.frombuffer(data, np.int64, len(types))) + 8 * len(types)
    return [np.frombuffer(data, t, (b - a) // np.dtype(t).itemsize, a) for t, a, b in zip(types, [8 * len(types), *ends[:-1].tolist()], ends.tolist())]


def cuts(ascending: np.ndarray, n: int):
    """(bucket, from, to) of ascending tokens: even ranges of all hashes."""
    bucket = ((ascending >> _U(32)) * _U(n) >> _U(32)).astype(np.int64)
    edges = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1], [True]])) if len(bucket) else np.zeros(1, np.int64)
    return [(int(bucket[a]), int(a), int(b)) for a, b in zip(edges[:-1], edges[1:])]
