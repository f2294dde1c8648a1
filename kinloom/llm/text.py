"""Whole-text word hashing in numpy, shared by the operators that run in Arrow batches.

A word is a run of bytes outside ``[\\x20\\x09-\\x0D]`` of the UTF-8 text, A-Z lower-cased. Its
64-bit hash is a random polynomial of its bytes, mixed; equal words have equal hashes in every
process. Two different words of a vocabulary of V words collide with probability below V^2 / 2^65.
"""

from __future__ import annotations

import gc
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: UTF-8 bytes that one numpy pass takes; longer texts are taken alone.
PASS_BYTES = 3 << 20

_rng = np.random.default_rng(20240607)
_BYTE = _rng.integers(0, 1 << 64, 256, dtype=np.uint64)
_STEP = np.uint64(int(_rng.integers(0, 1 << 62)) * 2 + 1)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BYTE = _BYTE[_LOWER]
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


_kept: dict[str, tuple[str, dict]] = {}


def worker_cache(name: str, key: str) -> dict:
    """A dict that this worker process keeps between tasks, emptied when another key comes."""
    kept = _kept.get(name)
    if kept is None or kept[0] != key:
        kept = _kept[name] = (key, {})
    return kept[1]


def release_caches() -> None:
    """Gives back what earlier operators keep in this worker process. Spark hands a worker from one
    query to the next, so an operator that keeps nothing itself begins with this."""
    if _kept:
        _kept.clear()
        gc.collect()
        pa.default_memory_pool().release_unused()


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def slices(column: pa.ChunkedArray | pa.Array, limit: int = PASS_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of a string column whose texts have about ``limit`` bytes together."""
    import pyarrow.compute as pc

    size = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
    end, start, total = len(size), 0, 0
    for i in range(end):
        total += int(size[i]) + 16
        if total >= limit or i == end - 1:
            yield start, i + 1
            start, total = i + 1, 0


def words(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of ``texts`` in order, and where each text's words begin (one more
    offset than texts)."""
    buf = np.frombuffer(b" ".join([*texts, b""]), np.uint8)
    first = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t) + 1 for t in texts], out=first[1:])
    if not len(buf):
        return np.zeros(0, np.uint64), np.zeros(len(texts) + 1, np.int64)
    inside = ~_SPACE[buf]
    edge = np.flatnonzero(np.diff(inside.view(np.int8), prepend=np.int8(0), append=np.int8(0)))
    start, stop = edge[::2], edge[1::2]
    if not len(start):
        return np.zeros(0, np.uint64), np.zeros(len(texts) + 1, np.int64)
    length = stop - start
    at = np.cumsum(length) - length
    power = np.multiply.accumulate(np.full(int(length.max()), _STEP, np.uint64))
    within = np.arange(int(length.sum())) - np.repeat(at, length)
    h = np.add.reduceat(_BYTE[buf[inside]] * power[within], at)
    return mix(h + np.uint64(1)), np.searchsorted(start, first)


def encoded(column: pa.Array) -> list[bytes]:
    """The UTF-8 bytes of a string column, empty for null."""
    return [b"" if x is None else x for x in column.cast(pa.binary()).to_pylist()]


def shingles(h: np.ndarray, at: np.ndarray, k: int) -> Iterator[np.ndarray]:
    """For each text the sorted distinct hashes of its k-word shingles; of a text with fewer
    words but one, the hash of the whole sequence; nothing for a text without words."""
    if len(h) >= k:
        g = h[: len(h) - k + 1].copy()
        for i in range(1, k):
            g = mix(g + np.uint64(i)) ^ h[i : len(h) - k + 1 + i]
        g = mix(g)
    for a, b in zip(at[:-1], at[1:], strict=True):
        if b - a >= k:
            yield np.unique(g[a : b - k + 1])
        elif b > a:
            whole = np.full(1, b - a, np.uint64)
            for i in range(a, b):
                whole = mix(whole + np.uint64(7)) ^ h[i : i + 1]
            yield mix(whole)
        else:
            yield np.zeros(0, np.uint64)
