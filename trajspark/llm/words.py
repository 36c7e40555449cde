"""Words and rolling hashes of whole Arrow batches, without a Python loop over words.

A batch is cut into blocks of whole documents, so that the working memory follows the
block, not the batch. The bytes of a block are hashed by prefix sums: the hash of any
stretch of bytes, or of any run of words, is a difference of two sums. Hashes have 64
bits; two different words, shingles or windows share one with probability 2**-64 each.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

BLOCK_BYTES = 1 << 20
U64 = np.uint64

# White space between words is \x20 and \x09 to \x0D.
SEPARATORS = np.zeros(256, dtype=bool)
SEPARATORS[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32

_BASE = 0x9E3779B97F4A7C13
_INVERSE = pow(_BASE, -1, 1 << 64)
_cached: dict[str, np.ndarray] = {}


def forget() -> None:
    """Drop the powers that a worker holds; they grow with the longest text it has met."""
    _cached.clear()


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit numbers (the finalizer of splitmix64)."""
    h = h ^ (h >> U64(30))
    h *= U64(0xBF58476D1CE4E5B9)
    h ^= h >> U64(27)
    h *= U64(0x94D049BB133111EB)
    return h ^ (h >> U64(31))


BYTE_VALUES = mix((np.arange(256, dtype=U64) + U64(1)) * U64(0x9E3779B97F4A7C15))


def powers(kind: str, count: int) -> np.ndarray:
    """``base ** i`` for i below ``count``, modulo 2**64."""
    have = _cached.get(kind, np.ones(1, dtype=U64))
    if len(have) < count:
        factor = _BASE if kind == "base" else _INVERSE
        have = np.full(max(count, 2 * len(have)), factor, dtype=U64)
        have[0] = 1
        np.cumprod(have, out=have)
        _cached[kind] = have
    return have[:count]


@dataclass(frozen=True)
class Block:
    """Whole documents ``first`` to ``last`` of a batch; ``offsets`` bound their bytes in ``data``."""

    first: int
    last: int
    data: np.ndarray
    offsets: np.ndarray


def blocks(texts: pa.Array, size: int = BLOCK_BYTES) -> Iterator[Block]:
    """Blocks of about ``size`` bytes; a longer document is a block of its own. Null is empty."""
    texts = texts.cast(pa.large_string()).fill_null("")
    if len(texts) == 0:
        return
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, dtype=np.uint8)
    first = 0
    while first < len(texts):
        last = int(np.searchsorted(offsets, offsets[first] + size, side="right")) - 1
        last = min(max(last, first + 1), len(texts))
        yield Block(first, last, data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first])
        first = last


@dataclass(frozen=True)
class Words:
    """Byte ranges of the words of a block; ``bounds`` has the range of words of each document."""

    start: np.ndarray
    end: np.ndarray
    bounds: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.bounds)


def find_words(block: Block, separators: np.ndarray = SEPARATORS) -> Words:
    """All maximal runs of bytes that are not separators, within their documents."""
    inside = ~separators[block.data]
    if not inside.any():
        none = np.zeros(0, dtype=np.int64)
        return Words(none, none, np.zeros(len(block.offsets), dtype=np.int64))
    begins, ends = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1]
    ends[:-1] &= ~inside[1:]
    edges = block.offsets[(block.offsets > 0) & (block.offsets < len(block.data))]
    begins[edges] = inside[edges]
    ends[edges - 1] = inside[edges - 1]
    start = np.flatnonzero(begins)
    return Words(start, np.flatnonzero(ends) + 1, np.searchsorted(start, block.offsets))


def stretch_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, lower: bool = False) -> np.ndarray:
    """A 64-bit hash of the bytes of each stretch ``[start, end)``; ``lower`` ignores the case of A to Z."""
    values = BYTE_VALUES[LOWER] if lower else BYTE_VALUES
    sums = np.zeros(len(data) + 1, dtype=U64)
    np.cumsum(values[data] * powers("base", len(data)), out=sums[1:])
    h = (sums[end] - sums[start]) * powers("inverse", len(data) + 1)[start]
    return mix(h + (end - start).astype(U64) * U64(0xD6E8FEB86659FD93))


def run_hashes(words: np.ndarray, length: int) -> np.ndarray:
    """Hash of every run of ``length`` consecutive words, by its first word (fewer at the end)."""
    count = max(0, len(words) - length + 1)
    sums = np.zeros(len(words) + 1, dtype=U64)
    np.cumsum(words * powers("base", len(words)), out=sums[1:])
    return mix((sums[length:] - sums[:-length])[:count] * powers("inverse", len(words) + 1)[:count])


def rows_between(lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """All numbers of the ranges ``[lo, hi)``, one range after the other."""
    counts = np.maximum(hi - lo, 0)
    total = int(counts.sum())
    if not total:
        return np.zeros(0, dtype=np.int64)
    steps = np.repeat(lo - np.concatenate([[0], np.cumsum(counts)[:-1]]), counts)
    return steps + np.arange(total)
