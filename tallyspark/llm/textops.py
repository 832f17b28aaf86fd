"""Scanning whole Arrow batches of texts with numpy: code points, word bounds and 64-bit hashes of any stretch.

A text that is null counts as empty. Stretches are hashed with prefix sums, so the hash of every word, n-gram or
substring of a chunk costs one subtraction and one multiplication.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 1 << 20
CODE_POINTS = 0x110000
_STEP = 0x9E3779B97F4A7C15
_BACK = pow(_STEP, -1, 1 << 64)


def mix(values: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit finalizer: every input bit reaches every output bit."""
    x = values + np.uint64((seed * _STEP + _STEP) % (1 << 64))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@cache
def letters() -> np.ndarray:
    """Which code points are letters."""
    return np.fromiter((chr(c).isalpha() for c in range(CODE_POINTS)), bool, CODE_POINTS)


@cache
def lower() -> np.ndarray:
    """The lower-case form of each code point; those whose form is longer than one stay."""
    table = np.arange(CODE_POINTS, dtype=np.uint32)
    for c in range(0x1F000):
        form = chr(c).lower()
        if len(form) == 1:
            table[c] = ord(form)
    return table


@cache
def _weights() -> np.ndarray:
    return mix(np.arange(CODE_POINTS, dtype=np.uint64), 7)


_powers: dict[int, np.ndarray] = {}


def _power(base: int, size: int) -> np.ndarray:
    held = _powers.get(base)
    if held is None or len(held) < size:
        grown = np.full(max(size, CHUNK_BYTES) + 1, base, np.uint64)
        grown[0] = 1
        np.cumprod(grown, out=grown)
        held = _powers[base] = grown
    return held[:size]


@dataclass
class Chunk:
    """Some neighbouring texts of a batch as one array of code points."""

    first: int
    points: np.ndarray
    bounds: np.ndarray

    @property
    def rows(self) -> int:
        return len(self.bounds) - 1

    def runs(self, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts and ends of the longest stretches where ``inside`` holds; none crosses two texts."""
        if not len(inside):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        before, after = np.zeros(len(inside), bool), np.zeros(len(inside), bool)
        before[1:], after[:-1] = inside[:-1], inside[1:]
        before[self.bounds[:-1][self.bounds[:-1] < len(inside)]] = False
        after[self.bounds[1:][self.bounds[1:] > 0] - 1] = False
        return np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1

    def row_of(self, positions: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.bounds, positions, side="right") - 1

    def not_space(self) -> np.ndarray:
        """Where a character is none of space and the five ASCII controls from tab to carriage return."""
        p = self.points
        return ~((p == 32) | ((p >= 9) & (p <= 13)))


class Hashes:
    """Hashes of any stretch of an array of code points."""

    def __init__(self, points: np.ndarray):
        self.sums = np.zeros(len(points) + 1, np.uint64)
        np.cumsum(_weights()[points] * _power(_STEP, len(points)), out=self.sums[1:])
        self.back = _power(_BACK, len(points) + 1)

    def of(self, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
        return mix((self.sums[ends] - self.sums[starts]) * self.back[starts], seed)


def chunks(texts: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[Chunk]:
    """Cut a batch of texts into chunks of about ``limit`` bytes; a longer text is a chunk of its own."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if not pa.types.is_large_string(texts.type):
        texts = texts.cast(pa.large_string())
    if not len(texts):
        return
    if texts.null_count:
        texts = texts.fill_null("")
    _, offset_buffer, data = texts.buffers()
    offsets = np.frombuffer(offset_buffer, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    first = 0
    while first < len(texts):
        last = int(np.searchsorted(offsets, offsets[first] + limit, side="right")) - 1
        last = min(max(last, first + 1), len(texts))
        begin, end = int(offsets[first]), int(offsets[last])
        raw = data[begin:end].to_pybytes() if end > begin else b""
        points = np.frombuffer(raw.decode("utf-8").encode("utf-32-le"), np.dtype("<u4"))
        bounds = offsets[first : last + 1] - begin
        if len(points) < len(raw):
            begins = (np.frombuffer(raw, np.uint8) & 0xC0) != 0x80
            bounds = np.concatenate([[0], np.cumsum(begins)])[bounds]
        yield Chunk(first, points, bounds.astype(np.int64))
        first = last


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The positions start, start + 1, ... of all stretches, one after the other."""
    lengths = np.asarray(lengths, np.int64)
    total = int(lengths.sum())
    shift = np.asarray(starts, np.int64) - (np.cumsum(lengths) - lengths)
    return np.arange(total, dtype=np.int64) + np.repeat(shift, lengths)


def find(keys: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Places of ``wanted`` in sorted ``keys``, -1 where absent."""
    if not len(keys):
        return np.full(len(wanted), -1, np.int64)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where(keys[at] == wanted, at, -1)
