"""Whole texts as flat word arrays, one Arrow batch at a time.

A word is a run of bytes other than space and the ASCII controls 9 to 13. These bytes never occur
inside a multi-byte UTF-8 sequence, so words are found on bytes without decoding. Batches are cut
into slices of bounded bytes; a longer text is a slice of its own.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SLICE_BYTES = 256 << 10
BITMAP_BITS = 26  # 8 MB in every task; more hashes only make more of the others pass
PIECE_BITS = 7  # a bitmap is put together from so many pieces (a power of two)

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

_U = np.uint64
_MIX_A, _MIX_B = _U(0xBF58476D1CE4E5B9), _U(0x94D049BB133111EB)


def mix(h: np.ndarray) -> np.ndarray:
    """Bijective scrambling of 64-bit values."""
    h = (h ^ (h >> _U(30))) * _MIX_A
    h = (h ^ (h >> _U(27))) * _MIX_B
    return h ^ (h >> _U(31))


def _byte_keys(seed: int) -> tuple[np.ndarray, int]:
    keys = mix(np.arange(1, 257, dtype=_U) * _U(0x9E3779B97F4A7C15) + _U(seed))
    return keys, int(mix(np.array([seed * 2 + 1], dtype=_U))[0]) | 1


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    out = np.full(max(n, 1), _U(base))
    out[0] = 1
    return np.multiply.accumulate(out)


@dataclass
class Slice:
    """Texts lo..hi of a batch: their bytes, and where words and texts begin and end in them."""

    lo: int
    hi: int
    data: np.ndarray
    bounds: np.ndarray  # byte offset of each text, and the end
    start: np.ndarray  # first byte of each word
    end: np.ndarray  # after its last byte
    first: np.ndarray  # first word of each text, and the number of words

    def hashes(self, seed: int = 1, lower: bool = False) -> np.ndarray:
        """A 64-bit hash of each word."""
        if not len(self.start):
            return np.empty(0, _U)
        size = self.end - self.start
        at = np.cumsum(size) - size
        inside = np.arange(int(size.sum())) - np.repeat(at, size)
        raw = self.data[inside + np.repeat(self.start, size)]
        keys, base = _byte_keys(seed)
        values = keys[_LOWER[raw] if lower else raw] * powers(base, int(size.max()))[inside]
        return mix(np.add.reduceat(values, at) + size.astype(_U))

    def strings(self, at: np.ndarray) -> pa.Array:
        """The words at these places, lower-cased in A-Z."""
        size = self.end[at] - self.start[at]
        ends = np.cumsum(size)
        inside = np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(self.start[at] - (ends - size), size)
        flat = np.ascontiguousarray(_LOWER[self.data[inside]])
        offsets = np.concatenate(([0], ends)).astype(np.int32)
        return pa.Array.from_buffers(pa.string(), len(at), [None, pa.py_buffer(offsets), pa.py_buffer(flat)])

    def text_of(self, i: int) -> np.ndarray:
        return self.data[self.bounds[i] : self.bounds[i + 1]]


def slices(texts: pa.Array, limit: int = SLICE_BYTES, in_word: Callable[[np.ndarray], np.ndarray] | None = None) -> Iterator[Slice]:
    """The texts of an Arrow column in order; null counts as empty. ``in_word`` tells which bytes belong to words."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    n = len(texts)
    if not n:
        return
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, np.int64, n + 1, texts.offset * 8)
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.empty(0, np.uint8)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, "right")) - 1)
        bounds = offsets[lo : hi + 1] - offsets[lo]
        part = data[offsets[lo] : offsets[hi]]
        word = ~_SPACE[part] if in_word is None else in_word(part)
        edge = np.zeros(len(part) + 1, bool)
        edge[bounds] = True
        before = np.concatenate(([False], word[:-1])) if len(part) else word
        after = np.concatenate((word[1:], [False])) if len(part) else word
        start = np.flatnonzero(word & (~before | edge[:-1]))
        end = np.flatnonzero(word & (~after | edge[1:])) + 1
        yield Slice(lo, hi, part, bounds, start, end, np.searchsorted(start, bounds))
        lo = hi


def _give_back() -> None:
    """Return freed memory to the system: workers live on between tasks, next to the executor's heap."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def arrow_rows(docs: DataFrame, rows: Callable, schema: str) -> DataFrame:
    """``mapInArrow`` with batches of few bytes, so that tasks of long texts stay small."""
    docs.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "4m")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from rows(batches)
        _give_back()

    return docs.mapInArrow(run, schema)


def joined(part: Slice, keep: np.ndarray | None = None) -> list[bytes]:
    """Each text's words, or those kept, with one space between."""
    keep = np.ones(len(part.start), bool) if keep is None else keep
    taken = np.zeros(len(part.data) + 1, np.int8)
    taken[part.start[keep]] = 1
    np.subtract.at(taken, part.end[keep], 1)
    mask = np.cumsum(taken[:-1], dtype=np.int8).astype(bool)
    out = part.data.copy()
    # the byte before a kept word that has a kept word of its text before it becomes the space
    kept = np.flatnonzero(keep)
    text = np.searchsorted(part.first, kept, "right")
    later = kept[1:][text[1:] == text[:-1]]
    space = part.start[later] - 1
    out[space] = 32
    mask[space] = True
    at = np.concatenate(([0], np.cumsum(mask)))[part.bounds]
    flat = out[mask].tobytes()
    return [flat[a:b] for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]


def passing(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Which hashes take a slot of the bitmap."""
    slot = keys >> _U(64 - BITMAP_BITS)
    return (bits[(slot >> _U(3)).astype(np.int64)] >> (slot & _U(7)).astype(np.uint8)) & 1 > 0


def bitmap(keys: DataFrame) -> np.ndarray:
    """Which slots the hashes of (key) take: 2**BITMAP_BITS bits reach the driver, however many keys there are."""
    bits = BITMAP_BITS - PIECE_BITS
    piece = F.shiftrightunsigned("key", 64 - PIECE_BITS)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces: dict[int, np.ndarray] = {}
        for batch in batches:
            slot = batch.column(0).to_numpy().view(_U) >> _U(64 - BITMAP_BITS)
            of = (slot >> _U(bits)).astype(np.int64)
            for p in np.unique(of).tolist():
                mine = pieces.setdefault(p, np.zeros(1 << bits, bool))
                mine[(slot[of == p] & _U((1 << bits) - 1)).astype(np.int64)] = True
        packed = [np.packbits(b, bitorder="little").tobytes() for b in pieces.values()]
        yield pa.record_batch([pa.array(pieces.keys(), pa.int32()), pa.array(packed, pa.binary())], names=["piece", "bits"])

    total = np.zeros(1 << (BITMAP_BITS - 3), np.uint8)
    for row in arrow_rows(keys.select("key").repartition(1 << PIECE_BITS, piece), rows, "piece int, bits binary").collect():
        total[row.piece << (bits - 3) : (row.piece + 1) << (bits - 3)] |= np.frombuffer(row.bits, np.uint8)
    return total
