"""Vectorised word splitting and hashing over the UTF-8 buffers of Arrow text columns.

All functions work on one Arrow batch inside a task.  A batch is cut into pieces of about
``PIECE_BYTES`` (a longer text is a piece of its own), so the memory needed does not depend on the
number of rows of a batch.  Null texts count as empty.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import wraps

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PIECE_BYTES = 1 << 19
_U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)
#: One odd random weight per byte value.
_BYTE_WEIGHT = np.random.Generator(np.random.PCG64(20240601)).integers(
    1, 1 << 63, 256, dtype=np.uint64
) * _U(2) + _U(1)

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def byte_class(member: Callable[[int], bool]) -> np.ndarray:
    """Table of the byte values that belong to a word; bytes of non-ASCII characters are 128 and up."""
    return np.array([member(b) for b in range(256)])


#: Everything but the six ASCII white space characters.
SPACED = byte_class(lambda b: not (b == 0x20 or 0x09 <= b <= 0x0D))
#: ASCII digits and lower-case letters, and every non-ASCII character.
ALNUM = byte_class(lambda b: 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80)


def mix64(x: np.ndarray) -> np.ndarray:
    """Scrambles 64-bit values; a bijection."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


class _Powers:
    """Powers of the hash base and of its inverse, as many as the longest piece so far needed."""

    def __init__(self):
        self.up = self.down = np.ones(1, _U)

    def upto(self, n: int) -> None:
        if n <= len(self.up):
            return
        n = max(n, PIECE_BYTES + 1)
        up, down = np.full(n, _U(_BASE)), np.full(n, _U(_BASE_INVERSE))
        up[0] = down[0] = 1
        self.up, self.down = np.multiply.accumulate(up), np.multiply.accumulate(down)


_POWERS = _Powers()


@dataclass
class Words:
    """Words of consecutive texts: ``first[i]:first[i+1]`` are those of text ``i``."""

    hashes: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray


def utf8(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a text column and the place where each text begins (one more than texts)."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.fill_null("").cast(pa.large_string())
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, places, data = texts.buffers()
    offsets = np.frombuffer(places, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def pieces(offsets: np.ndarray, max_bytes: int = PIECE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``max_bytes``, or of one row."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = int(np.searchsorted(offsets, offsets[lo] + max_bytes, "right")) - 1
        hi = min(n, max(hi, lo + 1))
        yield lo, hi
        lo = hi


def split_words(data: np.ndarray, bounds: np.ndarray, words: np.ndarray, lower: bool = True) -> Words:
    """Maximal runs of ``words`` bytes inside each text; ``lower`` folds A-Z first."""
    n = len(data)
    if lower:
        data = _LOWER[data]
    inside = words[data]
    before = np.zeros(n, bool)
    after = np.zeros(n, bool)
    if n:
        before[1:], after[:-1] = inside[:-1], inside[1:]
        before[bounds[:-1][bounds[:-1] < n]] = False
        after[bounds[1:][bounds[1:] > 0] - 1] = False
    starts = np.flatnonzero(inside & ~before)
    ends = np.flatnonzero(inside & ~after) + 1
    _POWERS.upto(n + 1)
    total = np.zeros(n + 1, _U)
    np.cumsum(_BYTE_WEIGHT[data] * _POWERS.up[:n], out=total[1:])
    hashes = mix64((total[ends] - total[starts]) * _POWERS.down[starts])
    hashes[hashes == 0] = 1
    return Words(hashes, starts, ends, np.searchsorted(starts, bounds))


def shared_copy(df: DataFrame, path: str) -> DataFrame:
    """Write ``df`` to ``path`` and read it back: cuts the lineage and survives lost executors."""
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def give_back() -> None:
    """Return freed memory to the system, where its allocator can."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def thrifty(function: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """An Arrow function whose worker, kept for later stages, gives its memory back after each task."""

    @wraps(function)
    def run(batches):
        yield from function(batches)
        give_back()

    return run


def with_result(df: DataFrame, result: Column, fields: dict[str, str]) -> DataFrame:
    """Add fields of one struct column; a column of ``df`` with the name of a field is replaced."""
    spare = unused(df, "_result")
    out = df.withColumn(spare, result)
    kept = [F.col(f"`{c}`") for c in df.columns if c not in fields.values()]
    return out.select(*kept, *[F.col(spare)[f].alias(name) for f, name in fields.items()])


def unused(df: DataFrame, name: str) -> str:
    """A column name that ``df`` does not have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name
