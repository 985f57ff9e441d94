"""Document fingerprints by Order MinHash.

A text's k-mers of ``K`` code points are numbered by occurrence, so a repeated k-mer counts as often
as it occurs.  Each of ``HASHES`` hash functions selects the ``TUPLE`` numbered k-mers of smallest
value; they are put back into text order and the tuple is hashed to 32 bits.  Two texts agree in a
place if they share the selected k-mers in the same order, which insertions, deletions and moved
passages make unlikelier: the share of equal places follows the edit distance, not only the sets.

Rules for special cases: a null text counts as empty; empty texts have an empty fingerprint, equal
to each other (likeness 1) and to nothing else (0); a text shorter than a k-mer is one k-mer; equal
texts have equal fingerprints; a text is read to its end in blocks of ``BLOCK`` k-mers.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from perennial.functions.storage import materialize
from perennial.llm.textops import mix64

K = 16
#: The standard error of a likeness p is sqrt(p (1 - p) / HASHES), at most 1/16; texts of likeness 0.1 get 0
#: once in a thousand times.
HASHES = 64
TUPLE = 2
BLOCK = 4096
_U = np.uint64
_BASE = 0xD6E8FEB86659FD93
_BACK = pow(_BASE, -1, 1 << 64)
_RANDOM = np.random.Generator(np.random.PCG64(7))
_XOR = _RANDOM.integers(0, 1 << 32, HASHES, dtype=np.uint32)[:, None]
_ODD = (_RANDOM.integers(0, 1 << 31, HASHES, dtype=np.uint32) * np.uint32(2) + np.uint32(1))[:, None]
_POINT = mix64(np.arange(1, 0x3001, dtype=_U))
_MOST = np.uint32(0xFFFFFFFF)


class _Powers:
    up = down = np.ones(1, _U)

    @classmethod
    def upto(cls, n: int):
        if len(cls.up) < n:
            up, down = np.full(max(n, 1 << 16), _U(_BASE)), np.full(max(n, 1 << 16), _U(_BACK))
            up[0] = down[0] = 1
            cls.up, cls.down = np.multiply.accumulate(up), np.multiply.accumulate(down)
        return cls.up[:n], cls.down[:n]


def numbered_kmers(points: np.ndarray, k: int = K) -> np.ndarray:
    """One hash per place for the k-mer that starts there and the number of its occurrence."""
    n = len(points)
    k = min(k, n)
    up, down = _Powers.upto(n)
    value = _POINT[np.minimum(points, 0x2FFF)]
    far = points > 0x2FFF
    if far.any():
        value[far] = mix64(points[far].astype(_U) + _U(1))
    total = np.zeros(n + 1, _U)
    np.cumsum(value * up, out=total[1:])
    count = n - k + 1
    hashes = mix64((total[k:] - total[:count]) * down[:count])
    # equal k-mers meet when sorted by hash; the place in the low bits keeps text order
    bits = _U(max(1, int(count).bit_length()))
    places = (_U(1) << bits) - _U(1)
    packed = np.sort((hashes & ~places) | np.arange(count, dtype=_U))
    again = np.zeros(count, bool)
    again[1:] = (packed[1:] >> bits) == (packed[:-1] >> bits)
    repeated = np.flatnonzero(again)
    if len(repeated):
        index = np.arange(count)
        begin = np.maximum.accumulate(np.where(again, 0, index))
        number = (index - begin)[repeated].astype(_U)
        at = (packed[repeated] & places).astype(np.int64)
        hashes[at] = mix64(hashes[at] + number * _U(0x9E3779B97F4A7C15))
    return hashes


def signature(text: str, k: int = K) -> np.ndarray:
    """``HASHES`` 32-bit numbers, or none for an empty text."""
    if not text:
        return np.zeros(0, np.uint32)
    kmers = numbered_kmers(np.frombuffer(text.encode("utf-32-le"), np.uint32), k)
    short = (kmers >> _U(32)).astype(np.uint32)
    rows = np.arange(HASHES)
    values: list[np.ndarray] = []
    where: list[np.ndarray] = []
    for start in range(0, len(short), BLOCK):
        grid = (short[None, start : start + BLOCK] ^ _XOR) * _ODD
        for _ in range(min(TUPLE, grid.shape[1])):
            at = grid.argmin(axis=1)
            values.append(grid[rows, at])
            where.append(at + start)
            grid[rows, at] = _MOST
    value, place = np.stack(values), np.stack(where)
    if len(value) > TUPLE:
        least = np.argsort(value, axis=0, kind="stable")[:TUPLE]
        place = np.take_along_axis(place, least, axis=0)
    place = np.sort(place, axis=0)
    tuples = np.zeros(HASHES, _U)
    for p in place:
        tuples = mix64(tuples * _U(_BASE) + kmers[p])
    return (tuples >> _U(32)).astype("<u4")


def alike(a: np.ndarray, b: np.ndarray) -> float:
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    return float((a == b).mean())


@F.arrow_udf(T.BinaryType())
def _signatures(texts: pa.Array) -> pa.Array:
    return pa.array([signature(t.as_py() or "").tobytes() for t in texts], pa.binary())


def with_fingerprint(docs: DataFrame, text: str = "text", result: str = "fingerprint") -> DataFrame:
    """Add the fingerprint of each text as hexadecimal text."""
    return docs.withColumn(result, F.lower(F.hex(_signatures(F.col(f"`{text}`")))))


def likeness(a: Column, b: Column) -> Column:
    """Share of equal places of two fingerprints."""
    at = F.sequence(F.lit(0), F.lit(HASHES - 1))
    same = F.aggregate(
        at, F.lit(0), lambda n, i: n + (a.substr(i * 8 + 1, F.lit(8)) == b.substr(i * 8 + 1, F.lit(8))).cast("int")
    )
    return F.when((a == "") | (b == ""), (a == b).cast("double")).otherwise(same / HASHES)


# --- comparison with an edited text and the next document ------------------------------------


def edited(text: str, following: str) -> str:
    """``text`` with its second half replaced by as much of the beginning of ``following``."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def _compared(text: str, own: np.ndarray, following: str, other: np.ndarray) -> dict:
    changed = edited(text, following)
    print_ = own if changed == text else signature(changed)
    return {
        "edited_sha256": hashlib.sha256(changed.encode()).hexdigest(),
        "edited": print_.tobytes(),
        "near_edited": alike(own, print_),
        "near_next": alike(own, other),
    }


_EMPTY = {"edited_sha256": None, "edited": None, "near_edited": None, "near_next": None}
_COMPARED = "edited_sha256 string, edited binary, near_edited double, near_next double"
_WALKED = f"doc_id long, n_chars long, own binary, {_COMPARED}, part int, first string, last string"
_TYPES = pa.schema(
    [
        ("doc_id", pa.int64()), ("n_chars", pa.int64()), ("own", pa.binary()),
        ("edited_sha256", pa.string()), ("edited", pa.binary()), ("near_edited", pa.float64()),
        ("near_next", pa.float64()), ("part", pa.int32()), ("first", pa.string()), ("last", pa.string()),
    ]
)


def _walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Compares each document with the one that follows in the task; the task's first and last
    documents carry their texts on, because their neighbours are in other tasks."""
    part = TaskContext.get().partitionId()
    held, start = None, True
    for batch in batches:
        out = []
        for doc, value in zip(batch.column(0).to_pylist(), batch.column(1)):
            text = value.as_py()
            own = signature(text)
            if held:
                row, before, before_own = held
                out.append(row | _compared(before, before_own, text, own))
            row = {"doc_id": doc, "n_chars": len(text), "own": own.tobytes(), "part": part}
            held = (row | {"first": text if start else None, "last": None}, text, own)
            start = False
        yield pa.RecordBatch.from_pylist(out, _TYPES)
    if held:
        row, text, _ = held
        yield pa.RecordBatch.from_pylist([row | _EMPTY | {"last": text}], _TYPES)


@F.arrow_udf(
    T.StructType()
    .add("edited_sha256", T.StringType())
    .add("edited", T.BinaryType())
    .add("near_edited", T.DoubleType())
    .add("near_next", T.DoubleType())
)
def _across(text: pa.Array, own: pa.Array, following: pa.Array, other: pa.Array) -> pa.Array:
    rows = [
        _compared(t.as_py(), np.frombuffer(a.as_py(), "<u4"), f.as_py(), np.frombuffer(b.as_py(), "<u4"))
        for t, a, f, b in zip(text, own, following, other)
    ]
    return pa.array(rows, pa.struct([_TYPES.field(i) for i in range(3, 7)]))


def compare_with_next(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: ``doc_id``, ``n_chars``, ``edited_sha256`` and the fingerprints and
    likenesses of its text, its edited text and the next document.

    The next document is the one of next lower key (null keys last, equal keys by text); after the
    last comes the first.  Documents are shuffled once, into ranges of keys; the ends of neighbouring
    ranges, one text each, are joined afterwards.
    """
    rows = docs.select(
        F.col(f"`{key}`").cast("long").alias("doc_id"),
        F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"),
    )
    ranged = rows.repartitionByRange(F.desc_nulls_last("doc_id")).sortWithinPartitions(
        F.desc_nulls_last("doc_id"), "text"
    )
    walked = materialize(ranged.mapInArrow(_walk, _WALKED), "compared")
    heads = walked.where("first IS NOT NULL").select(
        "part", F.col("first").alias("following"), F.col("own").alias("other")
    )
    parts = heads.select("part")
    after = parts.select(
        "part",
        F.coalesce(
            F.lead("part").over(Window.orderBy("part")), F.min("part").over(Window.orderBy("part"))
        ).alias("next"),
    )
    tails = (
        walked.where("last IS NOT NULL")
        .join(after, "part")
        .join(heads.withColumnRenamed("part", "next"), "next")
        .withColumn("c", _across("last", "own", "following", "other"))
        .select("doc_id", "n_chars", "own", "c.edited_sha256", "c.edited", "c.near_edited", "c.near_next")
    )
    inner = walked.where("last IS NULL").select(*tails.columns)

    def hexed(c):
        return F.lower(F.hex(c))

    return inner.unionByName(tails).select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        hexed("own").alias("fingerprint"),
        hexed("edited").alias("edited_fingerprint"),
        "near_edited",
        "near_next",
    )
