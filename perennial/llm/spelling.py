"""Spelling variants of words, found through a reduced alphabet.

Words are runs of letters counted over all texts.  Every letter is hashed to one of a few symbols
(its code point modulo ``symbols``), so many words share a reduced word.  The full one-edit
neighbourhood of each distinct reduced word (itself, every deletion, replacement and insertion over
the symbols) is generated and joined with the reduced vocabulary; the words behind two matching
reduced words are candidates, and an edit distance of exactly one is verified on the words.  Two words
one edit apart have reduced words at most one edit apart, so no pair is lost.

Neighbours are made as 64-bit polynomial hashes, in time and memory proportional to the word's length
times the symbols; each neighbour is made once (a deletion only at the begin of a run of equal symbols,
an insertion not after its own symbol).  A collision only adds a candidate.

Rules for special cases: a null text has no words; a null key counts as empty in the sampling of
deletions; repeated rows count each time; a word of any length is treated whole; among equally frequent
near words the smallest in code-point order is the form.  Columns other than the two named are not read.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from perennial.functions.storage import materialize
from perennial.llm.textops import mix64, pieces, utf8

SYMBOLS = 8
LEAST_LENGTH = 6
LEAST_COUNT = 5
#: A near word is a word's form if it is this many times as frequent.
TIMES = 5
#: Every run whose checksum is a multiple of this loses a letter.
SAMPLED = 199
#: Bytes of text whose runs are counted at once; a longer text is counted by itself.
COUNTED_BYTES = 1 << 22
#: Neighbours of reduced words made at once.
BLOCK = 1 << 19
#: Bytes of a run up to which checksums are made for many runs at once.
_SHORT = 48

#: The letters: A-Z become a-z, U+00C0 to U+00FF stay.
LETTERS = [*range(0x61, 0x7B), *range(0xC0, 0x100)]
_U = np.uint64
_BASE = 0xA24BAED4963EE407
_BACK = pow(_BASE, -1, 1 << 64)


# --- runs and their counts -------------------------------------------------------------------


def _checksum_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> 1) ^ np.uint32(0xEDB88320), table >> 1).astype(np.uint32)
    return table


_CHECKSUM = _checksum_table()
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[0x41:0x5B] += 32
_ASCII_LETTER = np.zeros(256, bool)
_ASCII_LETTER[0x41:0x5B] = _ASCII_LETTER[0x61:0x7B] = True


def checksums(letters: np.ndarray, first: np.ndarray, length: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """crc32 of each run ``letters[first:first + length]``, continued from the checksum ``begin``."""
    order = np.argsort(np.minimum(length, _SHORT + 1).astype(np.uint8), kind="stable")[::-1]
    sizes, places, state = length[order], first[order], ~begin[order].astype(np.uint32)
    long = int(np.searchsorted(-sizes, -_SHORT, "left"))
    for at in range(int(sizes[long]) if long < len(sizes) else 0):
        n = int(np.searchsorted(-sizes, -at, "left"))
        part = state[long:n]
        byte = letters[places[long:n] + at]
        state[long:n] = _CHECKSUM[(part ^ byte) & np.uint32(255)] ^ (part >> np.uint32(8))
    out = np.empty(len(order), np.uint32)
    out[order] = ~state
    for i in order[:long]:
        run = letters[first[i] : first[i] + length[i]].tobytes()
        out[i] = zlib.crc32(run, int(begin[i]))
    return out


def count_runs(
    data: np.ndarray, bounds: np.ndarray, begins: np.ndarray, sampled: int = SAMPLED, least: int = LEAST_LENGTH
) -> tuple[list[str], list[int]]:
    """Words of at least ``least`` letters and their counts in some texts; ``begins`` has the checksum
    of each text's key and colon."""
    pair = data == 0xC3
    inside = _ASCII_LETTER[data] | pair
    inside[1:] |= pair[:-1]
    opens = inside.copy()
    opens[1:] &= ~inside[:-1]
    edge = bounds[:-1][bounds[:-1] < len(data)]
    opens[edge] = inside[edge]
    starts = np.flatnonzero(opens)
    letters = _FOLD[data[inside]]
    first = np.zeros(len(starts) + 1, np.int64)
    held = np.zeros(len(data) + 1, np.int64)
    np.cumsum(inside, out=held[1:])
    first[:-1], first[-1] = held[starts], len(letters)
    wide = np.zeros(len(letters) + 1, np.int64)
    np.cumsum(letters == 0xC3, out=wide[1:])
    points = np.diff(first) - np.diff(wide[first])
    enough = np.flatnonzero(points >= least)
    size = np.diff(first)[enough]
    if not len(enough):
        return [], []
    of_text = np.searchsorted(bounds, starts[enough], "right") - 1
    crc = checksums(letters, first[:-1][enough], size, begins[of_text])
    words = pa.LargeStringArray.from_buffers(
        len(starts), pa.py_buffer(first), pa.py_buffer(np.ascontiguousarray(letters))
    ).take(pa.array(enough))
    coded = words.dictionary_encode()
    index = coded.indices.to_numpy()
    counts = np.bincount(index, minlength=len(coded.dictionary))
    hit = np.flatnonzero(crc % np.uint32(sampled) == 0)
    np.subtract.at(counts, index[hit], 1)
    found = coded.dictionary.to_pylist()
    changed: Counter[str] = Counter()
    for i in hit:
        word = found[index[i]]
        at = int(crc[i]) % len(word)
        if len(word) > least:
            changed[word[:at] + word[at + 1 :]] += 1
    left = np.flatnonzero(counts)
    return [found[i] for i in left] + list(changed), [*counts[left].tolist(), *changed.values()]


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, bounds = utf8(batch.column(1))
        keys = ["" if k is None else str(k) for k in batch.column(0).to_pylist()]
        begins = np.array([zlib.crc32(f"{k}:".encode()) for k in keys], np.uint32)
        for lo, hi in pieces(bounds, COUNTED_BYTES):
            part = data[bounds[lo] : bounds[hi]]
            words, counts = count_runs(part, bounds[lo : hi + 1] - bounds[lo], begins[lo:hi])
            yield pa.RecordBatch.from_arrays(
                [pa.array(words, pa.string()), pa.array(counts, pa.int64())], names=["word", "n"]
            )


def vocabulary(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``word``, ``n``: the words with at least ``LEAST_LENGTH`` letters and ``LEAST_COUNT`` occurrences."""
    rows = docs.select(F.col(f"`{key}`"), F.col(f"`{text}`").cast("string"))
    counts = rows.mapInArrow(_counted, "word string, n long")
    return counts.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST_COUNT)


# --- reduced words and their neighbourhoods --------------------------------------------------


def reduced(word, symbols: int = SYMBOLS):
    """Column of the reduced word: each letter's symbol, written as a letter from ``a`` on."""
    return F.translate(word, "".join(map(chr, LETTERS)), "".join(chr(0x61 + c % symbols) for c in LETTERS))


def _values(symbols: int) -> np.ndarray:
    return mix64(np.arange(1, symbols + 1, dtype=_U))


def _powers(n: int) -> np.ndarray:
    up = np.full(n + 2, _U(_BASE))
    up[0] = 1
    return np.multiply.accumulate(up)


def codes(words: np.ndarray, symbols: int = SYMBOLS) -> np.ndarray:
    """Hash of each row of a matrix of symbol numbers."""
    return (_values(symbols)[words] * _powers(words.shape[1])[: words.shape[1]]).sum(axis=1, dtype=_U)


def neighbourhood(words: np.ndarray, lo: int, hi: int, symbols: int = SYMBOLS) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers and hashes of the one-edit neighbours made at places ``lo`` to ``hi`` (of the ``L + 1``
    places of words of ``L`` symbols), each neighbour at one place only; place 0 also makes the word."""
    n, size = words.shape
    value, up = _values(symbols), _powers(size)
    terms = value[words] * up[:size]
    before = np.zeros((n, size + 1), _U)
    np.cumsum(terms, axis=1, out=before[:, 1:])
    whole = before[:, -1]
    owner: list[np.ndarray] = []
    made: list[np.ndarray] = []
    if lo == 0:
        owner.append(np.arange(n))
        made.append(whole)
    last = min(hi, size)
    if lo < last:
        at = np.arange(lo, last)
        previous = np.where(at > 0, words[:, np.maximum(at - 1, 0)], symbols)
        rows, cols = np.nonzero(words[:, lo:last] != previous)
        at = cols + lo
        owner.append(rows)
        made.append(before[rows, at] + (whole[rows] - before[rows, at + 1]) * _U(_BACK))
    for c in range(symbols):
        if lo < last:
            rows, cols = np.nonzero(words[:, lo:last] != c)
            at = cols + lo
            owner.append(rows)
            made.append(whole[rows] - terms[rows, at] + value[c] * up[at])
        at = np.arange(lo, hi)
        previous = np.where(at > 0, words[:, np.maximum(at - 1, 0)], symbols)
        rows, cols = np.nonzero(previous != c)
        at = cols + lo
        owner.append(rows)
        made.append(before[rows, at] + value[c] * up[at] + (whole[rows] - before[rows, at]) * _U(_BASE))
    return np.concatenate(owner), np.concatenate(made)


def _matrices(words: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Words of equal length as matrices of symbol numbers, with their places in ``words``."""
    data, bounds = utf8(words)
    sizes = np.diff(bounds)
    for size in np.unique(sizes):
        at = np.flatnonzero(sizes == size)
        yield at, data[bounds[at][:, None] + np.arange(size)].astype(np.int64) - 0x61


@F.arrow_udf(LongType())
def _code(words: pa.Array) -> pa.Array:
    out = np.zeros(len(words), np.int64)
    for at, matrix in _matrices(words):
        step = max(1, BLOCK // max(1, matrix.shape[1]))
        for lo in range(0, len(at), step):
            out[at[lo : lo + step]] = codes(matrix[lo : lo + step]).view(np.int64)
    return pa.array(out)


def _neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for _, matrix in _matrices(batch.column(0)):
            size = matrix.shape[1]
            step = max(1, BLOCK // ((size + 1) * 2 * SYMBOLS))
            wide = max(1, BLOCK // (2 * SYMBOLS))
            for lo in range(0, len(matrix), step):
                part = matrix[lo : lo + step]
                own = codes(part).view(np.int64)
                for place in range(0, size + 1, wide):
                    rows, near = neighbourhood(part, place, min(size + 1, place + wide))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(own[rows]), pa.array(near.view(np.int64))], names=["code", "near_code"]
                    )


def near_words(words: DataFrame) -> DataFrame:
    """All ordered pairs ``word``, ``n``, ``near``, ``near_n`` of words one edit apart.

    ``words`` has ``word`` and ``n``, each word once.  Reduced words are joined with reduced words; only
    matching ones are expanded to the words behind them.
    """
    coded = materialize(
        words.withColumn("reduced", reduced(F.col("word"))).withColumn("code", _code("reduced")), "words"
    )
    around = coded.select("reduced").distinct().mapInArrow(_neighbours, "code long, near_code long")
    known = coded.select(F.col("code").alias("near_code")).distinct()
    matched = around.join(known, "near_code")
    left = coded.select("code", "word", "n")
    right = coded.select(
        F.col("code").alias("near_code"), F.col("word").alias("near"), F.col("n").alias("near_n")
    )
    one_apart = F.levenshtein(F.col("word"), F.col("near"), 1) == 1
    return matched.join(left, "code").join(right, "near_code").where(one_apart).select("word", "n", "near", "near_n")


# --- forms and roots -------------------------------------------------------------------------


def _follow(forms: DataFrame) -> DataFrame:
    """``word``, ``root`` for words with a form, by doubling the steps: a form is several times as
    frequent as its word, so chains are short and few rounds end them."""
    reached = materialize(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        on = reached.select(F.col("word").alias("root"), F.col("root").alias("beyond"))
        further = materialize(
            reached.join(on, "root", "left").select(
                "word", F.coalesce("beyond", "root").alias("root"), F.col("beyond").isNotNull().alias("moved")
            ),
            "roots",
        )
        reached = further.select("word", "root")
        if further.where("moved").isEmpty():
            return reached


def spelling_variants(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per word: ``word``, ``n``, ``n_near`` (its near words), ``form`` (its near word of largest
    ``n``, if that is ``TIMES`` times its own), ``form_n`` and ``root`` (the last form when followed)."""
    words = materialize(vocabulary(docs, key, text), "vocabulary")
    best = F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near").alias("near")))
    around = (
        near_words(words)
        .groupBy("word")
        .agg(F.count_distinct("near").alias("n_near"), best.alias("best"))
        .select("word", "n_near", F.col("best.near").alias("best"), (-F.col("best.less")).alias("best_n"))
    )
    formed = F.col("best_n") >= TIMES * F.col("n")
    known = materialize(
        words.join(around, "word", "left").select(
            "word",
            "n",
            F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
            F.when(formed, F.col("best")).alias("form"),
            F.when(formed, F.col("best_n")).alias("form_n"),
        ),
        "forms",
    )
    roots = _follow(known.where("form IS NOT NULL"))
    return known.join(roots, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"
    )
