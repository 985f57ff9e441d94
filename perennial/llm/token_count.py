"""Token counts by heap-and-linked-list byte-pair merging.

A text is cut by the byte-level pattern into pieces.  The symbols of a piece (its bytes) form a
linked list; a heap holds the rank of every adjacent pair that can merge.  The lowest rank is popped
(the leftmost of equal ranks), its two symbols become one, and the two new neighbours are pushed.
A piece has as many tokens as symbols at the start minus merges, so no identifiers are made.

Rules for special cases: a null text counts as empty (0 bytes, 0 tokens); special strings of the
vocabulary inside a text are one token each, as the tokenizer library reads them by default;
repeated rows get equal counts; every text is read to its end.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from functools import cache
from heapq import heapify, heappop, heappush

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from perennial.llm.textops import unused

#: Fixed value: the piece pattern of byte-level vocabularies.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Counts of recent pieces that a process remembers; it starts anew when full.
REMEMBERED = 700_000
#: Longer pieces are counted each time, so that the remembered ones stay small.
LONGEST_REMEMBERED = 64


def byte_symbols() -> dict[str, int]:
    """The printable character that stands for each byte in a byte-level vocabulary file."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


class MergeTable:
    """Ranks of the merges.  Symbols are numbered, bytes first; ``merges`` is keyed by both at once."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        number = dict(byte_symbols())
        self.merges: dict[int, int] = {}
        self.made: list[int] = []
        for rank, pair in enumerate(spec["model"]["merges"]):
            left, right = pair.split(" ") if isinstance(pair, str) else pair
            self.made.append(number.setdefault(left + right, len(number)))
            self.merges[number[left] << 32 | number[right]] = rank
        self.special = [t["content"] for t in spec.get("added_tokens") or []]

    def count(self, piece: bytes) -> int:
        """Tokens of one piece.  Heap entries hold the rank above the place of the left symbol."""
        n = len(piece)
        if n < 2:
            return n
        rank_of, made = self.merges.get, self.made
        symbols = [*piece, 0]
        heap = []
        for i in range(n - 1):
            rank = rank_of(symbols[i] << 32 | symbols[i + 1])
            if rank is not None:
                heap.append(rank << 40 | i)
        if not heap:
            return n
        heapify(heap)
        after, before = list(range(1, n + 2)), list(range(-1, n))
        tokens = n
        while heap:
            top = heappop(heap)
            i, rank = top & 0xFFFFFFFFFF, top >> 40
            j = after[i]
            left = symbols[i]
            if left < 0 or j >= n or rank_of(left << 32 | symbols[j]) != rank:
                continue
            symbols[i] = new = made[rank]
            symbols[j] = -1
            after[i] = k = after[j]
            before[k] = i
            tokens -= 1
            if k < n:
                found = rank_of(new << 32 | symbols[k])
                if found is not None:
                    heappush(heap, found << 40 | i)
            h = before[i]
            if h >= 0:
                found = rank_of(symbols[h] << 32 | new)
                if found is not None:
                    heappush(heap, found << 40 | h)
        return tokens


class Pieces(dict):
    """Tokens by piece, for the pieces a process has met lately."""

    def __init__(self, table: MergeTable):
        super().__init__()
        self.count = table.count

    def __missing__(self, piece: str) -> int:
        n = self.count(piece.encode())
        if len(piece) <= LONGEST_REMEMBERED:
            if len(self) >= REMEMBERED:
                self.clear()
            self[piece] = n
        return n


class Counter(dict):
    """Tokens by space and following characters up to the next space.

    Where no space is followed by white space or the end, no piece of the pattern crosses from one
    such part to the next, so their counts add up.  Other texts are cut by the pattern as a whole.
    """

    def __init__(self, path: str):
        super().__init__()
        table = MergeTable(path)
        self.piece = Pieces(table).__getitem__
        self.find = regex.compile(PIECES).findall
        self.crossing = re.compile(r" (?!\S)").search
        special = sorted(table.special, key=len, reverse=True)
        self.special = regex.compile("|".join(map(regex.escape, special))) if special else None

    def __missing__(self, part: str) -> int:
        n = sum(map(self.piece, self.find(" " + part)))
        if len(part) <= LONGEST_REMEMBERED:
            if len(self) >= REMEMBERED:
                self.clear()
            self[part] = n
        return n

    def _plain(self, text: str) -> int:
        if self.crossing(text):
            return sum(map(self.piece, self.find(text)))
        first, *rest = text.split(" ")
        return sum(map(self.piece, self.find(first))) + sum(map(self.__getitem__, rest))

    def of(self, text: str) -> int:
        if self.special is not None and self.special.search(text):
            parts = self.special.split(text)
            return len(parts) - 1 + sum(map(self._plain, parts))
        return self._plain(text)


@cache
def counter(path: str) -> Counter:
    """One for each process, so that later tasks find the pieces of earlier ones."""
    return Counter(path)


def counter_udf(vocabulary: str):
    """Arrow function from texts to token counts; reads the vocabulary file once per process."""

    @F.arrow_udf("long")
    def count(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        of = counter(vocabulary).of
        for texts in batches:
            yield pa.array([of(t.as_py() or "") for t in texts], pa.int64())

    return count


def with_token_counts(
    docs: DataFrame, vocabulary: str, limit: int = 1024, text: str = "text"
) -> DataFrame:
    """Add ``n_bytes``, ``n_tokens`` and ``over_limit`` (more than ``limit`` tokens) to each row.

    ``vocabulary`` is the path of a byte-level vocabulary file present on every machine.  Columns of
    ``docs`` with one of the three names are replaced; others are kept.
    """
    made = ("n_bytes", "n_tokens", "over_limit")
    spare = unused(docs, "_tokens")
    counted = docs.withColumn(spare, counter_udf(vocabulary)(F.col(f"`{text}`")))
    kept = [F.col(f"`{c}`") for c in docs.columns if c not in made]
    return counted.select(
        *kept,
        F.coalesce(F.octet_length(F.col(f"`{text}`")), F.lit(0)).cast("long").alias("n_bytes"),
        F.col(spare).alias("n_tokens"),
        (F.col(spare) > limit).alias("over_limit"),
    )
