"""Token identifiers in wavelet matrices: one compressed, searchable file per shard of documents.

Documents are dealt into ranges of keys, encoded, and every document's identifiers and an end
identifier are appended to its shard.  A shard is a wavelet matrix: one bit-plane per bit of an
identifier, highest first, each plane ordered by the bits above it (zeros before ones).  With the counts
of ones before every block, a plane answers rank and select, so that the identifier at a place, the
occurrences of an identifier in a range and the place of its k-th occurrence need one step per plane.

A shard's bytes (little-endian): ``WMTX``, version, width, identifiers, documents, then sections, each
with its raw and its stored size and zstd-compressed: keys, presence of keys, tokens per document, zeros
per plane, and for each plane its bits and its block counts; at the end the crc32 of all before.  They
are written by Spark's Parquet writer as the one row of a file of their own, so that they go to any
store that Spark writes to, and a task that is run again replaces what its first run left.

Rules for special cases: a null text counts as empty, so it has the end identifier alone; null keys come
last, equal keys in the order of a hash of their texts; repeated rows are all kept; keys are cast to
``long``; a document lies in one shard whatever its length; an empty table has no shards.  Other columns
of the documents are not read.
"""

from __future__ import annotations

import json
import os
import struct
import zlib
from collections.abc import Iterator, Sequence
from functools import cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from perennial.functions.storage import materialize
from perennial.llm.textops import pieces, utf8

#: A shard is closed with the document that brings it to this many identifiers.
SHARD_TOKENS = 1 << 22
#: Bytes of text encoded at once; a longer text is encoded by itself.
ENCODED_BYTES = 1 << 23
#: Parts of texts, and identifiers of parts, that a process remembers; then it keeps those met again
#: since, or none if these are more than half.
REMEMBERED, REMEMBERED_IDS = 500_000, 4_000_000
#: New parts given to the library as one text.
JOINED = 1000
#: Bits per block whose ones are counted.
BLOCK_BITS = 512
_WORDS = BLOCK_BITS // 64


# --- encoding --------------------------------------------------------------------------------

_OTHER, _LETTER, _DIGIT, _MARK, _QUOTE, _SPACE, _BLANK = range(7)


def _classes() -> np.ndarray:
    out = np.full(256, _OTHER, np.uint8)
    out[0x21:0x7F] = _MARK
    out[0x41:0x5B] = out[0x61:0x7B] = _LETTER
    out[0x30:0x3A] = _DIGIT
    out[0x27], out[0x20], out[0x09:0x0E] = _QUOTE, _SPACE, _BLANK
    return out


def _cuts() -> np.ndarray:
    """Pairs of classes of adjacent bytes between which a piece of the byte-level pattern always ends."""
    out = np.zeros((8, 8), bool)
    for before in (_LETTER, _DIGIT, _MARK, _QUOTE):
        out[before, [_SPACE, _BLANK]] = True
    out[_LETTER, [_DIGIT, _MARK, _QUOTE]] = True
    out[_DIGIT, [_LETTER, _MARK, _QUOTE]] = True
    out[_MARK, [_LETTER, _DIGIT]] = True
    return out.ravel()


_CLASS, _CUT = _classes(), _cuts()


def _cut_anywhere(spec: dict) -> bool:
    """Whether a vocabulary file encodes texts by the plain byte-level pattern, so that the parts between
    two ends of pieces can be encoded one by one."""
    first = spec.get("pre_tokenizer") or {}
    plain = first.get("type") == "ByteLevel" and first.get("use_regex", True) and not first.get("add_prefix_space")
    tokens = spec.get("added_tokens") or []
    strict = not any(t.get("single_word") or t.get("lstrip") or t.get("rstrip") for t in tokens)
    return bool(plain and strict and spec.get("normalizer") is None and not spec["model"].get("dropout"))


class _Slots(dict):
    """Numbers parts of texts as they come; new ones wait in ``new``."""

    def __init__(self):
        super().__init__()
        self.new: list[str] = []

    def __missing__(self, part: str) -> int:
        self[part] = slot = len(self)
        self.new.append(part)
        return slot


class Encoder:
    """Identifiers of texts as the tokenizer library gives them, without added special tokens.

    Where the vocabulary allows it, texts are cut between pieces and the library encodes each part that
    the process doesn't remember; else it encodes whole texts.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.cuts = _cut_anywhere(spec)
        self.special = [t["content"].encode() for t in spec.get("added_tokens") or [] if t["content"]]
        vocabulary = self.library.get_vocab(with_added_tokens=True)
        self.width = max(1, max(vocabulary.values(), default=0).bit_length())
        self.joins = self.cuts and not any(b" " in s for s in self.special)
        #: Bytes of each identifier: a byte-level vocabulary writes one character for a byte.
        self.bytes = np.zeros(1 << self.width, np.int64)
        for token, number in vocabulary.items():
            self.bytes[number] = len(token)
        self.slots = _Slots()
        self.first = np.zeros(1, np.int64)
        self.ids = np.zeros(0, np.uint32)
        self.again = np.zeros(0, bool)

    def _forget(self) -> None:
        """Keep the parts that were met again."""
        kept = np.flatnonzero(self.again)
        if 2 * len(kept) > len(self.again) or 2 * int(np.diff(self.first)[kept].sum()) > REMEMBERED_IDS:
            kept = kept[:0]
        parts, size = list(self.slots), np.diff(self.first)[kept]
        self.slots = _Slots()
        for i in kept:
            self.slots[parts[i]] = len(self.slots)
        before, self.first = self.first[kept], np.concatenate([[0], np.cumsum(size)])
        self.ids = self.ids[np.repeat(before - self.first[:-1], size) + np.arange(self.first[-1])]
        self.again = np.zeros(len(kept), bool)

    def _library(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        found = [e.ids for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        return np.fromiter(chain.from_iterable(found), np.uint32, int(sizes.sum())), sizes

    def _new(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Identifiers of new parts, one after the other.  Parts that open with a space and close with
        a visible ASCII character are given to the library joined, since a piece ends between any two; the
        identifiers' bytes tell them apart."""
        if not self.joins:
            return self._library(parts)
        joined = np.array([p[0] == " " and "!" <= p[-1] <= "~" for p in parts], bool)
        alone, together = np.flatnonzero(~joined), np.flatnonzero(joined)
        ids, sizes = self._library([parts[i] for i in alone])
        texts = [
            "".join(parts[i] for i in together[lo : lo + JOINED]) for lo in range(0, len(together), JOINED)
        ]
        more, _ = self._library(texts)
        ends = np.cumsum(np.fromiter((len(parts[i].encode()) for i in together), np.int64, len(together)))
        stops = np.searchsorted(np.cumsum(self.bytes[more]), ends) + 1
        order = np.argsort(np.concatenate([alone, together]))
        sizes = np.concatenate([sizes, np.diff(stops, prepend=0)])
        first = np.cumsum(sizes) - sizes
        first, sizes = first[order], sizes[order]
        begin = np.cumsum(sizes) - sizes
        ids = np.concatenate([ids, more])
        return ids[np.repeat(first - begin, sizes) + np.arange(len(ids))], sizes

    def _parts(self, data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """Where the parts of texts begin, and the end."""
        cut = np.zeros(len(data) + 1, bool)
        kinds = _CLASS[data]
        cut[1:-1] = _CUT[kinds[:-1] * np.uint8(8) + kinds[1:]]
        # after a character of two bytes that is no white space
        blank = np.flatnonzero((kinds[2:] >= _SPACE) & (data[1:-1] >= 0x80)) + 2
        lead = data[blank - 2]
        cut[blank[(lead >= 0xC3) & (lead < 0xE0)]] = True
        raw = data.tobytes() if self.special else b""
        for special in self.special:
            at = raw.find(special)
            while at >= 0:
                cut[at + 1 : at + len(special)] = False
                cut[at] = cut[at + len(special)] = True
                at = raw.find(special, at + len(special))
        cut[bounds] = True
        return np.flatnonzero(cut)

    def encode(self, data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Identifiers of consecutive texts given as bytes, and how many each text has."""
        if not len(data):
            return np.zeros(0, np.uint32), np.zeros(len(bounds) - 1, np.int64)
        if not self.cuts:
            raw = data.tobytes()
            return self._library([raw[a:b].decode() for a, b in zip(bounds[:-1], bounds[1:])])
        if len(self.slots) > REMEMBERED or len(self.ids) > REMEMBERED_IDS:
            self._forget()
        begins = self._parts(data, bounds)
        parts = pa.LargeStringArray.from_buffers(
            len(begins) - 1, pa.py_buffer(begins), pa.py_buffer(np.ascontiguousarray(data))
        ).dictionary_encode()
        distinct = parts.dictionary.to_pylist()
        known = len(self.slots)
        slot = np.fromiter(map(self.slots.__getitem__, distinct), np.int64, len(distinct))
        self.again[slot[slot < known]] = True
        if self.slots.new:
            ids, sizes = self._new(self.slots.new)
            self.slots.new = []
            self.again = np.concatenate([self.again, np.zeros(len(sizes), bool)])
            self.first = np.concatenate([self.first, self.first[-1] + np.cumsum(sizes)])
            self.ids = np.concatenate([self.ids, ids])
        slot = slot[parts.indices.to_numpy()]
        size = self.first[slot + 1] - self.first[slot]
        ends = np.zeros(len(size) + 1, np.int64)
        np.cumsum(size, out=ends[1:])
        ids = self.ids[np.repeat(self.first[slot] - ends[:-1], size) + np.arange(ends[-1])]
        return ids, np.diff(ends[np.searchsorted(begins, bounds)])


@cache
def encoder(path: str) -> Encoder:
    """One for each process."""
    return Encoder(path)


# --- wavelet matrix --------------------------------------------------------------------------


class WaveletMatrix:
    """A sequence of ``n`` numbers below ``2 ** width`` as bit-planes with counts of ones.

    ``planes`` hold 64-bit words, a multiple of a block; ``ones`` the ones before each block and at the end.
    """

    def __init__(self, width: int, n: int, zeros: np.ndarray, planes: list[np.ndarray], ones: list[np.ndarray]):
        self.width, self.n, self.zeros, self.planes, self.ones = width, n, zeros, planes, ones

    @classmethod
    def build(cls, values: np.ndarray, width: int) -> WaveletMatrix:
        n = len(values)
        values = values.astype(np.uint16 if width <= 16 else np.uint32)
        blocks = -(-n // BLOCK_BITS)
        zeros, planes, ones = np.zeros(width, np.int64), [], []
        for level in range(width):
            bit = (values >> values.dtype.type(width - 1 - level)) & values.dtype.type(1) != 0
            plane = np.zeros(blocks * BLOCK_BITS // 8, np.uint8)
            packed = np.packbits(bit, bitorder="little")
            plane[: len(packed)] = packed
            words = plane.view("<u8")
            counts = np.zeros(blocks + 1, np.int64)
            np.cumsum(np.bitwise_count(words).reshape(-1, _WORDS).sum(axis=1), out=counts[1:])
            low = values[~bit]
            zeros[level] = len(low)
            planes.append(words)
            ones.append(counts)
            values = np.concatenate([low, values[bit]])
        return cls(width, n, zeros, planes, ones)

    def _bits(self, level: int) -> np.ndarray:
        return np.unpackbits(self.planes[level].view(np.uint8), count=self.n, bitorder="little").view(bool)

    def decode(self) -> np.ndarray:
        """The whole sequence, from the lowest plane up."""
        kind = np.uint16 if self.width <= 16 else np.uint32
        values = np.zeros(self.n, kind)
        for level in reversed(range(self.width)):
            bit, z = self._bits(level), self.zeros[level]
            above = np.empty(self.n, kind)
            above[~bit] = values[:z]
            above[bit] = values[z:] | kind(1 << (self.width - 1 - level))
            values = above
        return values

    def _rank(self, level: int, places: np.ndarray) -> np.ndarray:
        """Ones before each place."""
        words, block = self.planes[level], places // BLOCK_BITS
        out = self.ones[level][block].copy()
        rest = places - block * BLOCK_BITS
        for j in range(_WORDS):
            some = np.flatnonzero(rest > 64 * j)
            if not len(some):
                break
            word = words[block[some] * _WORDS + j]
            left = np.minimum(rest[some] - 64 * j, 64).astype(np.uint64)
            mask = np.where(left == 64, ~np.uint64(0), (np.uint64(1) << (left & np.uint64(63))) - np.uint64(1))
            out[some] += np.bitwise_count(word & mask)
        return out

    def _select(self, level: int, which: np.ndarray, bit: int) -> np.ndarray:
        """Place of the one (or zero) of each number, counted from 0."""
        ones = self.ones[level]
        before = ones if bit else np.arange(len(ones)) * BLOCK_BITS - ones
        block = np.searchsorted(before, which, "right") - 1
        words = self.planes[level].reshape(-1, _WORDS)
        out = np.empty(len(which), np.int64)
        for lo in range(0, len(which), 4096):
            at = block[lo : lo + 4096]
            bits = np.unpackbits(words[at].view(np.uint8), axis=1, bitorder="little") == bit
            seen = np.cumsum(bits, axis=1, dtype=np.int32)
            inside = (seen > (which[lo : lo + 4096] - before[at])[:, None]).argmax(axis=1)
            out[lo : lo + 4096] = at * BLOCK_BITS + inside
        return out

    def access(self, places: Sequence[int]) -> np.ndarray:
        """The numbers at some places."""
        at = np.asarray(places, np.int64)
        if len(at) and not (0 <= at.min() and at.max() < self.n):
            raise IndexError("place outside the sequence")
        out = np.zeros(len(at), np.int64)
        for level in range(self.width):
            words = self.planes[level]
            bit = (words[at // 64] >> (at % 64).astype(np.uint64)) & np.uint64(1) == 1
            ones = self._rank(level, at)
            out = out << 1 | bit
            at = np.where(bit, self.zeros[level] + ones, at - ones)
        return out

    def _range(self, value: int, lo: int, hi: int) -> tuple[int, int]:
        """Where the occurrences of a number among places ``lo`` to ``hi`` stand below the lowest plane."""
        if not 0 <= value < 1 << self.width:
            return 0, 0
        ends = np.array([lo, hi], np.int64)
        for level in range(self.width):
            ones = self._rank(level, ends)
            bit = value >> (self.width - 1 - level) & 1
            ends = self.zeros[level] + ones if bit else ends - ones
        return int(ends[0]), int(ends[1])

    def count(self, value: int, lo: int = 0, hi: int | None = None) -> int:
        """Occurrences of a number among places ``lo`` to ``hi`` (exclusive; the end if not given)."""
        a, b = self._range(value, lo, self.n if hi is None else hi)
        return b - a

    def places(self, value: int, first: int = 0, last: int | None = None) -> np.ndarray:
        """Places of the occurrences numbered ``first`` to ``last`` (exclusive) of a number."""
        a, b = self._range(value, 0, self.n)
        at = np.arange(min(b, a + first), b if last is None else min(b, a + last))
        for level in reversed(range(self.width)):
            if value >> (self.width - 1 - level) & 1:
                at = self._select(level, at - self.zeros[level], 1)
            else:
                at = self._select(level, at, 0)
        return at


# --- shard files -----------------------------------------------------------------------------

_HEAD = struct.Struct("<4sHHQQ")
_SECTION = struct.Struct("<QQ")


class Shard:
    """Documents of one file: ``keys`` (masked where null), ``ends`` of their tokens, ``matrix``."""

    def __init__(self, keys: np.ndarray, present: np.ndarray, sizes: np.ndarray, matrix: WaveletMatrix):
        self.keys, self.present, self.matrix = keys, present, matrix
        self.ends = np.cumsum(sizes)

    def to_bytes(self) -> bytes:
        m = self.matrix
        sections = [
            self.keys.astype("<i8"),
            self.present.astype(np.uint8),
            np.diff(self.ends, prepend=0).astype("<u4"),
            m.zeros.astype("<i8"),
            *chain.from_iterable((p, o.astype("<u4")) for p, o in zip(m.planes, m.ones)),
        ]
        out = [_HEAD.pack(b"WMTX", 1, m.width, m.n, len(self.keys))]
        for section in sections:
            raw = np.ascontiguousarray(section).tobytes()
            packed = pa.compress(raw, "zstd", asbytes=True)
            out += [_SECTION.pack(len(raw), len(packed)), packed]
        body = b"".join(out)
        return body + struct.pack("<I", zlib.crc32(body))

    @classmethod
    def from_bytes(cls, body: bytes) -> Shard:
        if len(body) < _HEAD.size + 4 or zlib.crc32(memoryview(body)[:-4]) != struct.unpack("<I", body[-4:])[0]:
            raise ValueError("damaged shard")
        magic, version, width, n, _ = _HEAD.unpack_from(body)
        if (magic, version) != (b"WMTX", 1):
            raise ValueError("not a shard")
        at = _HEAD.size

        def section(kind: str) -> np.ndarray:
            nonlocal at
            raw, packed = _SECTION.unpack_from(body, at)
            at += _SECTION.size + packed
            return np.frombuffer(pa.decompress(body[at - packed : at], raw, "zstd", asbytes=True), kind)

        keys, present, sizes, zeros = section("<i8"), section("u1") != 0, section("<u4"), section("<i8")
        planes, ones = [], []
        for _ in range(width):
            planes.append(section("<u8"))
            ones.append(section("<u4").astype(np.int64))
        return cls(keys, present, sizes.astype(np.int64), WaveletMatrix(width, n, zeros, planes, ones))


# --- Spark -----------------------------------------------------------------------------------

STORE = "part int, shard int, n_docs long, n_tokens long, body binary"


def _shards(vocabulary: str, end: int, shard_tokens: int):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number = TaskContext.get().partitionId(), 0
        coder = encoder(vocabulary)
        keys, sizes, ids, held = [], [], [], 0

        def closed() -> pa.RecordBatch:
            key = pa.concat_arrays(keys)
            size = np.concatenate(sizes)
            matrix = WaveletMatrix.build(np.concatenate(ids), max(coder.width, int(end).bit_length()))
            shard = Shard(
                key.fill_null(0).to_numpy(zero_copy_only=False), ~key.is_null().to_numpy(zero_copy_only=False), size, matrix
            )
            row = [[part], [number], [len(size)], [matrix.n], [shard.to_bytes()]]
            types = (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary())
            return pa.RecordBatch.from_arrays(
                [pa.array(v, t) for v, t in zip(row, types)], names=["part", "shard", "n_docs", "n_tokens", "body"]
            )

        for batch in batches:
            data, bounds = utf8(batch.column(1))
            key = batch.column(0)
            for lo, hi in pieces(bounds, ENCODED_BYTES):
                found, n = coder.encode(data[bounds[lo] : bounds[hi]], bounds[lo : hi + 1] - bounds[lo])
                size = n + 1
                ends = np.cumsum(size)
                own = np.empty(int(ends[-1]), np.uint32)
                tail = np.zeros(len(own), bool)
                tail[ends - 1] = True
                own[tail], own[~tail] = end, found
                start, at = 0, 0
                while start < hi - lo:
                    room = shard_tokens - held
                    stop = min(hi - lo, int(np.searchsorted(ends, at + room, "left")) + 1)
                    upto = int(ends[stop - 1])
                    keys.append(key.slice(lo + start, stop - start))
                    sizes.append(size[start:stop])
                    ids.append(own[at:upto])
                    held += upto - at
                    start, at = stop, upto
                    if held >= shard_tokens:
                        yield closed()
                        keys, sizes, ids, held, number = [], [], [], 0, number + 1
        if keys:
            yield closed()

    return write


def write_shards(
    docs: DataFrame,
    vocabulary: str,
    end: int = 0,
    shard_tokens: int = SHARD_TOKENS,
    key: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """Encode every text, append ``end`` to each, and write the shards in ascending key order, one file
    each, to the shared folder.  Returns the table that reads them: ``part`` and ``shard`` number the
    shards in key order, ``body`` is the file's content.

    Texts are shuffled once, into ranges of (key, hash of text, row number), so rows of one key or equal
    rows are spread over tasks too.
    """
    rows = docs.select(
        F.col(f"`{key}`").cast("long").alias("key"),
        F.col(f"`{text}`").cast("string").alias("text"),
        F.xxhash64(F.col(f"`{text}`")).alias("hash"),
        F.monotonically_increasing_id().alias("row"),
    )
    order = [F.asc_nulls_last("key"), F.col("hash"), F.col("row")]
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("key", "text")
    shards = ranged.mapInArrow(_shards(vocabulary, end, shard_tokens), STORE)
    return materialize(shards, "shards", maxRecordsPerFile=1)


def _documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part, number, body in zip(batch.column(0), batch.column(1), batch.column(2)):
            shard = Shard.from_bytes(body.as_py())
            ids, sums, begin = shard.matrix.decode(), [], 0
            for stop in shard.ends.tolist():
                sums.append(zlib.crc32(ids[begin:stop].astype("<u4").data))
                begin = stop
            sizes = np.diff(shard.ends, prepend=0)
            n = len(sizes)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.full(n, part.as_py(), np.int32)),
                    pa.array(np.full(n, number.as_py(), np.int32)),
                    pa.array(shard.keys, mask=~shard.present),
                    pa.array(shard.ends - sizes),
                    pa.array(sizes),
                    pa.array(sums, pa.int64()),
                ],
                names=["part", "shard", "doc_id", "offset", "n_tokens", "ids_crc32"],
            )


def shard_starts(store: DataFrame) -> DataFrame:
    """``part``, ``shard``, ``base``: the tokens before each shard; one row per shard."""
    sizes = store.select("part", "shard", "n_tokens")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    inside = Window.partitionBy("part").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    parts = sizes.groupBy("part").agg(F.sum("n_tokens").alias("n")).select(
        "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("part_base")
    )
    return sizes.join(parts, "part").select(
        "part", "shard", (F.col("part_base") + F.coalesce(F.sum("n_tokens").over(inside), F.lit(0))).alias("base")
    )


def stored_documents(store: DataFrame) -> DataFrame:
    """One row per document, from the files: ``doc_id``, ``start`` (tokens of all documents before it),
    ``n_tokens`` and ``ids_crc32`` (of its identifiers as little-endian unsigned 32-bit integers)."""
    found = store.select("part", "shard", "body").mapInArrow(
        _documents, "part int, shard int, doc_id long, offset long, n_tokens long, ids_crc32 long"
    )
    return found.join(shard_starts(store), ["part", "shard"]).select(
        "doc_id", (F.col("base") + F.col("offset")).alias("start"), "n_tokens", "ids_crc32"
    )


def count_tokens(store: DataFrame, tokens: Sequence[int]) -> DataFrame:
    """``token``, ``n``: occurrences of a stated list of identifiers in all shards, by rank."""
    wanted = sorted({int(t) for t in tokens})

    def count(batches):
        for batch in batches:
            for body in batch.column(0):
                matrix = Shard.from_bytes(body.as_py()).matrix
                n = [matrix.count(t) for t in wanted]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(wanted, pa.int64()), pa.array(n, pa.int64())], names=["token", "n"]
                )

    return store.select("body").mapInArrow(count, "token long, n long").groupBy("token").agg(F.sum("n").alias("n"))


def find_token(store: DataFrame, token: int) -> DataFrame:
    """``doc_id``, ``place``: every occurrence of an identifier, by select; places count from the begin of
    the document."""

    def find(batches):
        for batch in batches:
            for body in batch.column(0):
                shard = Shard.from_bytes(body.as_py())
                at = shard.matrix.places(token)
                doc = np.searchsorted(shard.ends, at, "right")
                begin = np.concatenate([[0], shard.ends])[doc]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(shard.keys[doc], mask=~shard.present[doc]), pa.array(at - begin)],
                    names=["doc_id", "place"],
                )

    return store.select("body").mapInArrow(find, "doc_id long, place long")
