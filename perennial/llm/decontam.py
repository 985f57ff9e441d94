"""Benchmark decontamination with suffix arrays of the documents.

Each task sorts the suffixes of its documents, word by word, into suffix arrays of bounded shards.
Every suffix of a benchmark item that starts a window is binary-searched in every shard: the range that
shares its first ``window`` words gives all places where that window occurs.  Windows that follow each
other in item and document make one match, so the longest run of them is the longest verbatim match;
matches shorter than a window are not looked for.  The documents are scanned once for each block of items and never
shuffled; only documents with hits send rows on.

Words: A-Z lower-cased, runs of ASCII letters, digits and non-ASCII characters.  The arrays order
words by 64-bit hash; documents with hits are compared again word by word as text, so a collision
cannot show in the result.  A window is ``window`` consecutive words of an item; an item of fewer
words, but not none, is one window.  Suffixes are ordered by as many words as the longest item has,
which decides every comparison with an item.

Bounds: items travel to the tasks in blocks of at most ``BLOCK_BYTES`` of text (an item longer than
that is a block of its own); the driver holds one block at a time.  Suffixes are offsets into the words
of a block, so a task's memory is linear in them, however long an item is.  A shard has at most
``SHARD_BYTES`` of text or one document.

Rules for special cases: a null or empty text has no words and no hits; an item that occurs in many
documents, or twice in the benchmark, counts for each; repeated documents get equal results; an
empty table gives no rows, an empty benchmark marks nothing.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from perennial.functions.storage import materialize
from perennial.llm.textops import ALNUM, pieces, split_words, thrifty, unused, utf8

WINDOW = 10
BLOCK_BYTES = 16 << 20
SHARD_BYTES = 1 << 20
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_FOLD = {c: c + 32 for c in range(65, 91)}


def words_of(text: str | None) -> list[str]:
    return _WORD.findall(text.translate(_FOLD)) if text else []


class SuffixArray:
    """Suffixes of a sequence of hashes, ordered by their first ``depth`` words (0 ends a text).

    No search goes past a word that is not in the sorted ``vocabulary``: suffixes are ordered up to
    and including their first such word, which decides every comparison with a test suffix.
    """

    def __init__(self, words: np.ndarray, depth: int, vocabulary: np.ndarray):
        self.words, self.depth = words, depth
        n = len(words)
        near = np.minimum(np.searchsorted(vocabulary, words), max(0, len(vocabulary) - 1))
        searched = vocabulary[near] == words if len(vocabulary) else np.zeros(n, bool)
        order = np.argsort(words)
        rank = self._ranks(words[order], order)
        known = 1
        # places of suffixes that are still to be ordered against others of equal rank
        tied = np.flatnonzero(searched[order])
        while known < depth:
            ranks = rank[order[tied]]
            same = np.zeros(len(tied) + 1, bool)
            same[1:-1] = ranks[1:] == ranks[:-1]
            tied = tied[same[1:] | same[:-1]]
            if not len(tied):
                break
            rows = order[tied]
            follow = rows + known
            key = (rank[rows] << 32) | np.where(follow < n, rank[np.minimum(follow, n - 1)], 0)
            again = np.argsort(key)
            order[tied] = rows[again]
            key = key[again]
            new = np.ones(len(key), bool)
            new[1:] = key[1:] != key[:-1]
            # a rank is one plus the place of the first suffix that has it
            rank[order[tied]] = np.maximum.accumulate(np.where(new, tied, 0)) + 1
            known *= 2
        self.order = order

    @staticmethod
    def _ranks(values: np.ndarray, order: np.ndarray) -> np.ndarray:
        new = np.ones(len(values), bool)
        new[1:] = values[1:] != values[:-1]
        rank = np.empty(len(values), np.int64)
        rank[order] = np.maximum.accumulate(np.where(new, np.arange(len(values)), 0)) + 1
        return rank

    def _compare(self, at: np.ndarray, wanted: np.ndarray, starts: np.ndarray, lengths: np.ndarray):
        """Words that the suffixes share with the sequences of ``wanted`` words, and whether they come
        before them."""
        n, shared = len(self.words), np.zeros(len(at), np.int64)
        before = np.zeros(len(at), bool)
        live = np.arange(len(at))
        for d in range(int(lengths.max(initial=0))):
            live = live[lengths[live] > d]
            if not len(live):
                break
            place = at[live] + d
            here = np.where(place < n, self.words[np.minimum(place, n - 1)], 0)
            there = wanted[starts[live] + d]
            before[live[here < there]] = True
            live = live[here == there]
            shared[live] += 1
        return shared, before

    def search(self, wanted: np.ndarray, starts: np.ndarray, lengths: np.ndarray, upper: bool = False):
        """Place of each sequence, ``lengths`` of the ``wanted`` words from ``starts`` on, in the order:
        first suffix not before it, or (``upper``) first one after all that begin with it."""
        lo = np.zeros(len(starts), np.int64)
        hi = np.full(len(starts), len(self.order), np.int64)
        while True:
            open_ = np.flatnonzero(lo < hi)
            if not len(open_):
                return lo
            middle = (lo[open_] + hi[open_]) // 2
            shared, before = self._compare(self.order[middle], wanted, starts[open_], lengths[open_])
            right = before | ((shared == lengths[open_]) if upper else False)
            lo[open_[right]] = middle[right] + 1
            hi[open_[~right]] = middle[~right]


class Items:
    """The suffixes of one block of benchmark items."""

    def __init__(self, rows: list[tuple[str, str]], window: int):
        self.names = [name for name, _ in rows]
        self.words = [words_of(text) for _, text in rows]
        joined = [" ".join(w) for w in self.words]
        data, bounds = utf8(pa.array(joined, pa.large_string()))
        found = split_words(data, bounds, ALNUM)
        self.window = window
        self.vocabulary = np.unique(found.hashes)
        counts = np.diff(found.first)
        self.item = np.repeat(np.arange(len(rows)), counts)
        self.place = np.arange(len(found.hashes)) - np.repeat(found.first[:-1], counts)
        rest = np.repeat(counts, counts) - self.place
        self.depth = int(counts.max(initial=1))
        #: all words; a suffix is the place of its first word
        self.hashes = found.hashes
        whole = np.repeat(counts, counts)
        #: suffixes that start a window, and the words of that window
        self.starting = np.flatnonzero((rest >= window) | ((self.place == 0) & (whole < window)))
        self.sizes = np.minimum(rest[self.starting], window)


def _shard(data, bounds, items: Items):
    """Words of each text of a shard; matches: text number, suffix, first word in the text, words."""
    found = split_words(data, bounds, ALNUM)
    counts = np.diff(found.first)
    # one end mark (0) follows each text
    n = len(found.hashes) + len(counts)
    words = np.zeros(n, np.uint64)
    text = np.repeat(np.arange(len(counts)), counts + 1)
    shift = np.repeat(np.arange(len(counts)), counts)
    words[np.arange(len(found.hashes)) + shift] = found.hashes
    begin = found.first[:-1] + np.arange(len(counts))
    array = SuffixArray(words, items.depth, items.vocabulary)
    use = items.starting
    lengths = items.sizes
    lo = array.search(items.hashes, use, lengths)
    hi = array.search(items.hashes, use, lengths, upper=True)
    hits = np.flatnonzero(hi > lo)
    matches = []
    for h in hits:
        at = array.order[lo[h] : hi[h]]
        docs = text[at]
        matches.append(
            (docs, np.full(len(at), use[h]), at - begin[docs], np.full(len(at), lengths[h]))
        )
    return counts, [np.concatenate(m) for m in zip(*matches)] if matches else None


_FIELDS = (
    "n_words long, places array<struct<first:long,words:long>>, items array<string>, longest long"
)
_TYPE = pa.struct(
    [
        ("n_words", pa.int64()),
        ("places", pa.list_(pa.struct([("first", pa.int64()), ("words", pa.int64())]))),
        ("items", pa.list_(pa.string())),
        ("longest", pa.int64()),
    ]
)


def _confirmed(text: str, items: Items, suffixes, firsts, sizes):
    """The matches of one document that hold for the words themselves, merged, and their items."""
    words, spans, names, runs = words_of(text), [], set(), []
    for s, first, size in zip(suffixes.tolist(), firsts.tolist(), sizes.tolist()):
        item, place = items.words[items.item[s]], int(items.place[s])
        if words[first : first + size] != item[place : place + size]:
            continue
        names.add(items.names[items.item[s]])
        spans.append((first, size))
        runs.append((int(items.item[s]), first - place, place, size))
    longest, length, before = 0, 0, None
    for item, shift, place, size in sorted(runs):
        length = length + 1 if before == (item, shift, place - 1) else size
        longest, before = max(longest, length), (item, shift, place)
    merged: list[list[int]] = []
    for first, size in sorted(spans):
        if merged and first <= merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], first + size)
        else:
            merged.append([first, first + size])
    return [{"first": a, "words": b - a} for a, b in merged], sorted(names), longest


def _matcher(block, window: int):
    @F.arrow_udf(_FIELDS)
    @thrifty
    def match(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        items = Items(block.value, window)
        for texts in batches:
            data, offsets = utf8(texts)
            rows = []
            for lo, hi in pieces(offsets, SHARD_BYTES):
                counts, matches = _shard(
                    data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], items
                )
                made = [
                    {"n_words": int(c), "places": [], "items": [], "longest": 0} for c in counts
                ]
                if matches is not None:
                    docs, suffixes, firsts, sizes = matches
                    order = np.argsort(docs, kind="stable")
                    cuts = np.flatnonzero(np.diff(docs[order])) + 1
                    for rows_of in np.split(order, cuts):
                        d = int(docs[rows_of[0]])
                        places, names, longest = _confirmed(
                            texts[lo + d].as_py(),
                            items,
                            suffixes[rows_of],
                            firsts[rows_of],
                            sizes[rows_of],
                        )
                        made[d] |= {"places": places, "items": names, "longest": longest}
                rows += made
            yield pa.array(rows, _TYPE)

    return match


def item_blocks(benchmark: DataFrame, item: str, text: str) -> Iterator[list[tuple[str, str]]]:
    """The items in blocks of at most ``BLOCK_BYTES`` of text; null texts have no words."""
    rows = benchmark.select(
        F.col(f"`{item}`").cast("string").alias("item"), F.col(f"`{text}`").alias("text")
    ).where(F.col("text").isNotNull() & F.col("item").isNotNull())
    block, size = [], 0
    for r in rows.toLocalIterator():
        n = len(r["text"].encode())
        if block and size + n > BLOCK_BYTES:
            yield block
            block, size = [], 0
        block.append((r["item"], r["text"]))
        size += n
    yield block


_UNION = """aggregate(array_sort(flatten(collect_list({places}))), CAST(array() AS {kind}),
  (a, p) -> IF(size(a) > 0 AND p.first <= element_at(a, -1).first + element_at(a, -1).words,
    concat(slice(a, 1, size(a) - 1), array(named_struct('first', element_at(a, -1).first,
      'words', greatest(element_at(a, -1).words, p.first + p.words - element_at(a, -1).first)))),
    concat(a, array(p))))"""


def with_contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    window: int = WINDOW,
    text: str = "text",
    item: str = "item_id",
    item_text: str = "text",
) -> DataFrame:
    """Add the struct column ``contamination``: ``n_words``, ``places`` (runs of hit words: number
    of the first word and words), ``items`` (ids as sorted text) and ``longest`` match in words.

    With more than one block of items the rows are grouped once to join the blocks' findings.
    """
    spark = docs.sparkSession
    kept = [F.col(f"`{c}`") for c in docs.columns if c != "contamination"]
    parts = []
    for block in item_blocks(benchmark, item, item_text):
        sent = spark.sparkContext.broadcast(block)
        parts.append(_matcher(sent, window)(F.col(f"`{text}`")))
    if len(parts) == 1:
        return docs.select(*kept, parts[0].alias("contamination"))
    key = unused(docs, "_row")
    numbered = materialize(docs.withColumn(key, F.monotonically_increasing_id()), "numbered")
    found = numbered.select(key, parts[0].alias("c"))
    for part in parts[1:]:
        found = found.unionByName(
            numbered.select(key, part.alias("c")).where(F.size("c.items") > 0)
        )
    kind = "array<struct<first:bigint,words:bigint>>"
    merged = found.groupBy(key).agg(
        F.struct(
            F.max("c.n_words").alias("n_words"),
            F.expr(_UNION.format(places="c.places", kind=kind)).alias("places"),
            F.array_sort(F.array_distinct(F.flatten(F.collect_list("c.items")))).alias("items"),
            F.max("c.longest").alias("longest"),
        ).alias("contamination")
    )
    return numbered.join(merged, key).select(*kept, "contamination")


def digest(marked: DataFrame) -> DataFrame:
    """The input of ``with_contamination`` with counts instead of the struct."""
    c = F.col("contamination")
    hit = F.aggregate(c["places"], F.lit(0).cast("long"), lambda a, p: a + p["words"])
    return (
        marked.withColumn("n_words", c["n_words"])
        .withColumn("n_hit", hit)
        .withColumn("n_items", F.size(c["items"]).cast("long"))
        .withColumn("items_sha256", F.sha2(F.array_join(c["items"], ","), 256))
        .withColumn("longest_match", c["longest"])
        .withColumn("contaminated", hit > 0)
        .drop("contamination")
    )


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """The documents without a hit word, with their own columns, also one named ``contamination``."""
    result, own = "contamination", unused(docs, "_own")
    renamed = docs.toDF(*[own if c.lower() == result else c for c in docs.columns])
    marked = with_contamination(renamed, benchmark, window)
    return marked.where(F.size(F.col(result)["items"]) == 0).select(
        *[F.col(f"`{n}`").alias(c) for n, c in zip(renamed.columns, docs.columns)]
    )
