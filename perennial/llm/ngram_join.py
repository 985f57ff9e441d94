"""Near duplicates by a grouped prefix join on word shingles.

Documents are sets of hashed shingles.  Two sets with Jaccard similarity t or more share a shingle
among the first |x| - ceil(t |x|) + 1 of each in any common order (their prefixes).  The order puts
common shingles last, so prefixes are rare and lists short.  The steps:

1. *Counts.*  Every shingle of every document is counted; tasks send sorted 32-bit remainders in
   one block per range instead of a row per shingle.  The commonest ``MOST_RANKED`` get a rank, and
   two bitmaps of ``BITMAP_BITS`` tell which others may occur twice, and which four times.  The order
   is: shingles of one document, of few, of more, ranked ones; then by hash.
2. *Sketches.*  Per document: size, fingerprints of set and prefix, and those shingles of the prefix
   that may occur elsewhere, with their places.  The table is written once.
3. *Groups.*  Equal sets become one node; nodes of equal prefix and size become one group.  For every
   shingle in a list it is known how many listed ones come before it in a node's prefix: no more than
   that, itself, and what comes after can be common with another node, which filters pairs by place.
4. *First links.*  In each list up to ``PIVOTS`` groups serve as pivots and every group is paired with
   them, if size and place allow the similarity; members are paired with their group's first node.
   Pairs are verified on whole sets, and the links' components found.
5. *Remaining pairs.*  In lists of up to ``CROWD`` nodes the groups are held against each other; pairs of
   groups that pass the filters and share enough of their prefixes are expanded to members, and those of
   different components not yet verified are verified.  Longer lists that several components share go
   to cells (``_cells``), where a second prefix join on what tells nodes from the cell's centre, most
   often a few shingles, finds the pairs (``_crowd_pairs``).  Both make the components exact.

Sets are read from the texts only for nodes in candidate pairs and travel to blocks of pairs, each
set once per block.  Nothing but counts, the bitmaps and the ranked shingles (all of fixed size)
reaches the driver; ids of candidates are broadcast only below ``MOST_SENT``, else joined.

Shingles are 64-bit hashes: sizes and similarities are those of the hash sets, which differ from
those of the texts only if two of a document's shingles collide.  Fingerprints have 128 bits, and
an equal first half with a different second half is noticed and hashed anew.

Rules for special cases: a text of fewer words than a shingle is one shingle; a text without words
(or null) has an empty set and is linked with nothing; a row with a null key is told apart by its
text and never gives a class its id; equal rows are in one class; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from perennial.functions.storage import materialize
from perennial.llm.textops import SPACED, mix64, pieces, split_words, thrifty, unused, utf8

MOST_RANKED = 1 << 17
BITMAP_BITS = 1 << 26
MOST_SENT = 2_000_000
PIVOTS = 8
#: Nodes in a list up to which its groups are held against each other; beyond, by what differs from a centre.
CROWD = 32
#: Members of a cell that its centre is made of, and rows of a cell that meet one copy of the centre.
CENTRE = 16
CELL_ROWS = 1024
#: Bytes of sets in one block of pairs.
BLOCK_BYTES = 8 << 20
#: Shingles that a task gathers before it sends their counts on.
GATHERED = 1 << 20
_PSEUDO = 1 << 62
_U = np.uint64
_STEP = _U(0x9FB21C651E98DF25)


@dataclass(frozen=True)
class Likeness:
    """Shingles of ``n`` words; similar from ``top`` in ``base`` on."""

    n: int = 5
    top: int = 80
    base: int = 100

    def prefix(self, size):
        return size - (size * self.top + self.base - 1) // self.base + 1

    def similar(self, both: int, a: int, b: int) -> bool:
        return both * self.base >= self.top * (a + b - both)

    def possible(self, a: list[Column], b: list[Column]) -> Column:
        """Whether a common shingle leaves room for the similarity.

        Either side has its smallest and largest size, and the most shingles in common that it can
        have before and after the shingle; one node's sizes are equal.
        """
        sizes = (a[1] * self.base >= b[0] * self.top) & (b[1] * self.base >= a[0] * self.top)
        most = F.least(a[2], b[2]) + 1 + F.least(a[3], b[3])
        return sizes & (most * (self.base + self.top) >= (a[0] + b[0]) * self.top)


def shingle_sets(data, bounds, n: int) -> Iterator[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    words = split_words(data, bounds, SPACED)
    w, first = words.hashes, words.first
    rolled = w.copy()
    for j in range(1, n):
        full = max(0, len(w) - j)
        rolled[:full] = rolled[:full] * _STEP + w[j:]
    rolled = mix64(rolled)
    for lo, hi in zip(first[:-1].tolist(), first[1:].tolist()):
        if hi - lo >= n:
            s = np.sort(rolled[lo : hi - n + 1])
            new = np.ones(len(s), bool)
            new[1:] = s[1:] != s[:-1]
            yield s if new.all() else s[new]
        elif hi > lo:
            whole = w[lo]
            with np.errstate(over="ignore"):
                for x in w[lo + 1 : hi]:
                    whole = whole * _STEP + x
                yield mix64(np.array([whole ^ _U(hi - lo)]))
        else:
            yield np.zeros(0, _U)


def _sets_of(texts: pa.Array, n: int) -> Iterator[np.ndarray]:
    data, offsets = utf8(texts)
    for lo, hi in pieces(offsets):
        yield from shingle_sets(
            data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], n
        )


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).view(np.int64))


# --- counts ---------------------------------------------------------------------------------


def _count_ranges(texts: DataFrame, like: Likeness, bits: int) -> DataFrame:
    """Per range of hashes: shingles met at least 4 times with counts, and the bitmaps' parts."""

    @thrifty
    def gather(batches):
        held, size = [], 0

        def sent(parts):
            tokens = np.sort(np.concatenate(parts))
            top = (tokens >> _U(64 - bits)).astype(np.int64)
            low = ((tokens >> _U(32 - bits)) & _U(0xFFFFFFFF)).astype("<u4")
            cuts = np.flatnonzero(np.diff(top)) + 1
            return pa.RecordBatch.from_arrays(
                [
                    pa.array(top[np.concatenate([[0], cuts])]),
                    pa.array([x.tobytes() for x in np.split(low, cuts)], pa.binary()),
                ],
                names=["part", "low"],
            )

        for batch in batches:
            for s in _sets_of(batch.column(0), like.n):
                if len(s):
                    held.append(s)
                    size += len(s)
                if size >= GATHERED:
                    yield sent(held)
                    held, size = [], 0
        if size:
            yield sent(held)

    slice_bits = BITMAP_BITS >> bits

    def total(table: pa.Table) -> pa.Table:
        part = table.column("part")[0].as_py()
        low = np.concatenate([np.frombuffer(b.as_py(), "<u4") for b in table.column("low")])
        low, counts = np.unique(low, return_counts=True)
        flags = np.zeros((2, slice_bits), bool)
        for i, least in enumerate((2, 4)):
            flags[i, (low[counts >= least].astype(np.int64) * slice_bits) >> 32] = True
        common = counts >= 4
        tokens = (np.int64(part) << 32) | low[common].astype(np.int64)
        return pa.table(
            {
                "part": pa.array([part], pa.int64()),
                "bitmap": pa.array([np.packbits(flags).tobytes()], pa.binary()),
                "tokens": pa.array([tokens.tolist()], pa.list_(pa.int64())),
                "counts": pa.array([counts[common].tolist()], pa.list_(pa.int64())),
            }
        )

    ranges = texts.mapInArrow(gather, "part long, low binary")
    return ranges.groupBy("part").applyInArrow(
        total, "part long, bitmap binary, tokens array<long>, counts array<long>"
    )


@dataclass
class Order:
    """What tasks need to order shingles: ranked tokens (ascending), ranks, and the bitmaps."""

    bits: int
    tokens: np.ndarray
    ranks: np.ndarray
    bitmap: np.ndarray

    def __post_init__(self):
        self.maybe = np.zeros(1 << 20, bool)
        self.maybe[self.tokens & 0xFFFFF] = True

    def token(self, shingles: np.ndarray) -> np.ndarray:
        return (shingles >> _U(32 - self.bits)).astype(np.int64)

    def rank(self, shingles: np.ndarray) -> np.ndarray:
        """0 only for shingles that one document alone has; common ones have the highest."""
        token = self.token(shingles)
        bit = token >> (32 + self.bits - int(math.log2(BITMAP_BITS)))
        byte, shift = bit >> 3, (7 - (bit & 7)).astype(np.uint8)
        out = ((self.bitmap[0][byte] >> shift) & 1).astype(np.int32)
        more = np.flatnonzero(out)
        out[more] += (self.bitmap[1][byte[more]] >> shift[more]) & 1
        some = np.flatnonzero(self.maybe[token & 0xFFFFF])
        if len(some):
            at = np.minimum(np.searchsorted(self.tokens, token[some]), len(self.tokens) - 1)
            found = self.tokens[at] == token[some]
            out[some[found]] = self.ranks[at[found]]
        return out


def _order(texts: DataFrame, like: Likeness) -> Order:
    spark = texts.sparkSession
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    bits = min(20, max(4, math.ceil(math.log2(4 * partitions))))
    table = materialize(_count_ranges(texts, like, bits), "shingle-counts")
    common = table.select(F.inline(F.arrays_zip("tokens", "counts")))
    left, least = MOST_RANKED, None
    for r in common.groupBy("counts").count().orderBy(F.desc("counts")).toLocalIterator():
        if r["count"] > left:
            break
        left, least = left - r["count"], r["counts"]
    ranked = []
    if least is not None:
        ranked = common.where(F.col("counts") >= least).collect()
    tokens = np.array([r["tokens"] for r in ranked], np.int64)
    counts = np.array([r["counts"] for r in ranked], np.int64)
    by_count = np.lexsort((tokens, counts))
    ranks = np.empty(len(tokens), np.int32)
    ranks[by_count] = np.arange(3, len(tokens) + 3)
    sort = np.argsort(tokens)
    bitmap = np.zeros((2, BITMAP_BITS >> 3), np.uint8)
    size = BITMAP_BITS >> bits >> 3
    for r in table.select("part", "bitmap").toLocalIterator():
        bitmap[:, r["part"] * size : (r["part"] + 1) * size] = np.frombuffer(
            r["bitmap"], np.uint8
        ).reshape(2, size)
    return Order(bits, tokens[sort], ranks[sort], bitmap)


# --- sketches -------------------------------------------------------------------------------

_SKETCH = (
    "k long, h long, doc long, n long, node long, other long, g1 long, g2 long, "
    "tokens array<long>, places array<int>"
)


def _fingerprint(s: np.ndarray, salt: int) -> tuple[int, int]:
    n = _U(len(s) * 2654435761 + salt)
    one = mix64(np.array([s.sum(dtype=_U) ^ n]))[0]
    two = mix64(np.array([mix64(s ^ _STEP).sum(dtype=_U) + n]))[0]
    return int(one.view(np.int64)), int(two.view(np.int64))


def _sketch(rows: DataFrame, like: Likeness, sent, salt: int) -> DataFrame:
    @thrifty
    def sketch(batches):
        order: Order = sent.value
        for batch in batches:
            size, prints, prefixes, elsewhere = [], [], [], []
            for s in _sets_of(batch.column(3), like.n):
                rank = order.rank(s)
                take = like.prefix(len(s)) if len(s) else 0
                alone = np.flatnonzero(rank == 0)[:take]
                chosen = alone if len(alone) == take else np.lexsort((s, rank))[:take]
                prefix = s[chosen]
                elsewhere.append(rank[chosen] > 0)
                size.append(len(s))
                prints.append((*_fingerprint(s, salt), *_fingerprint(prefix, salt)))
                prefixes.append(prefix)
            flat = np.concatenate(prefixes) if prefixes else np.zeros(0, _U)
            lengths = np.array([len(p) for p in prefixes], np.int64)
            owner = np.repeat(np.arange(len(prefixes)), lengths)
            start = np.cumsum(lengths) - lengths
            place = np.arange(len(flat)) - np.repeat(start, lengths)
            keep = np.concatenate(elsewhere) if elsewhere else np.zeros(0, bool)
            offsets = np.zeros(len(prefixes) + 1, np.int32)
            np.cumsum(np.bincount(owner[keep], minlength=len(prefixes)), out=offsets[1:])
            numbers = np.array(prints, np.int64).reshape(-1, 4)
            ends = pa.array(offsets, pa.int32())
            yield pa.RecordBatch.from_arrays(
                [
                    *[batch.column(i) for i in range(3)],
                    pa.array(size, pa.int64()),
                    *[pa.array(np.ascontiguousarray(numbers[:, i])) for i in range(4)],
                    pa.ListArray.from_arrays(ends, _signed(flat[keep])),
                    pa.ListArray.from_arrays(ends, pa.array(place[keep].astype(np.int32))),
                ],
                names=[f.split(" ")[0] for f in _SKETCH.split(", ")],
            )

    return rows.mapInArrow(sketch, _SKETCH)


# --- links ----------------------------------------------------------------------------------


def _sets_in(needed: DataFrame, nodes: DataFrame, rows: DataFrame, like: Likeness, salt: int):
    """The set of every needed node (node, blocks), once per block: (node, set, block)."""
    wanted = materialize(nodes.select("node", "rep").join(needed, "node"), "wanted")
    sent = F.broadcast(wanted) if wanted.count() <= MOST_SENT // 4 else wanted
    texts = rows.join(sent, rows["k"] == wanted["rep"]).select("node", "blocks", "text")

    @thrifty
    def read(batches):
        for batch in batches:
            names, sets, where = [], [], []
            for i, s in enumerate(_sets_of(batch.column(2), like.n)):
                node = batch.column(0)[i].as_py()
                if _fingerprint(s, salt)[0] == node:
                    names.append(node)
                    sets.append(s.tobytes())
                    where.append(batch.column(1)[i].as_py())
            yield pa.RecordBatch.from_arrays(
                [pa.array(names, pa.int64()), pa.array(where, pa.list_(pa.int64())),
                 pa.array(sets, pa.binary())],
                names=["node", "blocks", "set"],
            )

    return texts.mapInArrow(read, "node long, blocks array<long>, set binary").select(
        "node", "set", F.explode("blocks").alias("block")
    )


def _verify(pairs: DataFrame, nodes: DataFrame, rows: DataFrame, like: Likeness, salt: int):
    """The pairs (a, b, na, nb) whose whole sets are similar."""
    spark = pairs.sparkSession
    weight = pairs.agg(F.sum((F.col("na") + F.col("nb")) * 8)).first()[0] or 0
    side = max(1, math.ceil(math.sqrt(weight / BLOCK_BYTES)))

    def block(c):
        return F.pmod(F.xxhash64(c), F.lit(side))

    blocked = pairs.select("a", "b", (block("a") * side + block("b")).alias("block"))
    needed = (
        blocked.select(F.col("a").alias("node"), "block")
        .union(blocked.select("b", "block"))
        .groupBy("node")
        .agg(F.collect_set("block").alias("blocks"))
    )
    sets = _sets_in(needed, nodes, rows, like, salt)

    def check(left: pa.Table, right: pa.Table) -> pa.Table:
        have = {
            n: np.frombuffer(s, np.uint64)
            for n, s in zip(right.column("node").to_pylist(), right.column("set").to_pylist())
        }
        a, b = left.column("a").to_numpy(), left.column("b").to_numpy()
        order = np.argsort(a, kind="stable")
        a, b = a[order], b[order]
        good = np.zeros(len(a), bool)
        cuts = np.flatnonzero(np.diff(a)) + 1
        for lo, hi in zip([0, *cuts.tolist()], [*cuts.tolist(), len(a)]):
            if hi == lo:
                continue
            x = have[a[lo]]
            for start in range(lo, hi, 512):
                ys = [have[n] for n in b[start : min(hi, start + 512)]]
                flat = np.concatenate(ys)
                at = np.minimum(np.searchsorted(x, flat), len(x) - 1)
                lengths = np.array([len(y) for y in ys])
                both = np.add.reduceat(x[at] == flat, np.cumsum(lengths) - lengths, dtype=np.int64)
                good[start : start + len(ys)] = both * like.base >= like.top * (
                    len(x) + lengths - both
                )
        return pa.table({"a": a[good], "b": b[good]})

    return (
        blocked.groupBy("block")
        .cogroup(sets.groupBy("block"))
        .applyInArrow(check, "a long, b long")
    )


# --- crowds ---------------------------------------------------------------------------------


def _cells(crowd: DataFrame, like: Likeness) -> DataFrame:
    """Cells of the crowded lists (token, node, comp, n): (cell, node, comp, n, home, held).

    A list goes to the cell of that holder which stands in most crowded lists, so that the lists of
    one crowd share a cell; a cell is cut into bands of sizes.  A node is at home in its band and a
    visitor of the next, so similar nodes of a list, whose bands differ by one at most, meet.
    """
    kept = crowd.groupBy("node").agg(F.count(F.lit(1)).alias("lists"))
    leaders = (
        crowd.join(kept, "node")
        .groupBy("token")
        .agg(F.max(F.struct("lists", "node"))["node"].alias("leader"))
    )
    step = math.log(like.base / like.top) * (1 + 1e-9) if like.top < like.base else 1.0
    band = F.floor(F.log("n") / F.lit(step))
    spots = (
        crowd.join(leaders, "token")
        .select("leader", "node", "comp", "n")
        .distinct()
        .select("leader", "node", "comp", "n", band.alias("band"), F.explode(F.array(F.lit(0), F.lit(1))).alias("up"))
        .select(
            F.xxhash64("leader", F.col("band") + F.col("up")).alias("cell"),
            "node", "comp", "n", (F.col("up") == 0).alias("home"),
        )
    )
    useful = (
        spots.groupBy("cell")
        .agg(
            F.count(F.lit(1)).alias("held"),
            F.min("comp").alias("c1"),
            F.max("comp").alias("c2"),
            F.max("home").alias("lived"),
        )
        .where("c1 != c2 AND lived")
        .select("cell", "held")
    )
    return spots.join(useful, "cell")


def _deltas(spots: DataFrame, nodes: DataFrame, rows: DataFrame, like: Likeness, salt: int):
    """For every spot the shingles that tell its node from the cell's centre.

    The centre is what most of ``CENTRE`` members hold.  Any centre gives right results, since
    the shingles in which two nodes differ follow from what tells either from the same centre; a
    typical one gives short lists.
    """
    needed = spots.groupBy("node").agg(F.collect_set("cell").alias("blocks"))
    sets = materialize(
        _sets_in(needed, nodes, rows, like, salt).withColumnRenamed("block", "cell"), "crowd-sets"
    )
    first = Window.partitionBy("cell").orderBy(F.xxhash64("node"), "node")
    chosen = (
        spots.select("cell", "node", F.row_number().over(first).alias("turn"))
        .where(F.col("turn") <= CENTRE)
        .select("cell", "node")
    )

    def centre(table: pa.Table) -> pa.Table:
        parts = [np.frombuffer(x, np.uint64) for x in table.column("set").to_pylist()]
        tokens, counts = np.unique(np.concatenate(parts), return_counts=True)
        held = tokens[2 * counts > len(parts)].tobytes()
        return pa.table({"cell": table.column("cell").slice(0, 1), "centre": pa.array([held], pa.binary())})

    centres = (
        sets.join(chosen, ["cell", "node"])
        .select("cell", "set")
        .groupBy("cell")
        .applyInArrow(centre, "cell long, centre binary")
    )
    parts = F.ceil(F.col("held") / F.lit(CELL_ROWS))
    spread = (
        spots.select("cell", parts.alias("parts"))
        .distinct()
        .join(centres, "cell")
        .select("cell", "centre", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"))
    )

    @thrifty
    def differ(batches):
        for batch in batches:
            at = {name: i for i, name in enumerate(batch.schema.names)}
            held, sizes = [], []
            for x, z in zip(batch.column(at["set"]), batch.column(at["centre"])):
                own = np.frombuffer(x.as_buffer(), np.uint64)
                held.append(np.setxor1d(own, np.frombuffer(z.as_buffer(), np.uint64), True))
                sizes.append(len(held[-1]))
            ends = np.concatenate([[0], np.cumsum(np.array(sizes, np.int64))]).astype(np.int32)
            flat = np.concatenate(held) if held else np.zeros(0, _U)
            kept = ["cell", "node", "comp", "n", "home"]
            yield pa.RecordBatch.from_arrays(
                [
                    *[batch.column(at[c]) for c in kept],
                    pa.array(sizes, pa.int64()),
                    pa.ListArray.from_arrays(pa.array(ends), _signed(flat)),
                ],
                names=[*kept, "size", "tokens"],
            )

    return (
        spots.withColumn("part", F.pmod(F.xxhash64("node"), parts))
        .join(sets, ["cell", "node"])
        .join(spread, ["cell", "part"])
        .select("cell", "node", "comp", "n", "home", "set", "centre")
        .mapInArrow(
            differ,
            "cell long, node long, comp long, n long, home boolean, size long, tokens array<long>",
        )
    )


def _crowd_pairs(spots: DataFrame, nodes: DataFrame, rows: DataFrame, like: Likeness, salt: int):
    """Links (a, b) that follow without a look at the pair, and the pairs (a, b, na, nb) left to verify.

    Let d be what tells a node from the centre and f = (base + top) |d| - (base - top) n.  Two nodes are
    similar just when f + f' <= 2 (base + top) |d and d'|.  If f + f' <= 0, both are linked with the
    node of smallest f.  All other similar pairs share shingles of d, at least one and at least what
    f and the smallest f ask for: a prefix join on d, in the order of counts in the cell.
    """
    whole, gap = like.base + like.top, like.base - like.top
    deltas = materialize(_deltas(spots, nodes, rows, like, salt), "deltas")
    f = (whole * F.col("size") - gap * F.col("n")).alias("f")
    told = deltas.select("cell", "node", F.explode("tokens").alias("token"))
    often = told.groupBy("cell", "token").agg(F.count(F.lit(1)).alias("count")).where("count > 1")
    ranked = Window.partitionBy("cell", "node").orderBy("count", "token")
    shared = materialize(
        told.join(often, ["cell", "token"]).select(
            "cell",
            "node",
            "token",
            (F.row_number().over(ranked) - 1).cast("long").alias("before"),
            F.count(F.lit(1)).over(Window.partitionBy("cell", "node")).alias("common"),
        ),
        "crowd-shared",
    )
    common = shared.where("before = 0").select("cell", "node", "common")
    found = deltas.select("cell", "node", "comp", "n", "home", "size", f).join(
        common, ["cell", "node"], "left"
    )
    found = materialize(found.fillna(0, ["common"]), "crowd")
    edges = found.groupBy("cell").agg(
        F.min(F.struct("f", "node", "comp")).alias("mid"),
        F.min(F.col("f") - 2 * whole * F.col("common")).alias("room"),
    )
    placed = found.join(edges, "cell")
    sure = placed.where("f + mid.f <= 0 AND comp != mid.comp").select(
        F.col("node").alias("a"), F.col("mid.node").alias("b")
    )
    least = F.greatest(F.lit(1), F.ceil((F.col("f") + F.col("mid.f")) / F.lit(2 * whole)))
    usable = placed.where((F.col("f") + F.col("room") <= 0) & (least <= F.col("common"))).select(
        "cell", "node", "comp", "n", "home", "f", (F.col("common") - least).alias("last")
    )
    entries = shared.join(usable, ["cell", "node"]).where("before <= last").select(
        "cell", "token", "node", "comp", "n", "home", "f", "before",
        (F.col("common") - F.col("before") - 1).alias("after"),
    )
    entries = materialize(entries, "crowd-entries")
    other = entries.select("cell", "token", *[F.col(c).alias(f"{c}2") for c in entries.columns[2:]])
    after = F.least("after", "after2")
    most = F.least("before", "before2") + 1 + after
    pairs = (
        entries.join(other, ["cell", "token"])
        .where((F.col("node") < F.col("node2")) & (F.col("comp") != F.col("comp2")))
        .where(F.col("home") | F.col("home2"))
        .where(F.col("f") + F.col("f2") <= 2 * whole * most)
        .groupBy("cell", "node", "node2", "n", "n2", (F.col("f") + F.col("f2")).alias("f"))
        .agg((F.count(F.lit(1)) + F.min(after)).alias("most"))
        .where(F.col("f") <= 2 * whole * F.col("most"))
        .select(*_ordered(F.col("node"), F.col("node2"), F.col("n"), F.col("n2")))
    )
    return sure, pairs


def _ordered(x: Column, y: Column, nx: Column, ny: Column) -> list[Column]:
    swap = x > y
    return [
        F.least(x, y).alias("a"),
        F.greatest(x, y).alias("b"),
        F.when(swap, ny).otherwise(nx).alias("na"),
        F.when(swap, nx).otherwise(ny).alias("nb"),
    ]


def components(edges: DataFrame) -> DataFrame:
    """``(node, comp)`` for every node of the edges (a, b); ``comp`` is the smallest node reached.

    Labels take the minimum over neighbours, then the label of their label, until none changes.
    """
    both = materialize(
        edges.union(edges.select("b", "a")).toDF("a", "b").distinct(), "edges"
    )
    labels = materialize(
        both.groupBy(F.col("a").alias("node")).agg(F.least(F.first("a"), F.min("b")).alias("comp")),
        "labels",
    )
    while True:
        near = (
            both.join(labels.select(F.col("node").alias("b"), "comp"), "b")
            .groupBy(F.col("a").alias("node"))
            .agg(F.min("comp").alias("near"))
        )
        lower = labels.join(near, "node").select(
            "node", F.col("comp").alias("was"), F.least("comp", "near").alias("comp")
        )
        step = materialize(lower, "lower")
        upper = step.select(F.col("node").alias("comp"), F.col("comp").alias("next"))
        labels = materialize(
            step.join(upper, "comp").select("node", "was", F.col("next").alias("comp")), "labels"
        )
        if labels.where("was != comp").isEmpty():
            return labels.select("node", "comp")


def document_key(key: Column, text: Column) -> Column:
    """The integer key, or a number from 2^62 on made of the text where it is null."""
    made = F.shiftrightunsigned(F.xxhash64(text), 2) + F.lit(_PSEUDO)
    return F.coalesce(key.cast("long"), made)


def ngram_jaccard_join(
    docs: DataFrame,
    n: int = 5,
    similarity: tuple[int, int] = (80, 100),
    key: str = "doc_id",
    text: str = "text",
    _salt: int = 0,
) -> DataFrame:
    """One row per document: ``k`` and ``h`` (row key: number and hash of the text), ``doc_id``,
    ``n_shingles``, ``component_id`` (smallest non-null key of its class), ``keeper`` (the ``k`` of the
    document that stands for the class) and ``class`` (number of the class; null without words).

    ``n`` words make a shingle; documents are linked from ``similarity`` (a fraction) on.
    """
    spark = docs.sparkSession
    like = Likeness(n, *similarity)
    number = F.col(f"`{key}`")
    body = F.col(f"`{text}`")
    rows = docs.select(
        document_key(number, body).alias("k"),
        F.xxhash64(body).alias("h"),
        number.cast("long").alias("doc"),
        F.coalesce(body, F.lit("")).alias("text"),
    )
    order = _order(rows.select("text"), like)
    sent = spark.sparkContext.broadcast(order)
    sketch = materialize(_sketch(rows, like, sent, _salt), "sketch")
    nodes = materialize(
        sketch.where("n > 0")
        .groupBy("node")
        .agg(
            F.min("k").alias("rep"),
            F.min("doc").alias("doc"),
            F.first("n").alias("n"),
            *[F.first(c).alias(c) for c in ("g1", "g2", "tokens", "places")],
            (F.min("other") != F.max("other")).alias("collides"),
        ),
        "nodes",
    )
    if not nodes.where("collides").isEmpty():
        return ngram_jaccard_join(docs, n, similarity, key, text, _salt + 1)
    same = ["n", "g1", "g2"]
    groups = nodes.groupBy(*same).agg(
        F.min("node").alias("gid"),
        F.count(F.lit(1)).alias("held"),
        F.first("tokens").alias("tokens"),
        F.first("places").alias("places"),
    )
    members = materialize(
        nodes.select("node", *same).join(groups.select("gid", *same), same).select("node", "gid", "n"),
        "members",
    )
    listed = materialize(
        groups.select("gid", "n", "held", F.inline(F.arrays_zip("tokens", "places"))).toDF(
            "gid", "n", "held", "token", "place"
        ),
        "listed",
    )
    busy = listed.groupBy("token").agg(F.sum("held").alias("holders")).where("holders > 1")
    along = Window.partitionBy("gid").orderBy("place")
    lists = materialize(
        listed.join(busy, "token").select(
            "token",
            "gid",
            "n",
            (F.row_number().over(along) - 1).cast("long").alias("before"),
            (F.col("n") - F.col("place") - 1).alias("after"),
        ),
        "lists",
    )
    pivots = (
        lists.groupBy("token", F.pmod(F.xxhash64("gid"), F.lit(PIVOTS)).alias("slot"))
        .agg(F.min(F.struct("gid", "n", "before", "after")).alias("p"))
        .select("token", "p")
    )
    by_pivot = lists.join(pivots, "token").where(
        (F.col("gid") != F.col("p.gid"))
        & like.possible(
            [F.col(c) for c in ("n", "n", "before", "after")],
            [F.col(f"p.{c}") for c in ("n", "n", "before", "after")],
        )
    )
    by_group = members.where("node != gid").select(
        *_ordered(F.col("node"), F.col("gid"), F.col("n"), F.col("n"))
    )
    tested = materialize(
        by_pivot.select(*_ordered(F.col("gid"), F.col("p.gid"), F.col("n"), F.col("p.n")))
        .union(by_group)
        .distinct(),
        "tested",
    )
    linked = materialize(_verify(tested, nodes, rows, like, _salt), "links")
    comps = components(linked)

    placed = materialize(
        members.join(comps, "node", "left").select(
            "node", "gid", "n", F.coalesce("comp", "node").alias("comp")
        ),
        "placed",
    )
    spans = placed.groupBy("gid").agg(
        F.count(F.lit(1)).alias("held"), F.min("comp").alias("lo"), F.max("comp").alias("hi")
    )
    open_lists = materialize(lists.join(spans, "gid"), "open-lists")
    several = (
        open_lists.groupBy("token")
        .agg(F.sum("held").alias("holders"), F.min("lo").alias("first"), F.max("hi").alias("last"))
        .where("first != last")
        .select("token", "holders")
    )
    several = materialize(several, "several")
    crowded = several.where(F.col("holders") > CROWD).select("token")
    sure, pairs = None, None
    if not crowded.isEmpty():
        crowd = materialize(
            open_lists.select("token", "gid")
            .join(crowded, "token")
            .join(placed, "gid")
            .select("token", "node", "comp", "n"),
            "crowded",
        )
        spots = materialize(_cells(crowd, like), "cells")
        sure, pairs = _crowd_pairs(spots, nodes, rows, like, _salt)
    own = open_lists.join(several.where(F.col("holders") <= CROWD).select("token"), "token").drop("held")
    right = own.select("token", *[F.col(c).alias(f"{c}2") for c in own.columns if c != "token"])
    sizes = [F.col(c) for c in ("n", "n", "before", "after")]
    # A pair's rows are the shingles that both prefixes have (one that fails a filter rules the pair
    # out, so counting fewer does no harm): with what follows the last of them, no more is common.
    # Pairs that also share a crowded shingle are found in its cell.
    meeting = (
        own.join(right, "token")
        .where("gid <= gid2 AND least(lo, lo2) != greatest(hi, hi2)")
        .where(like.possible(sizes, [F.col(c) for c in ("n2", "n2", "before2", "after2")]))
        .groupBy("gid", "gid2", "n", "n2")
        .agg((F.count(F.lit(1)) + F.min(F.least("after", "after2"))).alias("most"))
        .where(F.col("most") * (like.base + like.top) >= (F.col("n") + F.col("n2")) * like.top)
        .select("gid", "gid2")
    )
    left = placed.toDF("node", "gid", "n", "comp")
    rest = (
        meeting.join(left, "gid")
        .join(placed.toDF("node2", "gid2", "n2", "comp2"), "gid2")
        .where("comp != comp2 AND (gid != gid2 OR node < node2)")
        .select(*_ordered(F.col("node"), F.col("node2"), F.col("n"), F.col("n2")))
    )
    if pairs is not None:
        rest = rest.union(pairs)
    rest = rest.distinct().join(tested, ["a", "b", "na", "nb"], "left_anti")
    rest = materialize(rest, "rest")
    more = materialize(_verify(rest, nodes, rows, like, _salt), "more-links")
    inner = comps.select(F.col("node").alias("a"), F.col("comp").alias("b")).where("a != b")
    comps = components(inner.union(more if sure is None else more.union(sure)))

    classes = nodes.select("node", "rep", "doc").join(comps, "node", "left").select(
        "node", "rep", "doc", F.coalesce("comp", "node").alias("comp")
    )
    named = classes.groupBy("comp").agg(
        F.min("rep").alias("keeper"), F.min("doc").alias("component_id")
    )
    by_node = materialize(classes.select("node", "comp").join(named, "comp"), "classes")
    return (
        sketch.select("k", "h", "doc", "n", "node")
        .join(by_node.select("node", "comp", "keeper", "component_id"), "node", "left")
        .select(
            "k",
            "h",
            F.col("doc").alias("doc_id"),
            F.col("n").alias("n_shingles"),
            F.when(F.col("n") == 0, F.col("doc")).otherwise(F.col("component_id")).alias("component_id"),
            F.when(F.col("n") == 0, F.col("k")).otherwise(F.col("keeper")).alias("keeper"),
            F.when(F.col("n") > 0, F.col("comp")).alias("class"),
        )
    )


def one_of_each(docs: DataFrame, n: int = 5, similarity: tuple[int, int] = (80, 100)) -> DataFrame:
    """The documents without near copies: the smallest key of each class stays, with its columns.

    Equal rows are copies of each other: one stays.  Where a key stands on several texts of a class, the
    one of smallest hash stays; texts of different classes all stay.
    """
    found = materialize(ngram_jaccard_join(docs, n, similarity), "near")
    keepers = found.where("k = keeper")
    repeated = not keepers.groupBy("k").count().where("count > 1").isEmpty()
    removed = found.where("k != keeper").select("k", "h")
    if repeated:
        least = keepers.where("class IS NOT NULL").groupBy("k", "class").agg(F.min("h").alias("least"))
        other = keepers.join(least, ["k", "class"]).where("h != least").select("k", "h")
        removed = removed.union(other)
    removed = materialize(removed.distinct(), "removed")
    if removed.count() <= MOST_SENT:
        removed = F.broadcast(removed)
    key, body = document_key(F.col("doc_id"), F.col("text")), F.xxhash64("text")
    kept = docs.join(removed, (key == removed["k"]) & (body == removed["h"]), "left_anti")
    if not repeated:
        return kept
    columns = [F.col(f"`{c}`") for c in docs.columns]
    spare = unused(docs, "_place")
    first = Window.partitionBy(key, body).orderBy(F.to_json(F.struct(*columns)))
    return kept.withColumn(spare, F.row_number().over(first)).where(F.col(spare) == 1).drop(spare)
