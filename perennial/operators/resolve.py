"""Company identifiers for tickers: override, ticker list, exact name, similar name."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from difflib import SequenceMatcher
from functools import cached_property

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from perennial.functions.columns import normalize_company_name, normalize_ticker
from perennial.functions.storage import materialize

# Identifiers verified by hand.
OVERRIDES = [
    ("AEP", 4904, "AMERICAN ELECTRIC POWER CO INC"),
    ("EQR", 906107, "EQUITY RESIDENTIAL"),
]
SIMILARITY_CUTOFF = 0.92


def identifier_coverage(tickers: DataFrame, ticker_map: DataFrame) -> DataFrame:
    """Every ticker with its normalised form and, where listed, CIK and name."""
    known = ticker_map.select(F.col("ticker").alias("normalized"), "cik", "title")
    return (
        tickers.select("ticker", normalize_ticker("ticker").alias("normalized"))
        .join(known, "normalized", "left")
        .withColumn("mapped", F.col("cik").isNotNull())
    )


def coverage_summary(coverage: DataFrame) -> DataFrame:
    return coverage.agg(
        F.count(F.lit(1)).alias("tickers"),
        F.count(F.when(F.col("mapped"), 1)).alias("mapped"),
        F.count(F.when(~F.col("mapped"), 1)).alias("missing"),
        F.avg(F.col("mapped").cast("double")).alias("rate"),
    )


def name_index(sec_names: DataFrame) -> DataFrame:
    """(normalized, cik, unique): lowest CIK of every normalised name and whether it is the only one."""
    return sec_names.groupBy("normalized").agg(
        F.min("cik").alias("cik"), (F.min("cik") == F.max("cik")).alias("unique")
    )


#: Names of one block on either side that meet in one task.
CELL_NAMES = 1024
#: Length of the pieces of a name by which the first candidate of a cell is found.
GRAM = 3
#: Length of the pieces by which names are looked up without meeting their whole block, and the most
#: listed names that such a piece may stand for.
PIECE = 5
PIECE_NAMES = 256
_CODES = np.full(128, 37, np.int64)
_CODES[[*range(48, 58), *range(65, 91), 32]] = np.arange(37)


def _letter_counts(names: Sequence[str]) -> np.ndarray:
    """How often each of 37 characters, and any other one, occurs in each name."""
    points = [np.frombuffer(n.encode("utf-32-le"), np.uint32) for n in names]
    owner = np.repeat(np.arange(len(names)), [len(p) for p in points])
    code = _CODES[np.minimum(np.concatenate(points), 127)] if len(owner) else owner
    return np.bincount(owner * 38 + code, minlength=38 * len(names)).reshape(-1, 38)


def _grams(name: str) -> set[str]:
    return {name[i : i + GRAM] for i in range(max(1, len(name) - GRAM + 1))}


class NameCell:
    """Listed names of one cell, and two searches for the one most similar to a name.

    ``first`` scores the name that shares most pieces, found by an inverted index.  ``best`` takes names
    by an upper bound of their ratio, twice the characters shared in any order over both lengths, and
    ends at the first that can't win; equal ratios go to the greater name.
    """

    def __init__(self, names: Sequence[str]):
        self.names = sorted(names, reverse=True)
        self.sizes = np.array([len(n) for n in self.names])
        self.scored = 0

    @cached_property
    def counts(self) -> np.ndarray:
        return _letter_counts(self.names)

    @cached_property
    def lists(self) -> dict[str, np.ndarray]:
        lists: dict[str, list[int]] = {}
        for i, name in enumerate(self.names):
            for gram in _grams(name):
                lists.setdefault(gram, []).append(i)
        return {gram: np.array(at) for gram, at in lists.items()}

    def _score(self, wanted: str, i: int) -> tuple[float, str]:
        self.scored += 1
        return SequenceMatcher(None, wanted, self.names[i]).ratio(), self.names[i]

    def first(self, wanted: str, least: float = 0.0) -> tuple[float, str] | None:
        lists = [self.lists[g] for g in _grams(wanted) if g in self.lists]
        if not lists:
            return None
        shared = np.bincount(np.concatenate(lists), minlength=len(self.names))
        found = self._score(wanted, int((2.0 * shared / (self.sizes + len(wanted))).argmax()))
        return found if found[0] >= least else None

    def best(self, wanted: str, least: float = 0.0) -> tuple[float, str] | None:
        shared = np.minimum(self.counts, _letter_counts([wanted])).sum(axis=1)
        bound = 2.0 * shared / (self.sizes + len(wanted))
        able = np.flatnonzero(bound >= least)
        found = None
        for i in able[np.argsort(-bound[able], kind="stable")]:
            if found and (bound[i], self.names[i]) < found:
                break
            candidate = self._score(wanted, i)
            if candidate[0] >= least and (found is None or candidate > found):
                found = candidate
        return found


def _of_cell(method: str):
    def search(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(left) and len(right):
            find = getattr(NameCell(right["candidate"].tolist()), method)
            for wanted, least in zip(left["wanted"], left["least"]):
                found = find(wanted, least)
                if found:
                    out.append((wanted, found[1], found[0]))
        return pd.DataFrame(out, columns=["wanted", "candidate", "score"])

    return search


def _dealt(rows: DataFrame, name: str, own: str, other: str, sizes: DataFrame) -> DataFrame:
    """Rows of one side in the cells of their block: dealt by hash on their own side, copied to every
    part of the other side."""
    return rows.join(sizes, "block").select(
        *rows.columns,
        F.pmod(F.xxhash64(name), F.col(own)).cast("int").alias(own),
        F.explode(F.sequence(F.lit(0), F.col(other) - 1)).alias(other),
    )


def _pieces(name: str) -> Column:
    """Every run of ``PIECE`` characters, repeats included."""
    last = F.length(name) - (PIECE - 1)
    runs = F.transform(F.sequence(F.lit(1), last), lambda i: F.substring(name, i, F.lit(PIECE)))
    return F.when(last >= 1, runs).otherwise(F.array().cast("array<string>"))


def _scored(pairs: DataFrame) -> DataFrame:
    """(wanted, candidate, score) of the pairs (wanted, candidate, least) that reach ``least``; pairs
    whose common characters cannot are not scored."""

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            left, right = batch["wanted"].tolist(), batch["candidate"].tolist()
            shared = np.minimum(_letter_counts(left), _letter_counts(right)).sum(axis=1)
            sizes = np.array([len(a) + len(b) for a, b in zip(left, right)])
            least = batch["least"].to_numpy()
            out = []
            for i in np.flatnonzero(2.0 * shared >= least * sizes - 1e-9):
                found = SequenceMatcher(None, left[i], right[i]).ratio()
                if found >= least[i]:
                    out.append((left[i], right[i], found))
            yield pd.DataFrame(out, columns=["wanted", "candidate", "score"])

    return pairs.select("wanted", "candidate", "least").mapInPandas(
        score, "wanted string, candidate string, score double"
    )


def _best(scored: DataFrame) -> DataFrame:
    return scored.groupBy("wanted").agg(F.max(F.struct("score", "candidate")).alias("best"))


def _by_pieces(asked: DataFrame, listed: DataFrame, least: float) -> tuple[DataFrame, DataFrame]:
    """(wanted, best) found by rare pieces, and the rows of ``asked`` that they do not settle.

    The name that shares most of an input's rarest pieces gives a score to reach.  A name that reaches
    score ``s`` differs from an input of ``n`` characters by at most ``d = 2n(1 - s) / s`` inserted or
    deleted ones, each of which breaks at most ``PIECE`` pieces.  So it holds one of any
    ``PIECE * d + 1`` pieces of the input, and the rarest of them find every name that can win.  Inputs
    that have too few pieces for this, or too few rare ones, are left to the cells.
    """
    held = listed.select("block", "candidate", F.explode(F.array_distinct(_pieces("candidate"))).alias("piece"))
    counts = materialize(held.groupBy("block", "piece").agg(F.count(F.lit(1)).alias("n")), "pieces")
    common = counts.where(F.col("n") > PIECE_NAMES).select("block", "piece")
    rare = materialize(held.join(common, ["block", "piece"], "left_anti"), "rare_pieces")
    own = asked.select("wanted", "block", F.posexplode(_pieces("wanted")).alias("place", "piece"))
    ranked = materialize(
        own.join(counts, ["block", "piece"], "left")
        .groupBy("wanted", "block")
        .agg(F.array_sort(F.collect_list(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "place", "piece"))).alias("own")),
        "ranked",
    )

    def pairs(rows: DataFrame, own: Column) -> DataFrame:
        asks = rows.select("wanted", "block", "least", F.explode(F.array_distinct(own)).alias("piece"))
        met = asks.join(rare, ["block", "piece"])
        return met.groupBy("wanted", "candidate").agg(F.count(F.lit(1)).alias("n"), F.max("least").alias("least"))

    usable = F.filter("own", lambda p: p["n"].between(1, PIECE_NAMES))
    met = pairs(ranked.withColumn("least", F.lit(least)), F.slice(usable["piece"], 1, 2 * PIECE))
    likeness = F.col("n") / (F.length("wanted") + F.length("candidate"))
    nearest = met.groupBy("wanted", "least").agg(
        F.max_by("candidate", F.struct(likeness, "candidate")).alias("candidate")
    )
    first = materialize(_best(_scored(nearest)), "nearest")
    score = F.col("best.score")
    edits = F.try_divide(2 * F.length("wanted") * (1 - score), score)
    need = (PIECE * F.floor(edits + 1e-9) + 1).cast("int")
    enough = need <= F.size("own")
    settled = F.when(enough, F.try_element_at("own", need)["n"] <= PIECE_NAMES)
    told = materialize(
        ranked.join(first, "wanted").withColumns({"least": score, "need": need, "settled": settled})
        .where("settled").select("wanted", "block", "least", "need", "own"),
        "settled",
    )
    wins = _best(_scored(pairs(told, F.slice(F.col("own")["piece"], F.lit(1), F.col("need")))))
    return (
        materialize(first.unionByName(wins), "by_pieces"),
        asked.join(told.select("wanted"), "wanted", "left_anti"),
    )


def similar_names(
    inputs: DataFrame, sec_names: DataFrame, min_reported_score: float = 0.0
) -> DataFrame:
    """The most similar listed name of every distinct ``normalized`` input.

    Compared are names that begin with the input's first word or contain it as a word.  Inputs close to
    a listed name are settled by the names that share one of their rare pieces (see ``_by_pieces``).

    For the others the names of a word are counted on both sides and split into cells of about
    ``CELL_NAMES`` names by ``CELL_NAMES`` inputs, so that a word that many names share is spread over as
    many tasks as its pairs need, and a rare word is copied nowhere.  A first pass over the cells scores
    one name per input and cell, found by shared pieces; the best of them is the score that any other
    must reach, so that the second pass scores few pairs (see ``NameCell``).  Pairs that cannot reach
    ``min_reported_score`` are not scored.
    """
    asked = materialize(
        inputs.where(F.col("normalized") != "")
        .select("normalized")
        .distinct()
        .select(
            F.col("normalized").alias("wanted"),
            F.split_part("normalized", F.lit(" "), F.lit(1)).alias("block"),
        ),
        "asked",
    )
    words = F.split("candidate", " ")
    first = words[0]
    beginnings = F.transform(
        F.sequence(F.lit(1), F.length(first)), lambda n: F.substring(first, F.lit(1), n)
    )
    every = sec_names.select(F.col("normalized").alias("candidate")).distinct().select(
        "candidate", F.explode(F.array_distinct(F.concat(words, beginnings))).alias("block")
    )
    listed = materialize(every.join(asked.select("block").distinct(), "block", "left_semi"), "listed")
    close, others = _by_pieces(asked, listed, float(min_reported_score))
    others = materialize(others, "others")
    found = close
    if not others.isEmpty():
        found = found.unionByName(_by_cells(others, listed, close, float(min_reported_score)))
    found = found.groupBy("wanted").agg(F.max("best").alias("best"))
    return found.select(F.col("wanted").alias("normalized"), "best.candidate", "best.score")


def _by_cells(asked: DataFrame, listed: DataFrame, known: DataFrame, least: float) -> DataFrame:
    """(wanted, best) by comparing every input with the whole block of its first word, cell by cell.

    ``known`` (wanted, best) are scores that another name must reach.
    """
    blocks = asked.groupBy("block").agg(F.count(F.lit(1)).alias("n_asked"))

    def parts(n: str, name: str):
        return F.ceil(F.col(n) / CELL_NAMES).cast("int").alias(name)

    sizes = blocks.join(listed.groupBy("block").agg(F.count(F.lit(1)).alias("n_listed")), "block").select(
        "block", parts("n_asked", "a"), parts("n_listed", "b")
    )
    right = _dealt(listed, "candidate", "b", "a", sizes)
    cell = ["block", "a", "b"]

    def best(rows: DataFrame, method: str) -> DataFrame:
        left = _dealt(rows, "wanted", "a", "b", sizes)
        found = left.groupBy(cell).cogroup(right.groupBy(cell)).applyInPandas(
            _of_cell(method), "wanted string, candidate string, score double"
        )
        return _best(found)

    def reached(by: DataFrame) -> DataFrame:
        scores = by.groupBy("wanted").agg(F.max("best.score").alias("score"))
        return asked.join(scores, "wanted", "left").select(
            "wanted", "block", F.coalesce("score", F.lit(least)).alias("least")
        )

    first = materialize(best(reached(known), "first"), "first")
    return first.unionByName(best(reached(known.unionByName(first)), "best"))


def resolve_identifiers(
    names: DataFrame,
    ticker_map: DataFrame,
    sec_names: DataFrame,
    fuzzy: bool = True,
    cutoff: float = SIMILARITY_CUTOFF,
    min_reported_score: float = 0.0,
) -> DataFrame:
    """(ticker, cik, resolution, input_name, matched_name, score) for (ticker, names).

    Steps in order: verified override, ticker list, one company with exactly this normalised name,
    several such companies (ambiguous), the most similar name at or above the cutoff if it belongs
    to one company, unresolved.  ``sec_names`` is read several times; pass a stored table.
    """
    spark = names.sparkSession
    fixed = spark.createDataFrame(OVERRIDES, "ticker string, o_cik long, o_name string")
    base = (
        names.withColumn("ticker", normalize_ticker("ticker"))
        .join(F.broadcast(fixed), "ticker", "left")
        .join(
            ticker_map.select("ticker", F.col("cik").alias("t_cik"), F.col("title").alias("t_name")),
            "ticker",
            "left",
        )
    )
    direct = base.where(F.col("o_cik").isNotNull() | F.col("t_cik").isNotNull()).select(
        "ticker",
        F.coalesce("o_cik", "t_cik").alias("cik"),
        F.when(F.col("o_cik").isNotNull(), F.lit("verified_override"))
        .otherwise(F.lit("ticker"))
        .alias("resolution"),
        F.try_element_at("names", F.lit(1)).alias("input_name"),
        F.when(F.col("o_cik").isNotNull(), F.col("o_name")).otherwise(F.col("t_name")).alias(
            "matched_name"
        ),
        F.lit(1.0).alias("score"),
    )
    rest = base.where(F.col("o_cik").isNull() & F.col("t_cik").isNull()).select("ticker", "names")
    index = name_index(sec_names)
    exact = (
        _named(rest).join(index, "normalized")
        .groupBy("ticker")
        .agg(
            F.min("cik").alias("x_cik"),
            (F.bool_and("unique") & (F.min("cik") == F.max("cik"))).alias("x_one"),
        )
    )
    joined = F.concat_ws(" | ", "names")
    state = materialize(rest.join(exact, "ticker", "left"), "state")
    by_cik = sec_names.groupBy("cik").agg(F.min("name").alias("matched_name"))
    found = (
        state.where("x_one")
        .select("ticker", F.col("x_cik").alias("cik"), joined.alias("input_name"))
        .join(by_cik, "cik", "left")
        .select(
            "ticker", "cik", F.lit("name_exact").alias("resolution"), "input_name", "matched_name",
            F.lit(1.0).alias("score"),
        )
    )
    nothing = F.lit(None)
    ambiguous = state.where("NOT x_one").select(
        "ticker", nothing.cast("long").alias("cik"), F.lit("ambiguous_exact").alias("resolution"),
        joined.alias("input_name"), nothing.cast("string").alias("matched_name"),
        nothing.cast("double").alias("score"),
    )
    open_ = state.where(F.col("x_cik").isNull()).select("ticker", "names")
    out = direct.unionByName(found).unionByName(ambiguous)
    if not fuzzy:
        left = open_.withColumn("score", nothing.cast("double"))
        return out.unionByName(_unresolved(left))
    asked = _named(open_)
    scored = asked.join(
        similar_names(asked, sec_names, min_reported_score), "normalized"
    )
    best = scored.groupBy("ticker").agg(
        F.max_by(
            F.struct("input_name", "candidate", "score"), F.struct("score", -F.col("place"))
        ).alias("_b")
    )
    best = materialize(best.select("ticker", "_b.*"), "similar")
    by_name = sec_names.groupBy(F.col("normalized").alias("candidate"), "cik").agg(
        F.min("name").alias("matched_name")
    )
    accepted = (
        best.where(F.col("score") >= cutoff)
        .join(index.where("unique").withColumnRenamed("normalized", "candidate"), "candidate")
        .join(by_name, ["candidate", "cik"])
        .select(
            "ticker", "cik", F.lit("name_fuzzy").alias("resolution"), "input_name", "matched_name",
            "score",
        )
    )
    left = open_.join(accepted.select("ticker"), "ticker", "left_anti").join(
        best.select("ticker", "score"), "ticker", "left"
    )
    return out.unionByName(accepted).unionByName(_unresolved(left))


def _named(rows: DataFrame) -> DataFrame:
    """One row per ticker and name, with the normalised name."""
    return rows.select("ticker", F.posexplode("names").alias("place", "input_name")).withColumn(
        "normalized", normalize_company_name("input_name")
    )


def _unresolved(rows: DataFrame) -> DataFrame:
    return rows.select(
        "ticker",
        F.lit(None).cast("long").alias("cik"),
        F.lit("unresolved").alias("resolution"),
        F.concat_ws(" | ", "names").alias("input_name"),
        F.lit(None).cast("string").alias("matched_name"),
        "score",
    )
