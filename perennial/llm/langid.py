"""Language identification of mixed text: script ranges, word scores and a Viterbi path.

A word is a run of letters of one script.  The script narrows its candidates to the languages that
use it.  Each candidate scores the word by the sum of log probabilities of its letter trigrams
(with a mark before and after the word), learned from labelled texts and hashed into
``2 ** TRIGRAM_BITS`` cells.  A Viterbi pass over the words with a penalty for every change of
language labels spans of words; the language with most letters is the prediction, and its share of
all letters, times how surely its words were told from the next best language, is the score.

Fitting takes at most ``FIT_TEXTS`` labelled texts, chosen by hash of their key, the same number for
each language where there are enough: a bound on the fit, not on what is predicted.  Tasks send one
table of counts per language; the model's size depends on the number of languages only.

The pass runs for all texts of a piece at once: step t treats the t-th word of every text.

Rules for special cases: a null text, or one without a letter, is ``und`` with score 0; words in
scripts that no learned language uses belong to ``und``; with no labelled text everything is
``und``; ties go to the first language by code point; equal texts get equal predictions; texts are
read to their end.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from perennial.functions.storage import materialize
from perennial.llm.textops import mix64, pieces, thrifty, utf8, with_result

TRIGRAM_BITS = 16
FIT_TEXTS = 12_000
SWITCH_PENALTY = 8.0
UNKNOWN = "und"
_U = np.uint64

#: Blocks of letters by script, first and last code point; other scripts go by their names.
SCRIPTS = (
    ("latin", ((0x41, 0x5A), (0x61, 0x7A), (0xAA, 0xAA), (0xB5, 0xB5), (0xBA, 0xBA), (0xC0, 0xD6),
               (0xD8, 0xF6), (0xF8, 0x24F), (0x250, 0x2AF), (0x1E00, 0x1EFF), (0xFF21, 0xFF3A),
               (0xFF41, 0xFF5A))),
    ("greek", ((0x370, 0x373), (0x376, 0x377), (0x37B, 0x37D), (0x37F, 0x37F), (0x386, 0x386),
               (0x388, 0x3FF), (0x1F00, 0x1FFF))),
    ("cyrillic", ((0x400, 0x481), (0x48A, 0x52F), (0x1C80, 0x1C8F))),
    ("armenian", ((0x531, 0x556), (0x561, 0x587))),
    ("hebrew", ((0x5D0, 0x5EA),)),
    ("arabic", ((0x620, 0x64A), (0x66E, 0x6D3), (0x6FA, 0x6FF), (0x750, 0x77F))),
    ("devanagari", ((0x900, 0x963), (0x971, 0x97F))),
    ("bengali", ((0x980, 0x9E3),)),
    ("tamil", ((0xB80, 0xBD7),)),
    ("thai", ((0xE01, 0xE3A), (0xE40, 0xE4E))),
    ("georgian", ((0x10A0, 0x10FF),)),
    ("hangul", ((0x1100, 0x11FF), (0xAC00, 0xD7A3))),
    ("kana", ((0x3041, 0x309F), (0x30A1, 0x30FA))),
    ("han", ((0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0x20000, 0x2FFFF))),
)
_LETTER = regex.compile(r"\p{L}")
#: First words of character names that stand for a listed script.
_ALIKE = {"cjk": "han", "hiragana": "kana", "katakana": "kana"}


def _script_name(point: int) -> str:
    words = unicodedata.name(chr(point), "other").lower().replace("-", " ").split()
    first = words[1] if words[0] in ("fullwidth", "halfwidth") else words[0]
    return _ALIKE.get(first, first)


def _zones() -> tuple[tuple[str, ...], np.ndarray]:
    """Script names and the script of each code point: the listed ranges, then every other letter by
    the first word of its name, with the marks of scripts that are not listed."""
    names = ["none", *[name for name, _ in SCRIPTS], "other"]
    listed = len(names)
    number = {name: i for i, name in enumerate(names)}
    zone = np.zeros(0x32400, np.int16)
    for i, (_, ranges) in enumerate(SCRIPTS):
        for lo, hi in ranges:
            zone[lo : hi + 1] = i + 1
    rest = [(p, unicodedata.category(chr(p))[0]) for p in np.flatnonzero(zone == 0).tolist()]
    for p, kind in rest:
        if kind == "L":
            zone[p] = number.setdefault(_script_name(p), len(number))
    for p, kind in rest:
        if kind == "M" and number.get(_script_name(p), 0) >= listed:
            zone[p] = number[_script_name(p)]
    return tuple(number), zone


SCRIPT_NAMES, _ZONE = _zones()


def script_of(points: np.ndarray) -> np.ndarray:
    """Number of the script of each code point, 0 for no letter."""
    return _ZONE[np.where(points < len(_ZONE), points, 0)]


_FOLD = np.arange(0x3000, dtype=np.uint32)
for _c in range(0x3000):
    _low = chr(_c).lower()
    if len(_low) == 1:
        _FOLD[_c] = ord(_low)


def code_points(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code points of UTF-8 bytes, and where each text begins among them."""
    points = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
    lead = np.zeros(len(data) + 1, np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=lead[1:])
    return points, lead[bounds]


@dataclass
class WordTable:
    """Words of consecutive texts with the trigram cells of their letters."""

    cells: np.ndarray  # one per letter: the trigram that ends there; then one per word for its end
    starts: np.ndarray
    lengths: np.ndarray
    scripts: np.ndarray
    first: np.ndarray


def word_table(data: np.ndarray, bounds: np.ndarray) -> WordTable:
    points, begin = code_points(data, bounds)
    n = len(points)
    script = script_of(points)
    folded = points.copy()
    small = points < 0x3000
    folded[small] = _FOLD[points[small]]
    change = np.ones(n, bool)
    change[1:] = script[1:] != script[:-1]
    change[begin[:-1][begin[:-1] < n]] = True
    run = np.flatnonzero(change)
    length = np.diff(np.append(run, n))
    word = script[run] > 0
    starts, lengths = run[word], length[word]
    at_start = np.zeros(n, bool)
    at_start[starts] = True
    second = np.zeros(n, bool)
    second[starts[lengths > 1] + 1] = True
    one = np.zeros(n, np.uint32)
    two = np.zeros(n, np.uint32)
    one[1:], two[2:] = folded[:-1], folded[:-2]
    one[at_start] = 0x20
    two[at_start] = 0
    two[second] = 0x20
    key = (two.astype(_U) << _U(42)) | (one.astype(_U) << _U(21)) | folded.astype(_U)
    cells = (mix64(key) >> _U(64 - TRIGRAM_BITS)).astype(np.int32)
    last = starts + lengths - 1
    tail = (one[last].astype(_U) << _U(42)) | (folded[last].astype(_U) << _U(21)) | _U(0x20)
    end = (mix64(tail) >> _U(64 - TRIGRAM_BITS)).astype(np.int32)
    return WordTable(
        np.concatenate([cells, end]), starts, lengths, script[starts], np.searchsorted(starts, begin)
    )


@dataclass
class Model:
    languages: list[str]
    #: log probabilities, languages first
    weights: np.ndarray
    #: which languages use which script
    uses: np.ndarray
    penalty: float = SWITCH_PENALTY
    rows: np.ndarray = field(init=False)

    def __post_init__(self):
        self.rows = np.ascontiguousarray(self.weights.T)

    def word_scores(self, t: WordTable) -> np.ndarray:
        """One row per word; languages that don't use its script are out of reach."""
        words, n = len(t.starts), len(t.cells) - len(t.starts)
        owner = np.repeat(np.arange(words), t.lengths)
        shift = np.cumsum(t.lengths) - t.lengths
        letters = np.arange(len(owner)) + np.repeat(t.starts - shift, t.lengths)
        scores = np.empty((words, len(self.languages)), np.float32)
        for k in range(len(self.languages)):
            each = self.weights[k][t.cells]
            scores[:, k] = np.add.reduceat(each[letters], shift) if words else 0
            scores[:, k] += each[n:]
        scores[~self.uses[t.scripts]] = -1e6
        return scores

    def predict(self, data: np.ndarray, bounds: np.ndarray):
        """Language number (-1 for none) and score of each text."""
        t = word_table(data, bounds)
        texts, count = len(bounds) - 1, len(self.languages)
        if not count or not len(t.starts):
            return np.full(texts, -1), np.zeros(texts), t, np.zeros(0, int)
        scores = self.word_scores(t)
        path = viterbi(scores, t.first, self.penalty)
        owner = np.repeat(np.arange(texts), np.diff(t.first))
        known = self.uses[t.scripts].any(axis=1)
        letters = np.bincount(
            (owner * count + path)[known], t.lengths[known].astype(float), texts * count
        ).reshape(texts, count)
        best = letters.argmax(axis=1)
        total = np.bincount(owner, t.lengths.astype(float), texts)
        # how much better the spans of the language are explained by it than by the next one
        inside = np.where((path == best[owner])[:, None], scores, 0)
        margin = np.add.reduceat(
            np.vstack([inside, np.zeros((1, count))]), np.minimum(t.first[:-1], len(scores))
        )
        margin[np.diff(t.first) == 0] = 0
        rows = np.arange(texts)
        own = margin[rows, best].copy()
        margin[rows, best] = -np.inf
        next_best = margin.max(axis=1) if count > 1 else own - 50
        sure = 1 / (1 + np.exp(-np.clip(own - next_best, -50, 50)))
        share = np.divide(letters[rows, best], total, out=np.zeros(texts), where=total > 0)
        found = letters[rows, best] > 0
        return np.where(found, best, -1), np.where(found, share * sure, 0.0), t, path


def viterbi(scores: np.ndarray, first: np.ndarray, penalty: float) -> np.ndarray:
    """Best label of every word; ``first`` gives the words of each text."""
    lengths = np.diff(first)
    by_length = np.argsort(-lengths, kind="stable")
    begin, lengths = first[:-1][by_length], lengths[by_length]
    longest = int(lengths.max(initial=0))
    live = np.searchsorted(-lengths, -np.arange(longest), "left")
    path = np.zeros(len(scores), np.int16)
    came = np.zeros(len(scores), np.int16)  # label that a change at this word comes from
    changed = np.zeros(scores.shape, bool)
    state = np.zeros((len(lengths), scores.shape[1]), np.float32)
    for t in range(longest):
        k = live[t]
        at = begin[:k] + t
        if t:
            top = state[:k].argmax(axis=1)
            enter = state[np.arange(k), top][:, None] - np.float32(penalty)
            change = enter > state[:k]
            came[at] = top
            changed[at] = change
            state[:k] = np.where(change, enter, state[:k])
        state[:k] += scores[at]
        state[:k] -= state[:k].max(axis=1, keepdims=True)
    label = state.argmax(axis=1)
    for t in range(longest - 1, -1, -1):
        k = live[t]
        at = begin[:k] + t
        path[at] = label[:k]
        label[:k] = np.where(changed[at, label[:k]], came[at], label[:k])
    return path


@thrifty
def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Trigram and script counts of the task's texts by language."""
    cells: dict[str, np.ndarray] = {}
    scripts: dict[str, np.ndarray] = {}
    for batch in batches:
        names = batch.column(0).to_pylist()
        data, offsets = utf8(batch.column(1))
        for i, name in enumerate(names):
            t = word_table(data[offsets[i] : offsets[i + 1]], np.array([0, offsets[i + 1] - offsets[i]]))
            if not len(t.starts):
                continue
            n = len(t.cells) - len(t.starts)
            keep = np.zeros(len(t.cells), bool)
            keep[n:] = True
            inside = np.zeros(n + 1, np.int64)
            np.add.at(inside, t.starts, 1)
            np.add.at(inside, t.starts + t.lengths, -1)
            keep[:n] = np.cumsum(inside)[:n] > 0
            cells.setdefault(name, np.zeros(1 << TRIGRAM_BITS, np.int64))
            cells[name] += np.bincount(t.cells[keep], minlength=1 << TRIGRAM_BITS)
            scripts.setdefault(name, np.zeros(len(SCRIPT_NAMES), np.int64))
            scripts[name] += np.bincount(t.scripts, t.lengths, len(SCRIPT_NAMES)).astype(np.int64)
    rows = [
        (name, int(i), int(c[i]))
        for name in cells
        for c in [np.concatenate([cells[name], scripts[name]])]
        for i in np.flatnonzero(c)
    ]
    columns = list(zip(*rows)) or [(), (), ()]
    yield pa.RecordBatch.from_arrays(
        [pa.array(columns[0], pa.string()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.int64())],
        names=["lang", "cell", "n"],
    )


def fit(
    labelled: DataFrame, key: Column, text: str = "text", lang: str = "lang", texts: int = FIT_TEXTS
) -> Model:
    """Learn from at most ``texts`` (in expectation) of the rows with a language.

    A language's rows are taken where a hash of the key is below its quota.
    """
    rows = labelled.select(
        F.col(f"`{lang}`").alias("lang"),
        F.col(f"`{text}`").alias("text"),
        (F.pmod(F.xxhash64(key), F.lit(1 << 20)) / float(1 << 20)).alias("draw"),
    ).where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    sizes = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    if not sizes:
        return Model([], np.zeros((0, 1 << TRIGRAM_BITS), np.float32), np.zeros((len(SCRIPT_NAMES), 0), bool))
    quota = texts / len(sizes)
    chosen = F.coalesce(
        F.create_map(*[F.lit(x) for name, n in sizes.items() for x in (name, quota / n)])[F.col("lang")],
        F.lit(0.0),
    )
    counted = (
        rows.where(F.col("draw") < chosen)
        .select("lang", "text")
        .mapInArrow(_counts, "lang string, cell long, n long")
        .groupBy("lang", "cell")
        .agg(F.sum("n").alias("n"))
    )
    names = sorted(sizes)
    table = np.zeros((len(names), (1 << TRIGRAM_BITS) + len(SCRIPT_NAMES)), np.float64)
    where = {name: i for i, name in enumerate(names)}
    for r in materialize(counted, "trigrams").toLocalIterator():
        table[where[r["lang"]], r["cell"]] = r["n"]
    learned = table.sum(axis=1) > 0
    names = [n for n, ok in zip(names, learned) if ok]
    table = table[learned]
    cells, scripts = table[:, : 1 << TRIGRAM_BITS], table[:, 1 << TRIGRAM_BITS :]
    smooth = 0.5
    logs = np.log((cells + smooth) / (cells.sum(axis=1, keepdims=True) + smooth * cells.shape[1]))
    share = scripts / np.maximum(1, scripts.sum(axis=1, keepdims=True))
    return Model(names, logs.astype(np.float32), (share >= 0.02).T.copy())


RESULT = T.StructType().add("lang_pred", T.StringType()).add("score", T.DoubleType())


def predictor(sent) -> Column:
    """Arrow function from texts to language and score; ``sent`` is a broadcast model."""

    @F.arrow_udf(RESULT)
    @thrifty
    def predict(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        model: Model = sent.value
        for texts in batches:
            names, scores = [], []
            data, offsets = utf8(texts)
            for lo, hi in pieces(offsets):
                best, score, _, _ = model.predict(
                    data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
                )
                names += [model.languages[b] if b >= 0 else UNKNOWN for b in best]
                scores += score.tolist()
            for i in [i for i, name in enumerate(names) if name == UNKNOWN]:
                # letters of scripts that no learned language uses: no candidate, but not wordless
                value = texts[i].as_py()
                if value and model.languages and _LETTER.search(value):
                    names[i], scores[i] = model.languages[0], 0.0
            yield pa.StructArray.from_arrays(
                [pa.array(names, pa.string()), pa.array(scores, pa.float64())], ["lang_pred", "score"]
            )

    return predict


def with_language(
    docs: DataFrame, model: Model, text: str = "text", names: tuple[str, str] = ("lang_pred", "score")
) -> DataFrame:
    """Add the predicted language and its score; columns with these names are replaced."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    result = predictor(sent)(F.col(f"`{text}`"))
    return with_result(docs, result, {"lang_pred": names[0], "score": names[1]})


def spans(model: Model, text: str) -> list[tuple[int, int, str]]:
    """Runs of one language in a text: first and end code point, language."""
    data, offsets = utf8(pa.array([text], pa.large_string()))
    _, _, t, path = model.predict(data, offsets)
    out: list[tuple[int, int, str]] = []
    for start, length, script, label in zip(t.starts, t.lengths, t.scripts, path):
        name = model.languages[label] if model.uses[script].any() else UNKNOWN
        if out and out[-1][2] == name:
            out[-1] = (out[-1][0], int(start + length), name)
        else:
            out.append((int(start), int(start + length), name))
    return out


def keep_identified(docs: DataFrame, key: str = "doc_id", least: float = 0.5) -> DataFrame:
    """Documents whose language is told with a score of ``least`` or more, with their own columns.

    Learns from the documents that carry a language.
    """
    model = fit(docs, F.col(f"`{key}`"))
    sent = docs.sparkSession.sparkContext.broadcast(model)
    found = predictor(sent)(F.col("text"))
    return docs.where((found["lang_pred"] != UNKNOWN) & (found["score"] >= least))
