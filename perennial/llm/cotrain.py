"""Quality classifier by co-training two views of a document.

The content view sees words (hashed to ``BUCKETS`` counts), the metadata view sees what describes the page: source,
language, length and layout (lines, repetition, marks, capitals).  Each view is a logistic
classifier.  In every round each one labels all unlabelled documents it is sure of and hands them to
the *other* view, which learns from them; a label once given stays.  Classes are balanced by weights.
After ``ROUNDS`` both are calibrated on labelled rows kept apart from all rounds (Platt scaling), and
the calibrated log odds are combined by weights fitted on the same rows.

Every unlabelled row takes part.  The features of all rows are stored once; each Newton step is a job
over them whose tasks add up loss, gradient and Hessian, and these sums are added in slices.  A row's
given label follows from the views' weights of the rounds so far, so nothing is stored for it.

Bounds: at most ``FIT_ROWS`` labelled rows (in expectation, by hash of the key) teach and calibrate;
only they and sums of fixed size reach the driver.  The fitted model has a fixed size.

Rules for special cases: null or empty text has no words and layout zero; a null source or language
is a value of its own; null labels, and labels other than 0 and 1, are not learned from; without
labels of both kinds every score is 0.5; equal rows get equal scores; an empty table gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from perennial.functions.storage import materialize
from perennial.llm.textops import SPACED, pieces, split_words, utf8

BUCKETS = 1024
SOURCES = 64
LANGUAGES = 16
FIT_ROWS = 3_000
ROUNDS = 4
SURE = 0.9
#: A given label weighs so much of a known one.
GIVEN = 0.5
RIDGE = (0.02, 0.1)
STEPS = 12
#: Newton's method ends where the next step promises less than this for each unit of weight.
LEAST_GAIN = 1e-6
#: Rows that are made numbers at once, and parts in which sums travel.
ROWS = 2_000
SLICES = 32
_LAYOUT = 10
META = SOURCES + LANGUAGES + _LAYOUT
_MARKS = np.zeros(256, bool)
_MARKS[[ord(c) for c in "!|#$%&*<>{}[]=~^"]] = True
_SURE_ODDS = np.log(SURE / (1 - SURE))
_BREAK = re.compile(r"\n+")


def content(texts: pa.Array) -> np.ndarray:
    """Square roots of word shares per bucket, one row per text."""
    data, offsets = utf8(texts)
    rows = []
    for lo, hi in pieces(offsets):
        bounds = offsets[lo : hi + 1] - offsets[lo]
        words = split_words(data[offsets[lo] : offsets[hi]], bounds, SPACED)
        bucket = (words.hashes % np.uint64(BUCKETS)).astype(np.int64)
        counts = np.diff(words.first)
        owner = np.repeat(np.arange(hi - lo), counts)
        grid = np.bincount(owner * BUCKETS + bucket, minlength=(hi - lo) * BUCKETS)
        share = grid.reshape(hi - lo, BUCKETS) / np.maximum(1, counts)[:, None]
        rows.append(np.sqrt(share).astype(np.float32))
    return np.vstack(rows) if rows else np.zeros((0, BUCKETS), np.float32)


def layout(texts: pa.Array) -> np.ndarray:
    data, offsets = utf8(texts)
    rows = []
    for lo, hi in pieces(offsets):
        raw = data[offsets[lo] : offsets[hi]]
        bounds = offsets[lo : hi + 1] - offsets[lo]
        words = split_words(raw, bounds, SPACED)

        def share(flag, whole):
            total = np.zeros(len(raw) + 1, np.int64)
            np.cumsum(flag, out=total[1:])
            return (total[bounds[1:]] - total[bounds[:-1]]) / np.maximum(1, whole)

        size = np.diff(bounds)
        counts = np.diff(words.first)
        distinct = np.array(
            [len(np.unique(words.hashes[a:b])) for a, b in zip(words.first[:-1], words.first[1:])]
        )
        lines = share(raw == 10, np.ones(len(size)))
        rows.append(
            np.column_stack(
                [
                    np.log1p(size) / 10,
                    np.log1p(counts) / 10,
                    distinct / np.maximum(1, counts),
                    share(_MARKS[raw], size) * 5,
                    share((raw >= 65) & (raw <= 90), size) * 3,
                    share((raw >= 48) & (raw <= 57), size) * 5,
                    np.log1p(lines) / 5,
                    np.minimum(1, lines * 100 / np.maximum(1, size)),
                    size / np.maximum(1, counts) / 20,
                    size == 0,
                ]
            )
        )
    return np.vstack(rows).astype(np.float32) if rows else np.zeros((0, _LAYOUT), np.float32)


def metadata(texts: pa.Array, source_cell: pa.Array, lang_cell: pa.Array) -> np.ndarray:
    x = np.zeros((len(texts), META), np.float32)
    at = np.arange(len(texts))
    x[at, np.asarray(source_cell)] = 1
    x[at, SOURCES + np.asarray(lang_cell)] = 1
    x[:, SOURCES + LANGUAGES :] = layout(texts)
    return x


def cell(value: Column, cells: int) -> Column:
    """Hash cell of a value; 0 is for null."""
    return F.when(value.isNull(), 0).otherwise(1 + F.pmod(F.xxhash64(value), F.lit(cells - 1))).cast("int")


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float) -> np.ndarray:
    """Weighted logistic regression by Newton steps; the last coefficient is the constant."""
    x = np.hstack([x, np.ones((len(x), 1), x.dtype)]).astype(np.float64)
    w = np.zeros(x.shape[1])
    pull = np.full(len(w), ridge)
    pull[-1] = 1e-3
    for _ in range(12):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (weight * (p - y)) + pull * w
        hessian = (x * (weight * np.maximum(1e-4, p * (1 - p)))[:, None]).T @ x + np.diag(pull)
        step = np.linalg.solve(hessian, gradient)
        w -= step
        if np.abs(step).max() < 1e-5:
            break
    return w


def _odds(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    return np.clip(x @ w[:-1].astype(np.float32) + w[-1], -30, 30).astype(float)


def _probability(z):
    return 1 / (1 + np.exp(-z))


@dataclass
class Model:
    content: np.ndarray
    metadata: np.ndarray
    #: per view: slope and constant of the calibration
    scales: np.ndarray
    #: weights of the two calibrated log odds, and constant
    combine: np.ndarray

    def score(self, c: np.ndarray, m: np.ndarray) -> np.ndarray:
        """Columns: content view, metadata view, combined."""
        if not len(self.content):
            return np.full((len(c), 3), 0.5)
        z = np.column_stack([_odds(c, self.content), _odds(m, self.metadata)])
        z = z * self.scales[:, 0] + self.scales[:, 1]
        return _probability(np.column_stack([z, z @ self.combine[:2] + self.combine[2]]))


NOTHING = Model(np.zeros(0), np.zeros(0), np.zeros((2, 2)), np.zeros(3))


def given(views, history, free: np.ndarray) -> list[np.ndarray]:
    """Per view: the label of the first round in which the other view was sure of a ``free`` row, or -1."""
    out = []
    for v in range(2):
        label = np.full(len(free), -1)
        for weights in history:
            z = _odds(views[1 - v], weights[1 - v])
            sure = (label < 0) & free & (np.abs(z) >= _SURE_ODDS)
            label[sure] = z[sure] > 0
        out.append(label)
    return out


def _sums(x: np.ndarray, y: np.ndarray, weight: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Loss, gradient and upper half of the Hessian of a weighted logistic regression, in one row."""
    d = len(w)
    total = np.zeros(1 + d + d * (d + 1) // 2)
    upper = np.triu_indices(d)
    for at in range(0, len(x), ROWS):
        some = x[at : at + ROWS]
        some = np.hstack([some, np.ones((len(some), 1), np.float32)])
        label, each = y[at : at + ROWS], weight[at : at + ROWS]
        z = np.clip(some @ w.astype(np.float32), -30, 30).astype(float)
        p = _probability(z)
        total[0] += each @ (np.logaddexp(0, z) - label * z)
        total[1 : d + 1] += some.T @ (each * (p - label))
        bend = (each * np.maximum(1e-4, p * (1 - p))).astype(np.float32)
        total[d + 1 :] += ((some * bend[:, None]).T @ some)[upper]
    return total


def _unpack(total: np.ndarray, d: int) -> tuple[float, np.ndarray, np.ndarray]:
    hessian = np.zeros((d, d))
    hessian[np.triu_indices(d)] = total[d + 1 :]
    return total[0], total[1 : d + 1], hessian + np.triu(hessian, 1).T


def _pool_counts(views, history, free) -> np.ndarray:
    return np.array([[(g == c).sum() for c in (0, 1)] for g in given(views, history, free)])


def _pool_sums(views, history, free, balance, weights) -> list[np.ndarray | None]:
    """Sums of the rows with a given label; a view without ``weights`` is left out."""
    out = []
    for v, label in enumerate(given(views, history, free)):
        if weights[v] is None:
            out.append(None)
            continue
        have = label >= 0
        y = label[have]
        out.append(_sums(views[v][have], y.astype(float), GIVEN * balance[v][y], weights[v]))
    return out


class LocalPool:
    """Unlabelled rows in memory."""

    def __init__(self, views, free: np.ndarray):
        self.views, self.free = views, free

    def counts(self, history) -> np.ndarray:
        return _pool_counts(self.views, history, self.free)

    def sums(self, history, balance, weights):
        return _pool_sums(self.views, history, self.free, balance, weights)


class StoredPool:
    """Unlabelled rows as a table with the features ``x``."""

    def __init__(self, table: DataFrame):
        self.sc = table.sparkSession.sparkContext
        # a task takes several pieces of the table: one set of sums for each core
        self.table = table.select("x").coalesce(max(1, self.sc.defaultParallelism))

    def _added(self, task, size: int) -> np.ndarray:
        """The sum over all batches of the arrays that ``task`` makes of their views."""
        cuts = np.linspace(0, size, SLICES + 1).astype(int)

        def each(batches):
            total = np.zeros(size)
            for b in batches:
                for at in range(0, len(b), ROWS):
                    x = _stored(b.column(0).slice(at, ROWS))
                    total += task((x[:, :BUCKETS], x[:, BUCKETS:]), np.ones(len(x), bool))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(range(SLICES), pa.int32()),
                    pa.array([TaskContext.get().partitionId()] * SLICES, pa.int32()),
                    pa.array([total[i:j].astype("<f8").tobytes() for i, j in zip(cuts, cuts[1:])], pa.binary()),
                ],
                names=["slice", "part", "sums"],
            )

        def add(rows: pa.Table) -> pa.Table:
            rows = rows.sort_by("part")
            total = np.sum([np.frombuffer(r, "<f8") for r in rows["sums"].to_pylist()], axis=0)
            return pa.table({"slice": rows["slice"][:1], "sums": pa.array([total.tobytes()], pa.binary())})

        found = (
            self.table.mapInArrow(each, "slice int, part int, sums binary")
            .groupBy("slice")
            .applyInArrow(add, "slice int, sums binary")
            .collect()
        )
        if not found:
            return np.zeros(size)
        return np.concatenate([np.frombuffer(r["sums"], "<f8") for r in sorted(found, key=lambda r: r["slice"])])

    def counts(self, history) -> np.ndarray:
        sent = self.sc.broadcast(history)
        total = self._added(lambda views, free: _pool_counts(views, sent.value, free).ravel(), 4)
        return total.reshape(2, 2)

    def sums(self, history, balance, weights):
        sent = self.sc.broadcast((history, balance, weights))
        sizes = [0 if w is None else 1 + len(w) + len(w) * (len(w) + 1) // 2 for w in weights]

        def task(views, free):
            found = _pool_sums(views, sent.value[0], free, sent.value[1], sent.value[2])
            return np.concatenate([f for f in found if f is not None])

        total = self._added(task, sum(sizes))
        return [total[: sizes[0]] if sizes[0] else None, total[sizes[0] :] if sizes[1] else None]


def _stored(cells: pa.Array) -> np.ndarray:
    rows = b"".join(cells.to_pylist())
    return np.frombuffer(rows, "<f2").reshape(len(cells), -1).astype(np.float32)


def newton(weights: list[np.ndarray], whole: float, evaluate) -> list[np.ndarray]:
    """Both views' optimum at once; ``evaluate`` gives each open view's loss, gradient and Hessian.

    A step that makes the loss larger is halved.
    """
    best: list = [None, None]
    trial = list(weights)
    open_ = {0, 1}
    for _ in range(STEPS):
        found = evaluate([trial[v] if v in open_ else None for v in range(2)])
        for v in sorted(open_):
            loss, gradient, hessian = found[v]
            pull = np.full(len(trial[v]), RIDGE[v])
            pull[-1] = 1e-3
            loss += 0.5 * (pull * trial[v] ** 2).sum()
            if best[v] is not None and loss > best[v][0] + 1e-6 * whole:
                trial[v] = (trial[v] + best[v][1]) / 2
                continue
            gradient = gradient + pull * trial[v]
            step = np.linalg.solve(hessian + np.diag(pull), gradient)
            best[v] = (loss, trial[v])
            trial[v] = trial[v] - step
            if gradient @ step < LEAST_GAIN * whole:
                open_.discard(v)
        if not open_:
            break
    return [best[v][1] if v in open_ else trial[v] for v in range(2)]


def cotrain(
    views: tuple[np.ndarray, np.ndarray], labels: np.ndarray, apart: np.ndarray, rounds: int = ROUNDS
) -> Model:
    """``labels`` is 0, 1 or -1 (unlabelled); rows ``apart`` calibrate and never teach."""
    return learn(views, labels, apart, LocalPool(views, (labels < 0) & ~apart), rounds)


def learn(views, labels: np.ndarray, apart: np.ndarray, pool, rounds: int = ROUNDS) -> Model:
    """As ``cotrain``, with the unlabelled rows in a ``pool``."""
    known = (labels >= 0) & ~apart
    if len(np.unique(labels[known])) < 2:
        return NOTHING
    own, y = [view[known] for view in views], labels[known]
    history: list[list[np.ndarray]] = []
    weights = [np.zeros(view.shape[1] + 1) for view in views]
    for done in range(rounds + 1):
        mass = np.tile(np.bincount(y, minlength=2).astype(float), (2, 1))
        if done:
            mass += GIVEN * pool.counts(history)
        # both classes weigh the same
        balance = mass.sum(axis=1, keepdims=True) / 2 / mass

        def evaluate(weights):
            more = pool.sums(history, balance, weights) if history else [None, None]
            out: list = [None, None]
            for v, w in enumerate(weights):
                if w is not None:
                    total = _sums(own[v], y.astype(float), balance[v][y], w)
                    out[v] = _unpack(total if more[v] is None else total + more[v], len(w))
            return out

        weights = newton(weights, mass.sum() / 2, evaluate)
        history.append(weights)
    check = apart & (labels >= 0)
    z = np.column_stack([_odds(views[v], weights[v]) for v in range(2)])
    if len(np.unique(labels[check])) < 2:
        return Model(*weights, np.array([[1.0, 0.0]] * 2), np.array([0.5, 0.5, 0.0]))
    y, one = labels[check].astype(float), np.ones(check.sum())
    scales = np.array([logistic(z[check][:, [v]], y, one, 0.01) for v in range(2)])
    combine = logistic(z[check] * scales[:, 0] + scales[:, 1], y, one, 0.1)
    return Model(*weights, scales, combine)


def _inputs(docs: DataFrame, text: str, source: str, lang: str) -> list[Column]:
    return [
        F.col(f"`{text}`"),
        cell(F.col(f"`{source}`"), SOURCES),
        cell(F.col(f"`{lang}`"), LANGUAGES),
    ]


def fit(
    docs: DataFrame,
    labels: DataFrame,
    key: str = "doc_id",
    label: str = "quality",
    text: str = "text",
    source: str = "source",
    lang: str = "lang",
) -> Model:
    """Learn from ``labels`` (key and label) and from documents without a label."""
    known = labels.select(
        F.col(f"`{key}`").alias("key"), F.col(f"`{label}`").cast("int").alias("label")
    ).where("label IN (0, 1) AND key IS NOT NULL").groupBy("key").agg(F.min("label").alias("label"))
    counts = {r["label"]: r["count"] for r in known.groupBy("label").count().collect()}
    if len(counts) < 2:
        return NOTHING
    draw = F.pmod(F.xxhash64("key", F.lit("quality")), F.lit(1 << 20)) / float(1 << 20)
    # rare labels are taken more often: half of the rows for each where there are enough
    quota = F.create_map(
        *[F.lit(x) for n, c in counts.items() for x in (n, FIT_ROWS / 2 / c)]
    )[F.col("label")]
    known = known.select("key", "label", (draw < quota).alias("chosen"))

    def features(batches):
        for b in batches:
            for at in range(0, len(b), ROWS):
                some = b.slice(at, ROWS)
                x = np.hstack([content(some.column(1)), metadata(some.column(1), some.column(2), some.column(3))])
                yield pa.RecordBatch.from_arrays(
                    [some.column(0), pa.array([r.astype("<f2").tobytes() for r in x], pa.binary())],
                    names=["own", "x"],
                )

    own = docs.select(F.col(f"`{key}`").alias("own"), *_inputs(docs, text, source, lang))
    kind = own.schema["own"].dataType.simpleString()
    rows = own.mapInArrow(features, f"own {kind}, x binary")
    # the labels meet the features, which are smaller than the texts
    table = materialize(
        rows.join(known, F.col("own") == F.col("key"), "left")
        .where("label IS NULL OR chosen")
        .select(F.col("own").cast("string").alias("key"), "label", "x"),
        "features",
    )
    apart = F.pmod(F.xxhash64("key", F.lit("apart")), F.lit(4)) == 0
    found = table.where("label IS NOT NULL").select("label", "x", apart.alias("apart")).orderBy("key", "x").collect()
    if not found:
        return NOTHING
    x = _stored(pa.array([r["x"] for r in found], pa.binary()))
    return learn(
        (x[:, :BUCKETS], x[:, BUCKETS:]),
        np.array([r["label"] for r in found]),
        np.array([bool(r["apart"]) for r in found]),
        StoredPool(table.where("label IS NULL")),
    )


def with_quality(
    docs: DataFrame, model: Model, text: str = "text", source: str = "source", lang: str = "lang"
) -> DataFrame:
    """Add the struct ``quality``: ``content``, ``metadata`` (the views) and ``score`` (combined)."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    names = ["content", "metadata", "score"]

    @F.arrow_udf("content double, metadata double, score double")
    def score(
        batches: Iterator[tuple[pa.Array, pa.Array, pa.Array]],
    ) -> Iterator[pa.Array]:
        model = sent.value
        for texts, sources, langs in batches:
            parts = []
            for at in range(0, len(texts), 2000):
                some = texts.slice(at, 2000)
                m = metadata(some, sources.slice(at, 2000), langs.slice(at, 2000))
                parts.append(model.score(content(some), m))
            p = np.vstack(parts) if parts else np.zeros((0, 3))
            yield pa.StructArray.from_arrays(
                [pa.array(np.ascontiguousarray(p[:, i])) for i in range(3)], names
            )

    return docs.withColumn("quality", score(*_inputs(docs, text, source, lang)))
