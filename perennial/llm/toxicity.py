"""Toxicity by a weighted finite-state pattern grammar.

Words become symbols: insult, threat, target (who is addressed), negation, reporting verb, clause
end, other.  Small transducers follow one scope each: negation reaches ``NEGATION_REACH`` words on,
reported speech to the end of its clause, a target a few words on.  A threat without a target before it
is pending for ``THREAT_REACH`` words of its clause and counts when a target follows, unless it is
negated or reported.  Their composition reads the symbols of
a text once and labels every matched insult or threat with the scopes that hold there; matches of a
clause are summed, so a clause is scored, not isolated words.  A logistic model turns
the amounts per kind of clause into a probability.

Insults are a fixed list and what labelled texts add: words and word beginnings (``stem*``) that
occur after many different words in toxic texts and hardly in others.  Counting the words before
them, not occurrences, keeps copies of one text from teaching its vocabulary.

Fitting uses at most ``FIT_ROWS`` labelled rows (in expectation, chosen by hash of the key), which
bound the entries too; scoring reads every text whole.  Texts without a listed word are not
walked: their amounts are 0.

Rules for special cases: null and empty texts have no matches and get the score of a text without
matches; without labelled rows, or with one label only, the prior weights of the grammar apply;
equal texts get equal scores; null labels are not learned from.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from perennial.functions.storage import materialize

FIT_ROWS = 10_000
LEAST_CONTEXTS = 4
LEAST_LOG_ODDS = 3.0
NEGATION_REACH = 3
TARGET_REACH = 2
THREAT_REACH = 3
STEM_LENGTHS = (4, 5, 6, 7)

#: General words of the classes in four languages.
INSULTS = """idiot idiots moron morons stupid loser losers scum trash worthless pathetic disgusting
clown dumb jerk filthy imbecile dummkopf trottel abschaum versager widerlich dumm imbécile minable
ordure crétin dégoûtant perdant idiota estúpido basura asqueroso inútil imbécil""".split()
THREATS = "kill hurt destroy beat burn töten verletzen vernichten tuer détruire blesser matar destruir".split()
TARGETS = """you your yours yourself he she him her they them du dich dir euch ihr tu toi vous votre
tú usted vosotros tuyo""".split()
NEGATIONS = "not never no neither nicht kein keine nie ne pas jamais nunca tampoco isn aren don".split()
REPORTS = """said says told reported quoted wrote claimed sagte schrieb behauptete dit écrit affirmé
dijo escribió afirmó""".split()

INSULT, THREAT, TARGET, NEGATION, REPORT, END, OTHER = range(7)
_TOKEN = re.compile(r"[^\W_]+|[.!?;:\n]+")
_WORD = re.compile(r"[^\W_]+")


@dataclass(frozen=True)
class Transducer:
    """``step[state][symbol]`` is the next state, ``mark[state]`` what holds for a match read there."""

    step: tuple[tuple[int, ...], ...]
    mark: tuple[int, ...]

    def compose(self, other: Transducer) -> Transducer:
        """Both at once: pairs of states, marks combined."""
        n = len(other.step)
        return Transducer(
            tuple(
                tuple(a[s] * n + b[s] for s in range(OTHER + 1))
                for a in self.step
                for b in other.step
            ),
            tuple(x | y for x in self.mark for y in other.mark),
        )


def within(opens: int, reach: int | None, mark: int) -> Transducer:
    """Marks matches up to ``reach`` words after the symbol ``opens``, or up to the clause end."""
    states = 2 if reach is None else reach + 1
    step = []
    for state in range(states):
        going = state if reach is None else max(0, state - 1)
        row = [going] * (OTHER + 1)
        row[opens], row[END] = states - 1, 0
        step.append(tuple(row))
    return Transducer(tuple(step), (0, *[mark] * (states - 1)))


NEGATED, REPORTED, ADDRESSED, PENDING = 1, 2, 4, 8
GRAMMAR = (
    within(NEGATION, NEGATION_REACH, NEGATED)
    .compose(within(REPORT, None, REPORTED))
    .compose(within(TARGET, TARGET_REACH, ADDRESSED))
    .compose(within(THREAT, THREAT_REACH, PENDING))
)
#: Amounts per text: plain, addressed, negated, reported insults; threats; clauses with a match.
AMOUNTS = 6
#: Prior weights of the amounts and the constant, used until labels teach others; one threat suffices.
PRIOR = np.array([2.2, 2.8, 0.8, 1.0, 5.2, 0.5, -3.0])


def words_of(text: str) -> list[str]:
    return _WORD.findall(text.lower())


@dataclass
class Lexicon:
    """Symbols and weights of words and of word beginnings."""

    words: dict[str, float]
    stems: dict[str, float]

    def __post_init__(self):
        self.symbols: dict[str, int] = {}
        for number, names in ((TARGET, TARGETS), (NEGATION, NEGATIONS), (REPORT, REPORTS)):
            self.symbols.update(dict.fromkeys(names, number))
        self.symbols.update(dict.fromkeys(THREATS, THREAT))
        self.lengths = sorted({len(s) for s in self.stems})
        self.seeds = frozenset(self.words) | frozenset(THREATS)

    def weight(self, word: str) -> float:
        best = self.words.get(word, 0.0)
        for n in self.lengths:
            if len(word) > n:
                best = max(best, self.stems.get(word[:n], 0.0))
        return best

    def might_match(self, text: str) -> bool:
        words = set(_WORD.findall(text))
        if not self.seeds.isdisjoint(words):
            return True
        stems = self.stems
        return any(
            not stems.keys().isdisjoint({w[:n] for w in words}) for n in self.lengths
        )

    def amounts(self, text: str | None) -> np.ndarray:
        """Runs the composed transducers over one text."""
        out = np.zeros(AMOUNTS)
        text = text.lower() if text else ""
        if not text or not self.might_match(text):
            return out
        state, clause, pending = 0, 0.0, 0.0
        for token in _TOKEN.findall(text):
            if not token[0].isalnum():
                state = GRAMMAR.step[state][END]
                out[5] += clause > 0
                clause = pending = 0.0
                continue
            weight = self.weight(token)
            symbol = INSULT if weight else self.symbols.get(token, OTHER)
            mark = GRAMMAR.mark[state]
            if not mark & PENDING:
                pending = 0.0
            if symbol == TARGET:
                out[4] += pending
                pending = 0.0
            if symbol in (INSULT, THREAT):
                amount = weight or 1.0
                clause += amount
                if symbol == THREAT:
                    if mark & ADDRESSED:
                        out[4] += amount
                    elif not mark & (NEGATED | REPORTED):
                        pending += amount
                elif mark & NEGATED:
                    out[2] += amount
                elif mark & REPORTED:
                    out[3] += amount
                else:
                    out[1 if mark & ADDRESSED else 0] += amount
            state = GRAMMAR.step[state][symbol]
        out[5] += clause > 0
        return np.log1p(out)


@dataclass
class Model:
    lexicon: Lexicon
    weights: np.ndarray

    def score(self, text: str | None) -> float:
        z = float(self.lexicon.amounts(text) @ self.weights[:-1] + self.weights[-1])
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


# --- learning -------------------------------------------------------------------------------


def _contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(feature, hash of the word before it) of each text, once per text; stems end in ``*``."""
    for batch in batches:
        for label, value in zip(batch.column(0).to_pylist(), batch.column(1)):
            pairs, before = set(), ""
            for w in words_of(value.as_py()):
                pairs.add((w, before))
                for n in STEM_LENGTHS:
                    if len(w) > n:
                        pairs.add((w[:n] + "*", before))
                before = w
            if pairs:
                names, befores = zip(*pairs)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([label] * len(names), pa.int32()),
                        pa.array(names, pa.string()),
                        pa.array(befores, pa.string()),
                    ],
                    names=["label", "feature", "word"],
                )


def learned_lexicon(rows: DataFrame) -> Lexicon:
    """From ``label`` and ``text``: entries with many contexts in toxic texts and few in others."""
    words = dict.fromkeys(INSULTS, 1.0)
    pairs = rows.mapInArrow(_contexts, "label int, feature string, word string")
    toxic = (
        pairs.where("label = 1").groupBy("feature").agg(F.countDistinct("word").alias("t"))
        .where(F.col("t") >= LEAST_CONTEXTS)
    )
    whole = pairs.where(~F.col("feature").endswith("*")).groupBy("label").agg(F.count("*").alias("n"))
    sizes = {r["label"]: r["n"] for r in whole.collect()}
    if not sizes.get(1) or not sizes.get(0):
        return Lexicon(words, {})
    clean = pairs.where("label = 0").groupBy("feature").agg(F.count("*").alias("c"))
    odds = F.log((F.col("t") + 0.5) / sizes[1]) - F.log((F.coalesce("c", F.lit(0)) + 0.5) / sizes[0])
    found = (
        toxic.join(clean, "feature", "left")
        .select("feature", "t", odds.alias("odds"))
        .where(F.col("odds") >= LEAST_LOG_ODDS)
    )
    stems: dict[str, float] = {}
    for r in found.collect():
        # an entry seen in few contexts weighs less
        weight = min(1.0, r["odds"] / 5.0) * min(1.0, r["t"] / 8.0)
        if r["feature"].endswith("*"):
            stems[r["feature"][:-1]] = weight
        else:
            words[r["feature"]] = max(words.get(r["feature"], 0.0), weight)
    return Lexicon(words, stems)


def logistic(x: np.ndarray, y: np.ndarray, prior: np.ndarray, strength: float = 0.5) -> np.ndarray:
    """Newton steps for logistic regression with a Gaussian prior around ``prior``."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w = prior.copy()
    pull = np.full(len(w), strength)
    pull[-1] = 1e-3
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (p - y) + pull * (w - prior)
        hessian = (x * (p * (1 - p))[:, None]).T @ x + np.diag(pull)
        step = np.linalg.solve(hessian, gradient)
        w = w - step
        if np.abs(step).max() < 1e-8:
            break
    return w


def fit(
    docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic"
) -> Model:
    """Learn lexicon and weights from the documents whose label in ``labels`` is 0 or 1.

    The labels are sampled before the join, so what is broadcast is bounded by ``FIT_ROWS``.
    """
    known = labels.select(
        F.col(f"`{key}`").alias("key"), F.col(f"`{label}`").cast("int").alias("label")
    ).where("label IN (0, 1) AND key IS NOT NULL")
    draw = F.pmod(F.xxhash64("key"), F.lit(1 << 20)) / float(1 << 20)
    chosen = known.where(draw < FIT_ROWS / max(1, known.count())).dropDuplicates(["key"])
    rows = materialize(
        docs.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text"))
        .where("text IS NOT NULL")
        .join(F.broadcast(chosen), "key")
        .select("label", "text"),
        "labelled",
    )
    lexicon = learned_lexicon(rows)
    sent = docs.sparkSession.sparkContext.broadcast(lexicon)

    def measure(batches):
        for batch in batches:
            values = [sent.value.amounts(t.as_py()) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([v.tolist() for v in values], pa.list_(pa.float64()))],
                names=["label", "x"],
            )

    found = rows.mapInArrow(measure, "label int, x array<double>").collect()
    labels = np.array([r["label"] for r in found], float)
    if not len(labels) or labels.min() == labels.max():
        return Model(lexicon, PRIOR)
    return Model(lexicon, logistic(np.array([r["x"] for r in found]), labels, PRIOR))


def with_toxicity(docs: DataFrame, model: Model, text: str = "text", result: str = "score") -> DataFrame:
    """Add the probability that a text is toxic."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        model = sent.value
        for texts in batches:
            yield pa.array([model.score(t.as_py()) for t in texts], pa.float64())

    return docs.withColumn(result, score(F.col(f"`{text}`")))
