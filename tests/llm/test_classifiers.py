import numpy as np
from llm_helpers import ROWS, awkward, empty
from pyspark.sql import functions as F

from perennial.llm import cotrain, toxicity

SF = "/root/testdata/sf0.1"


def test_grammar_scopes():
    lexicon = toxicity.Lexicon({"idiot": 1.0}, {"réeux": 0.5})
    kind = lambda text: np.flatnonzero(lexicon.amounts(text)[:5]).tolist()
    assert kind("such an idiot here") == [0]
    assert kind("you idiot") == [1]
    assert kind("he is not an idiot") == [2]
    assert kind("not one two three idiot") == [0]
    assert kind("she said what an idiot") == [3]
    assert kind("she said so. an idiot") == [0]
    assert kind("I saw you kill") == [4] and kind("kill") == []
    assert kind("un réeuxpa") == [0] and kind("réeux") == [] and kind("idiotic") == []
    assert lexicon.amounts("idiot one. two idiot")[5] == np.log1p(2)
    assert not lexicon.amounts(None).any() and not lexicon.amounts("").any()


def test_threats_with_the_target_after_them():
    lexicon = toxicity.Lexicon({}, {})
    threat = lambda text: lexicon.amounts(text)[4]
    for text in ("I will kill you", "we will hurt them", "I'll destroy you", "kill all of you", "beat and burn him"):
        assert threat(text) > 0
    assert threat("burn you and you") == threat("I saw you kill him") == np.log1p(1)
    assert threat("beat and burn him") == np.log1p(2)
    for text in ("kill it. you", "kill one two three you", "will not kill you", "she said we all kill you"):
        assert threat(text) == 0


def test_composition_is_both_at_once():
    a = toxicity.within(toxicity.NEGATION, 2, 1)
    b = toxicity.within(toxicity.REPORT, None, 2)
    both, draw = a.compose(b), np.random.default_rng(1)
    x = y = z = 0
    for symbol in draw.integers(0, 7, 500).tolist():
        assert both.mark[z] == a.mark[x] | b.mark[y]
        x, y, z = a.step[x][symbol], b.step[y][symbol], both.step[z][symbol]


def test_toxicity_held_out(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    apart = F.crc32(F.col("doc_id").cast("string")) % 3 == 1
    model = toxicity.fit(docs, labels.where(~apart))
    scored = toxicity.with_toxicity(docs.join(labels.where(apart), "doc_id"), model)
    rows = scored.select("toxic", "score").collect()
    hit = [r["score"] >= 0.7 for r in rows if r["toxic"] == 1]
    false = [r["score"] >= 0.7 for r in rows if r["toxic"] == 0]
    assert sum(hit) > 0.85 * len(hit) and sum(false) < 0.01 * len(false)


def test_toxicity_awkward(spark):
    labels = spark.createDataFrame([(1, 1), (4, 0), (8, None), (None, 1), (1, 1)], "doc_id long, toxic int")
    for known in (labels, labels.where("false"), labels.where("toxic = 1")):
        model = toxicity.fit(awkward(spark), known)
        scored = toxicity.with_toxicity(awkward(spark, {"score": "old"}), model)
        rows = scored.collect()
        assert len(rows) == len(ROWS) and all(0 <= r["score"] <= 1 for r in rows)
        assert toxicity.with_toxicity(empty(spark), model).count() == 0


def test_quality_held_out(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    apart = F.crc32(F.col("doc_id").cast("string")) % 3 == 1
    model = cotrain.fit(docs, labels.where(~apart))
    known = labels.where(apart).withColumnRenamed("quality", "label")
    scored = cotrain.with_quality(docs.join(known, "doc_id"), model)
    right = ((F.col("quality.score") >= 0.5).cast("int") == F.col("label")).cast("int")
    assert scored.agg(F.avg(right)).first()[0] > 0.96


def test_views_teach_each_other():
    draw = np.random.default_rng(3)
    y = draw.integers(0, 2, 3000)
    views = tuple(
        (draw.normal(0, 1, (3000, 8)) + np.outer(2 * y - 1, np.full(8, 0.6))).astype(np.float32) for _ in range(2)
    )
    labels = np.where(np.arange(3000) < 60, y, -1)
    apart = np.arange(3000) % 3 == 0
    right = lambda m: ((m.score(*views)[:, 2] >= 0.5) == y)[60:].mean()
    assert right(cotrain.cotrain(views, labels, apart)) >= right(cotrain.cotrain(views, labels, apart, 0)) - 0.01
    assert right(cotrain.cotrain(views, labels, apart)) > 0.95


def test_every_sure_row_teaches(spark):
    """A mark of a few unlabelled rows, of which the content view is less sure than of many others."""
    n, draw = 6000, np.random.default_rng(5)
    y = np.arange(n) % 2
    rare = (np.arange(n) >= n - 80) & (y == 1)
    strength = np.where(rare, 2.0, 4.0)
    views = (
        (draw.normal(0, 0.2, (n, 2)) + np.outer((2 * y - 1) * strength, [1, 0.5])).astype(np.float32),
        np.column_stack([draw.normal(0, 1, n), rare]).astype(np.float32),
    )
    labels = np.where(np.arange(n) < 400, y, -1)
    apart = (np.arange(n) % 4 == 0) & (labels >= 0)
    assert cotrain.cotrain(views, labels, apart).metadata[1] > 1


def test_sums_of_a_stored_pool(spark):
    draw = np.random.default_rng(8)
    x = draw.normal(0, 1, (300, cotrain.BUCKETS + cotrain.META)).astype("<f2")
    views = (x[:, : cotrain.BUCKETS].astype(np.float32), x[:, cotrain.BUCKETS :].astype(np.float32))
    local = cotrain.LocalPool(views, np.ones(300, bool))
    table = spark.createDataFrame([(r.tobytes(),) for r in x], "x binary").repartition(7)
    stored = cotrain.StoredPool(table)
    weights = [draw.normal(0, 0.1, v.shape[1] + 1) for v in views]
    history, balance = [weights, [-w for w in weights]], np.array([[0.7, 1.3], [1.0, 1.0]])
    assert (local.counts(history) == stored.counts(history)).all() and local.counts(history).min() > 0
    for one in (weights, [None, weights[1]], [weights[0], None]):
        for a, b in zip(local.sums(history, balance, one), stored.sums(history, balance, one)):
            assert (a is None and b is None) or np.allclose(a, b, rtol=1e-3, atol=1e-2)


def test_quality_awkward(spark):
    labels = spark.createDataFrame(
        [(1, 1), (4, 0), (6, 0), (7, 1), (8, None), (None, 1), (9, 7)], "doc_id long, quality int"
    )
    for known in (labels, labels.where("false"), labels.where("quality = 1")):
        model = cotrain.fit(awkward(spark), known)
        rows = cotrain.with_quality(awkward(spark, {"quality": "old"}), model).collect()
        assert len(rows) == len(ROWS) and all(0 <= r["quality"]["score"] <= 1 for r in rows)
        assert cotrain.with_quality(empty(spark), model).count() == 0


def test_toxicity_labels_beside_columns_of_their_names(spark):
    docs = awkward(spark, {"label": "x", "key": "y", "toxic": "z"})
    labels = spark.createDataFrame([(1, 1), (8, 0)], "doc_id long, toxic int")
    scored = toxicity.with_toxicity(docs, toxicity.fit(docs, labels))
    assert scored.columns == [*docs.columns, "score"] and scored.count() == docs.count()


def test_one_threat_is_enough():
    model = toxicity.Model(toxicity.Lexicon({}, {}), toxicity.PRIOR)
    assert model.score("I will kill you") >= 0.7
    for text in ("they said I will kill you", "I will not kill you", "kill the process", "you are kind"):
        assert model.score(text) < 0.7
