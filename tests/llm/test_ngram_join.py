import random

from llm_helpers import ROWS, awkward, classes, empty, shingles

from perennial.llm import ngram_join


def near_copies(seed, families, members, size):
    """Families of texts that differ in a few words, some beyond the threshold."""
    draw = random.Random(seed)
    texts = []
    for _ in range(families):
        base = [f"w{draw.randrange(400)}" for _ in range(draw.randint(size // 2, size))]
        for _ in range(draw.randint(1, members)):
            copy = list(base)
            for _ in range(draw.choice([0, 0, 1, 1, 2, 3, 6])):
                copy[draw.randrange(len(copy))] = f"x{draw.randrange(10**6)}"
            if draw.random() < 0.2:
                copy = copy[: -draw.randint(1, 5)]
            texts.append(" ".join(copy))
    draw.shuffle(texts)
    return texts


def check(spark, texts, n, top):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = ngram_join.ngram_jaccard_join(docs, n, (top, 100)).orderBy("doc_id").collect()
    assert [r["n_shingles"] for r in rows] == [len(shingles(t, n)) for t in texts]
    assert [r["component_id"] for r in rows] == classes(texts, n, top)


def test_families(spark):
    shared = " ".join(f"common{i}" for i in range(40))
    texts = near_copies(1, 25, 8, 60)
    texts += [f"{t} {shared}" for t in near_copies(2, 30, 1, 60)]  # a passage in many texts
    check(spark, [*texts, "a", "a", "A b", "a b", "", None, " ", "a b c", "a b c d e f g h i j k l"], 3, 90)


def test_one_crowded_family(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "PIVOTS", 1)
    monkeypatch.setattr(ngram_join, "BLOCK_BYTES", 4096)
    check(spark, near_copies(3, 1, 1, 120) * 3 + near_copies(4, 2, 60, 100), 5, 80)


def test_crowds(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "PIVOTS", 1)
    monkeypatch.setattr(ngram_join, "CROWD", 3)
    monkeypatch.setattr(ngram_join, "CENTRE", 3)
    monkeypatch.setattr(ngram_join, "CELL_ROWS", 5)
    one = near_copies(8, 1, 1, 150)[0].split()
    draw, texts = random.Random(9), []
    for _ in range(60):  # around one text, cut to several lengths and changed in few or many places
        copy = one[: len(one) - draw.choice([0, 0, 0, 3, 8, 20, 30])]
        for _ in range(draw.choice([0, 1, 1, 2, 2, 3, 4, 9])):
            copy[draw.randrange(len(copy))] = f"x{draw.randrange(30)}"
        texts.append(" ".join(copy))
    check(spark, [*texts, *near_copies(10, 12, 5, 40), "a b", "a b", "a b c d", ""], 3, 90)
    check(spark, texts, 3, 100)
    check(spark, texts, 5, 60)


def test_ranked_shingles(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "MOST_RANKED", 5)
    monkeypatch.setattr(ngram_join, "GATHERED", 50)
    check(spark, near_copies(6, 12, 12, 40), 3, 80)


def test_components_of_a_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 90)], "a long, b long")
    got = {r["node"]: r["comp"] for r in ngram_join.components(edges).collect()}
    assert got == {**dict.fromkeys(range(61), 0), 100: 90, 90: 90}


def test_one_of_each(spark):
    docs = awkward(spark, {"k": "old", "keeper": "old"})
    kept = ngram_join.one_of_each(docs)
    assert kept.columns == docs.columns
    ids = sorted((r["doc_id"] or -1) for r in kept.collect())
    assert ids == [-1, 1, 3, 4, 5, 6, 7, 8, 9]
    assert ngram_join.one_of_each(empty(spark)).count() == 0
    assert ngram_join.ngram_jaccard_join(awkward(spark)).count() == len(ROWS)


def test_equal_keys_of_different_texts(spark):
    one, two = "a b c d e f g h", "i j k l m n o p q"
    docs = spark.createDataFrame([(5, one), (5, two), (6, two), (7, one)], "doc_id long, text string")
    kept = ngram_join.one_of_each(docs)
    assert sorted((r["doc_id"], r["text"]) for r in kept.collect()) in (
        [(5, one)], [(5, two)], [(5, one), (5, two)],
    )


def test_unrelated_texts_of_one_key_all_stay(spark):
    one, two = "a b c d e f g h", "i j k l m n o p q"
    long = " ".join(f"w{i}" for i in range(60))
    rows = [
        (5, one, "x"), (5, two, "x"), (5, two, "y"), (6, two, "x"), (7, one, "x"),
        (8, long, "x"), (8, f"{long} end", "x"), (8, "", "x"), (8, " ", "x"),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    kept = sorted(tuple(r) for r in ngram_join.one_of_each(docs.repartition(3)).collect())
    assert kept[:2] == [(5, one, "x"), (5, two, "x")]
    assert [r[1] for r in kept[2:4]] == ["", " "]
    assert len(kept) == 5 and kept[4][1] in (long, f"{long} end")


def test_one_of_each_keeps_columns(spark):
    docs = awkward(spark, {"_keeper": "a", "_body": "b", "_place": "c", "k": "d", "h": "e"})
    kept = ngram_join.one_of_each(docs)
    assert kept.columns == docs.columns
    assert {tuple(r) for r in kept.select("_keeper", "_body", "_place", "k", "h").collect()} == {tuple("abcde")}
