import random

import numpy as np
from llm_helpers import ROWS, awkward, empty, fold

from perennial.llm import decontam


def plain(docs, items, window=10):
    """Hit words and items of each text by comparing every window with every place."""
    out = []
    for text in docs:
        w, hit, names = decontam.words_of(text), set(), set()
        for name, item in items:
            x = decontam.words_of(item)
            size = min(window, len(x))
            for i in range(max(0, len(x) - size + 1) if x else 0):
                for j in range(len(w) - size + 1):
                    if w[j : j + size] == x[i : i + size]:
                        hit |= set(range(j, j + size))
                        names.add(str(name))
        out.append((len(w), len(hit), ",".join(sorted(names))))
    return out


def run(spark, docs, items, window):
    table = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    rows = decontam.with_contamination(table, bench, window).orderBy("doc_id").collect()
    return [
        (c["n_words"], sum(p["words"] for p in c["places"]), ",".join(c["items"]))
        for c in (r["contamination"] for r in rows)
    ]


def test_random_texts(spark, monkeypatch):
    draw = random.Random(5)

    def text(n):
        return draw.choice([" ", ", ", "\n"]).join(draw.choice(["A", "b", "c", "é", "12"]) for _ in range(n))

    docs = [text(draw.randint(0, 60)) for _ in range(60)] + [None, "", "..."]
    items = [(i, text(draw.randint(0, 9))) for i in range(12)] + [(12, None), (3, "A b c")]
    want = plain(docs, [(n, t or "") for n, t in items], 4)
    assert run(spark, docs, items, 4) == want
    monkeypatch.setattr(decontam, "BLOCK_BYTES", 20)  # many blocks of items
    assert run(spark, docs, items, 4) == want
    monkeypatch.setattr(decontam, "SHARD_BYTES", 50)
    assert run(spark, docs, items, 4) == want


def test_suffix_array_orders_by_words():
    draw = np.random.default_rng(1)
    words = draw.integers(1, 4, 300).astype(np.uint64)
    array = decontam.SuffixArray(words, 8, np.unique(words))
    keys = [tuple(words[i : i + 8]) + (0,) * max(0, i + 8 - 300) for i in array.order]
    assert keys == sorted(keys)


def test_removal_and_awkward_table(spark):
    bench = spark.createDataFrame([(1, "Jumps over the lazy dog"), (2, None), (3, "")], "item_id long, text string")
    docs = awkward(spark, {"contamination": "old", "note": "x"})
    kept = decontam.remove_contaminated(docs.drop("contamination"), bench)
    assert kept.columns == docs.drop("contamination").columns
    assert kept.count() == len(ROWS) - 3
    marked = decontam.with_contamination(docs, bench)
    assert marked.count() == len(ROWS) and marked.columns.count("contamination") == 1
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontam.remove_contaminated(docs.drop("contamination"), none).count() == len(ROWS)
    assert decontam.remove_contaminated(empty(spark), bench).count() == 0


def test_words():
    assert decontam.words_of("Don't STOP-me_now É9") == ["don", "t", "stop", "me", "now", "É9"]
    assert fold("É") == "É"


def test_very_long_item(spark):
    size = 60_000
    item = [f"w{i * 7919 % 50_021}" for i in range(size)]
    items = decontam.Items([("1", " ".join(item)), ("2", "one two")], 10)
    arrays = [v for v in vars(items).values() if isinstance(v, np.ndarray)]
    assert sum(a.nbytes for a in arrays) < 100 * size
    docs = [" ".join(item), "x " + " ".join(item[300:500]) + " y", "so one two", " ".join(item[:9])]
    table = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")
    bench = spark.createDataFrame([(1, " ".join(item)), (2, "one two")], "item_id long, text string")
    rows = decontam.with_contamination(table, bench).orderBy("doc_id").collect()
    assert [r["contamination"]["longest"] for r in rows] == [size, 200, 2, 0]


def test_removal_keeps_a_column_named_contamination(spark):
    items = spark.createDataFrame([(1, "never seen words here")], "item_id long, text string")
    docs = awkward(spark, {"Contamination": "own", "_own": "other"})
    kept = decontam.remove_contaminated(docs, items)
    assert kept.columns == docs.columns and kept.where("Contamination = 'own'").count() == docs.count()
