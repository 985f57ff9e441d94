import unicodedata

import numpy as np
import pytest
from llm_helpers import ROWS, awkward, empty
from pyspark.sql import functions as F

from perennial.llm import langid

TEXTS = {
    "en": "the cat and the other thing that they have with the weather this three days ",
    "de": "der hund und die andere sache nicht schön über straße zwischen auch sich ",
    "ru": "это простой русский текст который читает человек ",
    "el": "αυτό είναι ένα απλό κείμενο που διαβάζει ο άνθρωπος ",
}


@pytest.fixture(scope="module")
def model(spark):
    rows = [(i, t * 5, name) for i, (name, t) in enumerate(list(TEXTS.items()) * 4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    return langid.fit(docs, F.col("doc_id"))


def best_path(scores, penalty):
    """Viterbi word by word in plain Python."""
    state, back = list(scores[0]), []
    for row in scores[1:]:
        top = max(range(len(state)), key=lambda k: (state[k], -k))
        back.append([top if state[top] - penalty > state[k] else k for k in range(len(state))])
        state = [state[back[-1][k]] - penalty * (back[-1][k] != k) + row[k] for k in range(len(state))]
    label = max(range(len(state)), key=lambda k: (state[k], -k))
    path = [label]
    for b in reversed(back):
        path.append(b[path[-1]])
    return path[::-1]


def test_viterbi_of_many_texts():
    draw = np.random.default_rng(2)
    scores = draw.normal(0, 3, (200, 3)).astype(np.float32)
    first = np.array([0, 5, 5, 60, 61, 200])
    path = langid.viterbi(scores, first, 4.0)
    for lo, hi in zip(first[:-1], first[1:]):
        if hi > lo:
            assert path[lo:hi].tolist() == best_path(scores[lo:hi].astype(float).tolist(), 4.0)


def test_spans_of_mixed_text(model):
    text = TEXTS["en"] + TEXTS["ru"] + TEXTS["de"]
    names = [name for _, _, name in langid.spans(model, text)]
    assert names == ["en", "ru", "de"]
    start, end, _ = langid.spans(model, text)[1]
    assert text[start:end].strip() == TEXTS["ru"].strip()


def test_scripts_narrow_candidates(model):
    assert langid.spans(model, "αβγ")[0][2] == "el"
    assert langid.spans(model, "日本語") == [(0, 3, langid.UNKNOWN)]


def test_held_out_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    apart = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    fitted = langid.fit(docs.where(~apart), F.col("doc_id"))
    found = langid.with_language(docs.where(apart), fitted)
    right = found.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0]
    assert right > 0.98


def test_awkward_table(spark, model):
    got = langid.with_language(awkward(spark, {"score": "old"}), model)
    rows = {r["doc_id"]: r for r in got.collect()}
    assert got.count() == len(ROWS)
    for i in (3, 4, 5, 6):
        assert (rows[i]["lang_pred"], rows[i]["score"]) == ("und", 0.0)
    assert rows[9]["lang_pred"] != "und" and rows[9]["score"] == 0.0
    assert rows[7]["lang_pred"] == "en" and 0 <= rows[7]["score"] <= 1
    assert langid.with_language(empty(spark), model).count() == 0
    nothing = langid.fit(empty(spark), F.col("doc_id"))
    assert {r["lang_pred"] for r in langid.with_language(awkward(spark), nothing).collect()} == {"und"}
    kept = langid.keep_identified(awkward(spark))
    assert kept.columns == awkward(spark).columns and kept.count() < len(ROWS)


def test_labelled_languages_of_unlisted_scripts(spark):
    texts = {
        "gu": "આ એક સરળ ગુજરાતી લખાણ છે જે માણસ વાંચે છે ",
        "te": "ఇది ఒక సాధారణ తెలుగు వచనం మనిషి చదువుతాడు ",
        "am": "ይህ ቀላል የአማርኛ ጽሑፍ ነው ሰው ያነባል ",
        **TEXTS,
    }
    rows = [(i, t * 3, name) for i, (name, t) in enumerate(list(texts.items()) * 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    fitted = langid.fit(docs, F.col("doc_id"))
    assert fitted.languages == sorted(texts)
    found = langid.with_language(docs, fitted).collect()
    assert all(r["lang_pred"] == r["lang"] and r["score"] > 0.9 for r in found)
    assert langid.keep_identified(docs).count() == len(rows)


def test_every_letter_has_a_script():
    points = [c for c in range(0x110000) if unicodedata.category(chr(c))[0] == "L"]
    assert (langid.script_of(np.array(points, np.uint32)) > 0).all()
    assert (langid.script_of(np.array([0x20, 0x31, 0x21, 0x10FFFF], np.uint32)) == 0).all()
