from llm_helpers import awkward, empty

import corpus_pipeline
from perennial.llm import decontam, pii


def test_stages_take_effect(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    before = {r["doc_id"]: r["text"] for r in docs.collect()}
    mixed = corpus_pipeline.run(spark, sf)
    assert mixed.columns == docs.columns
    rows = mixed.collect()
    assert len({r["doc_id"] for r in rows}) > 0.5 * len(before)
    assert all(r["n_chars"] == len(r["text"]) for r in rows)
    items = [r["text"] for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    windows = set()
    for item in items:
        w = decontam.words_of(item)
        windows |= {tuple(w[i : i + 10]) for i in range(len(w) - 9)}
    for doc_id, text in {r["doc_id"]: r["text"] for r in rows}.items():
        w = decontam.words_of(before[doc_id])
        assert not any(tuple(w[i : i + 10]) in windows for i in range(len(w) - 9))
        assert text == pii.mask(before[doc_id], pii.find_spans(before[doc_id]))


def test_awkward_tables(spark, tmp_path):
    spark.createDataFrame([(1, "lazy dog")], "item_id long, text string").write.parquet(
        f"{tmp_path}/benchmark.parquet"
    )
    for docs in (awkward(spark, {"k": "1", "size": "2", "score": "3", "node": "4", "taken": "5"}), empty(spark)):
        now = docs
        for _, stage in corpus_pipeline.STAGES:
            now = stage(spark, now, str(tmp_path))
            assert now.columns == docs.columns
        now.count()
