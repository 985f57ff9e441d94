from collections import Counter

from llm_helpers import ROWS, awkward, empty, words

from perennial.llm import mixing


def levels(sizes: dict, most: int = 3) -> dict:
    """Raise a common level until all is shared: sources at their bound drop out one after another."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: 1 + i % 3 for i, s in enumerate(order)}
    target, open_ = {}, set(order)
    while open_:
        left = sum(sizes.values()) - sum(target.values())
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = {s for s in open_ if share[s] >= most * sizes[s]}
        if not over:
            return target | share
        target |= {s: float(most * sizes[s]) for s in over}
        open_ -= over
    return target


def test_targets_and_copies(spark):
    rows = mixing.mixture_plan(awkward(spark, {"target": "old"})).collect()
    sizes = Counter()
    for r in ROWS:
        sizes[r[3]] += len(words(r[1]))
    want = levels(sizes)
    assert len(rows) == len(ROWS)
    for r in rows:
        assert r["size"] == len(words(r["text"]))
        assert r["source_size"] == sizes[r["source"]]
        assert abs(r["target"] - want[r["source"]]) < 1e-6 * max(1, want[r["source"]])
        assert int(r["rate"]) <= r["copies"] <= int(r["rate"]) + 1 <= 4
        assert r["taken"] == r["copies"] * r["size"] <= 3 * r["size"]
    twins = [r["copies"] for r in rows if r["doc_id"] == 2]
    assert twins[0] == twins[1]
    again = mixing.mixture_plan(awkward(spark)).collect()
    assert sorted(r["taken"] for r in again) == sorted(r["taken"] for r in rows)


def test_many_documents_come_near_the_target(spark):
    docs = spark.range(20_000).selectExpr(
        "id AS doc_id", "repeat('w ', int(1 + id % 40)) AS text",
        "IF(id % 3 = 0, 'hot', concat('s', id % 7)) AS source",
    )
    plan = mixing.mixture_plan(docs).groupBy("source").agg({"taken": "sum", "target": "max"})
    for r in plan.collect():
        assert abs(r["sum(taken)"] - r["max(target)"]) < 0.05 * r["max(target)"]


def test_emitted_rows(spark):
    plan = mixing.mixture_plan(awkward(spark))
    mixed = mixing.emit_copies(plan, awkward(spark).columns)
    assert mixed.columns == awkward(spark).columns
    assert mixed.count() == sum(r["copies"] for r in plan.collect())
    assert mixing.mixture_plan(empty(spark)).count() == 0


def test_no_python_in_the_plan(spark):
    plan = mixing.mixture_plan(awkward(spark))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_clashing_columns(spark):
    names = ["_rate_m", "_target_m", "_source_size_m", "_size_m", "_draw_m", "_source_m", "rate"]
    plan = mixing.mixture_plan(awkward(spark, dict.fromkeys(names, "own")))
    assert plan.count() == awkward(spark).count()
    assert {tuple(r) for r in plan.select(*names[:-1]).collect()} == {("own",) * 6}
