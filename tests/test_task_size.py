"""What a task has to hold does not grow with the data."""

import random
import re

import pytest
from pyspark.sql import functions as F

from perennial.functions import order as O


def test_ranges_are_ranked_in_tasks_of_bounded_size_and_sorted_once(spark, monkeypatch):
    monkeypatch.setattr(O, "TASK_ROWS", 50)
    rnd = random.Random(7)
    rows = [(k % 3, str(k), rnd.choice([None, float(rnd.randrange(40)), float("nan")])) for k in range(600)]
    data = spark.createDataFrame(rows, "g int, id string, x double")
    ranked = O.with_average_rank(data, ["g"], "x", ["id"], "r", rows_per_range=60)
    plan = ranked._jdf.queryExecution().executedPlan().toString()
    assert "REPARTITION_BY_NUM" in plan
    assert len(re.findall(r"Sort \[g#\d+ \S+ NULLS FIRST, _range#\d+ \S+ NULLS FIRST, x#", plan)) == 1, plan
    for g in range(3):
        values = sorted((x != x, x) for h, _, x in rows if h == g and x is not None)
        want = {}
        for at, v in enumerate(values, 1):
            want.setdefault(str(v[1]), []).append(at)
        got = {str(r.x): r.r for r in ranked.where(F.col("g") == g).collect() if r.x is not None}
        assert got == {v: pytest.approx(sum(places) / len(places)) for v, places in want.items()}
