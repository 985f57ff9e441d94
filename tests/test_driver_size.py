"""What the driver has to hold does not grow with the data."""

import datetime as dt

from perennial.operators import asof as A
from pyspark.sql import functions as F


def test_a_panel_of_months_is_not_broadcast(spark):
    months = 60
    names = [("s.0",), ("s.1",), ("s.1",), ("s.2",), (None,)]
    data = (
        spark.createDataFrame(names, "ticker string")
        .repartition(4)
        .select("ticker", F.explode(F.sequence(F.lit(24000), F.lit(24000 + months - 1))).alias("period_idx"))
    )
    # more listed tickers than there are in the panel, but fewer than its rows
    listed = [("S-0", 5), ("s.1", 6), ("S.1", 7), (None, 8), *[(f"X-{k}", 100 + k) for k in range(200)]]
    ids = spark.createDataFrame(listed, "ticker string, cik long")
    day = dt.date(2001, 2, 28)
    timeline = spark.createDataFrame(
        [(5, day, 1.0), (7, day, 2.0), (6, day, 3.0), (8, day, 4.0)], "cik long, filed date, x double"
    )
    out = A.attach_point_in_time(data, ids, timeline, ["x"])
    found = {}
    for r in out.collect():
        found.setdefault((r.ticker, r.cik), []).append(r.x)
    assert {k: len(v) for k, v in found.items()} == {
        ("S-0", 5): months, ("S-1", 7): 2 * months, ("S-2", None): months, (None, None): months,
    }
    assert {k: sum(filter(None, v)) for k, v in found.items()} == {
        ("S-0", 5): 46.0, ("S-1", 7): 2.0 * 2 * 46, ("S-2", None): 0, (None, None): 0,
    }
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan, plan


def test_rows_without_a_ticker_do_not_meet_in_one_task(spark):
    data = spark.range(0, 400, 1, 8).select(
        F.when(F.col("id") % 10 == 0, F.lit("s.0")).alias("ticker"), F.col("id").alias("row")
    )
    ids = spark.createDataFrame([("S-0", 5), (None, 6)], "ticker string, cik long")
    out = A.map_identifiers(data, ids)
    rows = out.withColumn("task", F.spark_partition_id()).collect()
    assert out.columns == ["ticker", "row", "cik"] and sorted(r.row for r in rows) == [*range(400)]
    assert {(r.ticker, r.cik) for r in rows} == {("S-0", 5), (None, None)}
    assert len({r.task for r in rows if r.ticker is None}) == 8
