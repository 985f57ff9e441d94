"""Cases in which a plausible operator goes wrong."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from perennial.functions import student
from perennial.functions.storage import materialize, owned_tables, shared_folder
from perennial.operators import portfolio as PF
from perennial.operators import seasonal as S
from perennial.operators.crosssection import ranked_in_month
from perennial.plans import screener as P
from perennial.plans import walkforward as WF
from perennial.sources import prices as SP


def test_nan_benchmark_is_missing(spark):
    obs = spark.sql("SELECT DATE'2020-01-02' AS entry_date, DATE'2020-01-09' AS exit_date, 0.1D AS ret")
    bench = spark.createDataFrame(
        [(dt.date(2020, 1, 2), float("nan")), (dt.date(2020, 1, 9), 5.0)], "date date, adj_close double"
    )
    row = S.add_benchmark(obs, bench).first()
    assert row.bench_ret is None and row.excess is None and row.beat is False


def test_missing_scores_rank_last(spark):
    rows = spark.createDataFrame(
        [(1, "a", None), (1, "b", 0.5), (1, "c", 0.9), (1, "d", None)], "period_idx int, ticker string, s double"
    )
    for descending, order in ((True, "cbad"), (False, "bcad")):
        got = ranked_in_month(rows, "s", "rank", descending=descending).orderBy("rank").collect()
        assert "".join(r.ticker for r in got) == order


def test_repeated_tickers_are_held_once(spark):
    rows = spark.createDataFrame(
        [(1, "a", 0.1, 0.0, 0.0, 1.0), (1, "a", 0.3, 0.0, 0.0, 1.0), (1, "b", 0.2, 0.0, 0.0, 1.0)],
        "period_idx int, ticker string, prediction double, ret double, bench_ret double, beta_24m double",
    )
    got = PF.eligible(rows, 2).collect()
    assert sorted((r.ticker, r.prediction) for r in got) == [("a", 0.3), ("b", 0.2)]
    assert PF.eligible(rows, 3).count() == 0


@pytest.mark.parametrize("confidence", [0.8, 0.95, 0.99, 0.999])
def test_student_quantiles_of_all_sizes(spark, confidence):
    rows = spark.range(1, 400).select("id", student.student_quantile(F.col("id"), confidence).alias("t"))
    for r in rows.collect():
        assert student.student_cdf(r.t, r.id) == pytest.approx(confidence, abs=2e-9)


def test_first_version_predicts_small_months(spark):
    assert WF.MODELS["v3"].min_test_rows == 10 and WF.MODELS["v5"].min_test_rows == 30
    features = WF.MODELS["v3"].features
    values = ", ".join(f"rand({i}) AS {f}" for i, f in enumerate(features))
    panel = spark.range(12 * 30).selectExpr(
        "int(id % 30) AS period_idx", "string(id div 30) AS ticker", "rand(99) AS residual",
        *values.split(", "),
    )
    panel = materialize(panel, "panel")
    got = WF.run_walk_forward(panel, WF.MODELS["v3"], 20, 29, training_months=18)
    assert "quality" in got.columns
    assert got.groupBy("period_idx").count().where("count = 12").count() == 10


def test_grid_of_more_than_a_year(spark):
    windows = spark.createDataFrame([(8, 1), (2, 29), (12, 31)], "entry_month int, entry_day int")
    got = P.with_grid_dates(windows, dt.date(2023, 8, 1), 400).collect()
    assert sorted(str(r.upcoming_entry_date) for r in got) == [
        "2023-08-01", "2023-12-31", "2024-02-29", "2024-08-01",
    ]


def test_ticker_filter_reaches_the_files(spark, tmp_path):
    rows = spark.range(100).selectExpr("concat('t', id) AS ticker", "DATE'2020-01-01' AS date", "1D AS adj_close")
    SP.write_prices(rows, f"{tmp_path}/p", buckets=8)
    found = SP.read_prices(spark, f"{tmp_path}/p", ["t5"], buckets=8)
    assert [r.ticker for r in found.collect()] == ["T5"]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(ticker_bucket" in plan and "EqualTo(ticker,T5)" in plan


def test_owned_tables_go(spark):
    with owned_tables(spark):
        stored = materialize(spark.range(3), "owned")
        path = stored.inputFiles()[0].removeprefix("file://")
        assert stored.count() == 3
    import os

    assert not os.path.exists(os.path.dirname(path)) and shared_folder(spark)
