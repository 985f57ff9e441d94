"""Literal fixtures and brute-force checks of the seasonal operators."""

import datetime as dt

import pandas as pd
import pytest
from pyspark.sql import functions as F

from perennial.functions.columns import wilson_lower_bound
from perennial.functions.student import student_cdf, student_quantile, student_quantiles
from perennial.operators import seasonal as S
from perennial.operators import validate as V
from perennial.plans import screener as P

KEY = "A', 1, 1, 5"


def observations(spark, returns, first_year=2011, bench=0.02):
    rows = [
        ("A", 1, 1, 5, first_year + i, r, bench, r - bench, r - bench > 0)
        for i, r in enumerate(returns)
    ]
    return spark.createDataFrame(
        rows,
        "ticker string, entry_month int, entry_day int, holding_days int, year int, ret double, "
        "bench_ret double, excess double, beat boolean",
    )


def test_metrics(spark):
    m = S.absolute_metrics(observations(spark, [0.10, 0.05, -0.02, 0.03, -0.01])).first()
    assert (m.sample_size, m.wins, m.losses) == (5, 3, 2)
    assert m.win_rate == pytest.approx(0.6)
    assert m.average_return == pytest.approx(0.03)
    assert (m.best_return, m.worst_return) == (0.10, -0.02)
    assert m.profit_factor == pytest.approx(0.18 / 0.03)


def test_profit_factor_without_losses(spark):
    m = S.absolute_metrics(observations(spark, [0.1, 0.2])).first()
    assert m.profit_factor == float("inf") and m.average_loss == 0.0


def test_wilson(spark):
    row = spark.range(1).select(
        wilson_lower_bound(F.lit(8), F.lit(10)).alias("w"),
        wilson_lower_bound(F.lit(0), F.lit(0)).alias("none"),
    ).first()
    assert 0 < row.w < 0.8 and row.none == 0.0


def test_student_quantiles(spark):
    q = student_quantiles(0.8)
    assert [round(q[i], 5) for i in (0, 1, 2, 8)] == [1.37638, 1.06066, 0.97847, 0.8834]
    got = spark.range(60).select(
        "id", student_quantile(F.col("id"), 0.8).alias("t")
    ).toPandas().set_index("id").t
    assert pd.isna(got[0])
    for df in range(1, 60):
        assert student_cdf(got[df], df) == pytest.approx(0.8, abs=1e-8)


def test_benchmark_on_same_dates(spark):
    obs = spark.createDataFrame(
        [(dt.date(2020, 1, 2), dt.date(2020, 1, 6), 0.10), (dt.date(2020, 1, 2), dt.date(2020, 1, 7), 0.1)],
        "entry_date date, exit_date date, ret double",
    )
    bench = spark.createDataFrame(
        [(dt.date(2020, 1, 2), 100.0), (dt.date(2020, 1, 6), 105.0)], "date date, adj_close double"
    )
    known, missing = S.add_benchmark(obs, bench).orderBy("exit_date").collect()
    assert known.bench_ret == pytest.approx(0.05) and known.excess == pytest.approx(0.05) and known.beat
    assert missing.bench_ret is None and missing.beat is False


def test_chronological_split(spark):
    split = V.chronological_split(observations(spark, [0.05] * 15), 5).toPandas()
    assert (~split.is_test).sum() == 10 and split[~split.is_test].year.max() == 2020
    assert split[split.is_test].year.min() == 2021 and split.enough_years.all()
    short = V.chronological_split(observations(spark, [0.05] * 5), 5).toPandas()
    assert not short.enough_years.any()


def test_walk_forward(spark):
    rets = [.05, .04, .06, -.01, .03, .05, .02, .04, .06, .03, .05, -.02, .04, .03, .06]
    folds = V.walk_forward_folds(observations(spark, rets), 8)
    shown = folds.where("is_fold").orderBy("year").collect()
    assert len(shown) == 7 and shown[0].year == 2019 and shown[0].training_years == 8
    summary = V.walk_forward_summary(folds).first()
    assert summary.wf_folds == 7 and 0 <= summary.wf_win_rate <= 1


def test_leap_day_and_late_december(spark):
    days = pd.bdate_range("2019-12-02", "2022-02-10")
    prices = spark.createDataFrame(
        [("A", d.date(), 100.0 + i) for i, d in enumerate(days)],
        "ticker string, date date, adj_close double",
    )
    got = S.seasonal_returns(prices, [(2, 29), (12, 25)], [3]).orderBy("target_date").collect()
    assert [str(r.target_date) for r in got] == [
        "2019-12-25", "2020-02-29", "2020-12-25", "2021-12-25",
    ]
    assert str(got[1].entry_date) == "2020-03-02"
    assert got[1].exit_price == got[1].entry_price + 3


def test_entry_search_matches_direct_search(spark):
    import random

    rnd = random.Random(3)
    days = sorted({dt.date(2020, 1, 5) + dt.timedelta(days=rnd.randint(0, 400)) for _ in range(60)})
    prices = spark.createDataFrame(
        [("A", d, 1.0) for d in days], "ticker string, date date, adj_close double"
    )
    got = {r.target_date: r.entry_date for r in S.next_sessions(S.clean_prices(prices)).collect()}
    day = dt.date(2020, 1, 1)
    while day <= days[-1]:
        direct = [d for d in days if day <= d <= day + dt.timedelta(days=7)]
        assert got.get(day) == (direct[0] if direct else None)
        day += dt.timedelta(days=1)


def test_overlap_suppression_is_greedy(spark):
    import random

    rnd = random.Random(1)
    rows = [
        (t, i, dt.date(2024, 1, 1) + dt.timedelta(days=rnd.randint(0, 20)), rnd.choice([5, 8, 10, 20]))
        for i, t in enumerate(rnd.choice("AB") for _ in range(80))
    ]
    df = spark.createDataFrame(
        rows, "ticker string, rank int, upcoming_entry_date date, holding_days int"
    )
    kept = []
    for t, r, d, h in rows:
        if not any(k[0] == t and abs((k[2] - d).days) <= 3 and abs(k[3] - h) <= 5 for k in kept):
            kept.append((t, r, d, h))
    assert {r["rank"] for r in V.suppress_overlaps(df).collect()} == {k[1] for k in kept}


def test_date_grid(spark):
    grid = P.date_grid(spark, dt.date(2024, 2, 27), 3, (5, 10)).collect()
    assert len(grid) == 8 and max(g.entry_date for g in grid) == dt.date(2024, 3, 1)
    with pytest.raises(ValueError):
        P.date_grid(spark, dt.date(2024, 1, 1), -1, (5,))
    with pytest.raises(ValueError):
        P.upcoming_dates(dt.date(2024, 1, 1), -1)


def test_invalid_sizes(spark):
    with pytest.raises(ValueError):
        S.seasonal_observations(None, [(1, 1)], [0])
    with pytest.raises(ValueError):
        S.keep_recent(None, 0)


def test_repeated_dates_keep_the_first(spark):
    df = spark.createDataFrame(
        [("A", dt.date(2020, 1, 1), 2.0, 1), ("A", dt.date(2020, 1, 1), 1.0, 2),
         ("A", dt.date(2020, 1, 2), None, 3), ("A", dt.date(2020, 1, 3), float("nan"), 4)],
        "ticker string, date date, adj_close double, seq int",
    )
    rows = S.clean_prices(df, first_by=["seq"]).collect()
    assert [(r.adj_close) for r in rows] == [2.0]
