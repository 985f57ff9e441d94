"""Split-range order statistics against pandas, with ranges of a few rows."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from perennial.functions.order import (
    exact_quantiles,
    with_average_rank,
    with_percentiles,
    with_positions,
)


@pytest.fixture(scope="module")
def frame():
    rng = np.random.default_rng(5)
    n = 900
    value = np.round(rng.normal(size=n), 2)
    value[rng.random(n) < 0.35] = 0.25  # a third of all rows share one value
    pdf = pd.DataFrame(
        {
            "g": rng.choice([1, 1, 1, 2, 3], n),
            "id": np.arange(n),
            "v": value,
            "w": rng.normal(size=n),
        }
    )
    pdf.loc[rng.random(n) < 0.1, "v"] = np.nan
    return pdf


@pytest.fixture(scope="module")
def df(spark, frame):
    df = spark.createDataFrame(frame)
    return df.withColumn("v", F.when(~F.isnan("v"), F.col("v"))).repartition(5).cache()


@pytest.mark.parametrize("keys", [[], ["g"]])
@pytest.mark.parametrize("per_range", [7, 10**6])
def test_positions(df, frame, keys, per_range):
    rows = df.where("v IS NOT NULL")
    got = with_positions(
        rows, keys, [-F.col("v"), F.col("id")], size="n", rows_per_range=per_range
    ).toPandas()
    want = frame.dropna().sort_values(["v", "id"], ascending=[False, True])
    group = want.groupby("g") if keys else want.groupby(np.zeros(len(want)))
    want = want.assign(position=group.cumcount() + 1, n=group["id"].transform("size"))
    m = got.merge(want, on="id", suffixes=("", "_w"))
    assert len(m) == len(want)
    assert (m.position == m.position_w).all() and (m.n == m.n_w).all()


@pytest.mark.parametrize("keys", [[], ["g"]])
@pytest.mark.parametrize("per_range", [7, 10**6])
def test_average_rank(df, frame, keys, per_range):
    got = with_average_rank(
        df, keys, "v", ["id"], percentile="pct", rows_per_range=per_range
    ).toPandas()
    group = frame.groupby("g")["v"] if keys else frame["v"]
    want = frame.assign(average_rank=group.rank(), pct=group.rank(pct=True))
    m = got.merge(want, on="id", suffixes=("", "_w"))
    assert len(m) == len(frame)
    np.testing.assert_allclose(m.average_rank, m.average_rank_w)
    np.testing.assert_allclose(m.pct, m.pct_w)


@pytest.mark.parametrize("keys", [[], ["g"]])
@pytest.mark.parametrize("per_range", [7, 10**6])
def test_quantiles(df, frame, keys, per_range):
    qs = {"lo": 0.01, "mid": 0.5, "hi": 0.99}
    got = exact_quantiles(df, keys, "v", ["id"], qs, rows_per_range=per_range).toPandas()
    for _, row in got.iterrows():
        values = frame[frame.g == row.g].v if keys else frame.v
        for name, q in qs.items():
            assert row[name] == pytest.approx(values.quantile(q))
    assert len(got) == (3 if keys else 1)


def test_percentiles_of_two_columns(df, frame):
    got = with_percentiles(df, ["g"], ["id"], {"v": "pv", "w": "pw"}).toPandas()
    for c in "vw":
        want = frame.assign(p=frame.groupby("g")[c].rank(pct=True))
        m = got.merge(want, on="id")
        np.testing.assert_allclose(m["p" + c], m.p)


def test_number_of_ranges_is_bounded(spark, monkeypatch):
    from perennial.functions import order

    monkeypatch.setattr(order, "RANGES", 8)
    rows = spark.range(3000).withColumn("v", F.col("id") % 700)
    ranged = order._ranges(rows.withColumn("_all", F.lit(0)), ["_all"], ["v", "id"], 2)
    assert ranged.select("_range").distinct().count() <= 8
    got = with_positions(rows, [], [F.col("v"), F.col("id")], rows_per_range=2).orderBy("v", "id").collect()
    assert [r.position for r in got] == list(range(1, 3001))
