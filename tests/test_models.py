"""Ridge, beta projection, look-ahead and inference against numpy and pandas."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from perennial.functions.inference import hac_t
from perennial.functions.storage import materialize
from perennial.operators import crosssection as CS
from perennial.operators import features as FE
from perennial.operators import portfolio as PF
from perennial.operators import ridge as R

FEATURES = [f"f{i}" for i in range(6)]


@pytest.fixture(scope="module")
def panel():
    rng = np.random.default_rng(2)
    rows = 30 * 60
    x = rng.normal(size=(rows, 6)) * [1, 2, 0.1, 1, 1, 0] + [0, 5, 0, 1, 0, 3]
    pdf = pd.DataFrame(x, columns=FEATURES)
    pdf["y"] = x @ [0.5, -0.1, 2, 0, 0.3, 0] + rng.normal(size=rows)
    pdf["period_idx"] = np.repeat(np.arange(30), 60)
    pdf["ticker"] = [f"T{i % 60}" for i in range(rows)]
    pdf.loc[rng.random(rows) < 0.05, "f0"] = np.nan
    pdf.loc[pdf.period_idx == 29, "y"] = np.nan
    return pdf


def direct_fit(train, alpha=10.0):
    x, y = train[FEATURES].to_numpy(), train.y.to_numpy()
    scale = x.std(axis=0)
    scale[scale == 0] = 1.0
    z = (x - x.mean(axis=0)) / scale
    w = np.linalg.solve(z.T @ z + alpha * np.eye(6), z.T @ (y - y.mean()))
    return w / scale, y.mean() - (w / scale) @ x.mean(axis=0)


def nulls(df):
    return df.select(*[F.when(~F.isnan(c), F.col(c)).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def test_rolling_ridge_matches_direct_fits(spark, panel):
    df = nulls(spark.createDataFrame(panel).repartition(4))
    got = R.walk_forward_predictions(
        df, FEATURES, "y", 12, 29, training_months=12, min_test_rows=30
    ).toPandas()
    assert sorted(got.period_idx.unique()) == list(range(12, 30))
    for p, part in got.groupby("period_idx"):
        train = panel[(panel.period_idx >= p - 12) & (panel.period_idx < p)].dropna()
        coef, intercept = direct_fit(train)
        assert (part.n_train == len(train)).all()
        np.testing.assert_allclose(part.prediction, part[FEATURES] @ coef + intercept, atol=1e-9)


def test_single_fit(spark, panel):
    fit = R.ridge_fit(nulls(spark.createDataFrame(panel)), FEATURES, "y").first()
    coef, intercept = direct_fit(panel.dropna())
    np.testing.assert_allclose(fit.coef, coef, atol=1e-9)
    assert fit.intercept == pytest.approx(intercept)


def brute_projection(base, beta, target, cap):
    """Bisection inside bisection on the two multipliers."""
    def weights(b):
        lo, hi = -1e3, 1e3
        for _ in range(200):
            a = (lo + hi) / 2
            w = np.clip(base + a + b * beta, 0, cap)
            lo, hi = (a, hi) if w.sum() < 1 else (lo, a)
        return w

    lo, hi = -50.0, 50.0
    for _ in range(200):
        b = (lo + hi) / 2
        lo, hi = (b, hi) if weights(b) @ beta < target else (lo, b)
    return weights((lo + hi) / 2)


def test_beta_projection(spark):
    rng = np.random.default_rng(8)
    frames = []
    for p, (n, level) in enumerate([(80, 1.1), (120, 0.9), (30, 1.2), (100, 4.0)]):
        raw = rng.random(n)
        frames.append(
            pd.DataFrame(
                {
                    "strategy": "x", "period_idx": p, "ticker": [f"T{i}" for i in range(n)],
                    "weight": raw / raw.sum(), "ret": 0.0, "beta_24m": level + 0.4 * rng.normal(size=n),
                    "bench_ret": 0.0,
                }
            )
        )
    pdf = pd.concat(frames)
    got = PF.beta_target_weights(spark.createDataFrame(pdf), 1.0, 0.02).toPandas()
    assert len(got) == len(pdf)
    for p, part in pdf.groupby("period_idx"):
        mine = part.merge(got[got.period_idx == p], on="ticker", suffixes=("", "_g"))
        n, beta, base = len(part), part.beta_24m.to_numpy(), part.weight.to_numpy()
        cap = 0.02 if n * 0.02 >= 1 else 1 / n + 1e-6
        assert mine.weight_g.sum() == pytest.approx(1)
        assert mine.weight_g.min() >= 0 and mine.weight_g.max() <= cap + 1e-6
        ends = np.sort(beta)
        fill = np.clip(1 - np.arange(n) * cap, 0, cap)
        target = np.clip(1.0, fill @ ends, fill @ ends[::-1])
        assert mine.weight_g @ beta == pytest.approx(target, abs=1e-5)
        if fill @ ends < 1.0 < fill @ ends[::-1]:
            np.testing.assert_allclose(
                mine.weight_g, brute_projection(base, beta, target, cap), atol=1e-6
            )


def test_large_months_are_projected_alike(spark, monkeypatch):
    rng = np.random.default_rng(12)
    rows = [
        ("x", p, f"T{i}", float(rng.random()), 0.0, float(0.9 + p / 10 + 0.4 * rng.normal()), 0.0)
        for p, n in enumerate((60, 120, 140)) for i in range(n)
    ]
    base = spark.createDataFrame(
        rows, "strategy string, period_idx int, ticker string, weight double, ret double, beta_24m double, bench_ret double"
    )
    want = {(r.period_idx, r.ticker): r.weight for r in PF.beta_target_weights(base).collect()}
    monkeypatch.setattr(PF, "MONTH_ROWS", 100)
    got = PF.beta_target_weights(base).collect()
    assert len(got) == len(rows) and {r.status for r in got} == {"solved"}
    assert all(r.weight == pytest.approx(want[r.period_idx, r.ticker], abs=1e-8) for r in got)


def test_hac(spark):
    rng = np.random.default_rng(4)
    x = np.cumsum(rng.normal(size=40)) * 0.1 + 0.5
    df = spark.createDataFrame(
        [("a", i, float(v)) for i, v in enumerate(x)] + [("b", 0, 1.0), ("c", 0, 2.0), ("c", 1, 2.0)],
        "k string, period_idx int, v double",
    )
    got = {r.k: r.v_hac_t for r in hac_t(df, ["k"], "period_idx", ["v"]).collect()}
    e = x - x.mean()
    lrv = e @ e / 40 + sum(2 * (1 - k / 4) * (e[k:] @ e[:-k]) / 40 for k in (1, 2, 3))
    assert got["a"] == pytest.approx(x.mean() / np.sqrt(lrv / 40))
    assert got["b"] == 0 and got["c"] == 0


def test_deciles_equal_quantile_edges(spark):
    for n in (100, 101, 137):
        df = spark.createDataFrame(
            [(0, f"{i:04d}", float(i)) for i in range(n)], "period_idx int, ticker string, s double"
        )
        got = CS.with_decile(df, "s").orderBy("s").toPandas().decile.to_numpy()
        ranks = pd.Series(np.arange(1, n + 1, dtype=float))
        edges = [1 + (n - 1) * k / 10 for k in range(1, 10)]
        want = 1 + np.sum([ranks.to_numpy() > e + 1e-9 for e in edges], axis=0)
        assert (got == want).all()
    small = spark.createDataFrame([(0, "a", 1.0)], "period_idx int, ticker string, s double")
    assert CS.with_decile(small, "s").count() == 0


def test_constant_beta_leaves_deviation_from_mean(spark):
    df = spark.createDataFrame(
        [(0, f"T{i}", float(i), 1.0) for i in range(25)],
        "period_idx int, ticker string, ret double, beta_24m double",
    )
    got = CS.beta_neutral_target(df).toPandas().sort_values("ret")
    np.testing.assert_allclose(got.beta_neutral_return, np.arange(25) - 12.0)
    assert got.beta_neutral_target.std() == pytest.approx(1)


def test_features_do_not_look_ahead(spark):
    rng = np.random.default_rng(9)
    rows = [
        (t, 24000 + m, float(rng.normal(0, 0.05)), float(0.01 * np.sin(m)))
        for t in "AB" for m in range(50)
    ]
    schema = "ticker string, period_idx int, ret double, bench_ret double"
    cut = 24040
    changed = [(t, p, r + (1.0 if p >= cut else 0.0), b) for t, p, r, b in rows]
    names = [*FE.FEATURES_V3, "season_samples"]

    def run(data):
        out = FE.features_from_months(spark.createDataFrame(data, schema))
        return out.where(F.col("period_idx") <= cut).orderBy("ticker", "period_idx").select(*names).toPandas()

    pd.testing.assert_frame_equal(run(rows), run(changed))


def test_incomplete_window_is_null(spark):
    rows = [("A", 24000 + m, None if m == 0 else 0.01 * m, 0.01) for m in range(6)]
    df = spark.createDataFrame(rows, "ticker string, period_idx int, ret double, bench_ret double")
    got = FE.features_from_months(df).orderBy("period_idx").toPandas().momentum_3m
    assert got[:4].isna().all() and got[4] == pytest.approx(1.01 * 1.02 * 1.03 - 1)


def test_membership_prunes_a_panel_stored_by_month(spark):
    from perennial.plans import walkforward as WF

    panel = spark.range(400).selectExpr(
        "concat('t', id % 20) AS ticker", "cast(24000 + id div 20 as int) AS period_idx", "cast(id as double) AS x"
    )
    stored = WF.store_by_month(panel)
    members = materialize(
        spark.createDataFrame(
            [(24003, "t1"), (24003, "t2"), (24007, "t5"), (24007, None), (None, "t5"), (25000, "t1")],
            "period_idx int, ticker string",
        )
    )
    kept = WF.members_only(stored, members.where("period_idx between 24000 and 26000"))
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert "SubqueryAdaptiveBroadcast dynamicpruning" in plan
    assert sorted((r["period_idx"], r["ticker"]) for r in kept.collect()) == [
        (24003, "t1"), (24003, "t2"), (24007, "t5"),
    ]
