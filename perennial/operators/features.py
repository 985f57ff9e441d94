"""Look-ahead-free monthly features per ticker.

Rows are one per (ticker, available month).  A rolling feature of row i uses rows i-n .. i-1 only and
is null unless all n values are present.  All windows share the ticker partitioning.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from perennial.operators.monthly import joined_months

FEATURES_V5 = (
    "season_mean", "season_recent", "season_median", "season_beat_rate", "season_q25",
    "residual_season_mean", "residual_season_recent", "residual_season_median",
    "momentum_3m", "momentum_6m", "momentum_12m",
    "residual_momentum_3m", "residual_momentum_6m", "residual_momentum_12m",
    "last_month_return", "last_month_excess", "beta_24m", "volatility_6m", "volatility_12m",
    "idio_volatility_6m", "idio_volatility_12m",
)
FEATURES_V3 = (*FEATURES_V5, "market_momentum_3m", "market_momentum_6m", "market_volatility_6m")


def by_month():
    return Window.partitionBy("ticker").orderBy("period_idx")


def trailing(value: Column, n: int, how) -> Column:
    """``how`` over the n previous rows, null unless all n values are present."""
    frame = by_month().rowsBetween(-n, -1)
    return F.when(F.count(value).over(frame) == n, how(value).over(frame))


def compounded(value: str, n: int) -> Column:
    return trailing(1 + F.col(value), n, F.product) - 1


def trailing_std(value: str, n: int) -> Column:
    return trailing(F.col(value), n, F.stddev_samp)


def with_beta(months: DataFrame, n: int = 24) -> DataFrame:
    """Excess, trailing market beta and residual return."""
    frame = by_month().rowsBetween(-n, -1)
    x = F.when(F.col("ret").isNotNull(), F.col("bench_ret"))
    y = F.when(F.col("bench_ret").isNotNull(), F.col("ret"))
    beta = F.when(
        F.count(x).over(frame) == n,
        F.try_divide(F.covar_samp(y, x).over(frame), F.var_samp(x).over(frame)),
    )
    return months.withColumns(
        {"excess": F.col("ret") - F.col("bench_ret"), "beta_24m": beta}
    ).withColumn("residual", F.col("ret") - F.col("beta_24m") * F.col("bench_ret"))


def _recent(value: str, w: Window, n: int = 5) -> Column:
    newest = F.slice(F.reverse(F.collect_list(value).over(w)), 1, n)
    total = F.aggregate(newest, F.lit(0.0), lambda a, x: a + x)
    return F.try_divide(total, F.size(newest))


def stock_features(prices: DataFrame, benchmark: DataFrame) -> DataFrame:
    """All features of every (ticker, month)."""
    return features_from_months(joined_months(prices, benchmark))


def features_from_months(months: DataFrame) -> DataFrame:
    base = with_beta(months).withColumn("calendar_month", F.col("period_idx") % 12 + 1)
    season = (
        Window.partitionBy("ticker", "calendar_month")
        .orderBy("period_idx")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    rolling = {
        **{f"momentum_{n}m": compounded("ret", n) for n in (3, 6, 12)},
        **{f"residual_momentum_{n}m": compounded("residual", n) for n in (3, 6, 12)},
        **{f"idio_volatility_{n}m": trailing_std("residual", n) for n in (6, 12)},
        **{f"volatility_{n}m": trailing_std("ret", n) for n in (6, 12)},
        **{f"market_momentum_{n}m": compounded("bench_ret", n) for n in (3, 6)},
        "market_volatility_6m": trailing_std("bench_ret", 6),
        "last_month_return": F.lag("ret").over(by_month()),
        "last_month_excess": F.lag("excess").over(by_month()),
    }
    excess = F.col("excess")
    beat = F.when(excess.isNotNull(), (excess > 0).cast("double"))
    same_month = {
        "season_samples": F.count("excess").over(season),
        "season_mean": F.avg("excess").over(season),
        "season_recent": _recent("excess", season),
        "season_median": F.percentile("excess", 0.5).over(season),
        "season_beat_rate": F.avg(beat).over(season),
        "season_q25": F.percentile("excess", 0.25).over(season),
        "residual_season_mean": F.avg("residual").over(season),
        "residual_season_recent": _recent("residual", season),
        "residual_season_median": F.percentile("residual", 0.5).over(season),
    }
    return base.withColumns(rolling).withColumns(same_month)


def build_panel(
    prices: DataFrame, benchmark: DataFrame, min_season_samples: int = 5
) -> DataFrame:
    """Feature rows with enough earlier occurrences of the calendar month."""
    return stock_features(prices, benchmark).where(F.col("season_samples") >= min_season_samples)
