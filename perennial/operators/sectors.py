"""Dynamic sector assignment by trailing correlation, and sector-relative features."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from perennial.operators.features import compounded, features_from_months, trailing_std
from perennial.operators.monthly import joined_months, monthly_returns

# The sector funds in tie-break order.
SECTOR_FUNDS = ("VGT", "VFH", "VHT", "VDE", "VIS", "VCR", "VDC", "VPU", "VAW", "VOX", "VNQ")
SECTOR_FEATURES = (
    "sector_correlation", "sector_momentum_3m", "sector_momentum_6m", "sector_momentum_12m",
    "sector_volatility_6m", "sector_volatility_12m",
)


def sector_returns(sector_prices: DataFrame) -> DataFrame:
    """(sector, period_idx, sector_ret) in long form; sectors x months rows."""
    return monthly_returns(sector_prices.withColumnRenamed("sector", "ticker")).select(
        F.col("ticker").alias("sector"), "period_idx", F.col("ret").alias("sector_ret")
    )


def dynamic_sector(
    months: DataFrame,
    sectors: DataFrame,
    order: Sequence[str] = SECTOR_FUNDS,
    lookback: int = 24,
    min_pairs: int = 12,
) -> DataFrame:
    """Per (ticker, month): the sector most correlated over the previous ``lookback`` rows.

    One row per month with a column for each sector is broadcast, and all correlations come from the
    ticker's window; a month without a sector value still counts as a row.  Earlier sectors in
    ``order`` win ties.
    """
    wide = (
        sectors.where(F.col("sector").isin(*order))
        .groupBy("period_idx")
        .agg(
            *[
                F.max(F.when(F.col("sector") == s, F.col("sector_ret"))).alias(f"_s{i}")
                for i, s in enumerate(order)
            ]
        )
    )
    rows = months.select("ticker", "period_idx", "ret").join(F.broadcast(wide), "period_idx", "left")
    frame = Window.partitionBy("ticker").orderBy("period_idx").rowsBetween(-lookback, -1)

    def candidate(i: int, sector: str):
        value = F.col(f"_s{i}")
        x = F.when(F.col("ret").isNotNull(), value)
        y = F.when(value.isNotNull(), F.col("ret"))
        scale = F.stddev_samp(x).over(frame) * F.stddev_samp(y).over(frame)
        correlation = F.when(
            F.count(x).over(frame) >= min_pairs,
            F.try_divide(F.covar_samp(x, y).over(frame), scale),
        )
        return F.struct(
            correlation.alias("corr"),
            F.lit(-i).alias("pref"),
            F.lit(sector).alias("sector"),
            value.alias("sector_ret"),
        )

    offered = F.array(*[candidate(i, s) for i, s in enumerate(order)])
    best = F.array_max(F.filter("_offered", lambda c: c["corr"].isNotNull()))
    return (
        rows.withColumn("_offered", offered)
        .withColumn("_best", best)
        .select(
            "ticker",
            "period_idx",
            "ret",
            F.col("_best.sector").alias("selected_sector"),
            F.col("_best.corr").alias("sector_correlation"),
            F.col("_best.sector_ret").alias("selected_sector_ret"),
        )
    )


def sector_features(
    months: DataFrame, sectors: DataFrame, order: Sequence[str] = SECTOR_FUNDS, lookback: int = 24
) -> DataFrame:
    """Dynamic sector plus lagged sector-relative momentum and volatility."""
    chosen = dynamic_sector(months, sectors, order, lookback).withColumn(
        "sector_relative", F.col("ret") - F.col("selected_sector_ret")
    )
    return chosen.withColumns(
        {
            **{f"sector_momentum_{n}m": compounded("sector_relative", n) for n in (3, 6, 12)},
            **{f"sector_volatility_{n}m": trailing_std("sector_relative", n) for n in (6, 12)},
        }
    ).drop("ret")


def build_panel_with_sectors(
    prices: DataFrame,
    benchmark: DataFrame,
    sector_prices: DataFrame,
    order: Sequence[str] = SECTOR_FUNDS,
    min_season_samples: int = 5,
) -> DataFrame:
    months = joined_months(prices, benchmark)
    extra = sector_features(months, sector_returns(sector_prices), order)
    panel = features_from_months(months).where(F.col("season_samples") >= min_season_samples)
    return panel.join(extra, ["ticker", "period_idx"], "left")
