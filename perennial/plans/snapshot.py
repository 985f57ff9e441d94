"""Yearly snapshot backtest: rank as of a month, select, realise, summarise, bootstrap."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from perennial.functions.storage import materialize
from perennial.operators.monthly import cross_section, evaluate_selected, select_candidates


def backtest_snapshot(
    prices: DataFrame,
    benchmark: DataFrame,
    test_years: Sequence[int],
    target_month: int,
    lookback_years: int = 15,
    recent_years: int = 5,
    long_sessions: int = 253,
    skip_sessions: int = 22,
    **selection,
) -> DataFrame:
    """The trades of every test year; ``selection`` goes to ``select_candidates``."""
    snapshot = cross_section(
        prices, benchmark, target_month, test_years, lookback_years, recent_years,
        long_sessions, skip_sessions,
    )
    return evaluate_selected(
        select_candidates(snapshot, **selection), prices, benchmark, target_month
    )


def _zero(c):
    return F.coalesce(c, F.lit(0.0))


def summarize_trades(trades: DataFrame) -> DataFrame:
    """One row; zeros when there are no trades (at most test years x top n rows come in)."""
    r, e = "realized_return", "realized_excess_return"
    return trades.agg(
        F.count(F.lit(1)).alias("trades"),
        _zero(F.avg(F.col("realized_win").cast("double"))).alias("win_rate"),
        _zero(F.avg(F.col("beat_benchmark").cast("double"))).alias("beat_rate"),
        _zero(F.avg(r)).alias("average_return"),
        _zero(F.percentile(r, 0.5)).alias("median_return"),
        _zero(F.avg(e)).alias("average_excess_return"),
        _zero(F.percentile(e, 0.5)).alias("median_excess_return"),
        _zero(F.min(r)).alias("worst_return"),
        _zero(F.max(r)).alias("best_return"),
        _zero(F.stddev_samp(r)).alias("return_std"),
        _zero(F.stddev_samp(e)).alias("excess_std"),
    )


def summarize_by_year(trades: DataFrame) -> DataFrame:
    return trades.groupBy("test_year").agg(
        F.count("ticker").alias("stocks"),
        F.avg("realized_return").alias("portfolio_return"),
        F.max("benchmark_return").alias("benchmark_return"),
        F.avg("realized_excess_return").alias("portfolio_excess"),
        F.avg(F.col("realized_win").cast("double")).alias("win_rate"),
        F.avg(F.col("beat_benchmark").cast("double")).alias("beat_rate"),
    )


def bootstrap_mean(
    values: DataFrame,
    value: str,
    order: Sequence[str],
    simulations: int = 10_000,
    seed: int = 42,
) -> DataFrame:
    """Resample the mean with replacement: mean of means, 5% and 95% quantile, P(mean > 0).

    The draw of (simulation, place) is a hash, so the result does not depend on partitioning or
    retries.  The values are the trades of a backtest (test years x top n), numbered by ``order``.
    """
    spark = values.sparkSession
    numbered = (
        values.where(F.col(value).isNotNull())
        .withColumn("_group", F.lit(0))
        .withColumn("_i", F.row_number().over(Window.partitionBy("_group").orderBy(*order)) - 1)
        .select("_i", F.col(value).alias("_v"))
    )
    numbered = materialize(numbered, "trades")
    n = numbered.agg(F.count(F.lit(1)).cast("int").alias("_n")).where("_n > 0")
    text = F.concat_ws("-", F.lit(str(seed)), "sim", "draw")
    pick = F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint") % F.col("_n")
    means = (
        spark.range(simulations)
        .select(F.col("id").alias("sim"))
        .crossJoin(F.broadcast(n))
        .select("sim", "_n", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)).alias("draw"))
        .withColumn("_i", pick)
        .join(F.broadcast(numbered), "_i")
        .groupBy("sim")
        .agg(F.avg("_v").alias("m"))
    )
    return means.agg(
        _zero(F.avg("m")).alias("bootstrap_mean"),
        _zero(F.percentile("m", 0.05)).alias("lower_5"),
        _zero(F.percentile("m", 0.95)).alias("upper_95"),
        _zero(F.avg((F.col("m") > 0).cast("double"))).alias("probability_positive"),
    )
