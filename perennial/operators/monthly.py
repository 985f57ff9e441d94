"""Month-end series, same-month seasonality, session momentum and the ranked snapshot."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from perennial.functions.columns import month_index, month_start
from perennial.functions.order import with_percentiles
from perennial.functions.storage import materialize
from perennial.operators.seasonal import clean_prices


def monthly_returns(prices: DataFrame, drop_first: bool = False) -> DataFrame:
    """Last price of every month and the change over consecutive *available* months."""
    months = (
        clean_prices(prices)
        .groupBy("ticker", month_index("date").alias("period_idx"))
        .agg(F.max_by("adj_close", "date").alias("price"), F.max("date").alias("date"))
    )
    w = Window.partitionBy("ticker").orderBy("period_idx")
    out = months.select(
        "ticker",
        "period_idx",
        month_start("period_idx").alias("period"),
        "date",
        "price",
        (F.try_divide(F.col("price"), F.lag("price").over(w)) - 1).alias("ret"),
    )
    return out.where(F.col("ret").isNotNull()) if drop_first else out


def benchmark_months(benchmark: DataFrame) -> DataFrame:
    """(period_idx, bench_ret): at most one row per calendar month, so safe to broadcast."""
    series = benchmark.select(F.lit("benchmark").alias("ticker"), "date", "adj_close")
    return monthly_returns(series).select("period_idx", F.col("ret").alias("bench_ret"))


def joined_months(prices: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Stock months that the benchmark also has."""
    return monthly_returns(prices).join(F.broadcast(benchmark_months(benchmark)), "period_idx")


def month_return(prices: DataFrame, year: int, month: int) -> DataFrame:
    """Realised return of one month per ticker; a ticker without it has no row."""
    return monthly_returns(prices, drop_first=True).where(
        F.col("period_idx") == year * 12 + month - 1
    )


def _years(test_years: Sequence[int]) -> Column:
    return F.array(*[F.lit(y) for y in sorted(set(test_years))])


def same_month_seasonality(
    months: DataFrame,
    target_month: int,
    test_years: Sequence[int],
    lookback_years: int = 15,
    recent_years: int = 5,
) -> DataFrame:
    """Statistics of the target month's earlier excess returns as of its first day in each year.

    Only rows of the target month are repeated, once for each later test year in the given list.
    """
    later = F.filter(
        _years(test_years), lambda y: F.col("period_idx") < y * 12 + (target_month - 1)
    )
    w = Window.partitionBy("test_year", "ticker").orderBy(F.desc("period_idx"))
    rows = (
        months.where(
            (F.col("period_idx") % 12 == target_month - 1)
            & F.col("ret").isNotNull()
            & F.col("bench_ret").isNotNull()
        )
        .select("*", F.explode(later).alias("test_year"))
        .withColumn("excess", F.col("ret") - F.col("bench_ret"))
        .withColumn("_back", F.row_number().over(w))
        .where(F.col("_back") <= lookback_years)
    )
    recent = F.when(F.col("_back") <= recent_years, F.col("excess"))
    n = F.count("excess")
    return rows.groupBy("test_year", "ticker").agg(
        n.alias("season_samples"),
        F.avg("excess").alias("season_mean_excess"),
        F.percentile("excess", 0.5).alias("season_median_excess"),
        F.avg((F.col("ret") > 0).cast("double")).alias("season_win_rate"),
        F.avg((F.col("excess") > 0).cast("double")).alias("season_beat_rate"),
        F.percentile("excess", 0.25).alias("season_q25_excess"),
        F.when(n > 1, F.stddev_samp("excess")).otherwise(F.lit(0.0)).alias("season_std"),
        F.avg(recent).alias("recent_mean_excess"),
        F.percentile(recent, 0.5).alias("recent_median_excess"),
    )


def session_momentum(
    prices: DataFrame,
    target_month: int,
    test_years: Sequence[int],
    long_sessions: int = 253,
    skip_sessions: int = 22,
) -> DataFrame:
    """Change between the 253rd and the 22nd last session before each as-of date.

    An as-of date belongs to exactly one session (the last before it), so rows are not repeated.
    """
    w = Window.partitionBy("ticker").orderBy("date")
    as_of = F.transform(
        _years(test_years), lambda y: F.make_date(y, F.lit(target_month), F.lit(1))
    )
    mine = F.filter(
        as_of,
        lambda a: (F.col("date") < a) & (F.col("_next").isNull() | (F.col("_next") >= a)),
    )
    start, end = F.col("_start"), F.col("_end")
    return (
        clean_prices(prices)
        .select(
            "ticker",
            "date",
            F.lead("date").over(w).alias("_next"),
            F.lag("adj_close", long_sessions - 1).over(w).alias("_start"),
            F.lag("adj_close", skip_sessions - 1).over(w).alias("_end"),
        )
        .select("ticker", "_start", "_end", F.explode(mine).alias("as_of"))
        .select(
            F.year("as_of").alias("test_year"),
            "ticker",
            F.when(start > 0, end / start - 1).alias("momentum_12_1"),
        )
    )


SNAPSHOT_MEASURES = {
    "season_mean_excess": "long_seasonal_rank",
    "recent_mean_excess": "recent_seasonal_rank",
    "momentum_12_1": "momentum_rank",
    "season_q25_excess": "downside_rank",
}


def cross_section(
    prices: DataFrame,
    benchmark: DataFrame,
    target_month: int,
    test_years: Sequence[int],
    lookback_years: int = 15,
    recent_years: int = 5,
    long_sessions: int = 253,
    skip_sessions: int = 22,
) -> DataFrame:
    """All tickers as of the first day of the target month, with percentile ranks and edge score."""
    season = same_month_seasonality(
        joined_months(prices, benchmark), target_month, test_years, lookback_years, recent_years
    )
    momentum = session_momentum(prices, target_month, test_years, long_sessions, skip_sessions)
    table = season.join(momentum, ["test_year", "ticker"]).dropna(subset=list(SNAPSHOT_MEASURES))
    ranked = with_percentiles(
        materialize(table, "snapshot"), ["test_year"], ["ticker"], SNAPSHOT_MEASURES
    )
    persistent = F.least("long_seasonal_rank", "recent_seasonal_rank")
    floor = F.lit(1e-6)
    edge = F.pow(
        F.greatest(persistent, floor)
        * F.greatest("momentum_rank", floor)
        * F.greatest("downside_rank", floor),
        F.lit(1 / 3),
    )
    return ranked.withColumn("persistent_rank", persistent).withColumn("edge_score", edge)


def select_candidates(
    snapshot: DataFrame,
    top_n: int = 10,
    min_samples: int = 8,
    min_long_rank: float = 0.8,
    min_recent_rank: float = 0.6,
    min_momentum_rank: float = 0.5,
    min_downside_rank: float = 0.4,
) -> DataFrame:
    """The best ``top_n`` of every test year that reach all thresholds.

    Spark prunes a ``row_number() <= n`` filter before the shuffle, so no year is sorted whole.
    """
    best = Window.partitionBy("test_year").orderBy(
        F.desc("edge_score"), F.desc("persistent_rank"), F.desc("momentum_rank"), "ticker"
    )
    return (
        snapshot.where(
            (F.col("season_samples") >= min_samples)
            & (F.col("long_seasonal_rank") >= min_long_rank)
            & (F.col("recent_seasonal_rank") >= min_recent_rank)
            & (F.col("momentum_rank") >= min_momentum_rank)
            & (F.col("downside_rank") >= min_downside_rank)
        )
        .withColumn("rank", F.row_number().over(best))
        .where(F.col("rank") <= top_n)
    )


def evaluate_selected(
    selected: DataFrame, prices: DataFrame, benchmark: DataFrame, target_month: int
) -> DataFrame:
    """Realised month of every selected ticker against the benchmark's.

    ``selected`` holds at most top n rows per test year and is broadcast.
    """
    chosen = selected.withColumn("period_idx", F.col("test_year") * 12 + (target_month - 1))
    bench = benchmark_months(benchmark).where(F.col("bench_ret").isNotNull())
    excess = F.col("ret") - F.col("bench_ret")
    return (
        monthly_returns(prices, drop_first=True)
        .select("ticker", "period_idx", "ret")
        .join(F.broadcast(chosen), ["ticker", "period_idx"])
        .join(F.broadcast(bench), "period_idx")
        .select(
            "test_year",
            "ticker",
            F.col("rank").alias("prior_rank"),
            "edge_score",
            "long_seasonal_rank",
            "recent_seasonal_rank",
            "persistent_rank",
            "momentum_rank",
            "downside_rank",
            F.col("season_mean_excess").alias("historical_mean_excess"),
            F.col("recent_mean_excess").alias("historical_recent_excess"),
            F.col("season_q25_excess").alias("historical_q25_excess"),
            F.col("ret").alias("realized_return"),
            F.col("bench_ret").alias("benchmark_return"),
            excess.alias("realized_excess_return"),
            (F.col("ret") > 0).alias("realized_win"),
            (excess > 0).alias("beat_benchmark"),
        )
    )
