"""Seasonal screener: scan one window, discover over a grid, nested walk-forward discovery."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from perennial.functions.storage import materialize
from perennial.operators.seasonal import (
    WINDOW_KEY,
    add_benchmark,
    clean_prices,
    keep_recent,
    seasonal_observations,
)
from perennial.operators.validate import (
    DISCOVERY_ORDER,
    SCAN_ORDER,
    analyze,
    kept_ranks,
    quality_filter,
    rank_by,
)

TIES = ("ticker", "entry_month", "entry_day", "holding_days")


@dataclass(frozen=True)
class Thresholds:
    """Training thresholds of the quality filter and sizes of the validation steps."""

    min_win_rate: float = 0.0
    min_sample_size: int = 0
    min_median_return: float | None = None
    min_beat_rate: float | None = None
    min_median_excess: float | None = None
    min_training: int = 8
    test_years: int = 5
    lookback_years: int = 15

    def filter(self, analyzed: DataFrame) -> DataFrame:
        return quality_filter(
            analyzed,
            self.min_win_rate,
            self.min_sample_size,
            self.min_median_return,
            self.min_beat_rate,
            self.min_median_excess,
        )


DISCOVERY_DEFAULTS = Thresholds(0.7, 10, 0.0, 0.6, 0.0)
NESTED_DEFAULTS = Thresholds(0.65, 8, 0.0, 0.55, 0.0)


def upcoming_dates(start: dt.date, days_ahead: int = 30) -> list[dt.date]:
    """``start`` and the following ``days_ahead`` days."""
    if days_ahead < 0:
        raise ValueError(f"days_ahead is {days_ahead}, below 0")
    return [start + dt.timedelta(days=i) for i in range(days_ahead + 1)]


def date_grid(spark, start: dt.date, days_ahead: int, holdings: Sequence[int]) -> DataFrame:
    """The (date, holding) grid as rows."""
    if days_ahead < 0:
        raise ValueError(f"days_ahead is {days_ahead}, below 0")
    first = F.lit(start.isoformat()).cast("date")
    days = F.explode(F.sequence(first, F.date_add(first, days_ahead)))
    grid = spark.range(1).select(days.alias("entry_date"))
    return grid.select(
        "entry_date", F.explode(F.array(*[F.lit(h) for h in holdings])).alias("holding_days")
    )


def analyzed_windows(
    prices: DataFrame,
    benchmark: DataFrame,
    entries: Sequence[tuple[int, int]],
    holdings: Sequence[int],
    limits: Thresholds = Thresholds(),
) -> DataFrame:
    """Every (ticker, window) with at least one observation, analyzed; failures carry ``error``."""
    obs = seasonal_observations(clean_prices(prices), entries, holdings)
    compared = add_benchmark(keep_recent(obs, limits.lookback_years), benchmark)
    return analyze(compared, limits.min_training, limits.test_years)


def scan(
    prices: DataFrame,
    benchmark: DataFrame,
    month: int,
    day: int,
    holding_days: int,
    limits: Thresholds = Thresholds(),
) -> DataFrame:
    """One window over all tickers, filtered and ranked on training metrics."""
    found = analyzed_windows(prices, benchmark, [(month, day)], [holding_days], limits)
    return rank_by(materialize(limits.filter(found), "scan"), SCAN_ORDER, TIES)


def scan_errors(
    prices: DataFrame,
    benchmark: DataFrame,
    entries: Sequence[tuple[int, int]],
    holdings: Sequence[int],
    limits: Thresholds = Thresholds(),
) -> DataFrame:
    """(ticker, window, error) for every window that could not be analyzed."""
    found = analyzed_windows(prices, benchmark, entries, holdings, limits)
    windows = F.array(
        *[
            F.struct(
                F.lit(m).alias("entry_month"),
                F.lit(d).alias("entry_day"),
                F.lit(h).alias("holding_days"),
            )
            for m, d in sorted(set(entries))
            for h in sorted(set(holdings))
        ]
    )
    asked = prices.select("ticker").distinct().select("ticker", F.inline(windows))
    none = asked.join(found.select(*WINDOW_KEY), list(WINDOW_KEY), "left_anti").withColumn(
        "error", F.lit("no year with a complete window")
    )
    failed = found.where(F.col("error").isNotNull()).select(*WINDOW_KEY, "error")
    return failed.unionByName(none)


def discover(
    prices: DataFrame,
    benchmark: DataFrame,
    start: dt.date,
    days_ahead: int = 30,
    holdings: Sequence[int] = (5, 10, 15, 20, 30),
    limits: Thresholds = DISCOVERY_DEFAULTS,
) -> DataFrame:
    """All windows of the grid in one plan: analyze, rank, suppress overlaps, rank again."""
    days = upcoming_dates(start, days_ahead)
    entries = sorted({(d.month, d.day) for d in days})
    found = limits.filter(analyzed_windows(prices, benchmark, entries, holdings, limits))
    found = with_grid_dates(found, start, days_ahead)
    ranked = rank_by(materialize(found, "windows"), DISCOVERY_ORDER, TIES)
    return without_overlaps(materialize(ranked, "ranked"))


def without_overlaps(ranked: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Suppress overlapping windows per ticker and close the gaps in the rank."""
    by = [*keys, "ticker"]
    kept = materialize(kept_ranks(ranked, key=by).withColumnRenamed("rank", "_raw"), "kept")
    renumbered = rank_by(kept, (), ("_raw",), keys)
    return ranked.withColumnRenamed("rank", "_raw").join(renumbered, [*by, "_raw"]).drop("_raw")


def with_grid_dates(found: DataFrame, start: dt.date, days_ahead: int) -> DataFrame:
    """One row per window and grid date with its month and day; one row per day is broadcast."""
    days = date_grid(found.sparkSession, start, days_ahead, [0]).select(
        F.col("entry_date").alias("upcoming_entry_date"),
        F.month("entry_date").alias("entry_month"),
        F.dayofmonth("entry_date").alias("entry_day"),
    )
    return found.join(F.broadcast(days), ["entry_month", "entry_day"])


@dataclass(frozen=True)
class NestedGrid:
    anchor_month: int
    anchor_day: int
    test_years: tuple[int, ...]
    days_ahead: int = 7
    holdings: tuple[int, ...] = (5, 10, 15, 20, 30)
    top_n: int = 3
    limits: Thresholds = field(default_factory=lambda: NESTED_DEFAULTS)


def nested_candidates(compared: DataFrame, grid: NestedGrid) -> DataFrame:
    """Per test year: windows analyzed only on observations that ended before January 1.

    Observations are repeated for each later test year, so the number of copies is bounded by the
    list of test years.
    """
    limits = grid.limits
    candidates = [
        (y, d.month, d.day, d)
        for y in grid.test_years
        for d in upcoming_dates(dt.date(y, grid.anchor_month, grid.anchor_day), grid.days_ahead)
    ]
    offered = F.array(
        *[
            F.struct(
                F.lit(y).alias("test_year"),
                F.lit(m).alias("m"),
                F.lit(d).alias("d"),
                F.lit(day).alias("upcoming_entry_date"),
            )
            for y, m, d, day in candidates
        ]
    )
    mine = F.filter(
        offered,
        lambda c: (c["m"] == F.col("entry_month"))
        & (c["d"] == F.col("entry_day"))
        & (F.year("exit_date") < c["test_year"]),
    )
    key = ("test_year", "upcoming_entry_date", *WINDOW_KEY)
    train = compared.select("*", F.inline(mine)).drop("m", "d")
    train = keep_recent(train, limits.lookback_years, key)
    found = limits.filter(analyze(train, limits.min_training, limits.test_years, key))
    ranked = rank_by(materialize(found, "candidates"), SCAN_ORDER, TIES, ["test_year"])
    kept = without_overlaps(materialize(ranked, "ranked"), ["test_year"])
    best = Window.partitionBy("test_year", "ticker").orderBy("rank")
    return kept.withColumn("_best", F.row_number().over(best)).where("_best = 1").drop("_best")


def realized_outcomes(selected: DataFrame, compared: DataFrame) -> DataFrame:
    """What the selected windows returned in their test year (exit before its end)."""
    outcome = compared.where(F.year("exit_date") <= F.col("year")).select(
        F.col("year").alias("test_year"),
        *WINDOW_KEY,
        "entry_date",
        "exit_date",
        F.col("ret").alias("realized_return"),
        F.col("bench_ret").alias("realized_benchmark_return"),
        F.col("excess").alias("realized_excess_return"),
        F.col("win").alias("realized_win"),
        F.col("beat").alias("realized_beat"),
    )
    return outcome.join(F.broadcast(selected), ["test_year", *WINDOW_KEY])


def nested_walk_forward(prices: DataFrame, benchmark: DataFrame, grid: NestedGrid) -> DataFrame:
    """Select the best windows of every test year on earlier data and report their outcome."""
    days = [
        d
        for y in grid.test_years
        for d in upcoming_dates(dt.date(y, grid.anchor_month, grid.anchor_day), grid.days_ahead)
    ]
    entries = sorted({(d.month, d.day) for d in days})
    compared = materialize(
        add_benchmark(seasonal_observations(clean_prices(prices), entries, grid.holdings), benchmark),
        "observations",
    )
    per_year = Window.partitionBy("test_year").orderBy("rank")
    selected = (
        nested_candidates(compared, grid)
        .withColumn("_place", F.row_number().over(per_year))
        .where(F.col("_place") <= grid.top_n)
        .select(
            "test_year",
            *WINDOW_KEY,
            F.col("train_win_rate").alias("prior_win_rate"),
            F.col("train_wilson").alias("prior_wilson"),
            F.col("train_median_return").alias("prior_median_return"),
            F.col("train_median_excess").alias("prior_median_excess"),
            F.col("rank").alias("prior_rank"),
        )
    )
    return realized_outcomes(selected, compared)


def trade_summary(trades: DataFrame) -> DataFrame:
    """One row over all trades (at most test years x top n); zeros when there are none."""
    zero = F.lit(0.0)

    def rate(c: str):
        return F.coalesce(F.avg(F.col(c).cast("double")), zero)

    return trades.agg(
        F.count(F.lit(1)).alias("trades"),
        rate("realized_win").alias("win_rate"),
        rate("realized_beat").alias("beat_rate"),
        rate("realized_return").alias("average_return"),
        F.coalesce(F.percentile("realized_return", 0.5), zero).alias("median_return"),
        rate("realized_excess_return").alias("average_excess_return"),
        F.coalesce(F.percentile("realized_excess_return", 0.5), zero).alias("median_excess_return"),
        F.coalesce(F.min("realized_return"), zero).alias("worst_return"),
    )
