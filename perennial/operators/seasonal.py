"""Calendar-window returns: clean prices -> sessions -> yearly observations -> metrics.

After the per-day aggregation a ticker has at most one row per calendar day, so the windows over a
ticker are bounded.  Everything after that shuffle (look-ahead, lookback, folds, metrics) is keyed by
the ticker plus window columns and reuses the same partitioning.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from perennial.functions.columns import wilson_lower_bound
from perennial.functions.student import student_quantile

WINDOW_KEY = ("ticker", "entry_month", "entry_day", "holding_days")


def clean_prices(
    prices: DataFrame, price: str = "adj_close", first_by: Sequence[str] = ()
) -> DataFrame:
    """One non-null price per (ticker, date).

    Repeated dates keep the row that is first by ``first_by`` (the lowest price where none is
    given).  The aggregation combines on the map side, so a ticker with very many repeats is safe.
    """
    keep = F.min_by(price, F.struct(*first_by)) if first_by else F.min(price)
    return (
        prices.where(
            F.col("date").isNotNull() & F.col(price).isNotNull() & ~F.isnan(F.col(price))
        )
        .groupBy("ticker", "date")
        .agg(keep.alias("adj_close"))
    )


def next_sessions(clean: DataFrame, max_shift: int = 7) -> DataFrame:
    """Every (ticker, target date) whose entry is found, with the entry row.

    A session serves the calendar days after the previous session up to itself, at most
    ``max_shift`` back, so the search is a projection and no range join.
    """
    w = Window.partitionBy("ticker").orderBy("date")
    first_target = F.greatest(
        F.coalesce(F.date_add(F.lag("date").over(w), 1), F.trunc("date", "year")),
        F.date_sub("date", max_shift),
    )
    return clean.select(
        "ticker",
        F.col("date").alias("entry_date"),
        F.col("adj_close").alias("entry_price"),
        F.sequence(first_target, F.col("date")).alias("target_dates"),
    ).select(
        "ticker", F.explode("target_dates").alias("target_date"), "entry_date", "entry_price"
    )


def seasonal_observations(
    clean: DataFrame,
    entries: Sequence[tuple[int, int]],
    holdings: Sequence[int],
    max_shift: int = 7,
) -> DataFrame:
    """All yearly observations of the (month, day) x holding grid.

    ``entries`` holds at most 366 calendar days, so the grid is a constant of the plan.
    """
    if any(h <= 0 for h in holdings):
        raise ValueError(f"holdings of no day: {sorted(holdings)}")
    w = Window.partitionBy("ticker").orderBy("date")
    first_target = F.greatest(
        F.coalesce(F.date_add(F.lag("date").over(w), 1), F.trunc("date", "year")),
        F.date_sub("date", max_shift),
    )
    codes = sorted({m * 100 + d for m, d in entries})
    wanted = F.filter(
        F.sequence(first_target, F.col("date")),
        lambda t: (F.month(t) * 100 + F.dayofmonth(t)).isin(codes),
    )
    exits = F.array(
        *[
            F.struct(
                F.lit(h).alias("holding_days"),
                F.lead("date", h).over(w).alias("exit_date"),
                F.lead("adj_close", h).over(w).alias("exit_price"),
            )
            for h in sorted(set(holdings))
        ]
    )
    ret = F.col("exit_price") / F.col("entry_price") - 1
    return (
        clean.select(
            "ticker",
            F.col("date").alias("entry_date"),
            F.col("adj_close").alias("entry_price"),
            wanted.alias("targets"),
            exits.alias("exits"),
        )
        .where((F.size("targets") > 0) & (F.col("entry_price") > 0))
        .select("ticker", "entry_date", "entry_price", "exits", F.explode("targets").alias("target_date"))
        .select("ticker", "entry_date", "entry_price", "target_date", F.inline("exits"))
        .where(
            F.col("exit_date").isNotNull()
            & (F.year("exit_date") <= F.year("target_date") + 1)
        )
        .select(
            "ticker",
            F.month("target_date").alias("entry_month"),
            F.dayofmonth("target_date").alias("entry_day"),
            "holding_days",
            F.year("target_date").alias("year"),
            "target_date",
            "entry_date",
            "exit_date",
            "entry_price",
            "exit_price",
            ret.alias("ret"),
            (ret > 0).alias("win"),
        )
    )


def keep_recent(
    observations: DataFrame, lookback_years: int, key: Sequence[str] = WINDOW_KEY
) -> DataFrame:
    """The most recent ``lookback_years`` valid observations of every window."""
    if lookback_years <= 0:
        raise ValueError(f"lookback_years is {lookback_years}, below 1")
    w = Window.partitionBy(*key).orderBy(F.desc("year"))
    return (
        observations.withColumn("_recent", F.row_number().over(w))
        .where(F.col("_recent") <= lookback_years)
        .drop("_recent")
    )


def seasonal_returns(
    prices: DataFrame,
    entries: Sequence[tuple[int, int]],
    holdings: Sequence[int],
    lookback_years: int = 15,
    max_shift: int = 7,
) -> DataFrame:
    return keep_recent(
        seasonal_observations(clean_prices(prices), entries, holdings, max_shift), lookback_years
    )


def add_benchmark(observations: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Benchmark return over exactly the same two dates; null if either is missing.

    The benchmark has at most one row per calendar day, which bounds the broadcast.
    """
    clean = (
        benchmark.where(
            F.col("date").isNotNull() & F.col("adj_close").isNotNull() & ~F.isnan("adj_close")
        )
        .groupBy("date")
        .agg(F.min("adj_close").alias("adj_close"))
    )
    at_entry = clean.select(F.col("date").alias("entry_date"), F.col("adj_close").alias("_b0"))
    at_exit = clean.select(F.col("date").alias("exit_date"), F.col("adj_close").alias("_b1"))
    bench = F.try_divide(F.col("_b1"), F.col("_b0")) - 1
    return (
        observations.join(F.broadcast(at_entry), "entry_date", "left")
        .join(F.broadcast(at_exit), "exit_date", "left")
        .withColumn("bench_ret", bench)
        .withColumn("excess", F.col("ret") - F.col("bench_ret"))
        .withColumn("beat", F.coalesce(F.col("excess") > 0, F.lit(False)))
        .drop("_b0", "_b1")
    )


# The metric lists are SQL text: a window has about sixty aggregates, and parsing each once is much
# cheaper to plan than building it call by call.


def absolute_aggregates(prefix: str, rows: str = "true") -> list[Column]:
    r = f"CASE WHEN {rows} THEN ret END"
    texts = {
        "n": f"count({r})",
        "wins": f"count(CASE WHEN {rows} AND ret > 0 THEN 1 END)",
        "mean": f"avg({r})",
        "median": f"percentile({r}, 0.5D)",
        "std": f"stddev_samp({r})",
        "best": f"max({r})",
        "worst": f"min({r})",
        "gain": f"coalesce(sum(CASE WHEN {rows} AND ret > 0 THEN ret END), 0D)",
        "loss": f"coalesce(sum(CASE WHEN {rows} AND ret <= 0 THEN ret END), 0D)",
    }
    return [F.expr(t).alias(f"{prefix}_{n}") for n, t in texts.items()]


def relative_aggregates(prefix: str, rows: str = "true") -> list[Column]:
    e = f"CASE WHEN {rows} AND bench_ret IS NOT NULL THEN excess END"
    texts = {
        "bn": f"count({e})",
        "beats": f"count(CASE WHEN beat THEN {e} END)",
        "emean": f"avg({e})",
        "emedian": f"percentile({e}, 0.5D)",
        "eq25": f"percentile({e}, 0.25D)",
        "estd": f"stddev_samp({e})",
        "ebest": f"max({e})",
        "eworst": f"min({e})",
    }
    return [F.expr(t).alias(f"{prefix}_{n}") for n, t in texts.items()]


def absolute_columns(p: str) -> dict[str, Column | str]:
    """Metrics from the aggregates of ``absolute_aggregates``; zeros for an empty sample."""
    return {
        "sample_size": f"{p}_n",
        "wins": f"{p}_wins",
        "losses": f"{p}_n - {p}_wins",
        "win_rate": f"coalesce(try_divide(double({p}_wins), {p}_n), 0D)",
        "average_return": f"coalesce({p}_mean, 0D)",
        "median_return": f"coalesce({p}_median, 0D)",
        "std_dev": f"coalesce({p}_std, 0D)",
        "best_return": f"coalesce({p}_best, 0D)",
        "worst_return": f"coalesce({p}_worst, 0D)",
        "average_gain": f"coalesce(try_divide({p}_gain, {p}_wins), 0D)",
        "average_loss": f"coalesce(try_divide({p}_loss, {p}_n - {p}_wins), 0D)",
        "profit_factor": f"CASE WHEN {p}_loss <> 0 THEN {p}_gain / abs({p}_loss) "
        f"WHEN {p}_gain > 0 THEN double('inf') ELSE 0D END",
        "wilson": wilson_lower_bound(f"{p}_wins", f"{p}_n"),
    }


def mean_lower_bound(mean: Column, std: Column, n: Column, confidence: float = 0.8) -> Column:
    """One-sided lower confidence bound of a mean; 0 for no value, the value itself for one."""
    bound = mean - student_quantile(n - 1, confidence) * std / F.sqrt(n)
    return F.when(n == 0, F.lit(0.0)).when(n == 1, mean).otherwise(bound)


def relative_columns(p: str, confidence: float = 0.8) -> dict[str, Column | str]:
    n, mean, std = F.col(f"{p}_bn"), F.col(f"{p}_emean"), F.col(f"{p}_estd")
    return {
        "benchmark_sample_size": f"{p}_bn",
        "beat_rate": f"coalesce(try_divide(double({p}_beats), {p}_bn), 0D)",
        "average_excess": f"coalesce({p}_emean, 0D)",
        "median_excess": f"coalesce({p}_emedian, 0D)",
        "best_excess": f"coalesce({p}_ebest, 0D)",
        "worst_excess": f"coalesce({p}_eworst, 0D)",
        "excess_std": f"coalesce({p}_estd, 0D)",
        "excess_lcb": mean_lower_bound(mean, std, n, confidence),
        "excess_q25": f"coalesce({p}_eq25, 0D)",
    }


def named(columns: dict[str, Column | str], prefix: str = "") -> list[Column]:
    return [
        (F.expr(c) if isinstance(c, str) else c).alias(f"{prefix}{n}") for n, c in columns.items()
    ]


def absolute_metrics(observations: DataFrame, key: Sequence[str] = WINDOW_KEY) -> DataFrame:
    """Win, return, dispersion and profit statistics of every window."""
    agg = observations.groupBy(*key).agg(*absolute_aggregates("all"))
    return agg.select(*key, *named(absolute_columns("all")))


def relative_metrics(
    compared: DataFrame, key: Sequence[str] = WINDOW_KEY, confidence: float = 0.8
) -> DataFrame:
    """Statistics against the benchmark over the rows where it is known."""
    agg = compared.groupBy(*key).agg(*relative_aggregates("all"))
    return agg.select(*key, *named(relative_columns("all", confidence)))
