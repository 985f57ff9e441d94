"""Out-of-sample checks of seasonal windows: splits, expanding folds, full analysis, suppression."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from perennial.functions.order import with_positions
from perennial.operators.seasonal import (
    WINDOW_KEY,
    absolute_aggregates,
    absolute_columns,
    named,
    relative_aggregates,
    relative_columns,
)

SCAN_ORDER = ("train_excess_lcb", "train_median_excess", "train_profit_factor", "train_wilson")
DISCOVERY_ORDER = ("wilson", "beat_rate", "median_excess", "median_return")


def chronological_split(
    observations: DataFrame, test_years: int = 5, key: Sequence[str] = WINDOW_KEY
) -> DataFrame:
    """Flag the last ``test_years`` distinct years of every window as test.

    ``enough_years`` is false where no training year would remain.
    """
    by_year = Window.partitionBy(*key).orderBy(F.desc("year"))
    whole = Window.partitionBy(*key)
    return (
        observations.withColumn("_back", F.dense_rank().over(by_year))
        .withColumn("is_test", F.col("_back") <= test_years)
        .withColumn("enough_years", F.max("_back").over(whole) > test_years)
        .drop("_back")
    )


def _sides(sides: dict[str, str]) -> list[Column]:
    out = []
    for p, rows in sides.items():
        out += absolute_aggregates(p, rows) + relative_aggregates(p, rows)
    return out


TRAIN_COLUMNS = (
    "sample_size", "win_rate", "median_return", "wilson", "beat_rate", "median_excess",
    "average_excess", "excess_lcb", "excess_q25", "worst_return", "profit_factor",
)
OOS_COLUMNS = ("sample_size", "win_rate", "median_return", "beat_rate", "median_excess")


def _flat(prefix: str, name: str, wanted: Sequence[str]) -> list[Column]:
    cols = {**absolute_columns(prefix), **relative_columns(prefix)}
    return named({c: cols[c] for c in wanted}, f"{name}_" if name else "")


def validation_metrics(
    compared: DataFrame, test_years: int = 5, key: Sequence[str] = WINDOW_KEY
) -> DataFrame:
    """Training and held-out metrics of every window with enough years."""
    split = chronological_split(compared, test_years, key).where("enough_years")
    agg = split.groupBy(*key).agg(*_sides({"tr": "NOT is_test", "te": "is_test"}))
    return agg.select(*key, *_flat("tr", "train", TRAIN_COLUMNS), *_flat("te", "oos", OOS_COLUMNS))


def walk_forward_folds(
    compared: DataFrame,
    min_training: int = 8,
    min_win_rate: float = 0.7,
    min_median_return: float = 0.0,
    min_beat_rate: float = 0.6,
    min_median_excess: float = 0.0,
    key: Sequence[str] = WINDOW_KEY,
) -> DataFrame:
    """Every observation with the metrics of the earlier ones.

    ``is_fold`` marks those with at least ``min_training`` earlier observations, ``qualified``
    whether the earlier metrics pass.  A window holds at most one row per year, so the expanding
    frame is short.
    """
    by_year = Window.partitionBy(*key).orderBy("year")
    prior = by_year.rowsBetween(Window.unboundedPreceding, -1)
    valid = F.col("bench_ret").isNotNull() & F.col("excess").isNotNull()
    e = F.when(valid, F.col("excess"))
    n = F.count("ret").over(prior)
    bn = F.count(e).over(prior)
    zero = F.lit(0.0)
    wins = F.count(F.when(F.col("ret") > 0, 1)).over(prior)
    beats = F.count(F.when(F.col("beat"), e)).over(prior)
    return (
        compared.withColumn("training_years", n)
        .withColumn("prior_wins", wins)
        .withColumn(
            "prior_win_rate",
            F.coalesce(F.try_divide(F.col("prior_wins").cast("double"), F.col("training_years")), zero),
        )
        .withColumn("prior_median_return", F.coalesce(F.percentile("ret", 0.5).over(prior), zero))
        .withColumn("prior_beat_rate", F.coalesce(F.try_divide(beats.cast("double"), bn), zero))
        .withColumn("prior_median_excess", F.coalesce(F.percentile(e, 0.5).over(prior), zero))
        .withColumn("is_fold", F.row_number().over(by_year) > min_training)
        .withColumn(
            "qualified",
            F.col("is_fold")
            & (F.col("training_years") >= min_training)
            & (F.col("prior_win_rate") >= min_win_rate)
            & (F.col("prior_median_return") >= min_median_return)
            & (F.col("prior_beat_rate") >= min_beat_rate)
            & (F.col("prior_median_excess") >= min_median_excess),
        )
    )


def _summary_aggregates() -> list[Column]:
    texts = {
        "wf_folds": "count(CASE WHEN is_fold THEN 1 END)",
        "wf_qualified_folds": "count(CASE WHEN qualified THEN 1 END)",
        "_wf_wins": "count(CASE WHEN qualified AND ret > 0 THEN 1 END)",
        "_wf_beats": "count(CASE WHEN qualified AND beat THEN 1 END)",
        "_wf_ret": "percentile(CASE WHEN qualified THEN ret END, 0.5D)",
        "_wf_excess": "percentile(CASE WHEN qualified THEN excess END, 0.5D)",
    }
    return [F.expr(t).alias(n) for n, t in texts.items()]


def _summary_columns() -> list[Column]:
    n = "wf_qualified_folds"
    return named(
        {
            "wf_folds": "wf_folds",
            "wf_qualified_folds": n,
            "wf_selection_rate": f"coalesce(try_divide(double({n}), wf_folds), 0D)",
            "wf_win_rate": f"coalesce(try_divide(double(_wf_wins), {n}), 0D)",
            "wf_beat_rate": f"coalesce(try_divide(double(_wf_beats), {n}), 0D)",
            "wf_median_return": f"CASE WHEN {n} = 0 THEN 0D ELSE _wf_ret END",
            "wf_median_excess": f"CASE WHEN {n} = 0 THEN 0D ELSE _wf_excess END",
        }
    )


def walk_forward_summary(folds: DataFrame, key: Sequence[str] = WINDOW_KEY) -> DataFrame:
    """Fold counts and realised outcome of the qualified folds, for windows that have folds."""
    agg = folds.groupBy(*key).agg(*_summary_aggregates()).where("wf_folds > 0")
    return agg.select(*key, *_summary_columns())


ABSOLUTE_COLUMNS = (
    "sample_size", "wins", "losses", "win_rate", "average_return", "median_return", "std_dev",
    "best_return", "worst_return", "average_gain", "average_loss", "profit_factor", "wilson",
)
RELATIVE_COLUMNS = ("beat_rate", "average_excess", "median_excess", "best_excess", "worst_excess")


def analyze(
    compared: DataFrame,
    min_training: int = 8,
    test_years: int = 5,
    key: Sequence[str] = WINDOW_KEY,
) -> DataFrame:
    """All metrics of every window in one row.

    ``error`` is null for a usable window; otherwise it names the first step that lacks data.
    """
    folds = walk_forward_folds(compared, min_training, key=key)
    split = chronological_split(folds, test_years, key)
    agg = split.groupBy(*key).agg(
        *_sides({"all": "true", "tr": "NOT is_test", "te": "is_test"}),
        *_summary_aggregates(),
        F.bool_and("enough_years").alias("_enough"),
    )
    error = F.when(
        F.col("wf_folds") == 0, F.lit("too few seasons to test any of them on earlier ones")
    ).when(~F.col("_enough"), F.lit("too few years to split into training and test"))
    return agg.select(
        *key,
        *_flat("all", "", ABSOLUTE_COLUMNS + RELATIVE_COLUMNS),
        *_flat("tr", "train", TRAIN_COLUMNS),
        *_flat("te", "oos", OOS_COLUMNS),
        *_summary_columns(),
        error.alias("error"),
    )


def quality_filter(
    analyzed: DataFrame,
    min_win_rate: float = 0.0,
    min_sample_size: int = 0,
    min_median_return: float | None = None,
    min_beat_rate: float | None = None,
    min_median_excess: float | None = None,
) -> DataFrame:
    """Usable windows whose training metrics reach every given threshold."""
    limits = {
        "train_sample_size": min_sample_size,
        "train_win_rate": min_win_rate,
        "train_median_return": min_median_return,
        "train_beat_rate": min_beat_rate,
        "train_median_excess": min_median_excess,
    }
    out = analyzed.where(F.col("error").isNull()).drop("error")
    for name, limit in limits.items():
        if limit is not None:
            out = out.where(F.col(name) >= limit)
    return out


def descending(names: Sequence[str], ties: Sequence[str]) -> list[Column]:
    return [-F.col(n) for n in names] + [F.col(t) for t in ties]


def rank_by(
    df: DataFrame,
    names: Sequence[str],
    ties: Sequence[str],
    keys: Sequence[str] = (),
    rank: str = "rank",
) -> DataFrame:
    """Place 1..n by ``names`` downwards; ``ties`` make the order total."""
    return with_positions(df, keys, descending(names, ties), rank)


def kept_ranks(
    ranked: DataFrame,
    entry_tolerance_days: int = 3,
    holding_tolerance_days: int = 5,
    key: Sequence[str] = ("ticker",),
    entry: str = "upcoming_entry_date",
    rank: str = "rank",
) -> DataFrame:
    """(key, rank) of the windows that survive greedy suppression per ticker in rank order.

    A window is dropped when an already kept one is close in both entry date and holding length.
    The list folded per key has at most one entry per grid window.
    """
    slim = F.struct(
        F.col(rank).alias("rank"),
        F.col(entry).alias("entry"),
        F.col("holding_days").cast("int").alias("holding"),
    )
    ordered = ranked.groupBy(*key).agg(F.array_sort(F.collect_list(slim)).alias("_all"))
    empty = F.filter("_all", lambda x: F.lit(False))

    def step(kept: Column, x: Column) -> Column:
        clash = F.exists(
            kept,
            lambda k: (F.abs(F.datediff(k["entry"], x["entry"])) <= entry_tolerance_days)
            & (F.abs(k["holding"] - x["holding"]) <= holding_tolerance_days),
        )
        return F.when(clash, kept).otherwise(F.concat(kept, F.array(x)))

    kept = ordered.select(*key, F.explode(F.aggregate("_all", empty, step)).alias("_kept"))
    return kept.select(*key, F.col("_kept.rank").alias(rank))


def suppress_overlaps(ranked: DataFrame, key: Sequence[str] = ("ticker",), **tolerances) -> DataFrame:
    """The rows of ``ranked`` that survive ``kept_ranks``, with their rank in the full list."""
    return ranked.join(kept_ranks(ranked, key=key, **tolerances), [*key, "rank"], "left_semi")
