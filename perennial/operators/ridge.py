"""Rolling ridge regression from additive monthly sums.

A fit over the previous 120 months needs only the sums of products over those months.  They are
collected once per month, added up over the window, and a small system is solved per test month; the
data is read once however many months are tested.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from perennial.operators.crosssection import PERIOD, ranked_in_month


def _product_sums(features: Sequence[str], target: str, shift: Sequence[float]):
    columns = [*features, target]
    shift = np.asarray(shift, dtype=float)
    width = len(columns) + 1
    upper = np.triu_indices(width)

    def collect(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            values = batch[columns].to_numpy(dtype=float)
            periods = batch[PERIOD].to_numpy()
            usable = np.isfinite(values).all(axis=1)
            for p in np.unique(periods):
                rows = values[(periods == p) & usable] - shift
                z = np.column_stack([np.ones(len(rows)), rows])
                sums[p] = sums.get(p, 0.0) + (z.T @ z)[upper]
        if sums:
            yield pd.DataFrame({PERIOD: list(sums), "sums": [list(v) for v in sums.values()]})

    return collect


def _solver(features: Sequence[str], shift: Sequence[float], alpha: float):
    p = len(features)
    width = p + 2
    upper = np.triu_indices(width)
    shift = np.asarray(shift, dtype=float)

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for period, sums in zip(batch[PERIOD], batch["sums"]):
                gram = np.zeros((width, width))
                gram[upper] = sums
                gram = gram + np.triu(gram, 1).T
                n = gram[0, 0]
                if n < 1:
                    continue
                mean = gram[0, 1:] / n
                centred = gram[1:, 1:] - n * np.outer(mean, mean)
                variance = np.clip(np.diag(centred)[:p] / n, 0.0, None)
                level = (mean[:p] + shift[:p]) ** 2 + mean[:p] ** 2
                constant = variance <= 1e-13 * level
                scale = np.where(constant, 1.0, np.sqrt(variance))
                a = centred[:p, :p] / np.outer(scale, scale)
                b = centred[:p, p] / scale
                a[constant, :] = 0.0
                a[:, constant] = 0.0
                b[constant] = 0.0
                coef = np.linalg.solve(a + alpha * np.eye(p), b) / scale
                intercept = mean[p] + shift[p] - coef @ (mean[:p] + shift[:p])
                out.append((int(period), int(round(n)), float(intercept), coef.tolist()))
            yield pd.DataFrame(out, columns=[PERIOD, "n_train", "intercept", "coef"])

    return solve


def column_shift(df: DataFrame, features: Sequence[str], target: str) -> list[float]:
    """One row of column means, read to the driver; centring limits cancellation in the sums."""
    row = df.agg(*[F.avg(c) for c in [*features, target]]).first()
    return [float(v) if v is not None else 0.0 for v in row]


def monthly_sums(
    df: DataFrame, features: Sequence[str], target: str, shift: Sequence[float]
) -> DataFrame:
    """(period_idx, place, value): summed products per month, zero where no row is usable."""
    rows = df.select(PERIOD, *[F.col(c).cast("double").alias(c) for c in [*features, target]])
    parts = rows.mapInPandas(
        _product_sums(features, target, shift), f"{PERIOD} int, sums array<double>"
    )
    return (
        parts.select(PERIOD, F.posexplode("sums").alias("place", "value"))
        .groupBy(PERIOD, "place")
        .agg(F.sum("value").alias("value"))
    )


def _coefficients(sums: DataFrame, features, shift, alpha) -> DataFrame:
    packed = sums.groupBy(PERIOD).agg(
        F.transform(
            F.array_sort(F.collect_list(F.struct("place", "value"))), lambda s: s["value"]
        ).alias("sums")
    )
    return packed.mapInPandas(
        _solver(features, shift, alpha),
        f"{PERIOD} int, n_train long, intercept double, coef array<double>",
    )


def ridge_fit(
    df: DataFrame, features: Sequence[str], target: str, alpha: float = 10.0
) -> DataFrame:
    """One fit over all rows: (n_train, intercept, coef) on the original feature scale."""
    shift = column_shift(df, features, target)
    sums = monthly_sums(df.withColumn(PERIOD, F.lit(0)), features, target, shift)
    return _coefficients(sums, features, shift, alpha).drop(PERIOD)


def rolling_ridge(
    df: DataFrame,
    features: Sequence[str],
    target: str,
    training_months: int = 120,
    alpha: float = 10.0,
) -> DataFrame:
    """Coefficients per month from the ``training_months`` calendar months before it."""
    shift = column_shift(df, features, target)
    sums = monthly_sums(df, features, target, shift)
    window = Window.partitionBy("place").orderBy(PERIOD).rangeBetween(-training_months, -1)
    rolled = sums.select(PERIOD, "place", F.sum("value").over(window).alias("value"))
    return _coefficients(
        rolled.where(F.col("value").isNotNull()), features, shift, alpha
    )


def predict(
    df: DataFrame, fits: DataFrame, features: Sequence[str], prediction: str = "prediction"
) -> DataFrame:
    """Score rows that have all features with their month's fit (one broadcast row per month)."""
    complete = df.dropna(subset=list(features))
    terms = " + ".join(["intercept", *[f"coef[{i}] * `{f}`" for i, f in enumerate(features)]])
    return (
        complete.join(F.broadcast(fits), PERIOD)
        .withColumn(prediction, F.expr(terms))
        .drop("intercept", "coef")
    )


def walk_forward_predictions(
    df: DataFrame,
    features: Sequence[str],
    target: str,
    start: int,
    end: int,
    training_months: int = 120,
    alpha: float = 10.0,
    min_test_rows: int = 30,
    prediction: str = "prediction",
) -> DataFrame:
    """Out-of-sample predictions for the months ``start``..``end`` (month indexes).

    A month is skipped without training rows or with fewer than ``min_test_rows`` complete rows.
    The input is read several times; materialize a costly panel first.
    """
    in_range = F.col(PERIOD).between(start, end)
    fits = rolling_ridge(
        df.where(F.col(PERIOD).between(start - training_months, end)),
        features, target, training_months, alpha,
    ).where(in_range & (F.col("n_train") > 0))
    test = df.where(in_range).dropna(subset=list(features))
    sizes = (
        test.groupBy(PERIOD)
        .agg(F.count(F.lit(1)).alias("_rows"))
        .where(F.col("_rows") >= min_test_rows)
        .drop("_rows")
    )
    kept = test.join(F.broadcast(sizes), PERIOD, "left_semi")
    return predict(kept, fits, features, prediction)


def predict_rank(df: DataFrame, prediction: str = "prediction") -> DataFrame:
    """Rank 1..n within the month and percentile 1 - (rank-1)/n."""
    ranked = ranked_in_month(df, prediction, "rank", "_n")
    return ranked.withColumn("percentile", 1 - (F.col("rank") - 1) / F.col("_n")).drop("_n")


def alpha_quality(
    df: DataFrame, prediction: str = "prediction", volatility_floor: float = 0.02
) -> DataFrame:
    """Prediction per unit of idiosyncratic risk, ranked within the month."""
    score = F.try_divide(F.col(prediction), F.col("idio_volatility_6m") + volatility_floor)
    return ranked_in_month(df.withColumn("quality", score), "quality", "rank")
