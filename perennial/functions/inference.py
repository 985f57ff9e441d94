"""Significance of a mean over a short time series (one value per month and group)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def mean_t(value: str) -> Column:
    """Aggregate: mean over its standard error; 0 below two values or without variation."""
    n, s = F.count(value), F.stddev_samp(value)
    t = F.try_divide(F.avg(value), s / F.sqrt(n))
    return F.when((n >= 2) & (s > 0), t).otherwise(F.lit(0.0))


def hac_t(
    df: DataFrame, keys: Sequence[str], order: str, values: Sequence[str], max_lag: int = 3
) -> DataFrame:
    """Newey-West t statistic of every value column's mean per group (Bartlett weights).

    Nulls are dropped before lags are taken.  Output columns are ``<value>_hac_t``.
    """
    items = [F.struct(F.lit(v).alias("_series"), F.col(v).alias("_v")) for v in values]
    long = df.select(*keys, order, F.inline(F.array(*items))).where(F.col("_v").isNotNull())
    by = [*keys, "_series"]
    whole = Window.partitionBy(*by)
    ordered = whole.orderBy(order)
    centred = long.withColumn("_x", F.col("_v") - F.avg("_v").over(whole))
    lagged = centred.withColumns(
        {f"_p{k}": F.col("_x") * F.lag("_x", k).over(ordered) for k in range(1, max_lag + 1)}
    )
    n = F.count(F.lit(1))
    long_run = F.sum(F.col("_x") * F.col("_x")) / n
    for k in range(1, max_lag + 1):
        weight = 2 * (1 - k / (max_lag + 1))
        long_run = long_run + weight * F.coalesce(F.sum(f"_p{k}"), F.lit(0.0)) / n
    stats = lagged.groupBy(*by).agg(
        n.alias("_n"), F.avg("_v").alias("_mean"), (long_run / n).alias("_var")
    )
    t = F.when(
        (F.col("_n") >= 2) & (F.col("_var") > 0), F.col("_mean") / F.sqrt("_var")
    ).otherwise(F.lit(0.0))
    scored = stats.withColumn("_t", t)
    wide = [
        F.coalesce(F.max(F.when(F.col("_series") == v, F.col("_t"))), F.lit(0.0)).alias(f"{v}_hac_t")
        for v in values
    ]
    return scored.groupBy(*keys).agg(*wide)
