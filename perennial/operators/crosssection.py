"""Operators inside one month: standardisation, beta neutralisation, rank correlation, deciles.

A month can hold a large share of all rows.  Moments come from a grouped aggregation (combined on the
map side) whose result has one row per calendar month and is broadcast back; anything that needs an
order uses the split ranges of ``functions.order``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from perennial.functions.columns import is_missing
from perennial.functions.order import exact_quantiles, with_average_rank, with_positions

PERIOD = "period_idx"


def per_month(df: DataFrame, stats: Sequence[Column], key: str = PERIOD) -> DataFrame:
    """Add per-month aggregates to every row (one broadcast row per calendar month)."""
    return df.join(F.broadcast(df.groupBy(key).agg(*stats)), key)


def zscore(df: DataFrame, columns: dict[str, str], fill: float | None = None) -> DataFrame:
    """Standardise columns within each month (sample deviation, null where it is zero)."""
    stats = []
    for c in columns:
        stats += [F.avg(c).alias(f"_m_{c}"), F.stddev_samp(c).alias(f"_s_{c}")]
    out = per_month(df, stats)
    scores = {}
    for c, name in columns.items():
        z = F.try_divide(F.col(c) - F.col(f"_m_{c}"), F.col(f"_s_{c}"))
        scores[name] = z if fill is None else F.coalesce(z, F.lit(fill))
    return out.withColumns(scores).drop(*[f"_{k}_{c}" for c in columns for k in "ms"])


def residual_target(df: DataFrame) -> DataFrame:
    """Residual return standardised within the month."""
    return zscore(df, {"residual": "residual_target"})


def standardized_features(df: DataFrame, features: Sequence[str]) -> DataFrame:
    return zscore(df, {f: f"cs_{f}" for f in features})


def neutralize(
    df: DataFrame, value: str, on: str, min_rows: int, residual: str, target: str | None = None
) -> DataFrame:
    """Residual of a per-month regression of ``value`` on ``on`` over rows that have both.

    Null in months with fewer than ``min_rows`` such rows.  A constant regressor leaves the
    deviation from the mean.  ``target`` is the residual divided by its sample deviation.
    """
    both = F.col(value).isNotNull() & F.col(on).isNotNull()
    y, x = F.when(both, F.col(value)), F.when(both, F.col(on))
    slope = F.coalesce(F.try_divide(F.covar_pop(y, x), F.var_pop(x)), F.lit(0.0))
    # residuals have mean 0, and their variance follows from the same moments
    unexplained = F.var_samp(y) - slope * F.covar_samp(y, x)
    fitted = per_month(
        df,
        [
            F.count(y).alias("_n"),
            slope.alias("_slope"),
            F.avg(y).alias("_my"),
            F.avg(x).alias("_mx"),
            F.sqrt(F.greatest(unexplained, F.lit(0.0))).alias("_s"),
        ],
    )
    enough = both & (F.col("_n") >= min_rows)
    gap = (F.col(value) - F.col("_my")) - F.col("_slope") * (F.col(on) - F.col("_mx"))
    out = fitted.withColumn(residual, F.when(enough, gap))
    if target is not None:
        out = out.withColumn(target, F.when(F.col("_s") > 0, F.col(residual) / F.col("_s")))
    return out.drop("_n", "_slope", "_my", "_mx", "_s")


def beta_neutral_target(df: DataFrame, min_rows: int = 20) -> DataFrame:
    return neutralize(
        df, "ret", "beta_24m", min_rows, "beta_neutral_return", "beta_neutral_target"
    )


def beta_neutral_prediction(
    df: DataFrame, prediction: str = "prediction", min_rows: int = 100
) -> DataFrame:
    return neutralize(df, prediction, "beta_24m", min_rows, "neutral_prediction")


def _long(df: DataFrame, ident: Sequence[str], columns: Sequence[str], name: str) -> DataFrame:
    items = [F.struct(F.lit(c).alias(name), F.col(c).alias("_value")) for c in columns]
    return df.select(*ident, F.inline(F.array(*items)))


def winsor_zscore(
    df: DataFrame,
    features: Sequence[str],
    identity: Sequence[str] = ("ticker",),
    lower: float = 0.01,
    upper: float = 0.99,
) -> DataFrame:
    """Per month: clip to exact quantiles, standardise, missing to 0, plus a missing flag.

    The quantiles of all features come from one pass in long form.
    """
    long = _long(df, [PERIOD, *identity], features, "_feature")
    bounds = exact_quantiles(
        long, [PERIOD, "_feature"], "_value", identity, {"_lo": lower, "_hi": upper}
    )
    wide = bounds.groupBy(PERIOD).agg(
        *[
            F.max(F.when(F.col("_feature") == f, F.col(b))).alias(f"{b}_{f}")
            for f in features
            for b in ("_lo", "_hi")
        ]
    )
    clipped = df.join(F.broadcast(wide), PERIOD, "left").withColumns(
        {
            **{
                f"_c_{f}": F.when(
                    F.col(f).isNotNull(),
                    F.greatest(F.least(F.col(f), F.col(f"_hi_{f}")), F.col(f"_lo_{f}")),
                )
                for f in features
            },
            **{f"missing_{f}": is_missing(f) for f in features},
        }
    )
    scored = zscore(clipped, {f"_c_{f}": f"cs_{f}" for f in features}, fill=0.0)
    return scored.drop(*[f"{b}_{f}" for f in features for b in ("_lo", "_hi", "_c")])


def spearman(
    df: DataFrame, pairs: dict[str, tuple[str, str]], identity: Sequence[str] = ("ticker",)
) -> DataFrame:
    """Rank correlation per month of several column pairs, each over rows that have both values.

    Null for constant columns.  All pairs are ranked in one long-form pass.
    """
    items = [
        F.struct(
            F.lit(name).alias("_pair"),
            F.lit(side).alias("_side"),
            F.when(F.col(x).isNotNull() & F.col(y).isNotNull(), F.col(v).cast("double")).alias(
                "_value"
            ),
        )
        for name, (x, y) in pairs.items()
        for side, v in enumerate((x, y))
    ]
    long = df.select(PERIOD, *identity, F.inline(F.array(*items))).where(
        F.col("_value").isNotNull()
    )
    ranked = with_average_rank(long, [PERIOD, "_pair", "_side"], "_value", identity, "_rank")
    paired = ranked.groupBy(PERIOD, "_pair", *identity).agg(
        F.max(F.when(F.col("_side") == 0, F.col("_rank"))).alias("_x"),
        F.max(F.when(F.col("_side") == 1, F.col("_rank"))).alias("_y"),
    )
    rho = F.try_divide(
        F.covar_samp("_x", "_y"), F.stddev_samp("_x") * F.stddev_samp("_y")
    )
    per_pair = paired.groupBy(PERIOD, "_pair").agg(rho.alias("_rho"))
    return per_pair.groupBy(PERIOD).agg(
        *[F.max(F.when(F.col("_pair") == n, F.col("_rho"))).alias(n) for n in pairs]
    )


def ranked_in_month(
    df: DataFrame, score: str, rank: str = "rank", size: str | None = None, descending: bool = True
) -> DataFrame:
    """Ordinal place within the month by ``score``, ties by ticker."""
    order = -F.col(score) if descending else F.col(score)
    return with_positions(df, [PERIOD], [order, F.col("ticker")], rank, size)


def decile_spread(df: DataFrame, score: str, measures: dict[str, str]) -> DataFrame:
    """Per month: means over the top and bottom tenth, all but the bottom tenth, and top - bottom.

    ``measures`` maps a column to the stem of its output names.
    """
    placed = ranked_in_month(df, score, "_place", "_size")
    k = F.greatest(F.lit(1), F.floor(F.col("_size") / 10))
    sides = {
        "top": F.col("_place") <= k,
        "bottom": F.col("_place") > F.col("_size") - k,
        "ex_bottom": F.col("_place") <= F.col("_size") - k,
    }
    aggs = [F.count(F.lit(1)).alias("universe_size")]
    aggs += [
        F.avg(F.when(rows, F.col(c))).alias(f"{side}_{stem}")
        for side, rows in sides.items()
        for c, stem in measures.items()
    ]
    out = placed.groupBy(PERIOD).agg(*aggs)
    return out.withColumns(
        {f"long_short_{s}": F.col(f"top_{s}") - F.col(f"bottom_{s}") for s in measures.values()}
    )


def with_decile(df: DataFrame, score: str, min_rows: int = 100, decile: str = "decile") -> DataFrame:
    """Decile 1..10 of the ascending ordinal rank, for months with at least ``min_rows`` rows.

    Equal to cutting the ranks at their 10% quantiles, in integers.
    """
    placed = ranked_in_month(df, score, "_r", "_size", descending=False)
    r, n = F.col("_r"), F.col("_size")
    number = F.greatest(F.lit(1), F.ceil(F.try_divide(10 * (r - 1), n - 1))).cast("int")
    return placed.where(n >= min_rows).withColumn(decile, number).drop("_r", "_size")


def decile_table(
    df: DataFrame, score: str, measures: dict[str, str], min_rows: int = 100
) -> DataFrame:
    """Per (month, decile): stock count and mean of every measure."""
    return (
        with_decile(df, score, min_rows)
        .groupBy(PERIOD, "decile")
        .agg(
            F.count(F.lit(1)).alias("stocks"),
            *[F.avg(c).alias(n) for c, n in measures.items()],
        )
    )


def latest_ranking(df: DataFrame, score: str = "prediction") -> DataFrame:
    """The last month only: ordinal rank and percentile of the score."""
    scored = df.where(F.col(score).isNotNull() & F.col("ticker").isNotNull())
    last = df.agg(F.max(PERIOD).alias(PERIOD))
    rows = scored.join(F.broadcast(last), PERIOD, "left_semi")
    placed = with_positions(rows, [PERIOD], [-F.col(score), F.col("ticker")], "rank")
    return with_average_rank(placed, [PERIOD], score, ["ticker"], "_avg", percentile="percentile").drop(
        "_avg"
    )
