"""Monthly diagnostics of predictions and their summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from perennial.functions.inference import hac_t, mean_t
from perennial.operators.crosssection import (
    PERIOD,
    decile_spread,
    decile_table,
    neutralize,
    spearman,
    with_decile,
)


def monthly_diagnostics(
    predictions: DataFrame,
    outcome: str = "residual",
    residual: str = "residual",
    ex_bottom_residual: str = "residual",
    prediction: str = "prediction",
    required: tuple[str, ...] = (),
) -> DataFrame:
    """One row per month: rank correlation, decile returns and spreads.

    ``outcome`` is what the prediction is correlated with; rows need the prediction, the outcome and
    ``required``.  The correlation of prediction and beta uses all predicted rows.
    """
    valid = predictions.dropna(subset=list({prediction, outcome, *required}))
    ic = spearman(valid, {"ic": (prediction, outcome)})
    beta = spearman(predictions, {"prediction_beta_corr": (prediction, "beta_24m")})
    measures = {"ret": "return", residual: "residual"}
    if ex_bottom_residual != residual:
        measures[ex_bottom_residual] = "_other"
    spread = decile_spread(valid, prediction, measures)
    if ex_bottom_residual != residual:
        spread = spread.withColumn("ex_bottom_residual", F.col("ex_bottom__other")).drop(
            *[f"{s}__other" for s in ("top", "bottom", "ex_bottom", "long_short")]
        )
    bench = valid.groupBy(PERIOD).agg(F.max("bench_ret").alias("benchmark_return"))
    out = spread.join(ic, PERIOD).join(beta, PERIOD).join(bench, PERIOD)
    return out.withColumns(
        {
            "top_excess": F.col("top_return") - F.col("benchmark_return"),
            "ex_bottom_excess": F.col("ex_bottom_return") - F.col("benchmark_return"),
        }
    )


def _positive_rate(c: str, of_all: bool = True) -> Column:
    hit = F.when(F.col(c) > 0, 1.0).when(F.col(c) <= 0, 0.0)
    return F.avg(F.coalesce(hit, F.lit(0.0)) if of_all else hit)


def summarize_months(monthly: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """Averages, positive rate and t statistics over months (at most one row per month and key)."""
    means = {
        "average_prediction_beta_corr": "prediction_beta_corr",
        "average_ic": "ic",
        "top_return": "top_return",
        "top_excess": "top_excess",
        "top_residual": "top_residual",
        "ex_bottom_return": "ex_bottom_return",
        "ex_bottom_excess": "ex_bottom_excess",
        "ex_bottom_residual": "ex_bottom_residual",
        "bottom_residual": "bottom_residual",
        "long_short_return": "long_short_return",
        "long_short_residual": "long_short_residual",
    }
    return monthly.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("months"),
        F.percentile("ic", 0.5).alias("median_ic"),
        _positive_rate("ic").alias("positive_ic_rate"),
        mean_t("ic").alias("ic_t"),
        mean_t("long_short_return").alias("long_short_t"),
        mean_t("long_short_residual").alias("long_short_residual_t"),
        *[F.avg(c).alias(n) for n, c in means.items()],
    )


def signal_diagnostics(predictions: DataFrame, min_rows: int = 20) -> DataFrame:
    """Monthly rank correlations of prediction and quality score, and tenth spreads."""
    need = ["prediction", "quality", "residual", "excess"]
    valid = predictions.dropna(subset=need)
    sizes = valid.groupBy(PERIOD).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= min_rows)
    valid = valid.join(F.broadcast(sizes.drop("_n")), PERIOD, "left_semi")
    ics = spearman(
        valid, {"prediction_ic": ("prediction", "residual"), "quality_ic": ("quality", "residual")}
    )
    spread = decile_spread(valid, "prediction", {"residual": "residual", "excess": "excess"})
    return spread.join(ics, PERIOD)


def summarize_signals(diagnostics: DataFrame) -> DataFrame:
    """One row of averages, medians, positive rates, plain and autocorrelation-robust t.

    Without any month the averages of correlation and spread are 0 and the rest null.
    """
    flat = diagnostics.withColumnRenamed("long_short_residual", "spread")
    series = ["prediction_ic", "quality_ic", "spread"]
    plain = flat.agg(
        F.count(F.lit(1)).alias("months"),
        F.avg("prediction_ic").alias("average_ic"),
        F.percentile("prediction_ic", 0.5).alias("median_ic"),
        _positive_rate("prediction_ic", False).alias("positive_ic_rate"),
        mean_t("prediction_ic").alias("ic_t"),
        F.avg("spread").alias("average_spread"),
        F.percentile("spread", 0.5).alias("median_spread"),
        _positive_rate("spread", False).alias("positive_spread_rate"),
        mean_t("spread").alias("spread_t"),
        F.avg("long_short_excess").alias("average_excess_spread"),
        F.avg("quality_ic").alias("average_quality_ic"),
        F.percentile("quality_ic", 0.5).alias("median_quality_ic"),
        _positive_rate("quality_ic", False).alias("positive_quality_ic_rate"),
        F.avg("top_residual").alias("average_top_residual"),
        F.avg("bottom_residual").alias("average_bottom_residual"),
        F.avg("top_excess").alias("average_top_excess"),
    )
    robust = hac_t(flat.withColumn("_all", F.lit(0)), ["_all"], PERIOD, series)
    out = plain.withColumn("_all", F.lit(0)).join(F.broadcast(robust), "_all", "left").drop("_all")
    zero_when_empty = [
        "average_ic", "median_ic", "positive_ic_rate", "average_spread", "median_spread",
        "positive_spread_rate", "average_excess_spread",
    ]
    return out.withColumns(
        {c: F.when(F.col("months") == 0, F.lit(0.0)).otherwise(F.col(c)) for c in zero_when_empty}
    )


def top_portfolio(predictions: DataFrame, top_n: int = 10) -> DataFrame:
    """Per month: the ``top_n`` rows by quality as an equal-weight portfolio."""
    best = Window.partitionBy(PERIOD).orderBy(F.desc("quality"), "ticker")
    chosen = predictions.withColumn("_place", F.row_number().over(best)).where(
        F.col("_place") <= top_n
    )
    out = chosen.groupBy(PERIOD).agg(
        F.count(F.lit(1)).alias("stocks"),
        F.avg("ret").alias("portfolio_return"),
        F.max("bench_ret").alias("benchmark_return"),
        F.avg("beta_24m").alias("portfolio_beta"),
        F.avg("residual").alias("residual_alpha"),
    )
    excess = F.col("portfolio_return") - F.col("benchmark_return")
    return out.withColumns(
        {
            "excess_return": excess,
            "beat_benchmark": excess > 0,
            "positive_month": F.col("portfolio_return") > 0,
        }
    )


def summarize_top_portfolio(monthly: DataFrame) -> DataFrame:
    def rate(c: str) -> Column:
        return F.avg(F.col(c).cast("double"))

    return monthly.agg(
        F.count(F.lit(1)).alias("months"),
        rate("positive_month").alias("positive_month_rate"),
        rate("beat_benchmark").alias("beat_rate"),
        F.avg("portfolio_return").alias("average_return"),
        F.percentile("portfolio_return", 0.5).alias("median_return"),
        F.avg("excess_return").alias("average_excess"),
        F.percentile("excess_return", 0.5).alias("median_excess"),
        F.stddev_samp("excess_return").alias("excess_volatility"),
        F.min("portfolio_return").alias("worst_month"),
        F.max("portfolio_return").alias("best_month"),
        F.avg("residual_alpha").alias("average_residual_alpha"),
        F.percentile("residual_alpha", 0.5).alias("median_residual_alpha"),
        _positive_rate("residual_alpha").alias("positive_alpha_rate"),
        F.avg("portfolio_beta").alias("average_beta"),
    )


def decile_summary(deciles: DataFrame, measure: str, averages: dict[str, str]) -> DataFrame:
    """Per decile over months: averages, robust t and positive rate of ``measure``."""
    plain = deciles.groupBy("decile").agg(
        F.count(F.lit(1)).alias("months"),
        _positive_rate(measure).alias("positive_rate"),
        *[F.avg(c).alias(n) for c, n in averages.items()],
    )
    return plain.join(hac_t(deciles, ["decile"], PERIOD, [measure]), "decile")


def _halves(months: DataFrame, last_early_year: int) -> DataFrame:
    year = F.floor(F.col(PERIOD) / 12)
    half = F.when(year <= last_early_year, F.lit(f"to {last_early_year}")).otherwise(
        F.lit(f"from {last_early_year + 1}")
    )
    return months.withColumns({"_half": half, "_year": F.concat(F.lit("year "), year.cast("string"))})


def subperiods(monthly: DataFrame, last_early_year: int = 2020) -> DataFrame:
    """Repeat every month for its half, its year and the whole, labelled ``span``."""
    rows = _halves(monthly, last_early_year)
    return rows.select(monthly["*"], F.explode(F.array(F.lit("all"), "_half", "_year")).alias("span"))


def span_means(
    monthly: DataFrame, keys: Sequence[str], means: Sequence[Column], last_early_year: int = 2020
) -> DataFrame:
    """Aggregates per half, per year and overall, labelled ``span``, by grouping sets of one aggregate."""
    sets = [[*keys, "_half"], [*keys, "_year"], [*keys]]
    span = F.when(F.grouping("_half") == 0, F.col("_half")).when(F.grouping("_year") == 0, F.col("_year"))
    grouped = _halves(monthly, last_early_year).groupingSets(sets, *keys, "_half", "_year")
    found = grouped.agg(F.coalesce(span, F.lit("all")).alias("span"), *means)
    return found.drop("_half", "_year")


def decile_subperiods(
    deciles: DataFrame, averages: dict[str, str], last_early_year: int = 2020
) -> DataFrame:
    """Mean measures per decile for each half, each year and overall."""
    means = [F.count(F.lit(1)).alias("months"), *[F.avg(c).alias(n) for c, n in averages.items()]]
    return span_means(deciles, ["decile"], means, last_early_year)


def subperiod_robustness(monthly: DataFrame, last_early_year: int = 2020) -> DataFrame:
    """Rank correlation and long-short statistics per half, per year and overall.

    Only the robust t, which needs the months of a span in order, takes a copy of each month per span.
    """
    means = [
        F.count(F.lit(1)).alias("months"),
        F.avg("ic").alias("average_ic"),
        _positive_rate("ic", False).alias("positive_ic_rate"),
        F.avg("long_short_residual").alias("average_long_short"),
        _positive_rate("long_short_residual", False).alias("positive_long_short_rate"),
        F.avg("prediction_beta_corr").alias("average_beta_corr"),
    ]
    plain = span_means(monthly, [], means, last_early_year)
    rows = subperiods(monthly, last_early_year)
    return plain.join(hac_t(rows, ["span"], PERIOD, ["ic", "long_short_residual"]), "span")


def _large_months(df: DataFrame, min_rows: int) -> DataFrame:
    sizes = df.groupBy(PERIOD).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= min_rows)
    return df.join(F.broadcast(sizes.drop("_n")), PERIOD, "left_semi")


def recheck_model(
    predictions: DataFrame, min_rows: int = 100, prediction: str = "prediction"
) -> DataFrame:
    """Recompute beta-neutral returns from saved predictions and compare rank correlations."""
    data = _large_months(predictions.dropna(subset=[prediction, "ret", "beta_24m"]), min_rows)
    data = neutralize(data, "ret", "beta_24m", min_rows, "true_neutral")
    ics = spearman(
        data,
        {
            "ic": (prediction, "true_neutral"),
            "stored_target_ic": (prediction, "beta_neutral_target"),
            "prediction_beta_corr": (prediction, "beta_24m"),
        },
    )
    tails = (
        with_decile(data, prediction, min_rows)
        .groupBy(PERIOD)
        .agg(
            F.avg(F.when(F.col("decile") == 10, F.col("true_neutral"))).alias("top_neutral"),
            F.avg(F.when(F.col("decile") == 1, F.col("true_neutral"))).alias("bottom_neutral"),
        )
        .withColumn("long_short_neutral", F.col("top_neutral") - F.col("bottom_neutral"))
    )
    return ics.join(tails, PERIOD)


def raw_vs_neutral(
    predictions: DataFrame, min_rows: int = 100, prediction: str = "prediction"
) -> DataFrame:
    """Monthly rank correlations of the raw and the beta-neutral prediction."""
    need = ["ticker", prediction, "beta_24m", "ret", "residual", "bench_ret"]
    data = _large_months(predictions.dropna(subset=need), min_rows)
    data = neutralize(data, prediction, "beta_24m", min_rows, "neutral_prediction").withColumn(
        "excess", F.col("ret") - F.col("bench_ret")
    )
    pairs = {
        f"{name}_{label}": (score, against)
        for label, against in (
            ("residual_ic", "residual"), ("excess_ic", "excess"), ("beta_corr", "beta_24m"),
        )
        for name, score in (("raw", prediction), ("neutral", "neutral_prediction"))
    }
    return spearman(data, pairs)


def neutral_deciles(
    predictions: DataFrame, min_rows: int = 100, prediction: str = "prediction"
) -> DataFrame:
    """Decile table of the beta-neutral prediction."""
    need = ["ticker", prediction, "beta_24m", "ret", "residual", "bench_ret"]
    data = _large_months(predictions.dropna(subset=need), min_rows)
    data = neutralize(data, prediction, "beta_24m", min_rows, "neutral_prediction").withColumn(
        "excess", F.col("ret") - F.col("bench_ret")
    )
    return decile_table(
        data, "neutral_prediction",
        {"ret": "return", "excess": "excess", "residual": "residual", "beta_24m": "beta"}, min_rows,
    )
