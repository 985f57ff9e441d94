"""Cross-sectional operators, rolling ridge, diagnostics and portfolios on the monthly panel."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.feature_queries import FEATURES, SECTOR_ORDER
from checks.inputs import benchmark, prices, sector_prices
from checks.monthly_queries import pct_sql
from checks.registry import query
from perennial.functions.inference import hac_t as hac
from perennial.functions.order import with_average_rank
from perennial.functions.storage import materialize
from perennial.operators import crosssection as CS
from perennial.operators import evaluation as EV
from perennial.operators import features as FE
from perennial.operators import portfolio as PF
from perennial.operators import ridge as R
from perennial.operators.sectors import build_panel_with_sectors
from perennial.plans import walkforward as WF

MIN_ROWS = 20
#: Every month of the panel that has an earlier one; months without training rows drop out.
START, END = "(SELECT min(period_idx) + 1 FROM panel)", "(SELECT max(period_idx) FROM panel)"
TRAIN_MONTHS = 36
PAIR = ("momentum_3m", "volatility_6m")
MODEL = WF.Model(PAIR, "beta_neutral_target", CS.beta_neutral_target)
ID = "ticker:s period_idx:i"


def panel(spark, sf):
    return materialize(FE.build_panel(prices(spark, sf), benchmark(spark, sf), 2), "panel")


def span(rows) -> tuple[int, int]:
    """First and last month to predict."""
    first, last = rows.agg(F.min("period_idx"), F.max("period_idx")).first()
    return first + 1, last


def neutral_sql(source: str, name: str, value: str, out: str, target: str | None, rows: int) -> str:
    """Residual of value on beta per month, and its z score."""
    z = ""
    if target:
        z = f""", (r - avg(r) OVER (PARTITION BY period_idx))
  / nullif(stddev_samp(r) OVER (PARTITION BY period_idx), 0) AS {target}"""
    return f"""{name}_fit AS (SELECT period_idx, count(*) AS fit_n, regr_slope({value}, beta_24m) AS fit_b,
  regr_intercept({value}, beta_24m) AS fit_a FROM {source} WHERE {value} IS NOT NULL
  AND beta_24m IS NOT NULL GROUP BY 1),
{name} AS (SELECT * EXCLUDE (r, fit_n, fit_a, fit_b), r AS {out}{z} FROM (
  SELECT s.*, f.fit_n, f.fit_a, f.fit_b,
  CASE WHEN f.fit_n >= {rows} THEN {value} - (f.fit_a + f.fit_b * beta_24m) END AS r
  FROM {source} s LEFT JOIN {name}_fit f USING (period_idx)))"""


BN = FEATURES + ",\n" + neutral_sql(
    "panel", "bn", "ret", "beta_neutral_return", "beta_neutral_target", MIN_ROWS
)


def z_sql(c: str) -> str:
    return f"""({c} - avg({c}) OVER (PARTITION BY period_idx))
  / nullif(stddev_samp({c}) OVER (PARTITION BY period_idx), 0)"""


@query(
    "cs_zscore_target",
    f"{ID} residual:d residual_target:d",
    FEATURES,
    f"SELECT *, {z_sql('residual')} AS residual_target FROM panel",
)
def cs_zscore_target(spark, sf):
    return CS.residual_target(panel(spark, sf))


@query(
    "cs_zscore_features",
    f"{ID} " + " ".join(f"cs_{f}:d" for f in FE.FEATURES_V5),
    FEATURES,
    "SELECT *, " + ", ".join(f"{z_sql(f)} AS cs_{f}" for f in FE.FEATURES_V5) + " FROM panel",
)
def cs_zscore_features(spark, sf):
    return CS.standardized_features(panel(spark, sf), FE.FEATURES_V5)


@query(
    "pct_rank_avg",
    f"{ID} season_beat_rate:d percentile:d",
    FEATURES,
    f"""SELECT *, {pct_sql('season_beat_rate', 'period_idx')} AS percentile FROM panel
  WHERE season_beat_rate IS NOT NULL""",
)
def pct_rank_avg(spark, sf):
    rows = panel(spark, sf).where(F.col("season_beat_rate").isNotNull())
    return with_average_rank(
        rows, ["period_idx"], "season_beat_rate", ["ticker"], percentile="percentile"
    )


@query(
    "beta_neutral_target",
    f"{ID} beta_neutral_return:d beta_neutral_target:d",
    BN,
    "SELECT * FROM bn",
)
def beta_neutral_target(spark, sf):
    return CS.beta_neutral_target(panel(spark, sf), MIN_ROWS)


WINSOR = ("momentum_12m", "residual_momentum_12m", "volatility_12m")


def winsor_sql(features, source: str) -> str:
    clip, z, miss = [], [], []
    for f in features:
        clip.append(
            f"""CASE WHEN {f} IS NULL THEN NULL ELSE greatest(least({f},
  quantile_cont({f}, 0.99) OVER (PARTITION BY period_idx)),
  quantile_cont({f}, 0.01) OVER (PARTITION BY period_idx)) END AS c_{f}"""
        )
        z.append(f"coalesce({z_sql('c_' + f)}, 0) AS cs_{f}")
        miss.append(f"CASE WHEN {f} IS NULL THEN 1.0 ELSE 0.0 END AS missing_{f}")
    return f"""SELECT *, {', '.join(z)}, {', '.join(miss)} FROM (
  SELECT *, {', '.join(clip)} FROM {source})"""


@query(
    "winsor_zscore",
    f"{ID} " + " ".join(f"cs_{f}:d missing_{f}:d" for f in WINSOR),
    FEATURES,
    winsor_sql(WINSOR, "panel"),
)
def winsor_zscore(spark, sf):
    return CS.winsor_zscore(panel(spark, sf), WINSOR)


def spearman_sql(x: str, y: str, source: str, name: str = "ic") -> str:
    """One row per month; rows without both values are left out."""
    return f"""SELECT period_idx, CASE WHEN stddev_samp(rx) > 0 AND stddev_samp(ry) > 0
  THEN corr(rx, ry) END AS {name} FROM (
  SELECT period_idx, {avg_rank_sql(x)} AS rx, {avg_rank_sql(y)} AS ry FROM {source}
  WHERE {x} IS NOT NULL AND {y} IS NOT NULL) GROUP BY 1"""


def avg_rank_sql(v: str) -> str:
    return f"""(rank() OVER (PARTITION BY period_idx ORDER BY {v})
  + (count(*) OVER (PARTITION BY period_idx, {v}) - 1) / 2.0)"""


@query(
    "spearman_ic",
    "period_idx:i momentum_ic:d beat_ic:d",
    FEATURES,
    f"""SELECT * FROM ({spearman_sql('momentum_6m', 'ret', 'panel', 'momentum_ic')})
  FULL JOIN ({spearman_sql('season_beat_rate', 'residual', 'panel', 'beat_ic')}) USING (period_idx)""",
)
def spearman_ic(spark, sf):
    return CS.spearman(
        panel(spark, sf),
        {"momentum_ic": ("momentum_6m", "ret"), "beat_ic": ("season_beat_rate", "residual")},
    )


def spread_sql(source: str, score: str, measures: dict[str, str]) -> str:
    sides = {"top": "p <= k", "bottom": "p > n - k", "ex_bottom": "p <= n - k"}
    aggs = [
        f"avg({c}) FILTER (WHERE {rows}) AS {side}_{stem}"
        for side, rows in sides.items() for c, stem in measures.items()
    ]
    diffs = [f"top_{s} - bottom_{s} AS long_short_{s}" for s in measures.values()]
    return f"""SELECT *, {', '.join(diffs)} FROM (SELECT period_idx, count(*) AS universe_size, {', '.join(aggs)}
  FROM (SELECT *, greatest(1, n // 10) AS k FROM (SELECT *, count(*) OVER (PARTITION BY period_idx) AS n,
  row_number() OVER (PARTITION BY period_idx ORDER BY {score} DESC, ticker) AS p FROM {source}))
  GROUP BY period_idx)"""


def spread_spec(stems) -> str:
    names = [f"{side}_{s}:d" for side in ("top", "bottom", "ex_bottom", "long_short") for s in stems]
    return "period_idx:i universe_size:i " + " ".join(names)


@query(
    "decile_spread",
    spread_spec(["return", "excess"]),
    FEATURES + ", m AS (SELECT * FROM panel WHERE momentum_6m IS NOT NULL AND ret IS NOT NULL)",
    spread_sql("m", "momentum_6m", {"ret": "return", "excess": "excess"}),
)
def decile_spread(spark, sf):
    rows = panel(spark, sf).dropna(subset=["momentum_6m", "ret"])
    return CS.decile_spread(rows, "momentum_6m", {"ret": "return", "excess": "excess"})


def decile_sql(source: str, score: str, rows: int, keep: str = "*") -> str:
    """Cut the ascending ordinal ranks at their exact 10% quantiles, by comparing with each edge."""
    edges = " + ".join(f"(10 * (r - 1) > {k} * (n - 1))::INT" for k in range(1, 10))
    return f"""SELECT {keep}, 1 + {edges} AS decile FROM (SELECT *,
  count(*) OVER (PARTITION BY period_idx) AS n,
  row_number() OVER (PARTITION BY period_idx ORDER BY {score}, ticker) AS r FROM {source}) WHERE n >= {rows}"""


DECILE_MEASURES = {"ret": "return", "excess": "excess", "residual": "residual", "beta_24m": "beta"}
DECILE_AVGS = ", ".join(f'avg({c}) AS "{n}"' for c, n in DECILE_MEASURES.items())
DECILE_ROWS = """, m AS (SELECT * FROM panel WHERE momentum_6m IS NOT NULL AND residual IS NOT NULL)"""


def decile_rows(spark, sf):
    return panel(spark, sf).dropna(subset=["momentum_6m", "residual"])


DECILES = FEATURES + DECILE_ROWS + f""",
dec AS (SELECT period_idx, decile, count(*) AS stocks, {DECILE_AVGS}
  FROM ({decile_sql('m', 'momentum_6m', 50)}) GROUP BY 1, 2)"""


@query(
    "decile_table",
    "period_idx:i decile:i stocks:i return:d excess:d residual:d beta:d",
    DECILES,
    "SELECT * FROM dec",
)
def decile_table(spark, sf):
    return CS.decile_table(decile_rows(spark, sf), "momentum_6m", DECILE_MEASURES, 50)


def hac_sql(source: str, key: str, value: str, name: str, lags: int = 3) -> str:
    """Robust t of the mean, with every autocovariance from a self-join on the lagged place."""
    ks = ", ".join(f"({k})" for k in range(1, lags + 1))
    return f"""SELECT {key}, CASE WHEN n < 2 OR v <= 0 THEN 0 ELSE mean / sqrt(v) END AS {name} FROM (
  SELECT {key}, any_value(n) AS n, any_value(mean) AS mean,
  (any_value(g0) + coalesce(sum(2 * (1 - k / {lags + 1}.0::DOUBLE) * g), 0)) / any_value(n) AS v FROM (
    SELECT a.{key}, ks.k, a.n, a.mean, a.g0, sum(a.x * b.x) / a.n AS g
    FROM (SELECT *, sum(x * x) OVER (PARTITION BY {key}) / n AS g0 FROM (SELECT {key}, {value} - avg({value}) OVER (PARTITION BY {key}) AS x,
      avg({value}) OVER (PARTITION BY {key}) AS mean, count(*) OVER (PARTITION BY {key}) AS n,
      row_number() OVER (PARTITION BY {key} ORDER BY period_idx) AS i FROM {source} WHERE {value} IS NOT NULL)) a
    CROSS JOIN (VALUES {ks}) ks(k)
    LEFT JOIN (SELECT {key}, {value} - avg({value}) OVER (PARTITION BY {key}) AS x,
      row_number() OVER (PARTITION BY {key} ORDER BY period_idx) AS i FROM {source} WHERE {value} IS NOT NULL) b
      ON b.{key} = a.{key} AND b.i = a.i - ks.k
    GROUP BY 1, 2, 3, 4, 5) GROUP BY 1)"""


@query(
    "decile_summary",
    """decile:i months:i positive_rate:d average_return:d average_excess:d average_residual:d average_beta:d
  residual_hac_t:d""",
    DECILES,
    f"""SELECT * FROM (SELECT decile, count(*) AS months, avg((residual > 0)::INT) AS positive_rate,
  avg("return") AS average_return, avg(excess) AS average_excess, avg(residual) AS average_residual,
  avg(beta) AS average_beta FROM dec GROUP BY 1)
  JOIN ({hac_sql('dec', 'decile', 'residual', 'residual_hac_t')}) USING (decile)""",
)
def decile_summary(spark, sf):
    table = CS.decile_table(decile_rows(spark, sf), "momentum_6m", DECILE_MEASURES, 50)
    averages = {v: f"average_{v}" for v in ("return", "excess", "residual", "beta")}
    return EV.decile_summary(materialize(table, "deciles"), "residual", averages)


@query(
    "decile_subperiods",
    "span:s decile:i months:i average_residual:d average_excess:d average_beta:d",
    DECILES + """,
dspans AS (SELECT *, 'all' AS span FROM dec UNION ALL
  SELECT *, CASE WHEN period_idx // 12 <= 1999 THEN 'to 1999' ELSE 'from 2000' END FROM dec UNION ALL
  SELECT *, concat('year ', period_idx // 12) FROM dec)""",
    """SELECT span, decile, count(*) AS months, avg(residual) AS average_residual,
  avg(excess) AS average_excess, avg(beta) AS average_beta FROM dspans GROUP BY 1, 2""",
)
def decile_subperiods(spark, sf):
    table = CS.decile_table(decile_rows(spark, sf), "momentum_6m", DECILE_MEASURES, 50)
    averages = {v: f"average_{v}" for v in ("excess", "residual", "beta")}
    return EV.decile_subperiods(table, averages, 1999)


@query(
    "hac_t",
    "ticker:s ret_hac_t:d residual_hac_t:d",
    FEATURES,
    f"""SELECT ticker, r.ret_hac_t, coalesce(s.residual_hac_t, 0) AS residual_hac_t
  FROM ({hac_sql('feat', 'ticker', 'ret', 'ret_hac_t')}) r
  LEFT JOIN ({hac_sql('feat', 'ticker', 'residual', 'residual_hac_t')}) s USING (ticker)""",
)
def hac_t(spark, sf):
    rows = FE.with_beta(FE.joined_months(prices(spark, sf), benchmark(spark, sf)))
    return hac(rows, ["ticker"], "period_idx", ["ret", "residual"])


# Two-feature rolling ridge in closed form.
X1, X2 = PAIR
PREDS = BN + f""",
train AS (SELECT t.period_idx, count(*) AS n, avg(p.{X1}) AS m1, avg(p.{X2}) AS m2,
  avg(p.beta_neutral_target) AS my, stddev_pop(p.{X1}) AS s1, stddev_pop(p.{X2}) AS s2,
  corr(p.{X1}, p.{X2}) AS r12, covar_pop(p.{X1}, p.beta_neutral_target) AS c1,
  covar_pop(p.{X2}, p.beta_neutral_target) AS c2
  FROM (SELECT DISTINCT period_idx FROM bn WHERE period_idx BETWEEN {START} AND {END}) t
  JOIN bn p ON p.period_idx BETWEEN t.period_idx - {TRAIN_MONTHS} AND t.period_idx - 1
  WHERE p.{X1} IS NOT NULL AND p.{X2} IS NOT NULL AND p.beta_neutral_target IS NOT NULL GROUP BY 1),
fit AS (SELECT period_idx, n, w1 / s1 AS b1, w2 / s2 AS b2, my - w1 / s1 * m1 - w2 / s2 * m2 AS b0 FROM (
  SELECT *, ((n + 10) * n * c1 / s1 - n * r12 * n * c2 / s2) / ((n + 10) * (n + 10) - n * r12 * n * r12) AS w1,
  ((n + 10) * n * c2 / s2 - n * r12 * n * c1 / s1) / ((n + 10) * (n + 10) - n * r12 * n * r12) AS w2
  FROM (SELECT * REPLACE (n::DOUBLE AS n) FROM train))),
scored AS (SELECT b.*, f.n AS n_train, f.b0 + f.b1 * {X1} + f.b2 * {X2} AS prediction
  FROM bn b JOIN fit f USING (period_idx) WHERE {X1} IS NOT NULL AND {X2} IS NOT NULL),
preds AS (SELECT *, 1 - (rank - 1) / cnt AS percentile FROM (SELECT *,
  row_number() OVER (PARTITION BY period_idx ORDER BY prediction DESC, ticker) AS rank,
  count(*) OVER (PARTITION BY period_idx) AS cnt FROM scored) WHERE cnt >= 30)"""


def predictions(spark, sf):
    rows = panel(spark, sf)
    return materialize(
        WF.run_walk_forward(rows, MODEL, *span(rows), training_months=TRAIN_MONTHS, alpha=10.0), "ranked"
    )


@query(
    "walk_forward_ridge",
    f"{ID} n_train:i prediction:d rank:i percentile:d",
    PREDS,
    "SELECT * FROM preds",
)
def walk_forward_ridge(spark, sf):
    return predictions(spark, sf)


@query(
    "ridge_fit",
    "n_train:i intercept:d coef_1:d coef_2:d",
    FEATURES + f""",
t AS (SELECT count(*)::DOUBLE AS n, avg({X1}) AS m1, avg({X2}) AS m2, avg(residual) AS my,
  stddev_pop({X1}) AS s1, stddev_pop({X2}) AS s2, corr({X1}, {X2}) AS r, covar_pop({X1}, residual) AS c1,
  covar_pop({X2}, residual) AS c2 FROM panel
  WHERE {X1} IS NOT NULL AND {X2} IS NOT NULL AND residual IS NOT NULL),
w AS (SELECT *, ((n + 10) * n * c1 / s1 - n * r * n * c2 / s2) / ((n + 10) * (n + 10) - n * r * n * r) / s1 AS b1,
  ((n + 10) * n * c2 / s2 - n * r * n * c1 / s1) / ((n + 10) * (n + 10) - n * r * n * r) / s2 AS b2 FROM t)""",
    "SELECT n AS n_train, my - b1 * m1 - b2 * m2 AS intercept, b1 AS coef_1, b2 AS coef_2 FROM w",
)
def ridge_fit(spark, sf):
    fit = R.ridge_fit(panel(spark, sf), PAIR, "residual")
    return fit.select(
        "n_train", "intercept", F.col("coef")[0].alias("coef_1"), F.col("coef")[1].alias("coef_2")
    )


@query(
    "latest_ranking",
    "ticker:s rank:i prediction:d percentile:d beta_24m:d ret:d",
    PREDS,
    f"""SELECT * EXCLUDE (percentile), {pct_sql('prediction', 'period_idx')} AS percentile FROM preds
  WHERE period_idx = (SELECT max(period_idx) FROM preds)""",
)
def latest_ranking(spark, sf):
    return CS.latest_ranking(predictions(spark, sf).drop("rank", "percentile"))


QUALITY = PREDS + """,
q AS (SELECT * EXCLUDE (rank), row_number() OVER (PARTITION BY period_idx ORDER BY quality DESC, ticker) AS rank
  FROM (SELECT *, prediction / (idio_volatility_6m + 0.02) AS quality FROM preds
    WHERE idio_volatility_6m IS NOT NULL))"""


def quality(spark, sf):
    rows = predictions(spark, sf).drop("rank").dropna(subset=["idio_volatility_6m"])
    return materialize(R.alpha_quality(rows), "quality")


@query("alpha_quality", f"{ID} quality:d rank:i", QUALITY, "SELECT * FROM q")
def alpha_quality(spark, sf):
    return quality(spark, sf)


MONTHLY_SPEC = """period_idx:i universe_size:i ic:d prediction_beta_corr:d benchmark_return:d top_return:d
  top_excess:d top_residual:d ex_bottom_return:d ex_bottom_excess:d ex_bottom_residual:d bottom_return:d
  bottom_residual:d long_short_return:d long_short_residual:d"""
MONTHLY = PREDS + f""",
v AS (SELECT * FROM preds WHERE beta_neutral_target IS NOT NULL AND beta_neutral_return IS NOT NULL),
monthly AS (SELECT s.* EXCLUDE (ex_bottom_residual), other AS ex_bottom_residual, ic, prediction_beta_corr,
  benchmark_return, top_return - benchmark_return AS top_excess,
  ex_bottom_return - benchmark_return AS ex_bottom_excess
  FROM ({spread_sql('v', 'prediction', {'ret': 'return', 'beta_neutral_return': 'residual'})}) s
  JOIN (SELECT period_idx, ex_bottom_x AS other FROM ({spread_sql('v', 'prediction', {'residual': 'x'})})) USING (period_idx)
  JOIN ({spearman_sql('prediction', 'beta_neutral_target', 'v')}) USING (period_idx)
  JOIN ({spearman_sql('prediction', 'beta_24m', 'preds', 'prediction_beta_corr')}) USING (period_idx)
  JOIN (SELECT period_idx, max(bench_ret) AS benchmark_return FROM v GROUP BY 1) USING (period_idx))"""


def monthly(spark, sf):
    found = EV.monthly_diagnostics(
        predictions(spark, sf), "beta_neutral_target", "beta_neutral_return", "residual",
        required=("beta_neutral_return",),
    )
    return materialize(found, "monthly")


@query("monthly_diagnostics", MONTHLY_SPEC, MONTHLY, "SELECT * FROM monthly")
def monthly_diagnostics(spark, sf):
    return monthly(spark, sf)


def t_sql(v: str) -> str:
    return f"""CASE WHEN count({v}) < 2 OR stddev_samp({v}) = 0 THEN 0
  ELSE avg({v}) / (stddev_samp({v}) / sqrt(count({v}))) END"""


def or_zero(aggregate: str) -> str:
    return f"CASE WHEN count(*) = 0 THEN 0 ELSE {aggregate} END"


SUMMARY_MEANS = [
    "top_return", "top_excess", "top_residual", "ex_bottom_return", "ex_bottom_excess",
    "ex_bottom_residual", "bottom_residual", "long_short_return", "long_short_residual",
]


@query(
    "version_summary",
    "months:i average_ic:d median_ic:d positive_ic_rate:d ic_t:d average_prediction_beta_corr:d "
    + "long_short_t:d long_short_residual_t:d " + " ".join(f"{c}:d" for c in SUMMARY_MEANS),
    MONTHLY,
    f"""SELECT count(*) AS months, avg(ic) AS average_ic, median(ic) AS median_ic,
  avg((ic > 0)::INT) AS positive_ic_rate, {t_sql('ic')} AS ic_t,
  avg(prediction_beta_corr) AS average_prediction_beta_corr,
  {t_sql('long_short_return')} AS long_short_t, {t_sql('long_short_residual')} AS long_short_residual_t,
  {', '.join(f'avg(m.{c}) AS {c}' for c in SUMMARY_MEANS)} FROM monthly m""",
)
def version_summary(spark, sf):
    return EV.summarize_months(monthly(spark, sf))


SPANS = MONTHLY + """,
spans AS (SELECT *, 'all' AS span FROM monthly UNION ALL
  SELECT *, CASE WHEN period_idx // 12 <= 2000 THEN 'to 2000' ELSE 'from 2001' END FROM monthly UNION ALL
  SELECT *, concat('year ', period_idx // 12) FROM monthly)"""


@query(
    "subperiod_robustness",
    """span:s months:i average_ic:d positive_ic_rate:d average_long_short:d positive_long_short_rate:d
  average_beta_corr:d ic_hac_t:d long_short_residual_hac_t:d""",
    SPANS,
    f"""SELECT * FROM (SELECT span, count(*) AS months, avg(ic) AS average_ic,
  avg((ic > 0)::INT) AS positive_ic_rate, avg(long_short_residual) AS average_long_short,
  avg((long_short_residual > 0)::INT) AS positive_long_short_rate,
  avg(prediction_beta_corr) AS average_beta_corr FROM spans GROUP BY 1)
  JOIN ({hac_sql('spans', 'span', 'ic', 'ic_hac_t')}) USING (span)
  JOIN ({hac_sql('spans', 'span', 'long_short_residual', 'long_short_residual_hac_t')}) USING (span)""",
)
def subperiod_robustness(spark, sf):
    return EV.subperiod_robustness(monthly(spark, sf), 2000)


SIGNALS = QUALITY + f""",
qv AS (SELECT * FROM q WHERE prediction IS NOT NULL AND quality IS NOT NULL AND residual IS NOT NULL
  AND excess IS NOT NULL QUALIFY count(*) OVER (PARTITION BY period_idx) >= 20),
sig AS (SELECT * FROM ({spread_sql('qv', 'prediction', {'residual': 'residual', 'excess': 'excess'})})
  JOIN ({spearman_sql('prediction', 'residual', 'qv', 'prediction_ic')}) USING (period_idx)
  JOIN ({spearman_sql('quality', 'residual', 'qv', 'quality_ic')}) USING (period_idx))"""


@query(
    "signal_diagnostics",
    spread_spec(["residual", "excess"]) + " prediction_ic:d quality_ic:d",
    SIGNALS,
    "SELECT * FROM sig",
)
def signal_diagnostics(spark, sf):
    return EV.signal_diagnostics(quality(spark, sf))


@query(
    "signal_summary",
    """months:i average_ic:d median_ic:d positive_ic_rate:d ic_t:d average_spread:d median_spread:d
  positive_spread_rate:d spread_t:d average_excess_spread:d average_quality_ic:d median_quality_ic:d
  positive_quality_ic_rate:d average_top_residual:d average_bottom_residual:d average_top_excess:d
  prediction_ic_hac_t:d quality_ic_hac_t:d spread_hac_t:d""",
    SIGNALS + ", one AS (SELECT *, 0 AS grp FROM sig)",
    f"""SELECT count(*) AS months, {or_zero('avg(prediction_ic)')} AS average_ic,
  {or_zero('median(prediction_ic)')} AS median_ic,
  {or_zero('avg((prediction_ic > 0)::INT)')} AS positive_ic_rate, {t_sql('prediction_ic')} AS ic_t,
  {or_zero('avg(long_short_residual)')} AS average_spread,
  {or_zero('median(long_short_residual)')} AS median_spread,
  {or_zero('avg((long_short_residual > 0)::INT)')} AS positive_spread_rate,
  {t_sql('long_short_residual')} AS spread_t,
  {or_zero('avg(long_short_excess)')} AS average_excess_spread, avg(quality_ic) AS average_quality_ic,
  median(quality_ic) AS median_quality_ic, avg((quality_ic > 0)::INT) AS positive_quality_ic_rate,
  avg(top_residual) AS average_top_residual, avg(bottom_residual) AS average_bottom_residual,
  avg(top_excess) AS average_top_excess,
  (SELECT t FROM ({hac_sql("one", "grp", 'prediction_ic', 't')})) AS prediction_ic_hac_t,
  (SELECT t FROM ({hac_sql("one", "grp", 'quality_ic', 't')})) AS quality_ic_hac_t,
  (SELECT t FROM ({hac_sql("one", "grp", 'long_short_residual', 't')})) AS spread_hac_t FROM sig""",
)
def signal_summary(spark, sf):
    return EV.summarize_signals(materialize(EV.signal_diagnostics(quality(spark, sf)), "signals"))


TOP = QUALITY + """,
topn AS (SELECT *, portfolio_return - benchmark_return AS excess_return,
  portfolio_return - benchmark_return > 0 AS beat_benchmark, portfolio_return > 0 AS positive_month FROM (
  SELECT period_idx, count(*) AS stocks, avg(ret) AS portfolio_return, max(bench_ret) AS benchmark_return,
  avg(beta_24m) AS portfolio_beta, avg(residual) AS residual_alpha FROM q WHERE rank <= 10 GROUP BY 1))"""


@query(
    "top_portfolio",
    """period_idx:i stocks:i portfolio_return:d benchmark_return:d excess_return:d beat_benchmark:b
  positive_month:b portfolio_beta:d residual_alpha:d""",
    TOP,
    "SELECT * FROM topn",
)
def top_portfolio(spark, sf):
    return EV.top_portfolio(quality(spark, sf), 10)


@query(
    "top_portfolio_summary",
    """months:i positive_month_rate:d beat_rate:d average_return:d median_return:d average_excess:d
  median_excess:d excess_volatility:d worst_month:d best_month:d average_residual_alpha:d
  median_residual_alpha:d positive_alpha_rate:d average_beta:d""",
    TOP,
    """SELECT count(*) AS months, avg(positive_month::INT) AS positive_month_rate,
  avg(beat_benchmark::INT) AS beat_rate, avg(portfolio_return) AS average_return,
  median(portfolio_return) AS median_return, avg(excess_return) AS average_excess,
  median(excess_return) AS median_excess, stddev_samp(excess_return) AS excess_volatility,
  min(portfolio_return) AS worst_month, max(portfolio_return) AS best_month,
  avg(residual_alpha) AS average_residual_alpha, median(residual_alpha) AS median_residual_alpha,
  avg((residual_alpha > 0)::INT) AS positive_alpha_rate, avg(portfolio_beta) AS average_beta FROM topn""",
)
def top_portfolio_summary(spark, sf):
    return EV.summarize_top_portfolio(EV.top_portfolio(quality(spark, sf), 10))


RECHECK = PREDS + ",\n" + neutral_sql("preds", "rc", "ret", "true_neutral", None, 50)


RECHECK_SPEC = """period_idx:i ic:d stored_target_ic:d prediction_beta_corr:d top_neutral:d bottom_neutral:d
  long_short_neutral:d"""
RECHECK_SQL = f"""SELECT *, top_neutral - bottom_neutral AS long_short_neutral
  FROM ({spearman_sql('prediction', 'true_neutral', 'rc')})
  JOIN ({spearman_sql('prediction', 'beta_neutral_target', 'rc', 'stored_target_ic')}) USING (period_idx)
  JOIN ({spearman_sql('prediction', 'beta_24m', 'rc', 'prediction_beta_corr')}) USING (period_idx)
  JOIN (SELECT period_idx, avg(true_neutral) FILTER (WHERE decile = 10) AS top_neutral,
    avg(true_neutral) FILTER (WHERE decile = 1) AS bottom_neutral
    FROM ({decile_sql('rc', 'prediction', 50)}) GROUP BY 1) USING (period_idx)"""


@query("recheck_models", RECHECK_SPEC, RECHECK, RECHECK_SQL)
def recheck_models(spark, sf):
    return EV.recheck_model(predictions(spark, sf), 50)


NEUTRAL = PREDS + ",\n" + neutral_sql("preds", "np", "prediction", "neutral_prediction", None, 50)


@query(
    "beta_neutral_prediction",
    f"{ID} prediction:d neutral_prediction:d",
    NEUTRAL,
    "SELECT * FROM np",
)
def beta_neutral_prediction(spark, sf):
    return CS.beta_neutral_prediction(predictions(spark, sf), min_rows=50)


@query(
    "raw_vs_neutral_ic",
    """period_idx:i raw_residual_ic:d neutral_residual_ic:d raw_excess_ic:d neutral_excess_ic:d
  raw_beta_corr:d neutral_beta_corr:d""",
    NEUTRAL,
    "SELECT * FROM "
    + " JOIN ".join(
        f"({spearman_sql(score, against, 'np', f'{name}_{label}')})"
        + ("" if i == 0 else " USING (period_idx)")
        for i, (name, score, label, against) in enumerate(
            (n, s, label, a)
            for label, a in (("residual_ic", "residual"), ("excess_ic", "excess"), ("beta_corr", "beta_24m"))
            for n, s in (("raw", "prediction"), ("neutral", "neutral_prediction"))
        )
    ),
)
def raw_vs_neutral_ic(spark, sf):
    return EV.raw_vs_neutral(predictions(spark, sf), 50)


@query(
    "neutral_deciles",
    "period_idx:i decile:i stocks:i return:d excess:d residual:d beta:d",
    NEUTRAL,
    f"""SELECT period_idx, decile, count(*) AS stocks, {DECILE_AVGS}
  FROM ({decile_sql('np', 'neutral_prediction', 50)}) GROUP BY 1, 2""",
)
def neutral_deciles(spark, sf):
    return EV.neutral_deciles(predictions(spark, sf), 50)


def model_panel(spark, sf):
    rows = build_panel_with_sectors(
        prices(spark, sf), benchmark(spark, sf), sector_prices(spark, sf), SECTOR_ORDER, 2
    )
    return materialize(rows, "model_panel")


# Portfolios on the two-feature predictions.
WEIGHT_SPEC = f"strategy:s {ID} weight:d ret:d"
BASE = PREDS + f""",
el AS (SELECT *, {pct_sql('prediction', 'period_idx')} AS pct FROM preds
  WHERE ret IS NOT NULL AND bench_ret IS NOT NULL AND beta_24m IS NOT NULL
  QUALIFY count(*) OVER (PARTITION BY period_idx) >= 50),
tilt AS (SELECT 'rank_tilt' AS strategy, period_idx, ticker,
  (pct - 0.1) / sum(pct - 0.1) OVER (PARTITION BY period_idx) AS weight, ret, beta_24m, bench_ret
  FROM el WHERE pct > 0.1),
bucket AS (SELECT strategy, period_idx, ticker, 1.0 / count(*) OVER (PARTITION BY strategy, period_idx) AS weight,
  ret, beta_24m, bench_ret FROM el JOIN (VALUES ('top_decile', 0.9), ('top_quintile', 0.8),
  ('ex_bottom_quintile', 0.2)) s(strategy, above) ON pct > above::DOUBLE),
wts AS (SELECT * FROM tilt UNION ALL SELECT * FROM bucket),
drift AS (SELECT *, CASE WHEN sum(weight * (1 + ret)) OVER (PARTITION BY strategy, period_idx) > 0
  THEN weight * (1 + ret) / sum(weight * (1 + ret)) OVER (PARTITION BY strategy, period_idx)
  ELSE weight END AS end_weight FROM wts),
seqs AS (SELECT strategy, period_idx, row_number() OVER (PARTITION BY strategy ORDER BY period_idx) AS i
  FROM (SELECT DISTINCT strategy, period_idx FROM wts)),
turn AS (SELECT s.strategy, s.period_idx, CASE WHEN s.i = 1 THEN 1.0 ELSE (
  SELECT sum(abs(coalesce(a.weight, 0) - coalesce(b.end_weight, 0))) FROM
    (SELECT * FROM drift WHERE strategy = s.strategy AND period_idx = s.period_idx) a FULL JOIN
    (SELECT d.* FROM drift d JOIN seqs q ON q.strategy = d.strategy AND q.period_idx = d.period_idx
      WHERE q.strategy = s.strategy AND q.i = s.i - 1) b USING (ticker)) END AS turnover FROM seqs s),
pm AS (SELECT *, gross_return - trading_cost AS net_return,
  gross_return - trading_cost - benchmark_return AS net_excess,
  gross_return - trading_cost > benchmark_return AS beat_benchmark FROM (
  SELECT strategy, period_idx, sum(weight * ret) AS gross_return, max(bench_ret) AS benchmark_return,
  sum(weight * beta_24m) AS estimated_beta, count(*) AS holdings, 1 / sum(weight * weight) AS effective_holdings,
  max(weight) AS max_weight, any_value(turnover) AS turnover, any_value(turnover) * 10 / 10000.0 AS trading_cost
  FROM wts JOIN turn USING (strategy, period_idx) GROUP BY 1, 2))"""


def eligible(spark, sf):
    return materialize(PF.eligible(predictions(spark, sf), 50), "eligible")


def weights(spark, sf):
    rows = eligible(spark, sf)
    return materialize(PF.rank_tilt_weights(rows).unionByName(PF.bucket_weights(rows)), "weights")


@query("rank_tilt_weights", WEIGHT_SPEC, BASE, "SELECT * FROM tilt")
def rank_tilt_weights(spark, sf):
    return PF.rank_tilt_weights(eligible(spark, sf))


@query("bucket_weights", WEIGHT_SPEC, BASE, "SELECT * FROM bucket")
def bucket_weights(spark, sf):
    return PF.bucket_weights(eligible(spark, sf))


# The nearest capped weights, by bisection of both multipliers of the dual: for a slope the level at
# which the weights sum to 1, then the slope at which they have the wanted beta.
INNER, OUTER = 60, 60
PROJECTION = BASE + f""",
ks AS (SELECT *, count(*) OVER p AS n, weight / sum(weight) OVER p AS base, (beta_24m - avg(beta_24m) OVER p)
  / coalesce(nullif(stddev_pop(beta_24m) OVER p, 0), 1) AS x, row_number() OVER (PARTITION BY period_idx ORDER BY beta_24m, ticker) AS lo,
  row_number() OVER (PARTITION BY period_idx ORDER BY beta_24m DESC, ticker) AS hi
  FROM tilt WINDOW p AS (PARTITION BY period_idx)),
kc AS MATERIALIZED (SELECT *, CASE WHEN n * 0.02 < 1 THEN 1.0::DOUBLE / n + 1e-6 ELSE 0.02::DOUBLE END AS cap FROM ks),
kr AS (SELECT period_idx, avg(beta_24m) AS centre, coalesce(nullif(stddev_pop(beta_24m), 0), 1) AS scale,
  max(base) + 1 AS reach, max(abs(x)) AS far,
  sum(greatest(0, least(cap, 1 - (lo - 1) * cap)) * beta_24m) AS least_beta,
  sum(greatest(0, least(cap, 1 - (hi - 1) * cap)) * beta_24m) AS most_beta FROM kc GROUP BY 1),
kg AS MATERIALIZED (SELECT period_idx, reach, far, (least(greatest(1.0, least_beta + (most_beta - least_beta) * 1e-7),
  most_beta - (most_beta - least_beta) * 1e-7) - centre) / scale AS goal FROM kr),
walk AS (WITH RECURSIVE r(period_idx, k, a0, a1, b0, b1) AS (
  SELECT period_idx, 0, -reach - 10 * far, reach + 10 * far, -10.0::DOUBLE, 10.0::DOUBLE FROM kg UNION ALL
  SELECT period_idx, k + 1, CASE WHEN last THEN -reach - 10 * far WHEN total < 1 THEN a ELSE a0 END,
    CASE WHEN last THEN reach + 10 * far WHEN total < 1 THEN a1 ELSE a END,
    CASE WHEN last AND tilt < goal THEN b ELSE b0 END, CASE WHEN last AND tilt >= goal THEN b ELSE b1 END FROM (
    SELECT period_idx, k, k % {INNER} = {INNER} - 1 AS last, any_value(a0) AS a0, any_value(a1) AS a1,
      any_value(b0) AS b0, any_value(b1) AS b1, any_value((a0 + a1) / 2) AS a, any_value((b0 + b1) / 2) AS b,
      any_value(reach) AS reach, any_value(far) AS far, any_value(goal) AS goal,
      sum(greatest(0, least(cap, base + (a0 + a1) / 2 + (b0 + b1) / 2 * x))) AS total,
      sum(x * greatest(0, least(cap, base + (a0 + a1) / 2 + (b0 + b1) / 2 * x))) AS tilt
    FROM r JOIN kc USING (period_idx) JOIN kg USING (period_idx) WHERE k < {INNER * (OUTER + 1) - 1} GROUP BY period_idx, k))
  SELECT period_idx, (a0 + a1) / 2 AS a, (b0 + b1) / 2 AS b FROM r WHERE k = {INNER * (OUTER + 1) - 1}),
kw AS (SELECT kc.*, greatest(0, least(cap, base + a + b * x)) AS w FROM kc JOIN walk USING (period_idx)),
proj AS (SELECT * EXCLUDE (strategy, weight), 'beta_target' AS strategy, w / sum(w) OVER (PARTITION BY period_idx) AS weight
  FROM kw)"""


@query("beta_target_weights", WEIGHT_SPEC, PROJECTION, "SELECT * FROM proj")
def beta_target_weights(spark, sf):
    return PF.beta_target_weights(PF.rank_tilt_weights(eligible(spark, sf)))


@query("drift_weights", f"{WEIGHT_SPEC} end_weight:d", BASE, "SELECT * FROM drift")
def drift_weights(spark, sf):
    return PF.end_weights(weights(spark, sf))


@query("gross_turnover", "strategy:s period_idx:i turnover:d", BASE, "SELECT * FROM turn")
def gross_turnover(spark, sf):
    return PF.gross_turnover(weights(spark, sf))


@query(
    "portfolio_monthly",
    """strategy:s period_idx:i gross_return:d net_return:d benchmark_return:d net_excess:d beat_benchmark:b
  estimated_beta:d turnover:d trading_cost:d holdings:i effective_holdings:d max_weight:d""",
    BASE,
    "SELECT * FROM pm",
)
def portfolio_monthly(spark, sf):
    return PF.portfolio_monthly(weights(spark, sf))


CAGR_SQL = """CASE WHEN product(1 + {c}) > 0 THEN pow(product(1 + {c}), 12.0 / count(*)) - 1 END"""
WEALTH = """(SELECT *, product(1 + net_return) OVER (PARTITION BY strategy ORDER BY period_idx) AS wealth FROM pm)"""
DRAWDOWN = f"""SELECT strategy, min(wealth / peak - 1) AS max_drawdown FROM (
  SELECT *, max(wealth) OVER (PARTITION BY strategy ORDER BY period_idx) AS peak FROM {WEALTH}) GROUP BY 1"""


@query(
    "cagr_and_drawdown",
    "strategy:s net_cagr:d benchmark_cagr:d max_drawdown:d",
    BASE,
    f"""SELECT * FROM (SELECT strategy, {CAGR_SQL.format(c='net_return')} AS net_cagr,
  {CAGR_SQL.format(c='benchmark_return')} AS benchmark_cagr FROM pm GROUP BY 1) JOIN ({DRAWDOWN}) USING (strategy)""",
)
def cagr_and_drawdown(spark, sf):
    months = materialize(PF.portfolio_monthly(weights(spark, sf)), "months")
    growth = months.groupBy("strategy").agg(
        PF.cagr("net_return").alias("net_cagr"), PF.cagr("benchmark_return").alias("benchmark_cagr")
    )
    return growth.join(PF.max_drawdown(months, "net_return", ["strategy"]), "strategy")


@query(
    "portfolio_summary",
    """strategy:s months:i net_cagr:d benchmark_cagr:d annual_volatility:d sharpe:d max_drawdown:d
  average_excess:d beat_rate:d average_beta:d realized_beta:d average_turnover:d average_cost:d
  average_holdings:d average_effective_holdings:d average_max_weight:d""",
    BASE,
    f"""SELECT * FROM (SELECT strategy, count(*) AS months, {CAGR_SQL.format(c='net_return')} AS net_cagr,
  {CAGR_SQL.format(c='benchmark_return')} AS benchmark_cagr,
  stddev_samp(net_return) * sqrt(12) AS annual_volatility,
  avg(net_return) * 12 / (stddev_samp(net_return) * sqrt(12)) AS sharpe, avg(net_excess) AS average_excess,
  avg(beat_benchmark::INT) AS beat_rate, avg(estimated_beta) AS average_beta,
  covar_samp(net_return, benchmark_return) / var_samp(benchmark_return) AS realized_beta,
  avg(turnover) AS average_turnover, avg(trading_cost) AS average_cost, avg(holdings) AS average_holdings,
  avg(effective_holdings) AS average_effective_holdings, avg(max_weight) AS average_max_weight
  FROM pm GROUP BY 1) JOIN ({DRAWDOWN}) USING (strategy)""",
)
def portfolio_summary(spark, sf):
    return PF.portfolio_summary(materialize(PF.portfolio_monthly(weights(spark, sf)), "months"))


INDEX = BASE + """,
held AS (SELECT * FROM (SELECT period_idx, ticker, prediction, ret, bench_ret, pct AS p FROM el)
  WHERE p > 0.9 AND period_idx // 12 = 2001)"""


@query(
    "wealth_index",
    """period_idx:i holdings:i portfolio_return:d benchmark_return:d excess_return:d portfolio_index:d
  benchmark_index:d""",
    INDEX,
    """SELECT *, portfolio_return - benchmark_return AS excess_return,
  100 * product(1 + portfolio_return) OVER (ORDER BY period_idx) AS portfolio_index,
  100 * product(1 + benchmark_return) OVER (ORDER BY period_idx) AS benchmark_index FROM (
  SELECT period_idx, count(*) AS holdings, avg(ret) AS portfolio_return, max(bench_ret) AS benchmark_return
  FROM held GROUP BY 1)""",
)
def wealth_index(spark, sf):
    return PF.wealth_index(eligible(spark, sf), 2001)[0]


@query(
    "wealth_holdings",
    f"{ID} rank:i prediction:d percentile:d ret:d",
    INDEX,
    """SELECT *, p AS percentile, row_number() OVER (PARTITION BY period_idx ORDER BY prediction DESC, ticker)
  AS rank FROM held""",
)
def wealth_holdings(spark, sf):
    return PF.wealth_index(eligible(spark, sf), 2001)[1]
