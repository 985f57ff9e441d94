"""Monthly panel features and sector-relative features."""

from __future__ import annotations

from checks.inputs import MONTHS, SECTORS, benchmark, prices, sector_prices
from checks.registry import query
from perennial.operators import features as FE
from perennial.operators import monthly as M
from perennial.operators import sectors as SE

SECTOR_ORDER = ("ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD")


def trail(agg: str, value: str, n: int, w: str = "ticker") -> str:
    frame = f"OVER (PARTITION BY {w} ORDER BY period_idx ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING)"
    return f"CASE WHEN count({value}) {frame} = {n} THEN {agg} {frame} END"


def momentum(value: str, n: int) -> str:
    return trail(f"product(1 + {value})", value, n) + " - 1"


def vol(value: str, n: int) -> str:
    return trail(f"stddev_samp({value})", value, n)


PAIR = "OVER (PARTITION BY ticker ORDER BY period_idx ROWS BETWEEN 24 PRECEDING AND 1 PRECEDING)"
SEASON = """OVER (PARTITION BY ticker, period_idx % 12 ORDER BY period_idx
  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"""
BETA = MONTHS + f""",
beta AS (SELECT *, ret - bench_ret AS excess, CASE WHEN count(ret + bench_ret) {PAIR} = 24
  THEN (avg(ret * bench_ret) {PAIR} - avg(ret) {PAIR} * avg(bench_ret) {PAIR})
    / var_pop(bench_ret) {PAIR} END AS beta_24m FROM jm),
resid AS (SELECT *, ret - beta_24m * bench_ret AS residual FROM beta)"""


def recent(value: str) -> str:
    lst = f"list_filter(list({value}) {SEASON}, lambda x: x IS NOT NULL)"
    return f"list_avg({lst}[-5:])"


FEATURES = BETA + f""",
feat AS (SELECT *, period_idx % 12 + 1 AS calendar_month,
  {momentum('ret', 3)} AS momentum_3m, {momentum('ret', 6)} AS momentum_6m,
  {momentum('ret', 12)} AS momentum_12m, {momentum('residual', 3)} AS residual_momentum_3m,
  {momentum('residual', 6)} AS residual_momentum_6m, {momentum('residual', 12)} AS residual_momentum_12m,
  {vol('residual', 6)} AS idio_volatility_6m, {vol('residual', 12)} AS idio_volatility_12m,
  {vol('ret', 6)} AS volatility_6m, {vol('ret', 12)} AS volatility_12m,
  {momentum('bench_ret', 3)} AS market_momentum_3m, {momentum('bench_ret', 6)} AS market_momentum_6m,
  {vol('bench_ret', 6)} AS market_volatility_6m,
  lag(ret) OVER (PARTITION BY ticker ORDER BY period_idx) AS last_month_return,
  lag(excess) OVER (PARTITION BY ticker ORDER BY period_idx) AS last_month_excess,
  count(excess) {SEASON} AS season_samples, avg(excess) {SEASON} AS season_mean,
  {recent('excess')} AS season_recent, median(excess) {SEASON} AS season_median,
  avg(CASE WHEN excess > 0 THEN 1.0 WHEN excess <= 0 THEN 0 END) {SEASON} AS season_beat_rate,
  quantile_cont(excess, 0.25) {SEASON} AS season_q25, avg(residual) {SEASON} AS residual_season_mean,
  {recent('residual')} AS residual_season_recent, median(residual) {SEASON} AS residual_season_median
  FROM resid),
panel AS (SELECT * FROM feat WHERE season_samples >= 2)"""
ID = "ticker:s period:t"
BASE_SPEC = f"{ID} ret:d bench_ret:d excess:d residual:d season_samples:i calendar_month:i"
FEATURE_SPEC = " ".join(f"{f}:d" for f in FE.FEATURES_V3)


def months(spark, sf):
    return M.joined_months(prices(spark, sf), benchmark(spark, sf))


@query(
    "market_beta",
    f"{ID} excess:d beta_24m:d residual:d",
    BETA,
    "SELECT * FROM resid",
)
def market_beta(spark, sf):
    return FE.with_beta(months(spark, sf))


ROLLING = [f for f in FE.FEATURES_V3 if "season" not in f]
SEASONAL = [f for f in FE.FEATURES_V3 if "season" in f]


@query("rolling_features", f"{ID} " + " ".join(f"{f}:d" for f in ROLLING), FEATURES, "SELECT * FROM feat")
def rolling_features(spark, sf):
    return FE.stock_features(prices(spark, sf), benchmark(spark, sf))


@query(
    "expanding_season_features",
    f"{ID} season_samples:i " + " ".join(f"{f}:d" for f in SEASONAL),
    FEATURES,
    "SELECT * FROM feat",
)
def expanding_season_features(spark, sf):
    return FE.stock_features(prices(spark, sf), benchmark(spark, sf))


@query("stock_features", f"{BASE_SPEC} {FEATURE_SPEC}", FEATURES, "SELECT * FROM feat")
def stock_features(spark, sf):
    return FE.stock_features(prices(spark, sf), benchmark(spark, sf))


@query("build_panel", f"{BASE_SPEC} {FEATURE_SPEC}", FEATURES, "SELECT * FROM panel")
def build_panel(spark, sf):
    return FE.build_panel(prices(spark, sf), benchmark(spark, sf), 2)


@query("sector_returns", "sector:s period_idx:i sector_ret:d", SECTORS, "SELECT * FROM sec")
def sector_returns(spark, sf):
    return SE.sector_returns(sector_prices(spark, sf))


CORR = """OVER (PARTITION BY ticker, sector ORDER BY period_idx ROWS BETWEEN 24 PRECEDING AND 1 PRECEDING)"""
SECTOR_CTES = MONTHS + "," + SECTORS + f""",
funds(sector, pref) AS (VALUES {', '.join(f"('{s}', {i})" for i, s in enumerate(SECTOR_ORDER))}),
pairs AS (SELECT ticker, period_idx, period, ret, sector, pref, sector_ret,
  CASE WHEN ret IS NOT NULL THEN sector_ret END AS x, CASE WHEN sector_ret IS NOT NULL THEN ret END AS y
  FROM jm CROSS JOIN funds LEFT JOIN sec USING (sector, period_idx)),
corrs AS (SELECT *, CASE WHEN count(x) {CORR} >= 12 THEN
  (avg(x * y) {CORR} - avg(x) {CORR} * avg(y) {CORR}) / nullif(stddev_pop(x) {CORR} * stddev_pop(y) {CORR}, 0)
  END AS corr FROM pairs),
best AS (SELECT * FROM corrs QUALIFY row_number() OVER (PARTITION BY ticker, period_idx
  ORDER BY corr DESC NULLS LAST, pref) = 1),
rel AS (SELECT ticker, period_idx, period, CASE WHEN corr IS NOT NULL THEN sector END AS selected_sector,
  corr AS sector_correlation, CASE WHEN corr IS NOT NULL THEN sector_ret END AS selected_sector_ret,
  CASE WHEN corr IS NOT NULL THEN ret - sector_ret END AS sector_relative FROM best),
secfeat AS (SELECT *, {momentum('sector_relative', 3)} AS sector_momentum_3m,
  {momentum('sector_relative', 6)} AS sector_momentum_6m,
  {momentum('sector_relative', 12)} AS sector_momentum_12m,
  {vol('sector_relative', 6)} AS sector_volatility_6m,
  {vol('sector_relative', 12)} AS sector_volatility_12m FROM rel)"""


@query(
    "dynamic_sector",
    "ticker:s period_idx:i selected_sector:s sector_correlation:d selected_sector_ret:d",
    SECTOR_CTES,
    "SELECT * FROM rel",
)
def dynamic_sector(spark, sf):
    return SE.dynamic_sector(
        months(spark, sf), SE.sector_returns(sector_prices(spark, sf)), SECTOR_ORDER
    )


SECTOR_SPEC = " ".join(f"{f}:d" for f in SE.SECTOR_FEATURES)


@query(
    "sector_features",
    f"ticker:s period_idx:i selected_sector:s sector_relative:d {SECTOR_SPEC}",
    SECTOR_CTES,
    "SELECT * FROM secfeat",
)
def sector_features(spark, sf):
    return SE.sector_features(
        months(spark, sf), SE.sector_returns(sector_prices(spark, sf)), SECTOR_ORDER
    )


@query(
    "build_panel_with_sectors",
    f"{BASE_SPEC} {FEATURE_SPEC} selected_sector:s {SECTOR_SPEC}",
    FEATURES + SECTOR_CTES.removeprefix(MONTHS),
    """SELECT p.*, s.selected_sector, s.sector_correlation, s.sector_momentum_3m, s.sector_momentum_6m,
  s.sector_momentum_12m, s.sector_volatility_6m, s.sector_volatility_12m
  FROM panel p LEFT JOIN secfeat s USING (ticker, period_idx)""",
)
def build_panel_with_sectors(spark, sf):
    return SE.build_panel_with_sectors(
        prices(spark, sf), benchmark(spark, sf), sector_prices(spark, sf), SECTOR_ORDER, 2
    )
