"""Month-end series, the yearly snapshot and its backtest."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.inputs import MONTHS, benchmark, prices
from checks.registry import query
from perennial.operators import monthly as M
from perennial.plans import snapshot as N

YEARS = (1999, 2000, 2001)
MONTH = 9
SELECTION = dict(
    top_n=10, min_samples=3, min_long_rank=0.5, min_recent_rank=0.3,
    min_momentum_rank=0.3, min_downside_rank=0.2,
)


@query(
    "monthly_returns",
    "ticker:s period:t period_idx:i date:t price:d ret:d",
    MONTHS,
    "SELECT * FROM mr",
)
def monthly_returns(spark, sf):
    return M.monthly_returns(prices(spark, sf))


@query(
    "benchmark_month_join",
    "ticker:s period:t ret:d bench_ret:d",
    MONTHS,
    "SELECT * FROM jm",
)
def benchmark_month_join(spark, sf):
    return M.joined_months(prices(spark, sf), benchmark(spark, sf))


YEARS_SQL = ", ".join(f"({y})" for y in YEARS)
SEASON = MONTHS + f""",
yrs(test_year) AS (VALUES {YEARS_SQL}),
season_rows AS (SELECT y.test_year, j.ticker, j.ret, j.ret - j.bench_ret AS excess,
  row_number() OVER (PARTITION BY y.test_year, j.ticker ORDER BY j.period_idx DESC) AS back
  FROM jm j JOIN yrs y ON j.period_idx < y.test_year * 12 + {MONTH - 1}
  WHERE month(j.period) = {MONTH} AND j.ret IS NOT NULL AND j.bench_ret IS NOT NULL),
season AS (SELECT test_year, ticker, count(*) AS season_samples, avg(excess) AS season_mean_excess,
  median(excess) AS season_median_excess, avg((ret > 0)::INT) AS season_win_rate,
  avg((excess > 0)::INT) AS season_beat_rate, quantile_cont(excess, 0.25) AS season_q25_excess,
  CASE WHEN count(*) > 1 THEN stddev_samp(excess) ELSE 0 END AS season_std,
  avg(excess) FILTER (WHERE back <= 3) AS recent_mean_excess,
  median(excess) FILTER (WHERE back <= 3) AS recent_median_excess
  FROM season_rows WHERE back <= 15 GROUP BY 1, 2),
before AS (SELECT y.test_year, p.ticker, p.adj_close,
  row_number() OVER (PARTITION BY y.test_year, p.ticker ORDER BY p.date DESC) AS back
  FROM px p JOIN yrs y ON p.date < make_date(y.test_year, {MONTH}, 1)),
mom AS (SELECT test_year, ticker, max(CASE WHEN back = 22 THEN adj_close END)
  / max(CASE WHEN back = 253 THEN adj_close END) - 1 AS momentum_12_1 FROM before GROUP BY 1, 2)"""


@query(
    "same_month_seasonality",
    """test_year:i ticker:s season_samples:i season_mean_excess:d season_median_excess:d season_win_rate:d
  season_beat_rate:d season_q25_excess:d season_std:d recent_mean_excess:d recent_median_excess:d""",
    SEASON,
    "SELECT * FROM season",
)
def same_month_seasonality(spark, sf):
    months = M.joined_months(prices(spark, sf), benchmark(spark, sf))
    return M.same_month_seasonality(months, MONTH, YEARS, 15, 3)


@query(
    "momentum_12_1", "test_year:i ticker:s momentum_12_1:d", SEASON, "SELECT * FROM mom"
)
def momentum_12_1(spark, sf):
    return M.session_momentum(prices(spark, sf), MONTH, YEARS)


def pct_sql(value: str, group: str) -> str:
    """Percentile rank with averaged ties, by counting smaller and equal values."""
    return f"""((rank() OVER (PARTITION BY {group} ORDER BY {value})
  + (count(*) OVER (PARTITION BY {group}, {value}) - 1) / 2.0) / count(*) OVER (PARTITION BY {group}))"""


SNAPSHOT = SEASON + f""",
snap0 AS (SELECT *, {pct_sql('season_mean_excess', 'test_year')} AS long_seasonal_rank,
  {pct_sql('recent_mean_excess', 'test_year')} AS recent_seasonal_rank,
  {pct_sql('momentum_12_1', 'test_year')} AS momentum_rank,
  {pct_sql('season_q25_excess', 'test_year')} AS downside_rank
  FROM season JOIN mom USING (test_year, ticker) WHERE momentum_12_1 IS NOT NULL),
snap AS (SELECT *, least(long_seasonal_rank, recent_seasonal_rank) AS persistent_rank,
  pow(greatest(least(long_seasonal_rank, recent_seasonal_rank), 1e-6) * greatest(momentum_rank, 1e-6)
    * greatest(downside_rank, 1e-6), 1 / 3.0::DOUBLE) AS edge_score FROM snap0),
picked AS (SELECT *, row_number() OVER (PARTITION BY test_year
  ORDER BY round(edge_score, 12) DESC, persistent_rank DESC, momentum_rank DESC, ticker) AS rank FROM snap
  WHERE season_samples >= 3 AND long_seasonal_rank >= 0.5 AND recent_seasonal_rank >= 0.3
    AND momentum_rank >= 0.3 AND downside_rank >= 0.2 QUALIFY rank <= 10),
trades AS (SELECT p.test_year, p.ticker, p.rank AS prior_rank, p.edge_score, p.long_seasonal_rank,
  p.recent_seasonal_rank, p.persistent_rank, p.momentum_rank, p.downside_rank,
  p.season_mean_excess AS historical_mean_excess, p.recent_mean_excess AS historical_recent_excess,
  p.season_q25_excess AS historical_q25_excess, j.ret AS realized_return,
  j.bench_ret AS benchmark_return, j.ret - j.bench_ret AS realized_excess_return,
  j.ret > 0 AS realized_win, j.ret - j.bench_ret > 0 AS beat_benchmark
  FROM picked p JOIN jm j ON j.ticker = p.ticker AND j.period_idx = p.test_year * 12 + {MONTH - 1}
  WHERE j.ret IS NOT NULL AND j.bench_ret IS NOT NULL)"""
RANK_SPEC = """long_seasonal_rank:d recent_seasonal_rank:d momentum_rank:d downside_rank:d
  persistent_rank:d edge_score:d"""


def snapshot(spark, sf):
    return M.cross_section(prices(spark, sf), benchmark(spark, sf), MONTH, YEARS, 15, 3)


@query(
    "cross_section",
    f"test_year:i ticker:s season_samples:i momentum_12_1:d {RANK_SPEC}",
    SNAPSHOT,
    "SELECT * FROM snap",
)
def cross_section(spark, sf):
    return snapshot(spark, sf)


@query(
    "select_candidates",
    f"test_year:i rank:i ticker:s {RANK_SPEC}",
    SNAPSHOT,
    "SELECT * FROM picked",
)
def select_candidates(spark, sf):
    return M.select_candidates(snapshot(spark, sf), **SELECTION)


@query(
    "month_return_lookup",
    "ticker:s ret:d",
    MONTHS,
    "SELECT ticker, ret FROM mr WHERE period_idx = 2000 * 12 + 8 AND ret IS NOT NULL",
)
def month_return_lookup(spark, sf):
    return M.month_return(prices(spark, sf), 2000, 9)


TRADE_SPEC = """test_year:i ticker:s prior_rank:i edge_score:d long_seasonal_rank:d recent_seasonal_rank:d
  persistent_rank:d momentum_rank:d downside_rank:d historical_mean_excess:d historical_recent_excess:d
  historical_q25_excess:d realized_return:d benchmark_return:d realized_excess_return:d realized_win:b
  beat_benchmark:b"""


def trades(spark, sf):
    return N.backtest_snapshot(
        prices(spark, sf), benchmark(spark, sf), YEARS, MONTH, 15, 3, **SELECTION
    )


@query("snapshot_backtest", TRADE_SPEC, SNAPSHOT, "SELECT * FROM trades")
def snapshot_backtest(spark, sf):
    return trades(spark, sf)


@query(
    "snapshot_summary",
    """trades:i win_rate:d beat_rate:d average_return:d median_return:d average_excess_return:d
  median_excess_return:d worst_return:d best_return:d return_std:d excess_std:d""",
    SNAPSHOT,
    """SELECT count(*) AS trades, avg(realized_win::INT) AS win_rate, avg(beat_benchmark::INT) AS beat_rate,
  avg(realized_return) AS average_return, median(realized_return) AS median_return,
  avg(realized_excess_return) AS average_excess_return,
  median(realized_excess_return) AS median_excess_return, min(realized_return) AS worst_return,
  max(realized_return) AS best_return, coalesce(stddev_samp(realized_return), 0) AS return_std,
  coalesce(stddev_samp(realized_excess_return), 0) AS excess_std FROM trades""",
)
def snapshot_summary(spark, sf):
    return N.summarize_trades(trades(spark, sf))


@query(
    "snapshot_by_year",
    """test_year:i stocks:i portfolio_return:d benchmark_return:d portfolio_excess:d win_rate:d
  beat_rate:d""",
    SNAPSHOT,
    """SELECT test_year, count(*) AS stocks, avg(realized_return) AS portfolio_return,
  max(benchmark_return) AS benchmark_return, avg(realized_excess_return) AS portfolio_excess,
  avg(realized_win::INT) AS win_rate, avg(beat_benchmark::INT) AS beat_rate FROM trades GROUP BY 1""",
)
def snapshot_by_year(spark, sf):
    return N.summarize_by_year(trades(spark, sf))


@query(
    "bootstrap_mean",
    "bootstrap_mean:d lower_5:d upper_95:d probability_positive:d",
    SNAPSHOT + """,
numbered AS (SELECT row_number() OVER (ORDER BY test_year, ticker) - 1 AS i,
  realized_excess_return AS v, count(*) OVER () AS n FROM trades),
draws AS (SELECT sim, draw, ('0x' || substr(md5(concat('42-', sim, '-', draw)), 1, 8))::BIGINT AS h
  FROM range(10000) s(sim), range((SELECT max(n) FROM numbered)) d(draw)),
means AS (SELECT sim, avg(v) AS m FROM draws JOIN numbered ON i = h % n GROUP BY 1)""",
    """SELECT avg(m) AS bootstrap_mean, quantile_cont(m, 0.05) AS lower_5,
  quantile_cont(m, 0.95) AS upper_95, avg((m > 0)::INT) AS probability_positive FROM means""",
)
def bootstrap_mean(spark, sf):
    return N.bootstrap_mean(trades(spark, sf), "realized_excess_return", ["test_year", "ticker"])
