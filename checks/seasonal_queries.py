"""Calendar-window operators over the supplier price series."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from checks.inputs import PX, benchmark, prices, table
from checks.registry import query
from perennial.functions.columns import wilson_lower_bound
from perennial.functions.student import student_quantiles
from perennial.operators import seasonal as S
from perennial.operators import validate as V
from perennial.plans import screener as P

ENTRIES = [(8, 20), (8, 27), (2, 29), (12, 29)]
HOLDINGS = [5, 10]
LOOKBACK = 5
MIN_TRAINING = 3
TEST_YEARS = 2
LIMITS = P.Thresholds(0.3, 2, None, 0.2, None, MIN_TRAINING, TEST_YEARS, LOOKBACK)
SCAN_LIMITS = P.Thresholds(0.5, 2, 0.0, None, None, MIN_TRAINING, TEST_YEARS, 15)
NESTED = P.NestedGrid(
    8, 20, (1999, 2000, 2001), 3, (5, 10), 3,
    P.Thresholds(0.4, 2, None, 0.3, None, MIN_TRAINING - 1, 1, 15),
)
KEY = "ticker, entry_month, entry_day, holding_days"
KEY_SPEC = "ticker:s entry_month:i entry_day:i holding_days:i"


def observations_sql(entries, holdings) -> str:
    days = ", ".join(f"({m}, {d})" for m, d in entries)
    holds = ", ".join(f"({h})" for h in holdings)
    return f"""{PX},
days(entry_month, entry_day) AS (VALUES {days}), holds(holding_days) AS (VALUES {holds}),
yrs AS (SELECT ticker, unnest(range(min(year(date)), max(year(date)) + 1)) AS year FROM px GROUP BY 1),
tgt AS (SELECT *, try_cast(printf('%04d-%02d-%02d', year, entry_month, entry_day) AS DATE) AS target_date
  FROM yrs CROSS JOIN days),
ent AS (SELECT t.ticker, t.year, entry_month, entry_day, target_date, min(p.rn) AS rn FROM tgt t
  JOIN px p ON p.ticker = t.ticker AND p.date BETWEEN t.target_date AND t.target_date + 7
  WHERE target_date IS NOT NULL GROUP BY ALL),
obs_all AS (SELECT e.ticker, e.entry_month, e.entry_day, h.holding_days, e.year, e.target_date,
  p.date AS entry_date, q.date AS exit_date, p.adj_close AS entry_price, q.adj_close AS exit_price,
  q.adj_close / p.adj_close - 1 AS ret, q.adj_close / p.adj_close - 1 > 0 AS win
  FROM ent e CROSS JOIN holds h JOIN px p ON p.ticker = e.ticker AND p.rn = e.rn
  JOIN px q ON q.ticker = e.ticker AND q.rn = e.rn + h.holding_days
  WHERE year(q.date) <= e.year + 1 AND p.adj_close > 0),
cmp_all AS (SELECT o.*, b1.adj_close / b0.adj_close - 1 AS bench_ret,
  ret - (b1.adj_close / b0.adj_close - 1) AS excess,
  coalesce(ret - (b1.adj_close / b0.adj_close - 1) > 0, false) AS beat
  FROM obs_all o LEFT JOIN bench b0 ON b0.date = entry_date LEFT JOIN bench b1 ON b1.date = exit_date)"""


def recent_sql(lookback: int, key: str = KEY, source: str = "cmp_all", name: str = "cmp") -> str:
    return f"""{name} AS (SELECT * FROM {source} QUALIFY
  row_number() OVER (PARTITION BY {key} ORDER BY year DESC) <= {lookback})"""


def wilson_sql(w: str, n: str) -> str:
    p = f"(({w}) / ({n})::DOUBLE)"
    return f"""CASE WHEN ({n}) > 0 THEN ({p} + 3.8416 / (2 * ({n})) - 1.96 * sqrt({p} * (1 - {p}) / ({n})
  + 3.8416 / (4 * ({n}) * ({n})))) / (1 + 3.8416 / ({n})) ELSE 0 END"""


T80 = "[" + ", ".join(repr(q) for q in student_quantiles(0.8, 40)) + "]"


def metrics_sql(prefix: str, rows: str = "true") -> dict[str, str]:
    """Every metric as a SQL aggregate over the rows that satisfy ``rows``."""
    a = f"FILTER (WHERE {rows})"
    e = f"FILTER (WHERE ({rows}) AND excess IS NOT NULL)"
    n, wins = f"count(*) {a}", f"count(*) FILTER (WHERE ({rows}) AND ret > 0)"
    gain = f"coalesce(sum(ret) FILTER (WHERE ({rows}) AND ret > 0), 0)"
    loss = f"coalesce(sum(ret) FILTER (WHERE ({rows}) AND ret <= 0), 0)"
    en = f"count(*) {e}"
    p = f"{prefix}_" if prefix else ""
    return {
        f"{p}sample_size": n,
        f"{p}wins": wins,
        f"{p}losses": f"{n} - {wins}",
        f"{p}win_rate": f"coalesce(avg(CASE WHEN ret > 0 THEN 1.0 ELSE 0 END) {a}, 0)",
        f"{p}average_return": f"coalesce(avg(ret) {a}, 0)",
        f"{p}median_return": f"coalesce(median(ret) {a}, 0)",
        f"{p}std_dev": f"coalesce(stddev_samp(ret) {a}, 0)",
        f"{p}best_return": f"coalesce(max(ret) {a}, 0)",
        f"{p}worst_return": f"coalesce(min(ret) {a}, 0)",
        f"{p}average_gain": f"coalesce(avg(ret) FILTER (WHERE ({rows}) AND ret > 0), 0)",
        f"{p}average_loss": f"coalesce(avg(ret) FILTER (WHERE ({rows}) AND ret <= 0), 0)",
        f"{p}profit_factor": f"""CASE WHEN {loss} = 0 THEN CASE WHEN {gain} > 0
  THEN 'inf'::DOUBLE ELSE 0 END ELSE {gain} / abs({loss}) END""",
        f"{p}wilson": wilson_sql(wins, n),
        f"{p}benchmark_sample_size": en,
        f"{p}beat_rate": f"coalesce(avg(CASE WHEN beat THEN 1.0 ELSE 0 END) {e}, 0)",
        f"{p}average_excess": f"coalesce(avg(excess) {e}, 0)",
        f"{p}median_excess": f"coalesce(median(excess) {e}, 0)",
        f"{p}best_excess": f"coalesce(max(excess) {e}, 0)",
        f"{p}worst_excess": f"coalesce(min(excess) {e}, 0)",
        f"{p}excess_std": f"coalesce(stddev_samp(excess) {e}, 0)",
        f"{p}excess_lcb": f"""CASE WHEN {en} = 0 THEN 0 WHEN {en} = 1 THEN avg(excess) {e}
  ELSE avg(excess) {e} - list_extract({T80}, {en} - 1) * stddev_samp(excess) {e} / sqrt({en}) END""",
        f"{p}excess_q25": f"coalesce(quantile_cont(excess, 0.25) {e}, 0)",
    }


def select_sql(metrics: dict[str, str], names) -> str:
    return ", ".join(f"{metrics[n]} AS {n}" for n in names)


OBS = observations_sql(ENTRIES, HOLDINGS)
OBS_RECENT = OBS + ",\n" + recent_sql(LOOKBACK)
OBS_SPEC = (
    KEY_SPEC + " year:i target_date:t entry_date:t exit_date:t entry_price:d exit_price:d ret:d win:b"
)
ABS_NAMES = V.ABSOLUTE_COLUMNS
REL_NAMES = (
    "benchmark_sample_size", "beat_rate", "average_excess", "median_excess", "best_excess",
    "worst_excess", "excess_std", "excess_lcb", "excess_q25",
)
INTEGERS = {"sample_size", "wins", "losses", "benchmark_sample_size", "wf_folds", "wf_qualified_folds"}


def spec(names) -> str:
    kinds = []
    for n in names:
        base = n.removeprefix("train_").removeprefix("oos_")
        kinds.append(f"{n}:{'i' if base in INTEGERS else 'd'}")
    return " ".join(kinds)


def compared(spark, sf, lookback=LOOKBACK, entries=ENTRIES, holdings=HOLDINGS):
    obs = S.seasonal_returns(prices(spark, sf), entries, holdings, lookback)
    return S.add_benchmark(obs, benchmark(spark, sf))


@query(
    "clean_price_series",
    "ticker:s date:t adj_close:d",
    sql="""SELECT CAST(l_suppkey AS VARCHAR) AS ticker, CAST(l_shipdate AS DATE) AS date,
  l_extendedprice / l_quantity AS adj_close FROM lineitem WHERE l_quantity IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY l_suppkey, CAST(l_shipdate AS DATE)
    ORDER BY l_orderkey, l_linenumber) = 1""",
)
def clean_price_series(spark, sf):
    raw = table(spark, sf, "lineitem").select(
        F.col("l_suppkey").cast("string").alias("ticker"),
        F.col("l_shipdate").cast("date").alias("date"),
        F.try_divide("l_extendedprice", "l_quantity").alias("adj_close"),
        "l_orderkey",
        "l_linenumber",
    )
    return S.clean_prices(raw, first_by=["l_orderkey", "l_linenumber"])


@query(
    "next_session",
    "ticker:s target_date:t entry_date:t entry_price:d",
    PX,
    """SELECT t.ticker, t.target_date, t.entry_date, p.adj_close AS entry_price FROM (
  SELECT c.ticker, c.target_date, min(p.date) AS entry_date FROM (
    SELECT ticker, unnest(generate_series(date_trunc('year', min(date))::TIMESTAMP, max(date)::TIMESTAMP,
      INTERVAL 1 DAY))::DATE AS target_date FROM px GROUP BY 1) c
  JOIN px p ON p.ticker = c.ticker AND p.date BETWEEN c.target_date AND c.target_date + 7 GROUP BY 1, 2) t
  JOIN px p ON p.ticker = t.ticker AND p.date = t.entry_date""",
)
def next_session(spark, sf):
    return S.next_sessions(S.clean_prices(prices(spark, sf)))


@query("seasonal_returns", OBS_SPEC, OBS + ",\n" + recent_sql(LOOKBACK, source="obs_all"), "SELECT * FROM cmp")
def seasonal_returns(spark, sf):
    return S.seasonal_returns(prices(spark, sf), ENTRIES, HOLDINGS, LOOKBACK)


@query(
    "benchmark_excess", OBS_SPEC + " bench_ret:d excess:d beat:b", OBS_RECENT, "SELECT * FROM cmp"
)
def benchmark_excess(spark, sf):
    return compared(spark, sf)


@query(
    "abs_metrics",
    f"{KEY_SPEC} {spec(ABS_NAMES)}",
    OBS_RECENT,
    f"SELECT {KEY}, {select_sql(metrics_sql(''), ABS_NAMES)} FROM cmp GROUP BY {KEY}",
)
def abs_metrics(spark, sf):
    return S.absolute_metrics(compared(spark, sf))


@query(
    "relative_metrics",
    f"{KEY_SPEC} {spec(REL_NAMES)}",
    OBS_RECENT,
    f"SELECT {KEY}, {select_sql(metrics_sql(''), REL_NAMES)} FROM cmp GROUP BY {KEY}",
)
def relative_metrics(spark, sf):
    return S.relative_metrics(compared(spark, sf))


@query(
    "wilson",
    "l_suppkey:i wins:i total:i wilson:d",
    sql=f"""SELECT l_suppkey, wins, total, {wilson_sql('wins', 'total')} AS wilson FROM (
  SELECT l_suppkey, count(*) FILTER (WHERE l_returnflag = 'N') AS wins, count(*) AS total
  FROM lineitem GROUP BY 1)""",
)
def wilson(spark, sf):
    flags = table(spark, sf, "lineitem").groupBy("l_suppkey").agg(
        F.count(F.when(F.col("l_returnflag") == "N", 1)).alias("wins"), F.count("*").alias("total")
    )
    return flags.withColumn("wilson", wilson_lower_bound("wins", "total"))


@query(
    "mean_lcb",
    "ticker:s n:i lower_bound:d",
    OBS,
    f"""SELECT ticker, count(*) AS n, CASE WHEN count(*) = 1 THEN avg(ret)
  ELSE avg(ret) - list_extract({T80}, count(*) - 1) * stddev_samp(ret) / sqrt(count(*)) END AS lower_bound
  FROM obs_all WHERE entry_month = 8 AND holding_days = 10 GROUP BY 1""",
)
def mean_lcb(spark, sf):
    obs = S.seasonal_returns(prices(spark, sf), [(8, 20), (8, 27)], [10], 15)
    agg = obs.groupBy("ticker").agg(
        F.count("ret").alias("n"), F.avg("ret").alias("m"), F.stddev_samp("ret").alias("s")
    )
    return agg.withColumn("lower_bound", S.mean_lower_bound(F.col("m"), F.col("s"), F.col("n")))


@query(
    "chrono_split",
    KEY_SPEC + " year:i ret:d is_test:b enough_years:b",
    OBS_RECENT,
    f"""SELECT *, max(back) OVER (PARTITION BY {KEY}) > {TEST_YEARS} AS enough_years FROM (
  SELECT *, dense_rank() OVER (PARTITION BY {KEY} ORDER BY year DESC) AS back,
  dense_rank() OVER (PARTITION BY {KEY} ORDER BY year DESC) <= {TEST_YEARS} AS is_test FROM cmp)""",
)
def chrono_split(spark, sf):
    return V.chronological_split(compared(spark, sf), TEST_YEARS)


SPLIT = f""",
split AS (SELECT *, dense_rank() OVER (PARTITION BY {KEY} ORDER BY year DESC) <= {TEST_YEARS} AS is_test,
  count(*) OVER (PARTITION BY {KEY}) AS n_obs FROM cmp)"""
TRAIN = [f"train_{c}" for c in V.TRAIN_COLUMNS]
OOS = [f"oos_{c}" for c in V.OOS_COLUMNS]
TRAIN_SQL = metrics_sql("train", "NOT is_test")
OOS_SQL = metrics_sql("oos", "is_test")


@query(
    "train_oos_metrics",
    f"{KEY_SPEC} {spec(TRAIN + OOS)}",
    OBS_RECENT + SPLIT,
    f"""SELECT {KEY}, {select_sql(TRAIN_SQL, TRAIN)}, {select_sql(OOS_SQL, OOS)}
  FROM split WHERE n_obs > {TEST_YEARS} GROUP BY {KEY}""",
)
def train_oos_metrics(spark, sf):
    return V.validation_metrics(compared(spark, sf), TEST_YEARS)


def folds_sql(key: str, min_training: int, source: str = "cmp") -> str:
    """Every observation paired with the metrics of the earlier ones (a plain self-join)."""
    same = " AND ".join(f"p.{k.strip()} = c.{k.strip()}" for k in key.split(","))
    e = "FILTER (WHERE p.excess IS NOT NULL)"
    return f"""folds AS (SELECT *, training_years >= {min_training} AS is_fold,
  training_years >= {min_training} AND prior_win_rate >= 0.7 AND prior_median_return >= 0
  AND prior_beat_rate >= 0.6 AND prior_median_excess >= 0 AS qualified FROM (
  SELECT c.*, count(p.ret) AS training_years,
  coalesce(avg(CASE WHEN p.ret > 0 THEN 1.0 WHEN p.ret <= 0 THEN 0 END), 0) AS prior_win_rate,
  coalesce(median(p.ret), 0) AS prior_median_return,
  coalesce(avg(CASE WHEN p.beat THEN 1.0 ELSE 0 END) {e}, 0) AS prior_beat_rate,
  coalesce(median(p.excess), 0) AS prior_median_excess
  FROM {source} c LEFT JOIN {source} p ON {same} AND p.year < c.year GROUP BY ALL))"""


OBS15 = observations_sql(ENTRIES, HOLDINGS) + ",\n" + recent_sql(15)
FOLDS = OBS15 + ",\n" + folds_sql(KEY, MIN_TRAINING)
WF_SQL = """count(*) FILTER (WHERE is_fold) AS wf_folds, count(*) FILTER (WHERE qualified) AS wf_qualified_folds,
  coalesce(avg(CASE WHEN qualified THEN 1.0 ELSE 0 END) FILTER (WHERE is_fold), 0) AS wf_selection_rate,
  coalesce(avg(CASE WHEN ret > 0 THEN 1.0 ELSE 0 END) FILTER (WHERE qualified), 0) AS wf_win_rate,
  coalesce(avg(CASE WHEN beat THEN 1.0 ELSE 0 END) FILTER (WHERE qualified), 0) AS wf_beat_rate,
  CASE WHEN count(*) FILTER (WHERE qualified) = 0 THEN 0 ELSE median(ret) FILTER (WHERE qualified) END
    AS wf_median_return,
  CASE WHEN count(*) FILTER (WHERE qualified) = 0 THEN 0 ELSE median(excess) FILTER (WHERE qualified) END
    AS wf_median_excess"""
WF = [
    "wf_folds", "wf_qualified_folds", "wf_selection_rate", "wf_win_rate", "wf_beat_rate",
    "wf_median_return", "wf_median_excess",
]


@query(
    "walk_forward",
    KEY_SPEC + """ year:i training_years:i prior_win_rate:d prior_median_return:d prior_beat_rate:d
  prior_median_excess:d qualified:b ret:d excess:d""",
    FOLDS,
    "SELECT * FROM folds WHERE is_fold",
)
def walk_forward(spark, sf):
    return V.walk_forward_folds(compared(spark, sf, 15), MIN_TRAINING).where("is_fold")


@query(
    "walk_forward_summary",
    f"{KEY_SPEC} {spec(WF)}",
    FOLDS,
    f"SELECT {KEY}, {WF_SQL} FROM folds GROUP BY {KEY} HAVING count(*) FILTER (WHERE is_fold) > 0",
)
def walk_forward_summary(spark, sf):
    return V.walk_forward_summary(V.walk_forward_folds(compared(spark, sf, 15), MIN_TRAINING))


def analyzed_sql(key: str, min_training: int, test_years: int, source: str = "cmp") -> str:
    """CTE ``analyzed``: one row per usable window with every metric."""
    return f"""{folds_sql(key, min_training, source)},
split AS (SELECT *, dense_rank() OVER (PARTITION BY {key} ORDER BY year DESC) <= {test_years} AS is_test,
  count(*) OVER (PARTITION BY {key}) AS n_obs FROM folds),
analyzed AS (SELECT {key}, {select_sql(metrics_sql(''), V.ABSOLUTE_COLUMNS + V.RELATIVE_COLUMNS)},
  {select_sql(TRAIN_SQL, TRAIN)}, {select_sql(OOS_SQL, OOS)}, {WF_SQL}
  FROM split WHERE n_obs > {min_training} AND n_obs > {test_years} GROUP BY {key})"""


ANALYZED_NAMES = [*V.ABSOLUTE_COLUMNS, *V.RELATIVE_COLUMNS, *TRAIN, *OOS, *WF]
SCAN_SORT = ", ".join(f"{c} DESC" for c in V.SCAN_ORDER)
DISCOVERY_SORT = ", ".join(f"{c} DESC" for c in V.DISCOVERY_ORDER)


@query(
    "analyze",
    f"{KEY_SPEC} {spec(ANALYZED_NAMES)}",
    OBS15 + ",\n" + analyzed_sql(KEY, MIN_TRAINING, TEST_YEARS),
    "SELECT * FROM analyzed",
)
def analyze(spark, sf):
    found = V.analyze(compared(spark, sf, 15), MIN_TRAINING, TEST_YEARS)
    return found.where(F.col("error").isNull())


@query(
    "analyze_errors",
    KEY_SPEC + " error:s",
    OBS15,
    f"""SELECT t.ticker, d.entry_month, d.entry_day, h.holding_days,
  CASE WHEN count(o.ret) = 0 THEN 'no year with a complete window'
    WHEN count(o.ret) <= {MIN_TRAINING} THEN 'too few seasons to test any of them on earlier ones'
    ELSE 'too few years to split into training and test' END AS error
  FROM (SELECT DISTINCT ticker FROM px) t CROSS JOIN days d CROSS JOIN holds h
  LEFT JOIN cmp o ON o.ticker = t.ticker AND o.entry_month = d.entry_month
    AND o.entry_day = d.entry_day AND o.holding_days = h.holding_days
  GROUP BY 1, 2, 3, 4 HAVING count(o.ret) <= {max(MIN_TRAINING, TEST_YEARS)}""",
)
def analyze_errors(spark, sf):
    return P.scan_errors(prices(spark, sf), benchmark(spark, sf), ENTRIES, HOLDINGS, SCAN_LIMITS)


@query(
    "quality_filter",
    f"{KEY_SPEC} {spec(TRAIN)}",
    OBS15 + ",\n" + analyzed_sql(KEY, MIN_TRAINING, TEST_YEARS),
    """SELECT * FROM analyzed WHERE train_sample_size >= 3 AND train_win_rate >= 0.5
  AND train_median_return >= 0 AND train_beat_rate >= 0.4 AND train_median_excess >= -0.01""",
)
def quality_filter(spark, sf):
    found = V.analyze(compared(spark, sf, 15), MIN_TRAINING, TEST_YEARS)
    return V.quality_filter(found, 0.5, 3, 0.0, 0.4, -0.01)


SCAN_SQL = (
    observations_sql([(8, 20)], [10])
    + ",\n" + recent_sql(15) + ",\n" + analyzed_sql(KEY, MIN_TRAINING, TEST_YEARS)
)


@query(
    "seasonal_scan",
    f"rank:i {KEY_SPEC} {spec(ANALYZED_NAMES)}",
    SCAN_SQL,
    f"""SELECT *, row_number() OVER (ORDER BY {SCAN_SORT}, ticker) AS rank FROM analyzed
  WHERE train_sample_size >= 2 AND train_win_rate >= 0.5 AND train_median_return >= 0""",
)
def seasonal_scan(spark, sf):
    return P.scan(prices(spark, sf), benchmark(spark, sf), 8, 20, 10, SCAN_LIMITS)


@query(
    "date_grid",
    "entry_date:t holding_days:i n_orders:i",
    sql="""SELECT g.entry_date, h.holding_days, count(o.o_orderkey) AS n_orders FROM (
  SELECT unnest(generate_series(TIMESTAMP '1998-08-20', TIMESTAMP '1998-09-19', INTERVAL 1 DAY))::DATE AS entry_date) g
  CROSS JOIN (VALUES (5), (10), (15), (20), (30)) h(holding_days)
  LEFT JOIN orders o ON CAST(o.o_orderdate AS DATE) = g.entry_date GROUP BY 1, 2""",
)
def date_grid(spark, sf):
    grid = P.date_grid(spark, dt.date(1998, 8, 20), 30, (5, 10, 15, 20, 30))
    per_day = table(spark, sf, "orders").groupBy(
        F.col("o_orderdate").cast("date").alias("entry_date")
    ).agg(F.count("o_orderkey").alias("n_orders"))
    return grid.join(per_day, "entry_date", "left").fillna(0, ["n_orders"])


DISCOVER_DAYS = P.upcoming_dates(dt.date(2002, 8, 18), 9)
DISCOVER_LIMITS = P.Thresholds(0.5, 2, 0.0, 0.3, None, MIN_TRAINING, TEST_YEARS, 15)
DISCOVER_CTES = (
    observations_sql([(d.month, d.day) for d in DISCOVER_DAYS], [5, 10, 20])
    + ",\n" + recent_sql(15) + ",\n" + analyzed_sql(KEY, MIN_TRAINING, TEST_YEARS)
    + f""",
ranked AS (SELECT *, make_date(2002, entry_month::INT, entry_day::INT) AS upcoming_entry_date,
  row_number() OVER (ORDER BY {DISCOVERY_SORT}, ticker, entry_month, entry_day, holding_days) AS raw_rank
  FROM analyzed WHERE train_sample_size >= 2 AND train_win_rate >= 0.5 AND train_median_return >= 0
    AND train_beat_rate >= 0.3),
seq AS (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY raw_rank) AS k FROM ranked)"""
)
# Greedy suppression as recursion over the ranked list of each ticker.
GREEDY_SQL = """walk AS (
  SELECT {key}, k, raw_rank, [{{'e': upcoming_entry_date, 'h': holding_days}}] AS kept, true AS keep
  FROM seq WHERE k = 1
  UNION ALL
  SELECT {skey}, s.k, s.raw_rank,
    CASE WHEN clash THEN w.kept ELSE list_append(w.kept, {{'e': s.upcoming_entry_date, 'h': s.holding_days}}) END,
    NOT clash
  FROM walk w JOIN seq s ON {join} AND s.k = w.k + 1,
  LATERAL (SELECT len(list_filter(w.kept, lambda x: abs(date_diff('day', x.e, s.upcoming_entry_date)) <= 3
    AND abs(x.h - s.holding_days) <= 5)) > 0 AS clash))"""


@query(
    "discover",
    f"rank:i upcoming_entry_date:t {KEY_SPEC} {spec(ANALYZED_NAMES)}",
    "RECURSIVE " + DISCOVER_CTES + ",\n"
    + GREEDY_SQL.format(key="ticker", skey="s.ticker", join="s.ticker = w.ticker"),
    """SELECT r.*, row_number() OVER (ORDER BY r.raw_rank) AS rank FROM ranked r
  JOIN walk w ON w.ticker = r.ticker AND w.raw_rank = r.raw_rank AND w.keep""",
)
def discover(spark, sf):
    return P.discover(
        prices(spark, sf), benchmark(spark, sf), DISCOVER_DAYS[0], 9, (5, 10, 20), DISCOVER_LIMITS
    )


@query(
    "dedup_windows",
    "ticker:s rank:i upcoming_entry_date:t holding_days:i",
    """RECURSIVE ranked AS (SELECT CAST(l_suppkey AS VARCHAR) AS ticker,
  CAST(l_shipdate AS DATE) AS upcoming_entry_date, CAST(l_quantity AS INT) AS holding_days,
  row_number() OVER (ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber) AS raw_rank FROM lineitem
  WHERE year(l_shipdate) = 1998 AND month(l_shipdate) = 8),
seq AS (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY raw_rank) AS k FROM ranked),
""" + GREEDY_SQL.format(key="ticker", skey="s.ticker", join="s.ticker = w.ticker"),
    """SELECT r.ticker, r.upcoming_entry_date, r.holding_days, r.raw_rank AS rank FROM ranked r
  JOIN walk w ON w.ticker = r.ticker AND w.raw_rank = r.raw_rank AND w.keep""",
)
def dedup_windows(spark, sf):
    items = table(spark, sf, "lineitem").where(
        (F.year("l_shipdate") == 1998) & (F.month("l_shipdate") == 8)
    )
    offers = items.select(
        F.col("l_suppkey").cast("string").alias("ticker"),
        F.col("l_shipdate").cast("date").alias("upcoming_entry_date"),
        F.col("l_quantity").cast("int").alias("holding_days"),
        "l_extendedprice",
        "l_orderkey",
        "l_linenumber",
    )
    ranked = V.rank_by(offers, ["l_extendedprice"], ["l_orderkey", "l_linenumber"])
    return V.suppress_overlaps(ranked)


NESTED_KEY = "test_year, upcoming_entry_date, " + KEY
NESTED_DAYS = [
    (y, d) for y in NESTED.test_years
    for d in P.upcoming_dates(dt.date(y, NESTED.anchor_month, NESTED.anchor_day), NESTED.days_ahead)
]
NESTED_CTES = (
    "RECURSIVE "
    + observations_sql(sorted({(d.month, d.day) for _, d in NESTED_DAYS}), NESTED.holdings)
    + ",\ncand(test_year, upcoming_entry_date) AS (VALUES "
    + ", ".join(f"({y}, DATE '{d}')" for y, d in NESTED_DAYS)
    + f"""),
train AS (SELECT c.test_year, c.upcoming_entry_date, a.* FROM cmp_all a JOIN cand c
  ON month(c.upcoming_entry_date) = a.entry_month AND day(c.upcoming_entry_date) = a.entry_day
  AND a.exit_date < make_date(c.test_year, 1, 1)),
{recent_sql(15, NESTED_KEY, 'train')},
{analyzed_sql(NESTED_KEY, MIN_TRAINING - 1, 1)},
ranked AS (SELECT *, row_number() OVER (PARTITION BY test_year
  ORDER BY {SCAN_SORT}, ticker, entry_month, entry_day, holding_days) AS raw_rank FROM analyzed
  WHERE train_sample_size >= 2 AND train_win_rate >= 0.4 AND train_beat_rate >= 0.3),
seq AS (SELECT *, row_number() OVER (PARTITION BY test_year, ticker ORDER BY raw_rank) AS k FROM ranked),
"""
    + GREEDY_SQL.format(
        key="test_year, ticker", skey="s.test_year, s.ticker",
        join="s.test_year = w.test_year AND s.ticker = w.ticker",
    )
    + """,
kept AS (SELECT r.*, row_number() OVER (PARTITION BY r.test_year ORDER BY r.raw_rank) AS rank FROM ranked r
  JOIN walk w ON w.test_year = r.test_year AND w.ticker = r.ticker AND w.raw_rank = r.raw_rank AND w.keep),
best AS (SELECT * FROM kept QUALIFY row_number() OVER (PARTITION BY test_year, ticker ORDER BY rank) = 1),
chosen AS (SELECT * FROM best QUALIFY row_number() OVER (PARTITION BY test_year ORDER BY rank) <= 3),
trades AS (SELECT s.test_year, s.ticker, s.entry_month, s.entry_day, s.holding_days, o.entry_date, o.exit_date,
  o.ret AS realized_return, o.bench_ret AS realized_benchmark_return, o.excess AS realized_excess_return,
  o.win AS realized_win, o.beat AS realized_beat, s.train_win_rate AS prior_win_rate,
  s.train_wilson AS prior_wilson, s.train_median_return AS prior_median_return,
  s.train_median_excess AS prior_median_excess, s.rank AS prior_rank
  FROM chosen s JOIN cmp_all o ON o.ticker = s.ticker AND o.entry_month = s.entry_month
    AND o.entry_day = s.entry_day AND o.holding_days = s.holding_days AND o.year = s.test_year
    AND o.exit_date < make_date(s.test_year + 1, 1, 1))"""
)
TRADE_SPEC = f"""test_year:i {KEY_SPEC} entry_date:t exit_date:t realized_return:d
  realized_benchmark_return:d realized_excess_return:d realized_win:b realized_beat:b prior_win_rate:d
  prior_wilson:d prior_median_return:d prior_median_excess:d prior_rank:i"""


@query("nested_walk_forward", TRADE_SPEC, NESTED_CTES, "SELECT * FROM trades")
def nested_walk_forward(spark, sf):
    return P.nested_walk_forward(prices(spark, sf), benchmark(spark, sf), NESTED)


@query(
    "trade_summary",
    """trades:i win_rate:d beat_rate:d average_return:d median_return:d average_excess_return:d
  median_excess_return:d worst_return:d""",
    NESTED_CTES,
    """SELECT count(*) AS trades, coalesce(avg(realized_win::INT), 0) AS win_rate,
  coalesce(avg(realized_beat::INT), 0) AS beat_rate, coalesce(avg(realized_return), 0) AS average_return,
  coalesce(median(realized_return), 0) AS median_return,
  coalesce(avg(realized_excess_return), 0) AS average_excess_return,
  coalesce(median(realized_excess_return), 0) AS median_excess_return,
  coalesce(min(realized_return), 0) AS worst_return FROM trades""",
)
def trade_summary(spark, sf):
    return P.trade_summary(nested_walk_forward(spark, sf))
