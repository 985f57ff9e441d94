"""Stored price tables and result files, split ranges, long grids, and what a projection must satisfy."""

from __future__ import annotations

import datetime as dt
import uuid

from pyspark.sql import functions as F

from checks import filing_queries as FQ
from checks import model_queries as MQ
from checks.inputs import PX, benchmark, prices, table
from checks.registry import query
from checks.seasonal_queries import KEY_SPEC, observations_sql
from perennial.functions.order import exact_quantiles, with_average_rank, with_positions
from perennial.functions.storage import materialize, shared_folder
from perennial.operators import facts as FA
from perennial.operators import portfolio as PF
from perennial.operators import seasonal as S
from perennial.plans import screener as P
from perennial.sources import filings as SF
from perennial.sources import prices as SP


def fresh(spark, name: str) -> str:
    return f"{shared_folder(spark)}/perennial/{name}-{uuid.uuid4().hex}"


def raw_prices(spark, sf):
    """Prices as a vendor would send them: dots, lower case, and a NaN on every first of a month."""
    named = prices(spark, sf).withColumn("ticker", F.concat(F.lit("x."), "ticker"))
    return named.withColumn(
        "adj_close", F.when(F.dayofmonth("date") == 1, float("nan")).otherwise(F.col("adj_close"))
    )


RAW = PX + """,
stored AS (SELECT 'X-' || ticker AS ticker, date,
  CASE WHEN day(date) <> 1 THEN adj_close END AS adj_close FROM px0)"""


@query("price_table", "ticker:s date:t adj_close:d", RAW, "SELECT * FROM stored")
def price_table(spark, sf):
    path = fresh(spark, "prices")
    SP.write_prices(raw_prices(spark, sf), path)
    return SP.read_prices(spark, path)


@query(
    "price_table_tickers",
    "ticker:s date:t adj_close:d",
    RAW,
    "SELECT * FROM stored WHERE ticker IN ('X-1', 'X-7', 'X-10')",
)
def price_table_tickers(spark, sf):
    """A few tickers by request, which is the feature: other buckets are not read."""
    path = fresh(spark, "prices")
    SP.write_prices(raw_prices(spark, sf), path)
    return SP.read_prices(spark, path, ["x.1", " X-7", "x.10", "NONE"])


@query("result_files", "ticker:s date:t adj_close:d", RAW, "SELECT * FROM stored")
def result_files(spark, sf):
    path, rows = fresh(spark, "results"), SP.normalized_prices(raw_prices(spark, sf))
    SP.write_csv(rows, path)
    return SP.read_csv(spark, path, "ticker string, date date, adj_close double")


@query(
    "load_price_rows",
    "ticker:s n:i error:s",
    PX,
    """SELECT CAST(s_suppkey AS VARCHAR) AS ticker, coalesce(n, 0) AS n,
  CASE WHEN n IS NULL THEN 'no price data' END AS error FROM (SELECT s_suppkey FROM supplier UNION
  SELECT -s_suppkey FROM supplier) LEFT JOIN (SELECT ticker, count(*) AS n FROM px0 GROUP BY 1) p
  ON p.ticker = CAST(s_suppkey AS VARCHAR)""",
)
def load_price_rows(spark, sf):
    keys = table(spark, sf, "supplier").select("s_suppkey")
    asked = keys.union(keys.select(-F.col("s_suppkey"))).select(
        F.concat(F.lit(" "), F.col("s_suppkey"), F.lit(" ")).alias("ticker")
    )
    found, missing = SP.load_prices(asked, prices(spark, sf))
    have = found.groupBy("ticker").agg(F.count(F.lit(1)).alias("n"))
    return have.withColumn("error", F.lit(None).cast("string")).unionByName(
        missing.withColumn("n", F.lit(0).cast("long")).select("ticker", "n", "error")
    )


PER_RANGE = 400


def tied(spark, sf):
    """Line items of which a third share one value, and some have none."""
    value = F.when(F.col("l_linenumber") <= 1, 0.05).when(
        F.col("l_quantity") < 49, F.col("l_discount").cast("double")
    )
    return table(spark, sf, "lineitem").select(
        "l_returnflag", "l_orderkey", "l_linenumber", value.alias("v")
    )


TIED = """t AS (SELECT l_returnflag, l_orderkey, l_linenumber, CASE WHEN l_linenumber <= 1 THEN 0.05
  WHEN l_quantity < 49 THEN l_discount::DOUBLE END AS v FROM lineitem)"""


@query(
    "average_rank_ranges",
    "l_returnflag:s l_orderkey:i l_linenumber:i average_rank:d",
    TIED,
    """SELECT *, rank() OVER (PARTITION BY l_returnflag ORDER BY v)
  + (count(*) OVER (PARTITION BY l_returnflag, v) - 1) / 2.0 AS average_rank FROM t WHERE v IS NOT NULL
  UNION ALL SELECT *, NULL FROM t WHERE v IS NULL""",
)
def average_rank_ranges(spark, sf):
    ident = ["l_orderkey", "l_linenumber"]
    return with_average_rank(
        tied(spark, sf), ["l_returnflag"], "v", ident, rows_per_range=PER_RANGE
    )


@query(
    "position_ranges",
    "l_orderkey:i l_linenumber:i place:i",
    TIED,
    """SELECT l_orderkey, l_linenumber,
  row_number() OVER (ORDER BY v NULLS LAST, l_orderkey, l_linenumber) AS place FROM t""",
)
def position_ranges(spark, sf):
    order = [F.col("v"), F.col("l_orderkey"), F.col("l_linenumber")]
    return with_positions(tied(spark, sf), [], order, "place", rows_per_range=PER_RANGE)


@query(
    "quantile_ranges",
    "l_returnflag:s q1:d q50:d q99:d",
    TIED,
    """SELECT l_returnflag, quantile_cont(v, 0.01) AS q1, quantile_cont(v, 0.5) AS q50,
  quantile_cont(v, 0.99) AS q99 FROM t GROUP BY 1""",
)
def quantile_ranges(spark, sf):
    return exact_quantiles(
        tied(spark, sf), ["l_returnflag"], "v", ["l_orderkey", "l_linenumber"],
        {"q1": 0.01, "q50": 0.5, "q99": 0.99}, rows_per_range=PER_RANGE,
    )


GRID_START, GRID_DAYS = dt.date(2001, 12, 20), 400


@query(
    "long_grid",
    f"{KEY_SPEC} upcoming_entry_date:t n:i average_return:d",
    observations_sql([(d.month, d.day) for d in P.upcoming_dates(GRID_START, GRID_DAYS)], [10])
    + f""",
grid AS (SELECT CAST(d AS DATE) AS upcoming_entry_date, month(d) AS m, day(d) AS d
  FROM (SELECT unnest(generate_series(DATE '{GRID_START}', DATE '{GRID_START}' + INTERVAL {GRID_DAYS} DAY,
  INTERVAL 1 DAY)) AS d))""",
    """SELECT ticker, entry_month, entry_day, holding_days, upcoming_entry_date, count(*) AS n,
  avg(ret) AS average_return FROM obs_all JOIN grid ON m = entry_month AND grid.d = entry_day GROUP BY ALL""",
)
def long_grid(spark, sf):
    """Every window of a grid of more than a year, on each of its dates."""
    entries = sorted({(d.month, d.day) for d in P.upcoming_dates(GRID_START, GRID_DAYS)})
    obs = S.seasonal_observations(S.clean_prices(prices(spark, sf)), entries, [10])
    found = obs.groupBy("ticker", "entry_month", "entry_day", "holding_days").agg(
        F.count(F.lit(1)).alias("n"), F.avg("ret").alias("average_return")
    )
    return P.with_grid_dates(found, GRID_START, GRID_DAYS)


CAP = 0.02
FILLED = "greatest(0, least(cap, 1 - (i - 1) * cap))"


@query(
    "beta_target_limits",
    "period_idx:i holdings:i total:d beta:d over_cap:i negative:i unsolved:i",
    MQ.BASE + f""",
sized AS (SELECT *, count(*) OVER (PARTITION BY period_idx) AS n FROM tilt),
capped AS (SELECT *, CASE WHEN n * {CAP} < 1 THEN 1.0 / n + 1e-6 ELSE {CAP} END AS cap FROM sized),
ends AS (SELECT period_idx, any_value(n) AS n,
  sum({FILLED.replace('i -', 'lo -')} * beta_24m) AS least, sum({FILLED.replace('i -', 'hi -')} * beta_24m) AS most
  FROM (SELECT *, row_number() OVER (PARTITION BY period_idx ORDER BY beta_24m, ticker) AS lo,
    row_number() OVER (PARTITION BY period_idx ORDER BY beta_24m DESC, ticker) AS hi FROM capped) GROUP BY 1)""",
    """SELECT period_idx, n AS holdings, 1.0 AS total, round(least(greatest(1.0, least + (most - least) * 1e-7),
  most - (most - least) * 1e-7), 4) AS beta, 0 AS over_cap, 0 AS negative, 0 AS unsolved FROM ends""",
)
def beta_target_limits(spark, sf):
    """Sum, beta and bounds of the projected weights per month against what the cap allows."""
    found = materialize(
        PF.beta_target_weights(PF.rank_tilt_weights(MQ.eligible(spark, sf)), 1.0, CAP), "projected"
    )
    n = F.count(F.lit(1))
    cap = F.when(n * CAP < 1, 1 / n + 1e-6).otherwise(F.lit(CAP))
    return found.groupBy("period_idx").agg(
        n.alias("holdings"),
        F.round(F.sum("weight"), 6).alias("total"),
        F.round(F.sum(F.col("weight") * F.col("beta_24m")), 4).alias("beta"),
        (F.max("weight") > cap + 1e-6).cast("int").alias("over_cap"),
        F.sum((F.col("weight") < 0).cast("int")).alias("negative"),
        F.sum((F.col("status") != "solved").cast("int")).alias("unsolved"),
    )


@query(
    "monthly_with_beta_target",
    "strategy:s period_idx:i holdings:i benchmark_return:d first_turnover:d",
    MQ.BASE,
    """SELECT s.strategy, period_idx, count(*) AS holdings, max(bench_ret) AS benchmark_return,
  CASE WHEN period_idx = (SELECT min(period_idx) FROM tilt) THEN 1.0 END AS first_turnover
  FROM tilt, (VALUES ('rank_tilt'), ('beta_target')) s(strategy) GROUP BY 1, 2""",
)
def monthly_with_beta_target(spark, sf):
    """Rank tilt and beta target through drift, turnover and cost in one run."""
    tilt = materialize(PF.rank_tilt_weights(MQ.eligible(spark, sf)), "tilt")
    target = materialize(PF.beta_target_weights(tilt, 1.0, CAP), "projected").drop("status")
    both = materialize(tilt.unionByName(target), "both")
    months = PF.portfolio_monthly(both)
    first = both.agg(F.min("period_idx").alias("_first"))
    held = both.groupBy("strategy", "period_idx").agg(F.count(F.lit(1)).alias("_held"))
    return (
        months.join(held, ["strategy", "period_idx"])
        .crossJoin(F.broadcast(first))
        .select(
            "strategy", "period_idx", F.col("_held").alias("holdings"), "benchmark_return",
            F.when(F.col("period_idx") == F.col("_first"), F.col("turnover")).alias("first_turnover"),
        )
    )



# A whole run: rank tilt, beta target and buckets, a strategy of one month, and one that loses all.
_HEAD, _MONTHS = MQ.BASE.split("\nwts AS (SELECT * FROM tilt UNION ALL SELECT * FROM bucket),")
RUN = (
    _HEAD.rstrip(",")
    + MQ.PROJECTION.removeprefix(MQ.BASE)
    + """,
wts AS (SELECT * FROM (SELECT * FROM tilt UNION ALL SELECT * FROM bucket
  UNION ALL SELECT strategy, period_idx, ticker, weight, ret, beta_24m, bench_ret FROM proj
  UNION ALL SELECT * REPLACE ('one_month' AS strategy) FROM tilt WHERE period_idx = (SELECT min(period_idx) FROM tilt)
  UNION ALL SELECT * REPLACE ('ruined' AS strategy, CASE WHEN period_idx = (SELECT max(period_idx) FROM tilt) THEN -1
    ELSE ret END AS ret) FROM tilt) WHERE weight > 1e-9),"""
    + _MONTHS
)
RUN_COLUMNS = """strategy:s period_idx:i gross_return:d benchmark_return:d estimated_beta:d holdings:i
  effective_holdings:d max_weight:d turnover:d trading_cost:d net_return:d net_excess:d beat_benchmark:b"""


def run_months(spark, sf):
    rows = MQ.eligible(spark, sf)
    tilt = materialize(PF.rank_tilt_weights(rows), "tilt")
    first, last = tilt.agg(F.min("period_idx"), F.max("period_idx")).first()
    lost = F.when(F.col("period_idx") == last, -1.0).otherwise(F.col("ret"))
    weights = [
        tilt,
        PF.beta_target_weights(tilt, 1.0, CAP).drop("status"),
        PF.bucket_weights(rows),
        tilt.where(F.col("period_idx") == first).withColumn("strategy", F.lit("one_month")),
        tilt.withColumn("strategy", F.lit("ruined")).withColumn("ret", lost),
    ]
    held = weights[0]
    for w in weights[1:]:
        held = held.unionByName(w)
    return materialize(PF.portfolio_monthly(materialize(held, "held")), "months")


@query("portfolio_run_months", RUN_COLUMNS, RUN, "SELECT * FROM pm")
def portfolio_run_months(spark, sf):
    return run_months(spark, sf)


ZERO_CAGR = """CASE WHEN product(1 + {c}) > 0 THEN pow(product(1 + {c}), 12.0 / count(*)) - 1 ELSE -1 END"""


@query(
    "portfolio_run_summary",
    """strategy:s months:i net_cagr:d benchmark_cagr:d annual_volatility:d sharpe:d max_drawdown:d
  average_excess:d beat_rate:d average_beta:d realized_beta:d average_turnover:d average_cost:d
  average_holdings:d average_effective_holdings:d average_max_weight:d""",
    RUN,
    f"""SELECT * FROM (SELECT strategy, count(*) AS months, {ZERO_CAGR.format(c='net_return')} AS net_cagr,
  {ZERO_CAGR.format(c='benchmark_return')} AS benchmark_cagr, stddev_samp(net_return) * sqrt(12) AS annual_volatility,
  CASE WHEN stddev_samp(net_return) > 0 THEN avg(net_return) * 12 / (stddev_samp(net_return) * sqrt(12)) ELSE 0 END
    AS sharpe, avg(net_excess) AS average_excess, avg(beat_benchmark::INT) AS beat_rate,
  avg(estimated_beta) AS average_beta, CASE WHEN var_samp(benchmark_return) > 0
    THEN covar_samp(net_return, benchmark_return) / var_samp(benchmark_return) ELSE 0 END AS realized_beta,
  avg(turnover) AS average_turnover, avg(trading_cost) AS average_cost, avg(holdings) AS average_holdings,
  avg(effective_holdings) AS average_effective_holdings, avg(max_weight) AS average_max_weight
  FROM pm GROUP BY 1) JOIN ({MQ.DRAWDOWN}) USING (strategy)""",
)
def portfolio_run_summary(spark, sf):
    return PF.portfolio_summary(run_months(spark, sf), degenerate="zero")


def _register_conditions(version: str, target_sql: str) -> None:
    """What each month's fit of a version must satisfy, from the panel and the fits alone.

    At the ridge solution the products of every centred feature with the residuals equal alpha times
    the coefficient times the feature's variance, and the residuals have mean 0; ``broken`` counts the
    features for which one of these fails.
    """
    spec = MQ.WF.MODELS[version]
    names = [f.removeprefix("cs_") for f in spec.features]
    complete = " AND ".join(f"{f} IS NOT NULL" for f in names)

    @query(
        f"ridge_conditions_{version}",
        "period_idx:i n_train:i predicted:i broken:i",
        MQ.BN + f""",
zt AS (SELECT *, {MQ.z_sql('residual')} AS residual_target FROM bn),
done AS (SELECT period_idx, {target_sql} IS NOT NULL AS has_target FROM zt WHERE {complete}),
tests AS (SELECT period_idx, count(*) AS predicted FROM done
  WHERE period_idx BETWEEN {MQ.START} AND {MQ.END} GROUP BY 1 HAVING count(*) >= {spec.min_test_rows})""",
        f"""SELECT t.period_idx, count(*) AS n_train, any_value(t.predicted) AS predicted, 0 AS broken
  FROM tests t JOIN done d ON d.period_idx BETWEEN t.period_idx - {MQ.TRAIN_MONTHS} AND t.period_idx - 1
  WHERE d.has_target GROUP BY 1""",
    )
    def run(spark, sf):
        prepared = materialize(spec.prepare(MQ.panel(spark, sf)), "prepared")
        features, target, alpha = list(spec.features), spec.target, 10.0
        rows = MQ.panel(spark, sf)
        found = MQ.WF.run_walk_forward(rows, version, *MQ.span(rows), training_months=MQ.TRAIN_MONTHS)
        predicted = materialize(
            found.groupBy("period_idx").agg(F.count(F.lit(1)).alias("predicted")), "predicted"
        )
        fits = MQ.R.rolling_ridge(prepared, features, target, MQ.TRAIN_MONTHS, alpha)
        fits = fits.where("n_train > 0").withColumnRenamed("period_idx", "fitted")
        later = F.explode(F.sequence(F.col("period_idx") + 1, F.col("period_idx") + MQ.TRAIN_MONTHS))
        rows = (
            prepared.dropna(subset=[*features, target])
            .select(F.array(*[F.col(f).cast("double") for f in features]).alias("xs"), F.col(target).alias("y"), later.alias("fitted"))
            .join(F.broadcast(fits), "fitted")
        )
        fit = F.aggregate(F.zip_with("xs", "coef", lambda x, c: x * c), F.col("intercept"), lambda s, v: s + v)
        long = rows.withColumn("e", F.col("y") - fit).select(
            "fitted", "n_train", "y", "e", F.posexplode(F.arrays_zip("xs", "coef")).alias("place", "xc")
        )
        x = F.col("xc.xs")
        gap = F.count(F.lit(1)) * F.covar_pop(x, "e") - alpha * F.first("xc.coef") * F.var_pop(x)
        size = F.count(F.lit(1)) * F.stddev_pop(x) * F.stddev_pop("y")
        off = F.abs(F.avg("e")) > 1e-6 * F.stddev_pop("y")
        by_feature = long.groupBy("fitted", "place").agg(
            F.first("n_train").alias("n_train"), ((F.abs(gap) > 1e-6 * size + 1e-12) | off).cast("int").alias("bad")
        )
        held = by_feature.groupBy(F.col("fitted").alias("period_idx")).agg(
            F.first("n_train").alias("n_train"), F.sum("bad").alias("broken")
        )
        return held.join(predicted, "period_idx").select("period_idx", "n_train", "predicted", "broken")


for _version, _target in (
    ("v3", "residual"),
    ("v5", "residual_target"),
    ("v6", "residual_target"),
    ("v7", "beta_neutral_target"),
):
    _register_conditions(_version, _target)


# Files of company facts: three documents per company, the second of every tenth company broken off;
# every fourth company is not marked successful.
PART = f"list_position([{FQ.text_list(FQ.TAGS)}], tag) - 1"
FILES = FQ.FLAT + f""",
whole AS (SELECT *, ({PART}) % 3 AS part FROM facts WHERE NOT (cik % 10 = 3 AND ({PART}) % 3 = 1))"""


def fact_files(spark, sf) -> str:
    broken = (F.col("cik") % 10 == 3) & (F.col("part") == 1)
    text = F.when(broken, F.expr("left(value, length(value) - 5)")).otherwise(F.col("value"))
    path = fresh(spark, "documents")
    FQ.company_documents(spark, sf, 3).select(text.alias("value")).write.text(path)
    return path


@query("scan_company_facts", FQ.FACT_SPEC, FILES, "SELECT * EXCLUDE (part) FROM whole WHERE cik % 4 <> 1")
def scan_company_facts(spark, sf):
    """Documents of written files as VARIANT, of the companies marked successful."""
    status = table(spark, sf, "supplier").select(
        F.col("s_suppkey").alias("cik"), (F.col("s_suppkey") % 4 != 1).alias("success")
    )
    documents = SF.read_documents(spark, fact_files(spark, sf), whole_files=False)
    return FA.scan_fact_rows(SF.parsed_documents(documents, status))


@query(
    "broken_documents",
    "head:s error:s in_file:b",
    FILES,
    f"""SELECT DISTINCT concat('{{"cik":', cik, ',"entityName":"', entity, '"') AS head,
  'unreadable company facts' AS error, true AS in_file FROM facts WHERE cik % 10 = 3 AND ({PART}) % 3 = 1""",
)
def broken_documents(spark, sf):
    path = fact_files(spark, sf)
    found = SF.broken_documents(SF.read_documents(spark, path, whole_files=False))
    head = F.regexp_extract("value", r'^\{"cik":[0-9]+,"entityName":"[^"]*"', 0)
    inside = F.col("file").contains(path.rsplit("/", 1)[-1])
    return found.select(head.alias("head"), "error", inside.alias("in_file"))


# Name lines in Latin-1: every seventh line has no number, every eleventh no name.
NAME_LINES = FQ.LISTED + """,
texts AS (SELECT DISTINCT concat(CASE WHEN cik % 11 = 5 THEN '' ELSE concat('CAFÉ ', name, ' Ñ&O') END, ':',
  CASE WHEN cik % 7 = 3 THEN 'n/a' ELSE lpad(CAST(cik AS VARCHAR), 10, '0') END, ':') AS line, normalized, cik,
  cik % 11 = 5 OR cik % 7 = 3 AS bad, name FROM listed)"""


@query(
    "name_line_files",
    "name:s cik:d corrupt:s",
    NAME_LINES,
    """SELECT CASE WHEN NOT bad THEN concat('CAFÉ ', name, ' Ñ&O') END AS name, CASE WHEN NOT bad THEN cik END AS cik,
  CASE WHEN bad THEN line END AS corrupt FROM texts""",
)
def name_line_files(spark, sf):
    """Lines written and read back in Latin-1; malformed ones are kept apart."""
    key = F.col("cik")
    name = F.when(key % 11 == 5, "").otherwise(F.concat(F.lit("CAFÉ "), "name", F.lit(" Ñ&O")))
    number = F.when(key % 7 == 3, "n/a").otherwise(F.lpad(key.cast("string"), 10, "0"))
    lines = FQ.listed_names(spark, sf).select(F.concat(name, F.lit(":"), number, F.lit(":")).alias("value"))
    path = fresh(spark, "names")
    writer = lines.write.option("encoding", "ISO-8859-1").option("sep", "\u0001").option("quote", "")
    writer.option("escapeQuotes", False).csv(path)
    return SF.named_lines(SF.read_lines(spark, path))


# Result files: predictions and timelines are written, read with a declared schema, and evaluated.
def prediction_file(spark, sf):
    rows = MQ.predictions(spark, sf)
    path = fresh(spark, "predictions")
    SP.write_csv(rows.drop("period"), path)
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.drop("period").schema)
    return SP.read_csv(spark, path, kinds)


@query("prediction_files", f"{MQ.ID} n_train:i prediction:d rank:i percentile:d", MQ.PREDS, "SELECT * FROM preds")
def prediction_files(spark, sf):
    return prediction_file(spark, sf)


@query("recheck_prediction_files", MQ.RECHECK_SPEC, MQ.RECHECK, MQ.RECHECK_SQL)
def recheck_prediction_files(spark, sf):
    return MQ.EV.recheck_model(materialize(prediction_file(spark, sf), "predictions"), 50)


@query(
    "timeline_files",
    "cik:i entity:s filed:t quarter_end:t prior_end:t " + " ".join(f"{f}:d" for f in FA.QUARTERLY_FEATURES),
    FQ.QUARTER_TL,
    "SELECT * FROM quarter_tl",
)
def timeline_files(spark, sf):
    """Timelines stored by filing year."""
    path = fresh(spark, "timelines")
    rows = FA.quarterly_timeline(FQ.fact_rows(spark, sf)).withColumn("filed_year", F.year("filed"))
    SP.write_table(rows, path, ("filed_year",))
    return spark.read.schema(rows.schema).parquet(path)


@query(
    "resolution_files",
    FQ.RESOLVE_SPEC,
    FQ.RESOLVE,
    FQ.EXACT_SQL,
)
def resolution_files(spark, sf):
    path = fresh(spark, "resolution")
    found = FQ.RS.resolve_identifiers(
        FQ.named_tickers(spark, sf), FQ.ticker_map(spark, sf), FQ.listed_names(spark, sf), fuzzy=False
    )
    SP.write_csv(found, path)
    return SP.read_csv(
        spark, path, "ticker string, cik long, resolution string, input_name string, matched_name string, score double"
    )
