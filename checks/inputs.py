"""Logical inputs derived from the supplied tables, once for Spark and once as SQL text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(rows: DataFrame, parts: int = 64) -> DataFrame:
    """The rows dealt over tasks, before each of them becomes many."""
    return rows.repartition(parts)


def _unit_price(df: DataFrame, *keys: str) -> DataFrame:
    price = F.round(50 + F.sum("l_extendedprice") / F.sum("l_quantity") / 500 + F.lit(1e-9), 6)
    return df.groupBy(*keys).agg(price.alias("adj_close"))


def prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(ticker, date, adj_close): one series per supplier."""
    items = table(spark, sf_dir, "lineitem").select(
        "l_suppkey", F.col("l_shipdate").cast("date").alias("date"), "l_extendedprice", "l_quantity"
    )
    # by the number: entries of a fixed width take less of a task's memory than those by its text
    per_day = _unit_price(items, "l_suppkey", "date")
    return per_day.select(F.col("l_suppkey").cast("string").alias("ticker"), "date", "adj_close")


def benchmark(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "lineitem").select(
        F.col("l_shipdate").cast("date").alias("date"), "l_extendedprice", "l_quantity"
    )
    return _unit_price(items, "date")


PX = """
px0 AS (SELECT CAST(l_suppkey AS VARCHAR) AS ticker, CAST(l_shipdate AS DATE) AS date,
  round(50 + sum(l_extendedprice) / sum(l_quantity) / 500 + 1e-9, 6) AS adj_close FROM lineitem GROUP BY 1, 2),
px AS (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY date) AS rn FROM px0),
bench AS (SELECT CAST(l_shipdate AS DATE) AS date,
  round(50 + sum(l_extendedprice) / sum(l_quantity) / 500 + 1e-9, 6) AS adj_close FROM lineitem GROUP BY 1)"""

MONTHS = (
    PX
    + """,
mr AS (SELECT *, price / lag(price) OVER (PARTITION BY ticker ORDER BY period_idx) - 1 AS ret,
  make_date((period_idx // 12)::INT, (period_idx % 12 + 1)::INT, 1) AS period FROM (
  SELECT ticker, year(date) * 12 + month(date) - 1 AS period_idx, arg_max(adj_close, date) AS price,
    max(date) AS date FROM px GROUP BY 1, 2)),
bm AS (SELECT period_idx, price / lag(price) OVER (ORDER BY period_idx) - 1 AS bench_ret FROM (
  SELECT year(date) * 12 + month(date) - 1 AS period_idx, arg_max(adj_close, date) AS price
    FROM bench GROUP BY 1)),
jm AS (SELECT mr.*, bm.bench_ret FROM mr JOIN bm USING (period_idx))"""
)


def sector_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(sector, date, adj_close): one series per part type."""
    items = table(spark, sf_dir, "lineitem").select(
        "l_partkey", F.col("l_shipdate").cast("date").alias("date"), "l_extendedprice", "l_quantity"
    )
    parts = table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("l_partkey"), F.col("p_type").alias("sector")
    )
    return _unit_price(items.join(parts, "l_partkey"), "sector", "date")


SECTORS = """
sec_px AS (SELECT p_type AS sector, CAST(l_shipdate AS DATE) AS date,
  round(50 + sum(l_extendedprice) / sum(l_quantity) / 500 + 1e-9, 6) AS adj_close
  FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2),
sec AS (SELECT sector, period_idx,
  price / lag(price) OVER (PARTITION BY sector ORDER BY period_idx) - 1 AS sector_ret FROM (
  SELECT sector, year(date) * 12 + month(date) - 1 AS period_idx, arg_max(adj_close, date) AS price
    FROM sec_px GROUP BY 1, 2))"""
