"""Price tables and result files."""

from __future__ import annotations

import zlib
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from perennial.functions.columns import null_if_nan

PRICE_SCHEMA = (
    "ticker string, date date, open double, high double, low double, close double, "
    "adj_close double, volume bigint"
)


BUCKETS = 64


def normalized_prices(prices: DataFrame) -> DataFrame:
    """Upper-case tickers with dashes, plain dates, NaN as null."""
    return prices.withColumns(
        {
            "ticker": F.upper(F.translate("ticker", ".", "-")),
            "date": F.col("date").cast("date"),
            "adj_close": null_if_nan("adj_close"),
        }
    )


def read_prices(
    spark: SparkSession, path: str, tickers: Sequence[str] | None = None, buckets: int = BUCKETS
) -> DataFrame:
    """The table that ``write_prices`` wrote, all of it or the given tickers.

    Tickers become a filter on the folder's bucket and on the stored column, so other folders are
    not opened and row groups without the ticker are skipped.
    """
    prices = spark.read.parquet(path)
    if tickers is not None:
        names = sorted({t.strip().upper().replace(".", "-") for t in tickers})
        folders = sorted({zlib.crc32(t.encode()) % buckets for t in names})
        prices = prices.where(F.col("ticker_bucket").isin(folders) & F.col("ticker").isin(names))
    return prices.drop("ticker_bucket")


def write_prices(prices: DataFrame, path: str, buckets: int = BUCKETS) -> None:
    """Normalize and write by ticker hash bucket, in ticker order inside a file."""
    bucket = (F.crc32("ticker") % buckets).cast("int")
    (
        normalized_prices(prices)
        .withColumn("ticker_bucket", bucket)
        .repartitionByRange(F.col("ticker_bucket"), F.col("ticker"), F.col("date"))
        .sortWithinPartitions("ticker_bucket", "ticker", "date")
        .write.mode("overwrite")
        .partitionBy("ticker_bucket")
        .parquet(path)
    )


def requested_tickers(requested: DataFrame) -> DataFrame:
    """Distinct trimmed upper-case tickers, blanks dropped."""
    cleaned = F.upper(F.trim("ticker"))
    return requested.select(cleaned.alias("ticker")).where(F.col("ticker") != "").distinct()


def load_prices(requested: DataFrame, prices: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Prices of the requested tickers, and the requested tickers that have none."""
    wanted = requested_tickers(requested)
    found = prices.join(wanted, "ticker", "left_semi")
    missing = wanted.join(prices.select("ticker").distinct(), "ticker", "left_anti")
    return found, missing.withColumn("error", F.lit("no price data"))


def sample_tickers(tickers: DataFrame, k: int, seed: int = 42) -> DataFrame:
    """A repeatable sample of ``k`` distinct tickers, independent of partitioning."""
    order = F.md5(F.concat_ws("-", F.lit(str(seed)), "ticker"))
    return tickers.select("ticker").distinct().orderBy(order, "ticker").limit(k)


def write_table(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> None:
    df.write.mode("overwrite").partitionBy(*partition_by).parquet(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """CSV with a declared schema; nothing is inferred."""
    return spark.read.schema(schema).option("header", True).csv(path)
