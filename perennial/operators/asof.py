"""Backward as-of joins and the point-in-time attachment of fundamentals."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from perennial.functions.columns import month_start, normalize_ticker
from perennial.operators.crosssection import PERIOD


def asof_backward(
    left: DataFrame,
    right: DataFrame,
    by: Sequence[str],
    left_time: str,
    right_time: str,
    values: Sequence[str],
    keep_time: bool = True,
    carry: bool = False,
) -> DataFrame:
    """Add the latest right row with ``right_time <= left_time`` per key; nulls where there is none.

    The rows of both sides are merged in time order and the last right value is carried forward, so no
    pair of rows is ever compared and nothing is joined back.  ``keep_time`` also adds ``right_time``.
    Of right rows with equal key and time the greatest by ``values`` counts.

    Left rows without key or time stay out of the merge, where those without key would all meet in one
    task.  ``carry=True`` saves reading the left side twice for it; use it where none is null.
    """
    wanted = [right_time, *values] if keep_time else list(values)
    filled = F.struct(*[F.col(c) for c in wanted])
    events = (
        right.dropna(subset=[*by, right_time])
        .groupBy(*by, F.col(right_time).alias("_t"))
        .agg(F.max(filled).alias("_v"))
        .withColumn("_ask", F.lit(False))
    )
    rest = [c for c in left.columns if c not in (*by, left_time)]
    whole = F.lit(True)
    for c in (*by, left_time):
        whole = whole & F.col(c).isNotNull()
    rows = left if carry else left.where(whole)
    asks = rows.select(*by, F.col(left_time).alias("_t"), F.struct(F.lit(0), *rest).alias("_row"))
    events = events.withColumn("_row", F.lit(None).cast(asks.schema["_row"].dataType))
    asks = asks.withColumn("_v", F.lit(None).cast(events.schema["_v"].dataType)).withColumn(
        "_ask", F.lit(True)
    )
    w = (
        Window.partitionBy(*by)
        .orderBy("_t", "_ask")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    merged = (
        events.unionByName(asks)
        .withColumn("_v", F.last("_v", ignorenulls=True).over(w))
        .where("_ask")
    )
    found = merged.select(
        *by, F.col("_t").alias(left_time), *[F.col(f"_row.{c}").alias(c) for c in rest],
        *[F.col(f"_v.{c}").alias(c) for c in wanted],
    )
    if carry:
        return found
    types = events.schema["_v"].dataType
    nothing = [F.lit(None).cast(types[c].dataType).alias(c) for c in wanted]
    return found.unionByName(left.where(~whole).select(*by, left_time, *rest, *nothing))


def map_identifiers(
    data: DataFrame, resolution: DataFrame, last_by: Sequence[str] = ()
) -> DataFrame:
    """Add the CIK of every normalised ticker; unmapped rows keep null.

    Repeated tickers keep the row that is last by ``last_by`` (the greatest CIK without it).

    Both sides are dealt by ticker and sorted.  Spark's estimate of ``data`` does not see rows that became
    many before the join, such as months of a ticker; it would take a panel for small and broadcast it.
    Rows without a ticker stay out of the join, where they would all meet in one task.
    """
    known = resolution.where(F.col("cik").isNotNull()).withColumn(
        "ticker", normalize_ticker("ticker")
    )
    pick: Column = F.max_by("cik", F.struct(*last_by)) if last_by else F.max("cik")
    mapping = known.groupBy("ticker").agg(pick.cast("bigint").alias("cik"))
    rows = data.withColumn("ticker", normalize_ticker("ticker"))
    found = rows.where(F.col("ticker").isNotNull()).join(mapping.hint("merge"), "ticker", "left")
    nothing = F.lit(None).cast("bigint")
    return found.unionByName(rows.where(F.col("ticker").isNull()).withColumn("cik", nothing))


def attach_point_in_time(
    data: DataFrame,
    resolution: DataFrame,
    timeline: DataFrame,
    values: Sequence[str],
    last_by: Sequence[str] = (),
    strict: bool = True,
) -> DataFrame:
    """For every (ticker, month): the last filing known on the day before the month starts.

    ``strict`` makes the job that reads the result fail on a filing from the month itself or later.
    """
    mapped = map_identifiers(data, resolution, last_by).withColumn(
        "cutoff", F.date_sub(month_start(PERIOD), 1)
    )
    out = asof_backward(mapped, timeline, ["cik"], "cutoff", "filed", values)
    out = out.withColumn("age_days", F.datediff("cutoff", "filed"))
    return require_point_in_time(out) if strict else out


def _violates() -> Column:
    return F.coalesce(F.col("filed") >= month_start(PERIOD), F.lit(False))


def point_in_time_violations(attached: DataFrame) -> DataFrame:
    """Rows that carry a filing from the month itself or later; must be empty."""
    return attached.where(_violates())


def require_point_in_time(attached: DataFrame) -> DataFrame:
    """The same rows; reading one that carries a filing from the month itself or later is an error.

    The check is a filter, so no later projection removes it.
    """
    what = F.concat_ws(" ", F.lit("not known at the start of month"), F.col(PERIOD), F.lit("filed"), F.col("filed"))
    stop = F.raise_error(what).cast("boolean")
    return attached.where(F.when(_violates(), stop).otherwise(F.lit(True)))
