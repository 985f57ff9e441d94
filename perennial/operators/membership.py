"""Index membership from the current members and a change log.

Membership at a date is the current set with later changes undone.  Per ticker the earliest later
change decides: before an addition it was out, before a removal it was in.  So each change closes an
interval that starts at the ticker's previous change; no date is replayed.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from perennial.functions.columns import month_index, normalize_ticker

BEGINNING = dt.date(1900, 1, 1)


def clean_changes(changes: DataFrame) -> DataFrame:
    """Dated changes with normalised tickers; other columns are kept."""
    return changes.withColumns(
        {
            "date": F.col("date").cast("date"),
            "added": normalize_ticker("added"),
            "removed": normalize_ticker("removed"),
        }
    ).where(F.col("date").isNotNull())


def change_actions(changes: DataFrame) -> DataFrame:
    """(date, ticker, action): one row per added or removed ticker."""
    sides = F.array(
        F.struct(F.col("added").alias("ticker"), F.lit("added").alias("action")),
        F.struct(F.col("removed").alias("ticker"), F.lit("removed").alias("action")),
    )
    return (
        clean_changes(changes)
        .select("date", F.inline(sides))
        .where(F.col("ticker").isNotNull() & (F.col("ticker") != ""))
    )


def membership_intervals(current: DataFrame, changes: DataFrame, today: dt.date) -> DataFrame:
    """(ticker, from_date, to_date): membership on from_date <= d < to_date.

    A ticker both added and removed on one date counts as removed, that is a member before it.
    After the per-day aggregation a ticker has at most one change per calendar day.
    """
    daily = (
        change_actions(changes)
        .where(F.col("date") <= F.lit(today))
        .groupBy("ticker", "date")
        .agg(F.bool_or(F.col("action") == "removed").alias("was_member"))
    )
    last = daily.groupBy("ticker").agg(F.max("date").alias("from_date"))
    start = F.lit(BEGINNING)
    w = Window.partitionBy("ticker").orderBy("date")
    closed = daily.select(
        "ticker",
        F.coalesce(F.lag("date").over(w), start).alias("from_date"),
        F.col("date").alias("to_date"),
        "was_member",
    ).where("was_member").drop("was_member")
    now = current.select(normalize_ticker("ticker").alias("ticker")).where(
        F.col("ticker") != ""
    ).distinct()
    open_ended = now.join(last, "ticker", "left").select(
        "ticker",
        F.coalesce("from_date", start).alias("from_date"),
        F.date_add(F.lit(today), 1).alias("to_date"),
    )
    return closed.unionByName(open_ended)


def membership_at(
    current: DataFrame, changes: DataFrame, as_of: dt.date, today: dt.date
) -> DataFrame:
    """Members on ``as_of``, which must not lie after ``today``."""
    if as_of > today:
        raise ValueError("cannot reconstruct future membership")
    day = F.lit(as_of)
    return (
        membership_intervals(current, changes, today)
        .where((F.col("from_date") <= day) & (day < F.col("to_date")))
        .select("ticker")
        .distinct()
    )


def membership_map(
    current: DataFrame, changes: DataFrame, start: dt.date, end: dt.date, today: dt.date
) -> DataFrame:
    """(period_idx, ticker): members on the first day of every month from ``start`` to ``end``."""
    if end.replace(day=1) > today:
        raise ValueError("cannot reconstruct future membership")
    first = F.greatest(F.col("from_date"), F.lit(start.replace(day=1)))
    first = F.when(F.dayofmonth(first) == 1, first).otherwise(
        F.add_months(F.trunc(first, "month"), 1)
    )
    last = F.least(F.date_sub("to_date", 1), F.lit(end))
    months = membership_intervals(current, changes, today).select(
        "ticker", first.alias("_first"), last.alias("_last")
    ).where(F.col("_first") <= F.col("_last"))
    each = F.sequence(month_index("_first"), month_index("_last"))
    return months.select(F.explode(each).alias("period_idx"), "ticker").distinct()


def membership_union(
    current: DataFrame, changes: DataFrame, start: dt.date, today: dt.date
) -> DataFrame:
    """Every ticker that is a member now or changed since ``start``."""
    moved = change_actions(changes).where(F.col("date").between(F.lit(start), F.lit(today)))
    now = current.select(normalize_ticker("ticker").alias("ticker")).where(F.col("ticker") != "")
    return now.unionByName(moved.select("ticker")).distinct()


def ticker_names(current: DataFrame, changes: DataFrame) -> DataFrame:
    """(ticker, names): sorted distinct company names from the current list and the change log."""
    sides = F.array(
        F.struct(F.col("added").alias("ticker"), F.col("added_security").alias("name")),
        F.struct(F.col("removed").alias("ticker"), F.col("removed_security").alias("name")),
    )
    pairs = current.select("ticker", F.col("security").alias("name")).unionByName(
        clean_changes(changes).select(F.inline(sides))
    )
    return (
        pairs.select(normalize_ticker("ticker").alias("ticker"), F.trim("name").alias("name"))
        .where((F.col("ticker") != "") & (F.col("name") != "") & (F.lower("name") != "nan"))
        .distinct()
        .groupBy("ticker")
        .agg(F.array_sort(F.collect_list("name")).alias("names"))
    )
