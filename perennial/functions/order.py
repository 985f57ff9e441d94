"""Exact order statistics inside groups that are too large for one task.

A month of a large panel can hold a sizeable share of all rows, so ``Window.partitionBy(month)``
would sort that month in one task.  These operators range-partition the rows by (group, order) and
store the result once with the number of each range.  Rows are then numbered inside their range, and
the sizes of the group's lower ranges are added.  Nothing a row carries depends on the size of the
data, and ranges only decide how the work is split, never the result.

A value shared by many rows is split over ranges by a hash of the row's identity; its average rank
follows from the counts at the ends of ranges.  Missing values come last.

Bounds: one row per (group, range) is broadcast, so as many as there are groups and partitions.  Use
these operators for few, large groups (months, one global order); for many small groups a plain window is right.

The range partitioner samples its input before the shuffle, so materialize a costly one first.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from perennial.functions.storage import materialize

#: Rows are split into no more ranges than this, unless a range would then exceed ``RANGE_ROWS``: every
#: range is a task, a file and a broadcast row.
RANGES = 256
RANGE_ROWS = 1 << 21
#: Rows of ranges that one task ranks, so that its sort does not grow with the data.
TASK_ROWS = 1 << 18


def _grouped(df: DataFrame, keys: Sequence[str]) -> tuple[DataFrame, list[str]]:
    if keys:
        return df, list(keys)
    return df.withColumn("_all", F.lit(0)), ["_all"]


def _ranges(
    rows: DataFrame, keys: Sequence[str], names: Sequence[str], rows_per_range: int | None
) -> DataFrame:
    """The rows with ``_range``, stored; ranges follow (keys, names).

    Without ``rows_per_range`` Spark sizes the partitions.  Ranges of many rows are larger than asked
    for, so that their number stays bounded (see ``RANGES``).
    """
    by = [*keys, *[F.col(n).asc_nulls_last() for n in names]]
    if rows_per_range is None:
        ranged = rows.repartitionByRange(*by)
    else:
        n = rows.count()
        most = max(RANGES, -(-n // RANGE_ROWS))
        ranged = rows.repartitionByRange(min(most, max(1, -(-n // rows_per_range))), *by)
    return materialize(ranged.withColumn("_range", F.spark_partition_id()), "ranges")


def _offsets(ranged: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of the group that precede each range, and the group's size."""
    sizes = ranged.groupBy(*keys, "_range").agg(F.count(F.lit(1)).alias("_n"))
    group = Window.partitionBy(*keys)
    before = group.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    return sizes.select(
        *keys,
        "_range",
        "_n",
        F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"),
        F.sum("_n").over(group).alias("_size"),
    )


def _ranged_by_row(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], rows_per_range: int | None
) -> tuple[DataFrame, list[str]]:
    names = [f"_o{i}" for i in range(len(order))]
    rows = df.select("*", *[c.alias(n) for c, n in zip(order, names)])
    return _ranges(rows, keys, names, rows_per_range), names


def _in_range(keys: Sequence[str], names: Sequence[str]):
    return Window.partitionBy(*keys, "_range").orderBy(*[F.col(n).asc_nulls_last() for n in names])


def with_positions(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column],
    position: str = "position",
    size: str | None = None,
    rows_per_range: int | None = None,
) -> DataFrame:
    """Add the 1-based place of every row in its group under a total ascending ``order``.

    ``order`` must end in columns that make a row unique; negate a number to sort it downwards.
    Group keys must not be null.
    """
    columns = df.columns
    rows, keys = _grouped(df, keys)
    ranged, names = _ranged_by_row(rows, keys, order, rows_per_range)
    placed = ranged.withColumn("_local", F.row_number().over(_in_range(keys, names))).join(
        F.broadcast(_offsets(ranged, keys)), [*keys, "_range"]
    )
    extra = [(F.col("_before") + F.col("_local")).cast("long").alias(position)]
    if size:
        extra.append(F.col("_size").cast("long").alias(size))
    return placed.select(*columns, *extra)


def with_average_rank(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    identity: Sequence[str],
    rank: str = "average_rank",
    size: str | None = None,
    percentile: str | None = None,
    rows_per_range: int | None = None,
) -> DataFrame:
    """Add the rank of ``value`` in its group, ties sharing the mean of their places.

    Rows with a null value keep null.
    """
    columns = df.columns
    rows, keys = _grouped(df, keys)
    rows = rows.withColumn("_salt", F.xxhash64(*identity))
    stored = _ranges(rows, keys, [value, "_salt"], rows_per_range)
    known = stored.where(F.col(value).isNotNull())
    offsets = _offsets(known, keys)
    ends = known.groupBy(*keys, "_range").agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"))
    crossing = (
        ends.select(*keys, F.explode(F.array_distinct(F.array("_lo", "_hi"))).alias(value))
        .groupBy(*keys, value)
        .agg(F.count(F.lit(1)).alias("_in"))
        .where("_in > 1")
        .drop("_in")
    )
    # rows before the value's first range are lower; in that range it is the highest
    shared = (
        known.join(F.broadcast(crossing), [*keys, value])
        .groupBy(*keys, value, "_range")
        .agg(F.count(F.lit(1)).alias("_equal"))
        .join(F.broadcast(offsets), [*keys, "_range"])
        .groupBy(*keys, value)
        .agg(
            F.min_by(F.col("_before") + F.col("_n") - F.col("_equal"), "_range").alias("_less"),
            F.sum("_equal").alias("_all_equal"),
        )
    )
    # both windows need the same order, so rows are sorted once
    upwards = Window.partitionBy(*keys, "_range").orderBy(value)
    same = Window.partitionBy(*keys, "_range", value)
    tasks = max(1, -(-stored.count() // TASK_ROWS))
    placed = (
        known.repartition(tasks, *keys, "_range")
        .withColumn("_first", F.rank().over(upwards))
        .withColumn("_ties", F.count(F.lit(1)).over(same))
        .join(F.broadcast(offsets), [*keys, "_range"])
        .join(F.broadcast(shared), [*keys, value], "left")
    )
    average = F.when(
        F.col("_less").isNotNull(), F.col("_less") + (F.col("_all_equal") + 1) / F.lit(2.0)
    ).otherwise(F.col("_before") + F.col("_first") + (F.col("_ties") - 1) / F.lit(2.0))
    extra = [(average, rank, "double")]
    if size:
        extra.append((F.col("_size"), size, "long"))
    if percentile:
        extra.append((average / F.col("_size"), percentile, "double"))
    missing = stored.where(F.col(value).isNull())
    return placed.select(*columns, *[c.cast(t).alias(n) for c, n, t in extra]).unionByName(
        missing.select(*columns, *[F.lit(None).cast(t).alias(n) for _, n, t in extra])
    )


def exact_quantiles(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    identity: Sequence[str],
    quantiles: dict[str, float],
    rows_per_range: int | None = None,
) -> DataFrame:
    """One row per group with linearly interpolated quantiles of the non-null values.

    Only the ranges that hold a wanted place are shuffled and sorted.
    """
    rows, keys = _grouped(df, keys)
    rows = rows.where(F.col(value).isNotNull()).select(
        *dict.fromkeys([*keys, value, *identity])
    )
    order = [F.col(value), *[F.col(c) for c in identity]]
    ranged, names = _ranged_by_row(rows, keys, order, rows_per_range)
    places = {n: 1 + (F.col("_size") - 1) * F.lit(q) for n, q in quantiles.items()}
    wanted = F.array_distinct(
        F.array(*[f(p).cast("long") for p in places.values() for f in (F.floor, F.ceil)])
    )
    inside = F.exists(
        wanted, lambda p: (p > F.col("_before")) & (p <= F.col("_before") + F.col("_n"))
    )
    needed = _offsets(ranged, keys).where(inside)
    local = _in_range(keys, names)
    placed = (
        ranged.join(F.broadcast(needed), [*keys, "_range"])
        .withColumn("_place", F.col("_before") + F.row_number().over(local))
        .where(F.array_contains(wanted, F.col("_place")))
    )

    def at(place: Column) -> Column:
        return F.max(F.when(F.col("_place") == place, F.col(value)))

    picked = placed.groupBy(*keys).agg(
        *[at(F.floor(p)).alias(f"_lo_{n}") for n, p in places.items()],
        *[at(F.ceil(p)).alias(f"_hi_{n}") for n, p in places.items()],
        *[F.max(p - F.floor(p)).alias(f"_part_{n}") for n, p in places.items()],
    )
    return picked.select(
        *[k for k in keys if k != "_all"],
        *[
            (
                F.col(f"_lo_{n}") + (F.col(f"_hi_{n}") - F.col(f"_lo_{n}")) * F.col(f"_part_{n}")
            ).alias(n)
            for n in quantiles
        ],
    )


def with_percentiles(
    df: DataFrame, keys: Sequence[str], identity: Sequence[str], ranks: dict[str, str]
) -> DataFrame:
    """Add percentile ranks (ties averaged) of several columns at once.

    ``ranks`` maps a column to the name of its rank.  The columns are ranked in long form, one pass
    for all of them; (keys, identity) must identify a row.  Materialize a costly input first.
    """
    ident = [*keys, *identity]
    long = df.select(
        *ident,
        F.inline(
            F.array(
                *[F.struct(F.lit(c).alias("_measure"), F.col(c).alias("_value")) for c in ranks]
            )
        ),
    )
    ranked = with_average_rank(
        long, [*keys, "_measure"], "_value", identity, percentile="_pct"
    )
    wide = ranked.groupBy(*ident).agg(
        *[F.max(F.when(F.col("_measure") == c, F.col("_pct"))).alias(n) for c, n in ranks.items()]
    )
    return df.join(wide, ident)
