"""Mixing sources to target weights.

Words are summed per source, which gives each source a target and a repetition rate (target over
size).  Every document is emitted floor(rate) times plus once more if a hash of its key, read as a
number in [0, 1), is below the fraction.  Only sums per source are shuffled, after a partial sum in
every task, so a source that holds most rows costs no more than another; the draw needs no shuffle.

Shares: sources in order of code points (null last) weigh 1, 2, 3, repeating.  A source gets at
most ``most`` times its size; what exceeds that is shared by weight among the others until none is
above.  With r = most * size / weight ascending, the sources that reach their bound are those at the
start of that order, so running sums find the level in one pass over the sources.

Rules for special cases: a null or empty text has size 0 and is taken once or not, with 0 words; a
source without words has target 0 and rate 0; a null source is a source of its own; a row with a
null key draws by its text; repeated rows have the same draw, so reruns and retried tasks agree; an
empty table gives no rows.  Columns of the input with the names of results are replaced.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from perennial.functions.storage import materialize
from perennial.llm.textops import unused

#: Anything but the six ASCII white space characters.
WORD = r"[^\x20\x09-\x0D]+"
#: Targets of so many sources are sent to every executor (some 60 MB); more are joined by a shuffle.
MOST_SOURCES_SENT = 500_000
RESULTS = ("size", "source_size", "target", "rate", "copies", "taken")


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def unit_draw(seed: str, key: Column, text: Column) -> Column:
    """A number in [0, 1) from the first 52 bits of a hash."""
    name = F.concat(F.lit(seed), F.coalesce(key.cast("string"), text, F.lit("")))
    return F.conv(F.substring(F.md5(name), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def source_targets(sizes: DataFrame, weights: Sequence[int] = (1, 2, 3), most: int = 3) -> DataFrame:
    """Targets for one row per ``source`` with its ``source_size``; they add up to all sizes.

    The windows run over sources, not documents.
    """
    by_name = Window.orderBy(F.col("source").isNull(), F.col("source"))
    cycle = F.array(*[F.lit(w) for w in weights])
    place = F.row_number().over(by_name) - 1
    weighed = sizes.select(
        "source",
        "source_size",
        F.element_at(cycle, (place % len(weights) + 1).cast("int")).cast("long").alias("weight"),
        place.alias("place"),
    ).withColumn("bound", F.col("source_size") * most)
    filling = Window.orderBy(F.col("bound") / F.col("weight"), "place")
    earlier = filling.rowsBetween(Window.unboundedPreceding, -1)
    later = filling.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everything = Window.orderBy(F.lit(0)).rowsBetween(
        Window.unboundedPreceding, Window.unboundedFollowing
    )
    level = (
        (F.sum("source_size").over(everything) - F.coalesce(F.sum("bound").over(earlier), F.lit(0)))
        * F.col("weight")
    ).cast("double") / F.sum("weight").over(later)
    reached = F.col("bound") <= level
    stepped = weighed.select(
        "source",
        "source_size",
        "weight",
        "bound",
        reached.alias("reached"),
        F.sum("source_size").over(everything).alias("whole"),
    )
    totals = stepped.select(
        "*",
        F.sum(F.when(F.col("reached"), F.col("bound")).otherwise(0)).over(everything).alias("full"),
        F.sum(F.when(F.col("reached"), 0).otherwise(F.col("weight")))
        .over(everything)
        .alias("open_weight"),
    )
    share = ((F.col("whole") - F.col("full")) * F.col("weight")).cast("double") / F.nullif(
        F.col("open_weight"), F.lit(0)
    )
    return totals.select(
        "source",
        "source_size",
        F.when(F.col("reached"), F.col("bound").cast("double")).otherwise(share).alias("target"),
    )


def mixture_plan(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    source: str = "source",
    weights: Sequence[int] = (1, 2, 3),
    most: int = 3,
    seed: str = "mix:",
) -> DataFrame:
    """Every row with ``size``, ``source_size``, ``target`` and ``rate`` of its source, ``copies``
    (how often the mix holds it) and ``taken`` (copies times size)."""
    names = {c: unused(docs, f"_{c}_m") for c in ("size", "draw", "source", "source_size", "target", "rate")}
    rows = docs.withColumn(names["size"], word_count(F.col(f"`{text}`"))).withColumn(
        names["draw"], unit_draw(seed, F.col(f"`{key}`"), F.col(f"`{text}`"))
    )
    sizes = docs.groupBy(F.col(f"`{source}`").alias("source")).agg(
        F.sum(word_count(F.col(f"`{text}`"))).alias("source_size")
    )
    table = materialize(source_targets(sizes, weights, most), "targets")
    targets = table.select(
        F.col("source").alias(names["source"]),
        F.col("source_size").alias(names["source_size"]),
        F.col("target").alias(names["target"]),
        F.least(
            F.lit(float(most)),
            F.coalesce(F.col("target") / F.nullif(F.col("source_size"), F.lit(0)), F.lit(0.0)),
        ).alias(names["rate"]),
    )
    if table.count() <= MOST_SOURCES_SENT:
        targets = F.broadcast(targets)
    joined = rows.join(targets, F.col(f"`{source}`").eqNullSafe(F.col(names["source"])), "left")
    whole = F.floor(names["rate"])
    extra = (F.col(names["draw"]) < F.col(names["rate"]) - whole).cast("long")
    kept = [F.col(f"`{c}`") for c in docs.columns if c not in RESULTS]
    return joined.select(
        *kept,
        F.col(names["size"]).alias("size"),
        F.col(names["source_size"]).alias("source_size"),
        F.col(names["target"]).alias("target"),
        F.col(names["rate"]).alias("rate"),
        (whole + extra).alias("copies"),
    ).withColumn("taken", F.col("copies") * F.col("size"))


def emit_copies(plan: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The mix itself: each row of ``mixture_plan`` as often as ``copies`` says."""
    spare = unused(plan, "_copy")
    again = F.array_repeat(F.lit(1), F.col("copies").cast("int"))
    return (
        plan.where(F.col("copies") > 0)
        .select(*[F.col(f"`{c}`") for c in columns], F.explode(again).alias(spare))
        .drop(spare)
    )
