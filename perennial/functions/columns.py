"""Scalar column expressions (all JVM-side)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Legal-form words dropped from the end of a company name, in two passes.
LEGAL_SUFFIXES = (
    "INC", "INCORPORATED", "CORP", "CORPORATION", "CO", "COMPANY",
    "LTD", "LIMITED", "LLC", "PLC", "LP",
)
TRAILING_MARKERS = ("DE", "NEW", "NV")


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def month_index(d: Column | str) -> Column:
    """Months since year 0; consecutive calendar months differ by one."""
    d = _col(d)
    return (F.year(d) * 12 + F.month(d) - 1).cast("int")


def month_start(idx: Column | str) -> Column:
    """First day of the month with this ``month_index``."""
    idx = _col(idx)
    return F.make_date(F.floor(idx / 12).cast("int"), (idx % 12 + 1).cast("int"), F.lit(1))


def calendar_date(year: Column | str, month: Column | str, day: Column | str) -> Column:
    """The date, or null where the calendar has no such day (Feb 29)."""
    text = F.format_string(
        "%04d-%02d-%02d", _col(year).cast("int"), _col(month).cast("int"), _col(day).cast("int")
    )
    return F.try_to_date(text, "yyyy-MM-dd")


def parse_date(c: Column | str) -> Column:
    """ISO date text to DATE, null where it does not parse.

    Text of the usual shape is cast, which is far cheaper than reading it by a pattern.
    """
    c = _col(c)
    usual = c.rlike("^[1-9][0-9]{3}-[0-9]{2}-[0-9]{2}\\z")
    return F.when(usual, c.try_cast("date")).otherwise(F.try_to_date(c, "yyyy-MM-dd"))


def normalize_ticker(c: Column | str) -> Column:
    """Non-breaking spaces to blanks, trim, upper, cut at the first ``|``, dots to dashes."""
    value = F.upper(F.trim(F.translate(_col(c), "\u00a0", " ")))
    value = F.trim(F.split_part(value, F.lit("|"), F.lit(1)))
    return F.translate(value, ".", "-")


def normalize_company_name(c: Column | str) -> Column:
    """Upper-case words only, without trailing legal forms, then without trailing markers."""
    value = F.replace(F.upper(_col(c)), F.lit("&"), F.lit(" AND "))
    value = F.trim(F.regexp_replace(value, "[^A-Z0-9]+", " "))
    for words in (LEGAL_SUFFIXES, TRAILING_MARKERS):
        value = F.regexp_replace(value, "(?:(?:^| )(?:" + "|".join(words) + "))+$", "")
    return F.trim(value)


def safe_ratio(numerator: Column | str, denominator: Column | str) -> Column:
    """Quotient; null when an input is null or the denominator is zero."""
    return F.try_divide(_col(numerator), _col(denominator))


def safe_growth(current: Column | str, previous: Column | str) -> Column:
    return safe_ratio(current, previous) - F.lit(1.0)


def is_missing(c: Column | str) -> Column:
    """1.0 where null, else 0.0."""
    return _col(c).isNull().cast("double")


def null_if_nan(c: Column | str) -> Column:
    """The engine's only missing value is NULL; apply this at ingest."""
    c = _col(c)
    return F.when(~F.isnan(c), c)


def wilson_lower_bound(wins: Column | str, total: Column | str, z: float = 1.96) -> Column:
    """Lower end of the Wilson score interval; 0 for an empty sample."""
    k, n = _col(wins).cast("double"), _col(total).cast("double")
    p = F.try_divide(k, n)
    z2 = z * z
    centre = p + F.try_divide(F.lit(z2), 2 * n)
    spread = z * F.sqrt(F.try_divide(p * (1 - p), n) + F.try_divide(F.lit(z2), 4 * n * n))
    bound = F.try_divide(centre - spread, 1 + F.try_divide(F.lit(z2), n))
    return F.when(n > 0, bound).otherwise(F.lit(0.0))
