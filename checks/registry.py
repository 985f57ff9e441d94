"""Registration of a query together with its output columns and its SQL equivalent.

``columns`` lists the result as ``name:kind`` with kind ``i`` (integer), ``s`` (text), ``t`` (date, as
ISO text), ``b`` (boolean) or ``d`` (double).  Doubles are rounded to 6 places, or to single precision
from 1000 up, on both sides because the order of summation differs; a small shift keeps exact halves
from going either way.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
#: Module that registered a query.
HOMES: dict[str, str] = {}


def _spec(columns: str) -> list[tuple[str, str]]:
    return [tuple(c.split(":")) for c in columns.split()]


def present(df: DataFrame, columns: str) -> DataFrame:
    out = []
    for name, kind in _spec(columns):
        c = F.col(name)
        if kind == "d":
            c = F.expr(
                f"CASE WHEN abs(`{name}`) < 1000 THEN round(double(`{name}`) + 1e-9D, 6) + 0D "
                f"ELSE double(float(`{name}`)) END"
            )
        elif kind == "i":
            c = c.cast("bigint")
        elif kind in "ts":
            c = c.cast("string")
        else:
            c = c.cast("boolean")
        out.append(c.alias(name))
    return df.select(*out)


def present_sql(ctes: str, body: str, columns: str) -> str:
    out = []
    for name, kind in _spec(columns):
        q = f'"{name}"'
        c = {
            "d": f"CASE WHEN abs({q}) < 1000 THEN round(CAST({q} AS DOUBLE) + 1e-9, 6) + 0.0 "
            f"ELSE CAST(CAST({q} AS FLOAT) AS DOUBLE) END",
            "i": f"CAST({q} AS BIGINT)",
            "t": f"CAST(CAST({q} AS DATE) AS VARCHAR)",
            "s": f"CAST({q} AS VARCHAR)",
            "b": f"CAST({q} AS BOOLEAN)",
        }[kind]
        out.append(f"{c} AS {q}")
    head = f"WITH {ctes} " if ctes else ""
    return f"{head}SELECT {', '.join(out)} FROM ({body}) AS result"


def query(name: str, columns: str, ctes: str | None = None, sql: str | None = None):
    """Decorator: register ``fn(spark, sf_dir)``; without ``sql`` only rows are checked."""

    def wrap(fn: Query) -> Query:
        HOMES[name] = fn.__module__
        QUERIES[name] = lambda spark, sf_dir: present(fn(spark, sf_dir), columns)
        if sql is not None:
            ORACLES[name] = present_sql(ctes or "", sql, columns)
        return fn

    return wrap
