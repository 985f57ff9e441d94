"""The shipped model versions, all months of the panel, with and without membership.

The SQL side solves every month's ridge by elimination: products of centred features are summed per
month, added up over the training months, scaled, and reduced row by row in a recursive table.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from checks import filing_queries as FQ
from checks import model_queries as MQ
from checks.feature_queries import FEATURES, SECTOR_CTES
from checks.inputs import MONTHS, table
from checks.registry import query
from perennial.functions.storage import materialize
from perennial.operators import asof as A
from perennial.operators import facts as FA
from perennial.operators import membership as MB
from perennial.plans import walkforward as WF

ALPHA = 10.0


def ridge_sql(source: str, features, target: str, min_rows: int) -> str:
    """CTEs up to ``scored``: rows of ``source`` with ``n_train`` and ``prediction``."""
    p = len(features)
    complete = " AND ".join(f"{f} IS NOT NULL" for f in features)
    values = ", ".join(f"CAST({f} AS DOUBLE)" for f in features)
    centres = ", ".join(f"avg(CAST({f} AS DOUBLE))" for f in features)
    return f"""
rs AS MATERIALIZED (SELECT *, [{values}] AS xs, CAST({target} AS DOUBLE) AS y FROM {source} WHERE {complete}),
rc AS MATERIALIZED (SELECT [{centres}] AS c, avg({target}) AS cy FROM rs),
rm AS (SELECT period_idx, list_concat(list_concat([1.0::DOUBLE],
  list_transform(range(1, {p + 1}), lambda i: xs[i] - c[i])), [y - cy]) AS z FROM rs, rc WHERE y IS NOT NULL),
rg AS MATERIALIZED (SELECT period_idx, a.i, b.j, sum(z[a.i] * z[b.j]) AS s FROM rm, range(1, {p + 3}) a(i),
  range(1, {p + 3}) b(j) WHERE a.i <= b.j GROUP BY ALL),
rt AS (SELECT period_idx AS t FROM rs WHERE period_idx BETWEEN (SELECT min(period_idx) + 1 FROM {source})
  AND (SELECT max(period_idx) FROM {source}) GROUP BY 1 HAVING count(*) >= {min_rows}),
rw AS MATERIALIZED (SELECT t, i, j, sum(s) AS s FROM rt JOIN rg ON period_idx BETWEEN t - {MQ.TRAIN_MONTHS} AND t - 1
  GROUP BY ALL),
r1 AS (SELECT a.t, a.j AS i, a.s / n.s AS mean, n.s AS n FROM rw a JOIN rw n ON n.t = a.t AND n.i = 1 AND n.j = 1
  WHERE a.i = 1),
rv AS (SELECT w.t, w.i, w.j, w.s - x.mean * y.mean * x.n AS v FROM rw w JOIN r1 x ON x.t = w.t AND x.i = w.i
  JOIN r1 y ON y.t = w.t AND y.i = w.j WHERE w.i >= 2),
rd AS (SELECT v.t, v.i, CASE WHEN v.i <= {p + 1} AND v.v > 1e-12 * m.n * (m.mean * m.mean + c[v.i - 1] * c[v.i - 1])
  THEN sqrt(v.v / m.n) END AS d FROM rv v JOIN r1 m ON m.t = v.t AND m.i = v.i, rc WHERE v.i = v.j),
rh AS (SELECT v.t, v.i, v.j, CASE WHEN v.j = {p + 2} THEN coalesce(v.v / x.d, 0)
  ELSE coalesce(v.v / (x.d * y.d), 0) + CASE WHEN v.i = v.j THEN {ALPHA} ELSE 0 END END AS a
  FROM rv v JOIN rd x ON x.t = v.t AND x.i = v.i JOIN rd y ON y.t = v.t AND y.i = v.j WHERE v.i <= {p + 1}),
rf AS (SELECT t, i, j, a FROM rh UNION ALL SELECT t, j, i, a FROM rh WHERE i < j AND j <= {p + 1}),
ra AS (SELECT t, list(r ORDER BY i) AS m FROM (SELECT t, i, list(a ORDER BY j) AS r FROM rf GROUP BY t, i) GROUP BY t),
re AS (WITH RECURSIVE e(t, k, m) AS (SELECT t, 1, m FROM ra UNION ALL
  SELECT t, k + 1, list_transform(m, lambda r, i: CASE WHEN i = k THEN list_transform(r, lambda x: x / r[k])
    ELSE list_transform(r, lambda x, j: x - r[k] * m[k][j] / m[k][k]) END) FROM e WHERE k <= {p})
  SELECT t, list_transform(m, lambda r: r[{p + 1}]) AS w FROM e WHERE k = {p + 1}),
rq AS (SELECT t, list(mean ORDER BY i) AS means, any_value(n) AS n FROM r1 GROUP BY t),
rb AS (SELECT t, list(coalesce(w[i - 1] / d, 0) ORDER BY i) AS b FROM rd JOIN re USING (t) WHERE i <= {p + 1} GROUP BY t),
scored AS (SELECT s.*, CAST(q.n AS BIGINT) AS n_train, cy + means[{p + 2}] + list_sum(list_transform(range(1, {p + 1}),
  lambda i: b[i] * (xs[i] - c[i] - means[i + 1]))) AS prediction
  FROM rs s JOIN rq q ON q.t = s.period_idx JOIN rb USING (t), rc)"""


def prepared_sql(version: str) -> str:
    """From ``src`` to ``prep``: targets and standardised features of a version."""
    residual = f"prep AS (SELECT *, {MQ.z_sql('residual')} AS residual_target FROM src)"
    neutral = MQ.neutral_sql("src", "bn", "ret", "beta_neutral_return", "beta_neutral_target", MQ.MIN_ROWS)
    spec = WF.MODELS[version]
    if version == "v3":
        return "prep AS (SELECT * FROM src)"
    if version == "v5":
        return residual
    if version == "v6":
        names = [f.removeprefix("cs_") for f in spec.features]
        return residual.replace(
            "SELECT *,", "SELECT *, " + ", ".join(f"{MQ.z_sql(f)} AS cs_{f}" for f in names) + ","
        )
    if version in ("v7", "v8"):
        return f"{neutral}, prep AS (SELECT * FROM bn)"
    names = [f.removeprefix("cs_") for f in spec.features if f.startswith("cs_")]
    return f"{neutral}, prep AS ({MQ.winsor_sql(names, 'bn')})"


def ranked_sql(version: str) -> str:
    spec = WF.MODELS[version]
    score = "prediction / (idio_volatility_6m + 0.02)" if version == "v3" else "prediction"
    share = ", 1 - (rank - 1) / cnt AS percentile" if version != "v3" else ", score AS quality"
    return ridge_sql("prep", spec.features, spec.target, spec.min_test_rows) + f""",
preds AS (SELECT *{share} FROM (SELECT *, row_number() OVER (PARTITION BY period_idx ORDER BY score DESC, ticker) AS rank,
  count(*) OVER (PARTITION BY period_idx) AS cnt FROM (SELECT *, {score} AS score FROM scored)))"""


SECTOR_PANEL = FEATURES + SECTOR_CTES.removeprefix(MONTHS) + """,
src AS (SELECT p.*, s.* EXCLUDE (ticker, period_idx, period, sector_relative, selected_sector, selected_sector_ret)
  FROM panel p LEFT JOIN secfeat s USING (ticker, period_idx))"""


def _facts_panel(timeline_ctes: str, timeline: str, features) -> str:
    columns = ", ".join("t." + f for f in features)
    return FEATURES + "," + timeline_ctes.removeprefix(",") + f""",
src AS (SELECT p.*, {columns} FROM (SELECT *, CAST(ticker AS BIGINT) AS cik,
    make_date((period_idx // 12)::INT, (period_idx % 12 + 1)::INT, 1) - 1 AS cutoff FROM panel) p
  ASOF LEFT JOIN {timeline} t ON t.cik = p.cik AND t.filed <= p.cutoff)"""


SOURCES = {
    "v8": SECTOR_PANEL,
    "v8b": _facts_panel(FQ.ANNUAL_TL, "annual_tl", FA.ANNUAL_FEATURES),
    "v8c": _facts_panel(FQ.QUARTER_TL, "quarter_tl", FA.QUARTERLY_FEATURES),
}
PLAIN = FEATURES + ", src AS (SELECT * FROM panel)"


def source(spark, sf, version: str):
    if version == "v8":
        return MQ.model_panel(spark, sf)
    if version not in ("v8b", "v8c"):
        return MQ.panel(spark, sf)
    rows = FQ.fact_rows(spark, sf)
    annual = version == "v8b"
    timeline = FA.annual_timeline(rows) if annual else FA.quarterly_timeline(rows)
    ids = table(spark, sf, "supplier").select(
        F.col("s_suppkey").cast("string").alias("ticker"), F.col("s_suppkey").alias("cik")
    )
    # what the models and their targets read besides the fundamentals
    months = MQ.panel(spark, sf).select("ticker", "period_idx", "ret", "beta_24m")
    return A.attach_point_in_time(
        months, ids, materialize(timeline, "timeline"),
        FA.ANNUAL_FEATURES if annual else FA.QUARTERLY_FEATURES,
    )


def _spec(version: str) -> str:
    return f"{MQ.ID} n_train:i prediction:d rank:i " + ("quality:d" if version == "v3" else "percentile:d")


def _register(version: str) -> None:
    @query(
        f"walk_forward_{version}",
        _spec(version),
        f"{SOURCES.get(version, PLAIN)},\n{prepared_sql(version)},{ranked_sql(version)}",
        "SELECT * FROM preds",
    )
    def run(spark, sf):
        rows = materialize(source(spark, sf, version), "source")
        return WF.run_walk_forward(rows, version, *MQ.span(rows), training_months=MQ.TRAIN_MONTHS, keep=())


for _version in WF.MODELS:
    _register(_version)


_V7 = f"{PLAIN},\n{prepared_sql('v7')},{ranked_sql('v7')}"
#: This version is measured by its residual return.
_MEASURED = (
    MQ.MONTHLY.removeprefix(MQ.PREDS).replace("beta_neutral_target", "residual").replace("beta_neutral_return", "residual")
)


@query(
    "diagnostics_v7",
    MQ.MONTHLY_SPEC,
    _V7 + _MEASURED,
    "SELECT * FROM monthly",
)
def diagnostics_v7(spark, sf):
    rows = MQ.panel(spark, sf)
    found = WF.run_walk_forward(rows, "v7", *MQ.span(rows), training_months=MQ.TRAIN_MONTHS)
    return WF.diagnose(materialize(found, "ranked"), "v7")


# Membership of suppliers, from their largest shipments: odd lines add, even lines remove.
MEMBERS = """
mchg AS (SELECT CAST(l_shipdate AS DATE) AS date, CAST(l_suppkey AS VARCHAR) AS ticker, l_linenumber % 2 = 0 AS removed
  FROM lineitem WHERE l_quantity = 50),
mnow AS (SELECT CAST(s_suppkey AS VARCHAR) AS ticker FROM supplier WHERE s_suppkey % 4 <> 0),
mall AS (SELECT ticker FROM mchg UNION SELECT ticker FROM mnow),
mdays AS (SELECT unnest(generate_series(date_trunc('month', (SELECT min(date) FROM mchg)),
  date_trunc('month', (SELECT max(date) FROM mchg)), INTERVAL 1 MONTH))::DATE AS day),
mlater AS (SELECT day, ticker, arg_min(removed, date) AS was FROM mdays
  JOIN (SELECT ticker, date, bool_or(removed) AS removed FROM mchg GROUP BY 1, 2) ON date > day GROUP BY 1, 2),
mem AS (SELECT year(day) * 12 + month(day) - 1 AS period_idx, ticker FROM mall CROSS JOIN mdays
  LEFT JOIN mlater USING (day, ticker) WHERE coalesce(was, ticker IN (SELECT ticker FROM mnow)))"""


def members(spark, sf):
    """Membership of every month from the first to the last change."""
    ticker = F.col("l_suppkey").cast("string")
    even = F.col("l_linenumber") % 2 == 0
    changes = table(spark, sf, "lineitem").where("l_quantity = 50").select(
        F.col("l_shipdate").cast("date").alias("date"),
        F.when(~even, ticker).alias("added"),
        F.when(even, ticker).alias("removed"),
    )
    current = table(spark, sf, "supplier").where("s_suppkey % 4 <> 0").select(
        F.col("s_suppkey").cast("string").alias("ticker")
    )
    first, last = changes.agg(F.min("date"), F.max("date")).first()
    return MB.membership_map(current, changes, first, last, last + dt.timedelta(1))


def _register_members(version: str) -> None:
    @query(
        f"walk_forward_{version}_members",
        _spec(version),
        SOURCES.get(version, PLAIN).replace("src AS (", "unfiltered AS (")
        + f",\n{MEMBERS},\nsrc AS (SELECT * FROM unfiltered SEMI JOIN mem USING (period_idx, ticker)),\n"
        + f"{prepared_sql(version)},{ranked_sql(version)}",
        "SELECT * FROM preds",
    )
    def run(spark, sf):
        rows = WF.store_by_month(source(spark, sf, version))
        membership = members(spark, sf)
        first, last = MQ.span(rows.join(membership, ["period_idx", "ticker"], "left_semi"))
        return WF.run_walk_forward(
            rows, version, first, last, membership=membership, training_months=MQ.TRAIN_MONTHS, keep=()
        )


for _version in ("v5", "v8c"):
    _register_members(_version)
