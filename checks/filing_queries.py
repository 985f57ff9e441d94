"""Filings, timelines, as-of joins, membership and identifier resolution.

Company facts are derived from ``lineitem``: the supplier is the company, the ship date the filing
date, and part and order keys choose tag, period and form.  In Spark they are nested, written as JSON
text and parsed again; the SQL side works on the flat form.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from checks.inputs import spread, table
from checks.registry import query
from perennial.functions.columns import (
    calendar_date,
    month_index,
    normalize_company_name,
    normalize_ticker,
)
from perennial.functions.storage import materialize
from perennial.operators import asof as A
from perennial.operators import crosssection as CS
from perennial.operators import facts as FA
from perennial.operators import membership as MB
from perennial.operators import resolve as RS
from perennial.plans import walkforward as WF
from perennial.sources import filings as SF
from perennial.sources import prices as SP

TAGS = [t for tags in FA.CONCEPT_ALIASES.values() for t in tags]
SHARE_TAGS = FA.CONCEPT_ALIASES["Diluted Shares"]
BALANCE_TAGS = [
    t for c in ("Assets", "Liabilities", "Equity") for t in FA.CONCEPT_ALIASES[c]
]


def company_documents(spark, sf, parts: int = 1):
    """(cik, part, value): JSON documents, with the tags of a company dealt to so many of them."""
    items = table(spark, sf, "lineitem")
    kind = (F.col("l_orderkey") + F.col("l_linenumber")) % 3
    ship = F.col("l_shipdate").cast("date")
    year = F.year(ship)
    tag = F.array(*[F.lit(t) for t in TAGS])[(F.col("l_partkey") % len(TAGS)).cast("int")]
    end = (
        F.when(kind == 2, F.make_date(year - 1, F.lit(12), F.lit(31)))
        .when(kind == 1, F.make_date(F.when(F.month(ship) >= 10, year).otherwise(year - 1), F.lit(9), F.lit(30)))
        .otherwise(F.date_sub(F.trunc(ship, "quarter"), 1))
    )
    days = F.when(kind == 2, 364).when(kind == 1, 273).otherwise(90)
    amended = F.when(F.col("l_returnflag") == "A", F.lit("/A")).otherwise(F.lit(""))
    form = F.when(F.col("l_quantity") == 13, F.lit("8-K")).otherwise(
        F.concat(F.when(kind == 2, F.lit("10-K")).otherwise(F.lit("10-Q")), amended)
    )
    place = F.array_position(F.array(*[F.lit(t) for t in TAGS]), tag) - 1
    flat = items.select(
        F.col("l_suppkey").alias("cik"),
        (place % parts).alias("part"),
        tag.alias("tag"),
        F.struct(
            F.when(~tag.isin(*BALANCE_TAGS), F.date_sub(end, days)).cast("string").alias("start"),
            end.cast("string").alias("end"),
            F.col("l_extendedprice").alias("val"),
            ship.cast("string").alias("filed"),
            form.alias("form"),
            F.concat_ws("-", "l_orderkey", "l_linenumber").alias("accn"),
        ).alias("o"),
    )
    # one shuffle; a company's values are dealt to its tags afterwards
    values = flat.groupBy("cik", "part").agg(F.collect_list(F.struct("tag", "o")).alias("values"))

    def reported(tag):
        unit = F.when(tag.isin(*SHARE_TAGS), F.lit("shares")).otherwise(F.lit("USD"))
        own = F.transform(F.filter("values", lambda v: v["tag"] == tag), lambda v: v["o"])
        return F.struct(tag, F.struct(F.create_map(unit, own).alias("units")))

    nested = values.select(
        "cik", "part", F.map_from_entries(F.transform(F.array_distinct("values.tag"), reported)).alias("tags")
    )
    return nested.select(
        "cik",
        "part",
        F.to_json(
            F.struct(
                "cik",
                F.concat(F.lit("Company "), F.col("cik").cast("string")).alias("entityName"),
                F.create_map(F.lit(FA.NAMESPACE), F.col("tags")).alias("facts"),
            )
        ).alias("value"),
    )


def company_facts(spark, sf):
    """(cik, entityName, facts) parsed from JSON text."""
    return SF.parse_company_facts(company_documents(spark, sf))


def fact_rows(spark, sf):
    return FA.fact_rows(company_facts(spark, sf))


def text_list(values) -> str:
    return ", ".join(f"'{v}'" for v in values)


ALIASES = ", ".join(
    f"('{c}', {i}, '{t}')" for c, tags in FA.CONCEPT_ALIASES.items() for i, t in enumerate(tags)
)
FLAT = f"""
alias(concept, priority, tag) AS (VALUES {ALIASES}),
raw AS (SELECT *, (l_orderkey + l_linenumber) % 3 AS kind, CAST(l_shipdate AS DATE) AS ship,
  list_extract([{text_list(TAGS)}], (l_partkey % {len(TAGS)} + 1)::INT) AS tag FROM lineitem),
dated AS (SELECT *, CASE WHEN kind = 2 THEN make_date(year(ship) - 1, 12, 31)
  WHEN kind = 1 THEN make_date(CASE WHEN month(ship) >= 10 THEN year(ship) ELSE year(ship) - 1 END, 9, 30)
  ELSE CAST(date_trunc('quarter', ship) AS DATE) - 1 END AS "end",
  CASE WHEN kind = 2 THEN 364 WHEN kind = 1 THEN 273 ELSE 90 END AS days FROM raw),
facts AS (SELECT l_suppkey AS cik, concat('Company ', l_suppkey) AS entity, concept, priority, d.tag,
  CASE WHEN d.tag IN ({text_list(SHARE_TAGS)}) THEN 'shares' ELSE 'USD' END AS unit,
  CASE WHEN d.tag NOT IN ({text_list(BALANCE_TAGS)}) THEN "end" - days::INT END AS start, "end",
  l_extendedprice AS val, ship AS filed,
  CASE WHEN l_quantity = 13 THEN '8-K' ELSE concat(CASE WHEN kind = 2 THEN '10-K' ELSE '10-Q' END,
    CASE WHEN l_returnflag = 'A' THEN '/A' ELSE '' END) END AS form,
  concat(l_orderkey, '-', l_linenumber) AS accn FROM dated d JOIN alias USING (tag))"""
FACT_SPEC = """cik:i entity:s concept:s priority:i tag:s unit:s start:t end:t val:d filed:t form:s accn:s"""


@query("company_facts_json", FACT_SPEC, FLAT, "SELECT * FROM facts")
def company_facts_json(spark, sf):
    return FA.fact_rows(company_facts(spark, sf))


OBS_SPEC = "cik:i concept:s tag:s priority:i value:d start:t end:t filed:t form:s accn:s"
ANNUAL = FLAT + f""",
annual AS (SELECT DISTINCT cik, entity, concept, tag, priority, val AS value, start, "end", filed, form, accn
  FROM facts WHERE form IN ('10-K', '10-K/A') AND (
    (concept IN ({text_list(FA.ANNUAL_FLOWS)}) AND "end" - start BETWEEN 300 AND 400)
    OR concept IN ('Assets', 'Equity')))"""


@query("annual_observations", OBS_SPEC, ANNUAL, "SELECT * FROM annual")
def annual_observations(spark, sf):
    return FA.annual_observations(fact_rows(spark, sf))


# The value of (company, concept, period end) as known on a date, by ordering all earlier filings.
VALUE_AS_OF = """(SELECT value FROM {table} o WHERE o.cik = {cik} AND o.concept = '{concept}' AND o."end" = {end}
  AND o.filed <= {as_of} ORDER BY o.filed DESC, {order} o.priority, o.accn, o.value LIMIT 1)"""


def value_sql(table_: str, concept: str, end: str, order: str = "") -> str:
    return VALUE_AS_OF.format(
        table=table_, cik="f.cik", concept=concept, end=end, as_of="f.filed", order=order
    )


@query(
    "value_as_of",
    "cik:i as_of:t end:t value:d",
    ANNUAL + """,
asks AS (SELECT DISTINCT f.cik, f.filed AS as_of, e."end" FROM annual f
  JOIN (SELECT DISTINCT cik, "end" FROM annual WHERE concept = 'Revenue') e USING (cik))""",
    """SELECT cik, as_of, "end", value FROM asks a LEFT JOIN annual o USING (cik, "end")
  WHERE o.concept = 'Revenue' AND o.filed <= as_of
  QUALIFY row_number() OVER (PARTITION BY cik, as_of, "end" ORDER BY o.filed DESC, priority, accn, value) = 1""",
)
def value_as_of(spark, sf):
    """Revenue as known on every filing date, for every end of which the company ever reports one."""
    obs = materialize(FA.annual_observations(fact_rows(spark, sf)), "annual")
    ends = obs.where("concept = 'Revenue'").select("cik", "end").distinct()
    asks = obs.select("cik", F.col("filed").alias("as_of")).distinct().join(ends, "cik")
    found = FA.value_as_of(asks.withColumn("concept", F.lit("Revenue")), obs)
    return found.where(F.col("value").isNotNull())


def growth_sql(a: str, b: str) -> str:
    return f"{a} / nullif({b}, 0) - 1"


ANNUAL_TL = ANNUAL + f""",
filings AS (SELECT DISTINCT cik, entity, filed FROM annual),
ends AS (SELECT f.cik, f.entity, f.filed, list_sort(list(DISTINCT a."end"), 'DESC') AS known
  FROM filings f JOIN annual a ON a.cik = f.cik AND a.concept = 'Assets' AND a.filed <= f.filed GROUP BY 1, 2, 3),
f AS (SELECT cik, entity, filed, known[1] AS e1, known[2] AS e0 FROM ends
  WHERE len(known) >= 2 AND known[1] - known[2] BETWEEN 300 AND 430),
v AS (SELECT f.*, {value_sql('annual', 'Revenue', 'f.e1')} AS rev, {value_sql('annual', 'Revenue', 'f.e0')} AS rev0,
  {value_sql('annual', 'Net Income', 'f.e1')} AS ni, {value_sql('annual', 'Operating Cash Flow', 'f.e1')} AS cfo,
  {value_sql('annual', 'Assets', 'f.e1')} AS assets, {value_sql('annual', 'Assets', 'f.e0')} AS assets0,
  {value_sql('annual', 'Equity', 'f.e1')} AS equity, {value_sql('annual', 'Diluted Shares', 'f.e1')} AS sh,
  {value_sql('annual', 'Diluted Shares', 'f.e0')} AS sh0 FROM f),
annual_tl AS (SELECT cik, entity, filed, e1 AS fiscal_end, {growth_sql('rev', 'rev0')} AS revenue_growth,
  ni / nullif(rev, 0) AS net_margin, ni / nullif((assets + assets0) / 2, 0) AS roa,
  cfo / nullif((assets + assets0) / 2, 0) AS cfo_to_assets,
  (ni - cfo) / nullif((assets + assets0) / 2, 0) AS accruals_to_assets,
  {growth_sql('assets', 'assets0')} AS asset_growth, equity / nullif(assets, 0) AS equity_to_assets,
  {growth_sql('sh', 'sh0')} AS share_growth FROM v)"""
ANNUAL_SPEC = "cik:i entity:s filed:t fiscal_end:t " + " ".join(f"{f}:d" for f in FA.ANNUAL_FEATURES)


@query("annual_timeline", ANNUAL_SPEC, ANNUAL_TL, "SELECT * FROM annual_tl")
def annual_timeline(spark, sf):
    return FA.annual_timeline(fact_rows(spark, sf))


FORMS = "('10-Q', '10-Q/A', '10-K', '10-K/A')"
QUARTER = FLAT + f""",
flows AS (SELECT * FROM (SELECT DISTINCT cik, entity, concept, tag, priority, val AS value, start, "end", filed, form,
  accn, CASE WHEN "end" - start BETWEEN 60 AND 120 THEN 'quarter' WHEN "end" - start BETWEEN 200 AND 300
  THEN 'nine_month' WHEN "end" - start BETWEEN 300 AND 400 THEN 'annual' END AS period_type
  FROM facts WHERE form IN {FORMS} AND concept IN ({text_list(FA.QUARTER_FLOWS)})) WHERE period_type IS NOT NULL),
instants AS (SELECT DISTINCT cik, entity, concept, tag, priority, val AS value, "end", filed, form, accn
  FROM facts WHERE form IN {FORMS} AND concept IN ('Assets', 'Equity')),
q4 AS (SELECT a.cik, a.entity, a.concept, a.tag, a.priority, a.value - n.value AS value, n."end" AS start, a."end",
  a.filed, a.form, a.accn, 'derived_q4' AS quarter_source, 1 AS source_priority FROM flows a JOIN flows n
  ON n.cik = a.cik AND n.concept = a.concept AND n.period_type = 'nine_month' AND n.filed <= a.filed
  AND abs(n.start - a.start) <= 15 AND a."end" - n."end" BETWEEN 60 AND 120
  WHERE a.period_type = 'annual' AND a.concept <> 'Diluted Shares'
  QUALIFY row_number() OVER (PARTITION BY a.cik, a.concept, a.tag, a.start, a."end", a.filed, a.form, a.accn, a.value
    ORDER BY n.filed DESC, n.priority, n."end" DESC, n.start DESC, n.accn, n.value) = 1),
quarters AS (SELECT * FROM (SELECT cik, entity, concept, tag, priority, value, start, "end", filed, form, accn,
  'direct' AS quarter_source, 0 AS source_priority FROM flows WHERE period_type = 'quarter'
  UNION ALL SELECT * FROM q4)
  QUALIFY row_number() OVER (PARTITION BY cik, concept, "end", filed
    ORDER BY source_priority, priority, accn, value) = 1)"""


@query("flow_observations", OBS_SPEC + " period_type:s", QUARTER, "SELECT * FROM flows")
def flow_observations(spark, sf):
    return FA.flow_observations(fact_rows(spark, sf))


@query(
    "instant_observations",
    "cik:i concept:s tag:s priority:i value:d end:t filed:t form:s accn:s",
    QUARTER,
    "SELECT * FROM instants",
)
def instant_observations(spark, sf):
    return FA.instant_observations(fact_rows(spark, sf))


@query(
    "single_quarters",
    OBS_SPEC + " quarter_source:s source_priority:i",
    QUARTER,
    "SELECT * FROM quarters",
)
def single_quarters(spark, sf):
    return FA.single_quarters(materialize(FA.flow_observations(fact_rows(spark, sf)), "flows"))


Q_TABLE = "both_tables"
QUARTER_TL = QUARTER + f""",
both_tables AS (SELECT cik, entity, concept, priority, value, "end", filed, accn FROM quarters
  UNION ALL SELECT cik, entity, concept, priority, value, "end", filed, accn FROM instants),
filings AS (SELECT DISTINCT cik, entity, filed FROM both_tables),
cur AS (SELECT f.cik, f.entity, f.filed, max(q."end") AS e1 FROM filings f
  JOIN quarters q ON q.cik = f.cik AND q.filed <= f.filed GROUP BY 1, 2, 3),
f AS (SELECT c.cik, c.entity, c.filed, c.e1, b."end" AS e0 FROM cur c JOIN both_tables b
  ON b.cik = c.cik AND b.filed <= c.filed AND c.e1 - b."end" BETWEEN 330 AND 400
  QUALIFY row_number() OVER (PARTITION BY c.cik, c.filed ORDER BY abs(c.e1 - b."end" - 365), b."end") = 1),
v AS (SELECT f.*, {value_sql(Q_TABLE, 'Revenue', 'f.e1')} AS rev, {value_sql(Q_TABLE, 'Revenue', 'f.e0')} AS rev0,
  {value_sql(Q_TABLE, 'Net Income', 'f.e1')} AS ni, {value_sql(Q_TABLE, 'Net Income', 'f.e0')} AS ni0,
  {value_sql(Q_TABLE, 'Assets', 'f.e1')} AS assets, {value_sql(Q_TABLE, 'Assets', 'f.e0')} AS assets0,
  {value_sql(Q_TABLE, 'Equity', 'f.e1')} AS equity, {value_sql(Q_TABLE, 'Diluted Shares', 'f.e1')} AS sh,
  {value_sql(Q_TABLE, 'Diluted Shares', 'f.e0')} AS sh0 FROM f),
quarter_tl AS (SELECT cik, entity, filed, e1 AS quarter_end, e0 AS prior_end,
  {growth_sql('rev', 'rev0')} AS q_revenue_growth, ni / nullif(rev, 0) AS q_net_margin,
  ni / nullif(rev, 0) - ni0 / nullif(rev0, 0) AS q_margin_change, ni / nullif(assets, 0) AS q_income_to_assets,
  {growth_sql('assets', 'assets0')} AS q_asset_growth, equity / nullif(assets, 0) AS q_equity_to_assets,
  {growth_sql('sh', 'sh0')} AS q_share_growth FROM v)"""


@query(
    "prior_year_end",
    "cik:i filed:t quarter_end:t prior_end:t",
    QUARTER_TL,
    "SELECT cik, filed, e1 AS quarter_end, e0 AS prior_end FROM f",
)
def prior_year_end(spark, sf):
    return FA.quarterly_timeline(fact_rows(spark, sf))


@query(
    "quarterly_timeline",
    "cik:i entity:s filed:t quarter_end:t prior_end:t "
    + " ".join(f"{f}:d" for f in FA.QUARTERLY_FEATURES),
    QUARTER_TL,
    "SELECT * FROM quarter_tl",
)
def quarterly_timeline(spark, sf):
    return FA.quarterly_timeline(fact_rows(spark, sf))


AUDIT_NAMES = {c: FA.snake(c) for c in FA.CONCEPT_ALIASES}
AUDIT = FLAT + """,
tags AS (SELECT cik, concept, priority, tag, bool_or(form = '10-K') AS ok FROM facts GROUP BY ALL),
firsts AS (SELECT * FROM tags QUALIFY row_number() OVER (PARTITION BY cik, concept ORDER BY priority) = 1),
audit AS (SELECT s_suppkey AS cik, """ + ", ".join(
    f"""coalesce(bool_or(ok) FILTER (WHERE concept = '{c}'), false) AS {n}_available,
  max(tag) FILTER (WHERE concept = '{c}') AS {n}_tag""" for c, n in AUDIT_NAMES.items()
) + " FROM supplier LEFT JOIN firsts ON cik = s_suppkey GROUP BY 1)"


def companies(spark, sf):
    return table(spark, sf, "supplier").select(F.col("s_suppkey").alias("cik"))


@query(
    "concept_audit",
    "cik:i " + " ".join(f"{n}_available:b {n}_tag:s" for n in AUDIT_NAMES.values()),
    AUDIT,
    "SELECT * FROM audit",
)
def concept_audit(spark, sf):
    return FA.concept_audit(fact_rows(spark, sf), companies(spark, sf))


COVER_GROUPS = {n: [n] for n in AUDIT_NAMES.values()} | {
    "core": [FA.snake(c) for c in FA.CORE],
    "quality": [FA.snake(c) for c in FA.QUALITY],
    "all_concepts": list(AUDIT_NAMES.values()),
}


@query(
    "concept_coverage",
    "measure:s companies:i available:i rate:d",
    AUDIT,
    " UNION ALL ".join(
        f"""SELECT '{m}' AS measure, count(*) AS companies, count(*) FILTER (WHERE {cond}) AS available,
  avg(({cond})::INT) AS rate FROM audit"""
        for m, cond in (
            (m, " AND ".join(f"{n}_available" for n in names)) for m, names in COVER_GROUPS.items()
        )
    ),
)
def concept_coverage(spark, sf):
    return FA.concept_coverage(concept_audit(spark, sf))


Q_NAMES = [FA.snake(c) for c in FA.QUARTER_FLOWS + FA.QUARTER_BALANCES]


@query(
    "quarterly_audit",
    "cik:i " + " ".join(f"{n}:b" for n in Q_NAMES) + " all_required:b",
    FLAT + """,
qa AS (SELECT s_suppkey AS cik, """ + ", ".join(
        f"""coalesce(bool_or("end" - start BETWEEN 60 AND 120) FILTER (WHERE concept = '{c}'), false) AS {FA.snake(c)}"""
        for c in FA.QUARTER_FLOWS
    ) + ", " + ", ".join(
        f"count(*) FILTER (WHERE concept = '{c}') > 0 AS {FA.snake(c)}" for c in FA.QUARTER_BALANCES
    ) + """ FROM supplier LEFT JOIN (SELECT * FROM facts WHERE form IN ('10-Q', '10-Q/A')) x ON cik = s_suppkey
  GROUP BY 1)""",
    f"SELECT *, {' AND '.join(Q_NAMES)} AS all_required FROM qa",
)
def quarterly_audit(spark, sf):
    return FA.quarterly_audit(fact_rows(spark, sf), companies(spark, sf))


# As-of attachment: companies' timelines on a (supplier, month) panel.
RESOLUTION = """
resolution AS (SELECT upper(concat('s.', s_suppkey)) AS ticker, s_suppkey AS cik FROM supplier
  WHERE s_suppkey % 7 <> 3),
grid AS (SELECT concat('S-', s_suppkey) AS ticker, period_idx FROM supplier
  CROSS JOIN (SELECT unnest(range(min(m), max(m) + 2)) AS period_idx FROM (
    SELECT year(l_shipdate) * 12 + month(l_shipdate) - 1 AS m FROM lineitem))),
mapped AS (SELECT g.*, r.cik, make_date((period_idx // 12)::INT, (period_idx % 12 + 1)::INT, 1) - 1 AS cutoff
  FROM grid g LEFT JOIN (SELECT replace(ticker, '.', '-') AS ticker, cik FROM resolution) r USING (ticker))"""


def attach_sql(features, timeline: str) -> str:
    return f""",{RESOLUTION},
attached AS (SELECT m.*, t.filed, {', '.join('t.' + f for f in features)}, cutoff - t.filed AS age_days
  FROM mapped m ASOF LEFT JOIN {timeline} t ON t.cik = m.cik AND t.filed <= m.cutoff)"""


def resolution(spark, sf):
    return table(spark, sf, "supplier").where("s_suppkey % 7 <> 3").select(
        F.concat(F.lit("s."), F.col("s_suppkey").cast("string")).alias("ticker"),
        F.col("s_suppkey").alias("cik"),
    )


def grid(spark, sf):
    """Every supplier in every month from the first filing to the month after the last."""
    filed = month_index("l_shipdate")
    first, last = table(spark, sf, "lineitem").agg(F.min(filed), F.max(filed)).first()
    months = F.sequence(F.lit(first), F.lit(last + 1))
    return spread(table(spark, sf, "supplier").select("s_suppkey")).select(
        F.concat(F.lit("S."), F.col("s_suppkey").cast("string")).alias("ticker"),
        F.explode(months).alias("period_idx"),
    )


def attached_quarterly(spark, sf):
    timeline = materialize(FA.quarterly_timeline(fact_rows(spark, sf)), "timeline")
    return materialize(
        A.attach_point_in_time(grid(spark, sf), resolution(spark, sf), timeline, FA.QUARTERLY_FEATURES),
        "attached",
    )


QUARTER_ATTACH = QUARTER_TL + attach_sql(FA.QUARTERLY_FEATURES, "quarter_tl")
Q_SPEC = " ".join(f"{f}:d" for f in FA.QUARTERLY_FEATURES)


@query(
    "asof_backward",
    "o_custkey:i cutoff:t o_orderdate:t o_totalprice:d",
    """cust AS (SELECT o_custkey, CAST(o_orderdate AS DATE) AS o_orderdate, max(o_totalprice) AS o_totalprice
  FROM orders GROUP BY 1, 2),
asks AS (SELECT c_custkey AS o_custkey, (DATE '1995-01-31' + to_months(m::INT))::DATE AS cutoff FROM customer,
  range(80) r(m))""",
    """SELECT a.o_custkey, a.cutoff, c.o_orderdate, c.o_totalprice FROM asks a ASOF LEFT JOIN cust c
  ON c.o_custkey = a.o_custkey AND c.o_orderdate <= a.cutoff""",
)
def asof_backward(spark, sf):
    asks = spread(table(spark, sf, "customer").select("c_custkey")).select(
        F.col("c_custkey").alias("o_custkey"),
        F.explode(F.sequence(F.lit(0), F.lit(79))).alias("m"),
    ).select("o_custkey", F.add_months(F.lit(dt.date(1995, 1, 31)), F.col("m")).alias("cutoff"))
    orders = table(spark, sf, "orders").select(
        "o_custkey", F.col("o_orderdate").cast("date").alias("o_orderdate"), "o_totalprice"
    )
    return A.asof_backward(
        asks, orders, ["o_custkey"], "cutoff", "o_orderdate", ["o_totalprice"]
    )


@query(
    "attach_quarterly",
    f"ticker:s period_idx:i cik:d cutoff:t filed:t age_days:d {Q_SPEC}",
    QUARTER_ATTACH,
    "SELECT * FROM attached",
)
def attach_quarterly(spark, sf):
    return attached_quarterly(spark, sf)


@query(
    "attach_annual",
    "ticker:s period_idx:i cik:d cutoff:t filed:t age_days:d "
    + " ".join(f"{f}:d" for f in FA.ANNUAL_FEATURES),
    ANNUAL_TL + attach_sql(FA.ANNUAL_FEATURES, "annual_tl"),
    "SELECT * FROM attached",
)
def attach_annual(spark, sf):
    timeline = materialize(FA.annual_timeline(fact_rows(spark, sf)), "timeline")
    return A.attach_point_in_time(
        grid(spark, sf), resolution(spark, sf), timeline, FA.ANNUAL_FEATURES
    )


@query(
    "pit_violations",
    "violations:i",
    QUARTER_ATTACH,
    "SELECT count(*) AS violations FROM attached WHERE filed > cutoff",
)
def pit_violations(spark, sf):
    return A.point_in_time_violations(attached_quarterly(spark, sf)).agg(
        F.count(F.lit(1)).alias("violations")
    )


@query(
    "merge_audit",
    "rows:i mapped_rate:d filing_rate:d violations:i mean_age_days:d",
    QUARTER_ATTACH,
    """SELECT count(*) AS rows, avg((cik IS NOT NULL)::INT) AS mapped_rate,
  avg((filed IS NOT NULL)::INT) AS filing_rate, count(*) FILTER (WHERE filed > cutoff) AS violations,
  avg(age_days) AS mean_age_days FROM attached""",
)
def merge_audit(spark, sf):
    return FA.merge_audit(attached_quarterly(spark, sf))


@query(
    "filing_age_quantiles",
    "median:d q90:d",
    QUARTER_ATTACH,
    "SELECT median(age_days) AS median, quantile_cont(age_days, 0.9) AS q90 FROM attached",
)
def filing_age_quantiles(spark, sf):
    from perennial.functions.order import exact_quantiles

    rows = attached_quarterly(spark, sf).withColumn("age", F.col("age_days").cast("double"))
    return exact_quantiles(rows, [], "age", ["ticker", "period_idx"], {"median": 0.5, "q90": 0.9})


@query(
    "feature_coverage",
    "feature:s rows:i present:i rate:d",
    QUARTER_ATTACH,
    " UNION ALL ".join(
        f"""SELECT '{f}' AS feature, count(*) AS rows, count({f}) AS present,
  count({f}) / count(*)::DOUBLE AS rate FROM attached""" for f in FA.QUARTERLY_FEATURES
    ),
)
def feature_coverage(spark, sf):
    return FA.feature_coverage(attached_quarterly(spark, sf), FA.QUARTERLY_FEATURES)


@query(
    "winsor_fundamentals",
    "ticker:s period_idx:i " + " ".join(f"cs_{f}:d missing_{f}:d" for f in FA.QUARTERLY_FEATURES),
    QUARTER_ATTACH,
    "SELECT * FROM (SELECT *, "
    + ", ".join(
        f"""coalesce((c_{f} - avg(c_{f}) OVER (PARTITION BY period_idx))
  / nullif(stddev_samp(c_{f}) OVER (PARTITION BY period_idx), 0), 0) AS cs_{f},
  CASE WHEN {f} IS NULL THEN 1.0 ELSE 0.0 END AS missing_{f}""" for f in FA.QUARTERLY_FEATURES
    )
    + " FROM (SELECT *, "
    + ", ".join(
        f"""CASE WHEN {f} IS NOT NULL THEN greatest(least({f}, quantile_cont({f}, 0.99) OVER (PARTITION BY period_idx)),
  quantile_cont({f}, 0.01) OVER (PARTITION BY period_idx)) END AS c_{f}""" for f in FA.QUARTERLY_FEATURES
    )
    + " FROM attached))",
)
def winsor_fundamentals(spark, sf):
    return CS.winsor_zscore(attached_quarterly(spark, sf), FA.QUARTERLY_FEATURES)


# Membership from orders: open orders add the customer, finished ones remove it, pending do both.
CHANGES = """
chg AS (SELECT CAST(o_orderdate AS DATE) AS date,
  CASE WHEN o_orderstatus IN ('O', 'P') THEN concat('t.', o_custkey) END AS added,
  CASE WHEN o_orderstatus = 'F' THEN concat('t.', o_custkey)
    WHEN o_orderstatus = 'P' THEN concat('t.', (o_custkey * 7) % 50) END AS removed FROM orders),
act AS (SELECT date, upper(replace(added, '.', '-')) AS ticker, 'added' AS action FROM chg WHERE added IS NOT NULL
  UNION ALL SELECT date, upper(replace(removed, '.', '-')), 'removed' FROM chg WHERE removed IS NOT NULL),
cur AS (SELECT concat('T-', c_custkey) AS ticker, c_name AS security FROM customer WHERE c_custkey % 3 <> 0),
everyone AS (SELECT ticker FROM cur UNION SELECT ticker FROM act)"""
TODAY = "(SELECT max(CAST(o_orderdate AS DATE)) FROM orders)"


def member_sql(day: str) -> str:
    """Undo later changes: the earliest later day decides, and a removal on it wins."""
    return f"""SELECT d.day, e.ticker FROM everyone e CROSS JOIN ({day}) d
  LEFT JOIN (SELECT x.day, a.ticker, arg_min(a.removed, a.date) AS was FROM ({day}) x
    JOIN (SELECT ticker, date, bool_or(action = 'removed') AS removed FROM act
      WHERE date <= {TODAY} GROUP BY 1, 2) a ON a.date > x.day GROUP BY 1, 2) l
    ON l.day = d.day AND l.ticker = e.ticker
  WHERE coalesce(l.was, e.ticker IN (SELECT ticker FROM cur))"""


def changes(spark, sf):
    status, key = F.col("o_orderstatus"), F.col("o_custkey")
    name = F.concat(F.lit("Customer "), key.cast("string"), F.lit(" Corp."))
    other = (key * 7) % 50
    return table(spark, sf, "orders").select(
        F.col("o_orderdate").cast("date").alias("date"),
        F.when(status.isin("O", "P"), F.concat(F.lit("t."), key.cast("string"))).alias("added"),
        F.when(status.isin("O", "P"), name).alias("added_security"),
        F.when(status == "F", F.concat(F.lit("t."), key.cast("string")))
        .when(status == "P", F.concat(F.lit("t."), other.cast("string")))
        .alias("removed"),
        F.lit(None).cast("string").alias("removed_security"),
    )


def order_days(spark, sf) -> tuple[dt.date, dt.date]:
    day = F.col("o_orderdate").cast("date")
    return tuple(table(spark, sf, "orders").agg(F.min(day), F.max(day)).first())


def current(spark, sf):
    return table(spark, sf, "customer").where("c_custkey % 3 <> 0").select(
        F.concat(F.lit("T."), F.col("c_custkey").cast("string")).alias("ticker"),
        F.col("c_name").alias("security"),
    )


@query(
    "membership_at",
    "ticker:s",
    CHANGES,
    member_sql("SELECT DATE '1999-03-15' AS day"),
)
def membership_at(spark, sf):
    _, today = order_days(spark, sf)
    return MB.membership_at(current(spark, sf), changes(spark, sf), dt.date(1999, 3, 15), today)


MONTHS_SQL = """SELECT unnest(generate_series(date_trunc('month', min(CAST(o_orderdate AS DATE))),
  date_trunc('month', max(CAST(o_orderdate AS DATE))), INTERVAL 1 MONTH))::DATE AS day FROM orders"""
MAP_SQL = f"SELECT year(day) * 12 + month(day) - 1 AS period_idx, ticker FROM ({member_sql(MONTHS_SQL)})"


def membership(spark, sf):
    first, today = order_days(spark, sf)
    return MB.membership_map(current(spark, sf), changes(spark, sf), first, today, today)


@query("membership_map", "period_idx:i ticker:s", CHANGES, MAP_SQL)
def membership_map(spark, sf):
    return membership(spark, sf)


@query(
    "membership_filter",
    "period_idx:i ticker:s spent:d",
    CHANGES + f""", mm AS ({MAP_SQL}),
spend AS (SELECT year(o_orderdate) * 12 + month(o_orderdate) - 1 AS period_idx, concat('T-', o_custkey) AS ticker,
  sum(o_totalprice) AS spent FROM orders GROUP BY 1, 2)""",
    "SELECT * FROM spend SEMI JOIN mm USING (period_idx, ticker)",
)
def membership_filter(spark, sf):
    spend = table(spark, sf, "orders").groupBy(
        month_index("o_orderdate").alias("period_idx"),
        F.concat(F.lit("T-"), F.col("o_custkey").cast("string")).alias("ticker"),
    ).agg(F.sum("o_totalprice").alias("spent"))
    return WF.members_only(spend, membership(spark, sf))


@query(
    "membership_union",
    "ticker:s",
    CHANGES,
    f"""SELECT ticker FROM cur UNION
  SELECT ticker FROM act WHERE date BETWEEN DATE '2000-01-01' AND {TODAY}""",
)
def membership_union(spark, sf):
    _, today = order_days(spark, sf)
    return MB.membership_union(current(spark, sf), changes(spark, sf), dt.date(2000, 1, 1), today)


@query(
    "ticker_name_map",
    "ticker:s names:s",
    CHANGES,
    """SELECT ticker, string_agg(name, '|' ORDER BY name) AS names FROM (
  SELECT ticker, security AS name FROM cur UNION
  SELECT upper(replace(concat('T-', o_custkey), '.', '-')), concat('Customer ', o_custkey, ' Corp.')
  FROM orders WHERE o_orderstatus IN ('O', 'P')) GROUP BY 1""",
)
def ticker_name_map(spark, sf):
    return MB.ticker_names(current(spark, sf), changes(spark, sf)).withColumn(
        "names", F.concat_ws("|", "names")
    )


@query(
    "normalize_tickers",
    "c_custkey:i ticker:s",
    sql="""SELECT c_custkey, concat('C-', c_custkey, '-', upper(substr(c_mktsegment, 1, 3))) AS ticker FROM customer""",
)
def normalize_tickers(spark, sf):
    messy = F.concat(
        F.lit("  c."), F.col("c_custkey").cast("string"), F.lit("."),
        F.substring("c_mktsegment", 1, 3), F.lit(" | note"),
    )
    return table(spark, sf, "customer").select("c_custkey", normalize_ticker(messy).alias("ticker"))


SUFFIXES = (" Inc.", " & Co., Ltd.", " Corp /DE/", ", L.P.", " Company New", "")
BRAND_NAME = "concat(p_name, ' ', replace(p_brand, '#', ' '))"


@query(
    "normalize_company_names",
    "p_partkey:i raw:s normalized:s",
    f"""src AS (SELECT p_partkey, concat({BRAND_NAME}, list_extract([{text_list(SUFFIXES)}],
  (p_partkey % 6 + 1)::INT)) AS raw FROM part),
words AS (SELECT *, regexp_split_to_array(trim(regexp_replace(replace(upper(raw), '&', ' AND '),
  '[^A-Z0-9]+', ' ', 'g')), ' ') AS w FROM src),
cut AS (SELECT *, (SELECT coalesce(max(i), 0) FROM range(1, len(w) + 1) r(i) WHERE NOT list_contains(
  ['INC','INCORPORATED','CORP','CORPORATION','CO','COMPANY','LTD','LIMITED','LLC','PLC','LP'], w[i])) AS n1 FROM words),
cut2 AS (SELECT *, (SELECT coalesce(max(i), 0) FROM range(1, n1 + 1) r(i)
  WHERE NOT list_contains(['DE','NEW','NV'], w[i])) AS n2 FROM cut)""",
    "SELECT p_partkey, raw, array_to_string(w[1:n2], ' ') AS normalized FROM cut2",
)
def normalize_company_names(spark, sf):
    suffix = F.array(*[F.lit(s) for s in SUFFIXES])[(F.col("p_partkey") % 6).cast("int")]
    raw = F.concat("p_name", F.lit(" "), F.replace("p_brand", F.lit("#"), F.lit(" ")), suffix)
    return table(spark, sf, "part").select(
        "p_partkey", raw.alias("raw"), normalize_company_name(raw).alias("normalized")
    )


@query(
    "calendar_dates",
    "o_orderkey:i d:t",
    sql="""SELECT o_orderkey, try_cast(printf('%04d-%02d-%02d', year(o_orderdate), 2,
  28 + day(o_orderdate) % 3) AS DATE) AS d FROM orders""",
)
def calendar_dates(spark, sf):
    day = 28 + F.dayofmonth("o_orderdate") % 3
    return table(spark, sf, "orders").select(
        "o_orderkey", calendar_date(F.year("o_orderdate"), F.lit(2), day).alias("d")
    )


# Identifier lists from customers: the market segment is the first word of all its names.
WORD = "concat(upper(c_mktsegment), ' ', upper(substr(md5(CAST(c_custkey AS VARCHAR)), 1, 10)))"


def customers(spark, sf):
    nation = table(spark, sf, "nation").select(
        F.col("n_nationkey").alias("c_nationkey"), F.upper("n_name").alias("nation")
    )
    return table(spark, sf, "customer").join(F.broadcast(nation), "c_nationkey").select(
        "c_custkey", "nation",
        F.concat(
            F.upper("c_mktsegment"), F.lit(" "),
            F.upper(F.substring(F.md5(F.col("c_custkey").cast("string")), 1, 10)),
        ).alias("word"),
        F.upper("c_mktsegment").alias("segment"),
    )


def listed_names(spark, sf):
    """``NAME:CIK:`` lines: all customers, every tenth name used by a second company."""
    base = customers(spark, sf)
    name = F.concat("word", F.lit(" HOLDINGS OF "), "nation", F.lit(" INC"))
    line = F.concat(name, F.lit(":"), F.lpad(F.col("c_custkey").cast("string"), 10, "0"), F.lit(":"))
    twin = F.concat(
        name, F.lit(":"), (F.col("c_custkey") + 1_000_000).cast("string"), F.lit(":")
    )
    lines = base.select(line.alias("value")).unionByName(
        base.where("c_custkey % 10 = 4").select(twin.alias("value"))
    )
    return materialize(SF.parse_name_lines(lines), "listed")


LISTED = f"""
base AS (SELECT c_custkey, {WORD} AS word, upper(c_mktsegment) AS segment, upper(n_name) AS nation FROM customer JOIN nation ON n_nationkey = c_nationkey),
listed AS (SELECT concat(word, ' HOLDINGS OF ', nation, ' INC') AS name, concat(word, ' HOLDINGS OF ', replace(nation, '_', ' ')) AS normalized,
  c_custkey AS cik FROM base UNION ALL SELECT concat(word, ' HOLDINGS OF ', nation, ' INC'),
  concat(word, ' HOLDINGS OF ', replace(nation, '_', ' ')), c_custkey + 1000000 FROM base WHERE c_custkey % 10 = 4)"""


@query("name_lines", "name:s normalized:s cik:i", LISTED, "SELECT DISTINCT * FROM listed")
def name_lines(spark, sf):
    return listed_names(spark, sf)


def ticker_map(spark, sf):
    """Tickers of every fifth customer, through the JSON object form."""
    entry = F.struct(
        F.col("c_custkey").alias("cik_str"),
        F.concat(F.lit("c."), F.col("c_custkey").cast("string")).alias("ticker"),
        F.concat("word", F.lit(" LISTED")).alias("title"),
    )
    documents = customers(spark, sf).where("c_custkey % 5 = 0").select(
        F.to_json(F.create_map(F.col("c_custkey").cast("string"), entry)).alias("value")
    )
    return SF.parse_ticker_map(documents)


@query(
    "ticker_map",
    "ticker:s cik:i title:s",
    LISTED,
    """SELECT concat('C-', c_custkey) AS ticker, c_custkey AS cik, concat(word, ' LISTED') AS title FROM base
  WHERE c_custkey % 5 = 0""",
)
def ticker_map_json(spark, sf):
    return ticker_map(spark, sf)


def all_tickers(spark, sf):
    return customers(spark, sf).select(
        F.concat(F.lit("c."), F.col("c_custkey").cast("string")).alias("ticker")
    )


COVERAGE = LISTED + """,
cov AS (SELECT concat('c.', c_custkey) AS ticker, concat('C-', c_custkey) AS normalized, c_custkey % 5 = 0 AS mapped,
  CASE WHEN c_custkey % 5 = 0 THEN c_custkey END AS cik FROM base)"""


@query("identifier_coverage", "ticker:s normalized:s mapped:b cik:d", COVERAGE, "SELECT * FROM cov")
def identifier_coverage(spark, sf):
    return RS.identifier_coverage(all_tickers(spark, sf), ticker_map(spark, sf))


@query(
    "coverage_summary",
    "tickers:i mapped:i missing:i rate:d",
    COVERAGE,
    """SELECT count(*) AS tickers, count(*) FILTER (WHERE mapped) AS mapped,
  count(*) FILTER (WHERE NOT mapped) AS missing, avg(mapped::INT) AS rate FROM cov""",
)
def coverage_summary(spark, sf):
    return RS.coverage_summary(identifier_coverage(spark, sf))


@query(
    "map_identifiers",
    "ticker:s cik:d",
    LISTED,
    """SELECT concat('C-', c_custkey) AS ticker, CASE WHEN c_custkey % 2 = 0 THEN c_custkey + 500 END AS cik
  FROM base""",
)
def map_identifiers(spark, sf):
    known = customers(spark, sf).where("c_custkey % 2 = 0").select(
        F.concat(F.lit("C-"), F.col("c_custkey").cast("string")).alias("ticker"),
        F.explode(F.array(F.lit(0), F.lit(500))).alias("row"),
        "c_custkey",
    ).withColumn("cik", F.col("c_custkey") + F.col("row"))
    return A.map_identifiers(all_tickers(spark, sf), known, last_by=["row"])


def named_tickers(spark, sf):
    """Tickers with one or two names: exact, misspelt, or unlike any listed name."""
    exact = F.concat("word", F.lit(" Holdings of "), "nation", F.lit(" Corp."))
    near = F.concat("word", F.lit(" Holding of "), "nation")
    far = F.concat("segment", F.lit(" Qxqx"))
    kind = F.col("c_custkey") % 4
    name = F.when(kind <= 1, exact).when(kind == 2, near).otherwise(far)
    return customers(spark, sf).select(
        F.concat(F.lit("c."), F.col("c_custkey").cast("string")).alias("ticker"),
        F.when(kind == 1, F.array(F.lit("Zzz Unknown"), name)).otherwise(F.array(name)).alias("names"),
    )


RESOLVE_SPEC = "ticker:s cik:d resolution:s input_name:s matched_name:s score:d"
RESOLVE = LISTED + """,
asked AS (SELECT *, concat('C-', c_custkey) AS ticker, c_custkey % 4 AS kind,
  CASE WHEN c_custkey % 4 <= 1 THEN concat(word, ' Holdings of ', nation, ' Corp.')
    WHEN c_custkey % 4 = 2 THEN concat(word, ' Holding of ', nation) ELSE concat(segment, ' Qxqx') END AS nm FROM base),
ids AS (SELECT normalized, count(DISTINCT cik) AS n FROM listed GROUP BY 1)"""


EXACT_SQL = """SELECT ticker, CASE WHEN r <> 'unresolved' AND r <> 'ambiguous_exact' THEN c_custkey END AS cik, r AS resolution,
  CASE WHEN kind = 1 THEN CASE WHEN r = 'ticker' THEN 'Zzz Unknown' ELSE concat('Zzz Unknown | ', nm) END ELSE nm END
    AS input_name, CASE WHEN r = 'ticker' THEN concat(word, ' LISTED')
    WHEN r = 'name_exact' THEN concat(word, ' HOLDINGS OF ', nation, ' INC') END AS matched_name,
  CASE WHEN r IN ('ticker', 'name_exact') THEN 1.0 END AS score FROM (
  SELECT a.*, CASE WHEN c_custkey % 5 = 0 THEN 'ticker' WHEN kind > 1 THEN 'unresolved'
    WHEN i.n = 1 THEN 'name_exact' ELSE 'ambiguous_exact' END AS r
  FROM asked a JOIN ids i ON i.normalized = concat(a.word, ' HOLDINGS OF ', replace(a.nation, '_', ' ')))"""


@query("resolve_exact", RESOLVE_SPEC, RESOLVE, EXACT_SQL)
def resolve_exact(spark, sf):
    return RS.resolve_identifiers(
        named_tickers(spark, sf), ticker_map(spark, sf), listed_names(spark, sf), fuzzy=False
    )


# The misspelt name lacks one letter of the listed one, and the far name shares only the first word
# and the blank after it, so the similarity ratio is known: the far one's best is the shortest name.
@query(
    "resolve_identifiers",
    RESOLVE_SPEC,
    RESOLVE + """,
sims AS (SELECT a.*, i.n, concat(word, ' HOLDINGS OF ', nation, ' INC') AS full_name,
  length(concat(word, ' HOLDINGS OF ', nation)) AS len_listed, min(length(concat(word, ' HOLDINGS OF ', nation)))
  OVER (PARTITION BY segment) AS shortest FROM asked a
  JOIN ids i ON i.normalized = concat(a.word, ' HOLDINGS OF ', replace(a.nation, '_', ' '))),
steps AS (SELECT *, CASE WHEN c_custkey % 5 = 0 THEN 'ticker' WHEN kind <= 1 AND n = 1 THEN 'name_exact'
  WHEN kind <= 1 THEN 'ambiguous_exact' WHEN kind = 2 AND n = 1 THEN 'name_fuzzy' ELSE 'unresolved' END AS r,
  CASE WHEN kind = 2 THEN 2.0 * (len_listed - 1) / (2 * len_listed - 1)
    WHEN kind = 3 THEN 2.0 * (length(segment) + 1) / (length(segment) + 5 + shortest) END AS ratio FROM sims)""",
    """SELECT ticker, CASE WHEN r IN ('ticker', 'name_exact', 'name_fuzzy') THEN c_custkey END AS cik, r AS resolution,
  CASE WHEN kind <> 1 THEN nm WHEN r = 'ticker' THEN 'Zzz Unknown' ELSE concat('Zzz Unknown | ', nm) END AS input_name,
  CASE WHEN r = 'ticker' THEN concat(word, ' LISTED') WHEN r IN ('name_exact', 'name_fuzzy') THEN full_name END
    AS matched_name,
  CASE WHEN r IN ('ticker', 'name_exact') THEN 1.0 WHEN r <> 'ambiguous_exact' THEN ratio END AS score FROM steps""",
)
def resolve_identifiers(spark, sf):
    return RS.resolve_identifiers(
        named_tickers(spark, sf), ticker_map(spark, sf), listed_names(spark, sf)
    )


@query(
    "download_worklist",
    "cik:i",
    sql="SELECT DISTINCT o_custkey AS cik FROM orders WHERE o_custkey % 4 <> 1",
)
def download_worklist(spark, sf):
    wanted = table(spark, sf, "orders").select(F.col("o_custkey").alias("cik"))
    status = table(spark, sf, "customer").select(
        F.col("c_custkey").alias("cik"), (F.col("c_custkey") % 4 == 1).alias("success")
    )
    return SF.download_worklist(wanted, status)


@query(
    "download_status",
    "cik:i success:b error:s",
    sql="""SELECT DISTINCT o_custkey AS cik, o_custkey % 4 >= 2 AS success, CASE o_custkey % 4
  WHEN 0 THEN 'missing document' WHEN 1 THEN 'unreadable company facts' END AS error FROM orders""",
)
def download_status(spark, sf):
    wanted = table(spark, sf, "orders").select(F.col("o_custkey").alias("cik"))
    key = F.col("c_custkey")
    good = F.to_json(F.struct(key.alias("cik"), F.col("c_name").alias("entityName")))
    landed = table(spark, sf, "customer").where(key % 4 > 0).select(
        key.alias("cik"), F.when(key % 4 == 1, F.lit("not json")).otherwise(good).alias("value")
    )
    return SF.download_status(wanted, landed)


@query(
    "cik_for_ticker",
    "cik:i",
    LISTED,
    "SELECT c_custkey AS cik FROM base WHERE c_custkey = 35",
)
def cik_for_ticker(spark, sf):
    return SF.cik_for_ticker(ticker_map(spark, sf), " c.35 ")


@query(
    "load_prices",
    "ticker:s n:i error:s",
    """w AS (SELECT upper(n_name) AS ticker FROM nation UNION SELECT concat(upper(n_name), ' B') FROM nation),
p AS (SELECT upper(n_name) AS ticker, count(*) AS n FROM supplier JOIN nation ON n_nationkey = s_nationkey
  GROUP BY 1)""",
    """SELECT ticker, coalesce(n, 0) AS n, CASE WHEN n IS NULL THEN 'no price data' END AS error
  FROM w LEFT JOIN p USING (ticker)""",
)
def load_prices(spark, sf):
    nation = table(spark, sf, "nation")
    asked = nation.select(F.concat(F.lit(" "), F.lower("n_name"), F.lit(" ")).alias("ticker"))
    second = nation.select(F.concat(F.lower("n_name"), F.lit(" b")).alias("ticker"))
    asked = asked.unionByName(asked).unionByName(second).unionByName(asked.select(F.lit("  ").alias("ticker")))
    rows = table(spark, sf, "supplier").join(
        nation.select(F.col("n_nationkey").alias("s_nationkey"), F.upper("n_name").alias("ticker")),
        "s_nationkey",
    )
    found, missing = SP.load_prices(asked, rows)
    have = found.groupBy("ticker").agg(F.count(F.lit(1)).alias("n"))
    return have.withColumn("error", F.lit(None).cast("string")).unionByName(
        missing.withColumn("n", F.lit(0).cast("long")).select("ticker", "n", "error")
    )


@query(
    "sample_tickers",
    "ticker:s",
    sql="""SELECT CAST(c_custkey AS VARCHAR) AS ticker FROM customer
  ORDER BY md5(concat('42-', c_custkey)), 1 LIMIT 100""",
)
def sample_tickers(spark, sf):
    return SP.sample_tickers(
        table(spark, sf, "customer").select(F.col("c_custkey").cast("string").alias("ticker")), 100
    )
