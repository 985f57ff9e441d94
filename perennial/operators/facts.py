"""Company filings: nested facts -> observations -> point-in-time timelines."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from perennial.functions.columns import month_index, parse_date, safe_growth, safe_ratio
from perennial.functions.storage import materialize
from perennial.operators import sweep as SW
from perennial.operators.asof import asof_backward

#: Companies of more values than this are not swept in one task.
COMPANY_ROWS = 1 << 20

# Reporting tags of every concept in order of preference.
CONCEPT_ALIASES = {
    "Revenue": [
        "RevenueFromContractWithCustomerExcludingAssessedTax", "Revenues", "SalesRevenueNet",
    ],
    "Operating Income": ["OperatingIncomeLoss"],
    "Net Income": ["NetIncomeLoss", "ProfitLoss"],
    "Operating Cash Flow": [
        "NetCashProvidedByUsedInOperatingActivities",
        "NetCashProvidedByUsedInOperatingActivitiesContinuingOperations",
    ],
    "Assets": ["Assets"],
    "Liabilities": ["Liabilities"],
    "Equity": [
        "StockholdersEquity",
        "StockholdersEquityIncludingPortionAttributableToNoncontrollingInterest",
    ],
    "Diluted Shares": [
        "WeightedAverageNumberOfDilutedSharesOutstanding",
        "WeightedAverageNumberOfShareOutstandingBasicAndDiluted",
    ],
}
NAMESPACE = "us-gaap"
ANNUAL_FORMS = ("10-K", "10-K/A")
QUARTER_FORMS = ("10-Q", "10-Q/A")
ANNUAL_FLOWS = ("Revenue", "Net Income", "Operating Cash Flow", "Diluted Shares")
ANNUAL_BALANCES = ("Assets", "Equity")
QUARTER_FLOWS = ("Revenue", "Net Income", "Diluted Shares")
QUARTER_BALANCES = ("Assets", "Equity")
ANNUAL_FEATURES = (
    "revenue_growth", "net_margin", "roa", "cfo_to_assets", "accruals_to_assets", "asset_growth",
    "equity_to_assets", "share_growth",
)
QUARTERLY_FEATURES = (
    "q_revenue_growth", "q_net_margin", "q_margin_change", "q_income_to_assets", "q_asset_growth",
    "q_equity_to_assets", "q_share_growth",
)


def alias_table(spark) -> DataFrame:
    """(concept, priority, namespace, tag): the fixed list above."""
    rows = [
        (concept, i, NAMESPACE, tag)
        for concept, tags in CONCEPT_ALIASES.items()
        for i, tag in enumerate(tags)
    ]
    return spark.createDataFrame(rows, "concept string, priority int, namespace string, tag string")


def preferred_unit(concept: Column | str) -> Column:
    c = F.col(concept) if isinstance(concept, str) else concept
    return F.when(c == "Diluted Shares", F.lit("shares")).otherwise(F.lit("USD"))


def fact_rows(company_facts: DataFrame) -> DataFrame:
    """One row per reported value of a known concept, in any unit.

    Input: (cik, entityName, facts) with ``facts`` as namespace -> tag -> units -> unit -> values.
    """
    tags = company_facts.select(
        F.col("cik").cast("bigint").alias("cik"),
        F.col("entityName").alias("entity"),
        F.explode("facts").alias("namespace", "_tags"),
    ).select("cik", "entity", "namespace", F.explode("_tags").alias("tag", "_fact"))
    known = tags.join(F.broadcast(alias_table(company_facts.sparkSession)), ["namespace", "tag"])
    return known.select(
        "cik", "entity", "concept", "priority", "tag", F.explode("_fact.units").alias("unit", "_obs")
    ).select("cik", "entity", "concept", "priority", "tag", "unit", F.inline("_obs"))


def scan_fact_rows(documents: DataFrame) -> DataFrame:
    """The rows of ``fact_rows`` from (cik, entity, doc) with documents as VARIANT.

    Tags, units and values are exploded one after the other, and the known tags are joined before their
    values are: a row never holds more than one document, and other tags' values are never decoded.
    """
    spark = documents.sparkSession

    def exploded(rows: DataFrame, variant: str, path: str, names: Sequence[str]) -> DataFrame:
        inner = F.try_variant_get(F.col(variant).outer(), path, "variant")
        return rows.lateralJoin(spark.tvf.variant_explode(inner).toDF("_pos", *names)).drop("_pos", variant)

    tags = exploded(documents.select("cik", "entity", "doc"), "doc", f"$.facts['{NAMESPACE}']", ["tag", "_fact"])
    known = tags.join(F.broadcast(alias_table(spark).drop("namespace")), "tag")
    units = exploded(known, "_fact", "$.units", ["unit", "_values"])
    values = exploded(units, "_values", "$", ["_key", "_value"])
    fields = {c: "string" for c in ("start", "end", "filed", "form", "accn")} | {"val": "double"}
    return values.select(
        "cik", "entity", "concept", "priority", "tag", "unit",
        *[F.try_variant_get("_value", f"$.{c}", fields[c]).alias(c) for c in ("start", "end", "val", "filed", "form", "accn")],
    )


def _dated(facts: DataFrame, forms: Sequence[str], concepts: Sequence[str]) -> DataFrame:
    """Values with a usable form, unit, end and filing date; dates that do not parse are dropped.

    The dates are a generator's row: as plain columns they would be parsed again for every filter on them.
    """
    dates = F.struct(*[parse_date(c).alias(c) for c in ("start", "end", "filed")])
    usable = facts.where(
        F.col("form").isin(*forms)
        & F.col("concept").isin(*concepts)
        & (F.col("unit") == preferred_unit("concept"))
        & F.col("val").isNotNull()
    ).select(
        "cik", "entity", "concept", "priority", "tag", F.col("val").cast("double").alias("value"),
        F.inline(F.array(dates)), "form", "accn",
    )
    return usable.where(F.col("end").isNotNull() & F.col("filed").isNotNull())


def _annual(facts: DataFrame) -> DataFrame:
    rows = _dated(facts, ANNUAL_FORMS, ANNUAL_FLOWS + ANNUAL_BALANCES)
    flow = F.col("concept").isin(*ANNUAL_FLOWS)
    days = F.datediff("end", "start")
    return (
        rows.where(~flow | days.between(300, 400))
        .withColumn("start", F.when(flow, F.col("start")))
    )


def annual_observations(facts: DataFrame) -> DataFrame:
    """Annual-report values; flows must cover 300 to 400 days."""
    return _annual(facts).distinct()


def _period_type() -> Column:
    days = F.datediff("end", "start")
    return (
        F.when(days.between(60, 120), "quarter")
        .when(days.between(200, 300), "nine_month")
        .when(days.between(300, 400), "annual")
    )


def _flows(facts: DataFrame) -> DataFrame:
    rows = _dated(facts, QUARTER_FORMS + ANNUAL_FORMS, QUARTER_FLOWS)
    return rows.withColumn("period_type", _period_type()).where(F.col("period_type").isNotNull())


def flow_observations(facts: DataFrame) -> DataFrame:
    """Flow values of quarterly and annual reports, classified by the days they cover."""
    return _flows(facts).distinct()


def _instants(facts: DataFrame) -> DataFrame:
    return _dated(facts, QUARTER_FORMS + ANNUAL_FORMS, QUARTER_BALANCES).drop("start")


def instant_observations(facts: DataFrame) -> DataFrame:
    """Balance values of quarterly and annual reports."""
    return _instants(facts).distinct()


def _first_value(rows: DataFrame, key: Sequence[str], *order: str) -> DataFrame:
    """One value per key, the first by ``order`` (then by accession and value)."""
    return rows.groupBy(*key).agg(
        F.min_by("value", F.struct(*order, "accn", "value")).alias("value")
    )


def value_as_of(asks: DataFrame, observations: DataFrame) -> DataFrame:
    """Add ``value`` to distinct (cik, concept, end, as_of): last filing known, then preferred tag."""
    one = _first_value(observations, ["cik", "concept", "end", "filed"], "priority")
    return asof_backward(
        asks, one, ["cik", "concept", "end"], "as_of", "filed", ["value"], keep_time=False, carry=True
    )


def _filings(*tables: DataFrame) -> DataFrame:
    """Distinct (cik, as_of) with the entity name."""
    rows = tables[0].select("cik", "entity", "filed")
    for t in tables[1:]:
        rows = rows.unionByName(t.select("cik", "entity", "filed"))
    return rows.groupBy("cik", F.col("filed").alias("as_of")).agg(F.max("entity").alias("entity"))


def _known_ends(rows: DataFrame) -> DataFrame:
    """(cik, end, filed): when each period end first became known."""
    return rows.groupBy("cik", "end").agg(F.min("filed").alias("filed"))


def _latest_two_ends(rows: DataFrame) -> DataFrame:
    """(cik, filed, current_end, previous_end): the two latest ends known after each filing.

    The second largest of a growing set is the running maximum of the smaller of (new value,
    largest so far).
    """
    w = Window.partitionBy("cik").orderBy("filed", "end")
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    upto = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    top = F.max("end").over(before)
    ends = _known_ends(rows).withColumn("_top", top).withColumn(
        "_low", F.when(F.col("_top").isNotNull(), F.least("end", "_top"))
    )
    return (
        ends.select(
            "cik",
            "filed",
            F.max("end").over(upto).alias("_current"),
            F.max("_low").over(upto).alias("_previous"),
        )
        .groupBy("cik", "filed")
        .agg(F.max("_current").alias("current_end"), F.max("_previous").alias("previous_end"))
    )


def _pivot_values(
    rows: DataFrame, needs: dict[str, tuple[str, str]], observations: DataFrame, carry: Sequence[str]
) -> DataFrame:
    """Look up several (concept, end column) values per (cik, as_of) in one as-of join."""
    asked = F.array(
        *[
            F.struct(F.lit(n).alias("_need"), F.lit(c).alias("concept"), F.col(e).alias("end"))
            for n, (c, e) in needs.items()
        ]
    )
    asks = rows.select("cik", "as_of", *carry, F.inline(asked))
    found = value_as_of(asks, observations)
    return found.groupBy("cik", "as_of", *carry).agg(
        *[F.max(F.when(F.col("_need") == n, F.col("value"))).alias(n) for n in needs]
    )


def _events(rows: DataFrame, kind: Column) -> DataFrame:
    """Observations as the sweep takes them, days as integers."""
    days = {c: F.unix_date(c) for c in ("start", "end", "filed")}
    return rows.withColumns({"kind": kind, **days}).select("cik", *SW.EVENT_COLUMNS)


def _quarterly_events(facts: DataFrame) -> DataFrame:
    """The events of ``_flows`` and ``_instants`` in one pass over the facts."""
    rows = _dated(facts, QUARTER_FORMS + ANNUAL_FORMS, QUARTER_FLOWS + QUARTER_BALANCES)
    flow = F.col("concept").isin(*QUARTER_FLOWS)
    kind = F.when(flow, _period_type()).otherwise(F.lit("instant"))
    events = _events(rows.withColumn("start", F.when(flow, F.col("start"))), kind)
    return events.where(F.col("kind").isNotNull())


def _swept(facts: DataFrame, events: DataFrame, rows, wanted: dict, by_joins) -> DataFrame:
    """One row per company and filing date with the ends and values known, from one shuffle by company.

    Companies are counted first.  ``by_joins`` serves the facts of those with more than ``COMPANY_ROWS``
    events, so that no task has to hold more than that of one company.
    """
    events = materialize(events, "events")
    large = materialize(
        events.groupBy("cik").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > COMPANY_ROWS).select("cik"),
        "large_companies",
    )
    values = ", ".join(f"{name} double" for name in wanted)
    kinds = f"cik bigint, entity string, as_of int, current_end int, previous_end int, {values}"
    sweep = SW.company_sweep(rows, wanted)
    dates = {c: F.date_from_unix_date(c) for c in ("as_of", "current_end", "previous_end")}

    def swept(some: DataFrame) -> DataFrame:
        ordered = some.repartition("cik").sortWithinPartitions("cik", "filed")
        return ordered.mapInArrow(sweep, kinds).withColumns(dates)

    if large.isEmpty():
        return swept(events)
    small = swept(events.join(large, "cik", "left_anti"))
    theirs = materialize(facts.join(large, "cik", "left_semi"), "large_facts")
    return small.unionByName(by_joins(theirs))


def annual_timeline(facts: DataFrame) -> DataFrame:
    """Eight ratios per (company, filing date) from what was known on that date."""
    v = _swept(
        facts,
        _events(_annual(facts), F.lit("annual")),
        SW.annual_rows,
        SW.ANNUAL_VALUES,
        lambda large: _annual_by_joins(annual_observations(large)),
    )
    average = (F.col("assets") + F.col("assets0")) / 2
    ratios = {
        "revenue_growth": safe_growth("rev", "rev0"),
        "net_margin": safe_ratio("ni", "rev"),
        "roa": safe_ratio(F.col("ni"), average),
        "cfo_to_assets": safe_ratio(F.col("cfo"), average),
        "accruals_to_assets": safe_ratio(F.col("ni") - F.col("cfo"), average),
        "asset_growth": safe_growth("assets", "assets0"),
        "equity_to_assets": safe_ratio("equity", "assets"),
        "share_growth": safe_growth("sh", "sh0"),
    }
    return v.select(
        "cik",
        "entity",
        F.col("as_of").alias("filed"),
        F.col("current_end").alias("fiscal_end"),
        *[c.alias(n) for n, c in ratios.items()],
    )


def _annual_by_joins(observations: DataFrame) -> DataFrame:
    """What the sweep finds, by as-of merges of (company, concept, end); for companies of any size."""
    obs = materialize(observations, "annual")
    ends = _latest_two_ends(obs.where(F.col("concept") == "Assets"))
    known = asof_backward(
        _filings(obs), ends, ["cik"], "as_of", "filed", ["current_end", "previous_end"], False, True
    ).where(F.datediff("current_end", "previous_end").between(300, 430))
    return _valued(known, SW.ANNUAL_VALUES, obs)


def _valued(rows: DataFrame, wanted: dict, observations: DataFrame) -> DataFrame:
    ends = ("current_end", "previous_end")
    needs = {name: (concept, ends[which]) for name, (concept, which) in wanted.items()}
    return _pivot_values(rows, needs, observations, ["entity", *ends])


def _months_before(end: str, most: int, least: int) -> Column:
    """Month indexes of the days ``most``..``least`` days before ``end`` (at most four)."""
    return F.explode(
        F.sequence(month_index(F.date_sub(end, most)), month_index(F.date_sub(end, least)))
    )


def derived_fourth_quarters(flows: DataFrame) -> DataFrame:
    """Annual value less the best matching nine-month value known at the annual filing.

    Spans are matched first (distinct start/end pairs, equi-joined on the end month); the value is
    then an as-of lookup per span, so revisions are never paired with each other.
    """
    rows = flows.where(F.col("concept") != "Diluted Shares")
    annual = rows.where(F.col("period_type") == "annual")
    nine = rows.where(F.col("period_type") == "nine_month")
    spans9 = (
        nine.select(
            "cik", "concept", F.col("start").alias("start9"), F.col("end").alias("end9")
        )
        .distinct()
        .withColumn("_month", month_index("end9"))
    )
    spans = (
        annual.select("cik", "concept", "start", "end")
        .distinct()
        .select("*", _months_before("end", 120, 60).alias("_month"))
        .join(spans9, ["cik", "concept", "_month"])
        .where(
            (F.abs(F.datediff("start9", "start")) <= 15)
            & F.datediff("end", "end9").between(60, 120)
        )
        .drop("_month")
    )
    values9 = nine.groupBy(
        "cik",
        "concept",
        F.col("start").alias("start9"),
        F.col("end").alias("end9"),
        F.col("filed").alias("filed9"),
    ).agg(F.min(F.struct("priority", "accn", "value")).alias("best9"))
    matched = asof_backward(
        annual.join(spans, ["cik", "concept", "start", "end"]),
        values9,
        ["cik", "concept", "start9", "end9"],
        "filed",
        "filed9",
        ["best9"],
    ).where(F.col("filed9").isNotNull())
    identity = [c for c in annual.columns if c != "period_type"]
    order = F.struct("filed9", -F.col("best9.priority"), "end9", "start9")
    picked = matched.groupBy(*identity).agg(
        F.max_by(F.struct("end9", F.col("best9.value").alias("value9")), order).alias("_nine")
    )
    return picked.withColumns(
        {
            "value": F.col("value") - F.col("_nine.value9"),
            "start": F.col("_nine.end9"),
            "period_type": F.lit("quarter"),
            "quarter_source": F.lit("derived_q4"),
            "source_priority": F.lit(1),
        }
    ).drop("_nine")


def single_quarters(flows: DataFrame) -> DataFrame:
    """One value per (cik, concept, end, filed): reported quarters first, then derived ones."""
    direct = flows.where(F.col("period_type") == "quarter").withColumns(
        {"quarter_source": F.lit("direct"), "source_priority": F.lit(0)}
    )
    both = direct.unionByName(derived_fourth_quarters(flows))
    rest = [
        "source_priority", "priority", "accn", "value", "tag", "start", "form", "quarter_source",
        "entity",
    ]
    return (
        both.groupBy("cik", "concept", "end", "filed")
        .agg(F.min(F.struct(*rest)).alias("_q"))
        .select("cik", "concept", "end", "filed", *[F.col(f"_q.{c}").alias(c) for c in rest])
    )


def prior_year_ends(rows: DataFrame, known: DataFrame) -> DataFrame:
    """Add ``prior_end``: of the ends known by ``as_of`` 330 to 400 days before ``current_end``,
    the one closest to 365 (the earlier of two equally close).  Rows without one are dropped."""
    spans = (
        rows.select("cik", "current_end")
        .distinct()
        .select("*", _months_before("current_end", 400, 330).alias("_month"))
        .join(known.withColumn("_month", month_index("end")), ["cik", "_month"])
        .withColumn("_gap", F.datediff("current_end", "end"))
        .where(F.col("_gap").between(330, 400))
        .select("cik", "current_end", "end", "filed", "_gap")
    )
    order = F.struct(F.abs(F.col("_gap") - 365), "end")
    return (
        rows.join(spans, ["cik", "current_end"])
        .where(F.col("filed") <= F.col("as_of"))
        .groupBy(*rows.columns)
        .agg(F.min_by("end", order).alias("prior_end"))
    )


def quarterly_timeline(facts: DataFrame) -> DataFrame:
    """Seven ratios per (company, filing date) from what was known on that date."""
    v = _swept(
        facts,
        _quarterly_events(facts),
        SW.quarterly_rows,
        SW.QUARTER_VALUES,
        lambda large: _quarterly_by_joins(flow_observations(large), instant_observations(large)),
    )
    ratios = {
        "q_revenue_growth": safe_growth("rev", "rev0"),
        "q_net_margin": safe_ratio("ni", "rev"),
        "q_margin_change": safe_ratio("ni", "rev") - safe_ratio("ni0", "rev0"),
        "q_income_to_assets": safe_ratio("ni", "assets"),
        "q_asset_growth": safe_growth("assets", "assets0"),
        "q_equity_to_assets": safe_ratio("equity", "assets"),
        "q_share_growth": safe_growth("sh", "sh0"),
    }
    return v.select(
        "cik",
        "entity",
        F.col("as_of").alias("filed"),
        F.col("current_end").alias("quarter_end"),
        F.col("previous_end").alias("prior_end"),
        *[c.alias(n) for n, c in ratios.items()],
    )


def _quarterly_by_joins(flow_rows: DataFrame, instant_rows: DataFrame) -> DataFrame:
    """What the sweep finds, by as-of merges of (company, concept, end); for companies of any size."""
    flows = materialize(flow_rows, "flows")
    quarters = materialize(single_quarters(flows), "quarters")
    instants = materialize(instant_rows, "instants")
    w = (
        Window.partitionBy("cik")
        .orderBy("filed")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    latest = (
        quarters.groupBy("cik", "filed")
        .agg(F.max("end").alias("_end"))
        .select("cik", "filed", F.max("_end").over(w).alias("current_end"))
    )
    current = asof_backward(
        _filings(quarters, instants), latest, ["cik"], "as_of", "filed", ["current_end"], False, True
    ).where(F.col("current_end").isNotNull())
    ends = _known_ends(
        quarters.select("cik", "end", "filed").unionByName(instants.select("cik", "end", "filed"))
    )
    columns = ["cik", "concept", "end", "filed", "priority", "accn", "value"]
    both = quarters.select(*columns).unionByName(instants.select(*columns))
    rows = prior_year_ends(current, ends).withColumnRenamed("prior_end", "previous_end")
    return _valued(rows, SW.QUARTER_VALUES, both)


def snake(concept: str) -> str:
    return concept.lower().replace(" ", "_")


def concept_audit(facts: DataFrame, companies: DataFrame) -> DataFrame:
    """Per company and concept: the first reported tag and whether it has an annual value.

    ``companies`` (cik) keeps companies that report none of the concepts.
    """
    usable = (
        (F.col("form") == "10-K")
        & F.col("val").isNotNull()
        & F.col("filed").isNotNull()
        & F.col("end").isNotNull()
    )
    tags = facts.groupBy("cik", "concept", "priority", "tag").agg(F.bool_or(usable).alias("_ok"))
    first = tags.groupBy("cik", "concept").agg(
        F.min_by(F.struct("tag", "_ok"), "priority").alias("_f")
    )
    wide = first.groupBy("cik").agg(
        *[
            c
            for name in CONCEPT_ALIASES
            for c in (
                F.coalesce(
                    F.bool_or(F.when(F.col("concept") == name, F.col("_f._ok"))), F.lit(False)
                ).alias(f"{snake(name)}_available"),
                F.max(F.when(F.col("concept") == name, F.col("_f.tag"))).alias(f"{snake(name)}_tag"),
            )
        ]
    )
    joined = companies.select("cik").distinct().join(wide, "cik", "left")
    return joined.fillna(False, [f"{snake(n)}_available" for n in CONCEPT_ALIASES])


CORE = ("Net Income", "Assets", "Equity")
QUALITY = ("Net Income", "Operating Cash Flow", "Assets")


def concept_coverage(audit: DataFrame) -> DataFrame:
    """(measure, companies, available, rate) per concept and for the three concept groups."""
    groups = {snake(n): (n,) for n in CONCEPT_ALIASES}
    groups |= {"core": CORE, "quality": QUALITY, "all_concepts": tuple(CONCEPT_ALIASES)}
    items = []
    for name, concepts in groups.items():
        every = F.lit(True)
        for c in concepts:
            every = every & F.col(f"{snake(c)}_available")
        items.append(F.struct(F.lit(name).alias("measure"), every.alias("_has")))
    long = audit.select(F.inline(F.array(*items)))
    return long.groupBy("measure").agg(
        F.count(F.lit(1)).alias("companies"),
        F.count(F.when(F.col("_has"), 1)).alias("available"),
        F.avg(F.col("_has").cast("double")).alias("rate"),
    )


def quarterly_audit(facts: DataFrame, companies: DataFrame) -> DataFrame:
    """Per company: which concepts have a usable value in a quarterly report."""
    days = F.datediff(parse_date("end"), parse_date("start"))
    flow = days.between(60, 120) & F.col("filed").isNotNull()
    instant = F.col("end").isNotNull() & F.col("filed").isNotNull() & F.col("val").isNotNull()
    usable = F.when(F.col("concept").isin(*QUARTER_FLOWS), flow).otherwise(instant)
    rows = facts.where(
        F.col("form").isin(*QUARTER_FORMS) & (F.col("unit") == preferred_unit("concept"))
    )
    names = QUARTER_FLOWS + QUARTER_BALANCES
    flags = rows.groupBy("cik").agg(
        *[
            F.coalesce(
                F.bool_or(F.when(F.col("concept") == n, F.coalesce(usable, F.lit(False)))),
                F.lit(False),
            ).alias(snake(n))
            for n in names
        ]
    )
    out = companies.select("cik").distinct().join(flags, "cik", "left")
    out = out.fillna(False, [snake(n) for n in names])
    every = F.lit(True)
    for n in names:
        every = every & F.col(snake(n))
    return out.withColumn("all_required", every)


def feature_coverage(data: DataFrame, features: Sequence[str]) -> DataFrame:
    """(feature, rows, present, rate): share of non-null values, counted in one aggregate of all."""
    whole = F.count(F.lit(1))
    counts = data.agg(whole.alias("_n"), *[F.count(f).alias(f"_c{i}") for i, f in enumerate(features)])
    items = [
        F.struct(
            F.lit(f).alias("feature"),
            F.col("_n").alias("rows"),
            F.col(f"_c{i}").alias("present"),
            (F.col(f"_c{i}") / F.col("_n")).alias("rate"),
        )
        for i, f in enumerate(features)
    ]
    return counts.where("_n > 0").select(F.inline(F.array(*items)))


def merge_audit(attached: DataFrame) -> DataFrame:
    """One row: rows, mapped and filled share, violations, mean filing age."""
    late = F.col("filed") > F.col("cutoff")
    return attached.agg(
        F.count(F.lit(1)).alias("rows"),
        F.avg(F.col("cik").isNotNull().cast("double")).alias("mapped_rate"),
        F.avg(F.col("filed").isNotNull().cast("double")).alias("filing_rate"),
        F.count(F.when(late, 1)).alias("violations"),
        F.avg("age_days").alias("mean_age_days"),
    )
