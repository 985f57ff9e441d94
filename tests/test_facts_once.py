"""Documents and dates are read once, and a sweep goes on from one batch to the next."""

import json
import random

import pyarrow as pa
from perennial.operators import facts as FA
from perennial.operators import sweep as SW
from perennial.sources import filings as SF


def plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_a_document_is_parsed_once(spark):
    doc = {"cik": 1, "entityName": "One", "facts": {"us-gaap": {"Assets": {"units": {"USD": [{"val": 1.0}]}}}}}
    texts = [(json.dumps(doc),), ("{broken",), (json.dumps({"cik": None}),), (None,)]
    lines = spark.createDataFrame(texts, "value string").repartition(2)
    facts = FA.fact_rows(SF.parse_company_facts(lines))
    assert plan(facts).count("from_json(") == 1
    assert [(r.cik, r.concept, r.val) for r in facts.collect()] == [(1, "Assets", 1.0)]


def test_dates_are_parsed_once(spark):
    rows = [
        (1, "One", "Revenue", 0, "Revenues", "USD", "2000-01-01", end, 1.0, filed, "10-Q", "a")
        for end, filed in (("2000-03-31", "2000-05-01"), ("2000-02-31", "2000-05-01"), ("2000-03-31", None))
    ]
    facts = spark.createDataFrame(
        rows,
        "cik long, entity string, concept string, priority int, tag string, unit string, start string, end string, "
        "val double, filed string, form string, accn string",
    ).repartition(2)
    for found in (FA._flows(facts), FA._quarterly_events(facts)):
        assert plan(found).count("RLIKE") == 3
        assert found.count() == 1


def test_a_company_may_span_batches():
    rnd = random.Random(5)
    rows = []
    for cik in (None, 1, 2, 3):
        days = sorted(rnd.randrange(11000, 13000) for _ in range(60))
        for filed in days:
            concept = rnd.choice(["Revenue", "Assets", "Net Income"])
            kind = "instant" if concept == "Assets" else rnd.choice(["quarter", "nine_month", "annual"])
            end = 10950 + 91 * rnd.randrange(12)
            length = {"instant": None, "quarter": 90, "nine_month": 273, "annual": 364}[kind]
            start = None if length is None else end - length
            name = rnd.choice([None, "One", "Two"])
            rows.append((cik, name, concept, kind, rnd.randrange(3), start, end, filed, rnd.choice([None, "a", "b"]),
                         float(rnd.randrange(9))))
    names = ["cik", *SW.EVENT_COLUMNS]
    table = pa.table({n: [r[i] for r in rows] for i, n in enumerate(names)})
    sweep = SW.company_sweep(SW.quarterly_rows, SW.QUARTER_VALUES)
    found = [
        [r for b in sweep(iter(table.to_batches(max_chunksize=size))) for r in b.to_pylist()] for size in (1000, 7, 1)
    ]
    assert found[0] == found[1] == found[2] and {r["cik"] for r in found[0]} == {None, 1, 2, 3}
