"""As-of joins, membership, filings and name resolution against direct computation."""

import datetime as dt
import json
import random
from difflib import SequenceMatcher

import pandas as pd
import pytest
from pyspark.sql import functions as F

from perennial.functions.columns import normalize_company_name, normalize_ticker, safe_growth, safe_ratio
from perennial.functions.storage import materialize
from perennial.operators import asof as A
from perennial.operators import facts as FA
from perennial.operators import membership as MB
from perennial.operators import portfolio as PF
from perennial.operators import resolve as RS
from perennial.sources import filings as SF
from perennial.sources import prices as SP

DAY = dt.date(2020, 1, 1)


@pytest.mark.parametrize("carry", [False, True])
def test_asof_equals_merge_asof(spark, carry):
    rnd = random.Random(7)
    right = {(rnd.randint(1, 4), DAY + dt.timedelta(days=rnd.randint(0, 90))) for _ in range(60)}
    right = [(k, d, float(i)) for i, (k, d) in enumerate(sorted(right))]
    left = sorted({(rnd.randint(1, 6), DAY + dt.timedelta(days=rnd.randint(-10, 100))) for _ in range(80)})
    left = [(k, d, i) for i, (k, d) in enumerate(left)]
    got = A.asof_backward(
        spark.createDataFrame(left, "k int, t date, id int"),
        spark.createDataFrame(right, "k int, f date, v double"),
        ["k"], "t", "f", ["v"], carry=carry,
    ).toPandas().sort_values("id")
    want = pd.merge_asof(
        pd.DataFrame(left, columns=["k", "t", "id"]).assign(t=lambda d: pd.to_datetime(d.t)).sort_values("t"),
        pd.DataFrame(right, columns=["k", "f", "v"]).assign(f=lambda d: pd.to_datetime(d.f)).sort_values("f"),
        by="k", left_on="t", right_on="f",
    ).sort_values("id")
    assert got.v.fillna(-1).tolist() == want.v.fillna(-1).tolist()


def test_unmapped_rows_survive_the_attachment(spark):
    data = spark.createDataFrame([("a.b", 24240), ("zz", 24240)], "ticker string, period_idx int")
    ids = spark.createDataFrame([("A-B", 5)], "ticker string, cik long")
    timeline = spark.createDataFrame(
        [(5, dt.date(2019, 12, 31), 1.0), (5, dt.date(2020, 1, 1), 2.0)], "cik long, filed date, x double"
    )
    out = A.attach_point_in_time(data, ids, timeline, ["x"])
    rows = {r.ticker: r for r in out.collect()}
    assert rows["A-B"].x == 1.0 and rows["A-B"].age_days == 0
    assert rows["ZZ"].cik is None and rows["ZZ"].x is None
    assert A.point_in_time_violations(out).count() == 0


def replay(current, changes, day, today):
    members = set(current)
    later = sorted((c for c in changes if day < c[0] <= today), key=lambda c: c[0], reverse=True)
    for _, added, removed in later:
        members.discard(added)
        if removed:
            members.add(removed)
    return members


def test_membership_equals_replay(spark):
    rnd = random.Random(11)
    names = [f"T{i}" for i in range(25)]
    today = dt.date(2020, 12, 31)
    days = rnd.sample(range(360), 60)
    changes = [
        (DAY + dt.timedelta(days=d), *rnd.choice([(a, None), (None, b), (a, b)]))
        for d in days for a, b in [rnd.sample(names, 2)]
    ]
    current = rnd.sample(names, 12)
    cdf = spark.createDataFrame([(c,) for c in current], "ticker string")
    chdf = spark.createDataFrame(changes, "date date, added string, removed string")
    for day in (dt.date(2019, 6, 1), dt.date(2020, 5, 17), changes[0][0], today):
        got = {r.ticker for r in MB.membership_at(cdf, chdf, day, today).collect()}
        assert got == replay(current, changes, day, today)
    months = MB.membership_map(cdf, chdf, dt.date(2020, 1, 1), dt.date(2020, 12, 31), today).toPandas()
    for m in range(1, 13):
        got = set(months[months.period_idx == 2020 * 12 + m - 1].ticker)
        assert got == replay(current, changes, dt.date(2020, m, 1), today)
    with pytest.raises(ValueError):
        MB.membership_at(cdf, chdf, dt.date(2021, 1, 1), today)


def test_normalisation(spark):
    names = {
        "Apple Inc.": "APPLE",
        "AT&T Corp": "AT AND T",
        "Foo Co., Ltd. /DE/": "FOO CO LTD",
        "Acme Holdings Inc /NEW/": "ACME HOLDINGS INC",
        "Bar De Inc": "BAR",
        "The Company": "THE",
        "Inc": "",
        "Coca-Cola Co": "COCA COLA",
        "Taco": "TACO",
    }
    df = spark.createDataFrame([(n,) for n in names], "n string")
    got = {r.n: r.x for r in df.select("n", normalize_company_name("n").alias("x")).collect()}
    assert got == names
    t = spark.createDataFrame([(" brk.b | x",), (None,)], "t string").select(normalize_ticker("t")).collect()
    assert t[0][0] == "BRK-B" and t[1][0] is None


def test_safe_ratio(spark):
    df = spark.createDataFrame([(1.0, 2.0), (1.0, 0.0), (None, 1.0)], "a double, b double")
    got = df.select(safe_ratio("a", "b"), safe_growth("a", "b")).collect()
    assert [tuple(r) for r in got] == [(0.5, -0.5), (None, None), (None, None)]


def test_similar_names_equal_brute_force(spark):
    rnd = random.Random(5)
    words = ["ALPHA", "ALPHABET", "BETA", "GAMMA", "DELTA", "ONE", "TWO"]
    listed = sorted({" ".join(rnd.choices(words, k=rnd.randint(1, 4))) for _ in range(60)})
    asked = sorted({" ".join(rnd.choices(words, k=3)) for _ in range(15)} | {"NOWHERE CORP"})
    sec = spark.createDataFrame([(n, n, i) for i, n in enumerate(listed)], "name string, normalized string, cik long")
    got = {
        r.normalized: r.score
        for r in RS.similar_names(spark.createDataFrame([(a,) for a in asked], "normalized string"), sec).collect()
    }
    for a in asked:
        token = a.split()[0]
        block = [c for c in listed if c.startswith(token) or token in c.split()]
        if block:
            assert got[a] == pytest.approx(max(SequenceMatcher(None, a, c).ratio() for c in block))
        else:
            assert a not in got


def test_similar_names_of_one_frequent_word(spark, monkeypatch):
    rnd = random.Random(8)
    parts = ["HOLDINGS", "HOLDING", "OF", "EAST", "WEST", "RIVER", "RIVERS", "ÉCLAIR", "X1", "1X"]
    listed = sorted({" ".join(["UNITED", *rnd.choices(parts, k=rnd.randint(0, 4))]) for _ in range(500)})
    asked = sorted({" ".join(["UNITED", *rnd.choices([*parts, "QXQX"], k=3)]) for _ in range(150)})
    sec = spark.createDataFrame([(n, n, i) for i, n in enumerate(listed)], "name string, normalized string, cik long")
    inputs = spark.createDataFrame([(a,) for a in [*asked, "", asked[0]]], "normalized string")
    want = {a: max((SequenceMatcher(None, a, c).ratio(), c) for c in listed) for a in asked}
    for size in (40, 1024):
        monkeypatch.setattr(RS, "CELL_NAMES", size)
        got = RS.similar_names(inputs, sec).collect()
        assert {r.normalized: (r.score, r.candidate) for r in got} == want and len(got) == len(asked)
    high = RS.similar_names(inputs, sec, 0.9).collect()
    assert {r.normalized: (r.score, r.candidate) for r in high} == {a: b for a, b in want.items() if b[0] >= 0.9}
    cell = RS.NameCell(listed)
    for a in asked:
        first = cell.first(a)
        assert max(first, cell.best(a, first[0])) == want[a]
    assert cell.scored < len(asked) * len(listed) / 4


def test_resolution_cascade(spark):
    names = spark.createDataFrame(
        [("AEP", ["American Electric"]), ("AAA", ["Anything"]), ("BBB", ["Omega Works Inc"]),
         ("CCC", ["Twin Co"]), ("DDD", ["Omega Work Corp"]), ("EEE", ["Quite Different"])],
        "ticker string, names array<string>",
    )
    tickers = spark.createDataFrame([("AAA", 7, "A TITLE")], "ticker string, cik long, title string")
    sec = SF.parse_name_lines(
        spark.createDataFrame(
            [("OMEGA WORKS INC:0000000011:",), ("TWIN CO:1:",), ("TWIN CORP:2:",), ("A:B:12",), ("X:y:",),
             ("PLAIN NAME:77",)],
            "value string",
        )
    )
    assert {(r.normalized, r.cik) for r in sec.collect()} == {
        ("OMEGA WORKS", 11), ("TWIN", 1), ("TWIN", 2), ("PLAIN NAME", 77),
    }
    got = {r.ticker: r for r in RS.resolve_identifiers(names, tickers, sec).collect()}
    assert {t: r.resolution for t, r in got.items()} == {
        "AEP": "verified_override", "AAA": "ticker", "BBB": "name_exact", "CCC": "ambiguous_exact",
        "DDD": "name_fuzzy", "EEE": "unresolved",
    }
    assert got["DDD"].cik == 11 and got["DDD"].score > 0.92 and got["EEE"].cik is None


def observation(start, end, val, filed, form):
    return {"start": start, "end": end, "val": val, "filed": filed, "form": form, "accn": filed}


def test_company_facts_from_files(spark, tmp_path):
    revenue = [
        observation("2019-01-01", "2019-12-31", 100.0, "2020-02-01", "10-K"),
        observation("2020-01-01", "2020-12-31", 150.0, "2021-02-01", "10-K"),
        observation("2020-01-01", "2020-09-30", 90.0, "2020-11-01", "10-Q"),
        observation("2020-10-01", "2020-13-45", 1.0, "2021-02-01", "10-K"),
    ]
    assets = [
        observation(None, "2019-12-31", 1000.0, "2020-02-01", "10-K"),
        observation(None, "2020-12-31", 1100.0, "2021-02-01", "10-K"),
        observation(None, "2020-12-31", 1200.0, "2021-05-01", "10-K/A"),
    ]
    doc = {
        "cik": 9, "entityName": "Nine",
        "facts": {"us-gaap": {"Revenues": {"units": {"USD": revenue}}, "Assets": {"units": {"USD": assets}}}},
    }
    (tmp_path / "CIK9.json").write_text(json.dumps(doc, indent=1))
    (tmp_path / "CIK8.json").write_text(json.dumps({**doc, "cik": 8}))
    (tmp_path / "bad.json").write_text("{not json")
    status = spark.createDataFrame([(9, True), (8, False)], "cik long, success boolean")
    facts = FA.fact_rows(SF.read_company_facts(spark, str(tmp_path), status))
    assert {r.cik for r in facts.select("cik").distinct().collect()} == {9}
    tl = FA.annual_timeline(facts).orderBy("filed").collect()
    assert [str(r.filed) for r in tl] == ["2021-02-01", "2021-05-01"]
    assert tl[0].revenue_growth == pytest.approx(0.5)
    assert [r.asset_growth for r in tl] == pytest.approx([0.1, 0.2])
    q4 = FA.single_quarters(FA.flow_observations(facts)).collect()
    assert [(r.quarter_source, r.value, str(r.start)) for r in q4] == [("derived_q4", 60.0, "2020-09-30")]
    docs = spark.read.text(str(tmp_path), wholetext=True)
    assert SF.quarantined_documents(docs).count() == 1


def test_sweep_and_joins_give_the_same_timelines(spark, monkeypatch):
    rnd = random.Random(3)
    tags = [(c, i, t) for c, names in FA.CONCEPT_ALIASES.items() for i, t in enumerate(names)]
    rows = []
    for cik, n in ((1, 40), (2, 400), (3, 900)):
        for k in range(n):
            concept, priority, tag = rnd.choice(tags)
            end = dt.date(2000 + rnd.randrange(4), rnd.choice([3, 6, 9, 12]), 30)
            days = rnd.choice([90, 91, 272, 273, 364, 365, 150])
            rows.append((
                cik, rnd.choice([f"Company {cik}", f"Firm {cik}", None]), concept, priority, tag,
                rnd.choice(["USD", "USD", "shares"]) if concept == "Diluted Shares" else "USD",
                None if concept in ("Assets", "Equity") else str(end - dt.timedelta(days)), str(end),
                rnd.choice([float(k), 0.0, None]), str(end + dt.timedelta(rnd.randrange(1, 700))),
                rnd.choice(["10-K", "10-K/A", "10-Q", "10-Q/A", "8-K"]), rnd.choice([f"a{k}", "same", None]),
            ))
    facts = spark.createDataFrame(
        [*rows, *rows[:50]],
        "cik long, entity string, concept string, priority int, tag string, unit string, start string, end string, "
        "val double, filed string, form string, accn string",
    ).cache()
    for timeline in (FA.annual_timeline, FA.quarterly_timeline):
        found = []
        for limit in (1 << 20, 300, 0):
            monkeypatch.setattr(FA, "COMPANY_ROWS", limit)
            found.append(sorted((tuple(map(str, r)) for r in timeline(facts).collect())))
        assert found[0] == found[1] == found[2] and len(found[0]) > 20


def test_a_filing_from_the_month_stops_the_job(spark):
    rows = [("A", 24001, dt.date(2000, 1, 31)), ("B", 24001, None)]
    attached = spark.createDataFrame(rows, "ticker string, period_idx int, filed date")
    assert A.require_point_in_time(attached).count() == 2
    planted = attached.unionByName(
        spark.createDataFrame([("C", 24001, dt.date(2000, 2, 1))], attached.schema)
    )
    with pytest.raises(Exception, match="not known at the start of month 24001"):
        A.require_point_in_time(planted).select("ticker").collect()


def test_scanned_facts_of_odd_documents(spark, tmp_path):
    good = {"start": None, "end": "2000-01-01", "val": "12", "filed": "2000-02-02", "form": "10-K"}
    documents = [
        {"cik": 1, "entityName": "One", "facts": {"us-gaap": {"Assets": {"units": {"USD": [good, {}], "EUR": []}}}}},
        {"cik": 2, "facts": {"us-gaap": {"Assets": {"units": {"USD": "text"}}, "Other": {"units": {"USD": [good]}}}}},
        {"cik": 3, "facts": {"dei": {"Assets": {"units": {"USD": [good]}}}}}, {"cik": 4}, {"cik": "five"}, {"x": 1}, [1],
    ]
    (tmp_path / "a.json").write_text("\n".join(json.dumps(d) for d in documents) + "\n{broken\n")
    read = SF.read_documents(spark, str(tmp_path), whole_files=False)
    got = FA.scan_fact_rows(SF.parsed_documents(read)).collect()
    assert [(r.cik, r.entity, r.concept, r.end, r.val, r.accn) for r in got if r.end] == [
        (1, "One", "Assets", "2000-01-01", 12.0, None)
    ]
    assert sorted(r.error for r in SF.broken_documents(read).collect()) == [
        "no company", "no company", "no company", "unreadable company facts"
    ]


def test_name_lines_file(spark, tmp_path):
    (tmp_path / "names.txt").write_bytes("CAFÉ \"X\", INC:0000000003:\n\nFOO:BAR:4:\n".encode("latin-1"))
    got = SF.read_name_lines(spark, str(tmp_path / "names.txt")).collect()
    assert {(r.name, r.cik) for r in got} == {('CAFÉ "X", INC', 3), ("FOO:BAR", 4)}


def test_price_table_round_trip(spark, tmp_path):
    df = spark.createDataFrame(
        [("brk.b", DAY, 1.0, 1.0, 1.0, 1.0, float("nan"), 5), ("a", DAY, 1.0, 1.0, 1.0, 1.0, 2.0, 5)],
        SP.PRICE_SCHEMA,
    )
    SP.write_prices(df, str(tmp_path / "p"), buckets=4)
    back = {r.ticker: r.adj_close for r in SP.read_prices(spark, str(tmp_path / "p")).collect()}
    assert back == {"BRK-B": None, "A": 2.0}
    SP.write_csv(df.select("ticker", "volume"), str(tmp_path / "c"))
    assert SP.read_csv(spark, str(tmp_path / "c"), "ticker string, volume bigint").count() == 2


def test_sample_does_not_depend_on_partitioning(spark):
    df = spark.range(500).select(F.col("id").cast("string").alias("ticker"))
    a = {r.ticker for r in SP.sample_tickers(df.repartition(7), 20).collect()}
    assert a == {r.ticker for r in SP.sample_tickers(df.coalesce(1), 20).collect()} and len(a) == 20


def test_turnover_and_drift(spark):
    rows = [("s", 1, "A", 0.5, 0.1), ("s", 1, "B", 0.5, -0.1), ("s", 4, "A", 1.0, None)]
    df = spark.createDataFrame(
        [(*r, 1.0, 0.0) for r in rows],
        "strategy string, period_idx int, ticker string, weight double, ret double, beta_24m double, bench_ret double",
    )
    got = {r.period_idx: r.turnover for r in PF.gross_turnover(df).collect()}
    assert got[1] == 1.0 and got[4] == pytest.approx(abs(1 - 0.55) + 0.45)


def test_degenerate_performance(spark):
    df = spark.createDataFrame([("s", 1, -1.0), ("t", 1, 0.1), ("t", 2, -0.5)], "strategy string, period_idx int, r double")
    null = {r.strategy: r.g for r in df.groupBy("strategy").agg(PF.cagr("r").alias("g")).collect()}
    zero = {r.strategy: r.g for r in df.groupBy("strategy").agg(PF.cagr("r", "zero").alias("g")).collect()}
    assert null["s"] is None and zero["s"] == -1.0 and null["t"] == pytest.approx((1.1 * 0.5) ** 6 - 1)
    falls = {r.strategy: r.max_drawdown for r in PF.max_drawdown(df, "r", ["strategy"]).collect()}
    assert falls["t"] == pytest.approx(-0.5)


def test_materialized_table_reads_back(spark):
    df = spark.range(10).withColumn("x", F.col("id") * 2)
    back = materialize(df, "unit")
    assert back.count() == 10 and "Parquet" in back._jdf.queryExecution().toString()


def test_close_names_meet_few_listed_ones(spark, monkeypatch):
    """Of one frequent first word, inputs with a close listed name never reach the cells."""
    rnd = random.Random(3)
    tokens = ["".join(rnd.choices("0123456789ABCDEF", k=10)) for _ in range(400)]
    listed = [f"UNITED {t} HOLDINGS OF {rnd.choice(['PERU', 'CHINA'])}" for t in tokens]
    near = [rnd.choice([n.replace("HOLDINGS", "HOLDING"), n[:9] + n[10:], n + "X"]) for n in listed[:60]]
    twins = [listed[0] + "Y", listed[0] + "Z"]
    far = ["UNITED QXQX", "UNITED", "UN"]
    sec = spark.createDataFrame([(n, n, i) for i, n in enumerate(listed + twins)], "name string, normalized string, cik long")
    asked = [*near, listed[0] + "W", *far]
    met = []
    by_cells = RS._by_cells
    monkeypatch.setattr(RS, "_by_cells", lambda rows, *a: (met.append({r.wanted for r in rows.collect()}), by_cells(rows, *a))[1])
    got = RS.similar_names(spark.createDataFrame([(a,) for a in asked], "normalized string"), sec).collect()
    want = {
        a: max((SequenceMatcher(None, a, c).ratio(), c) for c in listed + twins if c.startswith(a.split()[0]))
        for a in asked
    }
    assert {r.normalized: (r.score, r.candidate) for r in got} == want
    assert met == [set(far)]


@pytest.mark.parametrize("piece_names", [1, 5, 256])
def test_pieces_and_cells_agree(spark, monkeypatch, piece_names):
    monkeypatch.setattr(RS, "PIECE_NAMES", piece_names)
    rnd = random.Random(piece_names)
    listed = sorted({"A" + "".join(rnd.choices("AB ", k=rnd.randint(3, 24))).strip() for _ in range(300)})
    asked = sorted({n[:i] + rnd.choice(["", "B", "AB"]) + n[i + 1 :] for n in listed[:120] for i in [rnd.randint(1, len(n))]})
    sec = spark.createDataFrame([(n, n, i) for i, n in enumerate(listed)], "name string, normalized string, cik long")
    got = RS.similar_names(spark.createDataFrame([(a,) for a in asked], "normalized string"), sec).collect()
    want = {}
    for a in asked:
        token = a.split(" ")[0]
        block = [c for c in listed if c.startswith(token) or token in c.split(" ")]
        if block:
            want[a] = max((SequenceMatcher(None, a, c).ratio(), c) for c in block)
    assert {r.normalized: (r.score, r.candidate) for r in got} == want


def test_value_as_of_asks_for_every_known_end(spark, tmp_path):
    """A filing that reports nothing for an older end is asked for it all the same."""
    from checks import filing_queries as FQ

    rows = [(1, 1, 0, 9, dt.date(1996, 5, 1), 10.0), (1, 4, 0, 9, dt.date(1997, 5, 1), 20.0)]
    items = spark.createDataFrame(
        [(o, n, p, s, 5, v, "N", d) for o, n, p, s, d, v in rows],
        "l_orderkey long, l_linenumber long, l_partkey long, l_suppkey long, l_quantity int, "
        "l_extendedprice double, l_returnflag string, l_shipdate date",
    )
    items.write.parquet(f"{tmp_path}/lineitem.parquet")
    got = {(r.as_of.year, r.end.year, r.value) for r in FQ.value_as_of(spark, str(tmp_path)).collect()}
    assert got == {(1996, 1995, 10.0), (1997, 1995, 10.0), (1997, 1996, 20.0)}


def test_asof_neither_aggregates_nor_joins_the_left_side(spark):
    left = spark.createDataFrame([(1, DAY, 1), (1, DAY, 2), (None, DAY, 3), (2, None, 4)], "k int, t date, id int")
    right = spark.createDataFrame([(1, DAY, 5.0), (None, DAY, 6.0)], "k int, f date, v double")
    out = A.asof_backward(left, right, ["k"], "t", "f", ["v"])
    assert {(r.k, r.id, r.f, r.v) for r in out.collect()} == {
        (1, 1, DAY, 5.0), (1, 2, DAY, 5.0), (None, 3, None, None), (2, 4, None, None),
    }
    assert "Join" not in out._jdf.queryExecution().optimizedPlan().toString()


def test_timelines_pass_no_company_through_pandas(spark):
    facts = spark.createDataFrame(
        [(1, "C", "Assets", 0, "Assets", "USD", None, "2019-12-31", 1.0, "2020-01-05", "10-K", None)],
        "cik long, entity string, concept string, priority int, tag string, unit string, start string, "
        "`end` string, val double, filed string, form string, accn string",
    )
    for timeline in (FA.annual_timeline, FA.quarterly_timeline):
        out = timeline(facts)
        assert out.collect() == []
        assert "InPandas" not in out._jdf.queryExecution().optimizedPlan().toString()


def test_dates_of_usual_shape_read_as_by_pattern(spark):
    texts = ["2020-01-31", "2020-02-30", "2020-1-31", " 2020-01-31", "2020-01-31 ", "2020-01-31T00", "0999-01-01",
             "0000-01-01", "20200131", "2020-13-01", "2020-01-31\n", "+2020-01-01", "12020-01-01", "", "x", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    from perennial.functions.columns import parse_date

    got = df.select(parse_date("t").alias("a"), F.try_to_date("t", "yyyy-MM-dd").alias("b"))
    assert got.where(~F.col("a").eqNullSafe(F.col("b"))).count() == 0
    assert "CAST" in df.select(parse_date("t"))._jdf.queryExecution().analyzed().toString().upper()
