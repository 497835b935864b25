"""Sources, selection, derivation and appends against plain Python on small fixtures."""

import json
import random
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from almanac import fixed
from almanac.operators import metrics, pointintime, reconcile
from almanac.plans import domain
from almanac.session import cut_lineage, shared_folder
from almanac.sources import companyfacts, filings, statements, store, tickers

FACT = ("company_id long, concept string, canonical_concept string, unit string, value double, fiscal_year int, "
        "fiscal_period string, start_date date, end_date date, form string, accession_number string, "
        "filed_date date, source_url string, derived boolean")
PRIORITY = {t: n for _, _, tags in fixed.CONCEPTS for n, t in enumerate(tags)}
SF = "/root/testdata/sf0.001"


def fact(company=1, tag="Revenues", concept="revenue", value=1.0, fy=2024, period="FY", accn="a-1",
         filed=date(2024, 2, 1), derived=False, end=None):
    return (company, tag, concept, "USD", float(value), fy, period, None, end or date(fy, 12, 31), "10-K", accn,
            filed, "u", derived)


def frame(spark, rows):
    return spark.createDataFrame(rows, FACT)


def random_facts(seed, n=400):
    rng = random.Random(seed)
    names = {c: tags for c, _, tags in fixed.CONCEPTS}
    rows = {}
    for _ in range(n):
        concept = rng.choice(["revenue", "net_income", "total_assets", "eps_diluted"])
        accn = rng.choice(["a-1", "a-2", "a-3", fixed.BASELINE_ACCESSION])
        tag = "Other" if accn == fixed.BASELINE_ACCESSION else rng.choice(names[concept])
        key = (rng.choice([1, 2, 3]), tag, rng.choice([2021, 2022, 2023]), rng.choice(["Q1", "Q2", "Q3", "Q4", "FY"]), accn)
        filed = date(2024, 1, 1) + timedelta(days=rng.randrange(4))
        rows[key] = fact(key[0], tag, concept, rng.randrange(100), key[2], key[3], accn, filed)
    return list(rows.values())


def grouped(rows):
    out = {}
    for r in rows:
        out.setdefault((r[0], r[2], r[5], r[6]), []).append(r)
    return out


def current(rows):
    return min(rows, key=lambda r: (PRIORITY.get(r[1], 99), -r[11].toordinal(), r[10], r[1]))


@pytest.mark.parametrize("seed", [1, 2])
def test_selection_against_plain_python(spark, seed):
    rows = random_facts(seed)
    facts, groups = frame(spark, rows), grouped(rows)
    assert {tuple(r) for r in pointintime.latest(facts).collect()} == {current(g) for g in groups.values()}
    first = {min([r for r in g if r[10] != fixed.BASELINE_ACCESSION] or g, key=lambda r: (r[11], r[10], r[1]))
             for g in groups.values()}
    assert {tuple(r) for r in pointintime.original(facts).collect()} == first

    annual = {}
    for (company, concept, fy, period), g in groups.items():
        if period == "FY" or (period == "Q4" and (company, concept, fy, "FY") not in groups):
            annual[company, concept, fy] = current(g)[4]
    got = {(r.company_id, r.canonical_concept, r.fiscal_year): r.value
           for r in pointintime.annual_values(facts).collect()}
    assert got == annual

    growth = {k: (annual.get((k[0], k[1], k[2] - 1))) for k in annual}
    yoy = {(r.company_id, r.canonical_concept, r.fiscal_year): r.prior_value
           for r in pointintime.year_over_year(pointintime.annual_values(facts)).collect()}
    assert yoy == growth

    flows = {c for c, flow, _ in fixed.CONCEPTS if flow}
    want = {}
    for (company, concept, fy, period), g in groups.items():
        parts = [groups.get((company, concept, fy, q)) for q in ("Q1", "Q2", "Q3")]
        if period == "FY" and concept in flows and all(parts) and (company, concept, fy, "Q4") not in groups:
            want[company, concept, fy] = current(g)[4] - sum(current(p)[4] for p in parts)
    derived = {(r.company_id, r.canonical_concept, r.fiscal_year): r.value for r in pointintime.derive_q4(facts).collect()}
    assert derived == want


def test_better_tag_beats_newer_filing(spark):
    rows = [fact(tag=fixed.CONCEPTS[0][2][0], value=1, filed=date(2024, 1, 1)),
            fact(tag="Revenues", value=2, accn="a-2", filed=date(2025, 1, 1))]
    assert pointintime.latest(frame(spark, rows)).first()["value"] == 1


def test_q4_is_not_derived_twice(spark):
    rows = [fact(value=100), fact(value=20, period="Q1"), fact(value=30, period="Q2"), fact(value=10, period="Q3"),
            fact(concept="total_assets", tag="Assets", value=5), fact(concept="total_assets", tag="Assets", period="Q1"),
            fact(concept="total_assets", tag="Assets", period="Q2"), fact(concept="total_assets", tag="Assets", period="Q3")]
    once = pointintime.derive_q4(frame(spark, rows)).collect()
    assert [(r.value, r.fiscal_period, r.derived, r.start_date) for r in once] == [(40.0, "Q4", True, None)]
    both = rows + [tuple(once[0])]
    assert pointintime.derive_q4(frame(spark, both)).count() == 0
    reported = rows + [fact(value=7, period="Q4")]
    assert pointintime.derive_q4(frame(spark, reported)).count() == 0


def test_financials_filters_and_views(spark):
    rows = random_facts(3)
    facts = frame(spark, rows)
    got = pointintime.financials(facts, "revenue", 2022, "q1", "all").collect()
    assert {tuple(r) for r in got} == {r for r in rows if (r[2], r[5], r[6]) == ("revenue", 2022, "Q1")}
    keys = [(r.company_id, r.canonical_concept, r.fiscal_year, r.fiscal_period)
            for r in pointintime.financials(facts).collect()]
    assert keys == sorted(keys)
    with pytest.raises(ValueError):
        pointintime.financials(facts, point_in_time="newest")


def test_metrics_of_one_company(spark):
    rows = [fact(value=100, fy=2023), fact(value=125), fact(concept="net_income", tag="NetIncomeLoss", value=20, fy=2023),
            fact(concept="net_income", tag="NetIncomeLoss", value=30), fact(concept="gross_profit", tag="GrossProfit", value=50),
            fact(concept="operating_cash_flow", tag="NetCashProvidedByUsedInOperatingActivities", value=40),
            fact(concept="capex", tag="PaymentsToAcquirePropertyPlantAndEquipment", value=-10),
            fact(concept="stockholders_equity", tag="StockholdersEquity", value=150, period="Q4"),
            fact(company=2, concept="net_income", tag="NetIncomeLoss", value=30),
            fact(company=3, value=0, fy=2023), fact(company=3, value=5),
            fact(company=4, value=5, fy=2021), fact(company=4, value=5), fact(company=4, concept="capex",
                 tag="PaymentsToAcquirePropertyPlantAndEquipment", value=1, fy=2025)]
    got = {r.company_id: r.asDict() for r in metrics.screen_metrics(frame(spark, rows)).collect()}
    assert set(got) == {1, 3, 4}
    one = got[1]
    assert one["revenue_growth"] == pytest.approx(.25) and one["net_income_growth"] == pytest.approx(.5)
    assert one["gross_margin"] == pytest.approx(.4) and one["net_margin"] == pytest.approx(.24)
    assert one["free_cash_flow"] == 30 and one["fcf_margin"] == pytest.approx(.24) and one["roe"] == pytest.approx(.2)
    assert one["operating_margin"] is None and one["total_assets"] is None
    assert got[3]["revenue_growth"] is None                      # the prior year is 0
    assert got[4]["revenue_growth"] is None and got[4]["fiscal_year"] == 2024  # a gap; the year with revenue


def test_flatten_and_label(spark):
    entry = {"val": 5, "start": "2024-01-01", "end": "2024-03-31", "accn": "x", "form": "10-Q", "filed": "2024-05-01"}
    payload = {"facts": {"us-gaap": {
        "Revenues": {"units": {"EUR": [entry], "USD": [entry, {**entry, "val": 6}, {**entry, "val": None},
                                                       {**entry, "end": "2024-06-30"}]}},
        "Assets": {"units": {"USD": [{**entry, "start": None}, {**entry, "end": "2024-12-31"}]}},
        "Unmapped": {"units": {"USD": [entry]}}}}}
    raw = spark.createDataFrame([(1, 0, json.dumps(payload)), (2, 0, "{}"), (3, 0, "broken")],
                                "company_id long, page int, payload string")
    flat = companyfacts.flatten_facts(raw)
    assert flat.count() == 6
    companies = spark.createDataFrame([(1, "0000000009", 12)], "id long, cik string, fye_month int")
    documents = spark.createDataFrame([(1, "x", "d.htm")], "company_id long, accession_number string, document string")
    labelled = companyfacts.label_facts(flat, companies, documents)
    rows = sorted((r.concept, r.value, r.fiscal_period) for r in labelled.collect())
    assert rows == [("Assets", 5.0, "Q1"), ("Revenues", 5.0, "Q1"), ("Revenues", 6.0, "Q1")]
    assert labelled.first().source_url.endswith("/9/x/d.htm")
    empty = frame(spark, [])
    fresh = store.new_facts(labelled, empty)
    assert sorted((r.concept, r.value) for r in fresh.collect()) == [("Assets", 5.0), ("Revenues", 5.0)]


def test_append_twice_is_append_once(spark, tmp_path):
    path = str(tmp_path / "facts")
    rows = [(*fact(value=n, period=p), n) for n, p in enumerate(["Q1", "Q1", "Q2"])]
    candidates = spark.createDataFrame(rows, FACT + ", arrival int")
    frame(spark, []).write.parquet(path)
    for _ in range(2):
        store.append_facts(candidates, path)
        assert sorted(r.value for r in store.read_facts(spark, path).collect()) == [0.0, 2.0]
    assert store.read_facts(spark, path, company_id=1, fiscal_period="q2").count() == 1
    plan = store.read_facts(spark, path, concept="revenue").select("value")._jdf.queryExecution().toString()
    assert "EqualTo(canonical_concept,revenue)" in plan


def test_ingest_of_payloads_equals_the_stored_facts(spark):
    """The whole ingest reproduces the fact table, beside the entries planted to be first-wins losers."""
    entries = companyfacts.flatten_facts(domain.fact_payloads(spark, SF))
    candidates = companyfacts.label_facts(entries, domain.companies(spark, SF))
    ingested = store.first_by(candidates, store.FACT_KEY, ["arrival"]).select(*store.FACT_COLUMNS)
    filed = domain.facts(spark, SF).filter(F.col("accession_number") != fixed.BASELINE_ACCESSION)
    assert ingested.exceptAll(filed).count() == 0 and filed.exceptAll(ingested).count() == 0


def test_quarters_add_up_to_the_year(spark):
    facts = domain.complete_facts(spark, SF)
    derived = facts.filter("derived").select("company_id", "canonical_concept", "fiscal_year")
    current_facts = pointintime.latest(facts).join(derived, ["company_id", "canonical_concept", "fiscal_year"])
    sums = current_facts.groupBy("company_id", "canonical_concept", "fiscal_year").agg(
        F.sum(F.when(F.col("fiscal_period") == "FY", F.col("value"))).alias("year"),
        F.sum(F.when(F.col("fiscal_period") != "FY", F.col("value"))).alias("quarters"))
    assert sums.count() > 0
    assert sums.filter("abs(year - quarters) > 1e-6 * greatest(abs(year), 1)").count() == 0


def test_latest_has_one_row_per_key(spark):
    facts = domain.facts(spark, SF)
    assert pointintime.latest(facts).count() == facts.select(*pointintime.PERIOD_KEY).distinct().count()


def test_submissions(spark):
    def page(*rows):
        names = ("form", "accessionNumber", "filingDate", "primaryDocument")
        return json.dumps({"filings": {"recent": {n: [r[k] for r in rows] for k, n in enumerate(names)}}})

    raw = spark.createDataFrame([
        (1, 0, page(("10-Q", "a", "2024-05-01", "q.htm"), ("4", "b", "2024-04-01", "x"), ("8-K", "c", "2024-03-01", ""),
                    ("S-8", "d", "2024-02-01", "s"), ("10-K", "e", "2024-01-01", "k.htm"))),
        (1, 1, page(("10-K", "a", "2024-05-01", "later.htm"), ("10-K", "e", "2024-01-01", ""))), (2, 0, "{}")],
        "company_id long, block long, payload string")
    kept = filings.recent_filings(raw).filter("block = 0").orderBy("position").collect()
    assert [(r.form, r.position) for r in kept] == [("10-Q", 0), ("8-K", 2), ("10-K", 4)]
    assert kept[0].filed_date == date(2024, 5, 1)
    documents = {r.accession_number: r.document for r in filings.accession_documents(raw).collect()}
    assert documents == {"a": "later.htm", "b": "x", "d": "s", "e": "k.htm"}
    newest = filings.newest_filings(filings.filing_rows(raw), ["10-K", "10-Q"], 1, ["block", "position"]).collect()
    assert [r.accession_number for r in newest] == ["a"]


def test_archive_is_rewritten_in_place(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a", "10-K", date(2024, 1, 1), "d.htm"), (1, "b", "10-K", date(2024, 2, 1), "e.htm")],
                                 "company_id long, accession_number string, form string, filed_date date, document string")
    companies = spark.createDataFrame([(1, "abc")], "id long, ticker string")
    picked = filings.archive_selection(rows, companies, [" 10-k "], 5, [F.desc("filed_date")])
    assert sorted(r.path for r in picked.collect()) == ["ABC/a/d.htm", "ABC/b/e.htm"]
    path = str(tmp_path / "archive")
    for text in ("one", "two"):
        contents = spark.createDataFrame([("a", text)] + ([("b", text)] if text == "one" else []),
                                         "accession_number string, html string")
        filings.write_archive(picked, contents, path)
    stored = {r.accession_number: r.html for r in filings.archive(spark, path).read().collect()}
    assert stored == {"a": "two", "b": "one"}


def test_tickers(spark):
    payload = {"0": {"cik_str": 7, "ticker": "goog", "title": "A"}, "1": {"cik_str": 7, "ticker": "GOOGL", "title": "B"},
               "2": {"cik_str": 9, "ticker": "GOOG", "title": "C"}}
    listed = tickers.listings(spark.createDataFrame([(0, json.dumps(payload))], "shard long, payload string"))
    by_ticker = {r.ticker: (r.cik, r.title) for r in tickers.cik_by_ticker(listed).collect()}
    assert by_ticker == {"GOOG": ("0000000009", "C"), "GOOGL": ("0000000007", "B")}
    assert {r.cik_number: r.ticker for r in tickers.ticker_by_cik(listed).collect()} == {7: "GOOG", 9: "GOOG"}


def statement_frame(spark, rows, columns=None, statement="PL"):
    columns = columns or ["Fiscal Period", "Fiscal Year", "Report Date", "Publish Date", "Revenue", "Net Income"]
    payload = json.dumps([{"statement": statement, "columns": columns, "data": rows}])
    return spark.createDataFrame([(1, 0, payload)], "company_id long, page int, payload string")


def test_baseline_facts(spark):
    ciks = spark.createDataFrame([(1, "0000000001")], "company_id long, cik string")
    payload = statement_frame(spark, [
        ["FY", 2024, "2024-01-28", "2024-02-20", 100, 10], ["FY", 2024, "2024-01-28", "2024-02-20", 999, 11],
        ["FY", 2024, "2024-01-28", "2024-02-21", 101, "12"], ["Q4", 2024, "2024-01-28", None, 30],
        ["Q1", 2025, "2024-04-28", "soon", 0, True], ["H1", 2025, "2024-07-28", "", 5, 5], ["FY", 2023, "bad", "", 5, 5]])
    annual = {(r.canonical_concept, r.fiscal_year, r.fiscal_period): r for r in statements.baseline_facts(payload, ciks).collect()}
    assert {k: r.value for k, r in annual.items()} == {("revenue", 2024, "FY"): 101.0, ("net_income", 2024, "FY"): 10.0}
    assert annual["revenue", 2024, "FY"].source_url.endswith("CIK=0000000001")
    every = {(r.canonical_concept, r.fiscal_year, r.fiscal_period): (r.value, r.filed_date)
             for r in statements.baseline_facts(payload, ciks, quarterly=True).collect()}
    assert every["revenue", 2024, "Q4"] == (30.0, date(2024, 1, 28))
    assert every["revenue", 2025, "Q1"] == (0.0, date(2024, 4, 28))
    assert every["net_income", 2025, "Q1"][0] == 1.0
    assert ("revenue", 2025, "H1") not in every


def test_balances_of_the_second_source(spark):
    ciks = spark.createDataFrame([(1, "0000000001")], "company_id long, cik string")
    columns = ["Fiscal Period", "Report Date", "Total Assets"]
    payload = statement_frame(spark, [["FY", "2024-12-31", 5], ["Q4", "2024-12-31", 6], ["Q3", "2024-09-30", 7]], columns, "BS")
    assert [(r.fiscal_period, r.value) for r in statements.baseline_facts(payload, ciks).collect()] == [("Q4", 6.0)]
    no_date = statement_frame(spark, [["FY", 5]], ["Fiscal Period", "Total Assets"], "BS")
    assert statements.baseline_facts(no_date, ciks).count() == 0


def test_reconcile(spark):
    rows = [fact(value=100, end=date(2024, 1, 3), fy=2023), fact(value=110, end=date(2024, 12, 31), fy=2024),
            fact(concept="net_income", tag="NetIncomeLoss", value=-50), fact(concept="capex",
                 tag="PaymentsToAcquirePropertyPlantAndEquipment", value=0)]
    reference = spark.createDataFrame([(1, "revenue", 2024, 108.0), (1, "net_income", 2024, 50.2), (1, "capex", 2024, 3.0)],
                                      "company_id long, canonical_concept string, end_year int, reference_value double")
    compared = reconcile.compared_values(frame(spark, rows), reference)
    flagged = {r.canonical_concept: r.fiscal_year for r in reconcile.flags(compared).collect()}
    assert flagged == {"revenue": 2024, "capex": 2024}
    s = reconcile.summary(compared).first()
    assert (s.compared, s.matched, s.flagged) == (3, 1, 2)
    queue = [r.canonical_concept for r in reconcile.review_queue(reconcile.flags(compared)).collect()]
    assert queue == ["capex", "revenue"]
    stored = reconcile.flags(compared).unionByName(reconcile.flags(compared).withColumn("company_id", F.lit(2).cast("long")))
    checked = spark.createDataFrame([(1,)], "company_id long")
    left = reconcile.replace_flags(stored, reconcile.flags(compared).filter("canonical_concept = 'capex'"), checked)
    assert sorted((r.company_id, r.canonical_concept) for r in left.collect()) == [(1, "capex"), (2, "capex"), (2, "revenue")]


def test_metrics_table(spark, tmp_path):
    path = str(tmp_path / "metrics")
    metrics.write_metrics(frame(spark, [fact(value=5)]), path)
    both = frame(spark, [fact(value=99), fact(company=2, value=7)])
    metrics.write_metrics(both, path, only_missing=True)
    assert sorted((r.company_id, r.revenue) for r in spark.read.parquet(path).collect()) == [(1, 5.0), (2, 7.0)]
    metrics.write_metrics(both, path)
    assert sorted(r.revenue for r in spark.read.parquet(path).collect()) == [7.0, 99.0]


def test_shared_folder(spark):
    folder = shared_folder(spark)
    assert folder and shared_folder(spark) == folder
    assert cut_lineage(spark.range(3)).count() == 3


def test_rejected_payloads(spark):
    def payload(**entry):
        return json.dumps({"facts": {"us-gaap": {"Revenues": {"units": {"USD": [{"val": 1.0, "end": "2024-01-01", **entry}]}}}}})

    bad = [(1, 0, payload(start="")), (2, 0, payload(filed="soon")), (3, 0, payload()[:-9]), (4, 0, "{}"), (5, 0, None), (6, 0, payload())]
    payloads = spark.createDataFrame(bad, "company_id long, page int, payload string")
    reasons = {r.company_id: r.reason for r in companyfacts.rejected_payloads(payloads).collect()}
    assert reasons == {2: "unreadable date", 3: "not readable as JSON", 4: "no facts in it", 5: "not readable as JSON"}
    rows = {r.company_id: (r.start_date, r.filed_date) for r in companyfacts.flatten_facts(payloads).collect()}
    assert rows == {1: (None, None), 2: (None, None), 6: (None, None)}


def test_page_blocks_without_a_wrapper(spark):
    block = {"form": ["10-K"], "accessionNumber": ["a-1"], "filingDate": ["2024-02-30"], "primaryDocument": ["d.htm"]}
    rows = [(1, 0, json.dumps({"filings": {"recent": block}})), (2, 0, json.dumps(block)), (3, 0, "{}")]
    got = filings.filing_rows(spark.createDataFrame(rows, "company_id long, block int, payload string")).collect()
    assert sorted((r.company_id, r.accession_number, r.filed_date) for r in got) == [(1, "a-1", None), (2, "a-1", None)]


def test_statements_under_the_second_source_s_ticker(spark):
    payloads = spark.createDataFrame([("goog", 2023, "g"), ("ABC", 2023, "a"), ("GOOGL", 2023, "not ours")], "ticker string, page long, payload string")
    companies = spark.createDataFrame([(1, "GOOGL"), (2, "abc"), (3, "XYZ")], "id long, ticker string")
    got = statements.company_payloads(payloads, companies).collect()
    assert sorted((r.company_id, r.payload) for r in got) == [(1, "g"), (2, "a")]


def test_partitions_grow_with_the_books(spark, monkeypatch):
    folder = "/root/testdata/sf0.001"
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = domain.stored_books(spark, folder).count()
    assert rows > least and domain.partitions(spark, folder) == least
    monkeypatch.setattr(domain, "BOOKS_PER_PARTITION", 2)
    assert domain.partitions(spark, folder) == -(-rows // 2)
    assert domain.cells(spark, folder).rdd.getNumPartitions() == -(-rows // 2)


def test_payloads_are_parsed_once(spark):
    """Also pages without facts, which give no rows."""
    entry = {"val": 1.0, "end": "2023-12-31", "accn": "a", "form": "10-K", "filed": "2024-02-01"}
    bodies = [json.dumps({"facts": {"us-gaap": {"Assets": {"units": {"USD": [entry]}}}}}), '{"facts":{"us-gaap":{}}}', '{"facts":{}}', "no json", None]
    rows = spark.createDataFrame([(n, 0, body) for n, body in enumerate(bodies)], "company_id long, page int, payload string")
    got = companyfacts.reported_entries(rows)
    assert [(r.company_id, r.tag_no, r.unit_no, r.entry_no, r.tag, r.value) for r in got.collect()] == [(0, 0, 0, 0, "Assets", 1.0)]
    assert got._jdf.queryExecution().optimizedPlan().toString().count("from_json") == 1
