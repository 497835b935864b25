"""Screens, worklists, identities, sheets, templates and text."""

import json
from datetime import date

import pytest
from pyspark.sql import functions as F

from almanac import dims, fixed
from almanac.operators import chunks, coverage, identity, industries, kpis, screen, sheets, templates, usage
from tests.test_facts import fact, frame

METRICS = "company_id long, fiscal_year int, " + ", ".join(f"{m} double" for m in fixed.METRICS)
COMPANY = "id long, cik string, ticker string, name string, sic string, sector string"


def metric_rows(spark, *rows):
    full = [(n, 2024, *[row.get(m) for m in fixed.METRICS]) for n, row in enumerate(rows, 1)]
    return spark.createDataFrame(full, METRICS)


def companies(spark, *tickers, sector=None):
    return spark.createDataFrame([(n, f"{n:010d}", t, t.title(), None, sector) for n, t in enumerate(tickers, 1)], COMPANY)


def test_passes(spark):
    rows = metric_rows(spark, {"revenue_growth": .25}, {}, {"revenue_growth": float("nan")})

    def ids(*filters):
        return [r.company_id for r in rows.filter(screen.passes(
            [{"metric": "revenue_growth", "op": op, "value": v} for op, v in filters])).collect()]

    assert ids((">", .2)) == [1] and ids((">", .3)) == [] and ids() == [1, 2, 3]
    assert ids((">=", .25), ("<=", .25)) == [1] and ids(("<", .25)) == []


def test_screen_order_treats_zero_as_missing(spark):
    rows = metric_rows(spark, {"roe": .1, "revenue": 1.0}, {"roe": 0.0}, {"roe": -.5}, {}, {"roe": .3})
    listed = companies(spark, "a", "b", "c", "d", "e")
    spec = {"sector": None, "filters": [], "sort_by": "roe", "descending": True}
    got = screen.run_screen(rows, listed, spec)
    assert got.columns == ["ticker", "name", "sector", "fiscal_year", "net_margin", "revenue", "revenue_growth", "roe"]
    assert [r.ticker for r in got.collect()] == ["e", "a", "c", "b", "d"]
    up = screen.run_screen(rows, listed, {**spec, "descending": False})
    assert [r.ticker for r in up.collect()] == ["b", "d", "c", "a", "e"]
    assert screen.run_screen(rows, listed, {**spec, "sector": "Retail"}).count() == 0
    batch = screen.screen_batch(rows, listed, {"all": spec, "good": {
        **spec, "filters": [{"metric": "roe", "op": ">", "value": .2}]}})
    assert sorted((r.screen, r.ticker) for r in batch.collect() if r.screen == "good") == [("good", "e")]
    assert batch.count() == 6


def test_sanitised_specs(spark):
    specs = [
        {"sector": "Retail", "filters": [{"metric": "roe", "op": ">", "value": 0.1}], "sort_by": "roe"},
        {"sector": "Space", "filters": [{"metric": "magic", "op": ">", "value": 1}, {"metric": "roe", "op": "!=", "value": 1},
                                        {"metric": "roe", "op": ">", "value": "1"}, 7, {"metric": "roe", "op": "<", "value": True}],
         "sort_by": "magic", "descending": False},
        "a string", ["list"], {"filters": {"metric": "roe"}, "sort_by": 3, "descending": None}, {"descending": []}]
    rows = [(n, json.dumps(s)) for n, s in enumerate(specs)] + [(6, "not json"), (7, None)]
    got = {r.spec_id: r for r in screen.sanitize_specs(
        spark.createDataFrame(rows, "spec_id int, spec string"), spark.createDataFrame([("Retail",)], ["sector"])).collect()}
    assert len(got) == 8
    assert (got[0].sector, got[0].sort_by, got[0].descending) == ("Retail", "roe", True)
    assert [tuple(f) for f in got[0].filters] == [("roe", ">", 0.1)]
    assert (got[1].sector, got[1].sort_by, got[1].descending) == (None, None, False)
    assert [tuple(f) for f in got[1].filters] == [("roe", "<", 1.0)]
    for n in (2, 3, 6, 7):
        assert (got[n].sector, got[n].filters, got[n].sort_by, got[n].descending) == (None, [], None, True)
    assert (got[4].filters, got[4].sort_by, got[4].descending) == ([], None, False)
    assert got[5].descending is False


def test_datapoint_and_coverage_search(spark):
    kpi = spark.createDataFrame([
        (1, "RevPAR", "FY2023", "1", "a", date(2023, 1, 1), "u1"), (1, "RevPAR", "FY2024", "2", "b", date(2024, 1, 1), "u2"),
        (2, "ARR", "FY2024", "3", "c", date(2024, 1, 1), "u3")],
        "company_id long, name string, period string, value_text string, accession_number string, filed_date date, source_url string")
    listed = companies(spark, "x", "y")
    assert [(r.ticker, r.latest_value) for r in screen.search_datapoints(kpi, listed, "revp").collect()] == [("x", "2")]
    assert screen.search_datapoints(kpi, listed, "r%r").count() == 2
    rows = spark.createDataFrame([(f"t{n:02d}", "Name", "c", None, "sec" if n % 2 else "baseline") for n in range(10)],
                                 "ticker string, name string, cik string, sector string, source string")
    assert [r.ticker for r in screen.search_coverage(rows, "T0", 0, 6).collect()] == ["t01", "t03", "t05", "t07", "t09", "t00"]
    assert [r.ticker for r in screen.search_coverage(rows, "", 1, 6).collect()] == ["t02", "t04", "t06", "t08"]


def test_coverage_and_worklists(spark):
    listed_rows = [(0, n, t) for n, t in enumerate(["c", "a", "b-w", "d", "b", "e"])]
    listed = spark.createDataFrame(listed_rows, "shard long, position int, ticker string")
    known = companies(spark, "a", "b", "z", sector="Retail")
    facts = frame(spark, [fact(company=1), fact(company=2, accn=fixed.BASELINE_ACCESSION)])
    assert [(r.ticker, r.source) for r in coverage.coverage_source(known, facts).collect()] == [
        ("a", "sec"), ("b", "baseline"), ("z", "baseline")]

    def bulk(**options):
        return [r.ticker for r in coverage.bulk_worklist(listed, known, facts, **options).collect()]

    assert bulk() == ["c", "d", "b", "e"] and bulk(target=3, covered=1) == ["c", "d"] and bulk(target=1, covered=1) == []
    assert bulk(stored_only=True) == ["b"]
    kpi = spark.createDataFrame([(3,)], "company_id long")
    assert [r.ticker for r in coverage.kpi_sweep_worklist(known, kpi).collect()] == ["a", "b"]
    assert coverage.kpi_sweep_worklist(known.withColumn("sector", F.lit(None).cast("string")), kpi, True).count() == 0
    assert [r.ticker for r in coverage.kpi_extract_worklist(known, facts, kpi).collect()] == ["a"]
    checks = spark.createDataFrame([(1, date(2024, 1, 1))], "company_id long, checked date")
    assert coverage.reconcile_worklist(known, facts, checks, date(2024, 1, 15)).count() == 0
    assert coverage.reconcile_worklist(known, facts, checks, date(2024, 1, 16)).count() == 1


def test_recovery_resolves_collisions(spark):
    def with_url(company, cik):
        return (*fact(company=company)[:12], f"https://x/data/{cik}/1/", False)

    facts = frame(spark, [with_url(1, 10), with_url(2, 20), with_url(3, 20), with_url(4, 30), with_url(5, 40),
                          with_url(6, 50), with_url(7, 60)])
    known = spark.createDataFrame([(7, "0000000060", "G", "G", None, None), (9, "0000000090", "TAKEN", "T", None, None),
                                   (8, "0000000080", "CIK50", "T", None, None)], COMPANY)
    primary = spark.createDataFrame([(10, "SAME", "Ten"), (30, "SAME", "Thirty"), (40, "TAKEN", "Forty"), (50, None, None)],
                                    "cik_number long, ticker string, title string")
    got = {r.company_id: (r.cik, r.ticker, r.name) for r in identity.recover_companies(facts, known, primary).collect()}
    assert got == {1: ("0000000010", "SAME", "Ten"), 2: ("0000000020", "CIK20", "CIK20"),
                   4: ("0000000030", "CIK30", "Thirty"), 5: ("0000000040", "CIK40", "Forty")}


def test_universe_match_and_relink(spark):
    universe = spark.createDataFrame([(0, "p", "Pandora Media", "Banks"), (1, "goog", "Alphabet", ""),
                                      (2, "googl", "Alphabet Inc", "Widgets"), (3, "", "x", None), (4, "zz", "Zed", None)],
                                     "position long, ticker string, name string, sector_name string")
    ciks = spark.createDataFrame([("P", "1", "Piedmont Lithium"), ("GOOG", "2", "Alphabet Inc."), ("GOOGL", "2", "Alphabet Inc.")],
                                 "ticker string, cik string, title string")
    assert [tuple(r) for r in identity.universe_match(universe, ciks).collect()] == [("GOOG", "2", "Alphabet", None)]
    facts = frame(spark, [fact(accn="a-1"), fact(accn="b-1"), fact(accn=fixed.BASELINE_ACCESSION)])
    documents = spark.createDataFrame([(1, "a-1", "d.htm"), (1, "b-1", ""), (1, fixed.BASELINE_ACCESSION, "z")],
                                      "company_id long, accession_number string, document string")
    links = {r.accession_number: r.source_url for r in identity.relink_sources(facts, companies(spark, "t"), documents).collect()}
    assert links == {"a-1": fixed.VIEWER_URL + "1/a1/d.htm", "b-1": "u", fixed.BASELINE_ACCESSION: "u"}


def test_statement_sheets(spark):
    rows = [fact(value=1000), fact(concept="gross_profit", tag="GrossProfit", value=-400),
            fact(concept="total_assets", tag="Assets", value=5000, period="Q4"),
            fact(concept="total_assets", tag="Assets", value=4000, period="FY"),
            fact(concept="net_income", tag="NetIncomeLoss", value=7, period="Q4"),
            fact(concept="capex", tag="PaymentsToAcquirePropertyPlantAndEquipment", value=-30), fact(value=5, fy=2010, period="Q1")]
    facts = frame(spark, rows)
    cells = {(r.label, r.fiscal_year, r.fiscal_period): r.value for r in sheets.statement_grid(facts).collect()}
    assert cells == {("Revenue", 2024, "FY"): 1000.0, ("Gross Profit", 2024, "FY"): -400.0,
                     ("Total Assets", 2024, "FY"): 5000.0, ("Capital Expenditures", 2024, "FY"): -30.0}
    columns = [(r.fiscal_year, r.fiscal_period) for r in sheets.sheet_columns(facts, "quarterly").orderBy("fiscal_year").collect()]
    assert columns == [(2010, "Q1"), (2024, "Q4")]
    assert sheets.sheet_columns(facts, year_from=2011, year_to=2020).count() == 0
    margins = {(r.label, r.fiscal_year): r.value for r in sheets.statement_margins(facts).collect()}
    assert margins["Gross Margin %", 2024] == -.4 and margins["Net Margin %", 2024] == 0 and margins["Net Margin %", 2010] is None
    cash = {r.fiscal_year: r.value for r in sheets.statement_free_cash_flow(facts).collect()}
    assert cash == {2024: 30.0, 2010: 0.0}
    assert sheets.statement_free_cash_flow(facts, picked=["capex"]).count() == 0
    assert sheets.statement_margins(facts, picked=["revenue"]).count() == 0
    picked = sheets.statement_grid(facts, picked=["revenue"]).collect()
    assert [r.label for r in picked] == ["Revenue"]
    grid = {(r.canonical_concept, r.fiscal_year): r.value for r in sheets.annual_grid(facts, 8).collect()}
    assert grid["total_assets", 2024] == 4000 and grid["net_income", 2024] == 7 and ("revenue", 2010) not in grid


def test_sheet_export(spark, tmp_path):
    grid = sheets.statement_grid(frame(spark, [fact(company=c, value=c) for c in (1, 2, 3)]))
    sheets.write_sheets(grid, str(tmp_path / "sheets"))
    assert spark.read.parquet(str(tmp_path / "sheets")).exceptAll(grid).count() == 0


def test_last_years_count_from_the_bounds(spark):
    facts = frame(spark, [fact(fy=y) for y in range(2000, 2020)])
    years = sorted(r.fiscal_year for r in sheets.sheet_columns(facts, year_to=2015, max_years=10).collect())
    assert years == list(range(2006, 2016))
    assert sheets.sheet_columns(facts, year_to=2015).count() == 16 and sheets.annual_grid(facts).count() == 20


def test_eps_split(spark):
    rows = [fact(fy=y, concept=c, tag=t, value=v) for y, eps in ((2020, 20.0), (2021, 22.0), (2022, 1.1))
            for c, t, v in (("eps_diluted", "EarningsPerShareDiluted", eps), ("net_income", "NetIncomeLoss", 100.0))]
    got = {r.fiscal_year: (r.factor, r.eps_adjusted) for r in sheets.eps_split_adjust(frame(spark, rows)).collect()}
    assert got == {2020: (20, 1.0), 2021: (20, 1.1), 2022: (1, 1.1)}


def test_value_lookup(spark):
    facts = frame(spark, [fact(value=10), fact(concept="total_assets", tag="Assets", value=5, period="Q4")])
    asked = spark.createDataFrame([(1, "abc", "Revenue", 2024.2, None), (2, "abc", "total_assets", 2024.0, ""),
                                   (3, "abc", "total_assets", 2024.0, "q1"), (4, "no", "revenue", 2024.0, "FY"),
                                   (5, "abc", "revenue", 2024.0, "q4")],
                                  "request_id int, ticker string, concept string, year double, period string")
    got = {r.request_id: r.value for r in sheets.value_lookup(asked, companies(spark, "ABC"), facts).collect()}
    assert got == {1: 10.0, 2: 5.0, 3: None, 4: None, 5: None}


def test_export_manifest(spark):
    asked = spark.createDataFrame([(1, " abc, ,zz"), (2, ",".join(["abc"] * 60))], "request_id int, tickers string")
    manifest = sheets.export_manifest(asked, companies(spark, "ABC"))
    assert manifest.filter("request_id = 2").count() == 60
    assert {r.ticker: r.status for r in manifest.filter("request_id = 1").collect()} == {"ABC": "included", "ZZ": "skipped"}
    counts = {r.request_id: (r.included, r.skipped) for r in sheets.manifest_counts(manifest).collect()}
    assert counts == {1: (1, 1), 2: (60, 0)}


@pytest.mark.parametrize("expression, valid", [
    ("operating_income + stock_based_compensation", True), ("revenue", True), ("revenue-capex", True), ("revenue +", False),
    ("- revenue", False), ("revenue + - capex", False), ("revenue * capex", False), ("goodwill + revenue", False),
    ("revenue + 1", False), ("", False), ("revenue capex", False)])
def test_formulas(spark, expression, valid):
    row = spark.createDataFrame([("f", expression)], "formula_id string, expression string")
    assert templates.validate_formulas(row).first().valid is valid


def test_template_sheet(spark):
    facts = frame(spark, [fact(value=100), fact(concept="capex", tag="PaymentsToAcquirePropertyPlantAndEquipment", value=30),
                          fact(value=1, fy=2023, period="Q1")])
    rows = [{"type": "formula", "label": "Net", "expression": "revenue - capex"}, {"type": "spacer"},
            {"type": "concept", "label": "Revenue", "concept": "revenue"}, {"type": "concept", "label": "Capex", "concept": "capex"}]
    got = sorted((r.fiscal_year, r.row_no, r.value) for r in templates.template_sheet(rows, facts).collect())
    assert got == [(2023, 1, 0.0), (2024, 1, 70.0), (2024, 3, 100.0), (2024, 4, 30.0)]
    asked = spark.createDataFrame([(1, "n"), (1, "n"), (1, "unknown"), (9, "n")], "company_id long, formula_id string")
    formulas = dims.values_table(spark, ["formula_id", "expression"], [("n", "revenue - capex"), ("bad", "revenue -")])
    for period, want in (("annual", [(2023, "FY", 0.0), (2024, "FY", 70.0)]), ("quarterly", [(2023, "Q1", 1.0)])):
        sums = templates.formula_values(formulas, asked, facts, period).collect()
        assert sorted((r.fiscal_year, r.fiscal_period, r.value) for r in sums) == want
    quarters = templates.template_sheet(rows, facts, "quarterly", quarters=["Q1", "Q2"]).collect()
    assert sorted((r.fiscal_year, r.fiscal_period, r.row_no, r.value) for r in quarters) == [(2023, "Q1", 1, 1.0), (2023, "Q1", 3, 1.0)]


TEMPLATE_ROWS = "template_id long, row_no int, type string, label string, concept string, expression string"


def test_templates_as_a_table(spark):
    facts = frame(spark, [fact(value=100), fact(concept="capex", tag="PaymentsToAcquirePropertyPlantAndEquipment", value=30),
                          fact(company=2, value=7), fact(value=1, fy=2023, period="Q1")])
    rows = [(1, 1, "formula", "Net", None, "revenue - capex"), (1, 2, "spacer", None, None, None), (1, 3, "concept", "Revenue", "revenue", None),
            (1, 4, "concept", "Capex", "capex", None), (2, 1, "concept", "Revenue", "revenue", None),
            (2, 2, "formula", "FCF", None, "operating_cash_flow - capex"), (3, 1, "concept", "Sales", "revenue", None)]
    asked = spark.createDataFrame([(1, 1), (1, 2), (2, 3), (2, 1), (2, 9), (5, 1)], "company_id long, template_id long")
    got = templates.template_sheets(spark.createDataFrame(rows, TEMPLATE_ROWS), asked, facts).drop("source_url", "derived").collect()
    assert sorted(map(tuple, got)) == [
        (1, 1, 2023, "FY", 1, "Net", 0.0), (1, 1, 2024, "FY", 1, "Net", 70.0), (1, 1, 2024, "FY", 3, "Revenue", 100.0), (1, 1, 2024, "FY", 4, "Capex", 30.0),
        (2, 1, 2024, "FY", 1, "Net", 7.0), (2, 1, 2024, "FY", 3, "Revenue", 7.0), (2, 3, 2024, "FY", 1, "Sales", 7.0)]
    quarterly = templates.template_sheets(spark.createDataFrame(rows, TEMPLATE_ROWS), asked, facts, "quarterly").collect()
    assert {(r.template_id, r.fiscal_period, r.row_no, r.value) for r in quarterly} == {(1, "Q1", 1, 1.0), (1, "Q1", 3, 1.0)}


@pytest.mark.parametrize("row,error", [
    ((1, "concept", "Revenue", "revenue", None), None), ((1, "spacer", None, None, None), None), ((1, "concept", " ", "revenue", None), "no label"),
    ((1, "concept", "X", "goodwill", None), "unknown concept"), ((1, "concept", "X", None, None), "unknown concept"), ((1, "formula", None, None, "capex"), "no label"),
    ((1, "formula", "X", None, "capex - capex"), None), ((1, "formula", "X", None, "revenue - capex"), "not a row"), ((1, "formula", "X", None, "capex -"), "no formula"),
    ((1, "formula", "X", None, None), "no formula"), ((1, "chart", "X", None, None), "unknown type"), ((1, None, "X", None, None), "unknown type")])
def test_template_rows_are_checked(spark, row, error):
    rows = [(1, *row), (1, 9, "concept", "Capex", "capex", None), (2, 1, "concept", "Revenue", "revenue", None)]
    got = {(r.template_id, r.row_no): r.error for r in templates.checked_rows(spark.createDataFrame(rows, TEMPLATE_ROWS)).collect()}
    assert got == {(1, 1): error, (1, 9): None, (2, 1): None}


def plain_chunks(text, words, limit, size, step):
    scored = []
    for start in range(0, len(text), step):
        piece = text[start:start + size].lower()
        score = sum(piece.count(w.lower()) for w in words)
        if score:
            scored.append((-score, start))
    return [(start, -score) for score, start in sorted(scored)[:limit]]


def test_chunks(spark):
    filler, dense = "irrelevant text about nothing. " * 400, "RevPAR up 5% to $120. Occupancy 72%. " * 50
    texts = [filler + dense + filler, "", "nothing " * 500, "é" * 29_001 + "RevPAR", "revpar " * 9000]
    words = ["RevPAR", "occupancy"]
    frame_ = spark.createDataFrame([(n, t, words) for n, t in enumerate(texts)], "doc_id int, text string, keywords array<string>")
    for limit, size, step in ((2, 15_000, 14_500), (6, 500, 400)):
        top = chunks.top_chunks(frame_, limit=limit, size=size, step=step).orderBy("doc_id", "place").collect()
        for n, text in enumerate(texts):
            got = [(r.start, r.score) for r in top if r.doc_id == n]
            assert got == plain_chunks(text, words, limit, size, step)
        assert all(r.chunk == texts[r.doc_id][r.start:r.start + size] for r in top)
        scored = chunks.chunk_scores(frame_, size=size, step=step)
        assert scored.count() == sum(len(plain_chunks(t, words, 10**6, size, step)) for t in texts)
    whole = chunks.doc_chunks(frame_).filter("doc_id = 3").orderBy("chunk_no").collect()
    assert [len(r.chunk) for r in whole] == [15_000, 14_507, 7]


def test_sector_kpis(spark):
    rows = spark.createDataFrame([(1, "a", "Hospitality"), (2, "b", None), (3, "c", "Nowhere")], "id long, ticker string, sector string")
    got = {}
    for r in chunks.sector_kpis(rows).orderBy("id", "target_no").collect():
        got.setdefault(r.id, []).append(r.label)
    assert got[1][:4] == list(fixed.SECTOR_KPIS["Hospitality"]) and got[1][4:] == list(fixed.GENERIC_KPIS)
    assert got[2] == got[3] == list(fixed.GENERIC_KPIS)


def test_kpi_records(spark):
    good = {"name": " ARR ", "value": "1,200", "value_text": "$1.2k", "period": "FY2024", "quote": "q" * 2000}
    records = [good, {**good, "name": "arr", "period": "fy2024", "value": 5}, {**good, "name": "B", "value": True},
               {**good, "name": "C", "value": "n/a", "unit": "USD"}, {**good, "name": "D", "quote": " \n"}, [1], {**good, "name": None}]
    rows = spark.createDataFrame([(1, "x", n, json.dumps(r)) for n, r in enumerate(records)] + [(1, "x", 9, "nope")],
                                 "company_id long, accession_number string, chunk_no int, record string")
    valid = kpis.validate(rows)
    assert {r.chunk_no: r.value for r in valid.collect()} == {0: 1200.0, 1: 5.0, 2: 1.0, 3: None}
    stored = spark.createDataFrame([(1, "B", "FY2024", "x")], "company_id long, name string, period string, accession_number string")
    fresh = kpis.new_kpis(valid, stored, ["chunk_no"]).orderBy("name").collect()
    assert [(r.name, r.value, r.unit, len(r.source_quote)) for r in fresh] == [("ARR", 1200.0, "", 2000), ("C", None, "USD", 2000)]
    again = kpis.new_kpis(valid, stored.unionByName(kpis.new_kpis(valid, stored, ["chunk_no"]).select(*stored.columns)), ["chunk_no"])
    assert again.count() == 0


def test_industries(spark):
    raw = spark.createDataFrame([("Chemicals", "Materials", 1, 3, "LIN", "DCF, EV/EBITDA, ", "Volume; price/mix;; "),
                                 ("Paper", "Materials", 2, 5, "IP", "", "Volume")],
                                "industry string, sector string, phase int, complexity int, anchor_ticker string, valuation string, kpis string") \
        .withColumn("family", F.lit("Basic"))
    parsed = industries.parse_industries(raw)
    first = parsed.filter("industry = 'Chemicals'").first()
    assert first.valuation_methods == ["DCF", "EV/EBITDA"] and first.key_kpis == ["Volume", "price/mix"]
    assert industries.select_industries(parsed, phase=1).count() == 1
    assert industries.select_industries(parsed, sector="Energy").count() == 0
    volume = industries.family_rollup(parsed).filter("kpi = 'Volume'").first()
    assert (volume.members, volume.first_phase, volume.max_complexity) == (2, 1, 5)
    asked = spark.createDataFrame([("lin",), ("zz",)], "ticker string")
    assert {r.ticker: r.industry for r in industries.industry_of_ticker(asked, parsed).collect()} == {"LIN": "Chemicals", "ZZ": None}


def test_usage(spark):
    import datetime as dt

    today = date(2024, 3, 10)
    log = spark.createDataFrame([(k, dt.datetime(2024, 3, d, 5)) for k, d, n in ((1, 10, 3), (2, 10, 2), (1, 8, 7), (3, 10, 99), (1, 1, 4))
                                 for _ in range(n)], "key_id long, ts timestamp")
    keys = spark.createDataFrame([(1, 5), (2, 5), (3, 6), (4, 7)], "key_id long, account_id long")
    rows = usage.usage_daily(log, keys, today, 7)
    mine = [(r.day.day, r.requests) for r in rows.filter("account_id = 5").orderBy("day").collect()]
    assert mine == [(4, 0), (5, 0), (6, 0), (7, 0), (8, 7), (9, 0), (10, 5)]
    assert rows.filter("account_id = 7").agg(F.sum("requests")).first()[0] == 0
    with pytest.raises(ValueError):
        usage.usage_daily(log, keys, today, 0)
    assert usage.usage_daily(log, keys, today, 500).count() == 3 * 500
    totals = {r.key_id: r.requests for r in usage.usage_counts(log).filter("day is null").collect()}
    assert totals == {1: 14, 2: 2, 3: 99}


def test_subscriptions(spark):
    import datetime as dt

    def event(account, n, kind, status="active", price="p", customer="c"):
        return (account, n, dt.datetime(2024, 1, n), kind, status, price, customer, date(2024, 2, n))

    events = spark.createDataFrame([
        event(1, 1, "created"), event(1, 2, "updated", "past_due", customer=None), event(2, 1, "created", "trialing"),
        event(2, 2, "other", "canceled"), event(3, 1, "created"), event(3, 2, "deleted"), event(4, 1, "updated", price="gone")],
        "account_id long, event_id long, ts timestamp, kind string, status string, price_id string, customer_id string, period_end date")
    prices = spark.createDataFrame([("p", "pro")], "price_id string, tier string")
    state = usage.subscription_state(events, prices)
    got = {r.account_id: (r.tier, r.status, r.customer_id, r.period_end.day) for r in state.collect()}
    assert got == {1: ("free", "past_due", "c", 2), 2: ("pro", "trialing", "c", 1), 3: ("free", "canceled", "c", 1),
                   4: ("free", "active", "c", 1)}
    keys = spark.createDataFrame([(10, 2, "free"), (11, 9, "enterprise")], "key_id long, account_id long, tier string")
    assert {r.key_id: r.tier for r in usage.key_tiers(keys, state).collect()} == {10: "pro", 11: "enterprise"}


def test_stored_metrics_and_their_refresh(spark):
    from almanac.operators import metrics, screen

    facts = frame(spark, [fact(company=1, value=100), fact(company=2, concept="total_assets", tag="Assets", value=5, period="Q4"),
                          fact(company=3, value=7)])
    stored = metrics.stored_metrics(facts)
    assert {r.company_id: r.revenue for r in stored.collect()} == {1: 100.0, 2: None, 3: 7.0}
    assert metrics.missing_metrics(facts, stored).count() == 0
    newer = facts.unionByName(frame(spark, [fact(company=3, value=9, fy=2030), fact(company=1, value=1, fy=2030)]))
    fresh = metrics.refresh_metrics(stored, newer, spark.createDataFrame([(3,)], "company_id long"))
    assert {r.company_id: (r.fiscal_year, r.revenue) for r in fresh.collect()} == {1: (2024, 100.0), 2: (None, None), 3: (2030, 9.0)}
    found = screen.run_screen(fresh, companies(spark, "A", "B", "C"), {"filters": [], "sort_by": "revenue", "descending": True})
    assert "company_id" not in found.columns and all(r.fiscal_year for r in found.collect())
