"""Scalar rules on small literal frames."""

import math
import time
from datetime import date

import pytest
from pyspark.sql import functions as F

from almanac import dims, fixed
from almanac.functions import concepts, links, names, numbers, periods, text
from almanac.operators import coverage
from almanac.plans import domain
from almanac.sources.companyfacts import classify_tags


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize("end, fye, year, quarter", [
    (date(2015, 12, 26), 9, 2016, 1), (date(2016, 3, 26), 9, 2016, 2), (date(2016, 6, 25), 9, 2016, 3),
    (date(2016, 9, 24), 9, 2016, 4), (date(2016, 10, 1), 9, 2016, 4), (date(2016, 10, 29), 9, 2017, 1),
    (date(2024, 1, 28), 1, 2024, 4), (date(2023, 4, 30), 1, 2024, 1), (date(2023, 10, 29), 1, 2024, 3),
    (date(2024, 2, 1), 1, 2024, 4), (date(2024, 3, 31), 12, 2024, 1), (date(2024, 12, 31), 12, 2024, 4),
    (date(2025, 1, 2), 12, 2024, 4), (date(2016, 6, 30), 6, 2016, 4), (date(2015, 9, 30), 6, 2016, 1)])
def test_fiscal_label(spark, end, fye, year, quarter):
    assert one(spark, periods.fiscal_year(F.lit(end), F.lit(fye))) == year
    assert one(spark, periods.fiscal_quarter(F.lit(end), F.lit(fye))) == quarter


@pytest.mark.parametrize("end, period, year", [
    (date(2025, 1, 26), "FY", 2025), (date(2025, 1, 2), "FY", 2024), (date(2025, 4, 27), "Q1", 2026),
    (date(2024, 12, 28), "Q1", 2025), (date(2024, 12, 28), "Q4", 2024)])
def test_baseline_label(spark, end, period, year):
    assert one(spark, periods.baseline_fiscal_year(F.lit(end), F.lit(period))) == year


@pytest.mark.parametrize("start, end, quarterly, annual", [
    (date(2023, 7, 1), date(2023, 9, 30), True, False), (date(2023, 1, 1), date(2023, 9, 30), False, False),
    (None, date(2023, 9, 30), False, False), (date(2023, 1, 1), date(2023, 12, 31), False, True)])
def test_durations(spark, start, end, quarterly, annual):
    first = F.lit(start).cast("date")
    assert one(spark, periods.is_quarterly(first, F.lit(end))) is quarterly
    assert one(spark, periods.is_annual(first, F.lit(end))) is annual


@pytest.mark.parametrize("start, end, flow, label", [
    (None, date(2024, 3, 31), True, "Q1"), (None, date(2024, 3, 31), False, "Q1"),
    (date(2024, 1, 1), date(2024, 12, 31), True, "FY"), (date(2024, 1, 1), date(2024, 12, 31), False, None),
    (date(2024, 4, 1), date(2024, 6, 30), False, "Q2"), (date(2024, 1, 1), date(2024, 6, 30), True, None),
    (None, None, True, None)])
def test_period_label(spark, start, end, flow, label):
    got = one(spark, periods.period_label(F.lit(start).cast("date"), F.lit(end).cast("date"), F.lit(flow), F.lit(12)))
    assert got == label


@pytest.mark.parametrize("mmdd, month", [("0930", 9), ("1231", 12), ("0031", 12), ("1331", 12), ("xx31", 12),
                                         (None, 12), ("", 12)])
def test_fiscal_year_end(spark, mmdd, month):
    assert one(spark, periods.fiscal_year_end_month(F.lit(mmdd).cast("string"))) == month


def test_fiscal_year_end_of_the_domain(spark):
    i = F.col("id")
    wrong = spark.range(2000).filter(periods.fiscal_year_end_month(domain.fye_text(i)) != domain.fye_month(i))
    assert wrong.count() == 0


def test_tags(spark):
    got = {r.tag: r for r in classify_tags(spark.createDataFrame(
        [("Revenues",), ("RevenueFromContractWithCustomerExcludingAssessedTax",), ("Nothing",)], ["tag"])).collect()}
    assert set(got) == {"Revenues", "RevenueFromContractWithCustomerExcludingAssessedTax"}
    assert got["Revenues"].canonical_concept == "revenue" and got["Revenues"].priority > 0
    assert got["RevenueFromContractWithCustomerExcludingAssessedTax"].priority == 0


def test_tag_priority_equals_the_tag_table(spark):
    rows = dims.tags(spark).withColumn("p", concepts.tag_priority(F.col("tag")))
    assert rows.filter("p <> priority").count() == 0
    assert rows.filter(concepts.is_flow(F.col("canonical_concept")) != F.col("is_flow")).count() == 0
    assert one(spark, concepts.tag_priority(F.lit("Nothing"))) == fixed.UNKNOWN_TAG_PRIORITY


def test_sectors(spark):
    codes = ["7372", "3674", "6798", None, "not-a-code", "9999", "2834", "1311", "2050", "0"]
    rows = [(n, "", "", "", c, 12) for n, c in enumerate(codes)]
    frame = spark.createDataFrame(rows, "id long, cik string, ticker string, name string, sic string, fye_month int")
    got = {r.id: r.sector for r in coverage.with_sector(frame).collect()}
    assert [got[n] for n in range(len(codes))] == [
        "Software & SaaS", "Semiconductors", "REITs", None, None, "Other", "Pharmaceuticals & Biotech",
        "Oil & Gas", "Food & Beverage", "Other"]


@pytest.mark.parametrize("ours, reference, want", [
    (100.0, 100.0, 0.0), (500.0, -500.0, 0.0), (101.0, 100.0, 0.01), (0.0, 0.0, 0.0), (5.0, 0.0, math.inf)])
def test_variance(spark, ours, reference, want):
    assert one(spark, numbers.variance(F.lit(ours), F.lit(reference))) == pytest.approx(want)


@pytest.mark.parametrize("a, b, agree", [
    ("APPLE INC", "Apple Inc.", True), ("Pandora Media", "Piedmont Lithium Inc.", False), ("", "Anything", True),
    (None, "Anything", True), ("The Group", "Apple", True), ("Banco Étoile SA", "étoile, LLC", True),
    ("Johnson & Johnson", "Procter & Gamble", False)])
def test_names_agree(spark, a, b, agree):
    assert one(spark, names.names_agree(F.lit(a).cast("string"), F.lit(b))) is agree


def test_sector_names(spark):
    for theirs, ours in [("Banks", "Banking"), ("Widgets", "Widgets"), ("", None), (None, None)]:
        assert one(spark, names.sector_name(F.lit(theirs).cast("string"))) == ours


def test_links(spark):
    cik, accession = F.lit("0000320193"), F.lit("0000320193-24-000123")
    viewer = one(spark, links.audit_url(cik, accession, F.lit("a.htm")))
    assert viewer == "https://www.sec.gov/ix?doc=/Archives/edgar/data/320193/000032019324000123/a.htm"
    index = one(spark, links.audit_url(cik, accession, F.lit("")))
    assert index == "https://www.sec.gov/Archives/edgar/data/320193/000032019324000123/"
    for url in (viewer, index, fixed.COMPANY_URL + "0000320193"):
        assert one(spark, names.cik_from_url(F.lit(url))) == 320193
    assert one(spark, names.cik_from_url(F.lit("https://x.example/"))) is None


@pytest.mark.parametrize("raw, want", [("1,234.5", None), ("1234.5", 1234.5), (" 7 ", 7.0), ("1d", None),
                                       ("1e3", 1000.0), ("", None), ("n/a", None), (".5", 0.5), ("-3.", -3.0)])
def test_to_number(spark, raw, want):
    assert one(spark, numbers.to_number(F.lit(raw))) == want


def _factor(eps, income, eps_ref, income_ref):
    if not (eps and income and eps_ref and income_ref):
        return 1
    growth = abs(income_ref / eps_ref) / abs(income / eps)
    if growth < 1.5:
        return 1
    return min(fixed.SPLIT_FACTORS, key=lambda f: (abs(math.log(growth / f)), f))


@pytest.mark.parametrize("case", [(20.0, 100.0, 1.0, 100.0), (4.0, 100.0, 1.1, 120.0), (1.0, 100.0, 1.0, 140.0),
                                  (0.0, 100.0, 1.0, 100.0), (5.0, -100.0, -1.0, 100.0), (1.0, 100.0, 1.0, 170.0)])
def test_split_factor(spark, case):
    assert one(spark, numbers.split_factor(*[F.lit(x) for x in case])) == _factor(*case)
    assert one(spark, numbers.split_factor(F.lit(None).cast("double"), *[F.lit(x) for x in case[1:]])) == 1


@pytest.mark.parametrize("value, want", [(1_500_000.0, "2M"), (-2_500_000_000.0, "(2.5B)"), (999_400_000.0, "999M"),
                                         (1_000_000_000.0, "1B"), (12_345_000_000_000.0, "12,345B"), (0.0, "0M")])
def test_money(spark, value, want):
    assert one(spark, numbers.money_text(F.lit(value))) == want


def test_other_texts(spark):
    assert one(spark, numbers.plain_text(F.lit(-1234.5))) == "(1,234.5)"
    assert one(spark, numbers.plain_text(F.lit(100.0))) == "100"
    assert one(spark, numbers.metric_text(F.lit("net_margin"), F.lit(0.2345))) == "23.5%"
    assert one(spark, numbers.metric_text(F.lit("eps_diluted"), F.lit(1234.5))) == "1234.50"
    assert one(spark, numbers.metric_text(F.lit("revenue"), F.lit(5e9))) == "5B"


def test_html(spark):
    page = ("<html><head><style>p{}</style><script>var t='</p>';</script></head><body><!-- no -->"
            "<p> One <b>two</b></p>\r\n\n<td>3&nbsp;&amp;amp; 4</td></body>")
    assert one(spark, text.html_to_text(F.lit(page))) == "One\ntwo\n3\u00a0&amp; 4"


def test_keyword_score(spark):
    words = F.array(F.lit("RevPAR"), F.lit("aa"), F.lit("é"))
    assert one(spark, text.keyword_score(F.lit("revpar REVPAR aaaa É"), words)) == 2 + 2 + 1
    assert one(spark, text.keyword_score(F.lit("x"), F.array().cast("array<string>"))) == 0


BROKEN = [
    ("<p>One<p>Two</div>Three", "One\nTwo\nThree"),
    ("a < b and c > d <5 items <", "a < b and c > d <5 items <"),
    ("<b>bold<i>both</b>rest", "bold\nboth\nrest"),
    ("start <!-- never closed <p>gone</p>", "start"),
    ("a<!-->b<!--->c<!-- x --!>d<!-- y -- z -->e", "a\nb\nc\nd\ne"),
    ("<script>var a = '<!--'; if (a < b) {}</script>shown<!-- no -->too", "shown\ntoo"),
    ("<script>var t = '</scripts>';</script >ok", "ok"),
    ("<SCRIPT type='a>b'>x</Script\n>ok<script src=x>never closed <p>gone", "ok"),
    ("<style>p > a {}</style>x<styles>y</styles>", "x\ny"),
    ("<!-- <script> -->shown<!-- </script> -->", "shown"),
    ("<a title=\"x > y\" href='>'>link</a>", "link"),
    ("<a title=\"never closed>link</a> <b>next</b>", "link\nnext"),
    ("text <a href=\"cut off", "text"),
    ("<!DOCTYPE html><?xml version='1'?><![CDATA[no]]>body</>end</ x>", "body\nend"),
    ("<br/><br / >x<p/>y", "x\ny"),
    ("&amp Co &ampCo &AMP; &lt5 &copy2024 &notit; &notin; &nbsp&eacutet&eacute", "& Co &Co & <5 ©2024 ¬it; ∉ \u00a0étié".replace("étié", "été")),
    ("&hairsp;&rsquo;&rsquo s&NotEqualTilde;&fjlig;", "\u200a’&rsquo s≂̸fj"),
    ("&#65 &#x42 &#67; &#x1F600;&#0;&#128;&#99999999999;&#xD800; &#; &#x; &; &unknown; &", "A B C 😀�€�� &#; &#x; &; &unknown; &"),
    ("", ""), ("<", "<"), ("<p", ""), ("&lt;p&gt;not a tag&lt;/p&gt;", "<p>not a tag</p>"), ("&amp;lt;", "&lt;"),
]


def test_broken_markup(spark):
    got = spark.createDataFrame([(n, page) for n, (page, _) in enumerate(BROKEN)], "n int, html string").select("n", text.html_to_text(F.col("html")).alias("t")).collect()
    found = {r["n"]: r["t"] for r in got}
    assert {n: found[n] for n in found} == {n: want.strip() for n, (_, want) in enumerate(BROKEN)}


def test_names_of_references_agree_with_the_standard_library(spark):
    import html
    pages = [f"x&{name}y &{name}; &{name}" for name in [*text.NAMED, *text.OPEN_NAMES]]
    rows = spark.createDataFrame([(p,) for p in pages], "p string").select("p", text.decode_entities(F.col("p")).alias("t")).collect()
    assert all(r["t"] == html.unescape(r["p"]) for r in rows), [r for r in rows if r["t"] != html.unescape(r["p"])][:3]


def test_markup_in_linear_time(spark):
    pages = ["<a " + "x='y' " * 100_000 + ">t", "<" * 300_000, "<!--" * 100_000, "<script" * 50_000, "&amp" * 200_000, "<a '" * 50_000, "a" * 500_000]
    start = time.time()
    spark.createDataFrame([(p,) for p in pages], "html string").select(F.length(text.html_to_text(F.col("html")))).collect()
    assert time.time() - start < 60


def test_html_references_and_quoted_marks(spark):
    from almanac.functions.text import html_to_text

    pages = ["<p>Company&#8217;s net&#160;income &rsquo;s &reg; &amp;lt; &#x20AC; &#150; &unknown; a & b &#0;</p>",
             "<a title=\"a > b\">x</a> 5 < 6 <b class='q>r'>y</b>", "<p it's>open</p>", "AT&T; &copy;"]
    got = [r[0] for r in spark.createDataFrame([(p,) for p in pages], "html string").select(html_to_text(F.col("html"))).collect()]
    assert got == ["Company\u2019s net\u00a0income \u2019s \u00ae &lt; \u20ac \u2013 &unknown; a & b \ufffd",
                   "x\n5 < 6\ny", "open", "AT&T; \u00a9"]


def test_numbers_too_long_are_null(spark):
    from almanac.functions import links, names

    row = spark.createDataFrame([("http://x/data/" + "9" * 30 + "/", "abc")], "url string, cik string").select(
        names.cik_from_url(F.col("url")), links.index_url(F.col("cik"), F.col("cik"))).first()
    assert tuple(row) == (None, None)
