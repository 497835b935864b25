"""Every registered query with the DuckDB statement it is checked against."""

from __future__ import annotations

import datetime as dt
import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from almanac import dims, fixed
from almanac.functions import links, names, numbers, periods
from almanac.operators import (
    chunks, coverage, identity, industries, kpis, metrics, name_index, pointintime, ratelimit, reconcile,
    screen, sheets, spec_table, templates, updates, usage,
)
from almanac.plans import domain, oracle
from almanac.session import shared_folder
from almanac.sources import companyfacts, filings, html, keyed, statements, store, tickers
from almanac.streaming import admission, monitor, subscriptions
from almanac.streaming import usage as usage_stream

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}

FACT_SELECT = oracle.FACT_SELECT


def register(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(run: Query) -> Query:
        QUERIES[name] = run
        if sql is not None:
            ORACLE[name] = oracle.query(sql)
        return run

    return add


def rounded(df: DataFrame, *columns: str, digits: int = 9) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in columns})


def _run_folder(spark, name):
    """A new place for a run's output and checkpoint in the folder all executors share."""
    folder = shared_folder(spark)
    if folder is None:
        raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
    return f"{folder}/almanac/{name}-{uuid.uuid4().hex}"


# --- Sources ------------------------------------------------------------------------------

@register("flatten_facts", """
SELECT company_id, tag, unit, value, start_date, end_date, accession_number, form, filed_date FROM entries""")
def flatten_facts(spark, folder):
    return companyfacts.flatten_facts(domain.fact_payloads(spark, folder)).select(
        "company_id", "tag", "unit", "value", "start_date", "end_date", "accession_number", "form", "filed_date")


@register("classify_tags", """
SELECT canonical_concept, priority, is_flow, count(*) AS entries, count(DISTINCT company_id) AS companies
FROM (SELECT company_id, concept AS tag FROM facts UNION ALL
      SELECT company_id, 'IncomeTaxExpenseBenefit' FROM facts) f JOIN tags USING (tag)
GROUP BY canonical_concept, priority, is_flow""")
def classify_tags(spark, folder):
    facts = domain.facts(spark, folder)
    entries = facts.select("company_id", F.explode(F.array(
        F.col("concept"), F.lit("IncomeTaxExpenseBenefit"))).alias("tag"))
    # Counted per company first, so that the distinct count needs no expansion.
    per_company = companyfacts.classify_tags(entries).groupBy(
        "canonical_concept", "priority", "is_flow", "company_id").agg(F.count("*").alias("n"))
    return per_company.groupBy("canonical_concept", "priority", "is_flow").agg(
        F.sum("n").alias("entries"), F.count("*").alias("companies"))


def _candidates(spark, folder):
    entries = companyfacts.reported_entries(domain.fact_payloads(spark, folder))
    return companyfacts.label_facts(entries, domain.companies(spark, folder))


@register("ingest_rejects", """
SELECT s_suppkey AS company_id, CASE s_suppkey % 9 WHEN 0 THEN 'not readable as JSON' WHEN 1 THEN 'not readable as JSON'
  WHEN 2 THEN 'no facts in it' WHEN 3 THEN 'unreadable date' END AS reason FROM supplier WHERE s_suppkey % 9 < 4""")
def ingest_rejects(spark, folder):
    return companyfacts.rejected_payloads(domain.damaged_payloads(spark, folder)).drop("page")


@register("ingest_facts", f"SELECT {FACT_SELECT} FROM ingested")
def ingest_facts(spark, folder):
    candidates = _candidates(spark, folder)
    return store.first_by(candidates, store.FACT_KEY, ["arrival"]).select(*store.FACT_COLUMNS)


@register("idempotent_append", f"SELECT {FACT_SELECT} FROM ingested WHERE fiscal_year >= 1999")
def idempotent_append(spark, folder):
    stored = domain.facts(spark, folder).filter(F.col("fiscal_year") < 1999)
    return store.new_facts(_candidates(spark, folder), stored)


@register("recent_filings", f"""
SELECT company_id, block, position, form, accession_number, filed_date FROM submission_rows
WHERE form IN {oracle.listing(fixed.WATCHED_FORMS)}""")
def recent_filings(spark, folder):
    return filings.recent_filings(domain.submissions(spark, folder)).select(
        "company_id", "block", "position", "form", "accession_number", "filed_date")


@register("accession_documents", """
SELECT company_id, accession_number, document FROM (
  SELECT *, row_number() OVER (PARTITION BY company_id, accession_number ORDER BY block DESC, position DESC) AS rn
  FROM submission_rows WHERE document <> '') WHERE rn = 1""")
def accession_documents(spark, folder):
    return filings.accession_documents(domain.submissions(spark, folder))


@register("latest_filings", """
SELECT company_id, form, accession_number, filed_date, document, CAST(rank AS INTEGER) AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY company_id ORDER BY filed_date DESC, sequence DESC) AS rank
  FROM filings WHERE form IN ('10-K', '10-Q')) WHERE rank <= 1""")
def latest_filings(spark, folder):
    return filings.newest_filings(domain.filings(spark, folder), fixed.FINANCIAL_FORMS, 1,
                                  domain.newest_first()).drop("sequence")


@register("archive_selection", """
SELECT company_id, form, accession_number, filed_date, CAST(rank AS INTEGER) AS rank, 'S' || company_id || '/' || accession_number || '/' || document AS path
FROM (SELECT *, row_number() OVER (PARTITION BY company_id ORDER BY filed_date DESC, sequence DESC) AS rank
      FROM filings WHERE form IN ('10-K', '10-Q', '8-K')) JOIN companies ON id = company_id WHERE rank <= 5""")
def archive_selection(spark, folder):
    picked = filings.archive_selection(domain.filings(spark, folder), domain.companies(spark, folder),
                                       [" 10-k", "10-Q ", "8-K"], 5, domain.newest_first())
    return picked.select("company_id", "form", "accession_number", "filed_date", "rank", "path")


@register("ticker_dimension", """
SELECT t.ticker, t.cik, t.title, c.ticker AS primary_ticker FROM by_ticker t LEFT JOIN by_cik c USING (cik)""")
def ticker_dimension(spark, folder):
    listed = tickers.listings(domain.listing_payloads(spark, folder))
    primary = tickers.ticker_by_cik(listed).select("cik", F.col("ticker").alias("primary_ticker"))
    return tickers.cik_by_ticker(listed).join(primary, "cik", "left") \
        .select("ticker", "cik", "title", "primary_ticker")


@register("statement_unpivot", """
SELECT company_id, CAST(page AS INTEGER) AS page, statement, "column", canonical_concept, period, end_date, publish_date, value FROM statement_cells""")
def statement_unpivot(spark, folder):
    return statements.statement_unpivot(domain.statement_payloads(spark, folder)).select(
        "company_id", "page", "statement", "column", "canonical_concept", "period", "end_date",
        "publish_date", "value")


_BASELINE = f"""
SELECT company_id, '{fixed.BASELINE_TAG_PREFIX}' || "column" AS concept, canonical_concept,
       CASE canonical_concept WHEN 'eps_diluted' THEN 'USD/shares' ELSE 'USD' END AS unit, value,
       CAST(page AS INTEGER) AS fiscal_year, period AS fiscal_period, end_date, filed_date,
       '{fixed.COMPANY_URL}' || lpad(CAST(company_id + 1000 AS VARCHAR), 10, '0') AS source_url
FROM (SELECT *, row_number() OVER (PARTITION BY company_id, canonical_concept, page, period ORDER BY filed_date DESC, copy) AS rn
      FROM (SELECT *, coalesce(publish_date, end_date) AS filed_date FROM statement_cells) {{where}}) WHERE rn = 1"""


def _baseline(spark, folder, quarterly):
    ciks = domain.companies(spark, folder).select(F.col("id").alias("company_id"), "cik")
    return statements.baseline_facts(domain.statement_payloads(spark, folder), ciks, quarterly).select(
        "company_id", "concept", "canonical_concept", "unit", "value", "fiscal_year", "fiscal_period",
        "end_date", "filed_date", "source_url")


@register("baseline_facts", _BASELINE.format(where="WHERE period = CASE WHEN is_flow THEN 'FY' ELSE 'Q4' END"))
def baseline_facts(spark, folder):
    return _baseline(spark, folder, False)


@register("baseline_facts_quarterly", _BASELINE.format(where=""))
def baseline_facts_quarterly(spark, folder):
    return _baseline(spark, folder, True)


_HTML = "html"
for _pattern in (r"<!--.*?-->", r"<script\b[^>]*>.*?</script\s*>", r"<style\b[^>]*>.*?</style\s*>", r"<[^>]*>"):
    _HTML = f"regexp_replace({_HTML}, '{_pattern}', chr(10), 'gsi')"
for _entity, _char in (("&nbsp;", "\u00a0"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"),
                       ("&apos;", "''"), ("&middot;", "·"), ("&copy;", "©"), ("&ndash;", "–"),
                       ("&mdash;", "—"), ("&amp;", "&")):
    # all but these three stand without their semicolon too
    _HTML = f"regexp_replace({_HTML}, '{_entity}{'' if _entity in ('&apos;', '&ndash;', '&mdash;') else '?'}', '{_char}', 'g')"


@register("filing_text", f"""
SELECT page_id, list_aggregate(list_filter(list_transform(
  regexp_split_to_array({_HTML}, '[\\n\\r\\x0B\\f\\x1C-\\x1E\\x{{85}}\\x{{2028}}\\x{{2029}}]'),
  lambda x: regexp_replace(x, '^[\\s\\pZ]+|[\\s\\pZ]+$', '', 'g')), lambda x: x <> ''), 'string_agg', chr(10)) AS text
FROM pages""")
def filing_text(spark, folder):
    return html.filing_text(domain.table(spark, folder, "pages").select("page_id", "html"))


# --- Labels and scalar functions ----------------------------------------------------------

@register("duration_class", """
SELECT company_id, accession_number, fiscal_period, canonical_concept,
       coalesce(date_diff('day', start_date, end_date) BETWEEN 75 AND 105, false) AS quarterly,
       coalesce(date_diff('day', start_date, end_date) BETWEEN 340 AND 390, false) AS annual
FROM facts""")
def duration_class(spark, folder):
    start, end = F.col("start_date"), F.col("end_date")
    return domain.facts(spark, folder).select(
        "company_id", "accession_number", "fiscal_period", "canonical_concept",
        periods.is_quarterly(start, end).alias("quarterly"), periods.is_annual(start, end).alias("annual"))


@register("fiscal_label", """
WITH d AS (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS end_date, CAST(o_orderkey % 14 AS INTEGER) AS k FROM orders),
f AS (SELECT *, CASE WHEN k BETWEEN 1 AND 12 THEN k ELSE 12 END AS fye,
             CASE WHEN day(end_date) <= 6 THEN end_date - INTERVAL 7 DAY ELSE end_date END AS anchor FROM d)
SELECT o_orderkey, CAST(CASE WHEN month(anchor) <= fye THEN year(anchor) ELSE year(anchor) + 1 END AS INTEGER) AS fiscal_year,
       CAST(CASE WHEN (month(anchor) - fye + 12) % 12 = 0 THEN 4 ELSE ((month(anchor) - fye + 12) % 12 + 2) // 3 END AS INTEGER) AS quarter
FROM f""")
def fiscal_label(spark, folder):
    # Month texts 00 to 13: the ones outside 1 to 12 mean December.
    mmdd = F.concat(F.lpad((F.col("o_orderkey") % 14).cast("string"), 2, "0"), F.lit("31"))
    end, fye = F.to_date("o_orderdate"), periods.fiscal_year_end_month(mmdd)
    return domain.table(spark, folder, "orders").select(
        "o_orderkey", periods.fiscal_year(end, fye).alias("fiscal_year"),
        periods.fiscal_quarter(end, fye).alias("quarter"))


@register("period_label", """
SELECT company_id, tag, accession_number, unit, dup, start_date, end_date, fiscal_year, fiscal_period
FROM labelled WHERE fiscal_period IS NOT NULL""")
def period_label(spark, folder):
    labelled = _candidates(spark, folder)
    # The repeated cash entries are the second of two at one place.
    dup = (F.col("company_id") % 15 == 6) & (F.col("canonical_concept") == "cash_and_equivalents") \
        & (F.col("arrival.entry_no") % 2 == 1)
    return labelled.select("company_id", F.col("concept").alias("tag"), "accession_number", "unit",
                           dup.cast("int").alias("dup"), "start_date", "end_date", "fiscal_year", "fiscal_period")


@register("sic_sector", "SELECT id, sic, sector FROM companies")
def sic_sector(spark, folder):
    return domain.companies(spark, folder).select("id", "sic", "sector")


@register("sector_names", """
SELECT position, CASE sector_name WHEN 'Banks' THEN 'Banking' WHEN 'Restaurants' THEN 'Hospitality'
                                  WHEN 'Widgets' THEN 'Widgets' END AS sector FROM universe""")
def sector_names(spark, folder):
    return domain.universe(spark, folder).select("position", names.sector_name(F.col("sector_name")).alias("sector"))


@register("audit_links", f"""
SELECT accession_number, '{fixed.VIEWER_URL}' || (company_id + 1000) || '/' || replace(accession_number, '-', '') || '/' || document AS url
FROM filings WHERE document <> ''
UNION ALL
SELECT accession_number, '{fixed.ARCHIVE_URL}' || (company_id + 1000) || '/' || replace(accession_number, '-', '') || '/'
FROM filings WHERE document = ''""")
def audit_links(spark, folder):
    cik = names.padded_cik(F.col("company_id") + 1000)
    return domain.filings(spark, folder).select("accession_number", links.audit_url(
        cik, F.col("accession_number"), F.col("document")).alias("url"))


@register("extract_cik", """
SELECT company_id, accession_number, canonical_concept, fiscal_period, company_id + 1000 AS cik_number FROM facts""")
def extract_cik(spark, folder):
    return domain.facts(spark, folder).select(
        "company_id", "accession_number", "canonical_concept", "fiscal_period",
        names.cik_from_url(F.col("source_url")).alias("cik_number"))


@register("baseline_labels", """
WITH d AS (SELECT o_orderkey, CAST(o_orderkey % 5 AS INTEGER) AS k,
                  CASE WHEN day(o_orderdate) <= 6 THEN o_orderdate - INTERVAL 7 DAY ELSE o_orderdate END AS anchor FROM orders)
SELECT o_orderkey, CASE k WHEN 0 THEN 'FY' ELSE 'Q' || k END AS period,
       CAST(CASE k WHEN 0 THEN year(anchor) ELSE year(anchor) + (month(anchor) + 3 * (4 - k) - 1) // 12 END AS INTEGER) AS fiscal_year
FROM d""")
def baseline_labels(spark, folder):
    quarter = F.col("o_orderkey") % 5
    period = F.when(quarter == 0, "FY").otherwise(F.concat(F.lit("Q"), quarter.cast("string")))
    return domain.table(spark, folder, "orders").select(
        "o_orderkey", period.alias("period"),
        periods.baseline_fiscal_year(F.to_date("o_orderdate"), period).alias("fiscal_year"))


@register("name_guard", """
SELECT c_custkey, generic OR segment = n.other AS agree
FROM (SELECT position AS c_custkey, generic, segment FROM universe) u
JOIN (SELECT c_custkey AS k, (['BUILDING', 'MACHINERY', 'FURNITURE', 'HOUSEHOLD', 'AUTOMOBILE'])[c_nationkey % 5 + 1] AS other FROM customer) n
ON n.k = u.c_custkey""")
def name_guard(spark, folder):
    other = F.get(F.array(*[F.lit(f"The {s.title()}-Group & Co., Ltd.") for s in (
        "BUILDING", "MACHINERY", "FURNITURE", "HOUSEHOLD", "AUTOMOBILE")]), F.col("c_nationkey") % 5)
    name = F.when(F.col("c_custkey") % 13 == 0, "The Group Inc").otherwise(
        F.concat("c_mktsegment", F.lit(" Corp")))
    return domain.table(spark, folder, "customer").select(
        "c_custkey", names.names_agree(name, other).alias("agree"))


@register("variance", """
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice,
  CASE WHEN r = 0 THEN (CASE WHEN o = 0 THEN CAST(0 AS DOUBLE) ELSE CAST('inf' AS DOUBLE) END) ELSE round(abs(o - r) / r, 9) END AS variance
FROM (SELECT *, l_discount * 100 AS r, l_tax * 100 AS o FROM lineitem)""")
def variance(spark, folder):
    ours, reference = F.col("l_tax") * -100, F.col("l_discount") * 100
    return domain.table(spark, folder, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice",
        F.round(numbers.variance(ours, reference), 9).alias("variance"))


def _grouped_sql(value: str, digits: int) -> str:
    whole = f"format('{{:,}}', CAST(floor({value}) AS BIGINT))"
    if digits == 0:
        return whole
    scale = 10 ** digits
    part = f"lpad(CAST(CAST(round(({value} - floor({value})) * {scale}) AS BIGINT) AS VARCHAR), {digits}, '0')"
    return f"rtrim(rtrim({whole} || '.' || {part}, '0'), '.')"


@register("format_money", f"""
WITH a AS (SELECT l_suppkey AS company_id, CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS BIGINT)
             * (CASE WHEN l_suppkey % 3 = 0 THEN -1 ELSE 1 END) * (CASE WHEN l_suppkey % 2 = 0 THEN 100 ELSE 1 END) AS v
           FROM lineitem GROUP BY l_suppkey),
m AS (SELECT *, abs(v) / CAST(1000000 AS DOUBLE) AS mil FROM a),
t AS (SELECT *, CASE WHEN mil >= 1000 THEN {_grouped_sql("round(mil / 1000, 1)", 1)} || 'B'
                     ELSE {_grouped_sql("round(mil, 0)", 0)} || 'M' END AS txt FROM m)
SELECT company_id, CASE WHEN v < 0 THEN '(' || txt || ')' ELSE txt END AS money FROM t""")
def format_money(spark, folder):
    i = F.col("company_id")
    total = domain.table(spark, folder, "lineitem").groupBy(F.col("l_suppkey").alias("company_id")).agg(
        F.sum(domain.hundredths("l_extendedprice")).alias("v"))
    value = F.col("v") * F.when(i % 3 == 0, -1).otherwise(1) * F.when(i % 2 == 0, 100).otherwise(1)
    return total.select("company_id", numbers.money_text(value).alias("money"))



@register("format_metric", f"""
WITH a AS (SELECT company_id, UNNEST([{", ".join(f"{{'metric': '{m}', 'value': CAST({m} AS DOUBLE)}}" for m in ["revenue", "eps_diluted", "net_margin", "roe", "revenue_growth"])}]) AS u FROM metrics),
v AS (SELECT company_id, u.metric AS metric, u.value AS v, abs(u.value) / 1000000 AS mil FROM a WHERE u.value IS NOT NULL),
t AS (SELECT *, CASE WHEN mil >= 1000 THEN {_grouped_sql("round(mil / 1000, 1)", 1)} || 'B' ELSE {_grouped_sql("round(mil, 0)", 0)} || 'M' END AS money FROM v)
SELECT company_id, metric, CASE WHEN metric IN {oracle.listing(fixed.PERCENT_METRICS)} THEN printf('%.1f%%', round(v * 100, 1))
  WHEN metric = 'eps_diluted' THEN printf('%.2f', round(v, 2)) WHEN v < 0 THEN '(' || money || ')' ELSE money END AS shown,
  CASE WHEN v < 0 THEN '(' ELSE '' END || {_grouped_sql("round(abs(v), 2)", 2)} || CASE WHEN v < 0 THEN ')' ELSE '' END AS plain FROM t""")
def format_metric(spark, folder):
    names_ = ["revenue", "eps_diluted", "net_margin", "roe", "revenue_growth"]
    listed = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("v")) for m in names_])
    rows = domain.metrics_table(spark, folder).select("company_id", F.inline(listed)).filter("v is not null")
    return rows.select("company_id", "metric", numbers.metric_text(F.col("metric"), F.col("v")).alias("shown"), numbers.plain_text(F.col("v")).alias("plain"))


# --- Point in time ------------------------------------------------------------------------

@register("pit_latest", f"SELECT {FACT_SELECT} FROM latest")
def pit_latest(spark, folder):
    return pointintime.latest(domain.facts(spark, folder))


@register("pit_original", f"""
SELECT {FACT_SELECT} FROM (SELECT *, row_number() OVER (PARTITION BY company_id, canonical_concept, fiscal_year, fiscal_period
  ORDER BY accession_number = 'simfin-baseline', filed_date, accession_number, concept) AS rn FROM facts) WHERE rn = 1""")
def pit_original(spark, folder):
    return pointintime.original(domain.facts(spark, folder))


@register("pit_all", f"SELECT {FACT_SELECT} FROM facts")
def pit_all(spark, folder):
    return pointintime.financials(domain.facts(spark, folder), point_in_time="all")


@register("financials", """
SELECT company_id, canonical_concept AS concept, concept AS xbrl_tag, value, unit, fiscal_year, fiscal_period,
       strftime(end_date, '%Y-%m-%d') AS end_date, form, strftime(filed_date, '%Y-%m-%d') AS filed_date, derived, source_url
FROM latest WHERE canonical_concept = 'revenue' AND fiscal_period = 'FY'""")
def financials(spark, folder):
    rows = pointintime.financials(domain.facts(spark, folder), "revenue", fiscal_period="fy")
    return store.public_records(rows, "company_id")


@register("annual_values", """
SELECT company_id, canonical_concept, fiscal_year, fiscal_period, end_date, value FROM annual""")
def annual_values(spark, folder):
    return pointintime.annual_values(domain.facts(spark, folder))


@register("derive_q4", f"SELECT {FACT_SELECT} FROM q4")
def derive_q4(spark, folder):
    return pointintime.derive_q4(domain.facts(spark, folder))


@register("yoy_growth", """
SELECT n.company_id, n.canonical_concept, n.fiscal_year, n.value, p.value AS prior_value,
       CASE WHEN p.value <> 0 THEN round(n.value / p.value - 1, 9) END AS growth
FROM annual n LEFT JOIN annual p ON p.company_id = n.company_id AND p.canonical_concept = n.canonical_concept
  AND p.fiscal_year = n.fiscal_year - 1""")
def yoy_growth(spark, folder):
    rows = pointintime.year_over_year(pointintime.annual_values(domain.facts(spark, folder)))
    return rounded(rows, "growth").select(
        "company_id", "canonical_concept", "fiscal_year", "value", "prior_value", "growth")


@register("value_lookup", """
SELECT r.request_id, r.ticker, r.canonical_concept, r.fiscal_year, r.period,
       coalesce(l.value, CASE WHEN r.period = 'FY' THEN y.value END) AS value
FROM cell_requests r LEFT JOIN companies c ON c.ticker = r.ticker
LEFT JOIN latest l ON l.company_id = c.id AND l.canonical_concept = r.canonical_concept AND l.fiscal_year = r.fiscal_year AND l.fiscal_period = r.period
LEFT JOIN latest y ON y.company_id = c.id AND y.canonical_concept = r.canonical_concept AND y.fiscal_year = r.fiscal_year AND y.fiscal_period = 'Q4'""")
def value_lookup(spark, folder):
    return sheets.value_lookup(domain.cell_requests(spark, folder), domain.companies(spark, folder),
                               domain.facts(spark, folder))


# --- Metrics and screens ------------------------------------------------------------------

RATIOS = ["revenue_growth", "net_income_growth", "gross_margin", "operating_margin", "net_margin", "fcf_margin", "roe"]
_METRICS_SQL = "SELECT company_id, fiscal_year, " + ", ".join(
    f"round({m}, 9) AS {m}" if m in RATIOS else m for m in fixed.METRICS) + " FROM metrics"


@register("screen_metrics", _METRICS_SQL)
def screen_metrics(spark, folder):
    return rounded(metrics.screen_metrics(domain.facts(spark, folder)), *RATIOS)


@register("metrics_incremental", _METRICS_SQL + " WHERE company_id % 3 <> 1")
def metrics_incremental(spark, folder):
    facts = domain.facts(spark, folder)
    stored = domain.companies(spark, folder).filter(F.col("id") % 3 == 1).select(F.col("id").alias("company_id"))
    return rounded(metrics.missing_metrics(facts, stored).filter("fiscal_year is not null"), *RATIOS)


@register("metrics_stored", """
SELECT f.company_id, m.fiscal_year, m.revenue, m.stockholders_equity
FROM (SELECT DISTINCT company_id FROM facts) f LEFT JOIN metrics m USING (company_id)""")
def metrics_stored(spark, folder):
    return domain.metrics_table(spark, folder).select("company_id", "fiscal_year", "revenue", "stockholders_equity")


@register("metrics_refresh", _METRICS_SQL)
def metrics_refresh(spark, folder):
    """Rows of a quarter of the companies went stale; refreshed, the table is right again."""
    stale = domain.metrics_table(spark, folder).withColumn(
        "revenue", F.when(F.col("company_id") % 4 == 1, F.lit(0.0)).otherwise(F.col("revenue")))
    touched = domain.companies(spark, folder).filter(F.col("id") % 4 == 1).select(F.col("id").alias("company_id"))
    fresh = metrics.refresh_metrics(stale, domain.facts(spark, folder), touched)
    return rounded(fresh.filter("fiscal_year is not null"), *RATIOS)


SCREENS = {
    "growers": {"sector": None, "filters": [{"metric": "revenue_growth", "op": ">", "value": 0.05},
                                            {"metric": "net_margin", "op": ">=", "value": 0.1}],
                "sort_by": "revenue_growth", "descending": True},
    "retail": {"sector": "Retail", "filters": [], "sort_by": None, "descending": True},
    "weak": {"sector": None, "filters": [{"metric": "roe", "op": "<=", "value": 0.05}],
             "sort_by": "roe", "descending": False},
    "large": {"sector": None, "filters": [{"metric": "revenue", "op": ">", "value": 1e10}],
              "sort_by": "stockholders_equity", "descending": True},
}


def _screen_sql(s: dict) -> str:
    tests = [f"{f['metric']} {f['op']} CAST({f['value']!r} AS DOUBLE)" for f in s["filters"]]
    if s["sector"]:
        tests.append(f"sector = {oracle.text(s['sector'])}")
    return " AND ".join(tests) or "true"


def _shown_sql(name: str) -> str:
    shown = ", ".join(f"round({m}, 9) AS {m}" if m in RATIOS else m for m in screen.shown_metrics(SCREENS[name]))
    return (f"SELECT c.ticker, c.name, c.sector, m.fiscal_year, {shown} FROM metrics m "
            f"JOIN companies c ON c.id = m.company_id WHERE {_screen_sql(SCREENS[name])}")


def _run_screen(spark, folder, name):
    rows = screen.run_screen(domain.metrics_table(spark, folder),
                             domain.companies(spark, folder), SCREENS[name])
    return rounded(rows, *[m for m in screen.shown_metrics(SCREENS[name]) if m in RATIOS])


@register("run_screen", _shown_sql("growers"))
def run_screen(spark, folder):
    return _run_screen(spark, folder, "growers")


@register("run_screen_sector", _shown_sql("retail"))
def run_screen_sector(spark, folder):
    return _run_screen(spark, folder, "retail")


@register("screen_filter", f"SELECT company_id, fiscal_year FROM metrics WHERE {_screen_sql(SCREENS['weak'])}")
def screen_filter(spark, folder):
    return domain.metrics_table(spark, folder) \
        .filter(screen.passes(SCREENS["weak"]["filters"])).select("company_id", "fiscal_year")


@register("screen_batch", " UNION ALL ".join(
    f"SELECT '{name}' AS screen, c.ticker, m.fiscal_year, CASE WHEN coalesce({s['sort_by'] or 'revenue'}, 0) = 0 "
    f"THEN CAST('-inf' AS DOUBLE) ELSE round({s['sort_by'] or 'revenue'}, 6) END AS sort_value "
    f"FROM metrics m JOIN companies c ON c.id = m.company_id WHERE {_screen_sql(s)}"
    for name, s in SCREENS.items()))
def screen_batch(spark, folder):
    rows = screen.screen_batch(domain.metrics_table(spark, folder),
                               domain.companies(spark, folder), SCREENS)
    return rounded(rows, "sort_value", digits=6)


@register("screen_specs", """
WITH s AS (SELECT p_partkey AS k, CAST(p_size AS VARCHAR) AS n, CAST(p_size AS DOUBLE) AS x, p_size AS size,
                  p_partkey % 17 = 0 OR p_partkey % 19 = 0 AS broken FROM part)
SELECT k AS spec_id,
  CASE WHEN NOT broken AND size % 3 = 0 AND EXISTS (SELECT 1 FROM companies WHERE sector = 'Retail') THEN 'Retail' END AS sector,
  CASE WHEN broken THEN '' WHEN k % 6 = 0 THEN 'revenue_growth>' || x WHEN k % 6 = 2 THEN 'roe<=' || (x + 0.5)
       WHEN k % 6 = 5 THEN 'revenue>=1.0' ELSE '' END AS filters,
  CASE WHEN NOT broken AND k % 4 = 0 THEN 'revenue' END AS sort_by,
  broken OR k % 5 NOT IN (1, 3) AS descending
FROM s""")
def screen_specs(spark, folder):
    sectors = coverage.sector_list(domain.companies(spark, folder))
    rows = screen.sanitize_specs(domain.screen_specs(spark, folder), sectors)
    return rows.withColumn("filters", F.array_join(F.transform(
        "filters", lambda f: F.concat(f["metric"], f["op"], f["value"].cast("string"))), ";"))


@register("screen_table", """
WITH s AS (SELECT p_partkey AS k, CAST(p_size AS DOUBLE) AS x, p_size AS size,
                  p_partkey % 17 = 0 OR p_partkey % 19 = 0 AS broken FROM part)
SELECT k AS spec_id, m.company_id, c.ticker, m.fiscal_year,
  CASE WHEN coalesce(m.revenue, 0) = 0 THEN CAST('-inf' AS DOUBLE) ELSE m.revenue END AS sort_value, broken OR k % 5 NOT IN (1, 3) AS descending
FROM s, metrics m JOIN companies c ON c.id = m.company_id
WHERE (broken OR size % 3 <> 0 OR NOT EXISTS (SELECT 1 FROM companies WHERE sector = 'Retail') OR c.sector = 'Retail')
  AND coalesce(CASE WHEN broken THEN true WHEN k % 6 = 0 THEN m.revenue_growth > x WHEN k % 6 = 2 THEN m.roe <= x + 0.5
                    WHEN k % 6 = 5 THEN m.revenue >= 1 ELSE true END, false)""")
def screen_table(spark, folder):
    companies = domain.companies(spark, folder)
    specs = screen.sanitize_specs(domain.screen_specs(spark, folder), coverage.sector_list(companies))
    return spec_table.screen_table(domain.metrics_table(spark, folder), companies, specs)


@register("datapoint_search", """
SELECT ticker, company, kpi, latest_period, latest_value, source_url FROM (
  SELECT c.ticker, c.name AS company, k.name AS kpi, k.period AS latest_period, k.value_text AS latest_value, k.source_url,
         row_number() OVER (PARTITION BY k.company_id, k.name ORDER BY k.filed_date DESC, k.period, k.accession_number) AS rn
  FROM kpi_facts k JOIN companies c ON c.id = k.company_id WHERE k.name ILIKE '%a%') WHERE rn = 1""")
def datapoint_search(spark, folder):
    return screen.search_datapoints(domain.kpi_facts(spark, folder), domain.companies(spark, folder), "a")


_COVERAGE = """SELECT ticker, name, cik, sector, CASE WHEN EXISTS (
  SELECT 1 FROM facts f WHERE f.company_id = c.id AND f.accession_number <> 'simfin-baseline') THEN 'sec' ELSE 'baseline' END AS source
FROM companies c"""


@register("coverage_source", _COVERAGE)
def coverage_source(spark, folder):
    return coverage.coverage_source(domain.companies(spark, folder), domain.facts(spark, folder))


@register("coverage_search", f"""
SELECT * FROM ({_COVERAGE}) WHERE lower(ticker) LIKE '%re%' OR lower(name) LIKE '%re%' OR lower(coalesce(sector, '')) LIKE '%re%'
ORDER BY source <> 'sec', ticker LIMIT 60""")
def coverage_search(spark, folder):
    rows = coverage.coverage_source(domain.companies(spark, folder), domain.facts(spark, folder))
    return screen.search_coverage(rows, " Re ")


def _indexed(spark, *names):
    """An index of the names in a new place."""
    index = name_index.NameIndex(spark, _run_folder(spark, "names"), buckets=32)
    index.add(reduce(DataFrame.unionByName, names))
    return index


@register("datapoint_search_index", """
SELECT ticker, company, kpi, latest_period, latest_value, source_url FROM (
  SELECT c.ticker, c.name AS company, k.name AS kpi, k.period AS latest_period, k.value_text AS latest_value, k.source_url,
         row_number() OVER (PARTITION BY k.company_id, k.name ORDER BY k.filed_date DESC, k.period, k.accession_number) AS rn
  FROM kpi_facts k JOIN companies c ON c.id = k.company_id WHERE k.name ILIKE '%rev%') WHERE rn = 1""")
def datapoint_search_index(spark, folder):
    kpis = domain.kpi_facts(spark, folder)
    return screen.search_datapoints(kpis, domain.companies(spark, folder), "Rev", _indexed(spark, kpis.select("name")))


@register("coverage_search_index", f"""
SELECT * FROM ({_COVERAGE}) WHERE lower(ticker) LIKE '%re%' OR lower(name) LIKE '%re%' OR lower(coalesce(sector, '')) LIKE '%re%'
ORDER BY source <> 'sec', ticker LIMIT 60""")
def coverage_search_index(spark, folder):
    rows = coverage.coverage_source(domain.companies(spark, folder), domain.facts(spark, folder))
    index = _indexed(spark, *[rows.select(F.col(c).alias("name")) for c in ("ticker", "name", "sector")])
    return screen.search_coverage(rows, " Re ", index=index)


@register("sector_list", "SELECT DISTINCT sector FROM companies WHERE sector IS NOT NULL")
def sector_list(spark, folder):
    return coverage.sector_list(domain.companies(spark, folder))


# --- Reconciliation -----------------------------------------------------------------------

def _compared(spark, folder):
    return reconcile.compared_values(domain.facts(spark, folder),
                                     statements.reference_values(domain.statement_payloads(spark, folder)))


_FLAGS = "SELECT company_id, canonical_concept, fiscal_year, our_value, reference_value, round(variance, 6) AS variance FROM flags"


@register("reference_values", "SELECT company_id, canonical_concept, CAST(end_year AS INTEGER) AS end_year, reference_value FROM reference")
def reference_values(spark, folder):
    return statements.reference_values(domain.statement_payloads(spark, folder))


@register("crossref_flags", _FLAGS)
def crossref_flags(spark, folder):
    return rounded(reconcile.flags(_compared(spark, folder)), "variance", digits=6)


@register("review_queue", _FLAGS)
def review_queue(spark, folder):
    return rounded(reconcile.review_queue(reconcile.flags(_compared(spark, folder))), "variance", digits=6)


@register("crossref_summary", """
SELECT company_id, count(*) AS compared, count(*) FILTER (WHERE NOT variance > 0.01) AS matched,
       count(*) FILTER (WHERE variance > 0.01) AS flagged FROM compared GROUP BY company_id""")
def crossref_summary(spark, folder):
    return reconcile.summary(_compared(spark, folder))


_RELINK = f"""
SELECT {FACT_SELECT.replace('source_url', "CASE WHEN doc THEN url ELSE source_url END AS source_url")} FROM (
  SELECT *, accession_number <> 'simfin-baseline' AND month_no % 4 <> 0 AS doc,
         '{fixed.VIEWER_URL}' || (company_id + 1000) || '/' || replace(accession_number, '-', '') || '/f' || month_no || '.htm' AS url
  FROM (SELECT *, try_cast(substring(accession_number, 15, 5) AS INTEGER) AS month_no FROM facts))"""


# --- Changes to stored tables -------------------------------------------------------------

def _keyed(spark, name, schema):
    """A new stored table in buckets of companies."""
    return keyed.KeyedTable(spark, _run_folder(spark, name), schema, ["company_id"], buckets=16)


def _stored(spark, name, rows):
    table = _keyed(spark, name, rows.schema)
    table.append(rows, laid=True)
    return table


@register("append_and_refresh", f"""
SELECT {FACT_SELECT} FROM (SELECT *, row_number() OVER (
  PARTITION BY company_id, canonical_concept, fiscal_year, fiscal_period
  ORDER BY priority, filed_date DESC, accession_number, concept, derived) AS rn
  FROM (SELECT f.*, coalesce(t.priority, 99) AS priority FROM (
      SELECT {FACT_SELECT} FROM facts UNION ALL SELECT {FACT_SELECT} FROM q4) f LEFT JOIN tags t ON f.concept = t.tag)) WHERE rn = 1""")
def append_and_refresh(spark, folder):
    """A store without the filings of some companies' later years; they come in, and only their groups are selected again."""
    facts = domain.facts(spark, folder)
    late = (F.col("company_id") % 5 == 2) & (F.col("fiscal_year") >= 1997)
    stored = _stored(spark, "facts", facts.filter(~late))
    selected = _stored(spark, "selected", updates.complete_selection(stored.read()))
    arrived = facts.filter(late | (F.col("company_id") % 5 == 3)).withColumn("arrival", F.monotonically_increasing_id())
    updates.refresh_selection(selected, stored, updates.append_facts(stored, arrived))
    return selected.read()


@register("relink_stored", _RELINK)
def relink_stored(spark, folder):
    stored = _stored(spark, "facts", domain.facts(spark, folder))
    updates.relink_sources(stored, domain.companies(spark, folder), domain.fact_documents(spark, folder))
    return stored.read()


@register("metrics_refresh_stored", _METRICS_SQL)
def metrics_refresh_stored(spark, folder):
    """As ``metrics_refresh``, on tables in buckets: only those of the touched companies are written."""
    facts = _stored(spark, "facts", domain.facts(spark, folder))
    stale = domain.metrics_table(spark, folder).withColumn("revenue", F.when(F.col("company_id") % 4 == 1, F.lit(0.0)).otherwise(F.col("revenue")))
    table = _stored(spark, "metrics", stale)
    updates.refresh_metrics(table, facts, domain.companies(spark, folder).filter(F.col("id") % 4 == 1).select(F.col("id").alias("company_id")))
    return rounded(table.read().filter("fiscal_year is not null"), *RATIOS)


@register("flags_replaced", f"""
WITH found AS ({_FLAGS})
SELECT c.company_id, c.checked, f.canonical_concept, f.fiscal_year, f.our_value, f.reference_value, f.variance
FROM checks c LEFT JOIN found f ON f.company_id = c.company_id AND c.company_id % 3 <> 0
WHERE c.company_id % 3 <> 0
UNION ALL SELECT c.company_id, c.checked, 'revenue', 1990, 1, 2, 1 FROM checks c WHERE c.company_id % 3 = 0""")
def flags_replaced(spark, folder):
    """Every company has an old flag; two thirds are checked again and keep only what is found now."""
    checks = domain.checks(spark, folder)
    found = rounded(reconcile.flags(_compared(spark, folder)), "variance", digits=6)
    old = checks.select("company_id", F.lit("revenue").alias("canonical_concept"), F.lit(1990).alias("fiscal_year"), F.lit(1.0).alias("our_value"),
                        F.lit(2.0).alias("reference_value"), F.lit(1.0).alias("variance"), "checked")
    table = _stored(spark, "flags", old)
    again = checks.filter(F.col("company_id") % 3 != 0)
    updates.replace_flags(table, found.join(again.select("company_id"), "company_id", "left_semi"), again)
    return table.read()


_WANTED = """
WITH wanted AS (
  SELECT m.ticker, m.cik, m.name, m.sector, CAST(m.cik AS BIGINT) - 1000 AS company_id, c.id IS NULL AS fresh
  FROM matched m LEFT JOIN (SELECT * FROM companies WHERE id % 3 <> 0) c USING (cik)
  WHERE m.ticker NOT IN (SELECT ticker FROM companies WHERE id % 3 = 1)),
b AS ({baseline}),
filled AS (SELECT * FROM wanted WHERE company_id IN (SELECT company_id FROM b))
"""


def _baseline_run(spark, folder):
    """A third of the companies have facts, a third only their row; the second source's companies come in."""
    listed = domain.companies(spark, folder).filter(F.col("id") % 3 != 0)
    companies = keyed.KeyedTable(spark, _run_folder(spark, "companies"), listed.schema, ["id"], buckets=16)
    companies.append(listed)
    facts = _stored(spark, "facts", domain.facts(spark, folder).filter(F.col("company_id") % 3 == 1))
    table = _stored(spark, "metrics", metrics.stored_metrics(facts.read()))
    ciks = tickers.cik_by_ticker(tickers.listings(domain.listing_payloads(spark, folder)))
    universe = domain.universe(spark, folder)
    payloads = domain.statement_payloads(spark, folder).join(
        identity.universe_match(universe, ciks).select("ticker", (F.col("cik").cast("long") - 1000).alias("company_id")), "company_id")
    for _ in range(2):  # the second run finds nothing wanted
        updates.ingest_baseline(universe, ciks, payloads, companies, facts, table, F.col("cik").cast("long") - 1000)
    return companies, facts, table


@register("baseline_ingest", _WANTED.format(baseline=_BASELINE.format(where="WHERE period = CASE WHEN is_flow THEN 'FY' ELSE 'Q4' END")) + """
SELECT b.* FROM b JOIN filled USING (company_id) WHERE company_id % 3 <> 1""")
def baseline_ingest(spark, folder):
    _, facts, _ = _baseline_run(spark, folder)
    return facts.read().filter(F.col("company_id") % 3 != 1).select(
        "company_id", "concept", "canonical_concept", "unit", "value", "fiscal_year", "fiscal_period", "end_date", "filed_date", "source_url")


@register("baseline_companies", _WANTED.format(baseline=_BASELINE.format(where="WHERE period = CASE WHEN is_flow THEN 'FY' ELSE 'Q4' END")) + """
SELECT id, cik, ticker, name, sector FROM companies WHERE id % 3 <> 0
UNION ALL SELECT company_id, cik, ticker, name, sector FROM filled WHERE fresh""")
def baseline_companies(spark, folder):
    companies, _, _ = _baseline_run(spark, folder)
    return companies.read().select("id", "cik", "ticker", "name", "sector")


# --- Entities and worklists ---------------------------------------------------------------

@register("universe_match", "SELECT ticker, cik, name, sector FROM matched")
def universe_match(spark, folder):
    ciks = tickers.cik_by_ticker(tickers.listings(domain.listing_payloads(spark, folder)))
    return identity.universe_match(domain.universe(spark, folder), ciks)


@register("relink_sources", _RELINK)
def relink_sources(spark, folder):
    return identity.relink_sources(domain.facts(spark, folder), domain.companies(spark, folder),
                                   domain.fact_documents(spark, folder))


@register("recover_companies", """
WITH known AS (SELECT * FROM companies WHERE id % 4 = 0),
lost AS (SELECT DISTINCT company_id, company_id + 1000 AS cik_number FROM facts WHERE company_id NOT IN (SELECT id FROM known)),
l AS (SELECT lost.*, b.ticker, b.title FROM lost LEFT JOIN by_cik b USING (cik_number)),
own AS (SELECT company_id, cik_number, ticker, title FROM (
  SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY company_id) AS rn FROM l
  WHERE ticker IS NOT NULL AND ticker NOT IN (SELECT ticker FROM known)) WHERE rn = 1)
SELECT company_id, lpad(CAST(cik_number AS VARCHAR), 10, '0') AS cik, ticker, title AS name FROM own
UNION ALL
SELECT company_id, lpad(CAST(cik_number AS VARCHAR), 10, '0'), 'CIK' || cik_number, coalesce(title, 'CIK' || cik_number)
FROM l WHERE company_id NOT IN (SELECT company_id FROM own)""")
def recover_companies(spark, folder):
    known = domain.companies(spark, folder).filter(F.col("id") % 4 == 0)
    primary = tickers.ticker_by_cik(tickers.listings(domain.listing_payloads(spark, folder)))
    return identity.recover_companies(domain.facts(spark, folder), known, primary)


_HAVE = "SELECT ticker FROM companies WHERE id IN (SELECT company_id FROM facts WHERE accession_number <> 'simfin-baseline')"


@register("worklist_bulk", f"""
SELECT ticker, min(place) // 50 AS shard, CAST(min(place) % 50 AS INTEGER) AS position FROM listed
WHERE ticker NOT LIKE '%-%' AND ticker NOT LIKE '%.%' AND ticker NOT IN ({_HAVE})
GROUP BY ticker ORDER BY min(place) LIMIT (SELECT count(*) // 5 FROM ({_HAVE}))""")
def worklist_bulk(spark, folder):
    listed = tickers.listings(domain.listing_payloads(spark, folder))
    companies, facts = domain.companies(spark, folder), domain.facts(spark, folder)
    filed = coverage.filed_companies(facts).withColumnRenamed("company_id", "id")
    covered = companies.join(filed, "id", "left_semi").count()
    return coverage.bulk_worklist(listed, companies, facts, covered + covered // 5, covered)


@register("worklist_bulk_stored", f"""
SELECT ticker, min(place) // 50 AS shard, CAST(min(place) % 50 AS INTEGER) AS position FROM listed
WHERE ticker NOT LIKE '%-%' AND ticker NOT IN ({_HAVE}) AND ticker IN (SELECT ticker FROM companies) GROUP BY ticker""")
def worklist_bulk_stored(spark, folder):
    listed = tickers.listings(domain.listing_payloads(spark, folder))
    return coverage.bulk_worklist(listed, domain.companies(spark, folder), domain.facts(spark, folder), stored_only=True)


@register("worklist_kpi", f"""
SELECT ticker, sector, coalesce(sector IN {oracle.listing(list(fixed.SECTOR_KPIS))}, false) AS covered
FROM companies WHERE id NOT IN (SELECT company_id FROM kpi_facts)""")
def worklist_kpi(spark, folder):
    return coverage.kpi_sweep_worklist(domain.companies(spark, folder), domain.kpi_facts(spark, folder))


@register("worklist_crossref", f"""
SELECT ticker FROM companies WHERE ticker IN ({_HAVE}) AND id NOT IN (
  SELECT company_id FROM checks WHERE checked >= DATE '2001-06-17')""")
def worklist_crossref(spark, folder):
    return coverage.reconcile_worklist(domain.companies(spark, folder), domain.facts(spark, folder),
                                       domain.checks(spark, folder), dt.date(2001, 7, 1))


@register("worklist_kpi_extract", f"""
SELECT ticker FROM companies WHERE ticker IN ({_HAVE}) AND id NOT IN (SELECT company_id FROM kpi_facts)""")
def worklist_kpi_extract(spark, folder):
    return coverage.kpi_extract_worklist(domain.companies(spark, folder), domain.facts(spark, folder),
                                         domain.kpi_facts(spark, folder))


@register("worklist_baseline", """
SELECT ticker, cik FROM matched WHERE ticker NOT IN (
  SELECT ticker FROM companies WHERE id IN (SELECT company_id FROM facts))""")
def worklist_baseline(spark, folder):
    ciks = tickers.cik_by_ticker(tickers.listings(domain.listing_payloads(spark, folder)))
    candidates = identity.universe_match(domain.universe(spark, folder), ciks)
    companies, facts = domain.companies(spark, folder), domain.facts(spark, folder)
    return coverage.baseline_worklist(candidates, companies, facts).select("ticker", "cik")


# --- Sheets -------------------------------------------------------------------------------

@register("sheet_columns", "SELECT company_id, fiscal_year, 'FY' AS fiscal_period FROM annual_columns")
def sheet_columns(spark, folder):
    return sheets.sheet_columns(domain.facts(spark, folder))


@register("sheet_columns_quarterly", """
SELECT company_id, fiscal_year, fiscal_period FROM (
  SELECT *, dense_rank() OVER (PARTITION BY company_id ORDER BY fiscal_year DESC) AS r
  FROM (SELECT DISTINCT company_id, fiscal_year, fiscal_period FROM facts WHERE fiscal_year BETWEEN 1996 AND 2000))
WHERE r <= 3 AND fiscal_period IN ('Q1', 'Q4')""")
def sheet_columns_quarterly(spark, folder):
    return sheets.sheet_columns(domain.facts(spark, folder), "quarterly", 1996, 2000, ["Q1", "Q4"], max_years=3)


@register("statement_grid", """
SELECT company_id, statement, row_no, label, canonical_concept, fiscal_year, 'FY' AS fiscal_period, value, derived, source_url
FROM annual_cells JOIN layout USING (canonical_concept)""")
def statement_grid(spark, folder):
    return sheets.statement_grid(domain.complete_facts(spark, folder))


@register("statement_grid_quarterly", """
SELECT company_id, statement, row_no, label, canonical_concept, fiscal_year, fiscal_period, value, derived, source_url
FROM complete JOIN annual_columns USING (company_id, fiscal_year) JOIN layout USING (canonical_concept)
WHERE fiscal_period <> 'FY'""")
def statement_grid_quarterly(spark, folder):
    return sheets.statement_grid(domain.complete_facts(spark, folder), "quarterly")


_MARGINS = " UNION ALL ".join(
    f"SELECT company_id, fiscal_year, 'FY' AS fiscal_period, '{label}' AS label, CASE WHEN den <> 0 THEN round(coalesce(num, 0) / den, 9) END AS value "
    f"FROM annual_columns LEFT JOIN (SELECT company_id, fiscal_year, max(value) FILTER (WHERE canonical_concept = '{num}') AS num, "
    f"max(value) FILTER (WHERE canonical_concept = '{den}') AS den FROM annual_cells GROUP BY ALL) USING (company_id, fiscal_year)"
    for label, num, den in fixed.MARGIN_ROWS)


@register("statement_margins", _MARGINS)
def statement_margins(spark, folder):
    return rounded(sheets.statement_margins(domain.complete_facts(spark, folder)), "value")


@register("statement_fcf", """
SELECT company_id, fiscal_year, 'FY' AS fiscal_period, 'Free Cash Flow' AS label,
       coalesce(max(value) FILTER (WHERE canonical_concept = 'operating_cash_flow'), 0)
       - coalesce(max(value) FILTER (WHERE canonical_concept = 'capex'), 0) AS value
FROM annual_columns LEFT JOIN annual_cells USING (company_id, fiscal_year) GROUP BY company_id, fiscal_year""")
def statement_fcf(spark, folder):
    return sheets.statement_free_cash_flow(domain.complete_facts(spark, folder))


PICKED = ["revenue", "net_income", "total_assets"]


@register("statement_picker", f"""
SELECT company_id, label, fiscal_year, value FROM annual_cells JOIN layout USING (canonical_concept)
WHERE canonical_concept IN {oracle.listing(PICKED)}
UNION ALL SELECT company_id, label, fiscal_year, value FROM ({_MARGINS}) WHERE label = 'Net Margin %'""")
def statement_picker(spark, folder):
    facts = domain.complete_facts(spark, folder)
    cells = sheets.statement_grid(facts, picked=PICKED)
    ratios = rounded(sheets.statement_margins(facts, picked=PICKED), "value")
    columns = ["company_id", "label", "fiscal_year", "value"]
    return cells.select(columns).unionByName(ratios.select(columns))


@register("annual_grid", "SELECT company_id, canonical_concept, fiscal_year, value FROM grid")
def annual_grid(spark, folder):
    return sheets.annual_grid(domain.facts(spark, folder))


_FACTORS = "[" + ", ".join(map(str, fixed.SPLIT_FACTORS)) + "]"


@register("eps_split_adjust", f"""
WITH w AS (SELECT company_id, fiscal_year, max(value) FILTER (WHERE canonical_concept = 'eps_diluted') AS eps,
                  max(value) FILTER (WHERE canonical_concept = 'net_income') AS ni FROM grid GROUP BY ALL),
r AS (SELECT company_id, arg_max(eps, fiscal_year) AS eps_ref, arg_max(ni, fiscal_year) AS ni_ref
      FROM w WHERE eps IS NOT NULL AND ni IS NOT NULL GROUP BY company_id),
x AS (SELECT w.*, CASE WHEN eps <> 0 AND ni <> 0 AND eps_ref <> 0 AND ni_ref <> 0 THEN abs(ni_ref / eps_ref) / abs(ni / eps) END AS growth
      FROM w LEFT JOIN r USING (company_id) WHERE eps IS NOT NULL),
f AS (SELECT *, CASE WHEN growth >= 1.5 THEN (SELECT arg_min(k, abs(ln(growth / k)) * 1000000 + k * 0.000001)
        FROM (SELECT UNNEST({_FACTORS}) AS k)) ELSE 1 END AS factor FROM x)
SELECT company_id, fiscal_year, eps, CAST(factor AS INTEGER) AS factor, eps / factor AS eps_adjusted FROM f""")
def eps_split_adjust(spark, folder):
    return sheets.eps_split_adjust(domain.facts(spark, folder))


@register("kpi_tab", """
SELECT company_id, name, period, coalesce(CAST(value AS VARCHAR), value_text) AS shown_value, unit, source_quote FROM kpi_facts""")
def kpi_tab(spark, folder):
    return sheets.kpi_tab(domain.kpi_facts(spark, folder))


FORMULAS = [
    ("adjusted", "operating_income + stock_based_compensation"),
    ("free_cash", " operating_cash_flow-capex "),
    ("net_debt", "long_term_debt - cash_and_equivalents + revenue - revenue"),
    ("trailing", "revenue +"), ("leading", "- revenue"), ("double", "revenue + - capex"),
    ("product", "revenue * capex"), ("unknown", "revenue + goodwill"), ("number", "revenue + 1"),
]


_FORMULA_SQL = """
SELECT company_id, fiscal_year, fiscal_period, formula_id, round(sum(sign * coalesce(value, 0)), 3) AS value
FROM {columns} CROSS JOIN (VALUES ('adjusted', 'operating_income', 1), ('adjusted', 'stock_based_compensation', 1), ('free_cash', 'operating_cash_flow', 1),
  ('free_cash', 'capex', -1), ('net_debt', 'long_term_debt', 1), ('net_debt', 'cash_and_equivalents', -1), ('net_debt', 'revenue', 0))
  AS t(formula_id, canonical_concept, sign) LEFT JOIN {cells} USING (company_id, fiscal_year, fiscal_period, canonical_concept)
WHERE formula_id <> 'net_debt' OR company_id % 3 = 0 GROUP BY company_id, fiscal_year, fiscal_period, formula_id"""
_ANNUAL = {"columns": "(SELECT company_id, fiscal_year, 'FY' AS fiscal_period FROM annual_columns)",
           "cells": """(SELECT company_id, fiscal_year, 'FY' AS fiscal_period, canonical_concept, value, source_url FROM complete
  WHERE fiscal_period = CASE WHEN canonical_concept IN (SELECT canonical_concept FROM tags WHERE is_flow) THEN 'FY' ELSE 'Q4' END)"""}
_QUARTERLY = {"columns": "(SELECT DISTINCT company_id, fiscal_year, fiscal_period FROM complete WHERE fiscal_period <> 'FY')",
              "cells": "(SELECT company_id, fiscal_year, fiscal_period, canonical_concept, value, source_url FROM complete WHERE fiscal_period <> 'FY')"}


def _formulas(spark, folder, period):
    formulas = dims.values_table(spark, ["formula_id", "expression"], FORMULAS)
    asked = F.array(*[F.lit(name) for name, _ in FORMULAS if name != "net_debt"], F.when(F.col("id") % 3 == 0, "net_debt"))
    requests = domain.companies(spark, folder).select(F.col("id").alias("company_id"), F.explode(asked).alias("formula_id"))
    return rounded(templates.formula_values(formulas, requests, domain.complete_facts(spark, folder), period), "value", digits=3)


@register("template_formula", _FORMULA_SQL.format(**_ANNUAL))
def template_formula(spark, folder):
    return _formulas(spark, folder, "annual")


@register("template_formula_quarterly", _FORMULA_SQL.format(**_QUARTERLY))
def template_formula_quarterly(spark, folder):
    return _formulas(spark, folder, "quarterly")


TEMPLATE = [
    {"type": "formula", "label": "Free cash", "expression": "operating_cash_flow - capex"},
    {"type": "concept", "label": "Operating cash", "concept": "operating_cash_flow"},
    {"type": "spacer"},
    {"type": "concept", "label": "Capital spending", "concept": "capex"},
    {"type": "concept", "label": "Assets", "concept": "total_assets"},
    {"type": "formula", "label": "Sum", "expression": "capex + total_assets"},
]


_SHEET_SQL = """
WITH w AS (SELECT company_id, fiscal_year, fiscal_period, max(value) FILTER (WHERE canonical_concept = 'operating_cash_flow') AS ocf,
                  max(value) FILTER (WHERE canonical_concept = 'capex') AS capex,
                  max(value) FILTER (WHERE canonical_concept = 'total_assets') AS assets
           FROM {columns} LEFT JOIN {cells} USING (company_id, fiscal_year, fiscal_period)
           GROUP BY company_id, fiscal_year, fiscal_period)
SELECT * FROM (
  SELECT company_id, fiscal_year, fiscal_period, 1 AS row_no, 'Free cash' AS label, coalesce(ocf, 0) - coalesce(capex, 0) AS value FROM w
  UNION ALL SELECT company_id, fiscal_year, fiscal_period, 2, 'Operating cash', ocf FROM w
  UNION ALL SELECT company_id, fiscal_year, fiscal_period, 4, 'Capital spending', capex FROM w
  UNION ALL SELECT company_id, fiscal_year, fiscal_period, 5, 'Assets', assets FROM w
  UNION ALL SELECT company_id, fiscal_year, fiscal_period, 6, 'Sum', coalesce(capex, 0) + coalesce(assets, 0) FROM w) WHERE value IS NOT NULL"""


@register("template_sheet", _SHEET_SQL.format(**_ANNUAL))
def template_sheet(spark, folder):
    return templates.template_sheet(TEMPLATE, domain.complete_facts(spark, folder)).drop("derived")


@register("template_sheet_quarterly", _SHEET_SQL.format(**_QUARTERLY))
def template_sheet_quarterly(spark, folder):
    return templates.template_sheet(TEMPLATE, domain.complete_facts(spark, folder), "quarterly").drop("derived")


_CONCEPT_LIST = f"[{', '.join(oracle.text(c) for c in domain.TEMPLATE_CONCEPTS)}]"
_SHEETS_SQL = f"""
WITH asked AS (SELECT c.id AS company_id, p_partkey AS template_id, {_CONCEPT_LIST}[p_partkey % 5 + 1] AS one, {_CONCEPT_LIST}[(p_partkey + p_size) % 5 + 1] AS two,
                      p_partkey % 2 = 0 AS plus
               FROM companies c JOIN part ON p_partkey = c.id OR p_partkey = c.id + 50
               WHERE p_partkey % 11 <> 0 OR (p_partkey + 1) % 5 IN (p_partkey % 5, (p_partkey + p_size) % 5)),
w AS (SELECT a.company_id, template_id, fiscal_year, fiscal_period, plus, max(value) FILTER (WHERE canonical_concept = one) AS one,
             max(value) FILTER (WHERE canonical_concept = two) AS two, max(source_url) FILTER (WHERE canonical_concept = one) AS one_url,
             max(source_url) FILTER (WHERE canonical_concept = two) AS two_url
      FROM asked a JOIN {{columns}} USING (company_id) LEFT JOIN {{cells}} USING (company_id, fiscal_year, fiscal_period) GROUP BY ALL)
SELECT company_id, template_id, fiscal_year, fiscal_period, row_no, label, value, source_url FROM (
  SELECT *, 1 AS row_no, 'Change' AS label, coalesce(one, 0) + CASE WHEN plus THEN 1 ELSE -1 END * coalesce(two, 0) AS value, NULL AS source_url FROM w
  UNION ALL SELECT *, 2, 'One', one, one_url FROM w
  UNION ALL SELECT *, 4, 'Two', two, two_url FROM w
  UNION ALL SELECT *, 5, 'Zero', 0, NULL FROM w WHERE template_id % 11 = 0) WHERE value IS NOT NULL"""


def _many_templates(spark, folder, period):
    rows, requests = domain.template_rows(spark, folder), domain.template_requests(spark, folder)
    return templates.template_sheets(rows, requests, domain.complete_facts(spark, folder), period).drop("derived")


@register("template_sheets", _SHEETS_SQL.format(**_ANNUAL))
def template_sheets(spark, folder):
    return _many_templates(spark, folder, "annual")


@register("template_sheets_quarterly", _SHEETS_SQL.format(**_QUARTERLY))
def template_sheets_quarterly(spark, folder):
    return _many_templates(spark, folder, "quarterly")


@register("bulk_export_manifest", """
WITH wanted AS (
  SELECT p_partkey AS request_id, UNNEST(CASE WHEN p_partkey % 10 = 0 THEN list_transform(range(60), lambda n: 'S' || (n * 3))
           ELSE ['S' || (p_partkey % 110), 'S' || p_size, 'ZZ' || p_size] END) AS ticker,
         UNNEST(CASE WHEN p_partkey % 10 = 0 THEN range(60) ELSE range(3) END) AS position FROM part)
SELECT request_id, CAST(position AS INTEGER) AS position, ticker,
       CASE WHEN ticker IN (SELECT ticker FROM companies) THEN 'included' ELSE 'skipped' END AS status FROM wanted""")
def bulk_export_manifest(spark, folder):
    return sheets.export_manifest(domain.export_requests(spark, folder), domain.companies(spark, folder))


@register("bulk_export_counts", """
WITH wanted AS (
  SELECT p_partkey AS request_id, UNNEST(CASE WHEN p_partkey % 10 = 0 THEN list_transform(range(60), lambda n: 'S' || (n * 3))
           ELSE ['S' || (p_partkey % 110), 'S' || p_size, 'ZZ' || p_size] END) AS ticker FROM part)
SELECT request_id, count(c.ticker) AS included, count(*) - count(c.ticker) AS skipped
FROM wanted w LEFT JOIN companies c USING (ticker) GROUP BY request_id""")
def bulk_export_counts(spark, folder):
    return sheets.manifest_counts(sheets.export_manifest(domain.export_requests(spark, folder),
                                                         domain.companies(spark, folder)))


# --- Text and KPIs ------------------------------------------------------------------------

@register("doc_chunks", "SELECT doc_id, CAST(chunk_no AS INTEGER) AS chunk_no, CAST(start AS INTEGER) AS start, chunk FROM chunks")
def doc_chunks(spark, folder):
    return chunks.doc_chunks(domain.documents(spark, folder)).select("doc_id", "chunk_no", "start", "chunk")


@register("chunk_scores", "SELECT doc_id, CAST(chunk_no AS INTEGER) AS chunk_no, CAST(start AS INTEGER) AS start, score FROM scores")
def chunk_scores(spark, folder):
    return chunks.chunk_scores(domain.documents(spark, folder)).select("doc_id", "chunk_no", "start", "score")


@register("top_chunks", """
SELECT doc_id, CAST(place AS INTEGER) AS place, CAST(start AS INTEGER) AS start, score, chunk FROM (
  SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, start) AS place FROM scores) WHERE place <= 6""")
def top_chunks(spark, folder):
    return chunks.top_chunks(domain.documents(spark, folder)).select("doc_id", "place", "start", "score", "chunk")


@register("sector_kpis", "WITH targets(sector, position, label, keywords) AS (VALUES " + ", ".join(
    [f"({oracle.text(s)}, {n}, {oracle.text(label)}, {oracle.array(words)})" for s, targets in fixed.SECTOR_KPIS.items()
     for n, (label, words) in enumerate(targets.items())]
    + [f"(NULL, {n}, {oracle.text(label)}, {oracle.array(words)})" for n, (label, words) in enumerate(fixed.GENERIC_KPIS.items())]) + """)
SELECT id, ticker, c.sector, CAST(row_number() OVER (PARTITION BY id ORDER BY t.sector IS NULL, position) - 1 AS INTEGER) AS target_no,
       label, array_to_string(keywords, '|') AS keywords
FROM companies c JOIN targets t ON t.sector IS NULL OR t.sector = c.sector""")
def sector_kpis(spark, folder):
    return chunks.sector_kpis(domain.companies(spark, folder)) \
        .withColumn("keywords", F.array_join("keywords", "|"))


@register("kpi_validate", """
SELECT company_id, accession_number, chunk_no, name, value, value_text, unit, period, quote FROM kpi_valid""")
def kpi_validate(spark, folder):
    return kpis.validate(domain.kpi_records(spark, folder))


@register("kpi_append", """
SELECT f.company_id, f.accession_number, f.chunk_no, f.name, f.value, f.value_text, f.unit, f.period, f.quote AS source_quote
FROM kpi_found f WHERE NOT EXISTS (SELECT 1 FROM kpi_facts k WHERE k.company_id = f.company_id AND k.name = f.name
  AND k.period = f.period AND k.accession_number = f.accession_number)""")
def kpi_append(spark, folder):
    records = kpis.validate(domain.kpi_records(spark, folder))
    return kpis.new_kpis(records, domain.kpi_facts(spark, folder), ["chunk_no"])


# --- Industries ---------------------------------------------------------------------------

@register("industry_families", """
SELECT family, kpi, count(*) AS members, count(*) FILTER (WHERE phase = 1) AS first_phase, max(complexity) AS max_complexity
FROM (SELECT *, UNNEST(key_kpis) AS kpi FROM industries) GROUP BY family, kpi""")
def industry_families(spark, folder):
    return industries.family_rollup(industries.parse_industries(domain.industries(spark, folder)))


@register("industry_members", """
SELECT family, industry, sector, phase, complexity FROM industries WHERE phase = 1 AND sector = 'ECONOMY'""")
def industry_members(spark, folder):
    parsed = industries.parse_industries(domain.industries(spark, folder))
    return industries.family_members(industries.select_industries(parsed, phase=1, sector="ECONOMY"))


@register("industry_lookup", """
SELECT c.id, c.ticker, i.industry, i.family, i.sector FROM (SELECT id, ticker FROM companies) c
LEFT JOIN industries i ON i.anchor_ticker = c.ticker""")
def industry_lookup(spark, folder):
    asked = domain.companies(spark, folder).select("id", F.lower("ticker").alias("ticker"))
    return industries.industry_of_ticker(asked, domain.industries(spark, folder))


# --- Usage, limits, subscriptions ---------------------------------------------------------

@register("usage_counts", """
SELECT key_id, CAST(ts AS DATE) AS day, count(*) AS requests FROM log GROUP BY ALL
UNION ALL SELECT key_id, NULL, count(*) FROM log GROUP BY key_id""")
def usage_counts(spark, folder):
    return usage.usage_counts(domain.request_log(spark, folder))


@register("usage_daily", """
SELECT account_id, day, coalesce(n, 0) AS requests
FROM (SELECT DISTINCT account_id, CAST(UNNEST(generate_series(DATE '2024-01-11', DATE '2024-02-09', INTERVAL 1 DAY)) AS DATE) AS day FROM keys)
LEFT JOIN (SELECT key_id // 3 AS account_id, CAST(ts AS DATE) AS day, count(*) AS n FROM log GROUP BY ALL) USING (account_id, day)""")
def usage_daily(spark, folder):
    return usage.usage_daily(domain.request_log(spark, folder), domain.keys(spark, folder), dt.date(2024, 2, 9), 30)


# The log is sparse: a long window and low limits make the limiter work.
LIMITS, WINDOW_SECONDS = {"free": 1, "pro": 2, "enterprise": 3}, 86_400


def _audit(log: str, limits: dict[str, int], seconds: int) -> str:
    window = seconds * 1_000_000
    return f"""
WITH RECURSIVE hits AS (
  SELECT key_id, event_id, ts, epoch_us(ts) AS us, CASE tier WHEN 'free' THEN {limits['free']} WHEN 'pro' THEN {limits['pro']} ELSE {limits['enterprise']} END AS lim,
         row_number() OVER (PARTITION BY key_id ORDER BY ts, event_id) AS n FROM {log}),
steps AS (
  SELECT key_id, n, event_id, ts, true AS admitted, CAST(NULL AS DOUBLE) AS wait_seconds, [us] AS kept FROM hits WHERE n = 1
  UNION ALL
  SELECT h.key_id, h.n, h.event_id, h.ts, len(live) < lim,
         CASE WHEN len(live) < lim THEN NULL ELSE ({window} - (us - live[1])) / CAST(1000000 AS DOUBLE) END,
         CASE WHEN len(live) < lim THEN list_append(live, us) ELSE live END
  FROM (SELECT h.*, list_filter(s.kept, lambda x: x > h.us - {window}) AS live
        FROM steps s JOIN hits h ON h.key_id = s.key_id AND h.n = s.n + 1) h)
SELECT key_id, event_id, ts, admitted, wait_seconds FROM steps"""


_AUDIT = _audit("log", LIMITS, WINDOW_SECONDS)


@register("rate_limit_audit", _AUDIT)
def rate_limit_audit(spark, folder):
    return ratelimit.rate_limit_audit(domain.request_log(spark, folder), LIMITS, WINDOW_SECONDS)


@register("rate_limit_audit_default", _audit(f"""
  (SELECT CASE WHEN event_id % 10 = 0 THEN 0 ELSE key_id END AS key_id, tier, event_id,
          make_timestamp({domain.BUSY_START} + (epoch_us(ts) - {domain.BUSY_START}) // {domain.BUSY_FACTOR}) AS ts FROM log)""", fixed.TIER_LIMITS, fixed.LIMIT_WINDOW_SECONDS))
def rate_limit_audit_default(spark, folder):
    """The log run 40,000 times as fast, a tenth of it by one key that changes its tier all the time."""
    return ratelimit.rate_limit_audit(domain.busy_log(spark, folder))


@register("subscription_state", "SELECT account_id, tier, status, customer_id, period_end, updated FROM subs")
def subscription_state(spark, folder):
    return usage.subscription_state(domain.subscription_events(spark, folder), domain.prices(spark))


@register("key_tiers", """
SELECT key_id, k.account_id, coalesce(s.tier, k.tier) AS tier FROM keys k LEFT JOIN subs s USING (account_id)""")
def key_tiers(spark, folder):
    state = usage.subscription_state(domain.subscription_events(spark, folder), domain.prices(spark))
    return usage.key_tiers(domain.keys(spark, folder), state)


# --- Monitor and streams ------------------------------------------------------------------

@register("filing_monitor", """
SELECT company_id, count(*) AS new_filings, bool_or(form IN ('10-K', '10-Q')) AS refresh
FROM filings WHERE form IN ('10-K', '10-Q', '8-K') AND sequence % 4 = 0 GROUP BY company_id""")
def filing_monitor(spark, folder):
    fresh = monitor.new_filings(domain.filings(spark, folder), domain.seen(spark, folder))
    return monitor.refresh_list(fresh)


def _stream(spark, folder, name):
    """A table of the folder as a file stream; event times as instants, as watermarks need them."""
    rows = (spark.readStream.schema(domain.table(spark, folder, name).schema)
            .option("pathGlobFilter", f"{name}.parquet").option("maxFilesPerTrigger", 64).parquet(folder))
    return rows.withColumn("ts", F.col("ts").cast("timestamp")) if "ts" in rows.columns else rows


@register("filing_monitor_stream", """
SELECT company_id, accession_number, form, filed_date FROM filings WHERE form IN ('10-K', '10-Q', '8-K')""")
def filing_monitor_stream(spark, folder):
    place = _run_folder(spark, "monitor")
    stream = domain.filings_from_orders(_stream(spark, folder, "orders"))
    monitor.watch_filings(stream, f"{place}/seen", f"{place}/checkpoint", repeats_within="1 hour").awaitTermination()
    return monitor.seen_filings(spark, f"{place}/seen")


@register("filing_refresh_stream", """
SELECT company_id, count(*) AS new_filings, bool_or(form IN ('10-K', '10-Q')) AS refresh
FROM filings WHERE form IN ('10-K', '10-Q', '8-K') GROUP BY company_id""")
def filing_refresh_stream(spark, folder):
    place = _run_folder(spark, "monitor")
    stream = domain.filings_from_orders(_stream(spark, folder, "orders"))
    monitor.watch_filings(stream, f"{place}/seen", f"{place}/checkpoint", refresh_path=f"{place}/refresh").awaitTermination()
    return monitor.refresh_flags(spark, f"{place}/refresh")


@register("usage_stream", "SELECT key_id, CAST(ts AS DATE) AS day, count(*) AS requests FROM log GROUP BY ALL")
def count_usage(spark, folder):
    place = _run_folder(spark, "usage")
    stream = domain.requests_from_events(_stream(spark, folder, "events"))
    usage_stream.count_usage(stream, f"{place}/counts", f"{place}/checkpoint").awaitTermination()
    return usage_stream.current_counts(spark, f"{place}/counts")


@register("rate_limit_stream", _AUDIT)
def rate_limit_stream(spark, folder):
    admission.use_state_store(spark)
    place = _run_folder(spark, "admission")
    stream = domain.requests_from_events(_stream(spark, folder, "events"))
    (admission.admit_requests(stream, LIMITS, WINDOW_SECONDS, lateness="1 hour")
     .writeStream.format("parquet").option("path", f"{place}/audit")
     .option("checkpointLocation", f"{place}/checkpoint").trigger(availableNow=True).start().awaitTermination())
    audit = spark.read.schema(admission.RESULT).parquet(f"{place}/audit")
    return audit.drop("late").withColumn("ts", F.col("ts").cast("timestamp_ntz"))


def _subscriptions(spark, folder):
    """Accounts and keys as the stream of events leaves them."""
    place, keys = _run_folder(spark, "subscriptions"), domain.keys(spark, folder)
    accounts = keyed.KeyedTable(spark, f"{place}/accounts", subscriptions.ACCOUNT, ["account_id"])
    held = keyed.KeyedTable(spark, f"{place}/keys", keys.select("key_id", "account_id", "tier").schema, ["account_id"])
    held.append(keys)
    events = domain.subscriptions_from_events(_stream(spark, folder, "events"))
    subscriptions.follow_subscriptions(events, domain.prices(spark), accounts, held, f"{place}/checkpoint").awaitTermination()
    return accounts.read(), held.read()


@register("subscription_stream", "SELECT account_id, tier, status, customer_id, period_end, updated FROM subs")
def subscription_stream(spark, folder):
    return _subscriptions(spark, folder)[0]


@register("key_tiers_stream", """
SELECT key_id, k.account_id, coalesce(s.tier, k.tier) AS tier FROM keys k LEFT JOIN subs s USING (account_id)""")
def key_tiers_stream(spark, folder):
    return _subscriptions(spark, folder)[1]
