"""The same domain tables and results in DuckDB SQL, to check the Spark jobs against."""

from __future__ import annotations

from almanac import fixed
from almanac.plans import domain


def text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def listing(values: list[str]) -> str:
    return "(" + ", ".join(text(v) for v in values) + ")"


def array(values: list[str]) -> str:
    return "[" + ", ".join(text(v) for v in values) + "]"


FLOWS = [name for name, flow, _ in fixed.CONCEPTS if flow]
TAG_ROWS = ", ".join(f"({text(t)}, {text(c)}, {n}, {str(flow).lower()})"
                     for c, flow, tags in fixed.CONCEPTS for n, t in enumerate(tags))
SIC_ROWS = ", ".join(f"({lo}, {hi}, {text(s)})" for lo, hi, s in fixed.SIC_RANGES)
CIK = "lpad(CAST({} + 1000 AS VARCHAR), 10, '0')"

CTE: dict[str, str] = {}

CTE["tags"] = f"SELECT * FROM (VALUES {TAG_ROWS}) AS t(tag, canonical_concept, priority, is_flow)"
CTE["sic"] = f"SELECT * FROM (VALUES {SIC_ROWS}) AS t(lo, hi, sector)"
CTE["companies"] = f"""
SELECT id, cik, ticker, name, sic,
       CASE WHEN code IS NULL THEN NULL ELSE coalesce(
         (SELECT arg_min(s.sector, (s.hi - s.lo) * 1000 + rank_of) FROM
            (SELECT *, row_number() OVER (ORDER BY sector) AS rank_of FROM sic) s
          WHERE c.code BETWEEN s.lo AND s.hi), 'Other') END AS sector, fye_month
FROM (
  SELECT s_suppkey AS id, {CIK.format('s_suppkey')} AS cik, 'S' || s_suppkey AS ticker, s_name AS name,
         CASE WHEN s_suppkey % 31 = 0 THEN NULL WHEN s_suppkey % 37 = 5 THEN 'n/a'
              ELSE CAST(100 + (s_suppkey * 97) % 9900 AS VARCHAR) END AS sic,
         CASE WHEN s_suppkey % 31 = 0 OR s_suppkey % 37 = 5 THEN NULL
              ELSE 100 + (s_suppkey * 97) % 9900 END AS code,
         CAST(CASE WHEN s_suppkey % 29 = 0 OR s_suppkey % 23 = 0 THEN 12 ELSE 1 + s_suppkey % 12 END AS INTEGER) AS fye_month
  FROM supplier) c"""

CTE["lines"] = """
SELECT company_id, y + CASE WHEN m > fye THEN 1 ELSE 0 END AS fy, fye,
       CASE WHEN m = fye THEN 4 ELSE ((m - fye + 12) % 12 + 2) // 3 END AS quarter, kept, g, g * disc AS d, g * tax AS t, q
FROM (
  SELECT l_suppkey AS company_id, year(l_shipdate) AS y, month(l_shipdate) AS m,
         CASE WHEN l_suppkey % 29 = 0 OR l_suppkey % 23 = 0 THEN 12 ELSE 1 + l_suppkey % 12 END AS fye,
         l_returnflag <> 'R' AS kept,
         CAST(round(l_extendedprice * 100) AS BIGINT) AS g, CAST(round(l_discount * 100) AS BIGINT) AS disc,
         CAST(round(l_tax * 100) AS BIGINT) AS tax, CAST(l_quantity AS BIGINT) AS q
  FROM lineitem)"""
CTE["quarters"] = """
SELECT company_id, fy, fye, quarter, v, CAST(sum(g) AS BIGINT) AS g, CAST(sum(d) AS BIGINT) AS d,
       CAST(sum(t) AS BIGINT) AS t, CAST(sum(q) AS BIGINT) AS q
FROM (SELECT *, 1 AS v FROM lines UNION ALL SELECT *, 0 AS v FROM lines WHERE kept)
GROUP BY ALL"""
CTE["cells"] = f"""
SELECT *, {CIK.format('company_id')} || '-' || lpad(CAST(year(filed_date) % 100 AS VARCHAR), 2, '0') || '-'
          || close_month || v AS accession_number,
       CASE WHEN period IN ('FY', 'Q4') THEN '10-K' ELSE '10-Q' END AS form
FROM (
  SELECT *, CAST(end_date + CASE WHEN v = 0 THEN 40 ELSE 400 END AS DATE) AS filed_date
  FROM (
    SELECT *,
      CAST(make_date((close_month - back) // 12, (close_month - back) % 12 + 1, 1) + spill AS DATE) AS start_date,
      CAST(last_day(make_date(close_month // 12, close_month % 12 + 1, 1)) + spill AS DATE) AS end_date
    FROM (
      SELECT company_id, fy, fye, 'Q' || quarter AS period, v, g, d, t, q,
             fy * 12 + fye - 1 - (4 - quarter) * 3 AS close_month, 2 AS back,
             CAST(CASE WHEN company_id % 10 = 3 THEN 3 ELSE 0 END AS INTEGER) AS spill FROM quarters
      UNION ALL
      SELECT company_id, fy, fye, 'FY', v, CAST(sum(g) AS BIGINT), CAST(sum(d) AS BIGINT), CAST(sum(t) AS BIGINT),
             CAST(sum(q) AS BIGINT), fy * 12 + fye - 1, 11,
             CAST(CASE WHEN company_id % 10 = 3 THEN 3 ELSE 0 END AS INTEGER)
      FROM quarters GROUP BY company_id, fy, fye, v HAVING max(quarter) = 4)))"""

INCOME = ("(40 * g - 2 * d - 2 * t - CASE WHEN company_id % 9 = 0 AND fy % 3 = 0 THEN 40 ELSE 10 END * g)")
SHARES = ("((1000 + company_id % 500) * 1000 * CASE WHEN fy < 1999 THEN 1 WHEN company_id % 6 = 1 THEN 4 "
          "WHEN company_id % 6 = 2 THEN 20 ELSE 1 END)")
REVENUE_TAG = ("CASE WHEN fy <= 1996 THEN 'SalesRevenueNet' WHEN fy = 1997 OR (fy = 1998 AND v = 1) THEN 'Revenues' "
               "WHEN fy >= 2000 AND company_id % 6 = 1 THEN 'RevenueFromContractWithCustomerIncludingAssessedTax' "
               "ELSE 'RevenueFromContractWithCustomerExcludingAssessedTax' END")
AMOUNTS = {
    "revenue": (REVENUE_TAG, "CASE WHEN company_id % 13 = 4 THEN NULL WHEN company_id % 17 = 2 AND fy % 5 = 0 THEN 0 "
                             "ELSE 100 * g - d END"),
    "cost_of_revenue": ("CASE WHEN company_id % 2 = 0 THEN 'CostOfRevenue' WHEN v = 0 THEN 'CostOfGoodsSold' "
                        "ELSE 'CostOfGoodsAndServicesSold' END", "60 * g"),
    "gross_profit": ("'GrossProfit'", "40 * g - d"),
    "research_development": ("'ResearchAndDevelopmentExpense'", "CASE WHEN company_id % 7 <> 0 THEN d END"),
    "sga_expense": ("CASE WHEN company_id % 3 = 0 THEN 'GeneralAndAdministrativeExpense' "
                    "ELSE 'SellingGeneralAndAdministrativeExpense' END", "2 * t"),
    "operating_income": ("'OperatingIncomeLoss'", "40 * g - 2 * d - 2 * t"),
    "net_income": ("CASE WHEN v = 0 AND company_id % 8 = 0 THEN 'ProfitLoss' ELSE 'NetIncomeLoss' END", INCOME),
    "eps_diluted": ("'EarningsPerShareDiluted'",
                    f"CAST({INCOME} AS DOUBLE) / CAST(10000 AS DOUBLE) / CAST({SHARES} AS DOUBLE)"),
    "shares_diluted": ("'WeightedAverageNumberOfDilutedSharesOutstanding'", SHARES),
    "operating_cash_flow": ("CASE WHEN company_id % 5 = 2 THEN "
                            "'NetCashProvidedByUsedInOperatingActivitiesContinuingOperations' "
                            "ELSE 'NetCashProvidedByUsedInOperatingActivities' END", "40 * g - d - t"),
    "capex": ("'PaymentsToAcquirePropertyPlantAndEquipment'",
              "CASE WHEN company_id % 4 = 1 THEN -1000 * q ELSE 1000 * q END"),
    "stock_based_compensation": ("'ShareBasedCompensation'", "CASE WHEN fy % 2 = 0 THEN t END"),
    "cash_and_equivalents": ("'CashAndCashEquivalentsAtCarryingValue'", "20 * g + t"),
    "total_assets": ("'Assets'", "300 * g + q"),
    "total_liabilities": ("'Liabilities'", "180 * g + 3 * d"),
    "stockholders_equity": ("CASE WHEN company_id % 6 = 0 THEN "
                            "'StockholdersEquityIncludingPortionAttributableToNoncontrollingInterest' "
                            "ELSE 'StockholdersEquity' END",
                            "CASE WHEN company_id % 11 = 0 THEN 0 ELSE 120 * g + q - 3 * d END"),
    "long_term_debt": ("CASE WHEN v = 1 AND company_id % 4 = 2 THEN 'LongTermDebt' ELSE 'LongTermDebtNoncurrent' END",
                       "50 * g"),
}
FACTOR = ("CASE (company_id + fy) % 7 WHEN 0 THEN CAST(1030 AS DOUBLE) WHEN 1 THEN CAST(1005 AS DOUBLE) "
          "ELSE CAST(1000 AS DOUBLE) END")


def baseline_amount(concept: str) -> str:
    sign = "-1000" if concept == "capex" else "1000"
    return f"CAST({AMOUNTS[concept][1]} AS DOUBLE) * {FACTOR} / CAST({sign} AS DOUBLE)"


def _reported(concept: str) -> str:
    return "(period <> 'Q4' OR company_id % 5 = 0)" if concept in FLOWS else "period <> 'FY'"


def _entry(concept: str, tag: str, unit: str, value: str, when: str, extra: str) -> str:
    return (f"{{'canonical_concept': {text(concept)}, 'concept': {tag}, 'unit': {text(unit)}, "
            f"'value': CASE WHEN {when} THEN CAST({value} AS DOUBLE) END, {extra}}}")


_filed = [_entry(c, tag, domain.UNITS.get(c, "USD"), amount, f"company_id % 10 <> 0 AND {_reported(c)}",
                 "'base': false") for c, (tag, amount) in AMOUNTS.items()]
_second = [_entry(c, text(fixed.BASELINE_TAG_PREFIX + col), domain.UNITS.get(c, "USD"), baseline_amount(c),
                  f"v = 1 AND (company_id % 10 = 0 OR company_id % 3 = 0) AND period = '{'FY' if flow else 'Q4'}'",
                  "'base': true") for _, col, c, flow in fixed.INGEST_FIELDS]
CTE["facts"] = f"""
SELECT company_id, s.concept AS concept, s.canonical_concept AS canonical_concept, s.unit AS unit, s.value AS value,
       CAST(fy AS INTEGER) AS fiscal_year, period AS fiscal_period,
       CASE WHEN NOT s.base AND s.canonical_concept IN {listing(FLOWS)} THEN start_date END AS start_date, end_date,
       CASE WHEN s.base THEN '{fixed.BASELINE_FORM}' ELSE form END AS form,
       CASE WHEN s.base THEN '{fixed.BASELINE_ACCESSION}' ELSE accession_number END AS accession_number,
       CASE WHEN s.base THEN (CASE WHEN company_id % 5 = 1 THEN end_date ELSE CAST(end_date + 60 AS DATE) END)
            ELSE filed_date END AS filed_date,
       CASE WHEN s.base THEN '{fixed.COMPANY_URL}' || {CIK.format('company_id')}
            ELSE '{fixed.ARCHIVE_URL}' || (company_id + 1000) || '/' || replace(accession_number, '-', '') || '/'
            END AS source_url,
       false AS derived
FROM cells, UNNEST([{", ".join(_filed + _second)}]) AS u(s)
WHERE s.value IS NOT NULL"""
CTE["ranked"] = """
SELECT f.*, coalesce(t.priority, 99) AS priority FROM facts f LEFT JOIN tags t ON f.concept = t.tag"""
CTE["latest"] = """
SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (
  PARTITION BY company_id, canonical_concept, fiscal_year, fiscal_period
  ORDER BY priority, filed_date DESC, accession_number, concept) AS rn FROM ranked) WHERE rn = 1"""
CTE["annual"] = """
SELECT * EXCLUDE (place) FROM (SELECT *, row_number() OVER (
  PARTITION BY company_id, canonical_concept, fiscal_year ORDER BY fiscal_period) AS place
  FROM latest WHERE fiscal_period IN ('FY', 'Q4')) WHERE place = 1"""
CTE["q4"] = f"""
SELECT company_id, y.concept AS concept, canonical_concept, y.unit AS unit, y.value - (q1 + q2 + q3) AS value, fiscal_year,
       'Q4' AS fiscal_period, CAST(NULL AS DATE) AS start_date, y.end_date AS end_date, y.form AS form,
       y.accession_number AS accession_number, y.filed_date AS filed_date, y.source_url AS source_url, true AS derived
FROM (SELECT company_id, canonical_concept, fiscal_year,
             any_value({{'concept': concept, 'unit': unit, 'value': value, 'end_date': end_date, 'form': form,
                         'accession_number': accession_number, 'filed_date': filed_date, 'source_url': source_url}})
               FILTER (WHERE fiscal_period = 'FY') AS y,
             any_value(value) FILTER (WHERE fiscal_period = 'Q1') AS q1, any_value(value) FILTER (WHERE fiscal_period = 'Q2') AS q2,
             any_value(value) FILTER (WHERE fiscal_period = 'Q3') AS q3, bool_or(fiscal_period = 'Q4') AS has_q4
      FROM latest WHERE canonical_concept IN {listing(FLOWS)} GROUP BY company_id, canonical_concept, fiscal_year)
WHERE NOT has_q4 AND y IS NOT NULL AND q1 + q2 + q3 IS NOT NULL"""
CTE["complete"] = f"""
SELECT {", ".join(['company_id', 'concept', 'canonical_concept', 'unit', 'value', 'fiscal_year', 'fiscal_period',
                   'start_date', 'end_date', 'form', 'accession_number', 'filed_date', 'source_url', 'derived'])} FROM latest
UNION ALL SELECT * FROM q4"""
FACT_SELECT = ("company_id, concept, canonical_concept, unit, value, fiscal_year, fiscal_period, start_date, end_date, "
               "form, accession_number, filed_date, source_url, derived")

_wide = ", ".join(f"max(value) FILTER (WHERE canonical_concept = '{c}') AS {c}" for c in fixed.BASE_METRICS)
CTE["by_year"] = f"SELECT company_id, fiscal_year, {_wide} FROM annual GROUP BY company_id, fiscal_year"
CTE["metrics"] = f"""
SELECT n.company_id, n.fiscal_year, {", ".join("n." + c for c in fixed.BASE_METRICS)},
  CASE WHEN p.revenue <> 0 THEN n.revenue / p.revenue - 1 END AS revenue_growth,
  CASE WHEN p.net_income <> 0 THEN n.net_income / p.net_income - 1 END AS net_income_growth,
  CASE WHEN n.revenue <> 0 THEN n.gross_profit / n.revenue END AS gross_margin,
  CASE WHEN n.revenue <> 0 THEN n.operating_income / n.revenue END AS operating_margin,
  CASE WHEN n.revenue <> 0 THEN n.net_income / n.revenue END AS net_margin,
  n.operating_cash_flow - abs(n.capex) AS free_cash_flow,
  CASE WHEN n.revenue <> 0 THEN (n.operating_cash_flow - abs(n.capex)) / n.revenue END AS fcf_margin,
  CASE WHEN n.stockholders_equity <> 0 THEN n.net_income / n.stockholders_equity END AS roe
FROM by_year n LEFT JOIN by_year p ON p.company_id = n.company_id AND p.fiscal_year = n.fiscal_year - 1
WHERE n.fiscal_year = (SELECT max(x.fiscal_year) FROM by_year x WHERE x.company_id = n.company_id AND x.revenue IS NOT NULL)"""

# --- nested inputs ---
_raw = [f"{{'tag': {tag}, 'unit': '{domain.UNITS.get(c, 'USD')}', 'val': CASE WHEN {_reported(c)} THEN CAST({amount} AS DOUBLE) END, "
        f"'start': {'start_date' if c in FLOWS else 'CAST(NULL AS DATE)'}, 'dup': 0}}"
        for c, (tag, amount) in AMOUNTS.items()]
_rev = AMOUNTS["revenue"][1]


def _noise(when: str, tag: str, unit: str, val: str, start: str, dup: int = 0) -> str:
    return (f"{{'tag': {tag}, 'unit': '{unit}', 'val': CASE WHEN {when} THEN CAST({val} AS DOUBLE) END, "
            f"'start': {start}, 'dup': {dup}}}")


_none = "CAST(NULL AS DATE)"
_raw += [
    _noise("period IN ('Q2', 'Q3')", REVENUE_TAG, "USD", f"({_rev}) * 2",
           "CAST(make_date((fy * 12 + fye - 12) // 12, (fy * 12 + fye - 12) % 12 + 1, 1) + spill AS DATE)"),
    _noise("company_id % 21 = 5", REVENUE_TAG, "EUR", f"({_rev}) * 0.5", "start_date"),
    _noise("company_id % 15 = 6 AND period <> 'FY'", "'CashAndCashEquivalentsAtCarryingValue'", "USD", "g", _none, 1),
    _noise("company_id % 15 = 7 AND period <> 'FY'", "'CashAndCashEquivalentsAtCarryingValue'", "shares", "q", _none),
    _noise("true", "'IncomeTaxExpenseBenefit'", "USD", "t", "start_date"),
    _noise("company_id % 12 = 7 AND period = 'FY'", "'Assets'", "USD", "q", "start_date"),
]
CTE["entries"] = f"""
SELECT company_id, fy, fye, period AS cell_period, s.tag AS tag, s.unit AS unit, s.val AS value, s.start AS start_date, end_date,
       accession_number, form, filed_date, s.dup AS dup
FROM cells, UNNEST([{", ".join(_raw)}]) AS u(s)
WHERE company_id % 10 <> 0 AND s.val IS NOT NULL AND s.unit IN {listing(fixed.ALLOWED_UNITS)}"""
CTE["labelled"] = """
SELECT *, CASE WHEN start_date IS NULL THEN 'Q' || q
               WHEN date_diff('day', start_date, end_date) BETWEEN 340 AND 390 THEN CASE WHEN is_flow THEN 'FY' END
               WHEN date_diff('day', start_date, end_date) BETWEEN 75 AND 105 THEN 'Q' || q END AS fiscal_period
FROM (
  SELECT *, CASE WHEN (m - fye + 12) % 12 = 0 THEN 4 ELSE ((m - fye + 12) % 12 + 2) // 3 END AS q,
         CAST(CASE WHEN m <= fye THEN y ELSE y + 1 END AS INTEGER) AS fiscal_year
  FROM (
    SELECT e.*, t.canonical_concept, t.is_flow,
           CASE WHEN day(end_date) <= 6 THEN (CASE WHEN month(end_date) = 1 THEN 12 ELSE month(end_date) - 1 END)
                ELSE month(end_date) END AS m,
           CASE WHEN day(end_date) <= 6 AND month(end_date) = 1 THEN year(end_date) - 1 ELSE year(end_date) END AS y
    FROM entries e JOIN tags t ON e.tag = t.tag))"""
CTE["ingested"] = f"""
SELECT company_id, tag AS concept, canonical_concept, unit, value, fiscal_year, fiscal_period, start_date, end_date, form,
       accession_number, filed_date,
       '{fixed.ARCHIVE_URL}' || (company_id + 1000) || '/' || replace(accession_number, '-', '') || '/' AS source_url,
       false AS derived
FROM (SELECT *, row_number() OVER (PARTITION BY company_id, tag, fiscal_year, fiscal_period, accession_number
        ORDER BY unit, end_date, dup) AS rn
      FROM labelled WHERE fiscal_period IS NOT NULL) WHERE rn = 1"""

_cells = []
for _n, (_s, _col, _c, _flow) in enumerate(fixed.INGEST_FIELDS):
    _last = [c for s, c, _, _ in fixed.INGEST_FIELDS if s == _s][-1] == _col
    _v = f"{baseline_amount(_c)} * scale"
    _when = "true"
    if _last:
        _when = "company_id % 16 <> 5"
    if _c == "research_development":
        _when += " AND company_id % 14 <> 3"
    if _c == "gross_profit":
        _v = f"CASE WHEN company_id % 22 = 9 THEN CAST(1 AS DOUBLE) ELSE {_v} END"
    _cells.append(f"{{'statement': '{_s}', 'column': {text(_col)}, 'canonical_concept': '{_c}', "
                  f"'is_flow': {str(_flow).lower()}, 'value': CASE WHEN {_when} THEN {_v} END}}")
CTE["statement_rows"] = """
SELECT *, CASE copy WHEN 0 THEN CAST(1 AS DOUBLE) ELSE CASE WHEN company_id % 20 = 11 THEN CAST(2 AS DOUBLE) ELSE CAST(3 AS DOUBLE) END END AS scale,
       CASE WHEN company_id % 5 = 1 THEN NULL
            ELSE CAST(end_date + CASE WHEN company_id % 20 = 11 AND copy = 1 THEN 90 ELSE 60 END AS DATE) END AS publish_date,
       CASE period WHEN 'FY' THEN copy ELSE 2 END AS row_order
FROM (SELECT *, 0 AS copy FROM cells WHERE v = 1
      UNION ALL SELECT *, 1 FROM cells WHERE v = 1 AND period = 'FY' AND company_id % 20 IN (11, 12))
WHERE NOT (company_id % 18 = 7 AND period = 'Q1')"""
CTE["statement_cells"] = f"""
SELECT company_id, fy AS page, s.statement AS statement, s."column" AS "column", s.canonical_concept AS canonical_concept,
       s.is_flow AS is_flow, period, copy, end_date, publish_date, s.value AS value
FROM statement_rows, UNNEST([{", ".join(_cells)}]) AS u(s) WHERE s.value IS NOT NULL"""
CTE["reference"] = f"""
SELECT company_id, canonical_concept, year(end_date) AS end_year,
       arg_max(value, epoch(end_date) * 10 + copy) AS reference_value
FROM statement_cells
WHERE period = 'FY' AND value <> 0 AND canonical_concept IN {listing([c for _, _, c in fixed.RECONCILE_FIELDS])}
GROUP BY company_id, canonical_concept, year(end_date)"""
CTE["compared"] = """
SELECT *, CASE WHEN reference_value = 0 THEN (CASE WHEN our_value = 0 THEN 0 ELSE CAST('inf' AS DOUBLE) END)
               ELSE abs(abs(our_value) - abs(reference_value)) / abs(reference_value) END AS variance
FROM (SELECT company_id, canonical_concept, year(end_date) AS end_year, max(fiscal_year) AS fiscal_year,
             arg_max(value, fiscal_year) AS our_value FROM annual GROUP BY ALL) o
JOIN reference USING (company_id, canonical_concept, end_year)"""
CTE["flags"] = """
SELECT company_id, canonical_concept, fiscal_year, our_value, reference_value, variance FROM compared WHERE variance > 0.01"""

CTE["submission_rows"] = f"""
SELECT company_id, block, position, {CIK.format('company_id')} || '-' || strftime(day, '%y-%m') || (position % 3) AS accession_number,
       (['10-K', '10-Q', '8-K', '4', 'S-8'])[(block + position) % 5 + 1] AS form, day AS filed_date,
       CASE WHEN (block + position) % 6 = 0 THEN '' ELSE 'x' || block || '_' || position || '.htm' END AS document
FROM (SELECT *, CAST(CAST(o_orderdate AS DATE) - CAST(position * 20 AS INTEGER) AS DATE) AS day FROM (
  SELECT o_custkey // 15 AS company_id, o_orderkey AS block, o_orderdate,
         CAST(UNNEST(range(o_orderkey % 5 + 1)) AS INTEGER) AS position FROM orders))"""
CTE["listed"] = """
SELECT c_custkey AS place, 1000 + c_custkey // 2 AS cik_number, lpad(CAST(1000 + c_custkey // 2 AS VARCHAR), 10, '0') AS cik,
       'S' || (c_custkey // 3) || CASE WHEN c_custkey % 11 = 0 THEN '-W' ELSE '' END AS ticker,
       c_mktsegment || ', Inc.' AS title FROM customer"""
CTE["by_ticker"] = """
SELECT ticker, arg_max(cik, place) AS cik, arg_max(title, place) AS title FROM listed GROUP BY ticker"""
CTE["by_cik"] = """
SELECT cik_number, cik, arg_min(ticker, place) AS ticker, arg_min(title, place) AS title FROM listed GROUP BY ALL"""
CTE["universe"] = """
SELECT c_custkey AS position, 'S' || (c_custkey // 3) AS ticker,
       CASE WHEN c_custkey % 13 = 0 THEN 'The Group Inc' ELSE c_mktsegment || ' Corp' END AS name,
       (['Banks', 'Restaurants', 'Widgets', '', NULL])[c_nationkey % 5 + 1] AS sector_name, c_mktsegment AS segment,
       c_custkey % 13 = 0 AS generic FROM customer"""
CTE["matched"] = """
SELECT ticker, cik, name, CASE sector_name WHEN 'Banks' THEN 'Banking' WHEN 'Restaurants' THEN 'Hospitality'
                                           WHEN 'Widgets' THEN 'Widgets' END AS sector
FROM (SELECT u.*, b.cik, row_number() OVER (PARTITION BY b.cik ORDER BY position) AS rn
      FROM universe u JOIN by_ticker b USING (ticker)
      WHERE generic OR lower(segment) = lower(replace(b.title, ', Inc.', ''))) WHERE rn = 1"""
_forms = " ".join(f"WHEN '{p}' THEN '{f}'" for p, f in domain.FORM_OF_PRIORITY.items())
CTE["filings"] = f"""
SELECT o_custkey // 15 AS company_id, {CIK.format('o_custkey // 15')} || '-' || strftime(o_orderdate, '%y') || '-' || o_orderkey AS accession_number,
       CASE o_orderpriority {_forms} END AS form, CAST(o_orderdate AS DATE) AS filed_date,
       CASE WHEN o_orderkey % 10 = 0 THEN '' ELSE 'd' || o_orderkey || '.htm' END AS document, o_orderkey AS sequence
FROM orders"""
CTE["checks"] = """
SELECT s_suppkey AS company_id, CAST(DATE '2001-06-01' + CAST(s_suppkey % 30 AS INTEGER) AS DATE) AS checked FROM supplier"""
CTE["kpi_valid"] = f"""
SELECT company_id, 'kpi-' || company_id AS accession_number, turn AS chunk_no, name,
       CASE turn % 5 WHEN 0 THEN CAST(n AS DOUBLE) WHEN 1 THEN CAST(n AS DOUBLE) WHEN 3 THEN CAST(1 AS DOUBLE) END AS value,
       n || ' units' AS value_text, CASE WHEN turn % 3 = 0 THEN 'USD' ELSE '' END AS unit, period, quote
FROM (
  SELECT conv_id AS company_id, turn, length(text) AS n, ({array(domain.KPI_NAMES)})[(conv_id + turn) % 6 + 1] AS name,
         CASE WHEN turn % 2 = 0 THEN 'FY' ELSE 'fy' END || (2020 + turn // 4) AS period,
         regexp_replace(text, '^[\\s\\pZ]+|[\\s\\pZ]+$', '', 'g') AS quote
  FROM conversations)
WHERE trim(name) <> '' AND NOT (company_id % 9 = 0 AND turn = 1) AND quote <> ''"""
CTE["kpi_found"] = """
SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (
  PARTITION BY company_id, accession_number, lower(name), lower(period) ORDER BY chunk_no) AS rn FROM kpi_valid) WHERE rn = 1"""
CTE["kpi_facts"] = """
SELECT company_id, name, value, value_text, unit, period, quote AS source_quote, '10-K' AS form,
       accession_number, CAST(DATE '2024-01-01' + CAST(chunk_no AS INTEGER) AS DATE) AS filed_date,
       'https://filings.example/' || accession_number AS source_url
FROM kpi_found WHERE company_id % 3 <> 0"""
CTE["log"] = """
SELECT user_id AS key_id, (['free', 'pro', 'enterprise'])[user_id % 3 + 1] AS tier, event_id, ts FROM events"""
CTE["keys"] = "SELECT DISTINCT key_id, tier, key_id // 3 AS account_id FROM log"
CTE["sub_events"] = """
SELECT user_id // 3 AS account_id, event_id, ts, CASE event_type WHEN 'signup' THEN 'created' WHEN 'purchase' THEN 'updated' ELSE 'deleted' END AS kind,
       (['active', 'trialing', 'past_due', 'canceled'])[event_id % 4 + 1] AS status,
       (['pro', 'enterprise', 'free'])[event_id % 3 + 1] AS plan,
       CASE WHEN event_id % 5 <> 0 THEN 'cus_' || (user_id // 3) || '_' || (event_id % 7) END AS customer_id,
       CAST(CAST(ts AS DATE) + 30 AS DATE) AS period_end,
       row_number() OVER (PARTITION BY user_id // 3 ORDER BY ts, event_id) AS n
FROM events WHERE event_type IN ('signup', 'purchase', 'error')"""
CTE["subs"] = """
SELECT l.account_id, CASE WHEN l.kind <> 'deleted' AND l.status IN ('active', 'trialing') THEN l.plan ELSE 'free' END AS tier,
       CASE WHEN l.kind = 'deleted' THEN 'canceled' ELSE l.status END AS status,
       (SELECT arg_max(customer_id, n) FROM sub_events e WHERE e.account_id = l.account_id AND kind <> 'deleted' AND customer_id IS NOT NULL) AS customer_id,
       (SELECT arg_max(period_end, n) FROM sub_events e WHERE e.account_id = l.account_id AND kind <> 'deleted') AS period_end,
       CAST(l.ts AS DATE) AS updated
FROM sub_events l WHERE n = (SELECT max(n) FROM sub_events e WHERE e.account_id = l.account_id)"""
_concepts = [name.upper() if n % 2 else name for n, (name, _, _) in enumerate(fixed.CONCEPTS)] + ["unknown"]
CTE["cell_requests"] = f"""
SELECT o_orderkey AS request_id, 'S' || (o_custkey // 15) AS ticker, lower(({array(_concepts)})[o_orderkey % 18 + 1]) AS canonical_concept,
       CAST(1995 + o_orderkey % 8 AS INTEGER) AS fiscal_year,
       (['FY', 'FY', 'Q1', 'Q2', 'Q3', 'Q4', 'FY'])[o_orderkey % 7 + 1] AS period FROM orders"""
CTE["industries"] = """
SELECT p_name || ' ' || p_partkey AS industry, p_brand AS family, p_type AS sector, p_size % 3 + 1 AS phase,
       p_size % 5 + 1 AS complexity, 'S' || p_partkey AS anchor_ticker,
       list_concat(string_split(p_name, ' '), ['backlog']) AS key_kpis FROM part"""
_layout = ", ".join(f"({n}, {text(s)}, {text(l)}, '{c}', {str(c in FLOWS).lower()})"
                    for n, (s, l, c) in enumerate(fixed.STATEMENT_ROWS, 1))
CTE["layout"] = f"SELECT * FROM (VALUES {_layout}) AS t(row_no, statement, label, canonical_concept, is_flow)"
CTE["annual_columns"] = """
SELECT DISTINCT company_id, fiscal_year FROM facts"""
CTE["annual_cells"] = f"""
SELECT c.* FROM complete c JOIN annual_columns USING (company_id, fiscal_year)
WHERE fiscal_period = CASE WHEN canonical_concept IN {listing(FLOWS)} THEN 'FY' ELSE 'Q4' END"""
CTE["grid_cells"] = f"""
SELECT * FROM annual WHERE canonical_concept IN {listing(fixed.GRID_CONCEPTS)}"""
CTE["grid"] = "SELECT * FROM grid_cells"
_words = " ".join(f"WHEN '{lang}' THEN {array([w.lower() for w in words])}" for lang, words in domain.KEYWORDS.items())
CTE["chunks"] = f"""
SELECT doc_id, start // {fixed.CHUNK_STEP} AS chunk_no, start, substring(text, CAST(start + 1 AS INTEGER), {fixed.CHUNK_SIZE}) AS chunk, keywords
FROM (SELECT doc_id, text, CASE lang {_words} ELSE [] END AS keywords,
             UNNEST(range(0, length(text), {fixed.CHUNK_STEP})) AS start FROM documents)"""
CTE["scores"] = """
SELECT * FROM (SELECT *, CAST(list_sum(list_transform(keywords,
  lambda w: (length(lower(chunk)) - length(replace(lower(chunk), w, ''))) // length(w))) AS INTEGER) AS score FROM chunks)
WHERE score > 0"""


def _needs(sql: str) -> list[str]:
    """The names of this module's tables a statement mentions, in definition order."""
    import re

    words = set(re.findall(r"[a-z_0-9]+", re.sub(r"'(?:[^']|'')*'", "", sql)))
    return [name for name in CTE if name in words]


def query(sql: str) -> str:
    """A complete statement: ``sql`` with the definitions it needs in front."""
    wanted: set[str] = set()
    todo = _needs(sql)
    while todo:
        name = todo.pop()
        if name not in wanted:
            wanted.add(name)
            todo += [n for n in _needs(CTE[name]) if n != name]
    body = ",\n".join(f"{name} AS ({CTE[name]})" for name in CTE if name in wanted)
    recursive = "RECURSIVE " if "RECURSIVE" in sql else ""
    sql = sql.replace("RECURSIVE", "", 1)
    if sql.lstrip().upper().startswith("WITH"):
        tail = sql.lstrip()[4:]
        return f"WITH {recursive}{body},\n{tail}" if body else f"WITH {recursive}{tail}"
    return f"WITH {body}\n{sql}" if body else sql
