"""Word lists, ranges, field maps, layouts and limits that results depend on."""

from __future__ import annotations

# --- Canonical concepts -------------------------------------------------------------------
# (concept, is_flow, raw tags from most to least preferred)
CONCEPTS: list[tuple[str, bool, list[str]]] = [
    ("revenue", True, [
        "RevenueFromContractWithCustomerExcludingAssessedTax",
        "RevenueFromContractWithCustomerIncludingAssessedTax",
        "Revenues",
        "SalesRevenueNet",
    ]),
    ("cost_of_revenue", True, [
        "CostOfRevenue", "CostOfGoodsAndServicesSold", "CostOfGoodsSold",
    ]),
    ("gross_profit", True, ["GrossProfit"]),
    ("research_development", True, ["ResearchAndDevelopmentExpense"]),
    ("sga_expense", True, [
        "SellingGeneralAndAdministrativeExpense", "GeneralAndAdministrativeExpense",
    ]),
    ("operating_income", True, ["OperatingIncomeLoss"]),
    ("net_income", True, ["NetIncomeLoss", "ProfitLoss"]),
    ("eps_diluted", True, ["EarningsPerShareDiluted"]),
    ("shares_diluted", True, ["WeightedAverageNumberOfDilutedSharesOutstanding"]),
    ("operating_cash_flow", True, [
        "NetCashProvidedByUsedInOperatingActivities",
        "NetCashProvidedByUsedInOperatingActivitiesContinuingOperations",
    ]),
    ("capex", True, ["PaymentsToAcquirePropertyPlantAndEquipment"]),
    ("stock_based_compensation", True, ["ShareBasedCompensation"]),
    ("cash_and_equivalents", False, ["CashAndCashEquivalentsAtCarryingValue"]),
    ("total_assets", False, ["Assets"]),
    ("total_liabilities", False, ["Liabilities"]),
    ("stockholders_equity", False, [
        "StockholdersEquity",
        "StockholdersEquityIncludingPortionAttributableToNoncontrollingInterest",
    ]),
    ("long_term_debt", False, ["LongTermDebtNoncurrent", "LongTermDebt"]),
]
UNKNOWN_TAG_PRIORITY = 99
ALLOWED_UNITS = ["USD", "shares", "USD/shares"]

# --- Period rules -------------------------------------------------------------------------
QUARTER_DAYS = (75, 105)
YEAR_DAYS = (340, 390)
SPILLOVER_DAYS = 6
QUARTERS = ["Q1", "Q2", "Q3", "Q4"]

# --- SIC ranges: (from, to, sector) -------------------------------------------------------
SIC_RANGES: list[tuple[int, int, str]] = [
    (100, 999, "Agriculture"),
    (1000, 1499, "Mining"),
    (1300, 1399, "Oil & Gas"),
    (1500, 1799, "Construction"),
    (2000, 2199, "Food & Beverage"),
    (2800, 2899, "Chemicals"),
    (2833, 2836, "Pharmaceuticals & Biotech"),
    (3570, 3579, "Computer Hardware"),
    (3600, 3699, "Electronics & Semiconductors"),
    (3674, 3674, "Semiconductors"),
    (3711, 3716, "Automotive"),
    (2000, 3999, "Manufacturing"),
    (4000, 4799, "Transportation"),
    (4800, 4899, "Telecommunications"),
    (4900, 4999, "Utilities"),
    (5000, 5199, "Wholesale"),
    (5200, 5999, "Retail"),
    (6000, 6099, "Banking"),
    (6100, 6199, "Credit & Lending"),
    (6200, 6299, "Capital Markets"),
    (6300, 6499, "Insurance"),
    (6500, 6599, "Real Estate"),
    (6798, 6798, "REITs"),
    (7000, 7099, "Hospitality"),
    (7370, 7372, "Software & SaaS"),
    (7373, 7379, "IT Services"),
    (7800, 7999, "Media & Entertainment"),
    (8000, 8099, "Healthcare Services"),
]
OTHER_SECTOR = "Other"

# --- Second source ------------------------------------------------------------------------
BASELINE_ACCESSION = "simfin-baseline"
BASELINE_FORM = "SimFin"
BASELINE_TAG_PREFIX = "SimFin:"
# sector names of the second source -> our sector names
SECTOR_NAMES: dict[str, str] = {
    "Banks": "Banking",
    "Biotechnology": "Pharmaceuticals & Biotech",
    "Drug Manufacturers": "Pharmaceuticals & Biotech",
    "Application Software": "Software & SaaS",
    "Online Media": "Media & Entertainment",
    "Entertainment": "Media & Entertainment",
    "Computer Hardware": "Computer Hardware",
    "Semiconductors": "Semiconductors",
    "Communication Equipment": "Electronics & Semiconductors",
    "Asset Management": "Capital Markets",
    "Brokers, Exchanges & Other": "Capital Markets",
    "Metals & Mining": "Mining",
    "Oil & Gas - E&P": "Oil & Gas",
    "Consumer Packaged Goods": "Food & Beverage",
    "Restaurants": "Hospitality",
    "Travel & Leisure": "Hospitality",
    "Medical Devices": "Healthcare Services",
    "Medical Diagnostics & Research": "Healthcare Services",
    "Engineering & Construction": "Construction",
    "Chemicals": "Chemicals",
    "REITs": "REITs",
}
# (statement, column, concept, is_flow) for ingesting the second source as facts
INGEST_FIELDS: list[tuple[str, str, str, bool]] = [
    ("PL", "Revenue", "revenue", True),
    ("PL", "Cost of revenue", "cost_of_revenue", True),
    ("PL", "Gross Profit", "gross_profit", True),
    ("PL", "Selling, General & Administrative", "sga_expense", True),
    ("PL", "Research & Development", "research_development", True),
    ("PL", "Operating Income (Loss)", "operating_income", True),
    ("PL", "Net Income", "net_income", True),
    ("CF", "Cash from Operating Activities", "operating_cash_flow", True),
    ("CF", "Change in Fixed Assets & Intangibles", "capex", True),
    ("CF", "Stock-Based Compensation", "stock_based_compensation", True),
    ("BS", "Cash & Cash Equivalents", "cash_and_equivalents", False),
    ("BS", "Total Assets", "total_assets", False),
    ("BS", "Total Liabilities", "total_liabilities", False),
    ("BS", "Total Equity", "stockholders_equity", False),
    ("BS", "Long Term Debt", "long_term_debt", False),
    ("DERIVED", "Earnings Per Share, Diluted", "eps_diluted", True),
]
# (statement, column, concept) for reconciling against the second source
RECONCILE_FIELDS: list[tuple[str, str, str]] = [
    ("PL", "Revenue", "revenue"),
    ("PL", "Cost of revenue", "cost_of_revenue"),
    ("PL", "Gross Profit", "gross_profit"),
    ("PL", "Research & Development", "research_development"),
    ("PL", "Operating Income (Loss)", "operating_income"),
    ("PL", "Net Income", "net_income"),
    ("BS", "Total Assets", "total_assets"),
    ("BS", "Total Liabilities", "total_liabilities"),
    ("BS", "Total Equity", "stockholders_equity"),
    ("BS", "Long Term Debt", "long_term_debt"),
    ("CF", "Cash from Operating Activities", "operating_cash_flow"),
    ("CF", "Change in Fixed Assets & Intangibles", "capex"),
]
VARIANCE_THRESHOLD = 0.01
RECHECK_DAYS = 14
GENERIC_NAME_TOKENS = [
    "inc", "corp", "corporation", "incorporated", "company", "co", "ltd",
    "limited", "plc", "group", "holdings", "holding", "the", "trust", "lp",
    "sa", "nv", "ag", "se", "llc", "and", "of",
]

# --- Filings ------------------------------------------------------------------------------
WATCHED_FORMS = ["10-K", "10-Q", "8-K"]
FINANCIAL_FORMS = ["10-K", "10-Q"]
VIEWER_URL = "https://www.sec.gov/ix?doc=/Archives/edgar/data/"
ARCHIVE_URL = "https://www.sec.gov/Archives/edgar/data/"
# Where the company number stands in those addresses.
NUMBER_IN_PATH = r"/data/(\d+)/"
NUMBER_IN_QUERY = r"CIK=0*(\d+)"
# Share classes that the second source lists under another ticker than ours.
SECOND_SOURCE_TICKERS = {"GOOGL": "GOOG"}
COMPANY_URL = "https://www.sec.gov/cgi-bin/browse-edgar?action=getcompany&CIK="

# --- Screening metrics --------------------------------------------------------------------
BASE_METRICS = [
    "revenue", "cost_of_revenue", "gross_profit", "research_development",
    "operating_income", "net_income", "eps_diluted", "operating_cash_flow",
    "capex", "stock_based_compensation", "cash_and_equivalents",
    "total_assets", "total_liabilities", "stockholders_equity", "long_term_debt",
]
DERIVED_METRICS = [
    "revenue_growth", "net_income_growth", "gross_margin", "operating_margin",
    "net_margin", "free_cash_flow", "fcf_margin", "roe",
]
METRICS = BASE_METRICS + DERIVED_METRICS
PERCENT_METRICS = ["revenue_growth", "net_income_growth", "gross_margin", "operating_margin", "net_margin", "fcf_margin", "roe"]
PER_SHARE_METRICS = ["eps_diluted"]
SCREEN_OPERATORS = [">", ">=", "<", "<="]
ALWAYS_SHOWN = ["revenue", "revenue_growth", "net_margin"]

# --- Statement layout: (statement, label, concept) ------------------------------------------
STATEMENT_ROWS: list[tuple[str, str, str]] = [
    ("Income Statement", "Revenue", "revenue"),
    ("Income Statement", "Cost of Revenue", "cost_of_revenue"),
    ("Income Statement", "Gross Profit", "gross_profit"),
    ("Income Statement", "Research & Development", "research_development"),
    ("Income Statement", "SG&A Expense", "sga_expense"),
    ("Income Statement", "Operating Income", "operating_income"),
    ("Income Statement", "Net Income", "net_income"),
    ("Income Statement", "Diluted EPS", "eps_diluted"),
    ("Income Statement", "Diluted Shares", "shares_diluted"),
    ("Balance Sheet", "Cash & Equivalents", "cash_and_equivalents"),
    ("Balance Sheet", "Total Assets", "total_assets"),
    ("Balance Sheet", "Total Liabilities", "total_liabilities"),
    ("Balance Sheet", "Stockholders' Equity", "stockholders_equity"),
    ("Balance Sheet", "Long-Term Debt", "long_term_debt"),
    ("Cash Flow", "Operating Cash Flow", "operating_cash_flow"),
    ("Cash Flow", "Capital Expenditures", "capex"),
    ("Cash Flow", "Stock-Based Compensation", "stock_based_compensation"),
]
# (label, numerator, denominator)
MARGIN_ROWS: list[tuple[str, str, str]] = [
    ("Gross Margin %", "gross_profit", "revenue"),
    ("Operating Margin %", "operating_income", "revenue"),
    ("Net Margin %", "net_income", "revenue"),
]
# concepts shown in the compact annual grid
GRID_CONCEPTS = [
    "revenue", "cost_of_revenue", "gross_profit", "research_development", "sga_expense",
    "operating_income", "net_income", "eps_diluted", "operating_cash_flow", "capex",
    "stock_based_compensation", "cash_and_equivalents", "total_assets", "total_liabilities",
    "stockholders_equity", "long_term_debt",
]
SPLIT_FACTORS = [2, 3, 4, 5, 6, 7, 8, 10, 12, 14, 15, 20, 21, 25, 28, 30, 40, 50]
SPLIT_MIN_RATIO = 1.5
SEARCH_PAGE = 60

# --- KPI targets: label -> keywords ---------------------------------------------------------
GENERIC_KPIS: dict[str, list[str]] = {
    "Employee headcount": ["employees", "headcount"],
    "Backlog / remaining performance obligations": ["backlog", "remaining performance obligation"],
    "Share repurchases": ["repurchase", "buyback"],
}
SECTOR_KPIS: dict[str, dict[str, list[str]]] = {
    "Software & SaaS": {
        "Annual Recurring Revenue (ARR)": ["annual recurring revenue", "ARR"],
        "Net revenue retention": ["net revenue retention", "net retention", "dollar-based net"],
        "Customer count": ["customers", "paid subscribers"],
        "Billings": ["billings"],
    },
    "Hospitality": {
        "RevPAR (revenue per available room)": ["RevPAR", "revenue per available room"],
        "ADR (average daily rate)": ["average daily rate", "ADR"],
        "Occupancy rate": ["occupancy"],
        "Room count": ["rooms", "properties"],
    },
    "Semiconductors": {
        "Wafer capacity": ["wafer", "capacity"],
        "Fab utilization": ["utilization", "fab"],
        "Design wins": ["design win"],
    },
    "Automotive": {
        "Vehicle deliveries": ["deliveries", "delivered", "vehicles"],
        "Vehicle production": ["production", "produced", "manufactured"],
        "Energy storage deployed": ["energy storage", "deployed", "GWh", "MWh"],
        "Regulatory credits revenue": ["regulatory credits"],
        "Charging / service locations": ["Supercharger", "charging stations", "service centers"],
    },
    "Retail": {
        "Same-store / comparable sales growth": ["comparable sales", "same-store", "comp sales"],
        "Store count": ["stores", "locations"],
        "E-commerce revenue": ["e-commerce", "online sales", "digital sales"],
    },
    "Banking": {
        "Net interest margin": ["net interest margin"],
        "Efficiency ratio": ["efficiency ratio"],
        "Non-performing loans": ["non-performing", "nonperforming"],
        "Tier 1 capital ratio": ["tier 1", "CET1"],
    },
    "Oil & Gas": {
        "Production volume (BOE/d)": ["barrels of oil equivalent", "boe", "production"],
        "Proved reserves": ["proved reserves"],
        "Realized price per barrel": ["realized price"],
    },
    "Media & Entertainment": {
        "Subscriber count": ["subscribers", "memberships"],
        "ARPU (average revenue per user)": ["ARPU", "average revenue per"],
        "Monthly/daily active users": ["monthly active", "daily active", "MAU", "DAU"],
    },
    "Computer Hardware": {
        "Units shipped": ["units", "shipments"],
        "Installed base": ["installed base", "active devices"],
        "Services revenue": ["services revenue"],
    },
}
CHUNK_SIZE = 15_000
CHUNK_STEP = 14_500
MAX_CHUNKS = 6

# --- Request limits -----------------------------------------------------------------------
TIER_LIMITS = {"free": 60, "pro": 600, "enterprise": 6000}
LIMIT_WINDOW_SECONDS = 60
PAID_STATUSES = ["active", "trialing"]
