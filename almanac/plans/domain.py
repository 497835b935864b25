"""The domain tables, derived from the order and event tables of a data folder.

Companies are suppliers, their books are their line items: every (company, fiscal year) gets the
sums of its quarters, once over all lines (restated) and once without returned lines (as first
filed). All amounts are integers, so sums do not depend on the order of addition.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce, wraps
from hashlib import sha1

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from almanac import dims, fixed
from almanac.functions import links, names, periods
from almanac.operators import kpis, metrics, pointintime
from almanac.operators.coverage import with_sector
from almanac.session import shared_folder
from almanac.sources.store import FACT_COLUMNS, write_clustered

MEASURES = ["g", "d", "t", "q"]  # gross cents, discounts, taxes, quantity
#: Rows of the books (a company's year), of some hundred facts each, that a partition of facts stands for.
BOOKS_PER_PARTITION = 4000


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


_LANDED: dict[tuple[str, str, str], tuple[str, StructType]] = {}


def landed(build: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    """Writes a derived table to the shared folder once per application and data folder.

    Fact tables and payload files are stored inputs: ingest writes them, queries read them, with
    the columns and rows they need. Without a shared folder the table is derived in every query.
    """

    @wraps(build)
    def read(spark: SparkSession, folder: str) -> DataFrame:
        shared = shared_folder(spark)
        if shared is None:
            return build(spark, folder)
        app = spark.sparkContext.applicationId
        key = (app, folder, build.__name__)
        if key not in _LANDED:
            path = f"{shared}/almanac/landed/{app}/{sha1(folder.encode()).hexdigest()[:12]}/{build.__name__}"
            rows = build(spark, folder)
            rows.write.mode("overwrite").parquet(path)
            _LANDED[key] = (path, rows.schema)
        path, schema = _LANDED[key]
        return spark.read.schema(schema).parquet(path)

    return read


def clustered(build: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    """As ``landed``, for facts: a table in buckets of the company."""

    @wraps(build)
    def read(spark: SparkSession, folder: str) -> DataFrame:
        shared = shared_folder(spark)
        if shared is None:
            return build(spark, folder)
        app = spark.sparkContext.applicationId
        data = sha1(folder.encode()).hexdigest()[:12]
        name = f"almanac_{sha1(app.encode()).hexdigest()[:12]}_{data}_{build.__name__}"
        if not spark.catalog.tableExists(name):
            buckets = partitions(spark, folder)
            write_clustered(build(spark, folder), name, f"{shared}/almanac/landed/{app}/{data}/{build.__name__}", buckets)
        return spark.table(name)

    return read


def companies(spark: SparkSession, folder: str) -> DataFrame:
    """id, cik, ticker, name, sic, sector, fye_month."""
    i = F.col("s_suppkey")
    sic = (F.when(i % 31 == 0, None).when(i % 37 == 5, F.lit("n/a"))
            .otherwise((100 + (i * 97) % 9900).cast("string")))
    listed = table(spark, folder, "supplier").select(
        i.alias("id"), names.padded_cik(i + 1000).alias("cik"),
        F.concat(F.lit("S"), i.cast("string")).alias("ticker"), F.col("s_name").alias("name"),
        sic.alias("sic"), fye_month(i).alias("fye_month"))
    return with_sector(listed).select("id", "cik", "ticker", "name", "sic", "sector", "fye_month")


def fye_text(i: Column) -> Column:
    """Fiscal-year end as "MMDD"; some missing, some unreadable."""
    return (F.when(i % 29 == 0, F.lit("xx31")).when(i % 23 == 0, None)
             .otherwise(F.concat(F.lpad((1 + i % 12).cast("string"), 2, "0"), F.lit("31"))))


def fye_month(i: Column) -> Column:
    """The month ``fye_text`` stands for, as plain arithmetic for the scan of the line items."""
    return F.when((i % 29 == 0) | (i % 23 == 0), 12).otherwise(1 + i % 12).cast("int")


def hundredths(amount: str) -> Column:
    """A two-decimal amount as an integer."""
    return F.floor(F.col(amount) * 100 + 0.5)


def books(spark: SparkSession, folder: str) -> DataFrame:
    """One row per (company_id, fiscal_year) with the sums of each quarter and vintage.

    The line items are summed per quarter, partially before the shuffle. What is left is compact.
    """
    ship = F.col("l_shipdate")
    fye = fye_month(F.col("l_suppkey"))
    after = F.pmod(F.month(ship) - fye, F.lit(12))
    lines = table(spark, folder, "lineitem").select(
        F.col("l_suppkey").alias("company_id"),
        (F.year(ship) + (F.month(ship) > fye).cast("int")).cast("int").alias("fiscal_year"),
        F.when(after == 0, 4).otherwise(F.ceil(after / 3)).cast("int").alias("quarter"),
        (F.col("l_returnflag") != "R").alias("kept"),
        hundredths("l_extendedprice").alias("g"), hundredths("l_discount").alias("disc"),
        hundredths("l_tax").alias("tax"), F.col("l_quantity").cast("long").alias("q"))
    lines = lines.withColumns({"d": F.col("g") * F.col("disc"), "t": F.col("g") * F.col("tax")})
    quarters = lines.groupBy("company_id", "fiscal_year", "quarter", "kept").agg(
        *[F.sum(m).alias(m) for m in MEASURES])
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    sums = [F.sum(F.when((F.col("quarter") == k) & (F.col("kept") if v == 0 else F.lit(True)),
                         F.col(m))).alias(f"{m}{k}{v}")
            for v in (0, 1) for k in (1, 2, 3, 4) for m in MEASURES]
    return (quarters.repartition(partitions, "company_id", "fiscal_year")
            .groupBy("company_id", "fiscal_year").agg(*sums))


def _month_start(months: Column) -> Column:
    """First day of a month numbered year * 12 + month - 1."""
    return F.make_date(F.floor(months / 12).cast("int"), F.pmod(months, F.lit(12)) + 1, F.lit(1))


@landed
def stored_books(spark: SparkSession, folder: str) -> DataFrame:
    """The books, which every derived table starts from."""
    return books(spark, folder)


def partitions(spark: SparkSession, folder: str) -> int:
    """Partitions of what is made of the books: they grow with their rows, so that a task's share does not."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-stored_books(spark, folder).count() // BOOKS_PER_PARTITION))


def inlined(rows: DataFrame, made: list[Column], *kept: str) -> DataFrame:
    """The ``kept`` columns (by default all) beside the fields of each of the structs ``made`` of a row.

    The structs are columns before they are an array: Spark computes so many columns in many small methods,
    while an array of all of them is one, which is too large for the JVM to compile.
    """
    own = [f"_made{n}" for n in range(len(made))]
    wide = rows.select("*", *[column.alias(name) for column, name in zip(made, own)])
    return wide.select(*(kept or rows.columns), F.inline(F.array(*own)))


def cells(spark: SparkSession, folder: str) -> DataFrame:
    """One row per (company_id, fiscal_year, period, vintage) with sums, dates and filing.

    The books are laid out by company with a given partition count: each of their rows becomes hundreds
    of facts, so they must not be coalesced by their size before that. The partitioning then serves
    everything grouped by company and more, and the buckets that facts are stored in.
    """
    rows = stored_books(spark, folder).repartition(partitions(spark, folder), "company_id")
    wide = rows.withColumn("fye", fye_month(F.col("company_id")))
    close = F.col("fiscal_year") * 12 + F.col("fye") - 1
    spill = F.when(F.col("company_id") % 10 == 3, 3).otherwise(0)

    def cell(period: str, v: int) -> Column:
        k = 4 if period == "FY" else int(period[1])
        month = close - (4 - k) * 3
        present = F.col(f"q{k}{v}").isNotNull()
        if period == "FY":
            sums = [reduce(lambda a, b: a + b, [F.coalesce(F.col(f"{m}{x}{v}"), F.lit(0))
                                                for x in (1, 2, 3, 4)]) for m in MEASURES]
        else:
            sums = [F.col(f"{m}{k}{v}") for m in MEASURES]
        return F.when(present, F.struct(
            F.lit(period).alias("period"), F.lit(v).alias("v"),
            *[s.alias(m) for s, m in zip(sums, MEASURES)],
            month.alias("close_month"),
            F.date_add(_month_start(month - (11 if period == "FY" else 2)), spill).alias("start_date"),
            F.date_add(F.last_day(_month_start(month)), spill).alias("end_date")))

    every = [cell(p, v) for v in (0, 1) for p in ["FY", *fixed.QUARTERS]]
    rows = inlined(wide, every, "company_id", "fiscal_year").filter(F.col("period").isNotNull())
    filed = F.date_add("end_date", F.when(F.col("v") == 0, 40).otherwise(400))
    rows = rows.withColumn("filed_date", filed)
    accession = F.concat(names.padded_cik(F.col("company_id") + 1000), F.lit("-"),
                         F.lpad((F.year("filed_date") % 100).cast("string"), 2, "0"), F.lit("-"),
                         F.col("close_month").cast("string"), F.col("v").cast("string"))
    return rows.select("*", accession.alias("accession_number"),
                       F.when(F.col("period").isin("FY", "Q4"), "10-K").otherwise("10-Q").alias("form"))


def amounts() -> dict[str, tuple[Column, Column]]:
    """concept -> (raw tag, amount) of a cell; a null amount means not reported."""
    c = F.col
    i, fy, v = c("company_id"), c("fiscal_year"), c("v")
    g, d, t, q = c("g"), c("d"), c("t"), c("q")
    income = 40 * g - 2 * d - 2 * t - F.when((i % 9 == 0) & (fy % 3 == 0), 40).otherwise(10) * g
    shares = (1000 + i % 500) * 1000 * F.when(fy < 1999, 1).when(i % 6 == 1, 4).when(i % 6 == 2, 20).otherwise(1)
    revenue_tag = (F.when(fy <= 1996, "SalesRevenueNet")
                   .when((fy == 1997) | ((fy == 1998) & (v == 1)), "Revenues")
                   .when((fy >= 2000) & (i % 6 == 1), "RevenueFromContractWithCustomerIncludingAssessedTax")
                   .otherwise("RevenueFromContractWithCustomerExcludingAssessedTax"))
    rows = {
        "revenue": (revenue_tag, F.when(i % 13 == 4, None).when((i % 17 == 2) & (fy % 5 == 0), 0)
                    .otherwise(100 * g - d)),
        "cost_of_revenue": (F.when(i % 2 == 0, "CostOfRevenue").when(v == 0, "CostOfGoodsSold")
                            .otherwise("CostOfGoodsAndServicesSold"), 60 * g),
        "gross_profit": (F.lit("GrossProfit"), 40 * g - d),
        "research_development": (F.lit("ResearchAndDevelopmentExpense"), F.when(i % 7 != 0, d)),
        "sga_expense": (F.when(i % 3 == 0, "GeneralAndAdministrativeExpense")
                        .otherwise("SellingGeneralAndAdministrativeExpense"), 2 * t),
        "operating_income": (F.lit("OperatingIncomeLoss"), 40 * g - 2 * d - 2 * t),
        "net_income": (F.when((v == 0) & (i % 8 == 0), "ProfitLoss").otherwise("NetIncomeLoss"), income),
        "eps_diluted": (F.lit("EarningsPerShareDiluted"),
                        income.cast("double") / 10000.0 / shares.cast("double")),
        "shares_diluted": (F.lit("WeightedAverageNumberOfDilutedSharesOutstanding"), shares),
        "operating_cash_flow": (
            F.when(i % 5 == 2, "NetCashProvidedByUsedInOperatingActivitiesContinuingOperations")
            .otherwise("NetCashProvidedByUsedInOperatingActivities"), 40 * g - d - t),
        "capex": (F.lit("PaymentsToAcquirePropertyPlantAndEquipment"),
                  F.when(i % 4 == 1, -1000 * q).otherwise(1000 * q)),
        "stock_based_compensation": (F.lit("ShareBasedCompensation"), F.when(fy % 2 == 0, t)),
        "cash_and_equivalents": (F.lit("CashAndCashEquivalentsAtCarryingValue"), 20 * g + t),
        "total_assets": (F.lit("Assets"), 300 * g + q),
        "total_liabilities": (F.lit("Liabilities"), 180 * g + 3 * d),
        "stockholders_equity": (
            F.when(i % 6 == 0, "StockholdersEquityIncludingPortionAttributableToNoncontrollingInterest")
            .otherwise("StockholdersEquity"), F.when(i % 11 == 0, 0).otherwise(120 * g + q - 3 * d)),
        "long_term_debt": (F.when((v == 1) & (i % 4 == 2), "LongTermDebt").otherwise("LongTermDebtNoncurrent"),
                           50 * g),
    }
    return {name: (tag.cast("string"), amount.cast("double")) for name, (tag, amount) in rows.items()}


UNITS = {"eps_diluted": "USD/shares", "shares_diluted": "shares"}
FLOWS = {name for name, flow, _ in fixed.CONCEPTS if flow}


def _reported(concept: str) -> Column:
    """Which periods a concept is reported for: Q4 flows mostly only inside the fiscal year."""
    if concept in FLOWS:
        return (F.col("period") != "Q4") | (F.col("company_id") % 5 == 0)
    return F.col("period") != "FY"


def baseline_factor() -> Column:
    """Deviation of the second source in thousandths."""
    kind = (F.col("company_id") + F.col("fiscal_year")) % 7
    return F.when(kind == 0, 1030.0).when(kind == 1, 1005.0).otherwise(1000.0)


def baseline_amount(concept: str, amount: Column) -> Column:
    sign = -1.0 if concept == "capex" else 1.0
    return amount * baseline_factor() / F.lit(1000.0 * sign)


@clustered
def facts(spark: SparkSession, folder: str) -> DataFrame:
    """The stored fact table: filed facts, and second-source facts of some companies."""
    money = amounts()
    i = F.col("company_id")
    filed = [F.when((i % 10 != 0) & _reported(c), F.struct(
        F.lit(c).alias("canonical_concept"), tag.alias("concept"), F.lit(UNITS.get(c, "USD")).alias("unit"),
        amount.alias("value"), F.lit(False).alias("baseline"))) for c, (tag, amount) in money.items()]
    second = [F.when((F.col("v") == 1) & ((i % 10 == 0) | (i % 3 == 0))
                     & (F.col("period") == ("FY" if flow else "Q4")), F.struct(
        F.lit(c).alias("canonical_concept"), F.lit(fixed.BASELINE_TAG_PREFIX + column).alias("concept"),
        F.lit(UNITS.get(c, "USD")).alias("unit"), baseline_amount(c, money[c][1]).alias("value"),
        F.lit(True).alias("baseline"))) for _, column, c, flow in fixed.INGEST_FIELDS]
    cik = names.padded_cik(i + 1000)
    linked = cells(spark, folder).withColumns({
        "company_url": F.concat(F.lit(fixed.COMPANY_URL), cik), "index_url": links.index_url(cik, F.col("accession_number"))})
    rows = inlined(linked, [*filed, *second]).filter(F.col("value").isNotNull())
    base = F.col("baseline")
    flow = F.col("canonical_concept").isin(sorted(FLOWS))
    return rows.select(
        "company_id", "concept", "canonical_concept", "unit", "value", "fiscal_year",
        F.col("period").alias("fiscal_period"),
        F.when(~base & flow, F.col("start_date")).alias("start_date"), "end_date",
        F.when(base, fixed.BASELINE_FORM).otherwise(F.col("form")).alias("form"),
        F.when(base, fixed.BASELINE_ACCESSION).otherwise(F.col("accession_number")).alias("accession_number"),
        F.when(base, F.when(i % 5 == 1, F.col("end_date")).otherwise(F.date_add("end_date", 60)))
         .otherwise(F.col("filed_date")).alias("filed_date"),
        F.when(base, F.col("company_url")).otherwise(F.col("index_url")).alias("source_url"),
        F.lit(False).alias("derived")).select(*FACT_COLUMNS)


@clustered
def complete_facts(spark: SparkSession, folder: str) -> DataFrame:
    """The fact table after ingest, with the derived fourth quarters."""
    return pointintime.with_derived_q4(facts(spark, folder))


@landed
def metrics_table(spark: SparkSession, folder: str) -> DataFrame:
    """The stored metrics that screens read."""
    return metrics.stored_metrics(facts(spark, folder))


# --- Nested inputs ------------------------------------------------------------------------


@landed
def fact_payloads(spark: SparkSession, folder: str) -> DataFrame:
    """Company-fact documents, one (company_id, page, payload) per company and fiscal year.

    Beside the facts they hold what an ingest has to leave out: year-to-date spans, missing values,
    foreign units, unmapped tags, repeated entries, and balances over a span. A page holds at most
    a few hundred entries, whatever the size of the company.
    """
    c = F.col
    i, none = c("company_id"), F.lit(None).cast("date")

    def entry(when: Column, tag: Column | str, unit: str, val: Column, start: Column, dup: int = 0) -> Column:
        tag = F.lit(tag) if isinstance(tag, str) else tag
        return F.when(when, F.struct(tag.alias("tag"), F.lit(unit).alias("unit"), val.cast("double").alias("val"),
                                     start.alias("start"), F.lit(dup).alias("dup")))

    money = amounts()
    start = c("start_date")
    entries = [entry(_reported(name) & amount.isNotNull(), tag, UNITS.get(name, "USD"), amount,
                     start if name in FLOWS else none) for name, (tag, amount) in money.items()]
    quarter = F.substring("period", 2, 1).try_cast("int")
    year_start = F.date_add(_month_start(c("close_month") + (4 - quarter) * 3 - 11),
                            F.when(i % 10 == 3, 3).otherwise(0))
    revenue_tag, revenue = money["revenue"]
    entries += [
        entry(c("period").isin("Q2", "Q3") & revenue.isNotNull(), revenue_tag, "USD", revenue * 2, year_start),
        entry((i % 19 == 3) & (c("period") != "FY"), "ResearchAndDevelopmentExpense", "USD", F.lit(None), start, 1),
        entry((i % 21 == 5) & revenue.isNotNull(), revenue_tag, "EUR", revenue * 0.5, start),
        entry((i % 15 == 6) & (c("period") != "FY"), "CashAndCashEquivalentsAtCarryingValue", "USD", c("g"), none, 1),
        entry((i % 15 == 7) & (c("period") != "FY"), "CashAndCashEquivalentsAtCarryingValue", "shares", c("q"), none),
        entry(F.lit(True), "IncomeTaxExpenseBenefit", "USD", c("t"), start),
        entry((i % 12 == 7) & (c("period") == "FY"), "Assets", "USD", c("q"), start),
    ]
    rows = inlined(cells(spark, folder).filter(i % 10 != 0), entries).filter(c("tag").isNotNull())
    keys = ["company_id", "fiscal_year"]
    listed = F.sort_array(F.collect_list(F.struct(
        "accession_number", "end_date", "dup", "start", "val", "form", "filed_date")))
    body = F.transform(listed, lambda e: F.struct(
        e["val"].alias("val"), e["start"].cast("string").alias("start"),
        e["end_date"].cast("string").alias("end"), e["accession_number"].alias("accn"),
        e["form"].alias("form"), e["filed_date"].cast("string").alias("filed")))
    units = rows.groupBy(*keys, "tag", "unit").agg(body.alias("entries"))
    by_unit = F.map_from_entries(F.sort_array(F.collect_list(F.struct("unit", "entries"))))
    tags = units.groupBy(*keys, "tag").agg(F.struct(by_unit.alias("units")).alias("body"))
    by_tag = F.map_from_entries(F.collect_list(F.struct("tag", "body")))
    pages = tags.groupBy(*keys).agg(by_tag.alias("us-gaap"))
    return pages.select("company_id", F.col("fiscal_year").alias("page"),
                        F.to_json(F.struct(F.struct("us-gaap").alias("facts"))).alias("payload"))


STATEMENTS = ["PL", "CF", "BS", "DERIVED"]


def damaged_payloads(spark: SparkSession, folder: str) -> DataFrame:
    """One payload for each company, four in nine of them damaged in one way or another."""
    key = F.col("s_suppkey")
    entry = lambda day: F.concat(F.lit('{"facts":{"us-gaap":{"Revenues":{"units":{"USD":[{"val":1.5,"accn":"a","form":"10-K","filed":"2024-02-01","end":"'), day, F.lit('"}]}}}}}'))
    sound = entry(F.lit("2023-12-31"))
    payload = (F.when(key % 9 == 1, F.expr("substring('[{\"facts\": 1', 1, 8)")).when(key % 9 == 2, '{"facts":{"dei":{}}}')
               .when(key % 9 == 3, entry(F.lit("2023-02-30"))).when(key % 9 != 0, sound))
    return table(spark, folder, "supplier").select(key.alias("company_id"), F.lit(0).alias("page"), payload.alias("payload"))


@landed
def statement_payloads(spark: SparkSession, folder: str) -> DataFrame:
    """Second-source statements, one (company_id, page, payload) per company and fiscal year.

    Rows are FY, possibly FY once more, then the quarters. Some cells are text, boolean or
    missing, some rows are short, some dates unreadable or blank.
    """
    c = F.col
    i, money = c("company_id"), amounts()

    def quoted(text: Column) -> Column:
        return F.concat(F.lit('"'), text, F.lit('"'))

    def number(value: Column) -> Column:
        return F.coalesce(value.cast("string"), F.lit("null"))

    report = F.when((i % 18 == 7) & (c("period") == "Q1"), "bad").otherwise(c("end_date").cast("string"))
    days = F.when((i % 20 == 11) & (c("copy") == 1), 90).otherwise(60)
    publish = F.when(i % 5 == 1, "").otherwise(F.date_add("end_date", days).cast("string"))
    head = [quoted(c("period")), c("fiscal_year").cast("string"), quoted(report), quoted(publish)]
    scale = F.when(c("copy") == 0, 1.0).when(i % 20 == 11, 2.0).otherwise(3.0)

    def line(statement: str) -> Column:
        columns = [(column, concept) for s, column, concept, _ in fixed.INGEST_FIELDS if s == statement]
        values = []
        for column, concept in columns:
            text = number(baseline_amount(concept, money[concept][1]) * scale)
            if concept == "research_development":
                text = F.when(i % 14 == 3, F.lit('"N/A"')).otherwise(text)
            if concept == "gross_profit":
                text = F.when(i % 22 == 9, F.lit("true")).otherwise(text)
            values.append(text)
        full = F.array(*head, *values)
        kept = F.when(i % 16 == 5, F.slice(full, 1, len(head) + len(values) - 1)).otherwise(full)
        return F.concat(F.lit("["), F.array_join(kept, ","), F.lit("]"))

    rows = (cells(spark, folder).filter(c("v") == 1)
            .select("*", F.explode(F.when((c("period") == "FY") & (i % 20).isin(11, 12), F.array(F.lit(0), F.lit(1)))
                                   .otherwise(F.array(F.lit(0)))).alias("copy")))
    order = F.struct(F.when(c("period") == "FY", "F").otherwise(c("period")).alias("p"), "copy")
    lines = rows.groupBy("company_id", F.col("fiscal_year").alias("page")).agg(
        *[F.sort_array(F.collect_list(F.struct(order.alias("o"), line(s).alias("line")))).alias(s)
          for s in STATEMENTS])
    blocks = []
    for s in STATEMENTS:
        columns = ["Fiscal Period", "Fiscal Year", "Report Date", "Publish Date"] \
            + [column for x, column, _, _ in fixed.INGEST_FIELDS if x == s]
        names_json = "[" + ",".join(f'"{column}"' for column in columns) + "]"
        blocks.append(F.concat(F.lit(f'{{"statement":"{s}","columns":{names_json},"data":['),
                               F.array_join(c(s)["line"], ","), F.lit("]}")))
    return lines.select("company_id", "page", F.concat(
        F.lit("["), F.concat_ws(",", *blocks), F.lit("]")).alias("payload"))


@landed
def submissions(spark: SparkSession, folder: str) -> DataFrame:
    """Filing lists as parallel arrays, newest first, one (company_id, block, payload) per order.

    Every order is a page of one to five filings; the same accession returns on other pages. A third
    of the pages are older ones, which are the arrays themselves.
    """
    key, company = F.col("o_orderkey"), F.floor(F.col("o_custkey") / 15)
    forms = F.array(*[F.lit(f) for f in ["10-K", "10-Q", "8-K", "4", "S-8"]])
    places = F.sequence(F.lit(0), (key % 5).cast("int"))

    def day(n: Column) -> Column:
        return F.date_sub(F.to_date("o_orderdate"), n * 20)

    def accession(n: Column) -> Column:
        return F.concat(names.padded_cik(company + 1000), F.lit("-"), F.date_format(day(n), "yy-MM"),
                        (n % 3).cast("string"))

    def document(n: Column) -> Column:
        name = F.concat(F.lit("x"), key.cast("string"), F.lit("_"), n.cast("string"), F.lit(".htm"))
        return F.when((key + n) % 6 == 0, "").otherwise(name)

    recent = F.struct(
        F.transform(places, lambda n: F.get(forms, ((key + n) % 5).cast("int"))).alias("form"),
        F.transform(places, accession).alias("accessionNumber"),
        F.transform(places, lambda n: day(n).cast("string")).alias("filingDate"),
        F.transform(places, document).alias("primaryDocument"))
    return table(spark, folder, "orders").select(
        company.alias("company_id"), key.alias("block"),
        F.when(key % 3 == 0, F.to_json(recent))
         .otherwise(F.to_json(F.struct(F.struct(recent.alias("recent")).alias("filings")))).alias("payload"))


@landed
def listing_payloads(spark: SparkSession, folder: str) -> DataFrame:
    """The listed-companies map in shards (shard, payload) of 50 customers."""
    k = F.col("c_custkey")
    suffix = F.when(k % 11 == 0, "-w").otherwise("")
    entry = F.struct((k.cast("int") % 50).alias("n"), F.struct(
        (1000 + F.floor(k / 2)).alias("cik_str"),
        F.concat(F.lit("s"), F.floor(k / 3).cast("string"), suffix).alias("ticker"),
        F.concat("c_mktsegment", F.lit(", Inc.")).alias("title")).alias("row"))
    shards = table(spark, folder, "customer").groupBy(F.floor(k / 50).alias("shard")).agg(
        F.sort_array(F.collect_list(entry)).alias("rows"))
    listed = F.map_from_entries(F.transform("rows", lambda r: F.struct(r["n"].cast("string"), r["row"])))
    return shards.select("shard", F.to_json(listed).alias("payload"))


# --- Flat inputs --------------------------------------------------------------------------


def universe(spark: SparkSession, folder: str) -> DataFrame:
    """The second source's company list: position, ticker, name, sector_name."""
    k, n = F.col("c_custkey"), F.col("c_nationkey") % 5
    return table(spark, folder, "customer").select(
        k.alias("position"), F.concat(F.lit("s"), F.floor(k / 3).cast("string")).alias("ticker"),
        F.when(k % 13 == 0, "The Group Inc").otherwise(F.concat("c_mktsegment", F.lit(" Corp"))).alias("name"),
        F.when(n == 0, "Banks").when(n == 1, "Restaurants").when(n == 2, "Widgets").when(n == 3, "")
        .alias("sector_name"))


FORM_OF_PRIORITY = {"1-URGENT": "10-K", "2-HIGH": "10-Q", "3-MEDIUM": "8-K", "4-NOT SPECIFIED": "4", "5-LOW": "S-8"}


def filings_from_orders(orders: DataFrame) -> DataFrame:
    """Filings of (batch or streamed) orders: fifteen customers make a company."""
    key, company = F.col("o_orderkey"), F.floor(F.col("o_custkey") / 15)
    form = F.lit(None).cast("string")
    for priority, name in FORM_OF_PRIORITY.items():
        form = F.when(F.col("o_orderpriority") == priority, name).otherwise(form)
    filed = F.to_date("o_orderdate")
    return orders.select(
        company.alias("company_id"),
        F.concat(names.padded_cik(company + 1000), F.lit("-"), F.date_format(filed, "yy"), F.lit("-"),
                 key.cast("string")).alias("accession_number"),
        form.alias("form"), filed.alias("filed_date"),
        F.when(key % 10 == 0, "").otherwise(F.concat(F.lit("d"), key.cast("string"), F.lit(".htm"))).alias("document"),
        key.alias("sequence"))


def filings(spark: SparkSession, folder: str) -> DataFrame:
    return filings_from_orders(table(spark, folder, "orders"))


def newest_first() -> list[Column]:
    return [F.desc("filed_date"), F.desc("sequence")]


def seen(spark: SparkSession, folder: str) -> DataFrame:
    return filings(spark, folder).filter(F.col("sequence") % 4 != 0)


def fact_documents(spark: SparkSession, folder: str) -> DataFrame:
    """Known documents of the filings behind the facts."""
    c = F.col
    return (cells(spark, folder).filter((c("period") != "FY") & (c("close_month") % 4 != 0))
            .select("company_id", "accession_number",
                    F.concat(F.lit("f"), c("close_month").cast("string"), F.lit(".htm")).alias("document")))


def checks(spark: SparkSession, folder: str) -> DataFrame:
    """Last reconciliation per company."""
    i = F.col("s_suppkey")
    return table(spark, folder, "supplier").select(
        i.alias("company_id"), F.date_add(F.lit("2001-06-01").cast("date"), (i % 30).cast("int")).alias("checked"))


KPI_NAMES = ["Employee headcount", "RevPAR", "Backlog", "ARR", "employee headcount", "  "]


def kpi_records(spark: SparkSession, folder: str) -> DataFrame:
    """Extracted KPI records as JSON, one per conversation turn (a company's filing and chunk)."""
    c = F.col
    n = F.length("text")
    name = F.get(F.array(*[F.lit(x) for x in KPI_NAMES]), ((c("conv_id") + c("turn")) % 6).cast("int"))
    kind = c("turn") % 5
    grouped = F.concat(F.floor(n / 1000).cast("string"), F.lit(","), F.lpad((n % 1000).cast("string"), 3, "0"))
    value = (F.when(kind == 0, F.concat(F.lit('"'), grouped, F.lit('"'))).when(kind == 1, n.cast("string"))
             .when(kind == 2, '"n/a"').when(kind == 3, "true").otherwise("null"))
    text = F.when((c("conv_id") % 9 == 0) & (c("turn") == 1), " ").otherwise(
        F.concat(F.lit(" "), n.cast("string"), F.lit(" units ")))
    period = F.concat(F.when(c("turn") % 2 == 0, "FY").otherwise("fy"),
                      (2020 + F.floor(c("turn") / 4)).cast("string"))
    fields = F.struct(name.alias("name"), text.alias("value_text"),
                      F.when(c("turn") % 3 == 0, "USD").alias("unit"), period.alias("period"),
                      c("text").alias("quote"))
    record = F.concat(F.lit('{"value":'), value, F.lit(","), F.substring(F.to_json(fields), 2, 2_000_000_000))
    return table(spark, folder, "conversations").select(
        c("conv_id").alias("company_id"), F.concat(F.lit("kpi-"), c("conv_id").cast("string")).alias("accession_number"),
        c("turn").alias("chunk_no"), record.alias("record"))


def kpi_facts(spark: SparkSession, folder: str) -> DataFrame:
    """The stored KPI table: the records of two companies out of three."""
    stored = kpis.first_found(kpis.validate(kpi_records(spark, folder).filter(F.col("company_id") % 3 != 0)),
                              ["chunk_no"])
    return stored.select(
        "company_id", "name", "value", "value_text", "unit", "period", F.col("quote").alias("source_quote"),
        F.lit("10-K").alias("form"), "accession_number",
        F.date_add(F.lit("2024-01-01").cast("date"), F.col("chunk_no").cast("int")).alias("filed_date"),
        F.concat(F.lit("https://filings.example/"), "accession_number").alias("source_url"))


TIERS = ["free", "pro", "enterprise"]


def requests_from_events(events: DataFrame) -> DataFrame:
    """The request log of (batch or streamed) events; the user is the key."""
    tier = F.get(F.array(*[F.lit(t) for t in TIERS]), (F.col("user_id") % 3).cast("int"))
    return events.select(F.col("user_id").alias("key_id"), tier.alias("tier"), "event_id", "ts")


def request_log(spark: SparkSession, folder: str) -> DataFrame:
    return requests_from_events(table(spark, folder, "events"))


#: The request log's first day in microseconds, and how many times faster the busy log runs.
BUSY_START, BUSY_FACTOR = 1_704_067_200_000_000, 40_000


def busy_log(spark: SparkSession, folder: str) -> DataFrame:
    """The request log at many times its speed, a tenth of it by one key: the limits of the tiers bite."""
    us = F.unix_micros(F.col("ts").cast("timestamp")) - BUSY_START
    return request_log(spark, folder).select(
        F.when(F.col("event_id") % 10 == 0, F.lit(0)).otherwise(F.col("key_id")).alias("key_id"), "tier", "event_id",
        F.timestamp_micros(BUSY_START + F.floor(us / BUSY_FACTOR)).cast("timestamp_ntz").alias("ts"))


def keys(spark: SparkSession, folder: str) -> DataFrame:
    """API keys: three to an account."""
    return request_log(spark, folder).select("key_id", "tier").distinct() \
        .withColumn("account_id", F.floor(F.col("key_id") / 3))


def subscriptions_from_events(events: DataFrame) -> DataFrame:
    """Lifecycle events of accounts, from (batch or streamed) events."""
    c = F.col
    kind = F.when(c("event_type") == "signup", "created").when(c("event_type") == "purchase", "updated") \
            .when(c("event_type") == "error", "deleted").otherwise("other")
    account = F.floor(c("user_id") / 3)
    status = F.get(F.array(*[F.lit(x) for x in ["active", "trialing", "past_due", "canceled"]]),
                   (c("event_id") % 4).cast("int"))
    return events.select(
        account.alias("account_id"), "event_id", "ts", kind.alias("kind"), status.alias("status"),
        F.get(F.array(*[F.lit(x) for x in ["price_pro", "price_enterprise", "price_old"]]),
              (c("event_id") % 3).cast("int")).alias("price_id"),
        F.when(c("event_id") % 5 != 0, F.concat(F.lit("cus_"), account.cast("string"), F.lit("_"),
                                                (c("event_id") % 7).cast("string"))).alias("customer_id"),
        F.date_add(F.to_date("ts"), 30).alias("period_end"))


def subscription_events(spark: SparkSession, folder: str) -> DataFrame:
    return subscriptions_from_events(table(spark, folder, "events"))


def prices(spark: SparkSession) -> DataFrame:
    return dims.values_table(spark, ["price_id", "tier"], [("price_pro", "pro"), ("price_enterprise", "enterprise")])


def cell_requests(spark: SparkSession, folder: str) -> DataFrame:
    """Spreadsheet cell requests, one per order."""
    k = F.col("o_orderkey")
    concepts = [name.upper() if n % 2 else name for n, (name, _, _) in enumerate(fixed.CONCEPTS)] + ["unknown"]
    asked = [None, "fy", "q1", "Q2", "q3", "q4", ""]
    return table(spark, folder, "orders").select(
        k.alias("request_id"), F.concat(F.lit("s"), F.floor(F.col("o_custkey") / 15).cast("string")).alias("ticker"),
        F.get(F.array(*[F.lit(x) for x in concepts]), (k % 18).cast("int")).alias("concept"),
        (1995.4 + k % 8).alias("year"),
        F.get(F.array(*[F.lit(x) for x in asked]), (k % 7).cast("int")).alias("period"))


def export_requests(spark: SparkSession, folder: str) -> DataFrame:
    k, size = F.col("p_partkey"), F.col("p_size").cast("string")
    many = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(59)), lambda n: F.concat(
        F.lit("s"), (n * 3).cast("string"))), ",")
    few = F.concat(F.lit(" s"), (k % 110).cast("string"), F.lit(",, s"), size, F.lit(" ,zz"), size)
    return table(spark, folder, "part").select(
        k.alias("request_id"), F.when(k % 10 == 0, many).otherwise(few).alias("tickers"))


def screen_specs(spark: SparkSession, folder: str) -> DataFrame:
    """Screen specifications as JSON, many of them malformed."""
    k, size = F.col("p_partkey"), F.col("p_size")
    sector = F.when(size % 3 == 0, '"Retail"').when(size % 3 == 1, '"Nowhere"').otherwise("null")
    number = size.cast("string")
    filters = (F.when(k % 6 == 0, F.concat(F.lit('[{"metric":"revenue_growth","op":">","value":'), number, F.lit("}]")))
               .when(k % 6 == 1, '[{"metric":"unknown","op":">","value":1}]')
               .when(k % 6 == 2, F.concat(F.lit('[{"metric":"net_margin","op":"!=","value":1},'
                                                '{"metric":"roe","op":"<=","value":'), number, F.lit(".5}]")))
               .when(k % 6 == 3, '[{"metric":"roe","op":">","value":"high"}]')
               .when(k % 6 == 4, '"nope"')
               .otherwise('[5,{"metric":"revenue","op":">=","value":true}]'))
    sort_by = F.when(k % 4 == 0, ',"sort_by":"revenue"').when(k % 4 == 1, ',"sort_by":"bogus"') \
               .when(k % 4 == 2, "").otherwise(',"sort_by":null')
    descending = F.when(k % 5 == 0, ',"descending":true').when(k % 5 == 1, ',"descending":false') \
                  .when(k % 5 == 2, "").when(k % 5 == 3, ',"descending":0').otherwise(',"descending":"x"')
    spec = F.concat(F.lit('{"sector":'), sector, F.lit(',"filters":'), filters, sort_by, descending, F.lit("}"))
    return table(spark, folder, "part").select(
        k.alias("spec_id"), F.when(k % 17 == 0, "just a string").when(k % 19 == 0, "[1,2]").otherwise(spec).alias("spec"))


TEMPLATE_CONCEPTS = ["revenue", "operating_cash_flow", "capex", "total_assets", "net_income"]


def template_rows(spark: SparkSession, folder: str) -> DataFrame:
    """Templates, one for each part: a formula above its two concepts with a spacer between them. One in
    eleven has a row whose formula names a concept that need not be one of its rows."""
    k, names = F.col("p_partkey"), F.array(*[F.lit(c) for c in TEMPLATE_CONCEPTS])
    one, two, other = (F.get(names, (n % 5).cast("int")) for n in (k, k + F.col("p_size"), k + 1))
    none = F.lit(None).cast("string")
    op = F.when(k % 2 == 0, " + ").otherwise("-")

    def row(n: int, kind: str, label: Column, concept: Column = none, expression: Column = none) -> Column:
        return F.struct(F.lit(n).alias("row_no"), F.lit(kind).alias("type"), label.alias("label"), concept.alias("concept"), expression.alias("expression"))

    rows = F.array(row(1, "formula", F.lit("Change"), expression=F.concat(one, op, two)), row(2, "concept", F.lit("One"), one),
                   row(3, "spacer", none), row(4, "concept", F.lit("Two"), two))
    broken = F.array(row(5, "formula", F.lit("Zero"), expression=F.concat(other, F.lit(" - "), other)))
    listed = table(spark, folder, "part").select(k.alias("template_id"), F.inline(F.when(k % 11 == 0, F.concat(rows, broken)).otherwise(rows)))
    return listed


def template_requests(spark: SparkSession, folder: str) -> DataFrame:
    """Every company asks for two templates."""
    asked = F.explode(F.array(F.col("id"), F.col("id") + 50)).alias("template_id")
    return companies(spark, folder).select(F.col("id").alias("company_id"), asked)


def industries(spark: SparkSession, folder: str) -> DataFrame:
    k = F.col("p_partkey")
    return table(spark, folder, "part").select(
        F.concat("p_name", F.lit(" "), k.cast("string")).alias("industry"), F.col("p_brand").alias("family"),
        F.col("p_type").alias("sector"), (F.col("p_size") % 3 + 1).alias("phase"),
        (F.col("p_size") % 5 + 1).alias("complexity"), F.concat(F.lit("s"), k.cast("string")).alias("anchor_ticker"),
        F.lit("DCF, EV/EBITDA, ").alias("valuation"),
        F.concat(F.replace("p_name", F.lit(" "), F.lit(" ; ")), F.lit(";; backlog")).alias("kpis"))


KEYWORDS = {"en": ["the", "tion", "ING"], "de": ["sch", "ich"], "es": ["ción", "que"], "fr": ["eaux", "TION", "é"]}


def documents(spark: SparkSession, folder: str) -> DataFrame:
    """Filing texts with the keywords to look for."""
    words = F.array().cast("array<string>")
    for lang, listed in KEYWORDS.items():
        words = F.when(F.col("lang") == lang, F.array(*[F.lit(w) for w in listed])).otherwise(words)
    return table(spark, folder, "documents").select("doc_id", "text", words.alias("keywords"))
