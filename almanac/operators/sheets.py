"""Statement sheets of all companies as long grids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from almanac import dims, fixed
from almanac.functions.numbers import ratio, split_factor
from almanac.operators import pointintime


def last_years(years: DataFrame, n: int) -> DataFrame:
    """The last ``n`` distinct years of every company of a (company_id, fiscal_year) frame."""
    distinct = years.select("company_id", "fiscal_year").distinct()
    rank = F.row_number().over(Window.partitionBy("company_id").orderBy(F.desc("fiscal_year")))
    return distinct.withColumn("_rank", rank).filter(F.col("_rank") <= n).drop("_rank")


def sheet_columns(facts: DataFrame, period: str = "annual", year_from: int | None = None,
                  year_to: int | None = None, quarters: list[str] | None = None,
                  max_years: int | None = None) -> DataFrame:
    """The period columns (company_id, fiscal_year, fiscal_period) of the sheets.

    The year bounds apply first, the last ``max_years`` (all without it) are taken from what is left.
    A quarterly sheet shows the quarters with a fact of any concept.
    """
    periods = facts.select("company_id", "fiscal_year", "fiscal_period")
    if year_from is not None:
        periods = periods.filter(F.col("fiscal_year") >= year_from)
    if year_to is not None:
        periods = periods.filter(F.col("fiscal_year") <= year_to)
    years = (periods.select("company_id", "fiscal_year").distinct() if max_years is None
             else last_years(periods, max_years))
    if period == "annual":
        return years.withColumn("fiscal_period", F.lit("FY"))
    wanted = quarters or fixed.QUARTERS
    shown = periods.filter(F.col("fiscal_period").isin(wanted)).distinct()
    return shown.join(years, ["company_id", "fiscal_year"], "left_semi")


def _cells(facts: DataFrame, period: str, rows: DataFrame, columns: DataFrame) -> DataFrame:
    """Current facts at the layout's rows and the sheet's columns.

    In an annual column flows show the fiscal year and balances the year end (Q4); there is no
    fallback from one to the other. The filter comes before the selection it does not change.
    """
    placed = facts.join(F.broadcast(rows), "canonical_concept")
    if period == "annual":
        placed = placed.filter(F.col("fiscal_period") == F.when(F.col("is_flow"), "FY").otherwise("Q4"))
    else:
        placed = placed.filter(F.col("fiscal_period").isin(fixed.QUARTERS))
    current = pointintime.latest(placed)
    if period == "annual":
        current = current.withColumn("fiscal_period", F.lit("FY"))
    return current.join(columns, ["company_id", "fiscal_year", "fiscal_period"], "left_semi")


def picked_rows(facts: DataFrame, picked: list[str] | None) -> DataFrame:
    rows = dims.statement_rows(facts.sparkSession)
    return rows if picked is None else rows.filter(F.col("canonical_concept").isin(picked))


def statement_grid(facts: DataFrame, period: str = "annual", picked: list[str] | None = None,
                   **column_options) -> DataFrame:
    """Filled cells of the three statements, with their link and derived mark."""
    columns = sheet_columns(facts, period, **column_options)
    return _cells(facts, period, picked_rows(facts, picked), columns).select(
        "company_id", "statement", "row_no", "label", "canonical_concept", "fiscal_year",
        "fiscal_period", "value", "derived", "source_url")


def _wide(facts: DataFrame, period: str, needed: list[str], **column_options) -> DataFrame:
    """One row per sheet column with the needed concepts side by side."""
    columns = sheet_columns(facts, period, **column_options)
    rows = dims.statement_rows(facts.sparkSession).filter(F.col("canonical_concept").isin(needed))
    cells = _cells(facts, period, rows, columns)
    keys = ["company_id", "fiscal_year", "fiscal_period"]
    filled = cells.groupBy(*keys).agg(*[
        F.max(F.when(F.col("canonical_concept") == c, F.col("value"))).alias(c) for c in needed])
    return columns.join(filled, keys, "left")


def statement_margins(facts: DataFrame, period: str = "annual", picked: list[str] | None = None,
                      **column_options) -> DataFrame:
    """Margin rows under the income statement.

    A blank numerator counts as 0; a blank or zero denominator leaves the cell blank. A margin
    needs both of its inputs on the sheet.
    """
    rows = [r for r in fixed.MARGIN_ROWS if picked is None or (r[1] in picked and r[2] in picked)]
    needed = sorted({c for _, a, b in rows for c in (a, b)})
    if not rows:
        return sheet_columns(facts, period, **column_options).limit(0) \
            .select("*", F.lit("").alias("label"), F.lit(0.0).alias("value"))
    wide = _wide(facts, period, needed, **column_options)
    lines = F.array(*[
        F.struct(F.lit(label).alias("label"),
                 ratio(F.coalesce(num, F.lit(0.0)), F.coalesce(den, F.lit(0.0))).alias("value"))
        for label, num, den in [(label, F.col(a), F.col(b)) for label, a, b in rows]])
    return wide.select("company_id", "fiscal_year", "fiscal_period", F.inline(lines))


def statement_free_cash_flow(facts: DataFrame, period: str = "annual",
                             picked: list[str] | None = None, **column_options) -> DataFrame:
    """Operating cash flow minus capex as signed in the facts; blanks count as 0."""
    needed = ["operating_cash_flow", "capex"]
    wide = _wide(facts, period, needed, **column_options)
    if picked is not None and not set(needed) <= set(picked):
        wide = wide.limit(0)
    zero = F.lit(0.0)
    return wide.select("company_id", "fiscal_year", "fiscal_period",
                       F.lit("Free Cash Flow").alias("label"),
                       (F.coalesce("operating_cash_flow", zero) - F.coalesce("capex", zero)).alias("value"))


def kpi_tab(kpis: DataFrame) -> DataFrame:
    """KPI rows, each company's together and by name and period: the number where there is one, else the text."""
    shown = F.coalesce(F.col("value").cast("string"), F.col("value_text"))
    return kpis.repartition("company_id").sortWithinPartitions("company_id", "name", "period").select(
        "company_id", "name", "period", shown.alias("shown_value"), "unit", "source_quote")


def annual_or_q4(facts: DataFrame) -> DataFrame:
    """The shown annual cell per (company, concept, year): FY, else Q4."""
    shown = facts.filter(F.col("canonical_concept").isin(fixed.GRID_CONCEPTS))
    return pointintime.annual_values(shown)


def annual_grid(facts: DataFrame, max_years: int | None = None) -> DataFrame:
    """Compact annual grid: the last ``max_years`` with a shown value (all without it), empty concepts left out.

    Annual cells are few per company, so their years are ranked where they are.
    """
    cells = annual_or_q4(facts).select("company_id", "canonical_concept", "fiscal_year", "value")
    if max_years is None:
        return cells
    year_rank = F.dense_rank().over(Window.partitionBy("company_id").orderBy(F.desc("fiscal_year")))
    return cells.withColumn("_rank", year_rank).filter(F.col("_rank") <= max_years).drop("_rank")


def eps_split_adjust(facts: DataFrame, max_years: int | None = None) -> DataFrame:
    """Earnings per share of the compact grid on the share basis of the latest year.

    The reference is the last shown year with both earnings per share and net income.
    """
    wide = (annual_grid(facts, max_years)
            .groupBy("company_id", "fiscal_year")
            .agg(F.max(F.when(F.col("canonical_concept") == "eps_diluted", F.col("value"))).alias("eps"),
                 F.max(F.when(F.col("canonical_concept") == "net_income", F.col("value"))).alias("income")))
    newest_first = Window.partitionBy("company_id").orderBy(F.desc("fiscal_year")) \
        .rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    both = F.when(F.col("eps").isNotNull() & F.col("income").isNotNull(), F.struct("eps", "income"))
    reference = F.first(both, ignorenulls=True).over(newest_first)
    factor = split_factor(F.col("eps"), F.col("income"), F.col("ref.eps"), F.col("ref.income"))
    return (wide.withColumn("ref", reference)
            .filter(F.col("eps").isNotNull())
            .withColumn("factor", factor.cast("int"))
            .select("company_id", "fiscal_year", "eps", "factor",
                    (F.col("eps") / F.col("factor")).alias("eps_adjusted")))


def value_lookup(requests: DataFrame, companies: DataFrame, facts: DataFrame) -> DataFrame:
    """Answers a table of (request_id, ticker, concept, year, period) cell requests.

    The period defaults to FY, which falls back to Q4. Unknown cells stay null. The facts are cut
    down to the asked companies, concepts and years before they are laid out by period.
    """
    asked = requests.select(
        "request_id", F.upper("ticker").alias("ticker"), F.lower("concept").alias("canonical_concept"),
        F.round("year").cast("int").alias("fiscal_year"),
        F.upper(F.coalesce(F.nullif("period", F.lit("")), F.lit("FY"))).alias("period"))
    asked = asked.join(companies.select(F.col("id").alias("company_id"), "ticker"), "ticker", "left")
    facts = facts.join(asked.select(*pointintime.YEAR_KEY).distinct(), pointintime.YEAR_KEY, "left_semi")
    by_period = pointintime.best_by_period(facts, {p: ["value"] for p in ["FY", *fixed.QUARTERS]})
    found = asked.join(by_period, pointintime.YEAR_KEY, "left")
    value = F.when(F.col("period") == "FY", F.coalesce("FY.value", "Q4.value"))
    for quarter in fixed.QUARTERS:
        value = value.when(F.col("period") == quarter, F.col(f"{quarter}.value"))
    return found.select("request_id", "ticker", "canonical_concept", "fiscal_year", "period",
                        value.alias("value"))


def export_manifest(requests: DataFrame, companies: DataFrame) -> DataFrame:
    """Per export request (request_id, tickers): which tickers are included and which skipped.

    Requested tickers are trimmed and upper-cased, blank ones left out.
    """
    wanted = F.filter(F.transform(F.split("tickers", ","), lambda t: F.upper(F.trim(t))), lambda t: t != "")
    rows = (requests
            .select("request_id", F.posexplode(wanted).alias("position", "ticker"))
            .join(companies.select("ticker", F.lit(True).alias("known")), "ticker", "left"))
    return rows.select("request_id", "position", "ticker",
                       F.when(F.col("known"), "included").otherwise("skipped").alias("status"))


def manifest_counts(manifest: DataFrame) -> DataFrame:
    """How many tickers of each request are included and skipped."""
    def counted(status: str) -> Column:
        return F.count_if(F.col("status") == status).alias(status)

    return manifest.groupBy("request_id").agg(counted("included"), counted("skipped"))


def write_sheets(grid: DataFrame, path: str) -> None:
    """Exports sheets clustered by company: each file holds a range of companies, row by row."""
    (grid.repartitionByRange("company_id").sortWithinPartitions("company_id", "row_no", "fiscal_year")
         .write.mode("overwrite").parquet(path))


