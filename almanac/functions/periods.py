"""Fiscal calendar labels as Column expressions: everything stays in generated JVM code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from almanac import fixed


def is_quarterly(start: Column, end: Column) -> Column:
    """True for a span of about one quarter; false without a start date."""
    lo, hi = fixed.QUARTER_DAYS
    return F.coalesce(F.datediff(end, start).between(lo, hi), F.lit(False))


def is_annual(start: Column, end: Column) -> Column:
    """True for a span of about one year; false without a start date."""
    lo, hi = fixed.YEAR_DAYS
    return F.coalesce(F.datediff(end, start).between(lo, hi), F.lit(False))


def fiscal_year_end_month(mmdd: Column) -> Column:
    """Month of an "MMDD" text; December when it is missing or no month."""
    text = F.substring(mmdd.cast("string"), 1, 2)
    month = F.when(text.rlike("^[0-9]+$"), text.try_cast("int"))
    return F.when(month.between(1, 12), month).otherwise(12)


def _closing_month(end: Column) -> Column:
    """First day of the month a period end belongs to.

    52/53-week calendars run a few days into the next month, so the first days of a month
    count to the month before.
    """
    return F.when(F.dayofmonth(end) <= fixed.SPILLOVER_DAYS, F.add_months(F.trunc(end, "MM"), -1)) \
            .otherwise(F.trunc(end, "MM"))


def fiscal_quarter(end: Column, fye_month: Column) -> Column:
    """Quarter 1-4 of a period end, given the month the fiscal year ends in."""
    after = F.pmod(F.month(_closing_month(end)) - fye_month, F.lit(12))
    return F.when(after == 0, 4).otherwise(F.ceil(after / 3)).cast("int")


def fiscal_year(end: Column, fye_month: Column) -> Column:
    """Fiscal year of a period end: the calendar year the fiscal year ends in."""
    closing = _closing_month(end)
    return (F.year(closing) + (F.month(closing) > fye_month).cast("int")).cast("int")


def period_label(start: Column, end: Column, is_flow: Column, fye_month: Column) -> Column:
    """"Q1".."Q4" or "FY"; null for spans that are neither a quarter nor a year.

    Instants belong to a quarter end. An annual span is a fiscal year only for flows.
    """
    quarter = F.concat(F.lit("Q"), fiscal_quarter(end, fye_month).cast("string"))
    return (F.when(end.isNull(), None)
             .when(start.isNull(), quarter)
             .when(is_annual(start, end), F.when(is_flow, F.lit("FY")))
             .when(is_quarterly(start, end), quarter))


def baseline_fiscal_year(end: Column, period: Column) -> Column:
    """Fiscal year of a second-source row, projected from its quarter to the year end.

    Q1 ends nine months before the fiscal year does; a full year and Q4 end with it.
    """
    quarter = F.when(period == "FY", 4).otherwise(F.substring(period, 2, 1).try_cast("int"))
    return F.year(F.add_months(_closing_month(end), (4 - quarter) * 3)).cast("int")
