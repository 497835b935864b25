"""Industry tables: multi-valued columns, lookups as joins, family roll-ups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def split_values(column: str, separator: str) -> Column:
    """Trimmed non-blank parts of a multi-valued text."""
    parts = F.transform(F.split(column, separator), lambda part: F.trim(part))
    return F.filter(parts, lambda part: part != "")


def parse_industries(raw: DataFrame) -> DataFrame:
    """Industry rows with valuation methods (comma) and KPIs (semicolon) as arrays."""
    return raw.withColumn("valuation_methods", split_values("valuation", ",")) \
              .withColumn("key_kpis", split_values("kpis", ";")).drop("valuation", "kpis")


def select_industries(industries: DataFrame, phase: int | None = None,
                      sector: str | None = None) -> DataFrame:
    if phase is not None:
        industries = industries.filter(F.col("phase") == phase)
    if sector is not None:
        industries = industries.filter(F.col("sector") == sector)
    return industries


def family_members(industries: DataFrame) -> DataFrame:
    """Template families with their member industries, one row per member."""
    return industries.select("family", "industry", "sector", "phase", "complexity")


def family_rollup(industries: DataFrame) -> DataFrame:
    """Counts per family and KPI: members, how many of them are in phase 1, highest complexity.

    Members stay rows; a family may be large, so it is counted and never gathered into a list.
    """
    kpis = industries.select("family", "phase", "complexity", F.explode("key_kpis").alias("kpi"))
    return kpis.groupBy("family", "kpi").agg(
        F.count("*").alias("members"), F.count_if(F.col("phase") == 1).alias("first_phase"),
        F.max("complexity").alias("max_complexity"))


def industry_of_ticker(tickers: DataFrame, industries: DataFrame) -> DataFrame:
    """The industry whose anchor company has the ticker, compared in upper case."""
    anchors = industries.select(F.upper("anchor_ticker").alias("ticker"), "industry", "family", "sector")
    return tickers.withColumn("ticker", F.upper("ticker")).join(anchors, "ticker", "left")
