"""Compact statements (columns located by name, rows of mixed cells) to facts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from almanac import dims, fixed
from almanac.functions import names, numbers, periods
from almanac.sources.store import first_by

PAYLOAD = "array<struct<statement: string, columns: array<string>, data: array<array<variant>>>>"


def statement_cells(payloads: DataFrame, fields: DataFrame) -> DataFrame:
    """One row per mapped numeric cell of (company_id, page, payload).

    ``fields`` maps (statement, column) to a concept. Cells that are missing, short of the row or
    not numeric are skipped; so are rows whose report date cannot be read.
    """
    rows = (payloads
            .select("company_id", "page", F.posexplode(F.from_json("payload", PAYLOAD)).alias("block", "s"))
            .select("company_id", "page", "block", "s.statement", "s.columns",
                    F.posexplode("s.data").alias("row_no", "cells")))

    def text(column: str) -> Column:
        place = F.array_position("columns", column)
        cell = F.when(place > 0, F.try_element_at("cells", place.cast("int")))
        return F.try_variant_get(cell, "$", "string")

    cells = (rows
             .withColumn("end_date", F.try_to_date(text("Report Date"), "yyyy-MM-dd"))
             .withColumn("report_year", F.substring(text("Report Date"), 1, 4).try_cast("int"))
             .withColumn("publish_date", F.try_to_date(text("Publish Date"), "yyyy-MM-dd"))
             .withColumn("period", text("Fiscal Period"))
             .select("company_id", "page", "block", "row_no", "statement", "end_date", "report_year",
                     "publish_date", "period",
                     F.inline(F.filter(
                         F.arrays_zip(F.col("columns").alias("column"), F.col("cells").alias("cell")),
                         lambda pair: pair["cell"].isNotNull()))))
    return (cells.join(F.broadcast(fields), ["statement", "column"])
                 .withColumn("value", numbers.variant_number(F.col("cell")))
                 .filter(F.col("value").isNotNull())
                 .drop("cell"))


def statement_unpivot(payloads: DataFrame) -> DataFrame:
    """Long cells of all columns the fact ingest knows."""
    return statement_cells(payloads, dims.ingest_fields(payloads.sparkSession)) \
        .filter(F.col("end_date").isNotNull())


def company_payloads(payloads: DataFrame, companies: DataFrame) -> DataFrame:
    """The second source's statements (ticker, page, payload) of our companies (id, ticker), which it may list
    under another share class: (company_id, page, payload)."""
    listed = companies.select(F.col("id").alias("company_id"), names.second_source_ticker(F.col("ticker")).alias("ticker"))
    return payloads.select(F.upper("ticker").alias("ticker"), "page", "payload").join(listed, "ticker").drop("ticker")


def reference_values(payloads: DataFrame) -> DataFrame:
    """Second-source annual values by (concept, calendar year of the period end); zeros dropped.

    Several rows for one year: the latest period end wins, then the later row.
    """
    cells = statement_cells(payloads, dims.reconcile_fields(payloads.sparkSession))
    cells = cells.filter((F.col("period") == "FY") & F.col("report_year").isNotNull()
                         & (F.col("value") != 0))
    order = F.struct(F.col("end_date"), "page", "block", "row_no")
    return (cells.groupBy("company_id", "canonical_concept", F.col("report_year").alias("end_year"))
                 .agg(F.max_by("value", order).alias("reference_value")))


def baseline_facts(payloads: DataFrame, ciks: DataFrame, quarterly: bool = False) -> DataFrame:
    """Second-source facts in the stored layout.

    Annual mode keeps fiscal-year flows and Q4 balances. Per (concept, year, period) the newest
    publication wins, the first row on ties. ``ciks`` has (company_id, cik).
    """
    cells = (statement_unpivot(payloads)
             .filter(F.col("period").isin("FY", *fixed.QUARTERS))
             .withColumn("fiscal_year", periods.baseline_fiscal_year(F.col("end_date"), F.col("period")))
             .withColumn("filed_date", F.coalesce("publish_date", "end_date")))
    if not quarterly:
        cells = cells.filter(F.when(F.col("is_flow"), F.col("period") == "FY")
                              .otherwise(F.col("period") == "Q4"))
    newest = first_by(cells, ["company_id", "canonical_concept", "fiscal_year", "period"],
                      [F.desc("filed_date"), "page", "block", "row_no"])
    unit = F.when(F.col("canonical_concept") == "eps_diluted", "USD/shares").otherwise("USD")
    return newest.join(ciks, "company_id").select(
        "company_id", F.concat(F.lit(fixed.BASELINE_TAG_PREFIX), F.col("column")).alias("concept"),
        "canonical_concept", unit.alias("unit"), "value", "fiscal_year",
        F.col("period").alias("fiscal_period"), F.lit(None).cast("date").alias("start_date"),
        "end_date", F.lit(fixed.BASELINE_FORM).alias("form"),
        F.lit(fixed.BASELINE_ACCESSION).alias("accession_number"), "filed_date",
        F.concat(F.lit(fixed.COMPANY_URL), F.col("cik")).alias("source_url"),
        F.lit(False).alias("derived"))
