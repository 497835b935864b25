"""Custom model sheets: formulas and templates as tables, evaluated on the columns of all sheets.

A sheet column holds its cells as one map of concept to value, and a formula is an array of signed
terms, so that any number of formulas and templates needs no join on concepts: they meet the columns of
the companies that ask for them and are folded over the map. A blank cell adds as 0.
"""

from __future__ import annotations

import re
from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from almanac import fixed
from almanac.functions import concepts
from almanac.operators import pointintime, sheets

# A formula is concept names joined by + and -; spaces are free (fixed pattern).
FORMULA = r"^\s*[a-z_]+(\s*[+-]\s*[a-z_]+)*\s*$"
TERM = r"([+-]?)\s*([a-z_]+)"


def validate_formulas(formulas: DataFrame) -> DataFrame:
    """Adds valid: the grammar holds and every concept is a known one."""
    terms = F.regexp_extract_all("expression", F.lit(TERM), 2)
    known = F.forall(terms, concepts.is_known)
    return formulas.withColumn("valid", F.col("expression").rlike(FORMULA) & known)


def _terms() -> Column:
    """The signed terms of ``expression`` as an array."""
    signs = F.regexp_extract_all("expression", F.lit(TERM), 1)
    words = F.regexp_extract_all("expression", F.lit(TERM), 2)
    return F.zip_with(signs, words, lambda op, word: F.struct(F.when(op == "-", -1.0).otherwise(1.0).alias("sign"), word.alias("concept")))


def dense_columns(facts: DataFrame, period: str = "annual", **column_options) -> DataFrame:
    """Every sheet column (company_id, fiscal_year, fiscal_period) with ``cells``: a map of concept to
    (value, derived, source_url), empty where the column has no cell.

    In an annual column flows show the fiscal year and balances the year end; a quarterly column shows
    its quarter. The entries of a map are at most the known concepts.
    """
    columns = sheets.sheet_columns(facts, period, **column_options)
    known = facts.filter(concepts.is_known(F.col("canonical_concept")))
    if period == "annual":
        wanted = F.when(concepts.is_flow(F.col("canonical_concept")), "FY").otherwise("Q4")
        cells = pointintime.latest(known.filter(F.col("fiscal_period") == wanted)).withColumn("fiscal_period", F.lit("FY"))
    else:
        cells = pointintime.latest(known.filter(F.col("fiscal_period").isin(fixed.QUARTERS)))
    entry = F.struct("canonical_concept", F.struct("value", "derived", "source_url"))
    keys = ["company_id", "fiscal_year", "fiscal_period"]
    filled = cells.groupBy(*keys).agg(F.map_from_entries(F.collect_list(entry)).alias("cells"))
    return columns.join(filled, keys, "left")


def _cell(concept: Column) -> Column:
    return F.try_element_at(F.col("cells"), concept)


def _sum(terms: Column) -> Column:
    return F.aggregate(terms, F.lit(0.0), lambda total, t: total + t["sign"] * F.coalesce(_cell(t["concept"])["value"], F.lit(0.0)))


def formula_values(formulas: DataFrame, requests: DataFrame, facts: DataFrame, period: str = "annual", **column_options) -> DataFrame:
    """Value of each valid formula (formula_id, expression) that a company asks for (company_id,
    formula_id), in every column of the company's sheet; a blank cell adds as 0."""
    terms = validate_formulas(formulas).filter("valid").select("formula_id", _terms().alias("terms"))
    asked = requests.select("company_id", "formula_id").distinct().join(terms, "formula_id")
    return dense_columns(facts, period, **column_options).join(asked, "company_id").select(
        "company_id", "formula_id", "fiscal_year", "fiscal_period", _sum(F.col("terms")).alias("value"))


def checked_rows(rows: DataFrame) -> DataFrame:
    """Template rows (template_id, row_no, type, label, concept, expression) with ``error``, null where
    the row is sound.

    A concept row needs a label and a known concept, a formula row a label, the grammar, and concepts
    that are rows of its own template, above or below it; other types than these and spacer are errors.
    """
    held = F.collect_set(F.when(F.col("type") == "concept", F.col("concept"))).over(Window.partitionBy("template_id"))
    marked = rows.withColumn("_held", held)
    words = F.regexp_extract_all("expression", F.lit(TERM), 2)
    blank = F.coalesce(F.trim("label") == "", F.lit(True))
    error = (F.when(F.col("type") == "spacer", None)
             .when(~F.coalesce(F.col("type").isin("concept", "formula"), F.lit(False)), "unknown type")
             .when(blank, "no label")
             .when((F.col("type") == "concept") & ~F.coalesce(concepts.is_known(F.col("concept")), F.lit(False)), "unknown concept")
             .when((F.col("type") == "formula") & ~F.coalesce(F.col("expression").rlike(FORMULA), F.lit(False)), "no formula")
             .when((F.col("type") == "formula") & ~F.forall(words, lambda w: F.array_contains(F.col("_held"), w)), "not a row"))
    return marked.withColumn("error", error).drop("_held")


def template_sheets(rows: DataFrame, requests: DataFrame, facts: DataFrame, period: str = "annual", **column_options) -> DataFrame:
    """Cells of the templates that companies ask for (company_id, template_id), in every column of their
    sheets. Templates with an unsound row give no sheet; spacers only hold their row number; concept
    cells without a fact are left out, formula cells exist in every column."""
    checked = checked_rows(rows)
    entry = F.struct("row_no", "type", "label", "concept", F.when(F.col("type") == "formula", _terms()).alias("terms"))
    lists = checked.groupBy("template_id").agg(F.count("error").alias("errors"), F.sort_array(F.collect_list(entry)).alias("rows"))
    asked = requests.select("company_id", "template_id").distinct().join(lists.filter("errors = 0").drop("errors"), "template_id")
    columns = dense_columns(facts, period, **column_options).join(asked, "company_id")
    lines = F.transform(F.filter("rows", lambda r: r["type"] != "spacer"), lambda r: F.struct(
        r["row_no"].alias("row_no"), r["label"].alias("label"),
        F.when(r["type"] == "formula", _sum(r["terms"])).otherwise(_cell(r["concept"])["value"]).alias("value"),
        F.when(r["type"] == "formula", False).otherwise(_cell(r["concept"])["derived"]).alias("derived"),
        F.when(r["type"] == "concept", _cell(r["concept"])["source_url"]).alias("source_url")))
    return columns.select("company_id", "template_id", "fiscal_year", "fiscal_period", F.inline(lines)).filter("value is not null")


def template_sheet(rows: list[dict], facts: DataFrame, period: str = "annual", **column_options) -> DataFrame:
    """Cells of one template, a list of concept, formula and spacer rows, in all sheets.

    Every template row is a plain expression over a column's cells, wherever its concept rows stand.
    Formula cells exist in every column; spacers only advance the row number.
    """
    sheet = dense_columns(facts, period, **column_options)
    lines = []
    for n, row in enumerate(rows, 1):
        if row["type"] == "concept":
            cell = _cell(F.lit(row["concept"]))
            value, derived = cell["value"], cell["derived"]
        elif row["type"] == "formula":
            parts = [F.coalesce(_cell(F.lit(name))["value"], F.lit(0.0)) * (-1 if op == "-" else 1)
                     for op, name in re.findall(TERM, row["expression"])]
            value, derived = reduce(add, parts), F.lit(False)
        else:
            continue
        lines.append(F.struct(F.lit(n).alias("row_no"), F.lit(row["label"]).alias("label"),
                              value.alias("value"), derived.alias("derived")))
    return sheet.select("company_id", "fiscal_year", "fiscal_period", F.inline(F.array(*lines))) \
                .filter(F.col("value").isNotNull())
