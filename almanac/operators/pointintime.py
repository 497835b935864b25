"""Point-in-time selection over stored facts, for all companies at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from almanac import fixed
from almanac.functions import concepts
from almanac.sources.store import FACT_COLUMNS, first_by

PERIOD_KEY = ["company_id", "canonical_concept", "fiscal_year", "fiscal_period"]
YEAR_KEY = ["company_id", "canonical_concept", "fiscal_year"]


def current_order() -> list[Column]:
    """Best tag first, then the newest filing; the rest only makes ties deterministic."""
    return [concepts.tag_priority(F.col("concept")), F.desc("filed_date"),
            F.col("accession_number"), F.col("concept"), F.col("derived")]


def original_order() -> list[Column]:
    """Earliest filing first; second-source rows only where there is nothing else."""
    return [F.col("accession_number") == fixed.BASELINE_ACCESSION, F.col("filed_date"),
            F.col("accession_number"), F.col("concept"), F.col("derived")]


def latest(facts: DataFrame) -> DataFrame:
    """The current (post-restatement) fact of every period."""
    return first_by(facts, PERIOD_KEY, current_order())


def original(facts: DataFrame) -> DataFrame:
    """The fact of every period as first reported."""
    return first_by(facts, PERIOD_KEY, original_order())


def financials(facts: DataFrame, concept: str | None = None, fiscal_year: int | None = None,
               fiscal_period: str | None = None, point_in_time: str = "latest") -> DataFrame:
    """Filtered facts of one vintage view, in order of company, concept, year and period inside each partition.

    The filters are on keys of the selection, so they reach the scan below it. Facts clustered at rest
    (``store.write_clustered``) keep each company's concept in one partition, without an exchange.
    """
    views = {"latest": latest, "original": original, "all": lambda rows: rows}
    if point_in_time not in views:
        raise ValueError(f"point_in_time must be one of {sorted(views)}")
    if concept:
        facts = facts.filter(F.col("canonical_concept") == concept)
    if fiscal_year:
        facts = facts.filter(F.col("fiscal_year") == fiscal_year)
    if fiscal_period:
        facts = facts.filter(F.col("fiscal_period") == fiscal_period.upper())
    return views[point_in_time](facts).sortWithinPartitions(*PERIOD_KEY)


def annual_facts(facts: DataFrame) -> DataFrame:
    """The annual fact per (company, concept, year): the fiscal year if reported, else Q4.

    One pass: sorting the fiscal year before Q4 makes both choices in a single selection.
    """
    annual = facts.filter(F.col("fiscal_period").isin("FY", "Q4"))
    return first_by(annual, YEAR_KEY, [F.col("fiscal_period") != "FY", *current_order()])


def annual_values(facts: DataFrame) -> DataFrame:
    return annual_facts(facts).select(*YEAR_KEY, "fiscal_period", "end_date", "value")


def best_by_period(facts: DataFrame, carried: dict[str, list[str]], *extra: Column) -> DataFrame:
    """One row per (company, concept, year) with the current fact of each wanted period side by side.

    ``carried`` names the fields to keep per period. The current fact is the minimum of a struct
    that starts with the selection order, so all periods come out of one aggregation that is
    partially done before its only shuffle. ``extra`` adds further aggregates.
    """
    order = [concepts.tag_priority(F.col("concept")).alias("o1"), F.coalesce(-F.unix_date("filed_date"), F.lit(2**31 - 1)).alias("o2"),
             F.col("accession_number").alias("o3"), F.col("concept").alias("o4"), F.col("derived").alias("o5")]

    def best(period: str, fields: list[str]) -> Column:
        pick = F.struct(*order, F.struct(*fields).alias("fact"))
        return F.min(F.when(F.col("fiscal_period") == period, pick))["fact"].alias(period)

    return facts.groupBy(*YEAR_KEY).agg(*[best(p, fields) for p, fields in carried.items()], *extra)


def derive_q4(facts: DataFrame) -> DataFrame:
    """Q4 = FY - (Q1 + Q2 + Q3) for flows without any Q4 row.

    Only reported rows enter the difference, but a Q4 row of any kind blocks the year.
    """
    kept = ["concept", "unit", "value", "end_date", "form", "accession_number", "filed_date", "source_url"]
    flows = facts.filter(concepts.is_flow(F.col("canonical_concept"))
                         & (~F.col("derived") | (F.col("fiscal_period") == "Q4")))
    years = best_by_period(
        flows, {"FY": kept, "Q1": ["value"], "Q2": ["value"], "Q3": ["value"]},
        F.coalesce(F.bool_or(F.col("fiscal_period") == "Q4"), F.lit(False)).alias("has_q4"))
    complete = years.filter(~F.col("has_q4") & F.col("FY").isNotNull() & F.col("Q1").isNotNull()
                            & F.col("Q2").isNotNull() & F.col("Q3").isNotNull())
    return complete.select(
        "company_id", "FY.concept", "canonical_concept", "FY.unit",
        (F.col("FY.value") - (F.col("Q1.value") + F.col("Q2.value") + F.col("Q3.value"))).alias("value"),
        "fiscal_year", F.lit("Q4").alias("fiscal_period"), F.lit(None).cast("date").alias("start_date"),
        "FY.end_date", "FY.form", "FY.accession_number", "FY.filed_date", "FY.source_url",
        F.lit(True).alias("derived")).select(*FACT_COLUMNS)


def with_derived_q4(facts: DataFrame) -> DataFrame:
    return facts.select(*FACT_COLUMNS).unionByName(derive_q4(facts))


def year_over_year(annual: DataFrame) -> DataFrame:
    """Adds the value of exactly the year before, and the growth against it when it is not 0.

    A value range of one year back, not the previous row: a gap in the years yields no prior value.
    """
    year_before = (Window.partitionBy("company_id", "canonical_concept")
                   .orderBy("fiscal_year").rangeBetween(-1, -1))
    rows = annual.withColumn("prior_value", F.max("value").over(year_before))
    return rows.withColumn("growth", F.when(F.col("prior_value") != 0,
                                            F.col("value") / F.col("prior_value") - 1))
