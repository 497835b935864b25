"""Comparison of our annual values with a second source."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from almanac import fixed
from almanac.functions.numbers import variance
from almanac.operators import pointintime


def compared_values(facts: DataFrame, reference: DataFrame) -> DataFrame:
    """Our and the reference value per (company, concept, calendar year of the period end).

    Two fiscal years may end in one calendar year; the larger label is compared.
    """
    ours = (pointintime.annual_facts(facts)
            .groupBy("company_id", "canonical_concept", F.year("end_date").alias("end_year"))
            .agg(F.max(F.struct("fiscal_year", "value")).alias("ours"))
            .select("company_id", "canonical_concept", "end_year",
                    F.col("ours.fiscal_year").alias("fiscal_year"), F.col("ours.value").alias("our_value")))
    both = ours.join(reference, ["company_id", "canonical_concept", "end_year"])
    return both.withColumn("variance", variance(F.col("our_value"), F.col("reference_value")))


def flags(compared: DataFrame, threshold: float = fixed.VARIANCE_THRESHOLD) -> DataFrame:
    """The values that differ by more than the threshold, for review."""
    return compared.filter(F.col("variance") > threshold).select(
        "company_id", "canonical_concept", "fiscal_year", "our_value", "reference_value", "variance")


def summary(compared: DataFrame, threshold: float = fixed.VARIANCE_THRESHOLD) -> DataFrame:
    """Compared, matched and flagged values per company."""
    flagged = F.count_if(F.col("variance") > threshold)
    return compared.groupBy("company_id").agg(
        F.count("*").alias("compared"), (F.count("*") - flagged).alias("matched"),
        flagged.alias("flagged"))


def review_queue(flagged: DataFrame) -> DataFrame:
    """Flags with the largest variance first."""
    return flagged.orderBy(F.desc("variance"), "company_id", "canonical_concept", "fiscal_year")


def replace_flags(stored: DataFrame, flagged: DataFrame, checked: DataFrame) -> DataFrame:
    """The flag table after a run: companies in ``checked`` keep only the flags just found."""
    kept = stored.join(checked.select("company_id"), "company_id", "left_anti")
    return kept.unionByName(flagged)
