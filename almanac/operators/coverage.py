"""Coverage class, sector vocabulary and the resumable worklists."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from almanac import dims, fixed
from almanac.functions import names


def filed_companies(facts: DataFrame) -> DataFrame:
    """company_id of the companies with at least one fact from a filing."""
    return facts.filter(F.col("accession_number") != fixed.BASELINE_ACCESSION) \
                .select("company_id").distinct()


def coverage_source(companies: DataFrame, facts: DataFrame) -> DataFrame:
    """Companies with their source: "sec" with facts from filings, else "baseline"."""
    filed = filed_companies(facts).withColumn("filed", F.lit(True))
    return (companies.join(filed, companies["id"] == filed["company_id"], "left")
            .select("ticker", "name", "cik", "sector",
                    F.when(F.col("filed"), "sec").otherwise("baseline").alias("source"))
            .orderBy("ticker"))


def with_sector(companies: DataFrame) -> DataFrame:
    """Adds the sector of the SIC code: null without a code, "Other" outside all ranges."""
    coded = companies.withColumn("code", F.when(F.col("sic").rlike("^[0-9]+$"), F.col("sic").try_cast("int")))
    sectors = F.broadcast(dims.sic_sectors(companies.sparkSession))
    return coded.join(sectors, "code", "left").withColumn(
        "sector", F.when(F.col("code").isNotNull(), F.coalesce("sector", F.lit(fixed.OTHER_SECTOR)))).drop("code")


def sector_list(companies: DataFrame) -> DataFrame:
    return companies.filter(F.coalesce("sector", F.lit("")) != "").select("sector") \
                    .distinct().orderBy("sector")


def bulk_worklist(listed: DataFrame, companies: DataFrame, facts: DataFrame,
                  target: int | None = None, covered: int | None = None, stored_only: bool = False) -> DataFrame:
    """Listed tickers still to ingest, in listed order.

    ``target`` counts companies in the database, of which ``covered`` have facts by the caller's own
    count, so the list holds what is missing to reach it.
    """
    have = companies.join(filed_companies(facts), companies["id"] == F.col("company_id"), "left_semi") \
                    .select("ticker").distinct()
    todo = listed.filter(names.plain_symbol(F.col("ticker"))).join(have, "ticker", "left_anti")
    if stored_only:
        todo = todo.join(companies.select("ticker"), "ticker", "left_semi")
    first = todo.groupBy("ticker").agg(F.min(F.struct("shard", "position")).alias("place"))
    ordered = first.orderBy("place").select("ticker", "place.shard", "place.position")
    if target is None:
        return ordered
    if covered is None:
        raise ValueError("a target needs the number of covered companies")
    return ordered.limit(max(target - covered, 0))


def kpi_sweep_worklist(companies: DataFrame, kpis: DataFrame, sectors_only: bool = False) -> DataFrame:
    """Companies without KPIs: sectors with their own targets first, then the rest, by ticker."""
    todo = companies.join(kpis.select(F.col("company_id").alias("id")), "id", "left_anti") \
        .withColumn("covered", F.coalesce(F.col("sector").isin(list(fixed.SECTOR_KPIS)), F.lit(False)))
    if sectors_only:
        todo = todo.filter("covered")
    return todo.orderBy(F.desc("covered"), "ticker").select("ticker", "sector", "covered")


def reconcile_worklist(companies: DataFrame, facts: DataFrame, checks: DataFrame,
                       today: dt.date) -> DataFrame:
    """Companies with filed facts that were not checked within the recheck window, by ticker."""
    cutoff = today - dt.timedelta(days=fixed.RECHECK_DAYS)
    recent = checks.filter(F.col("checked") >= F.lit(cutoff)).select(F.col("company_id").alias("id"))
    filed = filed_companies(facts).withColumnRenamed("company_id", "id")
    return companies.join(filed, "id", "left_semi").join(recent, "id", "left_anti") \
                    .orderBy("ticker").select("ticker")


def kpi_extract_worklist(companies: DataFrame, facts: DataFrame, kpis: DataFrame) -> DataFrame:
    """Companies with filed facts and no KPIs, by ticker."""
    filed = filed_companies(facts).withColumnRenamed("company_id", "id")
    return companies.join(filed, "id", "left_semi") \
        .join(kpis.select(F.col("company_id").alias("id")), "id", "left_anti") \
        .orderBy("ticker").select("ticker")


def baseline_worklist(candidates: DataFrame, companies: DataFrame, facts: DataFrame) -> DataFrame:
    """Candidates whose ticker has no facts at all."""
    have = companies.join(facts.select(F.col("company_id").alias("id")), "id", "left_semi")
    return candidates.join(have.select("ticker"), "ticker", "left_anti")
