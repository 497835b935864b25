"""Matching companies between sources and recovering lost identities."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from almanac import fixed
from almanac.functions import links, names
from almanac.sources.store import first_by


def universe_match(universe: DataFrame, ciks: DataFrame) -> DataFrame:
    """Second-source companies (position, ticker, name, sector_name) that are listed filers.

    The ticker must be listed and the names must agree, since tickers are reassigned. Of several
    share classes of one company the first in list order stays.
    """
    listed = ciks.select("ticker", "cik", F.col("title").alias("listed_name"))
    pairs = (universe.withColumn("ticker", F.upper("ticker")).filter(F.col("ticker") != "")
             .join(listed, "ticker")
             .filter(names.names_agree(F.col("name"), F.col("listed_name"))))
    return first_by(pairs, ["cik"], ["position"]).select(
        "ticker", "cik", F.coalesce("name", "listed_name").alias("name"),
        names.sector_name(F.col("sector_name")).alias("sector"))


def relink_sources(facts: DataFrame, companies: DataFrame, documents: DataFrame) -> DataFrame:
    """Facts with the audit link deepened to the document where its filing resolves.

    Second-source rows, which have no document, pass by the join; unresolved filings keep their link.
    """
    known = documents.join(companies.select(F.col("id").alias("company_id"), "cik"), "company_id") \
        .select("company_id", "accession_number",
                links.viewer_url(F.col("cik"), F.col("accession_number"), F.col("document")).alias("deep_url"))
    filed = F.coalesce(F.col("accession_number") != fixed.BASELINE_ACCESSION, F.lit(False))
    joined = facts.filter(filed).join(known, ["company_id", "accession_number"], "left")
    deeper = joined.withColumn("source_url", F.coalesce("deep_url", "source_url")).select(*facts.columns)
    return deeper.unionByName(facts.filter(~filed))


def recover_companies(facts: DataFrame, known: DataFrame, primary: DataFrame) -> DataFrame:
    """Company rows rebuilt from the audit links of facts.

    Known ids are skipped and so are numbers already in use; of several ids for one company number
    the lowest stays. The primary listed ticker is taken unless it is in use; then, or without a
    listing, the company gets "CIK<number>", or nothing if that is in use too.
    Lower ids claim tickers first.
    """
    found = (facts.withColumn("cik_number", names.cik_from_url(F.col("source_url")))
             .filter(F.col("cik_number").isNotNull())
             .groupBy("company_id").agg(F.min("cik_number").alias("cik_number"))
             .join(known.select(F.col("id").alias("company_id")), "company_id", "left_anti"))
    one_each = (found.groupBy("cik_number").agg(F.min("company_id").alias("company_id"))
                .withColumn("cik", names.padded_cik(F.col("cik_number")))
                .join(known.select("cik"), "cik", "left_anti"))
    taken = known.select("ticker", F.lit(True).alias("taken"))
    listed = (one_each.join(primary.select("cik_number", "ticker", "title"), "cik_number", "left")
              .join(taken, "ticker", "left"))
    # A free listed ticker goes to the lowest id asking for it, everyone else gets a number.
    owners = (listed.filter(F.col("ticker").isNotNull() & F.col("taken").isNull())
              .groupBy("ticker").agg(F.min("company_id").alias("company_id"))
              .withColumn("owner", F.lit(True)))
    number = F.concat(F.lit("CIK"), F.col("cik_number").cast("string"))
    named = listed.join(owners, ["ticker", "company_id"], "left").select(
        "company_id", "cik", F.coalesce("owner", F.lit(False)).alias("owner"), "title",
        F.when(F.col("owner"), F.col("ticker")).otherwise(number).alias("ticker"))
    free = named.join(taken, "ticker", "left_anti")
    return first_by(free, ["ticker"], [F.desc("owner"), "company_id"]).select(
        "company_id", "cik", "ticker", F.coalesce("title", "ticker").alias("name"))
