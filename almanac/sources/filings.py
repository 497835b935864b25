"""Filing lists from parallel-array payloads, and the raw-document archive."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from almanac import fixed
from almanac.sources.keyed import KeyedTable

BLOCK = ("struct<form: array<string>, accessionNumber: array<string>, "
         "filingDate: array<string>, primaryDocument: array<string>>")
# The first payload wraps its block, the payloads of older pages are a block themselves.
SUBMISSIONS = f"struct<filings: struct<recent: {BLOCK}, files: array<struct<name: string>>>, {BLOCK[7:]}"


def filing_rows(submissions: DataFrame) -> DataFrame:
    """Every filing of (company_id, block, payload) with its position, newest first."""
    parsed = F.from_json("payload", SUBMISSIONS)
    lists = [F.coalesce(parsed["filings"]["recent"][name], parsed[name])
             for name in ("form", "accessionNumber", "filingDate", "primaryDocument")]
    zipped = F.arrays_zip(*lists)
    names = ["form", "accession_number", "filed_date", "document"]
    return (submissions
            .select("company_id", "block", F.posexplode(zipped).alias("position", "filing"))
            .select("company_id", "block", "position", F.inline(F.array("filing")))
            .toDF("company_id", "block", "position", *names)
            .withColumn("filed_date", F.try_to_date("filed_date", "yyyy-MM-dd")))


def recent_filings(submissions: DataFrame, forms: list[str] | None = None) -> DataFrame:
    """Filings of the watched forms."""
    return filing_rows(submissions).filter(F.col("form").isin(forms or fixed.WATCHED_FORMS))


def accession_documents(submissions: DataFrame) -> DataFrame:
    """company_id, accession_number, document over all blocks.

    Blank documents are skipped. A later block, and inside it a later position, overwrites.
    """
    return (filing_rows(submissions)
            .filter(F.col("document") != "")
            .groupBy("company_id", "accession_number")
            .agg(F.max_by("document", F.struct("block", "position")).alias("document")))


def newest_filings(filings: DataFrame, forms: list[str], n: int, order: list[Column]) -> DataFrame:
    """The newest ``n`` filings of the given forms per company, with their rank."""
    rank = F.row_number().over(Window.partitionBy("company_id").orderBy(*order))
    return (filings.filter(F.col("form").isin(forms))
                   .withColumn("rank", rank).filter(F.col("rank") <= n))


def archive_selection(filings: DataFrame, companies: DataFrame, forms: list[str], n: int,
                      order: list[Column]) -> DataFrame:
    """The filings to archive, with their place {TICKER}/{accession}/{document}."""
    picked = newest_filings(filings, [f.strip().upper() for f in forms], n, order)
    return (picked
            .join(companies.select(F.col("id").alias("company_id"), F.upper("ticker").alias("ticker")),
                  "company_id")
            .withColumn("path", F.concat_ws("/", "ticker", "accession_number", "document")))


ARCHIVE = "ticker string, accession_number string, document string, path string, html string"


def archive(spark: SparkSession, path: str, buckets: int = 64) -> KeyedTable:
    """The archive of raw documents, in buckets of tickers: a few files whatever the number of filings."""
    return KeyedTable(spark, path, ARCHIVE, ["ticker"], buckets)


def write_archive(selection: DataFrame, contents: DataFrame, path: str) -> None:
    """Stores document contents (accession_number, html) by ticker and accession.

    Run again, it replaces the documents that have contents and no others.
    """
    rows = selection.join(contents, "accession_number").select("ticker", "accession_number", "document", "path", "html")
    archive(selection.sparkSession, path).replace(rows, rows, on=["ticker", "accession_number"])
