"""New-filing monitor, as one batch pass and as a stream."""

from __future__ import annotations

from hashlib import sha1

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from almanac import fixed
from almanac.sources.keyed import KeyedTable

FILING_KEY = ["company_id", "accession_number"]
SEEN = "company_id long, accession_number string, form string, filed_date date"
REFRESH = "company_id long, new_filings long, refresh boolean"


def new_filings(filings: DataFrame, seen: DataFrame) -> DataFrame:
    """Watched filings that are not in the seen table, once each."""
    watched = filings.filter(F.col("form").isin(fixed.WATCHED_FORMS))
    return watched.join(seen.select(*FILING_KEY), FILING_KEY, "left_anti").dropDuplicates(FILING_KEY)


def refresh_list(fresh: DataFrame) -> DataFrame:
    """Companies with new filings; refresh is true if one of them carries financial data."""
    return fresh.groupBy("company_id").agg(
        F.count("*").alias("new_filings"),
        F.bool_or(F.col("form").isin(fixed.FINANCIAL_FORMS)).alias("refresh"))


def seen_table(spark: SparkSession, path: str, buckets: int = 64) -> KeyedTable:
    """The filings seen so far, in buckets of companies."""
    return KeyedTable(spark, path, SEEN, ["company_id"], buckets)


def seen_filings(spark: SparkSession, path: str) -> DataFrame:
    return seen_table(spark, path).read()


def refresh_flags(spark: SparkSession, path: str) -> DataFrame:
    """The companies to refresh, over all batches of a stream."""
    return spark.read.schema(REFRESH).parquet(path).groupBy("company_id").agg(
        F.sum("new_filings").alias("new_filings"), F.bool_or("refresh").alias("refresh"))


def watch_filings(filings: DataFrame, seen_path: str, checkpoint: str, trigger: dict | None = None,
                  refresh_path: str | None = None, repeats_within: str | None = None) -> StreamingQuery:
    """Adds every new watched filing of a stream to the seen table, exactly once, and writes the companies
    to refresh, a folder for each batch.

    The history is unbounded and exact because it is a table, not operator state; a batch reads only the
    buckets of its companies. A batch repeated after a failure is known by its number in the table's
    manifest; its refresh list, written before, is replaced. A stream started over with another
    checkpoint finds all filings seen. ``repeats_within`` drops filings that arrive again within that time
    before they reach a batch's join (Spark's own state, by time of arrival, so that no filing is late).
    """
    run = sha1(checkpoint.encode()).hexdigest()[:12]
    refresh_path = refresh_path or f"{seen_path}-refresh"
    table = seen_table(filings.sparkSession, seen_path)

    def record(batch: DataFrame, batch_id: int) -> None:
        if table.marks().get(run, -1) >= batch_id:
            return
        watched = batch.select(*FILING_KEY, "form", "filed_date").filter(F.col("form").isin(fixed.WATCHED_FORMS)).persist()
        fresh = new_filings(watched, table.read(watched)).persist()
        refresh_list(fresh).write.mode("overwrite").parquet(f"{refresh_path}/run={run}/batch={batch_id}")
        table.append(fresh, mark=(run, batch_id))
        fresh.unpersist()
        watched.unpersist()

    empty = filings.sparkSession.createDataFrame([], REFRESH)
    empty.write.mode("overwrite").parquet(f"{refresh_path}/run=none/batch=0")
    if repeats_within:
        filings = filings.withColumn("arrived", F.current_timestamp()).withWatermark("arrived", repeats_within) \
                         .dropDuplicatesWithinWatermark(FILING_KEY)
    return (filings.writeStream.foreachBatch(record)
            .option("checkpointLocation", checkpoint)
            .trigger(**(trigger or {"availableNow": True})).start())
