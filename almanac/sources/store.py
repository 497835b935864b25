"""The stored fact table: scans with pushed filters, idempotent appends, public records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

FACT_COLUMNS = [
    "company_id", "concept", "canonical_concept", "unit", "value", "fiscal_year", "fiscal_period",
    "start_date", "end_date", "form", "accession_number", "filed_date", "source_url", "derived",
]
# The unit is deliberately not part of the key.
FACT_KEY = ["company_id", "concept", "fiscal_year", "fiscal_period", "accession_number", "derived"]


# Facts at rest lie in buckets of the company, which all selections, derivations and sheets group by.
CLUSTERED_BY = ["company_id"]
SORTED_BY = ["company_id", "canonical_concept"]


def write_clustered(rows: DataFrame, name: str, path: str, buckets: int) -> DataFrame:
    """Writes facts as the table ``name`` at ``path``, bucketed by ``CLUSTERED_BY``, sorted by ``SORTED_BY``, and reads it.

    Selections by company, concept, year and period, and aggregates that group by company and more, then
    run on the scan's own partitioning, without an exchange. One company is in one bucket: its facts are as
    many as its years and concepts. Rows that are dealt by company into as many partitions stay where they are.
    """
    dealt = rows.repartition(buckets, *CLUSTERED_BY).sortWithinPartitions(*SORTED_BY)
    (dealt.write.mode("overwrite").option("path", path).bucketBy(buckets, *CLUSTERED_BY).sortBy(*SORTED_BY).saveAsTable(name))
    return rows.sparkSession.table(name)


def open_clustered(spark: SparkSession, name: str, path: str, schema: StructType, buckets: int) -> DataFrame:
    """The facts that another session has written with ``write_clustered``, with their buckets."""
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)
    spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({columns}) USING parquet "
              f"CLUSTERED BY ({', '.join(CLUSTERED_BY)}) SORTED BY ({', '.join(SORTED_BY)}) INTO {buckets} BUCKETS LOCATION '{path}'")
    return spark.table(name)


def first_by(df: DataFrame, keys: list[str], order: list[Column | str]) -> DataFrame:
    """The first row of every key in the given order.

    Written as a filtered row number: Spark then keeps one row per key and map task before the
    shuffle, so a key with many rows does not travel whole.
    """
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_rank", rank).filter(F.col("_rank") == 1).drop("_rank")


def read_facts(spark: SparkSession, path: str, *, company_id: int | None = None,
               concept: str | None = None, fiscal_year: int | None = None,
               fiscal_period: str | None = None) -> DataFrame:
    """Stored facts; the filters reach the Parquet scan."""
    facts = spark.read.parquet(path)
    wanted = {"company_id": company_id, "canonical_concept": concept, "fiscal_year": fiscal_year,
              "fiscal_period": fiscal_period and fiscal_period.upper()}
    for column, value in wanted.items():
        if value is not None:
            facts = facts.filter(F.col(column) == value)
    return facts


def new_facts(candidates: DataFrame, stored: DataFrame) -> DataFrame:
    """The candidates to append: first arrival per key, without the keys already stored."""
    fresh = candidates.join(stored.select(*FACT_KEY), FACT_KEY, "left_anti")
    return first_by(fresh, FACT_KEY, ["arrival"]).select(*FACT_COLUMNS)


def append_facts(candidates: DataFrame, path: str) -> None:
    """Appends the new facts; running it again adds nothing.

    Rows are clustered by company so that later reads of a company prune by file statistics.
    """
    spark = candidates.sparkSession
    rows = new_facts(candidates, spark.read.parquet(path))
    (rows.repartitionByRange("company_id").sortWithinPartitions("company_id", "canonical_concept")
         .write.mode("append").parquet(path))


def public_records(facts: DataFrame, *extra: str) -> DataFrame:
    """The stable public record of a fact, with ISO dates, after the ``extra`` columns."""
    return facts.select(
        *extra,
        F.col("canonical_concept").alias("concept"), F.col("concept").alias("xbrl_tag"), "value",
        "unit", "fiscal_year", "fiscal_period",
        F.date_format("end_date", "yyyy-MM-dd").alias("end_date"), "form",
        F.date_format("filed_date", "yyyy-MM-dd").alias("filed_date"), "derived", "source_url")
