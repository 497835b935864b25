"""The fixed values as small DataFrames (local relations, so their size is known to the planner)."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from almanac import fixed


def _literal(value: object) -> str:
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return "true" if value else "false"
    if isinstance(value, list):
        return "array(" + ", ".join(_literal(v) for v in value) + ")"
    if isinstance(value, str):
        return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"
    return str(value)


def values_table(spark: SparkSession, columns: list[str], rows: Iterable[tuple]) -> DataFrame:
    """A literal table of fixed rows."""
    body = ", ".join("(" + ", ".join(_literal(v) for v in row) + ")" for row in rows)
    return spark.sql(f"SELECT * FROM VALUES {body} AS t({', '.join(columns)})")


def tags(spark: SparkSession) -> DataFrame:
    """tag, canonical_concept, priority, is_flow."""
    return values_table(
        spark, ["tag", "canonical_concept", "priority", "is_flow"],
        [(tag, concept, rank, flow)
         for concept, flow, names in fixed.CONCEPTS for rank, tag in enumerate(names)])


def sic_sectors(spark: SparkSession) -> DataFrame:
    """One row per SIC code inside a range, with the sector of its narrowest range.

    Expanding the ranges (at most 9,999 codes) turns the range lookup into an equi join.
    """
    ranges = values_table(spark, ["lo", "hi", "sector"], fixed.SIC_RANGES)
    codes = ranges.select(F.explode(F.sequence("lo", "hi")).alias("code"),
                          F.struct((F.col("hi") - F.col("lo")).alias("width"), "sector").alias("pick"))
    return codes.groupBy("code").agg(F.min("pick")["sector"].alias("sector"))


def ingest_fields(spark: SparkSession) -> DataFrame:
    return values_table(spark, ["statement", "column", "canonical_concept", "is_flow"],
                        fixed.INGEST_FIELDS)


def reconcile_fields(spark: SparkSession) -> DataFrame:
    return values_table(spark, ["statement", "column", "canonical_concept"],
                        fixed.RECONCILE_FIELDS)


def statement_rows(spark: SparkSession) -> DataFrame:
    """row_no, statement, label, canonical_concept, is_flow."""
    flow = {name: is_flow for name, is_flow, _ in fixed.CONCEPTS}
    return values_table(
        spark, ["row_no", "statement", "label", "canonical_concept", "is_flow"],
        [(n, sheet, label, concept, flow[concept])
         for n, (sheet, label, concept) in enumerate(fixed.STATEMENT_ROWS, 1)])


def kpi_targets(spark: SparkSession) -> DataFrame:
    """sector (NULL for the generic targets), position, label, keywords."""
    rows = [(sector, n, label, words)
            for sector, kpis in fixed.SECTOR_KPIS.items()
            for n, (label, words) in enumerate(kpis.items())]
    rows += [(None, 100 + n, label, words)
             for n, (label, words) in enumerate(fixed.GENERIC_KPIS.items())]
    return values_table(spark, ["sector", "position", "label", "keywords"], rows)
