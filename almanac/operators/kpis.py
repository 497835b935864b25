"""Validation, dedupe and append of extracted KPI records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from almanac.functions.numbers import to_number, variant_number
from almanac.functions.text import strip
from almanac.sources.store import first_by

STORED_KEY = ["company_id", "name", "period", "accession_number"]


def validate(records: DataFrame, raw: str = "record") -> DataFrame:
    """Well-formed records of a JSON column; the other columns pass through.

    Name, value text, period and quote must not be blank. A text value loses its commas and
    becomes a number if it is one; every other kind that is not numeric becomes null.
    """
    parsed = records.withColumn("_v", F.try_parse_json(raw)) \
                    .filter(F.schema_of_variant("_v").startswith("OBJECT"))

    def text(field: str) -> Column:
        return strip(F.coalesce(F.try_variant_get("_v", f"$.{field}", "string"), F.lit("")))

    value = F.try_variant_get("_v", "$.value", "variant")
    number = F.when(F.schema_of_variant(value) == "STRING",
                    to_number(F.replace(F.try_variant_get(value, "$", "string"), F.lit(","), F.lit("")))) \
        .otherwise(variant_number(value))
    others = [c for c in records.columns if c != raw]
    fields = parsed.select(*others, text("name").alias("name"), number.alias("value"),
                           text("value_text").alias("value_text"), text("unit").alias("unit"),
                           text("period").alias("period"), text("quote").alias("quote"))
    return fields.filter((F.col("name") != "") & (F.col("value_text") != "")
                         & (F.col("period") != "") & (F.col("quote") != ""))


def first_found(records: DataFrame, order: list[Column | str]) -> DataFrame:
    """The first record per filing, name and period, both compared without case."""
    keyed = records.withColumn("_name", F.lower("name")).withColumn("_period", F.lower("period"))
    return first_by(keyed, ["company_id", "accession_number", "_name", "_period"], order) \
        .drop("_name", "_period")


def new_kpis(records: DataFrame, stored: DataFrame, order: list[Column | str]) -> DataFrame:
    """Records to append: first found, not stored yet."""
    fresh = first_found(records, order).join(stored.select(*STORED_KEY), STORED_KEY, "left_anti")
    return fresh.withColumnRenamed("quote", "source_quote")
