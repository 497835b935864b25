"""Filing documents to plain text."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from almanac.functions import text


def filing_text(pages: DataFrame, html: str = "html") -> DataFrame:
    """Replaces the HTML column by its visible text; no shuffle, no Python."""
    return pages.withColumn("text", text.html_to_text(F.col(html))).drop(html)
