"""Audit links into filings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from almanac import fixed


def _folder(cik: Column, accession: Column) -> Column:
    return F.concat(cik.try_cast("long").cast("string"), F.lit("/"),
                    F.regexp_replace(accession, "-", ""), F.lit("/"))


def index_url(cik: Column, accession: Column) -> Column:
    """Index page of a filing."""
    return F.concat(F.lit(fixed.ARCHIVE_URL), _folder(cik, accession))


def viewer_url(cik: Column, accession: Column, document: Column) -> Column:
    """Viewer opened on a filing's document; null when the document is unknown or blank."""
    return F.concat(F.lit(fixed.VIEWER_URL), _folder(cik, accession),
                    F.nullif(document, F.lit("")))


def audit_url(cik: Column, accession: Column, document: Column) -> Column:
    """The viewer where the document is known, else the filing's index page."""
    return F.coalesce(viewer_url(cik, accession, document), index_url(cik, accession))
