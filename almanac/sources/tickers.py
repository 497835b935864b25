"""The listed-companies map."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from almanac.functions import names

LISTING = "map<string, struct<cik_str: long, ticker: string, title: string>>"


def listings(payloads: DataFrame) -> DataFrame:
    """shard, position, cik, ticker (upper case) and title of (shard, payload) in listed order."""
    return (payloads
            .select("shard", F.posexplode(F.from_json("payload", LISTING)).alias("position", "n", "row"))
            .select("shard", "position", F.col("row.cik_str").alias("cik_number"),
                    names.padded_cik(F.col("row.cik_str")).alias("cik"),
                    F.upper("row.ticker").alias("ticker"), F.col("row.title").alias("title")))


def _position() -> Column:
    return F.struct("shard", "position")


def cik_by_ticker(listed: DataFrame) -> DataFrame:
    """ticker -> cik, title; the last listed row of a ticker wins."""
    last = F.max_by(F.struct("cik_number", "cik", "title"), _position()).alias("last")
    return listed.groupBy("ticker").agg(last).select("ticker", "last.*")


def ticker_by_cik(listed: DataFrame) -> DataFrame:
    """cik -> ticker, title; the first listed ticker of a company is its primary one."""
    first = F.min_by(F.struct("ticker", "title"), _position()).alias("first")
    return listed.groupBy("cik_number", "cik").agg(first).select("cik_number", "cik", "first.*")
