"""Request usage and subscription state."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from almanac import fixed


def usage_counts(log: DataFrame) -> DataFrame:
    """Requests per key and day, and per key in total (day is null).

    The totals are summed from the counts per day, so every row of the log is counted once.
    """
    per_day = log.groupBy("key_id", F.to_date("ts").alias("day")).agg(F.count("*").alias("requests"))
    totals = per_day.groupBy("key_id").agg(F.lit(None).cast("date").alias("day"), F.sum("requests").alias("requests"))
    return per_day.unionByName(totals)


def usage_daily(log: DataFrame, keys: DataFrame, today: dt.date, days: int = 30) -> DataFrame:
    """Requests per account and day over the last days, over all keys; days without any are 0.

    The log is reduced to one row per key and day before it meets the keys.
    """
    if days < 1:
        raise ValueError("days must be at least 1")
    since = today - dt.timedelta(days=days - 1)
    per_key = (log.select("key_id", F.to_date("ts").alias("day"))
               .filter(F.col("day") >= F.lit(since))
               .groupBy("key_id", "day").agg(F.count("*").alias("n")))
    used = (per_key.join(keys.select("key_id", "account_id"), "key_id")
            .groupBy("account_id", "day").agg(F.sum("n").alias("n")))
    calendar = keys.select("account_id").distinct().select(
        "account_id", F.explode(F.sequence(F.lit(since), F.lit(today))).alias("day"))
    return calendar.join(used, ["account_id", "day"], "left") \
                   .select("account_id", "day", F.coalesce("n", F.lit(0)).alias("requests"))


def subscription_state(events: DataFrame, prices: DataFrame) -> DataFrame:
    """Current plan per account from (account_id, event_id, ts, kind, status, price_id,
    customer_id, period_end) lifecycle events.

    The latest event decides: created or updated gives the tier of the price while active or
    trialing, else free; deleted gives free and canceled. Events of other kinds are ignored. The
    customer is the last one named, the period end the one of the last created or updated event.
    """
    relevant = events.filter(F.col("kind").isin("created", "updated", "deleted"))
    when = F.struct("ts", "event_id")
    applied = F.col("kind") != "deleted"
    last = relevant.groupBy("account_id").agg(
        F.max_by(F.struct("kind", "status", "price_id", "ts"), when).alias("last"),
        F.max_by("customer_id", F.when(applied & F.col("customer_id").isNotNull(), when)).alias("customer_id"),
        F.max_by("period_end", F.when(applied, when)).alias("period_end"))
    paid = (F.col("last.kind") != "deleted") & F.col("last.status").isin(fixed.PAID_STATUSES)
    return (last.withColumn("price_id", F.col("last.price_id")).join(prices, "price_id", "left")
            .select("account_id",
                    F.when(paid, F.coalesce("tier", F.lit("free"))).otherwise("free").alias("tier"),
                    F.when(F.col("last.kind") == "deleted", "canceled")
                     .otherwise(F.col("last.status")).alias("status"),
                    "customer_id", "period_end", F.to_date("last.ts").alias("updated")))


def key_tiers(keys: DataFrame, state: DataFrame) -> DataFrame:
    """Keys with their account's tier; keys of accounts without a subscription are unchanged."""
    plan = state.select("account_id", F.col("tier").alias("plan_tier"))
    return keys.join(plan, "account_id", "left").select(
        "key_id", "account_id", F.coalesce("plan_tier", "tier").alias("tier"))
