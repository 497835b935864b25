"""Numeric rules: guarded ratios, variance, text to number, split factors, display text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from almanac import fixed

NUMBER = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"


def ratio(numerator: Column, denominator: Column) -> Column:
    """numerator / denominator; null when either is missing or the denominator is 0."""
    return F.when(denominator != 0, numerator / denominator)


def variance(ours: Column, reference: Column) -> Column:
    """Relative difference of magnitudes; 0 for two zeros, infinite against a zero reference."""
    return (F.when(reference != 0, F.abs(F.abs(ours) - F.abs(reference)) / F.abs(reference))
             .when(ours == 0, 0.0)
             .when(ours.isNotNull() & reference.isNotNull(), float("inf")))


def to_number(text: Column) -> Column:
    """Plain decimal or scientific text as double; anything else is null."""
    trimmed = F.trim(text)
    return F.when(trimmed.rlike(NUMBER), trimmed.try_cast("double"))


def variant_number(value: Column) -> Column:
    """A JSON number (or boolean, as 1 and 0) as double; text and other kinds are null."""
    kind = F.schema_of_variant(value)
    return F.when(kind.rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL|BOOLEAN)"),
                  F.try_variant_get(value, "$", "double"))


def split_factor(eps: Column, income: Column, eps_ref: Column, income_ref: Column) -> Column:
    """Share split between a year and the reference year, from implied share counts.

    Ratios below the threshold are buybacks or issuance, not splits. Above it the factor nearest
    in log distance wins, the smaller one on a tie.
    """
    usable = ((F.coalesce(eps, F.lit(0.0)) != 0) & (F.coalesce(income, F.lit(0.0)) != 0)
              & (F.coalesce(eps_ref, F.lit(0.0)) != 0) & (F.coalesce(income_ref, F.lit(0.0)) != 0))
    shares = F.when(usable, F.abs(income / eps))
    shares_ref = F.when(usable, F.abs(income_ref / eps_ref))
    growth = F.when(shares > 0, shares_ref / shares)
    nearest = F.array_min(F.array(*[
        F.struct(F.abs(F.ln(growth / f)).alias("distance"), F.lit(f).alias("factor"))
        for f in fixed.SPLIT_FACTORS]))["factor"]
    return F.when(growth >= fixed.SPLIT_MIN_RATIO, nearest).otherwise(1)


def _grouped(value: Column, decimals: int) -> Column:
    """Thousands separators, at most ``decimals`` decimals, half away from zero, no trailing zeros."""
    text = F.format_number(F.round(value, decimals), decimals)
    if decimals == 0:
        return text
    return F.regexp_replace(F.regexp_replace(text, "0+$", ""), r"\.$", "")


def _signed(value: Column, text: Column) -> Column:
    return F.when(value < 0, F.concat(F.lit("("), text, F.lit(")"))).otherwise(text)


def money_text(value: Column) -> Column:
    """Millions, or billions from 1,000 million on; negatives in parentheses."""
    millions = F.abs(value / 1_000_000)
    text = (F.when(millions >= 1000, F.concat(_grouped(millions / 1000, 1), F.lit("B")))
             .otherwise(F.concat(_grouped(millions, 0), F.lit("M"))))
    return _signed(value, text)


def plain_text(value: Column) -> Column:
    """Up to two decimals; negatives in parentheses."""
    return _signed(value, _grouped(F.abs(value), 2))


def metric_text(name: Column, value: Column) -> Column:
    """Display text of a metric: percent for growth, margins and return, else money."""
    percent = F.concat(F.regexp_replace(F.format_number(F.round(value * 100, 1), 1), ",", ""), F.lit("%"))
    per_share = F.regexp_replace(F.format_number(F.round(value, 2), 2), ",", "")
    return (F.when(name.isin(fixed.PERCENT_METRICS), percent)
             .when(name.isin(fixed.PER_SHARE_METRICS), per_share)
             .otherwise(money_text(value)))
