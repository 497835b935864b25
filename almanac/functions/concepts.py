"""Lookups on raw tags and canonical concepts, as hashed IN lists instead of joins."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from almanac import fixed


def tag_priority(tag: Column) -> Column:
    """Rank of a raw tag inside its concept; tags outside the table rank last."""
    levels: dict[int, list[str]] = {}
    for _, _, names in fixed.CONCEPTS:
        for rank, name in enumerate(names):
            levels.setdefault(rank, []).append(name)
    result = None
    for rank in sorted(levels):
        test = tag.isin(levels[rank])
        result = F.when(test, rank) if result is None else result.when(test, rank)
    return result.otherwise(fixed.UNKNOWN_TAG_PRIORITY)


def is_flow(concept: Column) -> Column:
    """True for concepts measured over a span (a flow), false for balances."""
    return concept.isin([name for name, flow, _ in fixed.CONCEPTS if flow])


def is_known(concept: Column) -> Column:
    return concept.isin([name for name, _, _ in fixed.CONCEPTS])
