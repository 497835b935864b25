"""Company names, sectors and identifiers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from almanac import fixed


def name_tokens(name: Column) -> Column:
    """Distinct lower-case words of a name without the generic ones."""
    words = F.split(F.regexp_replace(F.lower(F.coalesce(name, F.lit(""))), r"[^\p{L}\p{N}]+", " "), " ")
    generic = F.array(*[F.lit(t) for t in fixed.GENERIC_NAME_TOKENS])
    return F.array_except(words, F.array_append(generic, F.lit("")))


def names_agree(a: Column, b: Column) -> Column:
    """True when two names share a distinctive word, or either has none."""
    left, right = name_tokens(a), name_tokens(b)
    return F.arrays_overlap(left, right) | (F.size(left) == 0) | (F.size(right) == 0)


def sector_name(source_name: Column) -> Column:
    """Our name of a second-source sector; unmapped names stay, empty ones become null."""
    renamed = None
    targets: dict[str, list[str]] = {}
    for theirs, ours in fixed.SECTOR_NAMES.items():
        targets.setdefault(ours, []).append(theirs)
    for ours, theirs in targets.items():
        test = source_name.isin(theirs)
        renamed = F.when(test, ours) if renamed is None else renamed.when(test, ours)
    return renamed.otherwise(F.nullif(source_name, F.lit("")))


def padded_cik(number: Column) -> Column:
    return F.lpad(number.cast("string"), 10, "0")


def cik_from_url(url: Column) -> Column:
    """The company number inside an audit link, from its path or its query."""
    path = F.nullif(F.regexp_extract(url, fixed.NUMBER_IN_PATH, 1), F.lit(""))
    query = F.nullif(F.regexp_extract(url, fixed.NUMBER_IN_QUERY, 1), F.lit(""))
    return F.coalesce(path, query).try_cast("long")


def plain_symbol(ticker: Column) -> Column:
    """False for units, warrants and dual-class symbols."""
    return ~ticker.rlike("[-.]")


def second_source_ticker(ticker: Column) -> Column:
    """The ticker that the second source lists a company of ours under."""
    other = F.create_map(*[F.lit(x) for pair in fixed.SECOND_SOURCE_TICKERS.items() for x in pair])
    return F.coalesce(F.try_element_at(other, F.upper(ticker)), F.upper(ticker))
