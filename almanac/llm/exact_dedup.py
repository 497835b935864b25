"""Exact dedup by two passes over a Bloom filter of repeated hashes; DataFrame functions only.

Pass 1 counts how many rows fall on each cell of a filter with two cells per text; only cells hit
twice or more stay, as 64-bit words. Pass 2 looks both cells of every row up: a row with a cell hit
once is unique and passes straight through, the rest are grouped by SHA-256.

The filter has ``CELLS_PER_ROW`` cells for each row, which are counted first, so that the share of unique
rows that pass by chance stays small whatever the input. It is kept as one row for each 64 cells; filters
up to ``BROADCAST_BITS`` are broadcast (64 MB of words), wider ones joined without a hint. The size of a
filter changes no result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from almanac.llm.common import saved, whole

CELLS_PER_ROW = 16
LEAST_BITS = 1 << 12
BROADCAST_BITS = 1 << 28


def filter_bits(rows: int) -> int:
    """Cells of a filter for so many rows: a power of two."""
    return max(LEAST_BITS, 1 << max(0, CELLS_PER_ROW * rows - 1).bit_length())


def _cells(digest: Column, bits: int) -> list[Column]:
    return [F.pmod(F.xxhash64(digest, F.lit(seed)), F.lit(bits)) for seed in (1, 2)]


def _bit(cell: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), cell.bitwiseAND(F.lit(63)).cast("int"))


def repeated_words(rows: DataFrame, bits: int) -> DataFrame:
    """Pass 1: the filter's words that hold a cell hit by two rows or more (``word``, ``mask``)."""
    cells = rows.select(F.explode(F.array(*_cells(F.col("digest"), bits))).alias("cell"))
    twice = cells.groupBy("cell").agg(F.count("*").alias("n")).where("n > 1")
    return twice.groupBy(F.shiftright("cell", 6).alias("word")).agg(F.bit_or(_bit(F.col("cell"))).alias("mask"))


def member_words(keys: DataFrame, bits: int) -> DataFrame:
    """The words of a plain Bloom filter of the keys in ``digest``, for ``flag_repeated``."""
    cells = keys.select(F.explode(F.array(*_cells(F.col("digest"), bits))).alias("cell"))
    return cells.groupBy(F.shiftright("cell", 6).alias("word")).agg(F.bit_or(_bit(F.col("cell"))).alias("mask"))


def flag_repeated(rows: DataFrame, words: DataFrame, bits: int) -> DataFrame:
    """Pass 2: ``rows`` with ``maybe``, false for a text that certainly occurs once."""
    hint = F.broadcast if bits <= BROADCAST_BITS else (lambda df: df)
    maybe = F.lit(True)
    for n, cell in enumerate(_cells(F.col("digest"), bits)):
        own = words.select(F.col("word").alias(f"_word{n}"), F.col("mask").alias(f"_mask{n}"))
        rows = rows.withColumn(f"_cell{n}", cell)
        rows = rows.join(hint(own), F.shiftright(f"_cell{n}", 6) == F.col(f"_word{n}"), "left")
        hit = F.coalesce(F.col(f"_mask{n}"), F.lit(0).cast("long")).bitwiseAND(_bit(F.col(f"_cell{n}"))) != 0
        maybe = maybe & hit
    rows = rows.withColumn("maybe", maybe)
    return rows.drop(*[f"_{part}{n}" for part in ("word", "mask", "cell") for n in (0, 1)])


def maybe_among(rows: DataFrame, keys: DataFrame) -> DataFrame:
    """``rows`` with ``maybe``: whether their ``digest`` can be one of ``keys``, a stored table."""
    bits = filter_bits(keys.count())
    return flag_repeated(rows, saved(member_words(keys, bits), "filter"), bits)


def _digest(text: Column) -> Column:
    return F.unhex(F.sha2(whole(text), 256))


def _groups(maybe: DataFrame) -> DataFrame:
    """One row per text that really occurs twice: its size and the row that stays."""
    best = F.max(F.struct(F.col("doc_id").isNotNull().alias("known"), "doc_id", "row_no")).alias("best")
    return maybe.groupBy("digest").agg(F.count("*").alias("group_size"), best).where("group_size > 1")


def exact_groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", bits: int | None = None) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256.

    Null texts count as empty. The largest doc_id of equal texts stays, null ids last; of rows equal in
    both, exactly one stays. An empty table gives an empty result; other columns are not read.
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"), _digest(F.col(text)).alias("digest"),
                       F.monotonically_increasing_id().alias("row_no"))
    rows = saved(rows, "digests")
    bits = bits or filter_bits(rows.count())
    words = saved(repeated_words(rows, bits), "filter")
    flagged = flag_repeated(rows, words, bits)
    groups = saved(_groups(flagged.where("maybe")), "groups")
    sha = F.lower(F.hex("digest")).alias("text_sha256")
    alone = flagged.where("not maybe").select(
        "doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"),
        F.lit(True).alias("kept"), sha)
    found = flagged.where("maybe").join(groups, "digest", "left")
    single = F.col("best").isNull()
    return alone.unionByName(found.select(
        "doc_id", F.when(single, F.col("doc_id")).otherwise(F.col("best.doc_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"),
        (single | (F.col("best.row_no") == F.col("row_no"))).alias("kept"), sha))


def drop_copies(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", bits: int | None = None) -> DataFrame:
    """``docs`` with one row of each text, all columns kept.

    Only rows that the filter marks as possibly repeated are shuffled with their texts. Rows equal in
    doc_id and text are one row in the result.
    """
    packed = docs.select(F.struct("*").alias("row"), F.col(doc_id).alias("doc_id"),
                         _digest(F.col(text)).alias("digest"))
    rows = saved(packed.select("doc_id", "digest", F.lit(0).alias("row_no")), "digests")
    bits = bits or filter_bits(rows.count())
    words = saved(repeated_words(rows, bits), "filter")
    maybe = flag_repeated(rows, words, bits).where("maybe")
    ties = maybe.groupBy("digest", "doc_id").agg(F.count("*").alias("n"))
    best = F.max(F.struct(F.col("doc_id").isNotNull().alias("known"), "doc_id", "n")).alias("best")
    groups = ties.groupBy("digest").agg(F.sum("n").alias("size"), best).where("size > 1")
    groups = saved(groups.select("digest", F.col("best.doc_id").alias("keep_id"), F.col("best.n").alias("n")), "groups")
    flagged = flag_repeated(packed, words, bits)
    alone = flagged.where("not maybe").select("row.*")
    # both sides grow with the input: the same join at every size
    found = flagged.where("maybe").join(groups.hint("merge"), "digest", "left")
    stay = found.where(F.col("n").isNull() | F.col("doc_id").eqNullSafe(F.col("keep_id")))
    plain = stay.where("n is null or n = 1").select("row.*")
    tied = stay.where("n > 1").groupBy("digest").agg(F.first("row").alias("row")).select("row.*")
    return alone.unionByName(plain).unionByName(tied)
