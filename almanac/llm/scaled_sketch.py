"""Document fingerprints: threshold-scaled sketches of word shingles.

A text's sketch holds the hashes of all its shingles of five words (of a shorter text: of all its words)
that lie below a fixed fraction of the hash range. Whatever the sizes of two texts, both sketches hold
the same part of the range, so the share of one found in the other estimates containment, and the union
of two sketches is the sketch of both texts together. Where fewer than ``LEAST`` hashes lie below the
fraction, the bound rises until the smallest ``LEAST`` (or all) are in, so that short texts have a sketch
too; the bound is part of the sketch, and two sketches are compared below the smaller bound.

A fingerprint is the largest value its sketch would hold and then its hashes in rising order, eight
hexadecimal digits each.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from almanac.llm.common import map_arrow, saved, whole
from almanac.llm.hashing import windows, word_hashes

WORDS = 5
#: One hash in so many is kept, and the fewest of a sketch (all, if a text has fewer).
SCALE, LEAST = 16, 64
RANGE = 1 << 32

#: Digests and sketches travel as bytes, and are written as digits at the end.
_RESULT = "doc_id long, n_chars long, edited_sha256 binary, fingerprint binary, edited_fingerprint binary, near_edited double, near_next double"
_RANGED = _RESULT + ", part int, edge string, text string"


def sketch(text: bytes, scale: int = SCALE, least: int = LEAST) -> tuple[int, np.ndarray]:
    """Bound and rising hashes: every shingle hash below the bound."""
    words = text.split()
    size = min(WORDS, len(words))
    if not size:
        return RANGE, np.empty(0, np.uint32)
    hashes = (windows(word_hashes(words, len(words)), size) >> np.uint64(32)).astype(np.uint32)
    bound = RANGE // scale
    low = np.unique(hashes[hashes < bound])
    if len(low) >= least:
        return bound, low
    every = np.unique(hashes)
    if len(every) <= least:
        return RANGE, every
    return int(every[least - 1]) + 1, every[:least]


def packed(bound: int, hashes: np.ndarray) -> bytes:
    return np.append(np.uint32(bound - 1), hashes).astype(">u4").tobytes()


def written(bound: int, hashes: np.ndarray) -> str:
    return packed(bound, hashes).hex()


def read(fingerprint: str) -> tuple[int, np.ndarray]:
    values = np.frombuffer(bytes.fromhex(fingerprint), ">u4").astype(np.uint32)
    return int(values[0]) + 1, values[1:]


def merged(one: tuple[int, np.ndarray], other: tuple[int, np.ndarray]) -> tuple[int, np.ndarray]:
    """The sketch of both texts' shingles together."""
    bound = min(one[0], other[0])
    both = np.union1d(one[1], other[1])
    return bound, both[both < bound]


def containment(one: tuple[int, np.ndarray], other: tuple[int, np.ndarray]) -> float:
    """Estimated share of the shingles of ``one`` that ``other`` has too; 1 if one has none at all,
    0 if none of its hashes is below both bounds."""
    if not len(one[1]):
        return 1.0
    bound = min(one[0], other[0])
    own = one[1][one[1] < bound]
    return len(np.intersect1d(own, other[1], assume_unique=True)) / len(own) if len(own) else 0.0


def likeness(one: tuple[int, np.ndarray], other: tuple[int, np.ndarray]) -> float:
    """Containment of the sketch with fewer hashes below both bounds in the other one; of two texts
    without words 1, of one with and one without 0."""
    if not len(one[1]) or not len(other[1]):
        return float(len(one[1]) == len(other[1]))
    bound = min(one[0], other[0])
    few, many = sorted((one, other), key=lambda s: int(np.searchsorted(s[1], bound)))
    return containment(few, many)


def edited_text(text: str, following: str) -> str:
    """The last half (rounded down) of the characters replaced by as many from the start of ``following``."""
    half = len(text) // 2
    return text[:len(text) - half] + following[:half]


def _row(doc_id, text: str, own, following: str, after) -> tuple:
    edited = edited_text(text, following).encode()
    changed = sketch(edited)
    return (doc_id, len(text), hashlib.sha256(edited).digest(), packed(*own), packed(*changed),
            likeness(own, changed), likeness(own, after))


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "string": pa.string(), "binary": pa.binary()}
    parts = [p.split() for p in schema.split(", ")]
    columns = zip(*rows) if rows else [[] for _ in parts]
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, (_, k) in zip(columns, parts)], names=[n for n, _ in parts])


def _in_order(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (doc_id, text) of one range, in order: each row's result needs the row after it, so one row
    is held. The first text and the last row go on as edges, to be met by those of other ranges."""
    part, held, out, size = TaskContext.get().partitionId(), None, [], 0
    for batch in batches:
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            text = text.as_py()
            own = sketch(text.encode())
            if held:
                out.append((*_row(*held, text, own), part, None, None))
                size += len(out[-1][3]) + len(out[-1][4])
            else:
                out.append((None,) * 7 + (part, "first", text))
            held = (doc_id, text, own)
            if size > 1 << 20:
                yield _batch(out, _RANGED)
                out, size = [], 0
    if held:
        out.append((held[0], *(None,) * 6, part, "last", held[1]))
        yield _batch(out, _RANGED)


def _met(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    rows = [_row(d, t, sketch(t.encode()), f, sketch(f.encode())) for d, t, f in zip(*(c.to_pylist() for c in batch.columns))]
    yield _batch(rows, _RESULT)


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: n_chars, its fingerprint and that of its edited text, the likeness of
    its fingerprint to both that and the next row's fingerprint.

    Rows follow each other by falling doc_id, nulls last, rows of one id by a hash of their text; the
    first one follows the last one. The edited text takes the start of the next row's text for its last
    half. Null texts count as empty. A single row follows itself; an empty table gives an empty result.
    Texts are shuffled once, by ranges of ids; a range's results wait for nothing but the first text of
    the next one, which is joined to it by the number of the range.
    """
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), whole(F.col(text)).alias("text"))
    order = [F.col("doc_id").desc_nulls_last(), F.xxhash64("text")]
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    ranged = saved(ranged.mapInArrow(_in_order, _RANGED), "sketches")
    columns = [F.lower(F.hex(n)).alias(n) if kind == "binary" else F.col(n) for n, kind in (p.split() for p in _RESULT.split(", "))]
    first = ranged.where("edge = 'first'").select(F.col("part").alias("next_part"), F.col("text").alias("following"))
    last = ranged.where("edge = 'last'").select("doc_id", "text", "part")
    # one number for each range: what Spark's driver holds anyhow
    numbers = ranged.where("edge = 'first'").select("part")
    by_part = Window.orderBy("part")
    numbers = numbers.withColumn("next_part", F.coalesce(F.lead("part").over(by_part), F.first("part").over(by_part)))
    met = last.join(numbers, "part").join(first, "next_part").select("doc_id", "text", "following")
    return ranged.where("edge is null").select(*columns).unionByName(map_arrow(met, _met, _RESULT, "text").select(*columns))


def merged_by(sketches: DataFrame, key: str, fingerprint: str = "fingerprint") -> DataFrame:
    """(key, bound, hash) of the merged sketches of each key, as rows: a merged sketch of any size stays
    spread. Null fingerprints are left out; a key without hashes has no row."""
    def digits(at: Column) -> Column:
        return F.conv(F.substr(F.col("_sketch"), at * 8 + 1, F.lit(8)), 16, 10).cast("long")

    rows = sketches.select(F.col(key).alias("key"), F.col(fingerprint).alias("_sketch")).where("_sketch is not null")
    bounds = rows.groupBy("key").agg(F.min(digits(F.lit(0))).alias("bound"))
    n = (F.length("_sketch") / 8 - 1).cast("int")
    each = rows.where(n > 0).select("key", F.explode(F.sequence(F.lit(1), n)).alias("at"), "_sketch").select("key", digits(F.col("at")).alias("hash"))
    each, bounds = each.distinct(), bounds.select(F.col("key").alias("_key"), (F.col("bound") + 1).alias("bound"))
    return each.join(bounds, F.col("key").eqNullSafe(F.col("_key"))).where("hash < bound").select("key", "bound", "hash")
