"""Substring dedup: words inside windows that occur anywhere else are removed.

Consecutive windows of a text that share one occurrence of their minimiser (the leftmost smallest hash
of a run of ``MINI_WORDS`` words inside the window) form a super-k-mer, one packed string. Equal windows
have equal minimisers at different places, so no super-k-mer repeats a window of its own, and only those
with a minimiser found twice can hold a repeat:

1. super-k-mers are counted by minimiser, and those whose minimiser is alone leave;
2. equal super-k-mers are counted before they meet; all windows of one found twice are repeats;
3. different super-k-mers with one minimiser travel to its bucket as packed strings, one for each
   different string, where their windows are sorted and neighbours compared;
4. minimisers with more than ``BUCKET_STRINGS`` different strings have no bucket: their windows are
   counted as rows, which partial aggregation and skew joins spread.

The texts themselves are read again by (doc_id, hash of the text), which is also how rows are told apart;
rows equal in both have the same windows and the same result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from almanac.llm.common import map_arrow, saved
from almanac.llm.exact_dedup import maybe_among
from almanac.llm.hashing import texts_of, windows, word_hashes

WINDOW_WORDS = 35
MINI_WORDS = 8
BUCKET_STRINGS = 1000

_KMERS = "doc_id long, text_key long, mini long, digest binary, start int, n int, times int"
_PACKED = "doc_id long, text_key long, mini long, single boolean, start int, packed binary, large boolean"
_SPANS = "doc_id long, text_key long, low int, high int"


def _digest(words: list[bytes]) -> bytes:
    return hashlib.blake2b(b" ".join(words), digest_size=16).digest()


def _leftmost_min(values: np.ndarray, width: int) -> np.ndarray:
    """Place of the leftmost smallest value of each run of ``width`` values."""
    have, place = 1, np.arange(len(values))
    while have < width:
        step = min(have, width - have)
        left, right = place[:len(place) - step], place[step:]
        place = np.where(values[left] <= values[right], left, right)
        have += step
    return place


def runs(hashes: np.ndarray, sizes: np.ndarray, window: int, mini: int) -> tuple[np.ndarray, ...]:
    """Super-k-mers of documents laid end to end: position of the first word, number of windows, minimiser."""
    none = np.zeros(0, np.int64)
    if len(hashes) < window:
        return none, none, none.astype(np.uint64)
    grams = windows(hashes, mini)
    place = _leftmost_min(grams, window - mini + 1)
    ends = np.repeat(np.cumsum(sizes), sizes)
    valid = (ends - np.arange(len(hashes)))[:len(place)] >= window
    before = np.concatenate([[False], valid[:-1]])
    starts = np.flatnonzero(valid & (~before | np.concatenate([[True], place[1:] != place[:-1]])))
    spots = np.flatnonzero(valid)
    number = np.diff(np.append(np.searchsorted(spots, starts), len(spots)))
    return starts, number, grams[place[starts]]


def _super_kmers(batch: pa.RecordBatch, window: int, mini: int) -> Iterator[pa.RecordBatch]:
    words, sizes = [], []
    for text in texts_of(batch, 2):
        own = text.split()
        words += own
        sizes.append(len(own))
    sizes = np.array(sizes)
    starts, number, low = runs(word_hashes(words, len(words)), sizes, window, mini)
    doc = np.searchsorted(np.cumsum(sizes), starts, side="right")
    digests = [_digest(words[s:e]) for s, e in zip(starts.tolist(), (starts + number + window - 1).tolist())]
    # a phrase repeated over and over gives equal neighbours: one row with how many
    same = (low[1:] == low[:-1]) & (doc[1:] == doc[:-1]) & (number[1:] == number[:-1]) & (starts[1:] == starts[:-1] + number[:-1])
    same = np.array([False] + [bool(s) and digests[i] == digests[i + 1] for i, s in enumerate(same.tolist())], bool)[:len(starts)]
    first = np.flatnonzero(~same)
    times = np.diff(np.append(first, len(starts)))
    starts, number, low, doc, digests = starts[first], number[first], low[first], doc[first], [digests[i] for i in first.tolist()]
    which = pa.array(doc)
    yield pa.RecordBatch.from_arrays(
        [batch.column(0).take(which), batch.column(1).take(which), pa.array(low.view(np.int64)), pa.array(digests, pa.binary()),
         pa.array((starts - (np.cumsum(sizes) - sizes)[doc]).astype(np.int32)), pa.array(number.astype(np.int32)),
         pa.array(times.astype(np.int32))], names=["doc_id", "text_key", "mini", "digest", "start", "n", "times"])


def _cut(batch: pa.RecordBatch, window: int) -> Iterator[pa.RecordBatch]:
    """Packed strings of the super-k-mers that the texts' lists name."""
    out: list[list] = [[] for _ in range(7)]
    rows = zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), texts_of(batch, 2), batch.column(3).to_pylist())
    for doc_id, key, text, wanted in rows:
        words = text.split()
        for own in wanted:
            start = own["start"]
            row = (doc_id, key, own["mini"], own["single"], start, b" ".join(words[start:start + own["n"] + window - 1]), own["large"])
            for column, value in zip(out, row):
                column.append(value)
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.int32(), pa.binary(), pa.bool_()]
    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)],
                                     names=["doc_id", "text_key", "mini", "single", "start", "packed", "large"])


def _bucket(rows: list[tuple], window: int) -> list[tuple]:
    """Spans of the windows of single strings that occur twice among the windows of all strings."""
    strings = {row[5]: row for row in rows}  # rows of one text may come twice
    listed = []
    for n, packed in enumerate(strings):
        words = packed.split(b" ")
        ends = np.cumsum([len(w) + 1 for w in words]) - 1
        for i in range(len(words) - window + 1):
            low = int(ends[i - 1]) + 1 if i else 0
            listed.append((packed[low:int(ends[i + window - 1])], n, i))
    listed.sort()
    repeated = [a[0] == b[0] for a, b in zip(listed, listed[1:])]
    hits: dict[int, list[int]] = {}
    for at, (_, n, i) in enumerate(listed):
        if (at and repeated[at - 1]) or (at < len(repeated) and repeated[at]):
            hits.setdefault(n, []).append(i)
    spans, own = [], list(strings.values())
    for n, places in hits.items():
        doc_id, key, _, single, start, _ = own[n]
        if not single:
            continue
        places = np.sort(places)
        breaks = np.flatnonzero(np.diff(places) > 1)
        for low, high in zip(places[np.append(0, breaks + 1)], places[np.append(breaks, len(places) - 1)]):
            spans.append((doc_id, key, start + int(low), start + int(high) + window))
    return spans


def _buckets(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    """Groups of rows with one minimiser, by which the partition is sorted."""
    def emit(spans):
        kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*spans), kinds)],
                                          names=["doc_id", "text_key", "low", "high"])

    mini, group, spans = None, [], []
    for batch in batches:
        for row in zip(*[c.to_pylist() for c in batch.columns]):
            if row[2] != mini:
                if len(group) > 1:
                    spans += _bucket(group, window)
                mini, group = row[2], []
                if len(spans) > 20_000:
                    yield emit(spans)
                    spans = []
            group.append(row)
    if len(group) > 1:
        spans += _bucket(group, window)
    if spans:
        yield emit(spans)


def _windows(batch: pa.RecordBatch, window: int) -> Iterator[pa.RecordBatch]:
    """The windows of packed strings, one row each."""
    which, digests, starts = [], [], []
    begins = batch.column(4).to_pylist()
    for n, packed in enumerate(batch.column(5).to_pylist()):
        words = packed.split(b" ")
        for i in range(len(words) - window + 1):
            which.append(n)
            digests.append(_digest(words[i:i + window]))
            starts.append(begins[n] + i)
    take = pa.array(which, pa.int64())
    yield pa.RecordBatch.from_arrays(
        [batch.column(0).take(take), batch.column(1).take(take), batch.column(3).take(take), pa.array(digests, pa.binary()),
         pa.array(starts, pa.int32())], names=["doc_id", "text_key", "single", "digest", "start"])


def _keyed(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    body = F.col(text).cast("string")
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.xxhash64(body).alias("text_key"), body.alias("text"))


def _same(a: DataFrame, b: DataFrame) -> Column:
    return a["doc_id"].eqNullSafe(b["doc_id"]) & (a["text_key"] == b["text_key"])


def _maybe(rows: DataFrame, keys: DataFrame) -> DataFrame:
    """``rows`` with ``maybe``: whether their text_key can be among those of ``keys``."""
    return maybe_among(rows.withColumn("digest", F.col("text_key")), keys.select(F.col("text_key").alias("digest"))).drop("digest")


def repeated_spans(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", window: int = WINDOW_WORDS,
                   mini: int = MINI_WORDS, bucket_strings: int = BUCKET_STRINGS) -> DataFrame:
    """(doc_id, text_key, low, high): words low to high - 1 lie in windows that occur elsewhere."""
    source = _keyed(docs, doc_id, text)
    work = partial(_super_kmers, window=window, mini=mini)
    kmers = saved(map_arrow(source.where("text is not null"), work, _KMERS, "text"), "kmers")
    # counts are stored before they are joined, so that a minimiser of very many rows is split over tasks
    twice = saved(kmers.groupBy("mini").agg(F.sum("times").alias("_n")).where("_n > 1").select("mini"), "twice")
    found = saved(kmers.join(twice, "mini", "left_semi"), "shared")
    first = F.min(F.struct("doc_id", "text_key", "start", "n")).alias("first")
    strings = saved(found.groupBy("mini", "digest").agg(F.sum("times").alias("copies"), first), "strings")
    copied = found.join(strings.where("copies > 1").select("mini", "digest"), ["mini", "digest"], "left_semi")
    copied = copied.select("doc_id", "text_key", F.col("start").alias("low"), (F.col("start") + F.col("n") * F.col("times") + (window - 1)).alias("high"))
    mixed = strings.groupBy("mini").agg(F.count("*").alias("strings"), F.min("copies").alias("least"))
    mixed = saved(mixed.where("strings > 1 and least = 1").select("mini", (F.col("strings") > bucket_strings).alias("large")), "mixed")
    wanted = strings.join(mixed, "mini").select(
        F.col("first.doc_id").alias("doc_id"), F.col("first.text_key").alias("text_key"),
        F.struct(F.col("first.start").alias("start"), F.col("first.n").alias("n"), "mini",
                 (F.col("copies") == 1).alias("single"), "large").alias("own"))
    wanted = wanted.groupBy("doc_id", "text_key").agg(F.collect_list("own").alias("wanted"))
    wanted = saved(wanted, "wanted")
    # only texts that a filter of the wanted ones lets through are shuffled
    near = _maybe(source, wanted).where("maybe").drop("maybe")
    texts = near.join(wanted.hint("merge"), _same(near, wanted)).select(near["doc_id"], near["text_key"], "text", "wanted")
    texts = saved(map_arrow(texts, partial(_cut, window=window), _PACKED, "text"), "packed")
    # no join below: Spark would take its exchange for this one, and may then split or localise it
    dealt = texts.where("not large").drop("large").repartition("mini").sortWithinPartitions("mini")
    compared = dealt.mapInArrow(partial(_buckets, window=window), _SPANS)
    rows = saved(map_arrow(texts.where("large"), partial(_windows, window=window),
                           "doc_id long, text_key long, single boolean, digest binary, start int", "packed"), "windows")
    again = saved(rows.groupBy("digest").agg(F.count("*").alias("_n")).where("_n > 1").select("digest"), "again")
    counted = rows.where("single").join(again, "digest", "left_semi").select(
        "doc_id", "text_key", F.col("start").alias("low"), (F.col("start") + window).alias("high"))
    return saved(copied.unionByName(compared).unionByName(counted), "spans")


def _kept(words: list[bytes], spans) -> tuple[list[bytes], int]:
    change = np.zeros(len(words) + 1, np.int32)
    np.add.at(change, [s["low"] for s in spans], 1)
    np.add.at(change, [s["high"] for s in spans], -1)
    keep = np.cumsum(change[:-1]) == 0
    return [words[i] for i in np.flatnonzero(keep).tolist()], int(len(words) - keep.sum())


def _reports(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    n_words, n_removed, digests = [], [], []
    for text, spans in zip(texts_of(batch, 1), batch.column(2).to_pylist()):
        words = text.split()
        kept, removed = _kept(words, spans) if spans else (words, 0)
        n_words.append(len(words))
        n_removed.append(removed)
        digests.append(hashlib.sha256(b" ".join(kept)).hexdigest())
    yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(digests)],
                                     names=["doc_id", "n_words", "n_removed", "kept_sha256"])


def _shortened(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    texts = []
    for text, spans in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
        texts.append(b" ".join(_kept(text.encode().split(), spans)[0]).decode() if spans else text)
    yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["row", "text"])


def _with_spans(keyed: DataFrame, spans: DataFrame) -> DataFrame:
    lists = saved(spans.distinct().groupBy("doc_id", "text_key").agg(F.collect_list(F.struct("low", "high")).alias("spans")), "lists")
    flagged = _maybe(keyed, lists)
    near = flagged.where("maybe").drop("maybe")
    found = near.join(lists.hint("merge"), _same(near, lists), "left").select(*[near[c] for c in keyed.columns], "spans")
    alone = flagged.where("not maybe").select(*keyed.columns, F.lit(None).cast(lists.schema["spans"].dataType).alias("spans"))
    return alone.unionByName(found)


def report(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", window: int = WINDOW_WORDS, **options) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, n_removed, kept_sha256 (kept words joined by a space).

    Null texts have no words. Texts shorter than a window lose nothing. Of rows with equal texts of a
    window or more, all words go, in each of them.
    """
    spans = repeated_spans(docs, doc_id, text, window, **options)
    joined = _with_spans(_keyed(docs, doc_id, text), spans).select("doc_id", "text", "spans")
    return map_arrow(joined, _reports, "doc_id long, n_words long, n_removed long, kept_sha256 string", "text")


def remove_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", window: int = WINDOW_WORDS, **options) -> DataFrame:
    """``docs`` with the repeated words taken out of ``text``; all rows and columns stay.

    Where nothing is removed the text is unchanged, else it is the kept words joined by a space.
    """
    spans = repeated_spans(docs, doc_id, text, window, **options)
    rest = [c for c in docs.columns if c != text]
    body = F.col(text).cast("string")
    keyed = docs.select(F.struct(*rest).alias("row") if rest else F.lit(None).alias("row"), F.col(doc_id).cast("long").alias("doc_id"),
                        F.xxhash64(body).alias("text_key"), body.alias("text"))
    schema = T.StructType([T.StructField("row", keyed.schema["row"].dataType), T.StructField("text", T.StringType())])
    done = map_arrow(_with_spans(keyed, spans).select("row", "text", "spans"), _shortened, schema, "text")
    return done.select(*[F.col("text").alias(text) if c == text else F.col(f"row.`{c}`") for c in docs.columns])
