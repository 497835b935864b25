"""Similarity join on word n-grams: MinHash banding, shuffle on band hashes, exact check on full sets.

Equal texts are one class from the start. A class lands in one bucket per band; buckets that hold the
same classes as another are left out, and so are those with one class. Buckets are cut into tiles of
about ``TILE`` classes or ``TILE_GRAMS`` n-grams a side, every pair of tiles is a group of rows of its own, and a pair of classes
is looked at only in the first bucket it shares. Tasks emit one row per class and tile: how many others
it links to, and the smallest class it is connected with. Pairs are never rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from almanac.llm.common import map_arrow, saved, whole
from almanac.llm.components import components
from almanac.llm.exact_dedup import maybe_among
from almanac.llm.hashing import mix, texts_of, windows, word_hashes

SHINGLE_WORDS = 5
THRESHOLD = 0.8
RECALL = 0.9999
MAX_HASHES = 128
TILE, TILE_GRAMS = 512, 2_000_000
#: Columns of the incidence matrix that are multiplied at once.
BLOCK = 4096


def choose_bands(threshold: float = THRESHOLD, recall: float = RECALL, max_hashes: int = MAX_HASHES) -> tuple[int, int]:
    """(bands, rows): the most rows, so the fewest needless candidates, with which a pair at the
    threshold shares a band with probability ``recall`` using at most ``max_hashes`` hashes."""
    best = None
    for rows in range(1, max_hashes + 1):
        same = threshold**rows
        if same < 1e-9:
            break
        bands = 1 if same >= 1 else int(np.ceil(np.log1p(-recall) / np.log1p(-same)))
        if bands * rows <= max_hashes:
            best = (max(1, bands), rows)
    if best is None:
        raise ValueError("max_hashes is too small for this recall")
    return best


def shingles(hashes: np.ndarray, size: int) -> np.ndarray:
    """n-grams of a document by its word hashes; a shorter document is one n-gram, an empty one has none."""
    return windows(hashes, min(size, len(hashes))) if len(hashes) else hashes


def _signatures(batch: pa.RecordBatch, size: int, bands: int, rows: int) -> Iterator[pa.RecordBatch]:
    parts = []
    for text in texts_of(batch, 3):
        words = text.split()
        parts.append(shingles(word_hashes(words, len(words)), size))
    sizes = np.array([len(p) for p in parts])
    flat, full = np.concatenate(parts), np.flatnonzero(sizes)
    starts = (np.cumsum(sizes) - sizes)[full]
    values = np.zeros((len(full), bands), np.uint64)
    if len(full):
        draw = np.random.default_rng(7)
        for band in range(bands):
            key = np.full(len(full), band, np.uint64)
            for _ in range(rows):
                a, b = draw.integers(1 << 63, size=2, dtype=np.uint64)
                low = np.minimum.reduceat(flat * (a | np.uint64(1)) + b, starts)
                key = mix(key * np.uint64(31) + low)
            values[:, band] = key
    counts = np.zeros(len(sizes), np.int32)
    counts[full] = bands
    offsets = pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32))
    lists = pa.ListArray.from_arrays(offsets, pa.array(values.view(np.int64).ravel()))
    yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), lists, pa.array(sizes, pa.int64())],
                                     names=["doc_id", "row_no", "digest", "bands", "n_grams"])


def _sets(batch: pa.RecordBatch, size: int) -> Iterator[pa.RecordBatch]:
    packed = []
    for text in texts_of(batch, 1):
        words = text.split()
        packed.append(np.unique(shingles(word_hashes(words, len(words)), size)).tobytes())
    yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(packed, pa.binary())], names=["node", "grams"])


def _links(grams: list[np.ndarray], buckets: list[np.ndarray], bucket: int, split: int | None, threshold: Fraction) -> np.ndarray:
    """Matrix of linked pairs among classes, of which the first ``split`` are the one side of the tile
    (None: both sides are the same)."""
    n = len(grams)
    pairs = np.triu(np.ones((n, n), bool), 1)
    if split is not None:
        pairs[:split, :split] = pairs[split:, split:] = False
    sizes = np.array([len(g) for g in grams])
    small, large = np.minimum.outer(sizes, sizes), np.maximum.outer(sizes, sizes)
    pairs &= small * threshold.denominator >= large * threshold.numerator
    earlier = [b[b < bucket] for b in buckets]  # a pair belongs to the first bucket it shares
    if any(map(len, earlier)):
        keys, which = np.unique(np.concatenate(earlier), return_inverse=True)
        member = np.zeros((n, len(keys)), np.float32)
        member[np.repeat(np.arange(n), [len(e) for e in earlier]), which] = 1
        pairs &= member @ member.T == 0
    if not pairs.any():
        return pairs
    flat, owner = np.concatenate(grams), np.repeat(np.arange(n), sizes)
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    fresh = np.concatenate([[True], flat[1:] != flat[:-1]])
    column = np.cumsum(fresh) - 1
    shared = np.bincount(column)[column] > 1
    column, owner = column[shared], owner[shared]
    common = np.zeros((n, n), np.float32)
    if len(column):
        column = np.cumsum(np.concatenate([[0], column[1:] != column[:-1]]))
        cuts = np.searchsorted(column, np.arange(0, column[-1] + BLOCK + 1, BLOCK))
        for at, (low, high) in enumerate(zip(cuts[:-1], cuts[1:])):
            if high > low:
                block = np.zeros((n, BLOCK), np.float32)
                block[owner[low:high], column[low:high] - at * BLOCK] = 1
                common += block @ block.T
    common = common.astype(np.int64)
    union = sizes[:, None] + sizes[None, :] - common
    return pairs & (common * threshold.denominator >= union * threshold.numerator)


def _roots(links: np.ndarray) -> np.ndarray:
    """Smallest connected index of each index."""
    n = len(links)
    near, label = links | links.T | np.eye(n, dtype=bool), np.arange(n)
    while True:
        new = np.where(near, label[None, :], n).min(axis=1)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _tile(rows: list[tuple], threshold: Fraction) -> list[tuple]:
    seen: dict[int, tuple] = {}
    for bucket, left, right, side, node, buckets, grams in rows:
        seen.setdefault(node, (side, node, buckets, grams))
    own = sorted(seen.values(), key=lambda r: (r[0] != left, r[1]))
    if len(own) < 2:
        return []
    split = sum(r[0] == left for r in own) if left != right else None
    links = _links([np.frombuffer(r[3], np.uint64) for r in own], [np.array(r[2], np.int64) for r in own], bucket, split, threshold)
    degree = links.sum(axis=0) + links.sum(axis=1)
    nodes = np.array([r[1] for r in own])
    roots = _roots(links)
    low = np.full(len(nodes), np.iinfo(np.int64).max)
    np.minimum.at(low, roots, nodes)
    hit = np.flatnonzero(degree)
    return list(zip(nodes[hit].tolist(), low[roots[hit]].tolist(), degree[hit].tolist()))


def _tiles(batches: Iterator[pa.RecordBatch], threshold: Fraction) -> Iterator[pa.RecordBatch]:
    """Groups of rows with one (bucket, left, right), in which the partition is sorted."""
    def emit(found):
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found)], names=["node", "root", "links"])

    key, group, found = None, [], []
    for batch in batches:
        for row in zip(*[c.to_pylist() for c in batch.columns]):
            if row[:3] != key:
                found += _tile(group, threshold)
                key, group = row[:3], []
                if len(found) > 20_000:
                    yield emit(found)
                    found = []
            group.append(row)
    found += _tile(group, threshold)
    if found:
        yield emit(found)


def _classes(docs: DataFrame, doc_id: str, text: str, size: int, bands: int, rows: int) -> tuple[DataFrame, DataFrame]:
    """Rows with the digest of their text, and one row per different text."""
    body = whole(F.col(text))
    source = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.monotonically_increasing_id().alias("row_no"),
                         F.unhex(F.sha2(body, 256)).alias("digest"), body.alias("text"))
    work = partial(_signatures, size=size, bands=bands, rows=rows)
    found = saved(map_arrow(source, work, "doc_id long, row_no long, digest binary, bands array<long>, n_grams long", "text"), "signatures")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("unknown"), "doc_id", "row_no")).alias("first")
    classes = found.groupBy("digest").agg(first, F.first("bands").alias("bands"), F.max("n_grams").alias("n_grams")).select(
        "digest", F.col("first.doc_id").alias("class_id"), F.col("first.row_no").alias("node"), "bands", "n_grams")
    return found.select("doc_id", "row_no", "digest"), saved(classes, "classes")


def _members(classes: DataFrame) -> DataFrame:
    """(bucket, n, grams, node, buckets) for the buckets worth looking at."""
    dealt = classes.select("node", "n_grams", F.explode("bands").alias("bucket"))
    sizes = dealt.groupBy("bucket").agg(
        F.count("*").alias("n"), F.sum("n_grams").alias("grams"), F.min("node").alias("low"), F.max("node").alias("high"),
        F.bit_xor(F.xxhash64("node")).alias("mark")).where("n > 1")
    kept = saved(sizes.groupBy("n", "grams", "low", "high", "mark").agg(F.min("bucket").alias("bucket")).select("bucket", "n", "grams"), "buckets")
    members = saved(dealt.drop("n_grams").join(kept, "bucket"), "members")
    lists = members.groupBy("node").agg(F.sort_array(F.collect_set("bucket")).alias("buckets"))
    return members.join(lists, "node")


def links(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = SHINGLE_WORDS,
          threshold: float = THRESHOLD, recall: float = RECALL, max_hashes: int = MAX_HASHES,
          tile: int = TILE, tile_grams: int = TILE_GRAMS) -> tuple[DataFrame, DataFrame]:
    """Rows of ``docs`` (doc_id, row_no, digest), and one row per different text (digest, class_id, node,
    n_links, label): how many other texts it is similar to, and the smallest node of its group."""
    bands, rows = choose_bands(threshold, recall, max_hashes)
    found, classes = _classes(docs, doc_id, text, size, bands, rows)
    members = _members(classes)
    # a side of few long texts is cut by what they hold; one text longer than a side stands alone
    blocks = F.greatest(F.ceil(F.col("n") / tile), F.least(F.ceil(F.col("grams") / tile_grams), F.col("n")))
    members = saved(members.withColumn("blocks", blocks).withColumn(
        "side", F.pmod(F.xxhash64("node", "bucket"), F.col("blocks"))), "members")
    wanted = saved(members.select("node").distinct().join(classes.select("node", "digest", "class_id"), "node"), "wanted")
    body = whole(F.col(text))
    source = docs.select(F.col(doc_id).cast("long").alias("_id"), F.unhex(F.sha2(body, 256)).alias("digest"), body.alias("_text"))
    # only texts that a filter of the wanted ones lets through are shuffled
    source = maybe_among(source, wanted).where("maybe")
    texts = source.join(wanted.hint("merge"), (source["digest"] == wanted["digest"]) & F.col("_id").eqNullSafe(F.col("class_id")))
    sets = saved(map_arrow(texts.select("node", F.col("_text").alias("text")), partial(_sets, size=size),
                           "node long, grams binary", "text"), "sets")
    spread = members.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    spread = spread.select("node", "bucket", F.least("side", "other").alias("left"),
                           F.greatest("side", "other").alias("right"), "side", "buckets")
    tiles = spread.join(sets, "node").select("bucket", "left", "right", "side", "node", "buckets", "grams")
    tiles = tiles.repartition("bucket", "left", "right").sortWithinPartitions("bucket", "left", "right")
    exact = Fraction(str(threshold))
    counted = saved(tiles.mapInArrow(partial(_tiles, threshold=exact), "node long, root long, links long"), "links")
    degrees = counted.groupBy("node").agg(F.sum("links").alias("n_links"))
    labels = components(counted.where("node != root").select(F.col("node").alias("a"), F.col("root").alias("b")))
    classes = classes.select("digest", "class_id", "node").join(degrees, "node", "left").join(labels, "node", "left")
    return found, saved(classes.select("digest", "class_id", "node", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"),
                                       F.coalesce("label", "node").alias("label")), "groups")


def similar_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """One row per row of ``docs``: doc_id, class_id, n_links, group_id.

    ``class_id`` is the smallest doc_id with the same text, ``n_links`` the number of other texts whose
    word n-grams have at least the threshold's Jaccard similarity, ``group_id`` the smallest class of all
    texts connected by such links. Null texts count as empty; empty texts are one class without links.
    Null ids come last. N-grams are compared by 64-bit hashes.
    """
    found, classes = links(docs, doc_id, text, **options)
    ids = classes.groupBy("label").agg(F.min("class_id").alias("group_id"))
    classes = saved(classes.join(ids, "label").select("digest", "class_id", "n_links", "group_id"), "classes")
    return found.join(classes, "digest").select("doc_id", "class_id", "n_links", "group_id")


def drop_similar(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """``docs`` with one document of each group of similar texts, that with the smallest doc_id; all
    columns kept. Rows equal in doc_id and text are one row in the result."""
    found, classes = links(docs, doc_id, text, **options)
    first = classes.groupBy("label").agg(F.min(F.struct(F.col("class_id").isNull().alias("unknown"), "class_id", "node")).alias("first"))
    stays = classes.join(first, "label").where("node = first.node").select("digest", "class_id")
    stays = saved(stays, "stays")
    rows = found.groupBy("doc_id", "digest").agg(F.count("*").alias("n"))
    rows = rows.join(stays.withColumn("kept", F.lit(True)), "digest", "left")
    kept = F.coalesce(F.col("kept") & F.col("doc_id").eqNullSafe(F.col("class_id")), F.lit(False))
    odd = saved(rows.select("digest", F.col("doc_id").alias("_odd_id"), "n", kept.alias("kept")).where("not kept or n > 1"), "dropped")
    packed = docs.select(F.struct("*").alias("row"), F.col(doc_id).cast("long").alias("_id"),
                         F.unhex(F.sha2(whole(F.col(text)), 256)).alias("digest"))
    packed = maybe_among(packed, odd)
    found = packed.where("maybe")
    joined = found.join(odd.hint("merge"), (found["digest"] == odd["digest"]) & F.col("_id").eqNullSafe(F.col("_odd_id")), "left")
    joined = joined.select("row", "_id", found["digest"].alias("_digest"), "n", "kept")
    plain = joined.where("n is null").select("row.*")
    tied = joined.where("kept").groupBy("_digest", "_id").agg(F.first("row").alias("row")).select("row.*")
    return packed.where("not maybe").select("row.*").unionByName(plain).unionByName(tied)
