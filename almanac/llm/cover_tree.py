"""Hard negatives by maximum inner product, over cover trees of norm-augmented candidates.

Every candidate x gets one more component, sqrt(M^2 - |x|^2) with M the largest norm, so that all have
the same length and the largest inner product with an anchor (whose own extra component is 0) is the
nearest neighbour. A node of a cover tree is one of its own points and the radius that covers all points
below it; an anchor's product with any of them differs from its product with the node's point by at
most the anchor's norm times the radius. The search opens the node with the highest bound first, skips
nodes that lie outside every window still wanted, and verifies the rows of leaves exactly.

The top level, a bounded number of points chosen from a bounded sample, deals all rows into cells; cells
are cut into shards of bounded size, each a tree of its own and one row of a table. Anchors go in blocks,
first to the cell they lie in, then, with what they found there, to the cells whose bounds still allow
a better row. Every row is in one tree and every cell not ruled out is searched, so results are exact.

Vectors are quantised to whole numbers, so that products are exact in doubles while they stay under 2^53.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from almanac.llm.common import saved

QUANTUM = 256
#: Rows of a shard, of a leaf, anchors of a block, blocks that meet a shard in one group.
SHARD_ROWS, LEAF_ROWS, BLOCK_ROWS, SLOT_BLOCKS = 4096, 32, 128, 64
#: Most cells, and rows of the sample their points are chosen from.
CELLS, SAMPLE_ROWS = 256, 4096
#: Nodes that the search takes from its queue at once, to begin with; twice as many each time.
BEAM = 32
#: Squared quantised norms stay below this, so that every product is exact.
EXACT = 1 << 53

_PREPARED = "row_no long, vec_id long, label long, q array<int>, norm long"
_TREE = ("cell int, shard int, center array<int>, radius array<double>, child array<int>, children array<int>, start array<int>, "
         "stop array<int>, row_nos array<long>, vec_ids array<long>, labels array<long>, rows binary")
_HITS = "anchor_no long, slot int, row_no long, vec_id long, score long"
_KINDS = {"long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "binary": pa.binary(), "array<int>": pa.list_(pa.int32()),
          "array<long>": pa.list_(pa.int64()), "array<double>": pa.list_(pa.float64())}


def _batch(columns: list, schema: str) -> pa.RecordBatch:
    parts = [p.split() for p in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, _KINDS[k]) for c, (_, k) in zip(columns, parts)], names=[n for n, _ in parts])


def _vectors(column: pa.Array, size: int, kind=np.float64) -> np.ndarray:
    """Rows of a list column, shorter ones filled with zeros."""
    lengths = np.diff(column.offsets.to_numpy())
    values = column.flatten().to_numpy(zero_copy_only=False)
    if (lengths == size).all():
        return values.reshape(len(lengths), size).astype(kind)
    out = np.zeros((len(lengths), size), kind)
    out[np.arange(size) < lengths[:, None]] = values
    return out


def _prepare(batches: Iterator[pa.RecordBatch], quantum: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        column = batch.column(3)
        if not batch.num_rows:
            continue
        size = int(np.diff(column.offsets.to_numpy()).max())
        q = np.floor(quantum * _vectors(column, size)) if size else np.zeros((batch.num_rows, 0))
        fits = (np.abs(q).max(axis=1, initial=0) < 1 << 26) & ((q * q).sum(axis=1) < EXACT)
        kept = batch.filter(pa.array(fits))
        q = q[fits].astype(np.int64)
        yield _batch([kept.column(0), kept.column(1), kept.column(2), list(q.astype(np.int32)), (q * q).sum(axis=1)], _PREPARED)


def prepared(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label", quantum: int = QUANTUM) -> DataFrame:
    """(row_no, vec_id, label, q, norm) of the rows that take part: vec_id and label known, the vector
    and all its components too, no component infinite or NaN, and the quantised squared norm below 2^53.
    A shorter vector is read as filled up with zeros; labels are whole numbers."""
    rows = vectors.select(F.monotonically_increasing_id().alias("row_no"), F.col(vec_id).cast("long").alias("vec_id"),
                          F.col(label).cast("long").alias("label"), F.col(embedding).cast("array<double>").alias("embedding"))
    odd = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = rows.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull() & ~odd)
    return saved(rows.mapInArrow(partial(_prepare, quantum=quantum), _PREPARED), "vectors")


def augmented(q: np.ndarray, norm: float) -> np.ndarray:
    """Rows with the component that gives all of them the length sqrt(``norm``)."""
    rest = np.sqrt(np.maximum(norm - (q * q).sum(axis=1), 0))
    return np.column_stack([q, rest])


def spread(points: np.ndarray, most: int, until: float = 0.0, first: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Chosen points, each row's nearest of them and its distance: the farthest row is chosen next until
    all rows lie within ``until`` of a chosen one, or ``most`` are chosen."""
    squares = (points * points).sum(axis=1)
    chosen, owner, gap = [], np.zeros(len(points), np.int64), np.full(len(points), np.inf)
    at = first
    while len(chosen) < most:
        own = np.maximum(squares + squares[at] - 2 * (points @ points[at]), 0)
        own[at] = 0
        owner[own < gap] = len(chosen)
        gap = np.minimum(gap, own)
        chosen.append(at)
        at = int(np.argmax(gap))
        if gap[at] <= until * until:
            break
    # the product of equal rows is exact only up to rounding: give the distance that much
    return np.array(chosen), owner, np.sqrt(gap) + 1e-7 * np.sqrt(squares.max(initial=0))


def build_tree(points: np.ndarray, leaf_rows: int = LEAF_ROWS) -> tuple[np.ndarray, list]:
    """Order of the rows and the nodes as columns (center, radius, child, children, start, stop).

    Each level halves the covering radius of the one above. A node's rows stand together; its first
    child has its own point, its children stand together too. ``children`` is 0 for a leaf.
    """
    order = np.arange(len(points))
    radius = float(spread(points, 1)[2].max())
    nodes = [[0, radius, 0, 0, 0, len(points)]]
    at = 0
    while at < len(nodes):
        center, radius, _, _, start, stop = nodes[at]
        rows = order[start:stop].copy()
        if stop - start > leaf_rows and radius > 1e-6 * math.sqrt(float(points[center] @ points[center])) + 1e-9:
            most = max(2, 2 * (stop - start) // leaf_rows)
            own = points[rows]
            chosen, owner, gap = spread(own, most, radius / 2, int(np.flatnonzero(rows == center)[0]))
            if len(chosen) > 1:
                into = np.argsort(owner, kind="stable")
                order[start:stop] = rows[into]
                sizes = np.bincount(owner, minlength=len(chosen))
                nodes[at][2:4] = len(nodes), len(chosen)
                to = start
                for k, size in enumerate(sizes.tolist()):
                    nodes.append([int(rows[chosen[k]]), float(gap[owner == k].max()), 0, 0, to, to + size])
                    to += size
        at += 1
    place = np.empty(len(points), np.int64)
    place[order] = np.arange(len(points))
    columns = [list(c) for c in zip(*nodes)]
    columns[0] = place[np.array(columns[0])].tolist()
    return order, columns


def _grow(table: pa.Table, size: int, norm: float) -> pa.Table:
    table = table.combine_chunks()
    q = _vectors(table.column("q").chunk(0), size)
    order, nodes = build_tree(augmented(q, norm))
    taken = table.take(pa.array(order))
    ids = [[taken.column(c).to_pylist()] for c in ("row_no", "vec_id", "label")]
    key = [table.column(c).to_pylist()[:1] for c in ("cell", "shard")]
    return pa.Table.from_batches([_batch([*key, *[[c] for c in nodes], *ids, [q[order].astype("<i4").tobytes()]], _TREE)])


def _ranges(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The numbers of all ranges, one range after the other."""
    before = np.cumsum(size) - size
    return np.arange(int(size.sum())) + np.repeat(start - before, size)


class Tree:
    """A shard's tree and rows as arrays, read from its row of the table of trees."""

    def __init__(self, row: dict, size: int):
        self.radius = np.array(row["radius"])
        self.child, self.children, self.start, self.stop, center = (np.array(row[c], np.int64) for c in ("child", "children", "start", "stop", "center"))
        self.row_no, self.vec_id, self.label = (np.array(row[c], np.int64) for c in ("row_nos", "vec_ids", "labels"))
        self.rows = np.frombuffer(row["rows"], "<i4").reshape(len(self.row_no), size).astype(float)
        self.center = self.rows[center]

    def search(self, anchor: np.ndarray, usable: np.ndarray, low: np.ndarray, high: np.ndarray, k: int, slack: float) -> list[tuple[int, np.ndarray, np.ndarray]]:
        """(window, rows, scores) with the ``k`` best usable rows of each window, of equal scores the smaller
        vec_id and row first. ``low`` rises as rows are found, which closes the window from below."""
        low, norm = low.astype(float), math.sqrt(float(anchor @ anchor))
        found = [(np.empty(0, np.int64), np.empty(0))] * len(low)
        nodes, above, below = np.empty(0, np.int64), np.empty(0), np.empty(0)
        fresh, beam = np.zeros(1, np.int64), BEAM
        while True:
            if len(fresh):
                product, reach = self.center[fresh] @ anchor, norm * self.radius[fresh] + slack
                nodes = np.concatenate([nodes, fresh])
                above, below = np.concatenate([above, product + reach]), np.concatenate([below, product - reach])
            needed = ((above[:, None] >= low) & (below[:, None] <= high)).any(axis=1)
            nodes, above, below = nodes[needed], above[needed], below[needed]
            if not len(nodes):
                return [(w, rows, scores) for w, (rows, scores) in enumerate(found) if len(rows)]
            if len(nodes) > beam:
                best = np.argpartition(-above, beam)
                take, rest = best[:beam], best[beam:]
            else:
                take, rest = np.arange(len(nodes)), np.empty(0, np.int64)
            opened = nodes[take]
            nodes, above, below, beam = nodes[rest], above[rest], below[rest], 2 * beam
            inner = opened[self.children[opened] > 0]
            leaves = opened[self.children[opened] == 0]
            fresh = _ranges(self.child[inner], self.children[inner])
            if not len(leaves):
                continue
            rows = _ranges(self.start[leaves], self.stop[leaves] - self.start[leaves])
            rows = rows[usable[rows]]
            scores = self.rows[rows] @ anchor
            for w in range(len(low)):
                fits = (scores >= low[w]) & (scores <= high[w])
                if not fits.any():
                    continue
                r, s = np.concatenate([found[w][0], rows[fits]]), np.concatenate([found[w][1], scores[fits]])
                best = np.lexsort((self.row_no[r], self.vec_id[r], -s))[:k]
                found[w] = (r[best], s[best])
                if len(best) == k:
                    low[w] = max(low[w], found[w][1][-1])


def _visit(batches: Iterator[pa.RecordBatch], size: int, k: int, same: bool, slack: float) -> Iterator[pa.RecordBatch]:
    """Each row is a shard's tree and a block of anchors with their windows."""
    tree, at = None, None
    for batch in batches:
        for n in range(batch.num_rows):
            row = {name: batch.column(i)[n].as_py() for i, name in enumerate(batch.schema.names) if name in ("cell", "shard", "anchors")}
            if at != (row["cell"], row["shard"]):
                at = row["cell"], row["shard"]
                tree = Tree({name: batch.column(i)[n].as_py() for i, name in enumerate(batch.schema.names) if name != "anchors"}, size)
            out: list[list] = [[] for _ in range(5)]
            for a in row["anchors"]:
                usable = (tree.label == a["label"]) & (tree.row_no != a["row_no"]) if same else tree.label != a["label"]
                vector = np.zeros(size)
                vector[:len(a["q"])] = a["q"]
                for w, rows, scores in tree.search(vector, usable, np.array(a["low"]), np.array(a["high"]), k, slack):
                    for column, values in zip(out, ([a["row_no"]] * len(rows), [a["slots"][w]] * len(rows), tree.row_no[rows].tolist(), tree.vec_id[rows].tolist(), scores.astype(np.int64).tolist())):
                        column.extend(values)
            if out[0]:
                yield _batch(out, _HITS)


def _cells_needed(batches: Iterator[pa.RecordBatch], centers: np.ndarray, radius: np.ndarray, size: int, slack: float) -> Iterator[pa.RecordBatch]:
    """Anchors with the cells other than their own that may hold rows of one of their windows."""
    for batch in batches:
        out: list[list] = [[] for _ in range(2)]
        names = batch.schema.names
        anchors, homes = _vectors(batch.column(names.index("q")), size), batch.column(names.index("cell")).to_numpy()
        products = anchors @ centers[:, :size].T
        reach = np.sqrt((anchors * anchors).sum(axis=1))[:, None] * radius + slack
        for i, (low, high) in enumerate(zip(*(batch.column(names.index(c)).to_pylist() for c in ("low", "high")))):
            inside = ((products[i] + reach[i])[:, None] >= np.array(low)) & ((products[i] - reach[i])[:, None] <= np.array(high))
            needed = inside.any(axis=1)
            needed[homes[i]] = False
            out[0].append(batch.column(names.index("row_no"))[i].as_py())
            out[1].append(np.flatnonzero(needed).tolist())
        yield _batch(out, "row_no long, cells array<int>")


class Index:
    """The trees of all prepared vectors, dealt by cells and shards."""

    def __init__(self, vectors: DataFrame, shard_rows: int = SHARD_ROWS, cells: int = CELLS, sample_rows: int = SAMPLE_ROWS):
        self.spark, self.shard_rows = vectors.sparkSession, shard_rows
        facts = vectors.agg(F.count("*").alias("n"), F.max(F.size("q")).alias("size"), F.max("norm").alias("norm")).first()
        self.n, self.size, self.norm = facts["n"], facts["size"] or 0, float(facts["norm"] or 0)
        self.slack = 1e-6 + 1e-9 * self.norm
        if not self.n:
            return
        few = vectors.orderBy(F.xxhash64("vec_id", "row_no"), "row_no").limit(sample_rows).select("q").toArrow()
        points = augmented(_vectors(few.column(0).combine_chunks(), self.size), self.norm)
        chosen = spread(points, max(1, min(cells, math.ceil(self.n / shard_rows))))[0]
        self.centers = points[chosen]
        dealt = saved(vectors.mapInArrow(partial(_deal, centers=self.centers, size=self.size, norm=self.norm), _PREPARED + ", cell int, gap double"), "cells")
        # a row for each cell, of which there are at most ``cells``
        held = {r["cell"]: r for r in dealt.groupBy("cell").agg(F.count("*").alias("n"), F.max("gap").alias("radius")).collect()}
        self.radius = np.array([held[c]["radius"] if c in held else -np.inf for c in range(len(chosen))])
        self.shards = [math.ceil(held[c]["n"] / shard_rows) if c in held else 0 for c in range(len(chosen))]
        shard = F.pmod(F.xxhash64("row_no"), self._shards_of(F.col("cell")))
        self.vectors = dealt.drop("gap")
        size, norm = self.size, self.norm

        def grow(rows: pa.Table) -> pa.Table:
            return _grow(rows, size, norm)

        sized = self.vectors.withColumn("shard", shard.cast("int")).groupBy("cell", "shard")
        self.trees = saved(sized.applyInArrow(grow, _TREE), "trees")

    def _shards_of(self, cell: Column) -> Column:
        return F.element_at(F.array(*[F.lit(n) for n in self.shards]), cell + 1)

    def search(self, anchors: DataFrame, same: bool, k: int) -> DataFrame:
        """Hits (anchor_no, slot, row_no, vec_id, score): the ``k`` best rows, of the anchor's label or of
        others, in each window of ``anchors`` (row_no, label, q, cell, slots, low, high), at least."""
        home = self._visit(anchors.withColumn("cells", F.array("cell")), same, k)
        home = saved(_best(home, k), "home")
        reached = home.groupBy("anchor_no", "slot").agg(F.when(F.count("*") >= k, F.min("score").cast("double")).alias("least"))
        reached = reached.groupBy(F.col("anchor_no").alias("row_no")).agg(F.map_from_entries(F.collect_list(F.struct("slot", "least"))).alias("least"))
        risen = F.zip_with("slots", "low", lambda slot, low: F.greatest(low, F.coalesce(F.try_element_at("least", slot), low)))
        rest = anchors.join(reached, "row_no", "left").withColumn("low", F.when(F.col("least").isNull(), F.col("low")).otherwise(risen)).drop("least")
        rest = saved(rest, "windows")
        needed = rest.select("row_no", "q", "cell", "low", "high").mapInArrow(
            partial(_cells_needed, centers=self.centers, radius=self.radius, size=self.size, slack=self.slack), "row_no long, cells array<int>")
        away = self._visit(rest.join(needed, "row_no"), same, k)
        return saved(_best(home.drop("rank").unionByName(away), k), "best")

    def _visit(self, anchors: DataFrame, same: bool, k: int) -> DataFrame:
        """Anchors meet the shards of their ``cells``, in blocks of anchors of one cell."""
        n = max(1, anchors.count())
        slots = math.ceil(n / (BLOCK_ROWS * SLOT_BLOCKS))
        blocks = math.ceil(n / BLOCK_ROWS)
        each = anchors.select(F.struct("row_no", "label", "q", "slots", "low", "high").alias("anchor"), F.pmod(F.xxhash64("row_no", "cell"), F.lit(blocks)).alias("block"),
                              F.explode("cells").alias("cell"))
        each = each.groupBy("cell", "block").agg(F.collect_list("anchor").alias("anchors"))
        each = each.withColumn("shard", F.explode(F.sequence(F.lit(0), self._shards_of(F.col("cell")) - 1)))
        each = each.select("cell", "shard", F.pmod("block", F.lit(slots)).alias("slot"), "anchors")
        trees = self.trees.withColumn("slot", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(slots - 1).cast("long"))))
        parts = max(int(self.spark.conf.get("spark.sql.shuffle.partitions")), min(sum(self.shards) * slots, 10_000))
        key = ["cell", "shard", "slot"]
        met = each.repartition(parts, *key).join(trees.repartition(parts, *key).hint("merge"), key)
        names = [p.split()[0] for p in _TREE.split(", ")]
        return met.select(*names, "anchors").mapInArrow(partial(_visit, size=self.size, k=k, same=same, slack=self.slack), _HITS)


def _deal(batches: Iterator[pa.RecordBatch], centers: np.ndarray, size: int, norm: float) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if not batch.num_rows:
            continue
        points = augmented(_vectors(batch.column(3), size), norm)
        products = points @ centers.T
        cell = np.argmax(products, axis=1)
        gap = np.sqrt(((points - centers[cell]) ** 2).sum(axis=1)) * (1 + 1e-9) + 1e-6
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell, pa.int32()), pa.array(gap)], names=[*batch.schema.names, "cell", "gap"])


def _best(hits: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("anchor_no", "slot").orderBy(F.desc("score"), "vec_id", "row_no")
    return hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def hard_negatives(vectors: DataFrame, anchors: Column, n_positives: int = 5, n_negatives: int = 5, low: int = 80, high: int = 100,
                   shard_rows: int = SHARD_ROWS) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for ``prepared`` vectors.

    Anchors are the rows that the condition ``anchors`` holds for. An anchor's positives are its best
    other rows of the same label, and a positive's negatives the best rows of other labels whose score
    is at least ``low`` and at most ``high`` percent of the positive's; higher scores first, of equal ones
    the smaller vec_id. Repeated rows count each on their own, also as anchors. Without rows, anchors,
    positives or negatives the result is empty.
    """
    schema = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    index = Index(vectors, shard_rows)
    if not index.n:
        return vectors.sparkSession.createDataFrame([], schema)
    own = index.vectors.where(anchors).select("row_no", "vec_id", "label", "q", "cell")
    own = saved(own, "anchors")
    everything = own.select("row_no", "label", "q", "cell", F.array(F.lit(0)).alias("slots"), F.array(F.lit(float("-inf"))).alias("low"), F.array(F.lit(float("inf"))).alias("high"))
    positives = index.search(everything, True, n_positives).select(
        "anchor_no", F.col("rank").alias("slot"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
    # whole numbers s with low * p <= 100 * s <= high * p, as far as there are any
    p = F.col("positive_score")
    bottom, top = ((times + F.pmod(-times, F.lit(100))) / 100 if up else (times - F.pmod(times, F.lit(100))) / 100
                   for times, up in ((p * low, True), (p * high, False)))
    windows = positives.withColumn("bottom", bottom.cast("double")).withColumn("top", top.cast("double")).where("bottom <= top")
    lists = windows.groupBy(F.col("anchor_no").alias("row_no")).agg(F.sort_array(F.collect_list(F.struct("slot", "bottom", "top"))).alias("w"))
    wanted = own.drop("vec_id").join(lists, "row_no").select("row_no", "label", "q", "cell", F.col("w.slot").alias("slots"), F.col("w.bottom").alias("low"), F.col("w.top").alias("high"))
    negatives = index.search(saved(wanted, "wanted"), False, n_negatives).select(
        "anchor_no", "slot", "rank", F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"))
    ids = own.select(F.col("row_no").alias("anchor_no"), F.col("vec_id").alias("anchor_id"))
    return negatives.join(positives, ["anchor_no", "slot"]).join(ids, "anchor_no").select(
        "anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score")


def mine(vectors: DataFrame, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """``hard_negatives`` with the anchors, labels and windows of the registered query: every vec_id
    divisible by 100 is an anchor, one divisible by 7 has the next label, modulo 10."""
    label = F.col("label").cast("long")
    moved = vectors.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (label + 1) % 10).otherwise(label))
    return hard_negatives(prepared(moved), F.col("vec_id") % 100 == 0, shard_rows=shard_rows)
