"""Prefix trie of conversations, with subtree totals rolled up by bands of depths.

A node is a distinct sequence of first turns. Its key joins position-keyed hashes of its turns by
exclusive or, so that keys of all prefixes are running values: they are taken piece by piece and the
pieces' values added, and a conversation of any length is never one task's work. A node's parent has the
key without the last turn.

Subtree totals: the depths are cut into bands of equal height. A node explodes to its ancestors inside
its band only, at most the height of a band. Bands are done from the deepest: what the nodes of a band
sum to at its top depth goes to the parents in the band above as one row a node. With the height the
root of the greatest depth, neither the rounds nor the explosion grow beyond that root.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from almanac.llm.common import map_arrow, saved, whole

#: Original turns that a conversation takes over from the first of its group are fewer than this.
MOST_SHARED, GROUP = 9, 5
#: Least height of a band.
HEIGHT = 8
#: Characters of ids that one row carries on their way to a digest.
CHUNK = 1 << 16


def node_key(first: Column, second: Column) -> Column:
    return F.struct(first.cast("long").alias("a"), second.cast("long").alias("b"))


def _running(df: DataFrame, key: list[str], order: list[Column], name: str, sums: dict[str, tuple]) -> DataFrame:
    """``df`` with running values over all rows of a key, in order; the key may hold any part of all rows.

    ``sums`` names (aggregate function, value column, neutral value). Rows are dealt by ranges of key and
    order, so that a large key lies in many partitions; running values are taken within a key's rows of
    one partition, and the totals of its earlier partitions added, one row a key and partition.
    """
    rank = [F.col(k) for k in key]
    ranged = df.repartitionByRange(*rank, *order).sortWithinPartitions(*rank, *order)
    ranged = saved(ranged.withColumn("_part", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id()), name)
    own = Window.partitionBy(*key, "_part").orderBy("_at").rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(*key).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    totals = ranged.groupBy(*key, "_part").agg(*[f(v).alias(f"_all_{n}") for n, (f, v, _) in sums.items()])
    totals = totals.select(*key, "_part", *[F.coalesce(f(f"_all_{n}").over(before), F.lit(zero).cast("long")).alias(f"_before_{n}")
                                            for n, (f, _, zero) in sums.items()])
    # a key of one partition has nothing before it: only rows behind a boundary are joined
    totals = totals.where(" or ".join(f"_before_{n} != {zero}" for n, (_, _, zero) in sums.items()))
    rows = ranged.select("*", *[f(v).over(own).alias(n) for n, (f, v, _) in sums.items()]).join(totals, [*key, "_part"], "left")
    for n, (f, _, zero) in sums.items():
        earlier = F.coalesce(F.col(f"_before_{n}"), F.lit(zero).cast("long"))
        rows = rows.withColumn(n, F.col(n).bitwiseXOR(earlier) if f is F.bit_xor else F.col(n) + earlier)
    return rows.select(*df.columns, *sums)


def rebuilt(conversations: DataFrame, most: int = MOST_SHARED, group: int = GROUP) -> tuple[DataFrame, DataFrame]:
    """(conv_id of every conversation), and its rebuilt turns (conv_id, pos from 1, role, text).

    A conversation c starts with the first h turns of conversation c - c % ``group``, h being the crc32
    of its decimal id modulo ``most``; its own turns after its first h follow. Turns are ordered by turn,
    nulls first, then by role and text; null roles and texts are empty ones. Rows without conv_id take
    no part.
    """
    turns = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").alias("turn"),
                                 whole(F.col("role")).alias("role"), whole(F.col("text")).alias("text"))
    turns = turns.where("conv_id is not null").withColumn("one", F.lit(1).cast("long"))
    order = [F.col("turn").asc_nulls_first(), F.col("role"), F.xxhash64("text"), F.xxhash64("text", F.lit(1))]
    turns = saved(_running(turns, ["conv_id"], order, "turns", {"rank": (F.sum, "one", 0)}).drop("one", "turn"), "ranked")
    # the first turns alone say which conversations there are
    members = turns.where("rank = 1").select("conv_id")
    members = members.withColumn("h", F.crc32(F.col("conv_id").cast("string").cast("binary")) % most)
    own = turns.withColumn("h", F.crc32(F.col("conv_id").cast("string").cast("binary")) % most).where("rank > h")
    heads = turns.where((F.col("rank") < most) & (F.col("conv_id") % group == 0))
    lead = heads.groupBy("conv_id").agg(F.max("rank").alias("n")).withColumnRenamed("conv_id", "base")
    members = members.withColumn("base", F.col("conv_id") - F.col("conv_id") % group).join(lead, "base", "left")
    members = saved(members.select("conv_id", "base", F.least("h", F.coalesce("n", F.lit(0))).alias("taken")), "members")
    copied = members.where("taken > 0").join(heads.withColumnRenamed("conv_id", "base"), "base").where("rank <= taken")
    own = own.join(members.select("conv_id", "taken"), "conv_id").select("conv_id", (F.col("rank") - F.col("h") + F.col("taken")).alias("pos"), "role", "text")
    return members.select("conv_id"), copied.select("conv_id", F.col("rank").alias("pos"), "role", "text").unionByName(own)


def trie_nodes(members: DataFrame, turns: DataFrame, height: int | None = None) -> tuple[DataFrame, DataFrame, int]:
    """The nodes (node, parent, depth, conv_id, n_convs, bytes, above) and the ends (node, conv_id), from
    conversations and their turns (conv_id, pos, role, text), and the height of a band.

    ``above`` lists a node's ancestors inside its band and the node itself, as its smallest member passes them.
    """
    marked = turns.select("conv_id", F.col("pos").alias("depth"), F.octet_length("text").cast("long").alias("bytes"),
                          *[F.xxhash64("pos", "role", "text", F.lit(seed)).alias(f"h{seed}") for seed in (1, 2)])
    marked = _running(marked, ["conv_id"], [F.col("depth")], "marked", {"a": (F.bit_xor, "h1", 0), "b": (F.bit_xor, "h2", 0)})
    steps = saved(marked.select("conv_id", "depth", "bytes", node_key(F.col("a"), F.col("b")).alias("node"),
                                node_key(F.col("a").bitwiseXOR(F.col("h1")), F.col("b").bitwiseXOR(F.col("h2"))).alias("parent")), "steps")
    deepest = steps.agg(F.max("depth").alias("d")).first()["d"] or 0
    height = height or max(HEIGHT, math.ceil(math.sqrt(deepest + 1)))
    nodes = steps.groupBy("node", "parent", "depth").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.max("bytes").alias("bytes"))
    root = node_key(F.lit(0), F.lit(0))
    band = F.floor(F.col("depth") / height)
    passed = F.collect_list("node").over(Window.partitionBy("conv_id", band).orderBy("depth").rowsBetween(Window.unboundedPreceding, 0))
    paths = steps.select("node", "conv_id", F.when(band == 0, F.concat(F.array(root), passed)).otherwise(passed).alias("above"))
    top = members.agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs")).where("n_convs > 0")
    top = top.select(root.alias("node"), F.lit(None).cast("struct<a:bigint,b:bigint>").alias("parent"), F.lit(0).cast("long").alias("depth"),
                     "conv_id", "n_convs", F.lit(0).cast("long").alias("bytes"), F.array(root).alias("above"))
    last = steps.groupBy("conv_id").agg(F.max_by("node", "depth").alias("node"))
    ends = members.join(last, "conv_id", "left").select(F.coalesce("node", root).alias("node"), "conv_id")
    nodes = nodes.join(paths, ["node", "conv_id"]).select(top.columns)
    return saved(nodes.unionByName(top), "nodes"), ends, height


def subtree_totals(nodes: DataFrame, values: list[str], height: int) -> DataFrame:
    """(node, and for each of ``values`` its sum over the node's subtree), for nodes (node, parent, depth,
    values, above) in bands of ``height``."""
    deepest = nodes.agg(F.max("depth").alias("d")).first()["d"]
    if deepest is None:
        return nodes.select("node", *values)
    sums = [F.sum(v).alias(v) for v in values]
    done, arrived = None, None
    for n in range(deepest // height, -1, -1):
        own = nodes.where((F.col("depth") >= n * height) & (F.col("depth") < (n + 1) * height))
        each = own.select(F.explode("above").alias("node"), *values)
        if arrived is not None:
            joined = own.select("node", "above").join(arrived, "node")
            each = each.unionByName(joined.select(F.explode("above").alias("node"), *values))
        totals = saved(each.groupBy("node").agg(*sums), "band")
        done = totals if done is None else done.unionByName(totals)
        if n:
            top = own.where(F.col("depth") == n * height).select("node", "parent")
            arrived = top.join(totals, "node").groupBy(F.col("parent").alias("node")).agg(*sums)
    return done


_IDS = "node struct<a:bigint,b:bigint>, first long, ids string"


def _joined_ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Ids in order, joined by commas in runs of one node, at most about ``CHUNK`` characters a run."""
    node, first, held, size = None, None, [], 0

    def row():
        kind = pa.struct([("a", pa.int64()), ("b", pa.int64())])
        return pa.RecordBatch.from_arrays([pa.array([node], kind), pa.array([first], pa.int64()), pa.array([",".join(held)])], names=["node", "first", "ids"])

    for batch in batches:
        for at, conv_id in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if held and (at != node or size > CHUNK):
                yield row()
                held, size = [], 0
            if not held:
                node, first = at, conv_id
            held.append(str(conv_id))
            size += len(held[-1]) + 1
    if held:
        yield row()


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One SHA-256 a node over its runs, which come one after the other; only one run is held."""
    node, state, done = None, None, []
    kind = pa.struct([("a", pa.int64()), ("b", pa.int64())])

    def rows():
        return pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], kind), pa.array([d[1] for d in done], pa.string())], names=["node", "ends_sha256"])

    for batch in batches:
        for at, ids in zip(batch.column(0).to_pylist(), batch.column(2)):
            if at == node:
                state.update(b",")
            else:
                if state:
                    done.append((node, state.hexdigest()))
                node, state = at, hashlib.sha256()
            state.update(ids.as_py().encode())
        if len(done) > 10_000:
            yield rows()
            done = []
    if state:
        done.append((node, state.hexdigest()))
    if done:
        yield rows()


def end_digests(ends: DataFrame) -> DataFrame:
    """(node, ends_sha256): the SHA-256 of the ids that end at a node, ascending and joined by commas.

    Ids are dealt by ranges of node and id, so that the ids of a node where many end are joined in many
    tasks; a digest is sequential by nature, and its task reads joined runs, one at a time.
    """
    runs = ends.repartitionByRange("node", "conv_id").sortWithinPartitions("node", "conv_id").mapInArrow(_joined_ids, _IDS)
    runs = saved(runs, "ids")
    return runs.repartition("node").sortWithinPartitions("node", "first").mapInArrow(
        _digests, "node struct<a:bigint,b:bigint>, ends_sha256 string")


def trie(members: DataFrame, turns: DataFrame, height: int | None = None) -> DataFrame:
    """One row per node: conv_id (its smallest member), depth, parent_conv_id, n_convs, n_children,
    n_leaves, saved_tokens, ends_sha256. Without any conversation there is no node."""
    nodes, ends, height = trie_nodes(members, turns, height)
    children = nodes.where("depth > 0").groupBy(F.col("parent").alias("node")).agg(F.count("*").alias("n_children"))
    nodes = nodes.join(children, "node", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)).cast("long"))
    nodes = saved(nodes.withColumn("n_leaves", (F.col("n_children") == 0).cast("long"))
                  .withColumn("saved_tokens", (F.col("n_convs") - 1) * F.col("bytes")), "trie")
    totals = subtree_totals(nodes, ["n_leaves", "saved_tokens"], height)
    parents = nodes.where("n_children > 0").select(F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    named = saved(nodes.drop("n_leaves", "saved_tokens", "above").join(parents, "parent", "left"), "named")
    none = hashlib.sha256().hexdigest()
    return named.join(totals, "node").join(saved(end_digests(ends), "ends"), "node", "left").select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
        F.coalesce("ends_sha256", F.lit(none)).alias("ends_sha256"))


def conversation_trie(conversations: DataFrame, height: int | None = None) -> DataFrame:
    """``trie`` of the rebuilt conversations; other columns are not read. An empty table gives no node."""
    members, turns = rebuilt(conversations)
    return trie(members, saved(turns, "rebuilt"), height)
