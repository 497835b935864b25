"""Scaled sketches, the conversation trie and the cover tree against plain Python."""

import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from almanac.llm import cover_tree, prefix_trie, scaled_sketch

NAN, INF = float("nan"), float("inf")


def prose(draw, n):
    return " ".join(f"w{draw.randrange(3000)}" for _ in range(n))


# ---- scaled sketches


def brute_fingerprints(rows, key):
    rows = sorted(((r[0], r[1] or "") for r in rows), key=lambda r: (r[0] is None, -(r[0] or 0), key[r[1]]))
    out = []
    for (doc_id, text), (_, after) in zip(rows, rows[1:] + rows[:1]):
        edited = text[:len(text) - len(text) // 2] + after[:len(text) // 2]
        own, changed, following = (scaled_sketch.sketch(t.encode()) for t in (text, edited, after))
        out.append((doc_id, len(text), hashlib.sha256(edited.encode()).hexdigest(), scaled_sketch.written(*own),
                    scaled_sketch.written(*changed), scaled_sketch.likeness(own, changed), scaled_sketch.likeness(own, following)))
    return out


def test_fingerprints_against_brute_force(spark, docs, rows, as_rows):
    texts = {r[1] or "" for r in rows}
    key = {r[0]: r[1] for r in spark.createDataFrame([(t,) for t in texts], "t string").select("t", F.xxhash64("t")).collect()}
    assert as_rows(scaled_sketch.fingerprints(docs)) == sorted(brute_fingerprints(rows, key), key=repr)


def test_fingerprints_of_one_and_of_no_row(spark, nothing):
    one = spark.createDataFrame([(5, "a b c d")], "doc_id long, text string")
    row = scaled_sketch.fingerprints(one).first()
    assert row["edited_sha256"] == hashlib.sha256(b"a b a b").hexdigest() and row["near_next"] == 1.0
    assert scaled_sketch.fingerprints(nothing).count() == 0


def test_sketches_hold_every_hash_below_their_bound():
    draw = random.Random(1)
    text = prose(draw, 20_000).encode()
    bound, hashes = scaled_sketch.sketch(text)
    everything = scaled_sketch.sketch(text, scale=1)[1]
    assert bound == scaled_sketch.RANGE // scaled_sketch.SCALE
    assert np.array_equal(hashes, everything[everything < bound])
    assert abs(len(hashes) / len(everything) * scaled_sketch.SCALE - 1) < 0.15
    short = scaled_sketch.sketch(prose(draw, 300).encode())
    assert len(short[1]) == scaled_sketch.LEAST and scaled_sketch.RANGE // scaled_sketch.SCALE < short[0] < scaled_sketch.RANGE
    assert len(scaled_sketch.sketch(b"one two")[1]) == 1 and scaled_sketch.sketch(b" \n")[0] == scaled_sketch.RANGE
    for s in (short, (bound, hashes)):
        got = scaled_sketch.read(scaled_sketch.written(*s))
        assert got[0] == s[0] and np.array_equal(got[1], s[1])


def test_containment_of_unequal_texts_and_merging():
    draw = random.Random(2)
    part, rest = prose(draw, 3000), prose(draw, 40_000)
    small, large = scaled_sketch.sketch(part.encode()), scaled_sketch.sketch((rest + " " + part).encode())
    assert scaled_sketch.containment(small, large) > 0.97
    assert scaled_sketch.containment(large, small) < 0.12
    assert scaled_sketch.likeness(small, large) == scaled_sketch.likeness(large, small) > 0.97
    both = scaled_sketch.merged(small, scaled_sketch.sketch(rest.encode()))
    assert both[0] == large[0] and len(np.setxor1d(both[1], large[1])) <= 3  # shingles across the seam
    half = " ".join(part.split()[:1500]) + " " + prose(draw, 1500)
    assert 0.4 < scaled_sketch.likeness(small, scaled_sketch.sketch(half.encode())) < 0.6
    assert scaled_sketch.likeness(small, scaled_sketch.sketch(rest.encode())) < 0.02
    assert scaled_sketch.likeness(scaled_sketch.sketch(b""), scaled_sketch.sketch(b"")) == 1.0
    assert scaled_sketch.likeness(small, scaled_sketch.sketch(b"")) == 0.0


def test_merged_sketches_as_rows(spark):
    draw = random.Random(3)
    texts = [("a", prose(draw, 4000)), ("a", prose(draw, 100)), ("b", prose(draw, 30)), (None, "x y z"), ("c", ""), ("d", None)]
    sketches = [scaled_sketch.sketch(t.encode()) if t is not None else None for _, t in texts]
    df = spark.createDataFrame([(k, s and scaled_sketch.written(*s)) for (k, _), s in zip(texts, sketches)], "source string, fingerprint string")
    got = defaultdict(set)
    for r in scaled_sketch.merged_by(df, "source").collect():
        got[r["key"]].add((r["bound"], r["hash"]))
    want = scaled_sketch.merged(*sketches[:2])
    assert got["a"] == {(want[0], int(h)) for h in want[1]}
    assert got["b"] == {(sketches[2][0], int(h)) for h in sketches[2][1]} and len(got[None]) == 1 and set(got) == {"a", "b", None}


# ---- prefix trie


def brute_trie(rows):
    own = defaultdict(list)
    for conv_id, turn, role, text in rows:
        if conv_id is not None:
            own[conv_id].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [r[2:] for r in turns] for c, turns in own.items()}
    members, ends = defaultdict(list), defaultdict(list)
    for c in own:
        h = zlib.crc32(str(c).encode()) % 9
        seq = own.get(c - c % 5, [])[:h] + own[c][h:]
        for d in range(len(seq) + 1):
            members[tuple(seq[:d])].append(c)
        ends[tuple(seq)].append(c)
    children, leaves, kept = defaultdict(int), defaultdict(int), defaultdict(int)
    for node in members:
        children[node[:-1]] += bool(node)
    for node, ids in members.items():
        for d in range(len(node) + 1):
            leaves[node[:d]] += not children[node]
            kept[node[:d]] += (len(ids) - 1) * len(node[-1][1].encode()) if node else 0
    return sorted(((min(ids), len(node), min(members[node[:-1]]) if node else None, len(ids), children[node], leaves[node], kept[node],
                    hashlib.sha256(",".join(map(str, sorted(ends[node]))).encode()).hexdigest()) for node, ids in members.items()), key=repr)


CONVERSATION = "conv_id long, turn long, role string, text string, node int, rank string"


def make_conversations(seed, n):
    draw = random.Random(seed)
    rows = []
    for c in range(n):
        for turn in range(draw.randint(1, 12)):
            rows.append((c, draw.choice([turn, turn, None]), draw.choice(["user", "user", None, ""]), draw.choice(["a", "b", "é", "", None]), 1, "x"))
    return rows


def in_order(spark, rows):
    """Rows as the operator orders equal turns: by role, then by hashes of the text."""
    texts = spark.createDataFrame([(r[3] or "",) for r in rows], "t string").distinct().select("t", F.xxhash64("t"), F.xxhash64("t", F.lit(1)))
    key = {r[0]: tuple(r[1:]) for r in texts.collect()}
    return [r[:4] for r in sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", key[r[3] or ""]))]


@pytest.mark.parametrize("height", [None, 1, 3, 5])
def test_trie_against_brute_force(spark, as_rows, height):
    rows = make_conversations(4, 60) + [(None, 1, "user", "lost", 1, "x"), (90, None, None, None, 1, "x"), (90, None, None, None, 1, "x"), (-7, 0, "user", "a", 1, "")]
    rows += [(200, turn, "user", "long way", 1, "") for turn in range(30)] + [(205, turn, "user", "long way", 1, "") for turn in range(25)]
    df = spark.createDataFrame(rows, CONVERSATION)
    members, turns = prefix_trie.rebuilt(df)
    assert as_rows(prefix_trie.trie(members, turns, height)) == brute_trie(in_order(spark, rows))


def test_trie_of_a_long_conversation_and_of_nothing(spark, as_rows):
    rows = [(c, turn, "user", f"t{turn}" * 3, 1, "") for c, n in ((0, 400), (1, 390), (2, 5)) for turn in range(n)]
    df = spark.createDataFrame(rows, CONVERSATION).repartition(8)
    assert as_rows(prefix_trie.conversation_trie(df)) == brute_trie(in_order(spark, rows))
    assert prefix_trie.conversation_trie(df.limit(0)).count() == 0


def test_digest_of_a_node_where_many_end(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "CHUNK", 200)
    ends = spark.range(5000).repartition(7).select(prefix_trie.node_key(F.lit(1), F.when(F.col("id") % 100 == 0, F.col("id")).otherwise(0)).alias("node"), F.col("id").alias("conv_id"))
    got = {r["node"]["b"]: r["ends_sha256"] for r in prefix_trie.end_digests(ends).collect()}
    want = defaultdict(list)
    for n in range(5000):
        want[n if n % 100 == 0 else 0].append(n)
    assert got == {b: hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest() for b, ids in want.items()}


# ---- cover tree


VECTORS = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.FloatType())), T.StructField("label", T.IntegerType()),
                        T.StructField("q", T.StringType()), T.StructField("cell", T.IntegerType()), T.StructField("rank", T.IntegerType())])


def brute_mining(rows):
    rows = [r for r in rows if None not in r[:3] and all(x is not None and np.isfinite(x) for x in r[1])]
    size = max((len(r[1]) for r in rows), default=0)
    q = np.array([[np.floor(256 * float(np.float32(x))) for x in r[1]] + [0] * (size - len(r[1])) for r in rows]).reshape(len(rows), size)
    ids = np.array([r[0] for r in rows], dtype=np.int64)
    label = np.array([(r[2] + 1) % 10 if r[0] % 7 == 0 else r[2] for r in rows])
    out = []
    for i in np.flatnonzero(ids % 100 == 0):
        score = (q @ q[i]).astype(np.int64)
        order = np.lexsort((ids, -score))
        for p in [j for j in order if label[j] == label[i] and j != i][:5]:
            found = [j for j in order if label[j] != label[i] and 80 * score[p] <= 100 * score[j] <= 100 * score[p]][:5]
            out += [(int(ids[i]), int(ids[p]), n + 1, int(ids[j]), int(score[p]), int(score[j])) for n, j in enumerate(found)]
    return sorted(out)


def make_vectors(seed, n, clusters, size=8):
    rng = np.random.default_rng(seed)
    middle = rng.normal(size=(clusters, size))
    rows = []
    for n in range(n):
        c = rng.integers(clusters)
        v = middle[c] + 0.1 * rng.normal(size=size) if n % 3 else middle[0]  # a third are one vector
        rows.append((n, [float(np.float32(x)) for x in v], int(c % 10), "x", 1, 1))
    odd = [(None, [1.0] * size, 1), (901, None, 1), (902, [1.0] * size, None), (903, [1.0, None], 1), (904, [1.0, NAN], 1), (905, [INF] * size, 2),
           (1000, [], 3), (1007, [2.0], 3), (1100, [-1.0] * size, 5), (1101, [1.0] * size, 5), (1200, [0.0] * size, 6), (1201, [0.0] * size, 6)]
    return rows + [(*r, "y", 2, 2) for r in odd]


@pytest.mark.parametrize("shard_rows", [4096, 40])
def test_mining_against_brute_force(spark, as_rows, shard_rows):
    rows = make_vectors(1, 700, 25)
    got = cover_tree.mine(spark.createDataFrame(rows, VECTORS).repartition(3), shard_rows)
    assert as_rows(got) == sorted(brute_mining(rows), key=repr)


def test_mining_repeated_and_no_rows(spark, as_rows):
    rows = [(100, [1.0, 0.0], 1), (100, [1.0, 0.0], 1), (101, [1.0, 0.0], 2), (102, [0.9, 0.0], 2), (103, [0.5, 0.0], 2)]
    df = spark.createDataFrame([(*r, "", 0, 0) for r in rows], VECTORS)
    assert as_rows(cover_tree.mine(df)) == [(100, 100, 1, 101, 65536, 65536)] * 2 + [(100, 100, 2, 102, 65536, 58880)] * 2
    assert cover_tree.mine(df.limit(0)).count() == 0
    assert cover_tree.mine(df.where("label = 1")).count() == 0
    assert cover_tree.mine(df.where("vec_id > 100")).count() == 0
    huge = spark.createDataFrame([(100, [3e38], 1, "", 0, 0), (101, [1.0], 1, "", 0, 0)], VECTORS)
    assert cover_tree.mine(huge).count() == 0


def test_trees_cover_their_rows_and_searches_skip_nodes():
    rng = np.random.default_rng(3)
    middle = 40 * rng.normal(size=(40, 6))
    points = np.floor(np.concatenate([middle[rng.integers(40, size=3000)] + rng.normal(size=(3000, 6)), np.ones((500, 6))]))
    norm = float((points * points).sum(axis=1).max())
    full = cover_tree.augmented(points, norm)
    order, (center, radius, child, children, start, stop) = cover_tree.build_tree(full)
    assert sorted(order.tolist()) == list(range(3500))
    for n in range(len(center)):
        below = full[order[start[n]:stop[n]]]
        assert (np.sqrt(((below - full[order[center[n]]]) ** 2).sum(axis=1)) <= radius[n] + 1e-6).all()
        if children[n]:
            assert [start[n], *[stop[c] for c in range(child[n], child[n] + children[n])]] == [start[child[n]], *[start[c] for c in range(child[n] + 1, child[n] + children[n])], stop[n]]
            assert all(radius[c] <= radius[n] * (1 + 1e-6) + 1e-6 for c in range(child[n], child[n] + children[n]))
    row = {"center": center, "radius": radius, "child": child, "children": children, "start": start, "stop": stop, "row_nos": order,
           "vec_ids": order, "labels": np.zeros(3500), "rows": points[order].astype("<i4").tobytes()}
    tree = cover_tree.Tree(row, 6)
    opened = []

    class Counting(np.ndarray):
        def __getitem__(self, at):
            opened.append(np.size(at))
            return np.asarray(self)[at]

    tree.rows = tree.rows.view(Counting)
    for i in (0, 77, 3400):
        score = points[order] @ points[i]
        high = float(np.quantile(score, 0.995))
        got = tree.search(points[i], np.ones(3500, bool), np.array([-np.inf]), np.array([high]), 5, 1e-6)
        want = np.lexsort((order, -np.where(score <= high, score, -np.inf)))[:5]
        assert got[0][2].tolist() == score[want].tolist() and tree.row_no[got[0][1]].tolist() == order[want].tolist()
    assert sum(opened) < 0.5 * 3 * 3500
