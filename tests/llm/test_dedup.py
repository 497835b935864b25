"""Exact dedup, the Jaccard join and substring dedup against plain Python."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from almanac.llm import exact_dedup, jaccard_join, substring_dedup
from almanac.llm.components import components


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def order(doc_id):
    return (doc_id is not None, doc_id or 0)


def words(text):
    return (text or "").encode().split()


@pytest.mark.parametrize("bits", [64, 1 << 24])
def test_exact_groups(docs, rows, as_rows, bits):
    groups = defaultdict(list)
    for row in rows:
        groups[row[1] or ""].append(row[0])
    want = []
    for text, ids in groups.items():
        ids.sort(key=order)
        want += [(i, ids[-1], len(ids), n == len(ids) - 1, sha(text)) for n, i in enumerate(ids)]
    assert as_rows(exact_dedup.exact_groups(docs, bits=bits)) == sorted(want, key=repr)


@pytest.mark.parametrize("bits", [64, 1 << 24])
def test_drop_copies(docs, rows, bits):
    left = exact_dedup.drop_copies(docs, bits=bits)
    assert left.columns == docs.columns
    best = {}
    for row in rows:
        key = row[1] or ""
        if key not in best or order(row[0]) > order(best[key][0]):
            best[key] = row
    assert sorted(((r["doc_id"], r["text"] or "") for r in left.collect()), key=repr) == sorted(((r[0], k) for k, r in best.items()), key=repr)


def grams(text, size=5):
    own = words(text)
    return {tuple(own[i:i + size]) for i in range(max(1, len(own) - size + 1))} if own else set()


def similar(rows, threshold=0.8):
    """Class, number of links and group of each text."""
    first = {}
    for row in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        first.setdefault(row[1] or "", row[0])
    texts = list(first)
    sets = {t: grams(t) for t in texts}
    near, label = defaultdict(set), {t: t for t in texts}
    for n, a in enumerate(texts):
        for b in texts[:n]:
            both = len(sets[a] & sets[b])
            if both and both >= threshold * len(sets[a] | sets[b]):
                near[a].add(b)
                near[b].add(a)
    changed = True
    while changed:
        changed = False
        for a in texts:
            low = min([label[a], *[label[b] for b in near[a]]], key=texts.index)
            changed |= low != label[a]
            label[a] = low
    groups = defaultdict(list)
    for t in texts:
        groups[label[t]].append(t)
    lowest = {t: min((first[x] for x in groups[label[t]]), key=lambda i: (i is None, i or 0)) for t in texts}
    return first, near, lowest


@pytest.mark.parametrize("rows_", [300, 100_000])
def test_few_unique_rows_pass_the_filter(spark, rows_):
    """Whatever the number of rows: the filter grows with it."""
    digests = spark.range(rows_).select(F.unhex(F.sha2(F.col("id").cast("string"), 256)).alias("digest"))
    bits = exact_dedup.filter_bits(rows_)
    assert 16 * rows_ <= bits <= 32 * rows_ or bits == exact_dedup.LEAST_BITS
    words = exact_dedup.repeated_words(digests, bits)
    assert exact_dedup.flag_repeated(digests, words, bits).where("maybe").count() < 0.05 * rows_
    both = digests.unionByName(digests.limit(50))
    assert exact_dedup.flag_repeated(both, exact_dedup.repeated_words(both, bits), bits).where("maybe").count() >= 100
    assert exact_dedup.maybe_among(digests, digests.limit(rows_ // 10)).where("maybe").count() < 0.2 * rows_


@pytest.mark.parametrize("tile,grams", [(2, 2_000_000), (512, 2_000_000), (512, 300)])
def test_similar_documents(docs, rows, as_rows, tile, grams):
    first, near, lowest = similar(rows)
    want = [(r[0], first[t], len(near[t]), lowest[t]) for r in rows for t in [r[1] or ""]]
    assert any(w[2] > 5 for w in want)
    assert as_rows(jaccard_join.similar_documents(docs, tile=tile, tile_grams=grams)) == sorted(want, key=repr)


def test_recall_against_all_pairs(spark):
    """Every pair of different texts, by one incidence matrix: documents, and copies with changed words."""
    draw, rows = random.Random(4), [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").limit(600).collect()]
    for doc_id, text in rows[:400]:
        own = (text or "").split()
        for at in draw.sample(range(len(own)), len(own) * draw.randint(1, 3) // 100):
            own[at] = "changed"
        rows.append((doc_id + 100_000, " ".join(own)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    texts = sorted({r[1] or "" for r in rows})
    sets = [np.unique(jaccard_join.shingles(jaccard_join.word_hashes(t.encode().split(), len(t.split())), 5)) for t in texts]
    sizes = np.array([len(s) for s in sets])
    names, column = np.unique(np.concatenate(sets), return_inverse=True)
    owner = np.repeat(np.arange(len(sets)), sizes)
    common = np.zeros((len(sets), len(sets)))
    often = np.bincount(column)[column] > 1
    column, owner = np.unique(column[often], return_inverse=True)[1], owner[often]
    for low in range(0, column.max() + 1, 4096):
        block = np.zeros((len(sets), 4096), np.float32)
        inside = (column >= low) & (column < low + 4096)
        block[owner[inside], column[inside] - low] = 1
        common += block @ block.T
    np.fill_diagonal(common, 0)
    near = (common >= 0.8 * (sizes[:, None] + sizes[None, :] - common)) & (common > 0)
    found = {r["text"] or "": r["n_links"] for r in docs.join(jaccard_join.similar_documents(docs), "doc_id").collect()}
    got, want = sum(found[t] for t in texts), near.sum()
    assert want > 100 and 0.99 * want <= got <= want
    assert all(found[t] <= n for t, n in zip(texts, near.sum(axis=0)))


def test_drop_similar(docs, rows):
    first, _, lowest = similar(rows)
    left = jaccard_join.drop_similar(docs)
    assert left.columns == docs.columns
    got = [(r["doc_id"], r["text"] or "") for r in left.collect()]
    assert len(got) == len(set(got))
    assert sorted(got, key=repr) == sorted(((i, t) for t, i in first.items() if lowest[t] == i), key=repr)


def test_bands_reach_the_recall():
    for threshold, recall in ((0.8, 0.9999), (0.5, 0.99), (0.9, 0.999)):
        bands, size = jaccard_join.choose_bands(threshold, recall, 512)
        assert bands * size <= 512 and 1 - (1 - threshold**size)**bands >= recall
    with pytest.raises(ValueError):
        jaccard_join.choose_bands(0.1, 0.9999, 4)


def test_components(spark):
    edges = [(n + 1, n) for n in range(40)] + [(100, 200), (200, 300), (300, 100)] + [(500, 500 + n) for n in range(1, 30)]
    got = {r["node"]: r["label"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{n: 0 for n in range(41)}, **{n: 100 for n in (100, 200, 300)}, **{n: 500 for n in range(500, 530)}}


def removed(rows, window):
    counts = Counter(tuple(w[i:i + window]) for r in rows for w in [words(r[1])] for i in range(len(w) - window + 1))
    out = []
    for row in rows:
        own = words(row[1])
        keep = [True] * len(own)
        for i in range(len(own) - window + 1):
            if counts[tuple(own[i:i + window])] > 1:
                keep[i:i + window] = [False] * window
        out.append([w for w, k in zip(own, keep) if k])
    return out


@pytest.mark.parametrize("window,strings", [(35, 1000), (35, 1), (12, 1000)])
def test_substring_report(docs, rows, as_rows, window, strings):
    want = [(r[0], len(words(r[1])), len(words(r[1])) - len(k), hashlib.sha256(b" ".join(k)).hexdigest())
            for r, k in zip(rows, removed(rows, window))]
    assert any(0 < w[2] < w[1] for w in want)
    assert as_rows(substring_dedup.report(docs, window=window, bucket_strings=strings)) == sorted(want, key=repr)


JOINS = {"autoBroadcastJoinThreshold": "-1", "adaptive.skewJoin.skewedPartitionThresholdInBytes": "1k", "adaptive.skewJoin.skewedPartitionFactor": "1.01",
         "adaptive.advisoryPartitionSizeInBytes": "4k", "adaptive.coalescePartitions.enabled": "false"}
LATE = {"autoBroadcastJoinThreshold": "1", "adaptive.autoBroadcastJoinThreshold": "10m", "adaptive.nonEmptyPartitionRatioForBroadcastJoin": "0",
        "adaptive.coalescePartitions.enabled": "false"}


@pytest.mark.parametrize("settings", [JOINS, LATE])
def test_buckets_stay_whole(spark, as_rows, settings):
    """Strings of one minimiser meet in one task, also where joins are split or turned into broadcasts at run time."""
    draw = random.Random(5)
    passages = [" ".join(draw.choice("abcdefgh") * 3 for _ in range(45)) for _ in range(60)]
    hot = " ".join(f"hot{n}" for n in range(45))
    rows = [(n, f"{n} {passages[n % 60]} {draw.random()} {passages[draw.randrange(60)]} " + (f"{hot} {draw.random()}" if n % 5 == 0 else ""))
            for n in range(600)]
    rows = [(n, text[draw.randrange(40):]) for n, text in rows]
    want = [(n, len(words(t)), len(words(t)) - len(k), hashlib.sha256(b" ".join(k)).hexdigest())
            for (n, t), k in zip(rows, removed(rows, 35))]
    settings = {f"spark.sql.{k}": v for k, v in settings.items()}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(8)
        assert as_rows(substring_dedup.report(docs, bucket_strings=50)) == sorted(want, key=repr)
    finally:
        for k in settings:
            spark.conf.unset(k)


def test_remove_repeats(docs, rows, as_rows):
    want = []
    for row, kept in zip(rows, removed(rows, 35)):
        text = row[1] if len(kept) == len(words(row[1])) else b" ".join(kept).decode()
        want.append((row[0], text, *row[2:]))
    left = substring_dedup.remove_repeats(docs)
    assert left.columns == docs.columns
    assert as_rows(left) == sorted(want, key=repr)


def test_empty_tables(nothing):
    assert exact_dedup.exact_groups(nothing).count() == 0
    assert exact_dedup.drop_copies(nothing).count() == 0
    assert jaccard_join.similar_documents(nothing).count() == 0
    assert jaccard_join.drop_similar(nothing).count() == 0
    assert substring_dedup.report(nothing).count() == 0
    assert substring_dedup.remove_repeats(nothing).count() == 0
