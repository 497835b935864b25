"""The trigram index against a scan of all names."""

import random

import pytest
from pyspark.sql import functions as F

from almanac.operators.name_index import NameIndex

NAMES = ["", "a", "ab", "RevPAR", "revenue per user", "100% owned", "under_score", "back\\slash", "Über Größe", "ÉTÉ", "İstanbul", "aaaa", "aab", "x y", " padded ",
         "Employee headcount", "employee HEADCOUNT", "head count", "💡 idea", "ßtrasse"]


@pytest.fixture(scope="module")
def index(spark, tmp_path_factory):
    found = NameIndex(spark, str(tmp_path_factory.mktemp("index") / "names"), buckets=16)
    draw = random.Random(1)
    more = ["".join(draw.choice("abc ") for _ in range(draw.randint(0, 7))) for _ in range(200)]
    frame = lambda names: spark.createDataFrame([(n,) for n in names], "name string")
    found.add(frame(NAMES + more[:100] + [None]))
    found.add(frame(more + NAMES[:5]))
    return found, sorted(set(NAMES + more)), frame(sorted(set(NAMES + more)))


TERMS = ["", "a", "ab", "abc", "REV", "revp", "e h", "%", "_", "100%", "r_v", "a%b", "\\_", "\\%", "under\\_s", "ü", "GRÖSSE", "größe", "été", "💡", "zzz", "zz", "aaaaa", " ", "  ", "head%unt"]


@pytest.mark.parametrize("wildcards", [True, False])
def test_find_equals_a_scan(spark, index, wildcards):
    found, _, frame = index
    draw = random.Random(2)
    terms = TERMS + ["".join(draw.choice("abc %_") for _ in range(draw.randint(1, 5))) for _ in range(12)]
    for term in terms:
        scan = frame.where(F.col("name").ilike(f"%{term}%")) if wildcards else frame.where(F.contains(F.lower("name"), F.lower(F.lit(term))))
        got = [r["name"] for r in found.find(term, wildcards).collect()]
        assert len(got) == len(set(got)) and sorted(got) == sorted(r["name"] for r in scan.collect()), term


def test_only_the_lists_asked_for_are_read(index):
    found, names, _ = index
    buckets = {str(r[0]) for r in found._keys(["hea", "ead", "adc"]).select(found.lists.bucket_of()).collect()}
    files = [f for f in found.candidates("headc").inputFiles() if "/lists/" in f]
    assert files and {f.split("_bucket=")[1].split("/")[0] for f in files} <= buckets
    assert found.candidates("headcxyz").inputFiles() == []
    assert found.candidates("headcount").count() == 2
    every = {f.split("_bucket=")[1].split("/")[0] for f in found.lists.read().inputFiles()}
    assert len(every) > 10 > len(buckets)


def test_names_are_listed_once(index):
    found, names, _ = index
    assert sorted(r["name"] for r in found.names.read().collect()) == names
    rows = [tuple(r) for r in found.lists.read().collect()]
    assert len(rows) == len(set(rows))
    assert {r["gram"]: r["names"] for r in found.sizes.read().collect()} == {g: len({n for h, n in rows if h == g}) for g, _ in rows}
