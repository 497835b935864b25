"""Registered queries against their SQL, and the pipeline against its parts."""

import pytest

import corpus_pipeline
from almanac.llm import exact_dedup, jaccard_join, packing, queries, rule_ensemble, substring_dedup
from almanac.llm.common import drop_scratch, scratch_root
from check import connect, normal

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", list(queries.ORACLE))
def test_query_equals_its_sql(spark, name):
    with connect(SF) as con:
        df = queries.QUERIES[name](spark, SF)
        cur = con.execute(queries.ORACLE[name])
        columns = [d[0] for d in cur.description]
        assert sorted(columns) == sorted(df.columns)
        assert normal([tuple(r) for r in df.collect()], df.columns) == normal(cur.fetchall(), columns)


@pytest.mark.parametrize("name", [n for n in queries.QUERIES if n not in queries.ORACLE])
def test_query_has_a_row_for_each_document(spark, name):
    ids = {r[0] for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id").collect()}
    assert {r["doc_id"] for r in queries.QUERIES[name](spark, SF).select("doc_id").collect()} == ids


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = rule_ensemble.train(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    want = substring_dedup.remove_repeats(jaccard_join.drop_similar(exact_dedup.drop_copies(rule_ensemble.drop_low_quality(docs, model))))
    want = packing.token_pieces(want).select("doc_id", "piece", "start", "length", "ids_crc32")
    got = corpus_pipeline.run(spark, SF)
    assert sorted(map(tuple, got.drop("sequence_id", "offset").collect())) == sorted(map(tuple, want.collect()))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"], name


def test_scratch_can_be_dropped(spark):
    queries.op6_exact_dedup(spark, SF).count()
    path = spark._jvm.org.apache.hadoop.fs.Path(scratch_root(spark))
    files = path.getFileSystem(spark._jsc.hadoopConfiguration())
    assert files.exists(path)
    drop_scratch(spark)
    assert not files.exists(path)
