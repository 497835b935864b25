"""The corpus pipeline: from raw documents to packed training sequences, stage by stage.

Each stage gets what its predecessor kept; ``run`` writes every stage's rows as Parquet into the shared
folder and reads them again, so a lost executor never costs more than the running stage.

Null texts count as empty in every stage, and stay null where they stay. Rows with a null doc_id take part
like others: of equal texts one with an id stays before one without. Rows equal in doc_id and text are one
row after exact dedup. Empty tables give empty results; further columns, whatever their names, come
through all stages but the last.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from almanac.llm import exact_dedup, jaccard_join, packing, rule_ensemble, substring_dedup
from almanac.llm.common import saved, table


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go. It is fitted on the labelled documents of ``sf_dir``; without
    labels of both classes, or where nothing tells them apart, all documents have one score."""
    model = rule_ensemble.train(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return rule_ensemble.drop_low_quality(docs, model)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest doc_id stays."""
    return exact_dedup.drop_copies(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of similar texts stays, that with the smallest doc_id."""
    return jaccard_join.drop_similar(docs)


def substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated passages go from the texts; all rows stay, and n_chars follows its text."""
    short = substring_dedup.remove_repeats(docs)
    return short.withColumn("n_chars", F.char_length("text").cast("long")) if "n_chars" in docs.columns else short


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces and their places in the training sequences."""
    return packing.pack_documents(docs).select(
        "doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


STAGES = [("quality_classifier", quality_classifier), ("exact_dedup", exact), ("jaccard_join", near_duplicates),
          ("substring_dedup", substrings), ("packing", packed)]

#: No SQL: the classifier, the banding and the tokenizer have none.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = saved(stage(spark, docs, sf_dir), name)
    return docs
