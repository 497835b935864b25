"""Keyword-dense chunks of long documents, computed inside each document's row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from almanac import dims, fixed
from almanac.functions.text import keyword_score


def _starts(text: Column, step: int) -> Column:
    """0-based chunk starts over the whole text; empty for an empty text."""
    return F.when(F.length(text) > 0, F.sequence(F.lit(0), F.length(text) - 1, F.lit(step))) \
            .otherwise(F.array().cast("array<int>"))


def doc_chunks(documents: DataFrame, size: int = fixed.CHUNK_SIZE,
               step: int = fixed.CHUNK_STEP) -> DataFrame:
    """Overlapping chunks (chunk_no, start, chunk) covering every document."""
    others = [c for c in documents.columns if c != "text"]
    cut = F.transform(_starts(F.col("text"), step), lambda start: F.struct(
        start.alias("start"), F.substring("text", start + 1, F.lit(size)).alias("chunk")))
    return (documents.select(*others, F.posexplode(cut).alias("chunk_no", "cut"))
            .select(*others, "chunk_no", "cut.start", "cut.chunk"))


def chunk_scores(documents: DataFrame, keywords: str = "keywords", size: int = fixed.CHUNK_SIZE,
                 step: int = fixed.CHUNK_STEP) -> DataFrame:
    """Chunks that mention a keyword of their document's list, with the score."""
    chunks = doc_chunks(documents, size, step)
    return chunks.withColumn("score", keyword_score(F.col("chunk"), F.col(keywords))) \
                 .filter(F.col("score") > 0).drop(keywords)


def top_chunks(documents: DataFrame, keywords: str = "keywords", limit: int = fixed.MAX_CHUNKS,
               size: int = fixed.CHUNK_SIZE, step: int = fixed.CHUNK_STEP) -> DataFrame:
    """The best chunks per document: score descending, the earlier chunk on ties.

    Scoring, sorting and cutting happen in an array inside the document's own row, so no text is
    shuffled; only the chosen chunks are cut out of the text.
    """
    others = [c for c in documents.columns if c not in ("text", keywords)]
    scored = F.transform(_starts(F.col("text"), step), lambda start: F.struct(
        (-keyword_score(F.substring("text", start + 1, F.lit(size)), F.col(keywords))).alias("rank_key"),
        start.alias("start")))
    best = F.slice(F.array_sort(F.filter(scored, lambda c: c["rank_key"] < 0)), 1, limit)
    return (documents
            .select(*others, "text", F.posexplode(best).alias("place", "pick"))
            .select(*others, (F.col("place") + 1).alias("place"), F.col("pick.start").alias("start"),
                    (-F.col("pick.rank_key")).alias("score"),
                    F.substring("text", F.col("pick.start") + 1, F.lit(size)).alias("chunk")))


def sector_kpis(companies: DataFrame) -> DataFrame:
    """KPI targets of every company: those of its sector, then the generic ones."""
    targets = dims.kpi_targets(companies.sparkSession)
    own = targets.filter(F.col("sector").isNotNull()).groupBy("sector").agg(
        F.sort_array(F.collect_list(F.struct("position", "label", "keywords"))).alias("own"))
    generic = [F.struct(F.lit(100 + n).alias("position"), F.lit(label).alias("label"),
                        F.array(*[F.lit(w) for w in words]).alias("keywords"))
               for n, (label, words) in enumerate(fixed.GENERIC_KPIS.items())]
    joined = companies.join(F.broadcast(own), "sector", "left")
    every = F.concat(F.coalesce("own", F.array().cast(own.schema["own"].dataType)), F.array(*generic))
    return joined.select("id", "ticker", "sector", F.posexplode(every).alias("target_no", "target")) \
                 .select("id", "ticker", "sector", "target_no", "target.label", "target.keywords")
