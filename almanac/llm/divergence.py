"""Quality rules by distribution divergence: character classes and common words of a document against
those of its language, by Jensen-Shannon distance. DataFrame functions only.

The references are counted per value of the language column over all documents that pass the base
rules, and a language's common words are those in most of its documents. Languages of fewer than
``MIN_DOCS`` such documents have no reference, and their documents, like those without a language, are
judged by the base rules only. There is a row of words and of references per language, so they are
broadcast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from almanac.llm.common import saved, whole
from almanac.llm.text_stats import CHAR_CLASSES, with_stats

#: Words counted apart in each language; they stand in one of ``RARE`` of its documents at least.
N_COMMON = 17
RARE = 20
#: Least number of documents that make a reference.
MIN_DOCS = 10

MIN_WORDS = 50
MIN_CHARS = 200
#: Largest distances of a kept document: what is allowed at any length, and what sampling adds at n items.
MAX_CHAR_JS, CHAR_NOISE = 0.16, 1.0
MAX_WORD_JS, WORD_NOISE = 0.35, 0.5


def js_distance(p: Column, q: Column) -> Column:
    """Square root of the Jensen-Shannon divergence (base 2) of two arrays of shares, 0 to 1."""
    def part(a: Column, b: Column) -> Column:
        return F.when(a > 0, a * F.log2(2 * a / (a + b))).otherwise(F.lit(0.0))

    parts = F.zip_with(p, q, lambda a, b: (part(a, b) + part(b, a)) / 2)
    total = F.aggregate(parts, F.lit(0.0), lambda s, x: s + x)
    return F.sqrt(F.greatest(total, F.lit(0.0)))


def _shares(counts: Column) -> Column:
    total = F.aggregate(counts, F.lit(0).cast("long"), lambda s, x: s + x)
    return F.when(total > 0, F.transform(counts, lambda x: x / total))


def _letter_words(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(whole(text)), "[^\\p{L}]+", -1), "")


def common_words(docs: DataFrame, text: str, lang: str) -> DataFrame:
    """(lang_key, listed) of each language: the words in most of its documents, filled up with empty ones.

    Counts are partial before their shuffle; a document counts once for a word. Only words that are not
    rare, a bounded number of each language, are ranked.
    """
    words = docs.select(F.col(lang).cast("string").alias("lang_key"), _letter_words(F.col(text)).alias("_letters"))
    words = words.where(F.col("lang_key").isNotNull() & (F.size("_letters") >= MIN_WORDS))
    # the empty word counts the documents
    words = words.select("lang_key", F.explode(F.array_append(F.array_distinct("_letters"), "")).alias("word"))
    counts = saved(words.groupBy("lang_key", "word").count(), "words")
    n_docs = counts.where("word = ''").select("lang_key", F.col("count").alias("n_docs"))
    rows = counts.where("word <> ''").join(F.broadcast(n_docs), "lang_key").where(F.col("count") * RARE >= F.col("n_docs"))
    rank = F.row_number().over(Window.partitionBy("lang_key").orderBy(F.desc("count"), "word"))
    rows = rows.withColumn("rank", rank).where(F.col("rank") <= N_COMMON)
    found = F.transform(F.sort_array(F.collect_list(F.struct("rank", "word"))), lambda x: x["word"])
    fill = F.array_repeat(F.lit(""), N_COMMON)
    return rows.groupBy("lang_key").agg(F.slice(F.concat(found, fill), 1, N_COMMON).alias("listed"))


def measures(docs: DataFrame, doc_id: str, text: str, lang: str) -> DataFrame:
    """Base statistics and both histograms of each document (word_counts: common words of its language,
    then all others)."""
    listed = saved(common_words(docs, text, lang), "common")
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(lang).cast("string").alias("lang_key"), F.col(text).alias("_body"))
    rows = rows.join(F.broadcast(listed), "lang_key", "left")
    fill = F.array_repeat(F.lit(""), N_COMMON)
    rows = rows.select("doc_id", "lang_key", "_body", F.coalesce("listed", fill).alias("_listed"), _letter_words(F.col("_body")).alias("_letters"))
    rows = rows.select("doc_id", "lang_key", "_body", "_listed", F.size("_letters").cast("long").alias("n_letter_words"),
                       F.filter("_letters", lambda w: F.array_contains("_listed", w)).alias("_common"))
    counts = F.transform("_listed", lambda w: (F.size("_common") - F.size(F.array_remove("_common", w))).cast("long"))
    rows = rows.select("doc_id", "lang_key", "_body", "n_letter_words", counts.alias("_counts"))
    rest = F.col("n_letter_words") - F.aggregate("_counts", F.lit(0).cast("long"), lambda s, x: s + x)
    rows = rows.select("doc_id", "lang_key", "_body", F.concat("_counts", F.array(rest)).alias("word_counts"))
    rows = with_stats(rows, "_body", ["doc_id", "lang_key", "word_counts"])
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return rows.withColumn("base_failed", failed)


def _typical(column: str, size: int) -> Column:
    """The median share of each item, brought to a sum of one: junk among the documents hardly moves it."""
    shares = _shares(F.col(column))
    return F.array(*[F.coalesce(F.percentile_approx(F.get(shares, F.lit(n)), 0.5, 10000), F.lit(0.0)) for n in range(size)])


def _normal(shares: Column) -> Column:
    total = F.aggregate(shares, F.lit(0.0), lambda s, x: s + x)
    return F.when(total > 0, F.transform(shares, lambda x: x / total))


def references(rows: DataFrame) -> DataFrame:
    """Shares of each character class and common word per language, over rows that pass the base rules."""
    sums = [_typical("char_counts", len(CHAR_CLASSES) + 1).alias("c"), _typical("word_counts", N_COMMON + 1).alias("w")]
    good = rows.where(~F.col("base_failed") & F.col("lang_key").isNotNull())
    refs = good.groupBy("lang_key").agg(F.count("*").alias("n_docs"), *sums).where(F.col("n_docs") >= MIN_DOCS)
    return refs.select("lang_key", _normal(F.col("c")).alias("char_ref"), _normal(F.col("w")).alias("word_ref"))


def judge(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang",
          max_char_js: float = MAX_CHAR_JS, max_word_js: float = MAX_WORD_JS) -> DataFrame:
    """One row per document: base statistics, base_failed, both distances, kept.

    A distance is null, and doesn't count, where the text is below a minimum length or no reference
    exists. Null texts count as empty (base_failed). Repeated rows are judged each; other columns are not read.
    """
    rows = saved(measures(docs, doc_id, text, lang), "measures")
    refs = saved(references(rows), "references")
    rows = rows.join(F.broadcast(refs), "lang_key", "left")
    n_letter_words = F.aggregate("word_counts", F.lit(0).cast("long"), lambda s, x: s + x)
    rows = rows.withColumn("n_letter_words", n_letter_words)
    char_js = F.when((F.col("n_chars") >= MIN_CHARS) & F.col("char_ref").isNotNull(), js_distance(_shares(F.col("char_counts")), F.col("char_ref")))
    word_js = F.when((F.col("n_letter_words") >= MIN_WORDS) & F.col("word_ref").isNotNull(), js_distance(_shares(F.col("word_counts")), F.col("word_ref")))
    rows = rows.withColumn("char_js", char_js).withColumn("word_js", word_js)
    far = (F.coalesce(F.col("char_js") > max_char_js + CHAR_NOISE / F.sqrt("n_chars"), F.lit(False))
           | F.coalesce(F.col("word_js") > max_word_js + WORD_NOISE / F.sqrt("n_letter_words"), F.lit(False)))
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
                       (~F.col("base_failed") & ~far).alias("kept"), "char_js", "word_js")
