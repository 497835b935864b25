"""Statistics of one text as Column expressions; each step is a projection of its own, so that the
arrays of words and windows are built once per row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from almanac.llm.common import BLANK_RUN, whole

SYMBOLS = "#*$%&|<>"

#: Name and pattern of each character class; what no class takes is counted as the last one, "rest".
CHAR_CLASSES = [("lower", "[a-z]+"), ("upper", "[\\p{Lu}\\p{Lt}]+"), ("letter", "[\\p{Ll}\\p{Lm}\\p{Lo}&&[^a-z]]+"),
                ("digit", "\\p{N}+"), ("blank", "[\\s]+"), ("stop", "[.,;:?'\"()-]+"), ("symbol", "[!#*$%&|<>]+")]

_OFTEN = ["lower", "blank", "stop", "upper", "letter", "symbol", "digit"]


def words(text: Column) -> Column:
    return F.array_remove(F.split(text, BLANK_RUN, -1), "")


def _repeat_words(df: DataFrame, keep: list[str]) -> DataFrame:
    """Adds n_repeat_words: words inside three-word windows that the text holds twice or more; the windows of
    a text are told apart by 64-bit hashes."""
    windows = F.when(F.size("_words") >= 3, F.transform(
        F.slice("_words", 1, F.size("_words") - 2),
        lambda w, i: F.xxhash64(w, F.get("_words", i + 1), F.get("_words", i + 2))))
    df = df.select(*keep, windows.alias("_windows"))
    twice = F.size(F.array_distinct("_windows")) < F.size("_windows")
    places = F.transform("_windows", lambda w, i: F.struct(w.alias("k"), i.alias("i")))
    df = df.select(*keep, F.when(twice, F.sort_array(places)).alias("_sorted"))

    def repeated(x: Column, i: Column) -> Column:
        near = [F.get("_sorted", i - 1)["k"] == x["k"], F.get("_sorted", i + 1)["k"] == x["k"]]
        return F.coalesce(near[0], F.lit(False)) | F.coalesce(near[1], F.lit(False))

    covered = F.transform(F.filter("_sorted", repeated), lambda x: F.sequence(x["i"], x["i"] + 2))
    n = F.coalesce(F.size(F.array_distinct(F.flatten(covered))), F.lit(0))
    return df.select(*keep, F.greatest(n, F.lit(0)).cast("long").alias("n_repeat_words"))


def with_stats(df: DataFrame, text: str, keep: list[str]) -> DataFrame:
    """``keep`` and the statistics of ``text`` (null: empty text), in linear memory per row.

    n_chars, n_words, word_chars, n_distinct (words), n_symbols, n_lines, n_dup_lines, n_repeat_words
    and ``char_counts``, the characters of each class of ``CHAR_CLASSES`` and of the rest.
    """
    df = df.select(*keep, whole(F.col(text)).alias("_text"))
    df = df.select(*keep, "_text", words(F.col("_text")).alias("_words"),
                   F.filter(F.split("_text", "\n", -1), lambda line: line.rlike("[^\\x20\\x09-\\x0D]")).alias("_lines"))
    flat = {
        "n_chars": F.char_length("_text"),
        "n_words": F.size("_words"),
        "n_distinct": F.size(F.array_distinct("_words")),
        "n_lines": F.size("_lines"),
        "n_dup_lines": F.size("_lines") - F.size(F.array_distinct("_lines")),
    }
    df = df.select(*keep, "_words", "_text", *[c.cast("long").alias(name) for name, c in flat.items()])
    # no character is of two classes: each class is counted in what the ones before it have left, the most frequent first
    place, done = {name: n for n, (name, _) in enumerate(CHAR_CLASSES)}, []
    for name in sorted(place, key=_OFTEN.index):
        left = F.regexp_replace("_text", CHAR_CLASSES[place[name]][1], "")
        if name == "symbol":
            own = (F.char_length("_text") - F.char_length(F.translate("_text", SYMBOLS, ""))).cast("long")
            df = df.withColumn("n_symbols", own)
        before = ["_words", *flat, *done, *(["n_symbols"] if "n_symbols" in df.columns else [])]
        df = df.select(*keep, *before, F.char_length("_text").alias("_size"), left.alias("_text"))
        df = df.select(*keep, *before, "_text", (F.col("_size") - F.char_length("_text")).cast("long").alias(f"_n_{name}"))
        done.append(f"_n_{name}")
    # blanks between words are the white space of their class
    own = {**{name: F.col(name) for name in flat}, "n_symbols": F.col("n_symbols"), "word_chars": F.col("n_chars") - F.col("_n_blank")}
    counts = F.array(*[F.col(f"_n_{name}") for name, _ in CHAR_CLASSES], F.char_length("_text").cast("long"))
    flat = ["n_chars", "n_words", "word_chars", "n_distinct", "n_symbols", "n_lines", "n_dup_lines"]
    df = df.select(*keep, "_words", *[own[name].alias(name) for name in flat], counts.alias("char_counts"))
    df = _repeat_words(df, [*keep, *flat, "char_counts"])
    # a generated row: as plain columns, a filter on the result would pull all steps down into itself
    return df.select(F.inline(F.array(F.struct(*df.columns))))
