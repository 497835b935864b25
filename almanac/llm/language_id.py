"""Language identification: sparse multinomial logistic regression on TF-IDF of hashed character n-grams.

Document frequencies are counted over all rows that may be learned from, in the tasks that read them;
the weights are fitted by follow-the-regularised-leader with an elastic net on a bounded sample of rows
for each language, and a temperature fitted on rows of the sample that the weights never saw turns
scores into probabilities. Predicting is one pass over the texts without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from almanac.llm.common import in_slices, map_arrow

ORDERS = (1, 2, 3)
BITS = 16
#: Rows of each language that weights and temperature are fitted on; every fifth is for the temperature.
SAMPLE_ROWS = 1000
HOLD = 5
MAX_LANGUAGES = 256
EPOCHS, ALPHA, BETA, L1, L2 = 4, 0.5, 1.0, 0.02, 0.001
SCALE = 8.0
UNKNOWN = "und"

_PRIME = np.uint64(0x9E3779B97F4A7C15)


@lru_cache(1)
def _letters() -> np.ndarray:
    """Whether each code point is a letter."""
    return np.array([chr(c).isalpha() for c in range(0x110000)])


def grams(text: str | None) -> np.ndarray:
    """Hashed n-grams of a text in lower case, in which each run of other than letters is one space;
    empty for a text without letters."""
    codes = np.frombuffer((text or "").lower().encode("utf-32-le", "replace"), np.uint32)
    letter = _letters()[codes]
    if not letter.any():
        return np.zeros(0, np.uint32)
    codes = np.where(letter, codes, 32).astype(np.uint64)
    keep = np.concatenate([[True], letter[1:] | letter[:-1]])
    codes = np.concatenate([[np.uint64(32)], codes[keep], [np.uint64(32)]])
    found = []
    for order in ORDERS:
        n = len(codes) - order + 1
        mixed = np.full(max(n, 0), order, np.uint64)
        for i in range(order):
            mixed = (mixed + codes[i:i + n]) * _PRIME
            mixed ^= mixed >> np.uint64(29)
        found.append(((mixed * _PRIME) >> np.uint64(64 - BITS)).astype(np.uint32))
    return np.concatenate(found)


@dataclass(frozen=True)
class Model:
    languages: tuple[str, ...]
    table: np.ndarray  # weight times inverse document frequency of each n-gram and language
    bias: np.ndarray
    temperature: float


def _document_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per n-gram a task has seen: in how many of its texts; the number of texts is n-gram -1."""
    counts, n = np.zeros(1 << BITS, np.int64), 0
    for batch in in_slices(batches, "text"):
        for text in batch.column(0).to_pylist():
            seen = np.zeros(1 << BITS, bool)
            seen[grams(text)] = True
            counts += seen
            n += 1
    hit = np.flatnonzero(counts)
    yield pa.RecordBatch.from_arrays([pa.array(np.append(hit, -1), pa.int64()), pa.array(np.append(counts[hit], n), pa.int64())],
                                     names=["gram", "n"])


def document_frequencies(docs: DataFrame, text: str = "text") -> tuple[np.ndarray, int]:
    """In how many texts each of the ``2 ** BITS`` hashed n-grams occurs, and the number of texts."""
    rows = docs.select(F.col(text).cast("string").alias("text")).mapInArrow(_document_counts, "gram long, n long")
    counts, total = np.zeros(1 << BITS, np.int64), 0
    for gram, n in rows.groupBy("gram").agg(F.sum("n").alias("n")).toPandas().itertuples(index=False):
        if gram < 0:
            total = int(n)
        else:
            counts[int(gram)] = n
    return counts, total


def _sparse(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    which, counts = [], []
    for text in batch.column(2).to_pylist():
        own, n = np.unique(grams(text), return_counts=True)
        which.append(own.astype("<u4").tobytes())
        counts.append(n.astype("<u4").tobytes())
    yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(which, pa.binary()), pa.array(counts, pa.binary())],
                                     names=["doc_id", "lang", "grams", "counts"])


def _softmax(scores: np.ndarray) -> np.ndarray:
    e = np.exp(scores - scores.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def fit_weights(rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, n_classes: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Weights (size, classes) and bias by FTRL-Proximal; rows are (n-grams, values)."""
    z, n = np.zeros((size + 1, n_classes)), np.zeros((size + 1, n_classes))

    def weights(at):
        own = z[at]
        return np.where(np.abs(own) <= L1, 0.0, -(own - np.sign(own) * L1) / ((BETA + np.sqrt(n[at])) / ALPHA + L2))

    order = np.random.default_rng(11)
    for _ in range(EPOCHS):
        for i in order.permutation(len(rows)):
            at, x = np.append(rows[i][0], size), np.append(rows[i][1], 1.0)
            w = weights(at)
            off = _softmax(x @ w)
            off[y[i]] -= 1
            g = x[:, None] * off[None, :]
            sigma = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / ALPHA
            z[at] += g - sigma * w
            n[at] += g * g
    every = weights(np.arange(size + 1))
    return every[:-1], every[-1]


def fit_temperature(scores: np.ndarray, y: np.ndarray) -> float:
    """The temperature with the least log loss, on a grid."""
    if not len(y):
        return 1.0
    grid = np.exp(np.linspace(np.log(0.1), np.log(10), 200))
    losses = [-np.log(np.maximum(_softmax(scores / t)[np.arange(len(y)), y], 1e-12)).mean() for t in grid]
    return float(grid[int(np.argmin(losses))])


def sampled_ids(docs: DataFrame, sample_rows: int) -> DataFrame:
    """The ``sample_rows`` (doc_id, lang) of each language with the smallest hashes, or all, if fewer.

    Languages are counted first; only rows whose hash lies below about twice the share that is wanted are
    ranked, so that a language's window holds some 2 * ``sample_rows`` rows whatever the input.
    """
    held = docs.groupBy("lang").agg(F.count("*").alias("n")).limit(MAX_LANGUAGES + 1).collect()
    if len(held) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    place, limit = F.xxhash64("doc_id", "lang"), F.lit(None).cast("long")
    for row in held:
        share = min(1.0, (2 * sample_rows + 100) / row["n"])
        limit = F.when(F.col("lang") == row["lang"], F.lit(min(int(share * (1 << 64)) - (1 << 63), (1 << 63) - 1))).otherwise(limit)
    few = docs.select("doc_id", "lang").where(place <= limit).distinct()
    by_hash = Window.partitionBy("lang").orderBy(place, "doc_id")
    return few.withColumn("place", F.row_number().over(by_hash)).where(F.col("place") <= sample_rows).select("doc_id", "lang")


def train(docs: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Model:
    """Fits on ``docs`` (doc_id, text, lang); rows without a lang are not learned from."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"),
                       F.col("lang").cast("string").alias("lang")).where("lang is not null")
    frequency, total = document_frequencies(docs)
    idf = np.log((1 + total) / (1 + frequency)) + 1
    picked = sampled_ids(docs, sample_rows).select(F.col("doc_id").alias("_id"), F.col("lang").alias("_lang"))
    own = docs.join(F.broadcast(picked), (F.col("doc_id") == F.col("_id")) & (F.col("lang") == F.col("_lang"))).select("doc_id", "lang", "text")
    rows = map_arrow(own, _sparse, "doc_id long, lang string, grams binary, counts binary", "text").toPandas()
    rows = rows.sort_values(["doc_id", "lang", "grams"], kind="stable")
    languages = tuple(sorted(rows["lang"].unique()))
    if not languages:
        return Model((), np.zeros((1 << BITS, 0), np.float32), np.zeros(0), 1.0)
    sparse, y = [], []
    for lang, which, counts in zip(rows["lang"], rows["grams"], rows["counts"]):
        at, n = np.frombuffer(which, "<u4"), np.frombuffer(counts, "<u4")
        if len(at):
            sparse.append((at.astype(np.int64), SCALE * n / n.sum() * idf[at]))
            y.append(languages.index(lang))
    y = np.array(y, dtype=np.int64)
    fitted = np.arange(len(y)) % HOLD != 0
    weights, bias = fit_weights([r for r, f in zip(sparse, fitted) if f], y[fitted], len(languages), 1 << BITS)
    scores = np.array([r[1] @ weights[r[0]] + bias for r, f in zip(sparse, fitted) if not f]).reshape(-1, len(languages))
    return Model(languages, (SCALE * weights * idf[:, None]).astype(np.float32), bias, fit_temperature(scores, y[~fitted]))


def probabilities(model: Model, text: str | None) -> np.ndarray | None:
    """Of each language; None for a text without letters."""
    own = grams(text)
    if not len(own) or not model.languages:
        return None
    return _softmax((model.table[own].sum(axis=0, dtype=np.float64) / len(own) + model.bias) / model.temperature)


def _predict(batch: pa.RecordBatch, model: Model) -> Iterator[pa.RecordBatch]:
    langs, scores = [], []
    for text in batch.column(2).to_pylist():
        p = probabilities(model, text)
        langs.append(UNKNOWN if p is None else model.languages[int(np.argmax(p))])
        scores.append(0.0 if p is None else float(p.max()))
    yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(langs), pa.array(scores)],
                                     names=["doc_id", "held_out", "lang_pred", "score"])


def identify(docs: DataFrame, model: Model, held_out=None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out (as given, else false), lang_pred, score.

    Texts that are null or without a letter are ``und`` with score 0. Other columns are not read.
    """
    flag = F.lit(False) if held_out is None else held_out
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), flag.alias("held_out"), F.col(text).cast("string").alias("text"))
    return map_arrow(rows, partial(_predict, model=model), "doc_id long, held_out boolean, lang_pred string, score double", "text")
