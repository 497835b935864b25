"""Quality classifier: a sparse ensemble of rules over text statistics.

Shallow boosted trees are grown on a bounded sample of labelled rows; every path from a root to a node
is a conjunctive rule. A lasso-penalised logistic fit keeps few rules, which are compiled into one
Column expression, so that scoring is a projection without Python.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from almanac.llm.text_stats import CHAR_CLASSES, with_stats

#: Most labelled rows of each class that the classifier is fitted on.
SAMPLE_ROWS = 6000
TREES, DEPTH, BINS, RATE = 24, 3, 48, 0.3
PENALTY, STEPS = 0.002, 400

#: Statistics that rules ask about, from the columns of ``with_stats``; 0 where a text has none.
FEATURES: dict[str, tuple[str, str]] = {
    "words": ("n_words", ""), "word_length": ("word_chars", "n_words"), "distinct_words": ("n_distinct", "n_words"),
    "repeated_words": ("n_repeat_words", "n_words"), "repeated_lines": ("n_dup_lines", "n_lines"),
    "line_length": ("n_words", "n_lines"), "symbols": ("n_symbols", "n_words"),
    **{name: (f"char_counts[{n}]", "n_chars") for n, name in enumerate([c for c, _ in CHAR_CLASSES] + ["rest"])},
}


@dataclass(frozen=True)
class Rule:
    """All of ``(feature, above, threshold)`` hold: the feature is above the threshold, or not."""

    terms: tuple[tuple[int, bool, float], ...]


@dataclass(frozen=True)
class Model:
    rules: tuple[Rule, ...]
    weights: tuple[float, ...]
    intercept: float


def with_features(df: DataFrame, text: str, keep: list[str]) -> DataFrame:
    """``keep`` and the array ``features``, over whole texts; null and empty texts give zeros."""
    df = with_stats(df, text, keep)
    values = []
    for top, bottom in FEATURES.values():
        value = F.expr(top).cast("double")
        if bottom:
            value = F.when(F.col(bottom) > 0, value / F.col(bottom)).otherwise(F.lit(0.0))
        values.append(value)
    return df.select(*keep, F.array(*values).alias("features"))


def _grow(binned: np.ndarray, edges: list[np.ndarray], grad: np.ndarray, hess: np.ndarray, rows: np.ndarray,
          path: tuple, found: list, fit: np.ndarray) -> None:
    """Splits a node where the boosting gain is largest; adds the paths of all nodes to ``found``."""
    if path:
        found.append(path)
    g, h = grad[rows].sum(), hess[rows].sum()
    best = (1e-6, None)
    if len(path) < DEPTH and len(rows) >= 40:
        for f, cuts in enumerate(edges):
            if not len(cuts):
                continue
            left_g = np.cumsum(np.bincount(binned[rows, f], grad[rows], len(cuts) + 1))[:-1]
            left_h = np.cumsum(np.bincount(binned[rows, f], hess[rows], len(cuts) + 1))[:-1]
            gain = left_g**2 / (left_h + 1) + (g - left_g)**2 / (h - left_h + 1) - g * g / (h + 1)
            gain[(left_h < 0.5) | (h - left_h < 0.5)] = 0
            cut = int(np.argmax(gain))
            if gain[cut] > best[0]:
                best = (gain[cut], (f, cut))
    if best[1] is None:
        fit[rows] = -g / (h + 1)
        return
    f, cut = best[1]
    above = binned[rows, f] > cut
    for side in (False, True):
        _grow(binned, edges, grad, hess, rows[above == side], (*path, (f, side, float(edges[f][cut]))), found, fit)


def tree_rules(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> list[Rule]:
    """Paths of boosted trees, each once."""
    edges, binned = [], np.empty(x.shape, np.int64)
    for f in range(x.shape[1]):
        values = np.unique(x[:, f])
        between = (values[1:] + values[:-1]) / 2  # halfway to the next value, so that no threshold sits on one
        if len(between) >= BINS:
            marks = np.searchsorted(values, np.quantile(x[:, f], np.arange(1, BINS) / BINS, method="lower"))
            between = between[np.unique(np.minimum(marks, len(between) - 1))]
        edges.append(between)
        binned[:, f] = np.searchsorted(edges[f], x[:, f], side="left")
    score, found = np.zeros(len(y)), []
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-score))
        fit = np.zeros(len(y))
        _grow(binned, edges, weight * (p - y), weight * np.maximum(p * (1 - p), 1e-6), np.arange(len(y)), (), found, fit)
        score += RATE * fit
    return [Rule(tuple(sorted(path))) for path in dict.fromkeys(tuple(sorted(p)) for p in found)]


def _holds(rule: Rule, x: np.ndarray) -> np.ndarray:
    out = np.ones(len(x), bool)
    for f, above, at in rule.terms:
        out &= (x[:, f] > at) == above
    return out


def lasso_logistic(z: np.ndarray, y: np.ndarray, weight: np.ndarray, penalty: float, steps: int = STEPS) -> tuple[np.ndarray, float]:
    """Weights and intercept by accelerated proximal gradient steps; the intercept isn't penalised."""
    z1 = np.column_stack([z, np.ones(len(z))])
    weight = weight / weight.sum()
    v = np.ones(z1.shape[1])
    for _ in range(30):
        v = z1.T @ (weight * (z1 @ v))
        v /= np.linalg.norm(v)
    size = 4 / float(v @ (z1.T @ (weight * (z1 @ v))))
    w = u = np.zeros(z1.shape[1])
    t = 1.0
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(z1 @ u, -30, 30)))
        new = u - size * (z1.T @ (weight * (p - y)))
        new[:-1] = np.sign(new[:-1]) * np.maximum(np.abs(new[:-1]) - size * penalty, 0)
        t, before = (1 + np.sqrt(1 + 4 * t * t)) / 2, t
        u, w = new + (before - 1) / t * (new - w), new
    return w[:-1], float(w[-1])


def fit(x: np.ndarray, y: np.ndarray, weight: np.ndarray, penalty: float = PENALTY) -> Model:
    """The ensemble for features ``x`` and labels 0/1. Where no split tells the classes apart there is no
    rule, and the score is the weighted share of label 1; with one class only it is a constant on its
    side, without rows it is one half."""
    if not len(y) or y.min() == y.max():
        return Model((), (), 0.0 if not len(y) else 3.0 * (2 * float(y[0]) - 1))
    rules = tree_rules(x, y, weight)
    if not rules:
        return Model((), (), float(np.log((weight * y).sum() / (weight * (1 - y)).sum())))
    w, b = lasso_logistic(np.column_stack([_holds(r, x) for r in rules]).astype(float), y, weight, penalty)
    used = np.flatnonzero(np.abs(w) > 1e-9)
    return Model(tuple(rules[i] for i in used), tuple(float(w[i]) for i in used), b)


def compile_score(model: Model, features: Column) -> Column:
    """The model as one expression over the array of features: 0 to 1."""
    total = F.lit(model.intercept)
    for rule, weight in zip(model.rules, model.weights):
        holds = F.lit(True)
        for f, above, at in rule.terms:
            term = features[f] > at
            holds = holds & (term if above else ~term)
        total = total + F.when(holds, F.lit(weight)).otherwise(F.lit(0.0))
    return 1 / (1 + F.exp(-total))


def remainder(doc_id: Column, n: int) -> Column:
    """crc32 of the id's text modulo ``n``; 0 for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % n, F.lit(0))


def train(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, held_out: int = 1, folds: int = 3) -> Model:
    """Fits on at most ``sample_rows`` labelled rows of each class, chosen by a hash of their ids.

    Rows whose ``remainder`` is ``held_out`` are never read. Every row of ``labels`` counts: a document
    labelled twice counts twice, one labelled both 0 and 1 counts on both sides. Rows with a null id or
    with a quality other than 0 and 1 are left out. The weights of the sample restore the share
    of each class among all labelled rows that may be learned from.
    """
    known = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull()).select(
        F.col("doc_id").alias("_id"), F.col("quality").cast("int").alias("y"))
    known = known.where(remainder(F.col("_id"), folds) != held_out)
    totals = {row["y"]: row["n"] for row in known.groupBy("y").agg(F.count("*").alias("n")).collect()}
    picked = None
    for y in (0, 1):
        own = known.where(F.col("y") == y).orderBy(F.xxhash64("_id"), "_id").limit(sample_rows)
        picked = own if picked is None else picked.unionByName(own)
    joined = docs.select("doc_id", "text").join(F.broadcast(picked), F.col("doc_id") == F.col("_id"))
    rows = with_features(joined, "text", ["doc_id", "y"]).orderBy("doc_id", "features").toPandas()
    x = np.array(rows["features"].tolist(), dtype=float).reshape(len(rows), len(FEATURES))
    y = rows["y"].to_numpy(dtype=float)
    share = {k: totals.get(k, 0) / max(1, int((y == k).sum())) for k in (0, 1)}
    return fit(x, y, np.where(y == 1, share[1], share[0]))


def score(docs: DataFrame, model: Model, keep: list[str], text: str = "text") -> DataFrame:
    """``keep`` and ``score`` of every row; empty and null texts are scored by their zero statistics."""
    rows = with_features(docs, text, keep)
    return rows.select(*keep, compile_score(model, F.col("features")).alias("score"))


def classify(docs: DataFrame, model: Model, held_out: int = 1, folds: int = 3) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted."""
    rows = score(docs.select("doc_id", "text"), model, ["doc_id"])
    return rows.select("doc_id", (remainder(F.col("doc_id"), folds) == held_out).alias("held_out"), "score",
                       (F.col("score") >= 0.5).cast("int").alias("predicted"))


def drop_low_quality(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` without the rows that score below 0.5; all columns kept."""
    rows = score(docs.select(F.struct("*").alias("row"), F.col("text").alias("_body")), model, ["row"], "_body")
    return rows.where("score >= 0.5").select("row.*")
