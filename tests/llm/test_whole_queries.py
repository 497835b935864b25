"""Queries without SQL against plain Python over their whole tables, and the pipeline on odd rows."""

import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import regex
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from almanac.llm import divergence, language_id, packing, queries, rule_ensemble
from almanac.llm.common import table, tokenizer_file
from tests.llm.conftest import SCHEMA
from tests.llm.test_dedup import order, removed, similar, words
from tests.llm.test_models import base, distance

SF = "/root/testdata/sf0.001"
CLASSES = ["[a-z]", r"[\p{Lu}\p{Lt}]", r"[[\p{Ll}\p{Lm}\p{Lo}]--[a-z]]", r"\p{N}", r"[\t\n\x0B\f\r ]", r"[.,;:?'\"()\-]", r"[!\#*$%\&|<>]"]


def char_counts(text):
    counts = [len(regex.findall(f"(?V1){c}", text)) for c in CLASSES]
    return [*counts, len(text) - sum(counts)]


def letter_words(text):
    return [w for w in regex.split(r"[^\p{L}]+", text.lower()) if w]


def median(values):
    return sorted(values)[math.ceil(len(values) / 2) - 1]


def plain_judge(rows):
    """Every step of the rules over (doc_id, text, lang)."""
    texts = [(doc_id, text or "", lang) for doc_id, text, lang in rows]
    by_lang, n_docs = defaultdict(Counter), Counter()
    for _, text, lang in texts:
        own = letter_words(text)
        if lang is not None and len(own) >= divergence.MIN_WORDS:
            by_lang[lang].update(set(own))
            n_docs[lang] += 1
    common = {lang: [w for w, n in sorted(c.items(), key=lambda x: (-x[1], x[0])) if n * divergence.RARE >= n_docs[lang]][:divergence.N_COMMON]
              for lang, c in by_lang.items()}
    measured = []
    for doc_id, text, lang in texts:
        own, listed, stats = letter_words(text), common.get(lang, []), base(text)
        counts = Counter(own)
        held = [counts[w] for w in listed] + [0] * (divergence.N_COMMON - len(listed))
        measured.append((doc_id, lang, stats, stats[0] < 50 or 100 * stats[4] > 50 * stats[0], char_counts(text), [*held, len(own) - sum(held)]))
    refs = {}
    for lang in {m[1] for m in measured} - {None}:
        good = [m for m in measured if m[1] == lang and not m[3]]
        if len(good) >= divergence.MIN_DOCS:
            found = []
            for at in (4, 5):
                shares = [np.array(m[at]) / sum(m[at]) for m in good if sum(m[at])]
                typical = np.array([median([s[n] for s in shares]) for n in range(len(shares[0]))])
                found.append(typical / typical.sum())
            refs[lang] = found
    out = {}
    for doc_id, lang, stats, failed, chars, counted in measured:
        js = [None, None]
        if lang in refs and sum(chars) >= divergence.MIN_CHARS:
            js[0] = distance(chars, refs[lang][0])
        if lang in refs and sum(counted) >= divergence.MIN_WORDS:
            js[1] = distance(counted, refs[lang][1])
        far = (js[0] is not None and js[0] > divergence.MAX_CHAR_JS + divergence.CHAR_NOISE / math.sqrt(sum(chars))
               or js[1] is not None and js[1] > divergence.MAX_WORD_JS + divergence.WORD_NOISE / math.sqrt(sum(counted)))
        out[doc_id] = (*stats, failed, not failed and not far, *js)
    return out


def test_op2_whole(spark):
    docs = [tuple(r) for r in table(spark, SF, "documents").select("doc_id", "text", "lang").collect()]
    want = plain_judge(docs)
    got = {r["doc_id"]: tuple(r)[1:] for r in queries.op2_divergence(spark, SF).collect()}
    assert got.keys() == want.keys() and len({w[6] for w in want.values()}) == 2
    for doc_id, row in want.items():
        assert got[doc_id][:7] == row[:7], doc_id
        for a, b in zip(got[doc_id][7:], row[7:]):
            assert (a is None) == (b is None) and (a is None or abs(a - b) < 1e-6)


def test_op7_whole(spark):
    """Scores by rules evaluated in plain Python on features counted in plain Python."""
    docs = table(spark, SF, "documents")
    model = rule_ensemble.train(docs, table(spark, SF, "labels"))
    got = {r["doc_id"]: r for r in queries.op7_rule_ensemble(spark, SF).collect()}
    rows = docs.select("doc_id", "text").collect()
    assert got.keys() == {r["doc_id"] for r in rows} and model.rules
    for doc_id, text in rows:
        text = text or ""
        n_words, word_chars, n_symbols, n_dup, n_repeat = base(text)
        lines = [x for x in text.split("\n") if regex.search(r"[^\x20\x09-\x0D]", x)]
        share = lambda a, b: a / b if b else 0.0
        values = {"words": float(n_words), "word_length": share(word_chars, n_words), "distinct_words": share(len(set(words(text))), n_words),
                  "repeated_words": share(n_repeat, n_words), "repeated_lines": share(n_dup, len(lines)), "line_length": share(n_words, len(lines)),
                  "symbols": share(n_symbols, n_words)}
        x = [values[name] if name in values else None for name in rule_ensemble.FEATURES]
        chars = iter(char_counts(text))
        x = [share(next(chars), len(text)) if v is None else v for v in x]
        z = model.intercept + sum(w for r, w in zip(model.rules, model.weights) if all((x[f] > at) == above for f, above, at in r.terms))
        assert abs(got[doc_id]["score"] - 1 / (1 + math.exp(-z))) < 1e-9
        assert got[doc_id]["predicted"] == int(got[doc_id]["score"] >= 0.5) and got[doc_id]["held_out"] == (zlib.crc32(str(doc_id).encode()) % 3 == 1)


def test_op9_whole(spark):
    """Document frequencies by plain counting, and every prediction from the weights."""
    docs = table(spark, SF, "documents")
    rows = [tuple(r) for r in docs.select("doc_id", "text", "lang").collect()]
    learned = [(t, lang) for d, t, lang in rows if lang is not None and zlib.crc32(str(d).encode()) % 4 != 2]
    counts = Counter(int(g) for t, _ in learned for g in set(language_id.grams(t).tolist()))
    own = docs.where((rule_ensemble.remainder(docs["doc_id"], 4) != 2) & docs["lang"].isNotNull())
    frequency, total = language_id.document_frequencies(own)
    assert total == len(learned) and {int(g): int(frequency[g]) for g in np.flatnonzero(frequency)} == dict(counts)
    model = language_id.train(own)
    assert set(model.languages) == {lang for _, lang in learned}
    got = {r["doc_id"]: r for r in queries.op9_language_id(spark, SF).collect()}
    for doc_id, text, _ in rows:
        grams, r = language_id.grams(text), got[doc_id]
        assert r["held_out"] == (zlib.crc32(str(doc_id).encode()) % 4 == 2)
        if not len(grams):
            assert (r["lang_pred"], r["score"]) == ("und", 0.0)
            continue
        z = (sum(model.table[g].astype(float) for g in grams) / len(grams) + model.bias) / model.temperature
        p = np.exp(z - z.max()) / np.exp(z - z.max()).sum()
        assert r["lang_pred"] == model.languages[int(np.argmax(p))] and abs(r["score"] - p.max()) < 1e-5


# ---- the pipeline


@pytest.fixture
def folder(spark, tmp_path, rows):
    def write(documents, labels):
        spark.createDataFrame(documents, SCHEMA).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
        spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
        return str(tmp_path)

    return write


def test_pipeline_on_odd_rows(spark, folder, rows):
    """Nulls, empty and long texts, copies, repeated rows, clashing columns; labels of one class keep all."""
    got = corpus_pipeline.run(spark, folder(rows, [(n, 1, 0) for n in range(10)] + [(None, 0, 0), (5, None, 0)])).collect()
    groups = defaultdict(list)
    for r in rows:
        groups[r[1] or ""].append(r[0])
    kept = [(max(ids, key=order), text) for text, ids in groups.items()]
    first, _, lowest = similar(kept)
    kept = [(i, t) for t, i in first.items() if lowest[t] == i]
    tokenizer, want = Tokenizer.from_file(tokenizer_file(packing.VOCABULARY)), []
    for (doc_id, text), own in zip(kept, removed(kept, 35)):
        text = text if len(own) == len(words(text)) else b" ".join(own).decode()
        ids = np.array(tokenizer.encode(text, add_special_tokens=False).ids + [1], "<u4")
        want += [(doc_id, n, s, len(ids[s:s + 4096]), zlib.crc32(ids[s:s + 4096].tobytes())) for n, s in enumerate(range(0, len(ids), 4096))]
    assert sorted(((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got), key=repr) == sorted(want, key=repr)
    assert got and all(r["offset"] + r["length"] <= 4096 for r in got)


def test_pipeline_on_equal_texts_and_on_nothing(spark, folder, tmp_path, rows):
    some = [(n, "one and the same text", "en", None, None, None, None, None) for n in range(60)]
    got = corpus_pipeline.run(spark, folder(some, [(n, int(n % 3 > 0), 0) for n in range(60)])).collect()
    assert [(r["doc_id"], r["piece"], r["start"], r["offset"]) for r in got] == [(59, 0, 0, 0)]
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, str(tmp_path)).count() == 0, name


def test_stages_keep_columns_of_any_name(spark, folder, tmp_path, rows):
    place = folder(rows, [(n, 1, 0) for n in range(10)])
    docs = spark.read.parquet(f"{place}/documents.parquet").withColumn("word", F.lit(1)).withColumn("maybe", F.lit("x")).withColumn("spans", F.lit(None).cast("string"))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, place)
        assert out.columns == docs.columns and out.where("maybe != 'x' or word != 1 or spans is not null").isEmpty(), name
