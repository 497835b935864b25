"""Quality rules, the classifier, languages, licences and WARC."""

import gzip
import random
import re
import time
import zlib
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from almanac.llm import divergence, language_id, license_scan, queries, rule_ensemble, warc
from almanac.llm.common import saved
from almanac.llm.text_stats import CHAR_CLASSES

SF = "/root/testdata/sf0.001"


def base(text):
    own = re.findall(r"[^\x20\x09-\x0D]+", text)
    triples = list(zip(own, own[1:], own[2:]))
    counts, covered = Counter(triples), set()
    for i, t in enumerate(triples):
        if counts[t] > 1:
            covered |= {i, i + 1, i + 2}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(own), sum(map(len, own)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


def test_base_rules(docs, rows, as_rows):
    got = divergence.judge(docs)
    want = []
    for row in rows:
        own = base(row[1] or "")
        want.append((row[0], *own, own[0] < 50 or 100 * own[4] > 50 * own[0]))
    assert as_rows(got.drop("kept", "char_js", "word_js")) == sorted(want, key=repr)
    assert not [r for r in got.collect() if r["kept"] and r["base_failed"]]


def distance(p, q):
    p, q = np.array(p, float) / sum(p), np.array(q, float)
    m = (p + q) / 2
    part = lambda a: (a[a > 0] * np.log2(a[a > 0] / m[a > 0])).sum()
    return np.sqrt(max(0.0, (part(p) + part(q)) / 2))


def test_distances_against_numpy(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = saved(divergence.measures(docs, "doc_id", "text", "lang"), "measures")
    refs = {r["lang_key"]: r for r in divergence.references(rows).collect()}
    for r in refs.values():
        assert abs(sum(r["char_ref"]) - 1) < 1e-9
    js = {r["doc_id"]: r for r in divergence.judge(docs).collect()}
    seen = 0
    for r in rows.collect():
        got = js[r["doc_id"]]
        assert sum(r["char_counts"]) == r["n_chars"] and len(r["char_counts"]) == len(CHAR_CLASSES) + 1
        if got["char_js"] is not None:
            seen += 1
            assert abs(got["char_js"] - distance(r["char_counts"], refs[r["lang_key"]]["char_ref"])) < 1e-6
        if got["word_js"] is not None:
            assert abs(got["word_js"] - distance(r["word_counts"], refs[r["lang_key"]]["word_ref"])) < 1e-6
    assert seen > 50


def test_rules_keep_clean_documents(spark):
    got = divergence.judge(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"))
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    rows = got.join(labels, "doc_id").where("not base_failed").groupBy("quality", "kept").count().collect()
    n = {(r["quality"], r["kept"]): r["count"] for r in rows}
    assert n.get((1, False), 0) <= 0.01 * n[1, True] and n.get((0, True), 0) <= 0.2 * n[0, False]


def test_rules_of_any_language(spark):
    draw = np.random.default_rng(5)
    rows = []
    for name, first, last in (("ru", 0x430, 0x44F), ("el", 0x3B1, 0x3C9), ("pl", 0x61, 0x7A)):
        words = ["".join(chr(c) for c in draw.integers(first, last, 2 + n % 7)) for n in range(400)]
        weights = 1 / (np.arange(400) + 2.0)
        for kind in ["clean"] * 60 + ["junk"] * 3:
            share = weights / weights.sum() if kind == "clean" else None
            own = list(draw.choice(words if kind == "clean" else words[40:], 300, p=share))
            rows.append((len(rows), " ".join(own), name, kind))
    rows += [(len(rows) + n, r[1], lang, "none") for n, (r, lang) in enumerate(zip(rows, (None, "xx")))]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, kind string")
    got = {r["doc_id"]: r for r in divergence.judge(docs).collect()}
    for n, _, _, kind in rows:
        assert got[n]["kept"] == (kind != "junk"), rows[n]
        assert (got[n]["char_js"] is None) == (got[n]["word_js"] is None) == (kind == "none")


def test_classifier_held_out(spark):
    got = queries.op7_rule_ensemble(spark, "/root/testdata/sf0.01")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    rows = got.where("held_out").join(labels, "doc_id").collect()
    assert all((zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in rows)
    assert np.mean([r["predicted"] == r["quality"] for r in rows]) > 0.95
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_compiled_rules_equal_the_model(spark, docs, rows):
    draw = np.random.default_rng(1)
    x = draw.random((400, len(rule_ensemble.FEATURES)))
    y = ((x[:, 1] > 0.5) & (x[:, 3] < 0.7)).astype(float)
    model = rule_ensemble.fit(x, y, np.ones(len(y)))
    assert 0 < len(model.rules) < 100
    z = model.intercept + sum(w * rule_ensemble._holds(r, x) for r, w in zip(model.rules, model.weights))
    assert ((z > 0) == (y == 1)).mean() > 0.97
    table = spark.createDataFrame([(n, v) for n, v in enumerate(x.tolist())], "id int, features array<double>")
    scores = {r["id"]: r["s"] for r in table.select("id", rule_ensemble.compile_score(model, table["features"]).alias("s")).collect()}
    assert np.allclose([scores[n] for n in range(len(x))], 1 / (1 + np.exp(-z)))
    left = rule_ensemble.drop_low_quality(docs, rule_ensemble.Model((), (), 1.0))
    assert left.columns == docs.columns and left.count() == len(rows)
    assert rule_ensemble.classify(docs, model).where("score is null").isEmpty()


def test_one_class_and_no_labels(spark, nothing):
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert rule_ensemble.train(nothing, none) == rule_ensemble.Model((), (), 0.0)
    assert rule_ensemble.classify(nothing, rule_ensemble.Model((), (), 0.0)).count() == 0


def test_language_held_out(spark):
    folder = "/root/testdata/sf0.01"
    rows = queries.op9_language_id(spark, folder).join(spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in rows if r["held_out"]]
    assert all(zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2 for r in held)
    assert np.mean([r["lang"] == r["lang_pred"] for r in held]) > 0.95


def test_language_of_odd_texts(docs, rows, nothing):
    model = language_id.train(docs, sample_rows=20)
    got = {(r["doc_id"], r["lang_pred"], r["score"]) for r in language_id.identify(docs, model).collect()}
    none = {r[0] for r in rows if not any(c.isalpha() for c in r[1] or "")}
    assert {i for i, lang, _ in got if lang == "und"} == none
    assert all(0 <= s <= 1 for _, _, s in got)
    empty = language_id.train(nothing)
    assert empty.languages == () and language_id.probabilities(empty, "abc") is None


def test_symbols_beyond_the_first_plane():
    model = language_id.Model(("en",), np.zeros((1 << language_id.BITS, 1)), np.zeros(1), 1.0)
    for text in ("\U0001F600\U0001F680 \U0001F600", "\U0001D7D8\U0001D7D9", "12 \U0001F4A9!"):
        assert language_id.grams(text).size == 0 and language_id.probabilities(model, text) is None
    assert (language_id.grams("abc \U0001F600") == language_id.grams("abc !")).all()
    assert language_id.grams("\U00020000\U00010400").size > 0  # letters there stay letters


def test_document_frequencies(docs, rows):
    counts, total = language_id.document_frequencies(docs)
    want = np.zeros_like(counts)
    for row in rows:
        want[np.unique(language_id.grams(row[1]))] += 1
    assert total == len(rows) and (counts == want).all()


def test_licences(spark, docs, rows, nothing):
    templates = license_scan.Templates(license_scan.TEMPLATES, license_scan.THRESHOLD)
    mit = next(t for name, form, t in license_scan.TEMPLATES if (name, form) == ("MIT", "text"))
    lines = mit.split(". ")
    for text, want in (("Released under the MIT License.", {"MIT"}), ("intro words here\n\n" + "\n".join(lines) + "\n\nend", {"MIT"}),
                       ("licensed UNDER cc by-nc 4.0", {"CC-BY-NC-4.0"}), ("nothing to see here at all", set()), (mit[:len(mit) // 2], set())):
        assert {m[1] for m in license_scan.scan_text(text, templates)} == want, text[:40]
    grams = [(n, f, license_scan.bigrams(license_scan.normalised(t))) for n, f, t in license_scan.TEMPLATES]
    for row in rows:  # pruning by size loses nothing
        for _, words in license_scan.units(row[1] or ""):
            own = license_scan.bigrams(words)
            full = {(n, f) for n, f, g in grams if own and 2 * len(own & g) >= license_scan.THRESHOLD * (len(own) + len(g))}
            assert {(n, f) for _, n, f in templates.match(own)} == full
    assert license_scan.scan(docs).count() == len(rows) and license_scan.scan(nothing).count() == 0


def test_licences_inside_long_files():
    templates = license_scan.Templates(license_scan.TEMPLATES, license_scan.THRESHOLD)
    texts = {(name, form): " ".join(t.split()) for name, form, t in reversed(license_scan.TEMPLATES)}
    mit, bsd, apache = texts["MIT", "text"], texts["BSD-3-Clause", "text"], texts["Apache-2.0", "notice"]
    paragraphs = mit.replace("conditions: The", "conditions:\n\nThe").replace("Software. THE", "Software.\n\nTHE")
    clauses = bsd.replace(" 1. ", "\n\n1. ").replace(" 2. ", "\n\n2. ").replace(" 3. ", "\n\n3. ").replace(" THIS SOFTWARE IS", "\n\nTHIS SOFTWARE IS")
    wrapped = re.sub(r"(.{40,60}) ", r"\1\n", apache.replace(" You may", "\n\nYou may").replace(" Unless", "\n\nUnless"))
    header = "\n".join(" * " + line for line in wrapped.split("\n"))
    code = "\n".join(f"value_{n} = compute_{n}(of, the, software, {n})" for n in range(200))
    assert paragraphs.count("\n\n") == 2 and clauses.count("\n\n") == 4 and "* \n" in header
    cases = [(paragraphs, "MIT"), (clauses, "BSD-3-Clause"), (header, "Apache-2.0"), (texts["BSD-2-Clause", "text"], "BSD-2-Clause"),
             ("All of this is ours and is licensed under the MIT License, see there.", "MIT"), ("// SPDX-License-Identifier: MIT", "MIT"),
             ("It comes under the GNU General Public License, version 2, as a whole.", "GPL-2.0"), ("Shared under the terms of the GNU GPLv3 by us", "GPL-3.0"),
             (texts["GPL-3.0", "text"], "GPL-3.0"), (texts["Apache-2.0", "text"], "Apache-2.0"),
             ("all of it under CC BY-NC-SA 4.0 only", "CC-BY-NC-SA-4.0"), (texts["AGPL-3.0", "notice"], "AGPL-3.0"), (texts["GPL-2.0", "notice"], "GPL-2.0")]
    for text, name in cases:
        for whole in (f"{code}\n\nCopyright (c) 2020 A\n\n{text}\n\n{code}", f"{code}\n{text}\n{code}", f"{code} {text} {code}"):
            found = license_scan.scan_text(whole, templates)
            assert {m[1] for m in found} == {name}, (name, found)
            assert len(found) == 1 or len(text) > 5000  # a title above a full text is a place of its own
            assert abs(found[0][3] - whole[:whole.index(text)].count("\n")) <= 1
    full = {name: text for (name, form), text in texts.items() if form == "text"}
    assert {"AGPL-3.0", "GPL-1.0", "LGPL-2.0", "LGPL-2.1", "LGPL-3.0", "BSL-1.0", "Artistic-1.0", "MPL-1.1", "MPL-2.0", "GFDL-1.3", "CC0-1.0", "ISC", "Unlicense"} <= full.keys()
    for name, text in full.items():  # licences of one family hold most of each other's text
        found = license_scan.scan_text(f"{code}\n{text}\n{code}", templates)
        assert {m[1] for m in found if m[2] == "text"} == {name}, (name, found)
    assert len(license_scan.scan_text(f"{code}\n{paragraphs}\n{code}\n{paragraphs}\n{clauses}\n", templates)) == 3
    for text in (code, f"{code}\n{mit[:len(mit) // 2]}\n{code}", "He was released under the terms of the deal by the MIT press"):
        assert license_scan.scan_text(text, templates) == []


def test_sample_of_each_language(spark):
    """The smallest hashes of each language, without ranking more than about twice as many rows."""
    docs = spark.range(30_000).select(F.when(F.col("id") % 3 == 0, F.lit(7)).otherwise(F.col("id")).alias("doc_id"),
                                      F.when(F.col("id") % 10 == 0, "rare").when(F.col("id") % 1000 == 1, "few").otherwise("often").alias("lang"))
    hashes = {}
    for r in docs.distinct().select("doc_id", "lang", F.xxhash64("doc_id", "lang").alias("h")).collect():
        hashes.setdefault(r["lang"], []).append((r["h"], r["doc_id"]))
    got = {}
    for r in language_id.sampled_ids(docs, 200).collect():
        got.setdefault(r["lang"], set()).add(r["doc_id"])
    assert got == {lang: {doc_id for _, doc_id in sorted(own)[:200]} for lang, own in hashes.items()}
    assert len(got["few"]) < 200 == len(got["often"])
    many = spark.range(300).select(F.col("id").alias("doc_id"), F.col("id").cast("string").alias("lang"))
    with pytest.raises(ValueError, match="languages"):
        language_id.sampled_ids(many, 10)


def plain_windows(templates, words, n):
    """Windows by their definition: every start, every end."""
    pairs = list(zip(words, words[1:]))
    size, _, _, own = templates.items[n]
    most = int(size * (2 - templates.t) / templates.t)
    dice = lambda i, j: Fraction(2 * len(set(pairs[i:j + 1]) & own), len(set(pairs[i:j + 1])) + size)
    out, at = [], 0
    while at < len(pairs):
        ends = [j for j in range(at, min(len(pairs), at + license_scan.WINDOW_FACTOR * most)) if pairs[j] in own and pairs[j] not in pairs[at:j]
                and len(set(pairs[at:j + 1])) <= most] if pairs[at] in own else []
        end = max(ends, key=lambda j: (dice(at, j), -j)) if ends else None
        if end is None or dice(at, end) < templates.t:
            at += 1
            continue
        start = max(range(at, end + 1), key=lambda i: (dice(i, end), i))
        out.append((dice(start, end), len(set(pairs[start:end + 1]) & own), n, start, end + 2))
        at = end + 1
    return out


def test_windows_against_their_definition():
    draw, texts = random.Random(6), ["a b c d e f g h i j", "the a b c of the d e f", "x y z x y w", "p q " * 3 + "r s t u v w x y z a b c d e f g h"]
    templates = license_scan.Templates([(f"T{n}", "text", t) for n, t in enumerate(texts)], 0.7)
    found = 0
    for _ in range(400):
        words = []
        while len(words) < draw.randint(5, 90):
            part = draw.choice(texts).split()
            cut = draw.randint(0, len(part))
            words += draw.choice([part, part[:cut], part[cut:], draw.choices("a b c of the x y p q".split(), k=draw.randint(1, 12)), ["a", "b"] * draw.randint(1, 20)])
        for n in range(len(texts)):
            got = list(templates.windows(words, [n]))
            assert got == plain_windows(templates, words, n), words
            found += len(got)
    assert found > 400


def test_time_of_a_text_made_of_licence_bigrams():
    templates = license_scan.Templates(license_scan.TEMPLATES, license_scan.THRESHOLD)
    text = max((t for name, _, t in license_scan.TEMPLATES if name == "GPL-3.0"), key=len)
    own, draw = sorted(license_scan.bigrams(license_scan.normalised(text))), random.Random(7)
    for words in ([w for _ in range(20_000) for w in draw.choice(own)], ["the", "software"] * 100_000):
        start = time.process_time()
        assert license_scan.scan_text(" ".join(words), templates) == []
        assert time.process_time() - start < 15


@pytest.mark.parametrize("n", [10, 60])
def test_classifier_without_rules(spark, n):
    """Few rows, or rows that nothing tells apart, give the share of label 1."""
    docs = spark.createDataFrame([(i, "one and the same text" if n == 60 else f"text {i}") for i in range(n)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(n)] + [(0, 1), (3, 0), (None, 1), (1, None), (2, 7)], "doc_id long, quality int")
    model = rule_ensemble.train(docs, labels, held_out=-1)
    assert model.rules == ()
    marks = [int(i % 3 == 0) for i in range(n)] + [1, 0]  # a document labelled twice counts twice
    got = rule_ensemble.classify(docs, model).collect()
    assert len(got) == n and all(abs(r["score"] - sum(marks) / len(marks)) < 1e-9 and r["predicted"] == 0 for r in got)


PAGES = "page_id long, url string, html string, record string, file string"


@pytest.fixture(scope="module")
def records(spark):
    rows = [(n, f"http://h/{n % 50}", "x" * (n * 37 % 900), "r", None) for n in range(300)]
    rows += [(None, None, None, None, None), (1, "http://h/1", "same", None, None), (1, "http://h/1", "same", None, None), (400, "a\r\nb", "é" * 400_000, None, None)]
    return saved(warc.to_records(spark.createDataFrame(rows, PAGES).repartition(3)), "records")


def test_records_parse_again(spark, records):
    by_file = {}
    for r in sorted(records.collect(), key=lambda r: (r["file"], r["offset"])):
        content = by_file.get(r["file"], b"")
        assert len(content) == r["offset"]
        by_file[r["file"]] = content + bytes(r["record"])
    files = spark.createDataFrame([(str(f), bytearray(c)) for f, c in by_file.items()], "path string, content binary")
    got = {(r["path"], r["offset"], bytes(r["record"])) for r in warc.parse_files(files).collect()}
    assert got == {(str(r["file"]), r["offset"], bytes(r["record"])) for r in records.collect()}
    assert list(warc.split_records(b"WARC/1.0\r\nContent-Length: 9\r\n\r\nshort")) == []


def test_compressed_files_are_read_member_by_member(spark, records):
    own = [bytes(r["record"]) for r in records.orderBy("file", "offset").limit(60).collect()]
    parts = [gzip.compress(r, mtime=0) for r in own]
    starts = np.cumsum([0, *map(len, parts)]).tolist()
    hurt = list(parts)
    hurt[7] = parts[7][:20] + bytes(b ^ 255 for b in parts[7][20:30]) + parts[7][30:]
    hurt[9] = b"not compressed at all"
    hurt[59] = parts[59][:-9]
    files = {"whole": b"".join(parts), "hurt": b"".join(hurt), "plain": b"".join(own), "empty": b"", "null": None, "pair": gzip.compress(own[0] + own[1], mtime=0)}
    got = {}
    for r in warc.parse_files(spark.createDataFrame(list(files.items()), "path string, content binary")).collect():
        got.setdefault(r["path"], []).append((r["offset"], bytes(r["record"]), r["intact"]))
    assert sorted(got["whole"]) == [(o, r, True) for o, r in zip(starts, own)]
    assert [r for _, r, _ in sorted(got["plain"])] == own and got.keys() == {"whole", "hurt", "plain", "pair"}
    assert {r for _, r, ok in got["hurt"] if ok} == {r for n, r in enumerate(own) if n not in (7, 9, 59)}
    at = np.cumsum([0, *map(len, hurt)]).tolist()
    assert sorted((o, r) for o, r, ok in got["hurt"] if not ok) == [(at[n], hurt[n]) for n in (7, 9, 59)]
    assert [(o, ok) for o, _, ok in got["pair"]] == [(0, True), (0, True)]


def test_audit_keeps_columns_of_any_name(spark, records):
    named = records.withColumn("length", F.lit("own")).withColumn("range", F.col("page_id")).withColumn("record_id", F.lit(1)).withColumn("sha256", F.lit(None).cast("string"))
    gone = named.where("offset > 0")
    got = warc.audit(named, gone, keep=("length", "range", "record_id", "sha256"))
    assert got.columns[:4] == ["length", "range", "record_id", "sha256"]
    assert {r["length"] for r in got.collect()} == {"own"} and got.count() == named.where("offset = 0").count()
    with pytest.raises(ValueError, match="status"):
        warc.audit(named.withColumn("status", F.lit(1)), gone, keep=("status",))


def test_audit(spark, records, as_rows):
    assert warc.audit(records, records).count() == 0
    rows = [list(r) for r in records.collect()]
    schema = records.schema
    rows[5][4] = rows[5][4][:-3] + b"!\r\n"
    rows[17][4] = rows[17][4][:-4]
    rows[30][4] = rows[30][4] + b"more"
    gone = rows.pop(60)
    rows.append([999, "new", 7 << 20, 0, bytearray(b"extra")])
    got = {(r["page_id"], r["file"], r["offset"], r["status"]) for r in warc.audit(records, spark.createDataFrame(rows, schema)).collect()}
    want = {(rows[n][0], rows[n][2], rows[n][3], s) for n, s in ((5, "altered"), (17, "truncated"), (30, "extended"))}
    assert got == want | {(gone[0], gone[2], gone[3], "missing"), (999, 7 << 20, 0, "extra")}
    none = records.limit(0)
    assert warc.audit(none, none).count() == 0 and warc.audit(records, none).count() == records.count()


def test_damage_moves_what_follows(spark, records):
    own = sorted(records.collect(), key=lambda r: (r["file"], r["offset"]))
    number = next(n for n in range(5, 200) if len({r["file"] for r in own[n:n + 30]}) == 1)
    rows = [list(r) for r in own]
    rows[number][4] = rows[number][4][:-10]  # cut
    rows[number + 9][4] = rows[number + 9][4].replace(b"Content-Length", b"Content-Lengt#")  # not to be parsed
    gone = rows.pop(number + 4)
    rows.insert(number + 15, [None, None, gone[2], own[number + 15][3], bytearray(b"no record\r\n")])
    second = warc.read_back(spark.createDataFrame(rows, records.schema))
    got = {(r["page_id"], r["status"]) for r in warc.audit(records, second).collect()}
    want = {(own[number][0], "truncated"), (own[number + 9][0], "altered"), (gone[0], "missing"), (None, "extra")}
    assert got == want
    content = b"".join(bytes(r[4]) for r in rows if r[2] == gone[2])
    found = list(warc.pieces(content))
    assert b"".join(p for _, p, _ in found) == content and sum(not intact for _, _, intact in found) == 3
    intact = {bytes(r["record"]) for r in own if r["file"] == gone[2]} - {bytes(own[n]["record"]) for n in (number, number + 4, number + 9)}
    assert {r for _, r in warc.split_records(content)} == intact
    assert warc.audit(records, warc.read_back(records)).count() == 0
