"""Licence scan, language identification and language-model scoring."""

import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from drivegrid.llm import languages, licenses, maxent

SF = "/root/testdata/sf0.001/documents.parquet"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def rows(df):
    return [r.asDict() for r in df.collect()]


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


@pytest.mark.parametrize("which", ["odd", "table"])
def test_base_notices_match_brute_force(spark, odd, which):
    df = odd if which == "odd" else spark.read.parquet(SF)
    want = Counter()
    for r in rows(df.select("doc_id", "text")):
        words = WORD.findall(lower(r["text"]))
        places = [(k, label) for p, label in licenses.BASE_PHRASES.items() for n in [len(p.split())] for k in range(len(words)) if words[k:k + n] == p.split()]
        starts = [k for k, _ in places]
        want[r["doc_id"], len(words), len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in places}))] += 1
    got = rows(licenses.scan(df))
    assert Counter((r["doc_id"], r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) for r in got) == want
    for r in got:
        assert set(filter(None, r["base_labels"].split(","))) <= set(filter(None, r["labels"].split(","))) and 0 <= r["score"] <= 1


def test_places_and_spans(spark):
    text = "MIT License, mit-license; the GNU Lesser General Public License v3. All rights reserved"
    r = rows(licenses.scan(spark.createDataFrame([(1, text)], "doc_id long, text string")))[0]
    assert (r["n_base"], r["first_word"], r["last_word"]) == (3, 0, 7)
    assert r["base_labels"] == "gpl,mit" and r["labels"] == "all-rights-reserved,gpl,lgpl,mit"
    assert [tuple(s) for s in r["spans"]] == [(0, 2, "mit", True), (2, 4, "mit", True), (6, 10, "lgpl", False), (7, 10, "gpl", True), (11, 14, "all-rights-reserved", False)]


@pytest.mark.parametrize("text,names,rank", [
    (" MIT", ["mit"], 1), (" Apache-2.0.", ["apache"], 1), (" MIT OR GPL-3.0-only", ["gpl", "mit"], 1), (" MIT AND GPL-3.0-only", ["gpl", "mit"], 3),
    (" MIT OR Apache-2.0 AND GPL-2.0+", ["apache", "gpl", "mit"], 1), (" (MIT OR Apache-2.0) AND GPL-2.0", ["apache", "gpl", "mit"], 3),
    (" GPL-2.0-only WITH Classpath-exception-2.0", ["gpl"], 2), (" MIT OR LicenseRef-own", ["licenseref-own", "mit"], 1), (" MIT AND unknown-thing", ["mit", "unknown-thing"], None),
    (" MIT and then", ["mit", "then"], None), (" MIT) x", ["mit"], 1), (" (MIT", None, None), ("", None, None), (" and MIT", None, None), (" ((MIT))", ["mit"], 1),
])
def test_expressions(text, names, rank):
    got = licenses.parse_expression(text)
    assert got == (None if names is None else (names, rank))


def test_tags_count(spark):
    text = "// SPDX-License-Identifier: MIT AND MPL-2.0\nint x;"
    r = rows(licenses.scan(spark.createDataFrame([(1, text)], "doc_id long, text string")))[0]
    assert (r["labels"], r["n_tags"], r["license_class"], r["score"]) == ("mit,mpl", 1, 2, 1.0)


def test_nothing_to_scan(empty):
    assert licenses.scan(empty).collect() == []


def test_language_of_held_out_texts(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    held = languages.held_out("doc_id")
    model = languages.fit(df.filter(~held))
    found = {r["doc_id"]: r for r in rows(languages.predict(df, model))}
    test = [r for r in rows(df.filter(held)) if r["lang"] is not None]
    right = sum(found[r["doc_id"]]["lang_pred"] == r["lang"] for r in test)
    assert right >= 0.98 * len(test)
    sample = df.agg(F.count("*")).first()[0]
    assert sample == len(found) and all(zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2 for r in test)


def test_mixed_text_is_cut_into_spans(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = languages.fit(df)
    de, en = (df.filter(f"lang = '{v}' AND length(text) BETWEEN 800 AND 3000").orderBy("doc_id").first()["text"][:600] for v in ("de", "en"))
    both = spark.createDataFrame([(1, de + " " + en)], "doc_id long, text string")
    r = rows(languages.predict(both, model, spans=True))[0]
    spans = [tuple(s) for s in r["spans"]]
    assert all(a[1] <= b[0] for a, b in zip(spans, spans[1:]))
    half = {v: sum(min(b, hi) - max(a, lo) for a, b, lang in spans if lang == v and min(b, hi) > max(a, lo)) for v, lo, hi in (("de", 0, 600), ("en", 601, 1201))}
    assert half["de"] > 500 and half["en"] > 500 and 0.3 < r["score"] < 0.75


def test_filter_keeps_texts_of_three_languages(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = languages.fit(df)
    langs = [r[0] for r in df.filter("lang IS NOT NULL").groupBy("lang").count().orderBy("lang").limit(3).collect()]
    parts = [df.filter((F.col("lang") == v) & (F.length("text") > 800)).orderBy("doc_id").first()["text"][:n] for v, n in zip(langs, (800, 600, 600))]
    mixed = spark.createDataFrame([(1, " ".join(parts)), (2, "\u0e01\u0e02 " * 50), (3, "12 34")], "doc_id long, text string")
    found = {r["doc_id"]: r for r in rows(languages.predict(mixed, model))}
    assert found[1]["score"] < 0.5
    assert [r["doc_id"] for r in rows(languages.filter_texts(mixed, model, 0.5))] == [1]


def test_odd_texts(spark, odd, empty):
    model = languages.fit(odd)
    got = {(r["doc_id"], r["lang_pred"], r["score"]) for r in rows(languages.predict(odd, model))}
    by = {d: (p, s) for d, p, s in got}
    assert by[3] == by[4] == by[5] == by[10] == ("und", 0.0)
    assert by[1][0] == "en" and languages.predict(odd, model).count() == odd.count()
    assert languages.predict(empty, languages.fit(empty)).collect() == []
    assert {r["lang_pred"] for r in rows(languages.predict(odd, languages.fit(empty)))} == {"und"}
    kept = languages.filter_texts(odd, model, 0.5)
    assert kept.columns == odd.columns and {r["doc_id"] for r in rows(kept)} == {1, 2, None, 6, 7, 8, 9, -11, 12}


def test_script_narrows_candidates(spark):
    df = spark.createDataFrame([(1, "привет мир как дела", "ru"), (2, "hello world how are you", "en"), (3, "мир", None), (4, "漢字", None)], "doc_id long, text string, lang string")
    by = {r["doc_id"]: r for r in rows(languages.predict(df, languages.fit(df)))}
    assert by[3]["lang_pred"] == "ru" and by[3]["score"] == 1.0
    assert by[4]["lang_pred"] in ("en", "ru") and by[4]["score"] == 0.0  # a script nobody was seen with


def test_viterbi_equals_plain_search():
    rng = np.random.default_rng(3)
    doc = np.repeat(np.arange(6), [1, 5, 3, 7, 2, 4])
    scores = rng.normal(size=(len(doc), 3)) * 4
    got = languages.viterbi(scores.copy(), doc, 2.5)
    for d in range(6):
        at = np.flatnonzero(doc == d)
        cost = lambda seq: sum(scores[i, s] for i, s in zip(at, seq)) - 2.5 * sum(a != b for a, b in zip(seq, seq[1:]))
        best = max(cost(seq) for seq in np.ndindex(*[3] * len(at)))
        assert cost(got[at]) == pytest.approx(best)


def brute_base(docs, held):
    tokens = {k: re.findall(r"[^\x20\x09-\x0D]+", lower(t)) + [None] for k, (_, t) in enumerate(docs)}
    c = Counter(w for k, (d, _) in enumerate(docs) if not held(d) for w in tokens[k])
    n, v = sum(c.values()), len(c)
    out = Counter()
    for k, (d, _) in enumerate(docs):
        base = sum(math.log10((c[w] + 1) / (n + 1 * (v + 1))) for w in tokens[k])
        out[d, held(d), len(tokens[k]), sum(c[w] > 0 for w in tokens[k]), n, round(base, 6)] += 1
    return out


@pytest.mark.parametrize("which", ["odd", "table"])
def test_base_score_matches_brute_force(spark, odd, which):
    df = odd if which == "odd" else spark.read.parquet(SF)
    got = rows(maxent.score(df, languages.held_out("doc_id", 7)))
    docs = [(r["doc_id"], r["text"]) for r in rows(df.select("doc_id", "text"))]
    want = brute_base(docs, lambda d: d is not None and zlib.crc32(str(d).encode()) % 7 == 2)
    assert Counter((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in got) == want
    assert all(r["score"] < 0 for r in got)


def test_model_beats_base_on_held_out_texts(spark):
    got = rows(maxent.score(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), languages.held_out("doc_id", 7)))
    held = [r for r in got if r["held_out"]]
    assert sum(r["score"] for r in held) > 0.99 * sum(r["base_score"] for r in held)


def test_model_gains_three_percent_on_held_out_texts(spark):
    got = rows(maxent.score(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), languages.held_out("doc_id", 7)))
    held = [r for r in got if r["held_out"]]
    assert sum(r["score"] for r in held) > 0.97 * sum(r["base_score"] for r in held)


def test_class_probabilities_sum_to_one():
    rng = np.random.default_rng(1)
    w = rng.normal(size=(maxent.ROWS, 5)).astype(np.float32)
    p = maxent.probabilities(w, np.zeros(5, np.float32), maxent.contexts(rng.integers(0, maxent.BUCKETS, 40), np.array([1, 20, 19])))
    assert np.allclose(p.sum(1), 1, atol=1e-5)
    # within a class: every known token and one share for the unseen
    m = maxent.Classes(np.r_[np.array([5.0, 3, 2]), np.zeros(maxent.BUCKETS - 3)], np.r_[np.array([2.0, 1, 1]), np.zeros(maxent.BUCKETS - 3)], 2)
    assert np.allclose((m.mass + m.kinds + 1) / 10 ** m.within, 1)


def test_nothing_to_score(empty):
    assert maxent.score(empty, languages.held_out("doc_id", 7)).collect() == []


def test_marks_alone_are_no_letters(spark):
    """A variation selector or a lone accent makes no word; accents inside words stay."""
    model = languages.fit(spark.read.parquet(SF))
    texts = ["\u2764\ufe0f 123", "\u0301", "\u0301 \u0301\u0302 !", "e\u0301te\u0301 la ville et le pays", "abc \u0301"]
    got = {r["doc_id"]: r for r in rows(languages.predict(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), model))}
    assert [got[k]["lang_pred"] == "und" for k in range(5)] == [True, True, True, False, False]
    assert got[0]["score"] == 0.0
    kept = languages.filter_texts(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), model, 0.5)
    assert {r["doc_id"] for r in rows(kept)} <= {3, 4}


def test_many_notices_take_linear_time():
    import time

    scanner = licenses.Scanner(licenses.BASE_PHRASES, licenses.NOTICE_PHRASES, licenses.TAGS)
    text = "see the mit license now " * 100_000 + "SPDX-License-Identifier: MIT " * 50_000
    start = time.time()
    found = scanner.scan(text)
    assert time.time() - start < 20 and found["n_base"] == 100_000 and found["n_tags"] == 50_000
    assert (found["first_word"], found["last_word"]) == (2, 499_997)
