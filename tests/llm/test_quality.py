"""Quality rules: counts against brute force, held-out accuracy, calibration and odd cases."""

import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from drivegrid.llm import quality_rules as qr

SF = "/root/testdata/sf0.01/documents.parquet"
LABELS = "/root/testdata/sf0.01/labels.parquet"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    words, lines = WORD.findall(text), [x for x in text.split("\n") if WORD.search(x)]
    windows = Counter(zip(words, words[1:], words[2:]))
    again = {k + j for k in range(len(words) - 2) if windows[tuple(words[k:k + 3])] > 1 for j in range(3)}
    n = len(words)
    failed = n < 50 or 100 * len(again) > 50 * n
    return n, sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(again), failed


@pytest.fixture(scope="module")
def model(spark):
    return qr.fit(spark.read.parquet(SF), spark.read.parquet(LABELS))


@pytest.mark.parametrize("which", ["odd", "table"])
def test_counts_match_brute_force(spark, odd, model, which):
    df = odd if which == "odd" else spark.read.parquet(SF)
    got = qr.judge(df, model).collect()
    columns = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    assert Counter(tuple(r[c] for c in columns) for r in got) == Counter((r["doc_id"], *brute(r["text"])) for r in df.select("doc_id", "text").collect())
    for r in got:
        assert r["kept"] == (not r["base_failed"] and r["probability"] >= qr.MIN_PROBABILITY)


def test_slices_do_not_change_results(spark, model, monkeypatch):
    rng = np.random.default_rng(1)
    texts = ["", "x", "a b c a b c", "l\nl\n \nl", "   é\x1c", "# # #\n# # #"] + [" ".join(rng.choice(["aa", "b", "c,", "🙂"], int(n))) for n in rng.integers(1, 90, 40)]
    whole = qr.Slice(texts)
    counts, logits = whole.counts(texts), whole.logits(model)
    for k, t in enumerate(texts):
        one = qr.Slice([t])
        assert tuple(one.counts([t]).iloc[0]) == tuple(counts.iloc[k]) == brute(t)[:5]
        assert abs(one.logits(model)[0] - logits[k]) < 1e-9
    monkeypatch.setattr(qr, "SLICE_CHARS", 50)
    spans = list(qr._slices(texts))
    assert [a for a, _ in spans][1:] == [b for _, b in spans][:-1] and spans[-1][1] == len(texts)


def test_logit_matches_plain_sum(model):
    """The same features, one occurrence at a time."""

    def bucket(h, kind):
        h = (h + kind) * 0x9E3779B97F4A7C15 % 2**64
        h ^= h >> 29
        return h * 0x9E3779B97F4A7C15 % 2**64 >> 64 - qr.BITS

    for t in ["The plain text, and more of the plain text.", "é", "", "AB!! CD!!", "x | y | z"]:
        groups = []
        for n in (1, 2, 3, 4):
            grams = []
            for k in range(len(t) - n + 1):
                h = 0
                for j in range(n):
                    h = (h * 0x100000001B3 + ord(t[k + j]) + j + 1) % 2**64
                grams.append(bucket(h, n))
            groups.append(grams)
        words = [zlib.crc32(w.encode()) for w in WORD.findall(t)]
        groups.append([bucket(w, 11) for w in words])
        groups.append([bucket((a * 0x100000001B3 % 2**64) ^ b, 12) for a, b in zip(words, words[1:])])
        want = model.bias + sum(np.mean([model.weights[b] for b in g]) for g in groups if g)
        assert abs(qr.Slice([t]).logits(model)[0] - want) < 1e-6


def test_held_out_rows_are_judged_right(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    part = F.crc32(F.col("doc_id").cast("string")) % 3 == 1
    fitted = qr.fit(docs, labels.filter(~part))
    got = qr.judge(docs, fitted).join(labels.filter(part), "doc_id").filter("NOT base_failed").collect()
    good, bad = ([r for r in got if r["quality"] == q] for q in (1, 0))
    assert len(good) > 900 and len(bad) > 50
    assert np.mean([r["kept"] for r in good]) > 0.98 and np.mean([not r["kept"] for r in bad]) > 0.9
    brier = np.mean([(r["probability"] - r["quality"]) ** 2 for r in got])
    assert brier < 0.3 * np.mean([r["quality"] for r in got]) * (1 - np.mean([r["quality"] for r in got]))


def test_labels_with_gaps_repeats_and_one_kind(spark, odd, empty):
    odd_labels = spark.createDataFrame([(None, 1), (1, None), (2, 1), (2, 0), (2, 1), (6, 1), (8, 0), (99, 0)], "doc_id long, quality int")
    assert qr.judge(odd, qr.fit(odd, odd_labels)).count() == odd.count()
    none = odd_labels.filter("false")
    only_good = qr.judge(odd, qr.fit(odd, none)).collect()
    assert all(r["kept"] != r["base_failed"] for r in only_good)
    bad = qr.judge(odd, qr.fit(odd, odd_labels.filter("quality = 0 AND doc_id = 8"))).collect()
    assert not any(r["kept"] for r in bad)
    assert qr.judge(empty, qr.fit(empty, odd_labels)).count() == 0


def test_fit_is_bounded_and_repeatable(spark):
    docs, labels = spark.read.parquet(SF), spark.read.parquet(LABELS)
    rows = qr._sample(docs.unionByName(docs), labels, "doc_id", "text", 100).select("doc_id").collect()
    assert 50 < len(rows) < 150 and len({r[0] for r in rows}) == len(rows)
    a, b = (qr.fit(docs, labels, steps=2) for _ in range(2))
    assert np.allclose(a.weights, b.weights, atol=1e-4) and abs(a.slope - b.slope) < 1e-2 * a.slope
