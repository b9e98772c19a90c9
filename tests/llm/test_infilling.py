"""Fill-in-the-middle: brute force, round trip and odd cases."""

import hashlib
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from drivegrid.llm import infilling

SF = "/root/testdata/sf0.001/documents.parquet"
UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def brute(doc, text, rate, spm):
    text = text or ""
    units = UNIT.findall(text)
    digest = hashlib.sha256(f"42:{'' if doc is None else doc}".encode()).hexdigest()
    h = [int(digest[8 * k:8 * k + 8], 16) for k in range(4)]
    n = len(units)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    pre, mid, suf = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= rate:
        return n, "plain", None, None, text
    if h[3] % 100 < spm:
        return n, "spm", len(pre), len(mid), f"<S>{suf}<P>{pre}<M>{mid}"
    return n, "psm", len(pre), len(mid), f"<P>{pre}<S>{suf}<M>{mid}"


@pytest.mark.parametrize("rate, spm", [(50, 80), (100, 50), (0, 80)])
@pytest.mark.parametrize("which", ["odd", "table"])
def test_transform_matches_brute_force_and_comes_back(spark, odd, which, rate, spm):
    df = odd if which == "odd" else spark.read.parquet(SF)
    got = infilling.transform(df, rate=rate, spm_rate=spm).withColumn("back", infilling.restored("output", "form")).collect()
    rows = [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]
    assert Counter((r["doc_id"], r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output"]) for r in got) == Counter(
        (d, *brute(d, t, rate, spm)) for d, t in rows
    )
    assert Counter((r["doc_id"], r["back"]) for r in got) == Counter((d, t or "") for d, t in rows)


def test_texts_with_markers_stay_and_near_markers_come_back(spark):
    texts = ["a <P> b", "x<S>", "<M>", "<<P", "<S <S <P <M", "S> <", "<S", "M>P>S> <", " \n ", "<P<S<M", "   x", "🙂 <", "a\x00 b"]
    df = spark.createDataFrame([(k, t) for k in range(40) for t in texts], "doc_id long, text string")
    made = infilling.transform(df, rate=100).withColumn("back", infilling.restored("output", "form"))
    for r in made.join(df.withColumn("doc", F.col("doc_id")), "doc_id").filter("text = back").select("text", "form").distinct().collect():
        assert (r["form"] == "plain") == any(m in r["text"] for m in ("<P>", "<S>", "<M>"))
    assert Counter((r["doc_id"], r["back"]) for r in made.collect()) == Counter((k, t) for k in range(40) for t in texts)


def test_empty_table_and_long_text(spark, empty):
    assert infilling.transform(empty).count() == 0
    df = spark.createDataFrame([(k, "ab \n" * 400_000) for k in range(4)], "doc_id long, text string")
    made = infilling.transform(df, rate=100).withColumn("back", infilling.restored("output", "form")).select("n", F.length("back").alias("c")).collect()
    assert {tuple(r) for r in made} == {(400_001, 1_600_000)}
